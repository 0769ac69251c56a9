import random

import pytest

from trackloom.operators import unpack, widen

TAGS = "tag_id long, path string, tag_key string, tag_value string, field int, value int"


def tags(spark, rows):
    return spark.createDataFrame([(i, p, k, v, 1, 2) for i, (p, k, v) in enumerate(rows)], TAGS)


@pytest.mark.parametrize(
    "key,value,field,want",
    [
        ("TRCK", "08/12", "trackno", 8), ("Track Number", " 3 ", "trackno", 3), ("track", "7 of 9", "trackno", 7), ("TRACK", "side B", "trackno", None), ("disc", "2/2", "discno", 2),
        ("DATE", "(P) 1998", "rel_year", 1998), ("year", "1967年", "rel_year", 1967), ("TDRC", "19??", "rel_year", None), ("date", "20010315", "rel_year", 2001), ("date", "1899", "rel_year", None),
        ("LENGTH", "0:08:36", "seconds", 516), ("length", "3:22", "seconds", 202), ("DURATION", "PT3M5S", "seconds", 185), ("length", "9 min 5 s", "seconds", 545), ("length", "247000 ms", "seconds", 247), ("length", "--:--", "seconds", None), ("length", "176.0", "seconds", 176),
        ("TBPM", "138,8", "bpm", 138.8), ("BPM", "130bpm", "bpm", 130.0), ("bpm", "fast", "bpm", None), ("REPLAYGAIN_TRACK_GAIN", "−1.73 dB", "gain_db", -1.73), ("RG_TRACK_GAIN", "-11,97dB", "gain_db", -11.97), ("replaygain_track_gain", "dB", "gain_db", None), ("replaygain_album_gain", "1 dB", "gain_db", None),
        ("TCMP", "Y", "is_compilation", True), ("compilation", "0", "is_compilation", False), ("compilation", "maybe", "is_compilation", None), ("ARTIST ", "   ", "artist", None), ("album_artist", "Ann", "albumartist", "Ann"), ("ORIGINALYEAR", "1990", "rel_year", None), ("title", "x" * 30000, "title", "x" * 30000),
    ],
)
def test_cells(spark, key, value, field, want):
    row = widen.wide(tags(spark, [("p", key, value)])).first()
    assert row[field] == want


def test_wide_rows(spark, got):
    df = tags(spark, [("p", "artist", "A"), ("p", "ARTIST", "B"), ("p", "bpm", "fast"), ("p", "BPM", None), ("p", "X_1", "y"), ("p", "artist", "A"), ("q", None, "z"), (None, "artist", "A"), ("r", "", "z")])
    rows = {r["path"]: r for r in widen.wide(df).collect()}
    assert set(rows) == {"p", "q", "r"} and rows["p"]["artist"] == "A" and rows["p"]["bpm"] is None
    assert rows["p"]["cast_failures"]["bpm"]["n"] == 2 and rows["p"]["cast_failures"]["bpm"]["first"] == "fast" and rows["q"]["cast_failures"] == {}
    assert got(widen.filled(df)) == [("p", "artist")]
    assert got(widen.failures(df)) == [(2, "p", "bpm", "fast"), (3, "p", "bpm", None)]
    assert widen.wide(df.limit(0)).count() == 0 and widen.filled(df.limit(0)).count() == 0


@pytest.mark.parametrize("key,field", [("©nam", "title"), ("©ART", "artist"), ("©alb", "album"), ("©gen", "genre"), ("©day", "rel_year"), ("Track #", "trackno"), ("(Year)", "rel_year"), ("©cmt", None)])
def test_signs_in_keys(spark, got, key, field):
    df = tags(spark, [("p", key, "1998")])
    assert got(widen.filled(df)) == ([("p", field)] if field else [])


ARTISTS = ["Ann Lee", "Bob Ray", "Cy", "Duo/Two", "Kay, Reds & Co.", "Zed"]


def values(spark, artists, more=()):
    flacs = spark.createDataFrame([(i, a, "x") for i, a in enumerate([*artists, *ARTISTS])], "flac_id long, artist string, text string")
    t = spark.createDataFrame([(i, "p", k, v) for i, (k, v) in enumerate(more)], "tag_id long, path string, tag_key string, tag_value string")
    terms = spark.createDataFrame([(1, "genre", "Rock & Roll"), (2, "genre", "Jazz"), (3, "genre", "Rock")], "term_id long, term_kind string, term string")
    out = {}
    for r in unpack.unpack(flacs, t, terms).orderBy("src", "rec_id", "pos").collect():
        out.setdefault((r["src"], r["rec_id"]), []).append((r["pos"], r["value"]))
    return {k: [v for _, v in vs] for k, vs in out.items() if [p for p, _ in vs] == list(range(1, len(vs) + 1))}


def test_unpack(spark):
    packed = ["Ann Lee; bob ray", '"Cy"|"Ann Lee"', "Duo/Two/Cy", "Kay, Reds & Co., Zed", "Lee, Ann", "Ann Lee feat. Cy vs. Zed", "Cy;;Zed;", "Cy; Cy", "Cy; Nobody", None, "", ";", "Cy ; Duo/Two\\\\Zed", "Cy, " * 400 + "Zed"]
    got = values(spark, packed, [("GENRE", "Rock & Roll, Jazz"), ("mood", "Jazz"), ("TCON", "Rock & Jazz"), ("comment", "Cy; Zed"), ("Performer", None)])
    want = {("flacs", 0): ["Ann Lee", "bob ray"], ("flacs", 1): ["Cy", "Ann Lee"], ("flacs", 2): ["Duo/Two", "Cy"], ("flacs", 3): ["Kay, Reds & Co.", "Zed"], ("flacs", 5): ["Ann Lee", "Cy", "Zed"], ("flacs", 6): ["Cy", "Zed"],
            ("flacs", 7): ["Cy", "Cy"], ("flacs", 12): ["Cy", "Duo/Two", "Zed"], ("flacs", 13): ["Cy"] * 400 + ["Zed"], ("flac_tags", 0): ["Rock & Roll", "Jazz"], ("flac_tags", 2): ["Rock", "Jazz"]}
    assert got == want


def test_unpack_empty(spark):
    assert values(spark, []) == {}


def test_shortest_against_brute_force():
    r = random.Random(4)
    book = {"a": 1.0, "b": 3.0, "a/b": 2.0, "c": 5.0, "b,c": 4.0}

    def brute(text):
        at = unpack.cuts(text)
        best = None
        for mask in range(1, 1 << (len(at) - 2)):
            own = [0, *(i for i in range(1, len(at) - 1) if mask >> (i - 1) & 1), len(at) - 1]
            parts = [(unpack.bare(text[at[x][1] : at[y][0]])[0], y - x) for x, y in zip(own, own[1:])]
            if any(p not in book if p else n > 1 for p, n in parts):
                continue
            kinds = {text[slice(*at[i])].lower() for i in own[1:-1]}
            n = sum(bool(p) for p, _ in parts)
            cost = sum(book.get(p, 0) for p, _ in parts) + unpack.KIND * len(kinds) + unpack.CUT * len(parts)
            if n >= 2 and (best is None or cost < best):
                best = cost
        return best if best is not None and best < unpack.CHAR * len(text) else None

    for _ in range(200):
        text = r.choice("abc") + "".join(r.choice("/,;") + r.choice(("a", "b", "c", "", "x")) for _ in range(r.randrange(1, 6)))
        at = unpack.cuts(text)
        known = {(i, j): book[p] for i in range(len(at)) for j in range(i + 1, len(at)) if (p := text[at[i][1] : at[j][0]]) in book}
        parts = unpack.shortest(text, known)
        want = brute(text)
        assert bool(parts) == (want is not None), text
        if parts:
            assert all(p in book for p in parts)


def test_long_value_in_a_field(spark):
    """A name with more separators than ``INNER`` is one value, found from the code book."""
    name = ", ".join(f"P{i}x" for i in range(unpack.INNER + 6)) + " & Co"
    flacs = spark.createDataFrame([(1, name), (2, "Ann Lee"), (3, f"{name}; Ann Lee"), (4, f'Ann Lee; "{name}"; Bob Ray'), (5, "Bob Ray")], "flac_id long, artist string")
    tags = spark.createDataFrame([], "tag_id long, path string, tag_key string, tag_value string")
    out = {}
    for r in unpack.unpack(flacs, tags, spark.createDataFrame([], "term string")).collect():
        out.setdefault(r["rec_id"], {})[r["pos"]] = r["value"]
    assert out == {3: {1: name, 2: "Ann Lee"}, 4: {1: "Ann Lee", 2: name, 3: "Bob Ray"}}


@pytest.mark.parametrize("key", ["©ART", "Track Artist", "ARTISTS", "©gen", "Genre Name", "©wrt", "Composers", "Performers", "Moods", "LANGUAGES"])
def test_other_names_of_packed_tags(spark, key):
    """A tag is unpacked under each usual name, those that the wide table knows among them."""
    assert values(spark, [], [(key, "Cy; Zed"), ("album artist", "Cy; Zed")]) == {("flac_tags", 0): ["Cy", "Zed"]}
