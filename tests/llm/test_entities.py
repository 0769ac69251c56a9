import os
import re
from itertools import product

import numpy as np
import pytest

from trackloom.llm import labelled, linkage, names, packing, private, queries, tokens

SAME = [
    ("Nathaniel Stabrusobun", "N. Stabrusobun"), ("Nate Nutubokre", "Nathaniel Nutubokre"), ("Zogadukris, David", "Daavid Zogadukris"), ("The Kopizuga Candles", "Kopizuga Candles, The"), ("Krukrupotrir R.O.", "Krukrupotrir Radio Orchestra"),
    ("Vastapaste CC", "Vastapaste Chamber Choir"), ("Symphony Orchestra of Petruzotrus", "The Petruzotrus Symphony Orchestra"), ("Drõvikruder 'n' the Islands", "Drovikruder & the Islands"), ("A. Rifozage", "Alexander Rifozage"),
    ("Vapesisun Volume 6", "Vapesisun, Vol. VI"), ("Music for Tubo, Pt. 3", "Music for Tubo, Part III"), ("Live @ Foso Hall", "Foso Hall (Live)"), ("Zefi Symphony #4", "Zefi Sym. No. 4"), ("Ravekokar, Vol1", "Ravekokar, Vol. 1"), ("Nites in Shosho", "Nights in Shosho"),
]
OTHER = [("Gregory Zutroledrun", "Gregory Zutroledrun Quintet"), ("Leonard Studuramus", "Cosima Studuramus"), ("Dukolaril, Vol. 1", "Dukolaril, Vol. 2"), ("Music for Tubo, Part 3", "Music for Tubo, Part 4"), ("Songs from Tubo", "Nights in Tubo"), ("The Road to Baka", "The Road to Zoku"), ("Ann Lee", "Ann Ray"), ("Kuku", "Koko")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert names.monge_elkan(names.words_of(names.fold(a)), names.words_of(names.fold(b))) >= names.ACCEPT


@pytest.mark.parametrize("a,b", OTHER)
def test_other(a, b):
    assert names.monge_elkan(names.words_of(names.fold(a)), names.words_of(names.fold(b))) < names.ACCEPT


def test_collision_curve():
    b = names.bands()
    assert 1 - (1 - names.MEET**names.ROWS) ** b >= names.RECALL > 1 - (1 - names.MEET**names.ROWS) ** (b - 1)


def test_clusters(spark, got):
    rows = [("artist", "David Zogadukris")] * 5 + [("artist", x) for x in ("DAVID ZOGADUKRIS", "Zogadukris, David", "Daavid Zogadukris", "D. Zogadukris", "Clara Zogadukris", None, "", "  ", "...")] + [("album", "David Zogadukris"), ("album", "Zogadukris Suite"), ("album", "x" * 3000)]
    df = spark.createDataFrame([(f, n, "c") for f, n in rows], "field string, name string, key string")
    pairs = got(names.variant_pairs(names.cluster_names(df)))
    own = sorted(["David Zogadukris", "DAVID ZOGADUKRIS", "Zogadukris, David", "Daavid Zogadukris", "D. Zogadukris"])
    assert pairs == sorted(("artist", a, b) for i, a in enumerate(own) for b in own[i + 1 :])
    assert names.cluster_names(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [24, 60, 1000])
def test_usual_words_do_not_part(spark, n):
    """Two spellings made of words that many names have are candidates at every size."""
    made = ["".join(x) for x in product(("bel", "dor", "fim", "gas", "hul"), ("tan", "rus", "vok", "zel", "mip"), ("", "ba", "cho", "di", "fu", "ge", "hy", "jo"), ("lor", "nim", "pag", "qua", "sys"))]
    keys = [f"kestrel {w}" for w in made[:n]] + [f"wandering {w}" for w in made[-n:]] + ["kestrel wandering", "kesrtel wandering"]
    df = spark.createDataFrame([("artist", k) for k in keys], "field string, key string")
    assert ("kesrtel wandering", "kestrel wandering") in {(r["a"], r["b"]) for r in names.candidates(df).collect()}


def test_candidates_against_all_pairs(spark, monkeypatch):
    """Every pair that the similarity accepts is a candidate, whether bands are joined whole or in parts."""
    keys = sorted({names.fold(x) for p in SAME + OTHER for x in p})
    df = spark.createDataFrame([("artist", k) for k in keys], "field string, key string")
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if names.monge_elkan(names.words_of(a), names.words_of(b)) >= names.ACCEPT}
    whole = {(r["a"], r["b"]) for r in names.candidates(df).collect()}
    assert len(want & whole) >= 0.95 * len(want) > 10
    monkeypatch.setattr(names, "PART", 1)
    assert {(r["a"], r["b"]) for r in names.candidates(df).collect()} == whole


def _accepted(keys):
    words = [names.words_of(k) for k in keys]
    return {(a, b) for i, a in enumerate(keys) for j, b in enumerate(keys[i + 1 :], i + 1) if names.monge_elkan(words[i], words[j]) >= names.ACCEPT}


def test_shared_syllables_make_no_candidates(spark):
    """Names whose words only share syllables do not meet, so pairs do not grow with the square of the keys."""
    made = ["".join(x) for x in product(("bel", "dor", "fim", "gas", "hul"), ("a", "o"), ("tan", "rus", "vok", "zel", "mip"), ("ba", "cho", "di", "fu", "ge"))]
    keys = sorted({f"{n} {w}" for w in made for n in ("songs from", "nights in")} | {f"songs from {w[:3]}{w[4]}{w[3]}{w[5:]}" for w in made[::9]})
    got = {(r["a"], r["b"]) for r in names.candidates(spark.createDataFrame([("album", k) for k in keys], "field string, key string")).collect()}
    want = _accepted(keys)
    assert want <= got and len(got) <= len(want) + 3 * len(keys)


def test_no_similar_pair_is_lost(spark):
    """Names of few words in all kinds of short and mistyped forms: every pair that the similarity accepts is a candidate."""
    rng = np.random.default_rng(5)
    vocabulary = "nathaniel robert katherine zanibor krepola vastiman abc hall live orchestra radio symphony quartet teh fro 12 b kr dj and the drokan".split() + ["q" * 11 + "werty" * 4, "ab" * 12]

    def bent(w):
        kind, at = rng.integers(0, 8), int(rng.integers(0, len(w)))
        if kind == 0:
            return w[:1]
        if kind == 1:
            return w[:at] + w[at + 1 :] or w
        if kind == 2:
            return w[:at] + w[at : at + 2][::-1] + w[at + 2 :]
        if kind == 3:
            return w[:3]
        if kind == 4:
            return w[:1] + "".join(ch for ch in w[1:] if ch not in "aeiouy")[:2]
        return {"nathaniel": "nate", "robert": "bob", "katherine": "kit"}.get(w, w)

    keys = set()
    for _ in range(160):
        name = [vocabulary[i] for i in rng.integers(0, len(vocabulary), int(rng.integers(1, 5)))]
        keys.add(" ".join(name))
        keys |= {" ".join(bent(w) for w in name) for _ in range(2)}
        if len(name) > 2:
            keys.add(" ".join(["".join(w[0] for w in name[:2]), *(bent(w) for w in name[2:])]))
    keys = sorted(keys)
    got = {(r["a"], r["b"]) for r in names.candidates(spark.createDataFrame([("artist", k) for k in keys], "field string, key string")).collect()}
    want = _accepted(keys)
    assert len(want) > 200 and want <= got


def test_stars_reach_rest(spark):
    nodes = spark.createDataFrame([("f", f"k{i}", 10 - i) for i in range(6)], "field string, key string, n long")
    edges = spark.createDataFrame([("f", f"k{i}", f"k{i + 1}", 0.9) for i in range(5)], "field string, a string, b string, sim double")
    out = {r["key"]: r["center"] for r in names.star_clusters(nodes, edges).collect()}
    assert out == {"k0": "k1", "k1": "k1", "k2": "k1", "k3": "k3", "k4": "k3", "k5": "k5"}  # by degree, then weight


def test_stars_in_any_number_of_rounds(spark):
    """A chain whose ranks fall gives a star in each round; none is left over."""
    n = 80
    nodes = spark.createDataFrame([("f", f"k{i:02}", 1000 - i) for i in range(n)], "field string, key string, n long")
    edges = spark.createDataFrame([("f", f"k{i:02}", f"k{i + 1:02}", 0.9) for i in range(n - 1)], "field string, a string, b string, sim double")
    out = {r["key"]: r["center"] for r in names.star_clusters(nodes, edges).collect()}
    assert set(out.values()) == {f"k{i:02}" for i in range(1, n, 2)} and all(abs(int(k[1:]) - int(c[1:])) <= 1 for k, c in out.items())


FLACS = "flac_id long, path string, norm string, artist string, album string, title string, trackno long, duration long, rec long"
LIBRARY = [
    (1, "/a/1", "01 - red sky", "Ann Lee", "Blue Road", "Red Sky", 1, 200, 0), (2, "/b/1", "01", "A. Lee", "Blue Road", "Red Ski", 1, 201, 0), (3, "/c/1", "01 - red sky", "Ann Lee", "Blue Road", "Red Sky (Live)", 2, 260, 0),
    (4, "/d/1", "01", None, "Blue Road", "Red Sky", 1, 199, 0), (5, "/e/1", "track 01", "Ann Lee", "Blue Road", None, 1, 200, 0), (6, "/f/1", "x", "Bob Ray", "Grey", "Red Sky", 4, 150, 0), (7, "/g/1", "x", "Bob Ray; Ann Lee", "Grey", "Cold Wind", 5, 300, 0),
    (8, "/a/1", "01 - red sky", "Ann Lee", "Blue Road", "Red Sky", 1, 200, 0), (9, None, "n", "Ann Lee", "Blue Road", "Red Sky", 1, 200, 0), (10, "/h/1", "n", None, None, None, None, None, 0), (11, "/i/1", "n", "Bob Ray", "x", "y", 1, 1, 0),
]
ENTRIES = [
    (1, '{"artist": "Ann Lee", "title": "Red Sky (Official Video)"}'), (2, '{"artist": "red sky", "title": "ANN LEE"}'), (3, '"Ann Lee - Red Sky - Live"'), (4, '{"artist": "", "title": "Ann Lee - Blue Road - 01 - Red Sky", "duration": "200"}'),
    (5, '{"artist": "Ann Lee", "title": "Green Sea"}'), (6, None), (7, ""), (8, "{"), (9, '{"artist": null, "title": ""}'), (10, '{"artist": "Bob Ray", "track": "Cold Wnid"}'), (11, '{"artist": "Ann Lee", "title": "Red Sky (Official Video)"}'), (12, "[1]"), (13, "7"),
]


def test_link(spark):
    library = spark.createDataFrame(LIBRARY, FLACS)
    entries = spark.createDataFrame([(i, q, 1) for i, q in ENTRIES], "match_id long, query_track string, query_id int")
    terms = spark.createDataFrame([], "term string")
    out = {}
    for r in linkage.link(entries, library, terms).collect():
        assert linkage.ACCEPT <= r["confidence"] <= 1
        out.setdefault(r["match_id"], set()).add(r["path"])
    red = {"/a/1", "/b/1", "/d/1", "/e/1"}
    assert out == {1: red, 2: red, 3: {"/c/1"}, 4: red, 10: {"/g/1"}, 11: red}
    assert linkage.link(entries.limit(0), library, terms).count() == 0 and linkage.link(entries, library.limit(0), terms).count() == 0


def linked(spark, library, query):
    flacs = spark.createDataFrame([(i, f"/{i}", "x", *r, 0) for i, r in enumerate(library)], FLACS)
    entries = spark.createDataFrame([(1, query, 1)], "match_id long, query_track string, query_id int")
    return {int(r["path"][1:]) for r in linkage.link(entries, flacs, spark.createDataFrame([], "term string")).collect()}


def test_link_mistyped_beside_exact(spark):
    artist = "Krukrupotrir Radio Orchestra"
    library = [(artist, "Blue", "Window Bribrulotar", None, 200), (artist, "Grey Hall", "Widnow Bribrulotar", None, 201), (artist, "Songs", "Window Bribrulotra", None, 199), (artist, "Green", "Window Sky", None, 200)]
    assert linked(spark, library, f'{{"artist": "{artist}", "title": "Window Bribrulotar", "duration": 200}}') == {0, 1, 2}


@pytest.mark.parametrize("part", [2, 500])
def test_link_frequent(spark, monkeypatch, part):
    monkeypatch.setattr(linkage, "PART", part)
    library = [("Ann Lee", f"Album {w}", "Red Sky", None, 200) for w in ("Oak", "Elm", "Fir", "Ash", "Yew")] + [("Ann Lee", "Elm", "Cold Wind", None, 200)]
    assert linked(spark, library, '{"artist": "Ann Lee", "title": "Red Sky"}') == {0, 1, 2, 3, 4}
    assert linked(spark, library, '{"artist": "Ann Lee", "title": "Red Sly"}') == {0, 1, 2, 3, 4}


@pytest.mark.parametrize("n", [400, 401, 5000])
def test_link_one_recording_on_many_albums(spark, n):
    library = [("Ann Lee", f"Album {i:05}", "Red Evening", None, 200) for i in range(n)] + [("Ann Lee", f"Other {i:05}", "Cold Wind", None, 200) for i in range(100)]
    assert linked(spark, library, '{"artist": "Ann Lee", "title": "Red Evening", "duration": 200}') == set(range(n))
    assert linked(spark, library, '{"artist": "Ann Lee", "title": "Red Evenign", "duration": 200}') == set(range(n))


def test_refined_by_neighbours(spark):
    """A file known with a low confidence gains by a neighbour of a higher one."""
    library = [("Ann Lee", "Blue", "Evening Skylark", 1, 200), ("A. Lee", "Blue", "Evenign Skylrak", 1, 203)]
    flacs = spark.createDataFrame([(i, f"/{i}", "x", *r, 0) for i, r in enumerate(library)], FLACS)
    entries = spark.createDataFrame([(1, '{"artist": "Ann Lee", "title": "Evening Skylark"}', 1)], "match_id long, query_track string, query_id int")
    out = {r["path"]: r["confidence"] for r in linkage.link(entries, flacs, spark.createDataFrame([], "term string")).collect()}
    assert out["/0"] == 1.0 and out["/1"] == linkage.FADE


def test_link_without_duration(spark):
    library = [("Ann Lee", "Blue", "Red Sky", 1, None), (None, "Blue", "Red Sky", 1, 200), (None, "Blue", "Cold Wind", 1, 200)]
    assert linked(spark, library, '{"artist": "Ann Lee", "title": "Red Sky"}') == {0, 1}
    library = [("Ann Lee", "Blue", "Red Sky", 1, 200), ("Ann Lee", "Grey", "Red Sky", 1, None)]
    assert linked(spark, library, '{"artist": "Ann Lee", "title": "Red Sky", "album": "Blue"}') == {0, 1}


def test_link_until_no_file_is_new(spark):
    word = "bridgeworkhalftimes"
    library = [(None if n else "Ann Lee", "Blue", "zx" * n + word[2 * n :], 1, 200) for n in range(9)]
    assert linked(spark, library, f'{{"artist": "Ann Lee", "title": "{word}"}}') == set(range(9))


def test_link_without_artist(spark):
    library = [(None, "Blue", "Window Bribrulotar", None, 200), (None, "Grey", "Red Sky", None, 200)] + [("Bob Ray", f"Album {w}", "Red Sky", None, 300) for w in ("Oak", "Elm", "Fir", "Ash")]
    assert linked(spark, library, '{"artist": "Ann Lee", "title": "Window Bribrulotar", "duration": 200}') == {0}
    assert linked(spark, library, '{"artist": "Ann Lee", "title": "Window Bribrulotra", "duration": 200}') == set()
    assert linked(spark, library, '{"artist": "Ann Lee", "title": "Red Sky", "duration": 200}') == set()


def test_readings():
    assert linkage.readings('{"title": "Ann - Blue - 03 - Sky - Live", "album": "Blue"}')[0][0] == ("Ann", "Sky (Live)", "Blue")
    assert linkage.title_parts("04. Sky [HQ] (Live)") == (("sky",), "live") and linkage.title_parts("Sky (Remastered 2011)")[1] == ""
    assert linkage.title_parts("Sky - Dub Mix")[1] == "dub" and linkage.title_parts("Sky (Extended Remix)")[1] == "remix"
    assert linkage.seconds("3:22") == 202 and linkage.seconds("x") is None


def test_plan_uses_every_item():
    rng = np.random.default_rng(1)
    for hist in (np.bincount(rng.integers(1, 400, 5000), minlength=2049), np.bincount([2048] * 7 + [1] * 3 + [1500], minlength=2049), np.zeros(2049, dtype=int), np.bincount([300] * 1000, minlength=2049)):
        packed = packing.plan(hist)
        used = np.zeros(2049, dtype=int)
        for pattern, times in packed:
            assert sum(pattern) <= 2048 and times > 0
            np.add.at(used, list(pattern), times)
        assert (used[1:] == hist[1:]).all()
    hist = np.bincount(rng.integers(1, 700, 20000), minlength=2049)
    load = (np.arange(2049) * hist).sum()
    assert load / (2048 * sum(t for _, t in packing.plan(hist))) > 0.999


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file here")
def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 5)
    texts = [None, "", "a"] + ["word " * n for n in (1, 5, 50, 99, 100, 3000)] + ["same text here"] * 40
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, size int")
    out = packing.pack(docs, capacity=100).collect()
    machine = tokens.automaton()
    loads, sizes = {}, {}
    for r in out:
        loads[r["container"]] = loads.get(r["container"], 0) + r["size"]
        sizes.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["size"]))
    assert max(loads.values()) <= 100 and set(sizes) == set(range(len(texts)))
    for i, t in enumerate(texts):
        n, own = len(machine.encode(t)), sorted(sizes[i])
        assert sum(s for *_, s in own) == n and (len(own) == 1 or n > 100) and [p for p, *_ in own] == list(range(len(own)))
        assert all(start == 100 * p for p, start, _ in own) and all(s == 100 for _, _, s in own[:-1])
    f = packing.fill(packing.pack(docs, capacity=100), 100).first()
    assert f["fullest"] <= 100 and f["fill"] > 0.9
    assert packing.pack(docs.limit(0)).count() == 0
    assert sorted(map(tuple, out)) == sorted(map(tuple, packing.pack(docs, capacity=100).collect()))


needs_words = pytest.mark.skipif(not os.path.isdir(private.VOCABULARIES), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def field():
    if not os.path.isdir(private.VOCABULARIES):
        pytest.skip("no vocabulary files here")
    return private.train()


@needs_words
def test_held_out_lines():
    """Trained without each fifth line of the table, the field finds the items of those lines."""
    model = private.train(12, 5, 0)
    seqs = private.table_of_sequences(3, 99, -1)
    both = true = found = 0
    for tags, (_, gold) in zip(model.decode([x for x, _ in seqs]), seqs):
        a, b = set(private.items(np.array(gold))), set(private.items(tags))
        both, true, found = both + len(a & b), true + len(a), found + len(b)
    assert both / true > 0.85 and both / found > 0.85


def test_table_is_not_from_the_documents(spark, data):
    """No fragment of a line, street, town or host of the labelled table occurs in the documents."""
    texts = " ".join(r["text"].lower() for r in spark.read.parquet(f"{data}/documents.parquet").where("text is not null").collect())
    fragments = [f.strip().lower() for line in labelled.LINES.split("\n") for f in re.split(r"\{\w+\}|\\\\n", line)]
    assert not [f for f in fragments if len(f) >= 16 and f in texts]  # shorter ones are terms such as "passport number"
    own = [v for t in (labelled.STREETS, labelled.TOWNS, labelled.STREETS_DE, labelled.TOWNS_DE, labelled.STREETS_FR, labelled.TOWNS_FR, labelled.STREETS_ES, labelled.TOWNS_ES) for v in t.split("|")]
    assert not [v for v in [*own, *labelled.HOSTS.split(), *labelled.GIVEN.split()] if re.search(rf"(?<!\w){re.escape(v.lower())}(?!\w)", texts)]


@pytest.mark.parametrize("text,kind,fits", [
    ("12 Oak Street, Bexford", "address", True), ("Flat 3, 12b Oak Rd.", "address", True), ("4 bis rue Talma, 75001 Orlay", "address", True), ("Am Hang 3 in 12345 Olm", "address", True), ("Kastanienallee 12a", "address", True), ("C/ Luna, 4, 2.º B", "address", True),
    ("Disc 7, track 12", "address", False), ("85 of 100", "address", False), ("+1 555 010 0199 ext. 12", "phone", True), ("3分過ぎ1234567", "phone", False), ("Ann Lee", "name", True), ("Lee, Ann", "name", True), ("Ann 3", "name", False),
])
def test_proof(text, kind, fits):
    assert bool(private.PROOF[kind].search(text)) is fits


def test_proper():
    assert private.proper("Ann Lee", True) and private.proper("ann lee", False) and not private.proper("ann lee", True) and not private.proper("B-side, Lee", True) and private.proper("Ann van der Lee-Ray", True)


def test_viterbi_against_all_paths(field):
    words = ["Ticket", "opened", "by", "Ann"]
    e = field.scores(words)
    best = max(product(range(len(private.TAGS)), repeat=4), key=lambda p: field.trans[0, p[0]] + e[0, p[0]] + sum(field.trans[a, b] + e[i + 1, b] for i, (a, b) in enumerate(zip(p, p[1:]))))
    assert tuple(field.decode([words])[0]) == best


TEXT = "Both Helga Thornmere and Bruno Quillidge signed the loan sheet. Questions go to helga77@posta.invalid or +44 20 7946 0184. Tax 12. Karel Dvolubar played Golden Hammer twice that night, the second time without the moth. tax id 904-20-1050, phone 415-555-0146, please keep private"


def test_find_and_redact(spark, got, field):
    docs = spark.createDataFrame([(1, TEXT, "a"), (2, None, "a"), (3, "", "a"), (4, "   ", "a"), (5, "What a paper record. " * 3000, "a"), (6, TEXT, "a")], "doc_id long, text string, kind string")
    artists = spark.createDataFrame([("Karel Dvolubar",), (None,)], "artist string")
    one = {("name", 1), ("name", 2), ("email", 1), ("phone", 1), ("phone", 2), ("identity", 1)}
    assert {tuple(r) for r in private.find_items(docs, artists, field).collect()} == {(d, *x) for d in (1, 6) for x in one}
    out = {r["doc_id"]: r["text"] for r in private.redact(docs, artists, field).collect()}
    assert out[1] == TEXT.replace("Helga Thornmere", "[NAME]").replace("Bruno Quillidge", "[NAME]").replace("helga77@posta.invalid", "[EMAIL]").replace("+44 20 7946 0184", "[PHONE]").replace("904-20-1050", "[IDENTITY]").replace("415-555-0146", "[PHONE]")
    assert out[2] is None and out[3] == "" and out[4] == "   " and out[5].count("[") == 0
    assert private.find_items(docs.limit(0), artists.limit(0), field).count() == 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, data, name):
    df = queries.queries()[name](spark, data)
    assert df.columns and df.count() > 0


def test_found_columns(spark, data):
    want = {"p1_found": [("match_id", "bigint"), ("path", "string")], "p3_found": [("flac_id", "bigint"), ("field", "string")], "p5_found": [("flac_id", "bigint"), ("field", "string")],
            "p6_found": [("field", "string"), ("name_a", "string"), ("name_b", "string")], "p7_ids": [("doc_id", "bigint"), ("ids", "array<int>")], "p9_found": [("doc_id", "bigint"), ("kind", "string"), ("nth", "bigint")]}
    assert {n: queries.queries()[n](spark, data).dtypes for n in want} == want
