import random

import numpy as np
import pytest

from trackloom.config import Config
from trackloom.functions.similarity import ratio_number
from trackloom.operators import blocking, matching

LIB = "path string, norm string, n long, extra string"
LIBRARY = [("/m/Ann/Blue/01 - Red Sky.flac", "red sky", 1, "x"), ("/m/Ann/Blue/02 - Green Sea.flac", "green sea", 2, "x"), ("/m/Bob/Grey/01 - Red Sky.flac", "red sky", 3, None),
           ("/m/Bob/Grey/._03 - Hidden.flac", "hidden", 4, None), ("/m/Bob/Grey/04 - Cold Wind.flac", "cold wind", 5, None), (None, None, None, None)]
PLAYLIST = [(0, "Red Sky"), (1, "Ann - Green Sea"), (2, "Bob - Cold Wind"), (3, "Bob - Cold Wind"), (4, ""), (5, None), (6, "xy"), (7, "Nobody - Nothing Here"), (8, "Ann - Green  Sea")]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(PLAYLIST, "pos long, track string"), spark.createDataFrame(LIBRARY, LIB)


def test_one_to_one(tables, got):
    playlist, library = tables
    found = matching.best(playlist, library, "n")
    out = {r["track"]: r["path"] for r in matching.one_to_one(found, playlist).collect()}
    assert out["Red Sky"] == "/m/Bob/Grey/01 - Red Sky.flac"  # the last of equal norms
    assert out["Ann - Green Sea"] == "/m/Ann/Blue/02 - Green Sea.flac"
    assert out["Ann - Green  Sea"] is None  # used
    assert out["Bob - Cold Wind"] is None and out[""] is None and out["xy"] is None  # a repeated track ends without
    kept = {r["track"]: r["path"] for r in matching.one_to_one(found, playlist, Config(dup_policy="keep_first")).collect()}
    assert kept["Bob - Cold Wind"] == "/m/Bob/Grey/04 - Cold Wind.flac"
    paths = [p for p in kept.values() if p]
    assert len(paths) == len(set(paths))
    n = matching.counts(playlist, matching.one_to_one(found, playlist)).first()
    assert (n["matched"], n["unmatched"]) == (2, 6)


def test_classify_and_review(tables):
    playlist, library = tables
    status = {r["track"]: r["status"] for r in matching.classify(matching.best(playlist, library, "n"), playlist).collect()}
    assert status["Red Sky"] == "auto" and status["Nobody - Nothing Here"] == "unmatched" and "" not in status
    top = matching.review_candidates(playlist, library, "n").collect()
    assert all(1 <= r["rank"] <= 5 for r in top) and any(r["track"] == "Ann - Green Sea" and r["rank"] == 1 for r in top)


def test_unmatched_and_overlay(spark, tables, got):
    playlist, library = tables
    one = matching.one_to_one(matching.best(playlist, library, "n"), playlist)
    rest = got(matching.unmatched(playlist, one))
    assert (2, "Bob", "Cold Wind") in rest and (3, "Bob", "Cold Wind") in rest and (6, "Unknown Artist", "xy") in rest
    decided = spark.createDataFrame([("xy", "/z.flac"), ("Red Sky", None)], "track string, choice string")
    over = {r["track"]: r["path"] for r in matching.overlay(one, decided).collect()}
    assert over["xy"] == "/z.flac" and over["Red Sky"] is None and over["Ann - Green Sea"]


def test_empty(spark):
    none, lib = spark.createDataFrame([], "pos long, track string"), spark.createDataFrame([], LIB)
    assert matching.best(none, lib, "n").count() == 0
    assert matching.one_to_one(matching.best(none, lib, "n"), none).count() == 0
    assert matching.match_simple(none, lib, "n").count() == 0
    q = spark.createDataFrame([], "pos long, artist string, album string, title string, duration int")
    assert matching.match_by_ratio(q, lib.selectExpr("path", "norm artist", "norm album", "norm title", "1 duration")).count() == 0


def test_ratio_scan_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(blocking, "ROWS", 7)
    monkeypatch.setattr(blocking, "QUERIES", 3)
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcde", k=r.randrange(1, 9)))
    some = lambda f: f() if r.random() < 0.85 else None
    row = lambda: (some(word), some(word), some(word), some(lambda: r.randrange(0, 30)))
    lib = [(f"/p{i:02}", *row()) for i in range(40)]
    qs = [(i, *row()) for i in range(12)]

    def score(q, c):
        parts = [ratio_number(q[k], c[k]) * (2 if k == 2 else 1) for k in (2, 0, 1) if q[k] and c[k]]
        if q[3] and c[3]:
            d = abs(q[3] - c[3])
            parts.append(100 if d <= 2 else 80 if d <= 5 else 60 if d <= 10 else 40)
        return int(sum(parts) / len(parts)) if parts else 0

    spec = "artist string, album string, title string, duration int"
    out = matching.match_by_ratio(spark.createDataFrame(qs, f"pos long, {spec}"), spark.createDataFrame(lib, f"path string, {spec}"))
    want = {}
    for q in qs:
        top = max(score(q[1:], c[1:]) for c in lib)
        want[q[0]] = (top, min(c[0] for c in lib if score(q[1:], c[1:]) == top) if top >= 70 else None)
    assert {x["pos"]: (x["score"], x["path"]) for x in out.collect()} == want
    assert sum(matching.status_counts(out).first()) == 12


def test_simple(tables):
    playlist, library = tables
    out = {r["track"]: r["path"] for r in matching.match_simple(playlist, library, "n").collect()}
    assert out["Red Sky"] == "/m/Bob/Grey/01 - Red Sky.flac" and out["xy"] is None


def test_entry_paths(spark, got):
    lib = spark.createDataFrame([("/a", "ann"), ("/b", "blue")], "path string, norm string")
    entries = spark.createDataFrame([(1, "Ann ", "t"), (2, "", "Blue"), (3, None, None), (4, "zed", "Blue")], "entry_id long, artist string, title string")
    index = spark.createDataFrame([("zed", "/z")], "key string, path string")
    assert got(matching.entry_paths(entries, lib, index, None)) == [(1, "/a"), (2, "/b"), (3, None), (4, "/z")]


def test_fuzzy_top(spark, monkeypatch):
    from trackloom.functions.similarity import weighted_ratio_number as w

    monkeypatch.setattr(blocking, "ROWS", 3)
    norms = ["red sky", "sky red", "green sea", "cold wind", "red sky live at the hall", "wind", "r"]
    library = spark.createDataFrame([(f"/{i}", n) for i, n in enumerate(norms)], "path string, norm string")
    queries = spark.createDataFrame([("red sky",), ("winds",), ("",)], "norm_query string")
    out = {}
    for r in matching.fuzzy_top(queries, library, 3).orderBy("norm_query", "rank").collect():
        out.setdefault(r["norm_query"], []).append((r["score"], r["norm"]))
    for q in ("red sky", "winds", ""):
        assert out[q] == [(w(q, n), n) for n in sorted(norms, key=lambda n: (-w(q, n), n))[:3]]


def test_fallback_without_index_hit(spark):
    """Titles with accents or apostrophes share no index word; the most similar files stand in, and the rules of acceptance hold."""
    library = spark.createDataFrame([("/m/Motörhead - Überkiller.flac", "motörhead - überkiller", 1, None), ("/m/Ann - Çığlık.flac", "ann - çığlık", 2, None), ("/m/Bob - Other.flac", "bob - other", 3, None)], LIB)
    playlist = spark.createDataFrame([(0, "Motörhead - Überkiller (Live)"), (1, "Ünß Äöü"), (2, "Ø")], "pos long, track string")
    found = matching.best(playlist, library, "n")
    out = {r["track"]: r["path"] for r in matching.one_to_one(found, playlist).collect()}
    assert out == {"Motörhead - Überkiller (Live)": "/m/Motörhead - Überkiller.flac", "Ünß Äöü": None, "Ø": None}
    assert matching.best(playlist, library.limit(0), "n").count() == 0
    top = matching.review_candidates(playlist, library, "n").where("track = 'Motörhead - Überkiller (Live)'").orderBy("rank").collect()
    assert top[0]["path"] == "/m/Motörhead - Überkiller.flac" and len(top) == 3


def test_weighted_block_against_every_pair():
    from trackloom.functions.similarity import WeightedBlock, weighted_ratio_number

    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdé", k=r.choice((1, 2, 2, 3, 5, 8))))
    text = lambda: r.choice((" ", " - ")).join(word() for _ in range(r.choice((0, 1, 2, 3, 5, 14))))
    texts = sorted({text() for _ in range(300)})
    block = WeightedBlock(texts)
    for _ in range(60):
        q = text()
        want = sorted((-weighted_ratio_number(q, t), t) for t in texts)[:12]
        assert [(-s, texts[i]) for s, i in block.top(q, 12)] == want


def test_scans_copy_no_rows(spark, tables):
    """Blocks of a scan are shuffled once and meet in a cartesian product; no row is copied for each block of the other side."""
    playlist, library = tables
    q = spark.createDataFrame([(1, "ann", "", "", 1)], "pos long, artist string, album string, title string, duration int")
    lib = spark.createDataFrame([("/a", "ann", "x", "y", 1)], "path string, artist string, album string, title string, duration int")
    for out in (matching.match_by_ratio(q, lib), matching.match_simple(playlist, library, "n"), matching.fuzzy_top(playlist.selectExpr("track norm_query"), library)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "explode(sequence" not in plan


def test_bounds_of_ratios():
    from trackloom.functions.similarity import TextBlock

    r = random.Random(5)
    text = lambda: "".join(r.choices("abcdeé\U0001f600\0 ж", k=r.choice((0, 1, 3, 8, 70))))
    texts = [text() for _ in range(200)]
    block, which = TextBlock(texts), np.array([3, 50, 51, 199])
    for _ in range(40):
        q = text()
        exact = block.ratios(q)
        assert exact.tolist() == [ratio_number(q, t) for t in texts]
        assert (block.bounds(q) >= exact - 1e-9).all() and (block.ratios(q, which) == exact[which]).all()
