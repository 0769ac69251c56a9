import random

import pytest

from trackloom.functions import similarity
from trackloom.functions.text import JUNK, SERIES
from trackloom.operators import blocking, matching

WORDS = ["red", "sky", "sea", "blue", "o", "wind", "ann", "redsky", *JUNK[:4], SERIES[1]]


def tables(spark, r, n, m):
    text = lambda k: " ".join(r.choices(WORDS, k=r.choice(k)))
    library = [(f"/m/{text((0, 1, 2))} ({r.randrange(1990, 2002)})/{text((1, 2, 3, 6, 30))}/{i:02} - {text((1, 2, 3, 30))}.flac", text((1, 2, 3, 5)), i) for i in range(n)]
    tracks = [(i, r.choice(("", f"{text((1, 2))} - ", f"{text((1, 2))} - Sea (1995) - 01. ")) + text((1, 2, 3, 28))) for i in range(m)]
    return spark.createDataFrame(tracks, "pos long, track string"), spark.createDataFrame(library, "path string, norm string, n long")


@pytest.mark.parametrize("seed", [1, 2])
def test_best_of_blocks_against_every_pair(spark, monkeypatch, got, seed):
    """The best candidates told in blocks are those of all pairs scored, long texts and ties included."""
    monkeypatch.setattr(matching, "TRACKS", (40, 30))
    monkeypatch.setattr(similarity, "WORDS", 8)
    playlist, library = tables(spark, random.Random(seed), 120, 70)
    queries, options = matching.asked(playlist), matching.choices(matching.lookup_with(library, "n"), "n")
    want = {}
    for t in matching.scored(queries, options, False).select("track", "norm", "path", "score").collect():
        want.setdefault(t["track"], []).append((-t["score"], t["norm"], t["path"]))
    pairs = matching.likely(queries, options, False).select("track", "norm", "path", "score").collect()
    out = {}
    for t in pairs:
        out.setdefault(t["track"], []).append((-t["score"], t["norm"], t["path"]))
    assert {k: min(v) for k, v in out.items()} == {k: min(v) for k, v in want.items()} and len(out) > 50
    assert len(pairs) < sum(map(len, want.values())) / 4


def test_candidates_of_the_best_are_no_rows(spark, monkeypatch):
    """Entry and file meet in blocks; no join on words makes a row of each pair."""
    playlist, library = tables(spark, random.Random(3), 20, 10)
    monkeypatch.setattr(matching, "candidates", lambda *_: pytest.fail("pairs are made as rows"))
    assert matching.best(playlist, library, "n").count() > 0


def test_totals_of_block():
    r = random.Random(4)
    text = lambda: " ".join(r.choices(WORDS, k=r.choice((0, 1, 2, 3, 5))))
    rows = [(text(), text(), text(), r.randrange(4), r.choice((float("nan"), 1990.0, 1995.0))) for _ in range(200)]
    import numpy as np

    block = similarity.TrackBlock([str(i) for i in range(200)], [["all"]] * 200, *([x[k] for x in rows] for k in range(3)), np.array([x[3] for x in rows]), np.array([x[4] for x in rows]))
    for _ in range(100):
        q = (text(), text(), text(), r.randrange(4), r.choice((float("nan"), 1992.0)))
        assert block.totals(np.arange(200), *q).tolist() == [similarity.total_number(q, x) for x in rows]


def test_best_norms_of_later_blocks(spark, monkeypatch):
    """What earlier blocks of a task gave leaves nothing out that is among the best."""
    monkeypatch.setattr(matching, "LIKE", (5, 4))
    monkeypatch.setattr(blocking, "PARTS", 1)
    r = random.Random(6)
    norms = sorted({" ".join(r.choices(WORDS, k=r.choice((1, 2, 4)))) for _ in range(60)})
    asked = ["red sky", "wind o", "blue sea ann live", "x"]
    library = spark.createDataFrame([(f"/{i}", n) for i, n in enumerate(norms)], "path string, norm string")
    out = matching.fuzzy_top(spark.createDataFrame([(q,) for q in asked], "norm_query string"), library, 4)
    w = similarity.weighted_ratio_number
    assert {(x["norm_query"], x["score"], x["norm"]) for x in out.collect()} == {(q, w(q, n), n) for q in asked for n in sorted(norms, key=lambda n: (-w(q, n), n))[:4]}
