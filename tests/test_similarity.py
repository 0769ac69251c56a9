import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import similarity as sim
from trackloom.functions.text import SERIES, canon
from trackloom.plans import queries


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_three_ways(spark):
    r = random.Random(1)
    pairs = [("", ""), ("a", ""), ("kitten", "sitting"), ("radiohead creep", "creep radiohead"), ("ab" * 50, "ba" * 60)]
    pairs += [("".join(r.choices("abcé ", k=r.randrange(30))), "".join(r.choices("abcé ", k=r.randrange(30)))) for _ in range(60)]
    pairs += [("".join(r.choices("abcé ", k=n)), "".join(r.choices("abcé ", k=r.randrange(200)))) for n in (61, 62, 63, 64, 124, 125, 186, 300)]
    want = [brute_lcs(a, b) for a, b in pairs]
    assert [sim.lcs_number(a, b) for a, b in pairs] == want
    df = spark.createDataFrame(pairs[:30], "a string, b string")
    assert [row[0] for row in df.select(sim.lcs("a", "b")).collect()] == want[:30]
    block = sim.TextBlock([b for _, b in pairs])
    for i, (a, _) in enumerate(pairs):
        assert np.allclose(block.ratios(a), [sim.ratio_number(a, b) for _, b in pairs]), i
    assert round(sim.ratio_number("kitten", "sitting"), 4) == 61.5385


def score(spark, s, c):
    df = spark.createDataFrame([(*s, *c)], "sa string, st string, sl string, sy int, ca string, ct string, cl string, cy int")
    left = sim.describe("sa", "st", "sl", F.lit("p"), "sy")
    right = sim.describe("ca", "ct", "cl", F.lit("q"), "cy")
    return df.select(left.alias("s"), right.alias("c")).select(sim.track_score(F.col("s"), F.col("c"))).first()[0]


def test_track_score(spark):
    assert score(spark, ("Ann", "Blue Sky", "", None), ("Ann", "Blue Sky", "X", None)) == 100.0  # capped
    assert score(spark, ("", "Blue Sky", "", None), ("Ann", "Blue Sky", "X", None)) == 60.0
    assert score(spark, ("", "", "", None), ("", "", "", None)) == 0.0
    assert score(spark, (None, None, None, None), ("Ann", "Blue", "X", 1990)) == 0.0
    assert score(spark, ("", "New Path", "", 1990), ("Ann", "New Path", "X", 1991)) == 96.0


@pytest.mark.parametrize("a,b,want", [("blue sky", "blue sky", 1.0), ("blue", "blue sky", 0.9), ("sky blue", "blue sky", 0.4), ("", "x", 0.0), ("a b c", "a x b", 0.8 * 2 / 3)])
def test_phrase(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    df = df.select(canon("a").alias("a"), canon("b").alias("b"))
    assert df.select(sim.phrase(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_ratio_score_and_lengths(spark):
    names = ("artist", "album", "title", "duration")
    df = spark.createDataFrame([("Ann", None, "Sky", 200, "ann", "x", "sky", 203), (None, None, None, None, "a", "b", "c", 1)], "qa string, ql string, qt string, qd int, ca string, cl string, ct string, cd int")
    q, c = (dict(zip(names, [F.col(f"{p}{k}") for k in ("a", "l", "t", "d")])) for p in "qc")
    assert [r[0] for r in df.select(sim.ratio_score(q, c)).collect()] == [126, 0]  # (200 + 100 + 80) / 3
    assert [r[0] for r in df.select(sim.ratio_score(q, c, sim.edit_ratio, normalised=True)).collect()] == [93, 0]
    assert df.select(sim.length_ratio(F.lit("abcd"), F.lit("ab"))).first()[0] == 50


def test_weighted_ratio(spark):
    assert sim.weighted_ratio_number("Blue Sky", "sky blue") == 95
    assert sim.weighted_ratio_number("", "x") == 0 and sim.weighted_ratio_number("same", "SAME!") == 100
    assert sim.weighted_ratio_number("blue", "the very long blue sky of all") == 90
    assert spark.createDataFrame([("a b", None)], "a string, b string").select(sim.weighted_ratio("a", "b")).first()[0] == 0


def test_series_bonus(spark, tmp_path):
    texts = [None, "", "New Path", "Café “New Path”", "Ｎｅｗ Ｐａｔｈ", "Nuances de Nuit – été", "Ünew pathé", "FAFEP010 Привет", "(new path) ночь", "new · path", "Привет"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def brute(text):
        s = unicodedata.normalize("NFKC", text or "").lower().replace("&", " and ").replace("+", " and ").replace("|", " ").replace("`", "'")
        s = re.sub(r"\(.*?\)(?!bp single track).*?|\[.*?\]|\{.*?\}", " ", s)
        s = " ".join(re.sub(r"[^a-z0-9' ]+", " ", s).split(" "))
        s = re.sub(" +", " ", s).strip()
        return 0.3 if any(h in s for h in SERIES) else 0.0

    got = {r["doc_id"]: r["bonus"] for r in queries.series_bonus(spark, str(tmp_path)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)} and sum(got.values()) > 1.4
