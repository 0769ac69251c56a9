"""Filling containers of fixed capacity with texts sized in tokens.

Pattern packing. Only the histogram of sizes (at most capacity + 1 rows, whatever the data) comes
to the driver. Patterns of a few document lengths that fill a container are enumerated from it,
their repeat counts are fitted to the histogram by non-negative least squares and rounded down,
and the residual histogram is packed best fit first, pattern by pattern. Documents then find their
container from their rank among those of equal size, which is counted in hashed buckets so that
no length, however common, ends in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from trackloom.llm.tokens import VOCABULARY, token_count
from trackloom.session import cut, spread

CAPACITY = 2048
#: Patterns enumerated, documents of a pattern, iterations of the fit, and rows of one rank bucket.
PATTERNS, FEW, ROUNDS, BUCKET = 6000, 24, 400, 50_000


def enumerate_patterns(hist: np.ndarray, capacity: int, n: int = PATTERNS, seed: int = 7) -> list[tuple[int, ...]]:
    """Patterns of few lengths: lengths drawn by frequency, the last one chosen to fill what is left."""
    lengths = np.flatnonzero(hist)
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return []
    rng = np.random.default_rng(seed)
    p = hist[lengths] / hist[lengths].sum()
    at_most = np.zeros(capacity + 1, dtype=np.int64)  # longest length that fits
    at_most[lengths] = lengths
    at_most = np.maximum.accumulate(at_most)
    found: dict[tuple[int, ...], None] = {}
    for draw in rng.choice(lengths, size=(n, FEW), p=p):
        own, left = [], capacity
        for x in draw:
            if len(own) == FEW - 1 or x > left or at_most[left - x] == 0 and x != left:
                break
            own.append(int(x))
            left -= int(x)
        while left and (y := int(at_most[left])) and len(own) < FEW:
            own.append(y)
            left -= y
        found[tuple(sorted(own, reverse=True))] = None
    return list(found)


def fit(patterns: list[tuple[int, ...]], hist: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 minimising |A x - hist|, A being the lengths of each pattern, by multiplicative updates."""
    rows = np.concatenate([np.array(p) for p in patterns])
    cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    n, m = len(patterns), len(hist)
    h = hist.astype(float)
    x = np.full(n, h.sum() / max(1, len(rows)))
    up = np.bincount(cols, h[rows], n)
    for _ in range(rounds):
        down = np.bincount(cols, np.bincount(rows, x[cols], m)[rows], n)
        x *= up / np.maximum(down, 1e-12)
    return x


def plan(hist: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use every item of the histogram exactly once; sizes above 0 only."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], times: int) -> None:
        sizes, mult = np.unique(pattern, return_counts=True)
        times = min(times, int((left[sizes] // mult).min()))
        if times > 0:
            left[sizes] -= mult * times
            out.append((pattern, times))

    patterns = [p for p in enumerate_patterns(hist, capacity) if sum(p) >= 0.99 * capacity]
    if patterns:
        x = fit(patterns, hist)
        for i in np.argsort(-x, kind="stable"):
            take(patterns[i], int(x[i]))
    while (top := int(np.flatnonzero(left)[-1]) if left.any() else 0) > 0:
        own, room, have = [], capacity, left.copy()
        y = top
        while y:
            own.append(y)
            have[y] -= 1
            room -= y
            fits = np.flatnonzero(have[: room + 1])
            y = int(fits[-1]) if len(fits) else 0
        take(tuple(own), int(left[top]))
    return out


def places(packed: list[tuple[tuple[int, ...], int]]) -> tuple[dict[str, np.ndarray], int]:
    """Arrays sorted by (size, first rank): which container the item of a size and rank goes to; and the number of containers."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for pattern, times in packed:
        for size, mult in zip(*(x.tolist() for x in np.unique(pattern, return_counts=True))):
            rows.append((size, used.get(size, 0), mult, base))
            used[size] = used.get(size, 0) + mult * times
        base += times
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"size": a[:, 0], "first": a[:, 1], "mult": a[:, 2], "base": a[:, 3]}, base


def pieces(docs: DataFrame, capacity: int, path: str) -> DataFrame:
    """(doc_id, piece, start, size): a text is one piece unless longer than the capacity."""
    texts = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    own = texts.select("doc_id", token_count(F.col("text"), path).alias("n"))
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / capacity) - 1)
    cuts = own.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return cuts.select("doc_id", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("n") - start).cast("int").alias("size"))


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, size, container): every document assigned to containers of ``capacity`` tokens.

    Null and empty texts have size 0 and are spread over the containers; a text longer than the
    capacity is cut into full pieces and a rest; repeated doc_ids are packed as rows of their own.
    An empty table gives no rows. The result is the same on every run over the same rows.
    """
    items = cut(pieces(docs, capacity, path))
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for r in items.groupBy("size").count().collect():  # at most capacity + 1 rows
        hist[r["size"]] = r["count"]
    where, n = places(plan(hist, capacity))
    buckets = int(max(1, -(-hist.max() // BUCKET)))
    bucket = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = bucket.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("size", "bucket").orderBy("doc_id", "piece")
    ranked = bucket.withColumn("r", F.row_number().over(within)).join(offsets, ["size", "bucket"]).withColumn("rank", F.col("offset") + F.col("r") - 1)

    @F.pandas_udf(T.LongType())
    def container(size: pd.Series, rank: pd.Series) -> pd.Series:
        s, r = size.to_numpy(np.int64), rank.to_numpy(np.int64)
        out = r % max(1, n)
        real = s > 0
        if real.any():
            key = where["size"] << 40 | where["first"]
            i = np.searchsorted(key, s[real] << 40 | r[real], side="right") - 1
            out[real] = where["base"][i] + (r[real] - where["first"][i]) // where["mult"][i]
        return pd.Series(out)

    return ranked.select("doc_id", "piece", "start", "size", container("size", "rank").alias("container"))


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, fill, fullest): how well the containers are used."""
    loads = packed.groupBy("container").agg(F.sum("size").alias("load"))
    return loads.agg(
        F.count("*").alias("containers"), F.coalesce(F.sum("load"), F.lit(0)).alias("tokens"),
        F.round(F.sum("load") / (F.count("*") * capacity), 6).alias("fill"), F.max("load").alias("fullest"),
    )
