"""Candidates of a query set: exact norms, shared index words, and scans of the whole library in blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trackloom.functions.text import index_words, query_words

#: Library rows and queries that meet in one group of a scan.
ROWS, QUERIES = 20_000, 250
#: Parts that either side of a scan is held in; each part meets each of the other side.
PARTS = 64


def postings(choices: DataFrame, norm: str = "norm") -> DataFrame:
    """(word, norm): the inverted index over distinct norms, kept exploded so that no list grows with a word."""
    return choices.select(norm).distinct().select(F.explode(index_words(norm)).alias("word"), F.col(norm).alias("norm"))


def exact(queries: DataFrame, choices: DataFrame) -> DataFrame:
    """Queries with the path whose norm they equal, others with null."""
    own = queries.drop("path")
    return own.join(choices.select(F.col("norm").alias("norm_query"), "path"), "norm_query", "left")


def candidates(queries: DataFrame, choices: DataFrame, key: str = "norm_query", text: str = "search_text") -> DataFrame:
    """(norm_query, norm): distinct pairs with a shared word of more than two characters."""
    asked = queries.select(key, F.explode(query_words(text)).alias("word")).distinct()
    return asked.join(postings(choices), "word").select(key, "norm").distinct()


def candidates_exist(queries: DataFrame, choices: DataFrame, key: str = "norm_query", text: str = "search_text") -> DataFrame:
    """(norm_query): queries that share an index word with any row; the words meet as distinct words, so no pair is made."""
    asked = queries.select(key, F.explode(query_words(text)).alias("word")).distinct()
    return asked.join(postings(choices).select("word").distinct(), "word", "left_semi").select(key).distinct()


def scan_in_blocks(queries: DataFrame, library: DataFrame, prepare: Callable[[pd.DataFrame], Any], best: Callable[[pd.DataFrame, Any, dict], pd.DataFrame], schema: str, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Run ``best(queries, prepare(rows), known)`` on every block of queries with every block of rows.

    For a stated query set against all rows. Blocks have a bounded number of rows, no pair is ever a
    row: ``best`` gives a bounded result for each query, to be combined by the caller. Each block is a
    row, shuffled once; the blocks meet in a cartesian product, which reads them again and writes
    nothing. ``known`` is kept through a task, for what its earlier blocks gave. ``sizes``: rows and
    queries of a block, if other than usual.
    """
    n_l, n_q = (max(1, math.ceil(df.count() / size)) for df, size in zip((library, queries), sizes or (ROWS, QUERIES)))
    types, arrow = T.StructType.fromDDL(schema), to_arrow_schema(T.StructType.fromDDL(schema))

    def packed(df: DataFrame, n: int, name: str) -> DataFrame:
        own = df.select(F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int").alias(f"{name}_block"), F.struct(*df.columns).alias("row"))
        parts = own.repartitionById(min(n, PARTS), F.col(f"{name}_block"))  # stated, since blocks are few bytes and much work, and by their numbers, so that none holds more blocks than it must
        return parts.groupBy(f"{name}_block").agg(F.collect_list("row").alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame = lambda rows: pa.RecordBatch.from_struct_array(rows.values).to_pandas()
        known: dict = {}
        at, ready = None, None
        for batch in batches:
            for block, rows, asked in zip(*(batch.column(c) for c in ("l_block", "l", "q"))):
                if block != at:  # those of one block follow each other
                    at, ready = block, prepare(frame(rows))
                yield pa.RecordBatch.from_pandas(best(frame(asked), ready, known), arrow, preserve_index=False)

    pairs = packed(library, n_l, "l").hint("shuffle_replicate_nl").crossJoin(packed(queries, n_q, "q").drop("q_block"))
    return pairs.mapInArrow(run, types)
