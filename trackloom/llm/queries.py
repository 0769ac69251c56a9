"""Queries of the text and entity operators over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackloom.llm import linkage, lookalike, mojibake, names, packing, private, tokens
from trackloom.operators import unpack
from trackloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_links(spark, d).select("match_id", "path").distinct()


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    return linkage.link(table(spark, d, "matches"), table(spark, d, "flacs"), table(spark, d, "tag_terms"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.disguised_fields(table(spark, d, "flacs"))


def p3_plain(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.plain_fields(table(spark, d, "flacs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_fields(table(spark, d, "flacs"))


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repair_fields(table(spark, d, "flacs")).where("garbled").select("flac_id", "field", "text", "restored", "chain")


def clean_names(spark: SparkSession, d: str) -> DataFrame:
    """(field, name) of the artist and album fields of rows where that field is no case of problems 3, 4 and 5."""
    flacs = table(spark, d, "flacs")
    own = mojibake.fields_of(flacs, fields=("artist", "album"))
    odd = mojibake.repair_fields(flacs, fields=("artist", "album")).withColumn("plain", lookalike.plain_form("text")).where("garbled or plain <> text").select("flac_id", "field")
    fields = flacs.select(F.lit("artist").alias("field"), F.col("flac_id").alias("rec_id"), F.col("artist").cast("string").alias("text")).where("text is not null")
    alone = flacs.select(F.col("artist").alias("text")).unionByName(table(spark, d, "tag_terms").select(F.col("term").alias("text"))).where("text is not null")
    packed = unpack.parses(fields, unpack.code_book(alone, fields)).select(F.lit("artist").alias("field"), "text")
    return own.join(odd, ["flac_id", "field"], "left_anti").join(packed, ["field", "text"], "left_anti").select("field", F.col("text").alias("name"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_pairs(names.cluster_names(clean_names(spark, d)))


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    return names.cluster_names(clean_names(spark, d))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_packing(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return private.find_items(table(spark, d, "documents"), table(spark, d, "flacs"))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return private.redact(table(spark, d, "documents"), table(spark, d, "flacs"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
