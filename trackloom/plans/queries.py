"""Queries over the tables of a data folder, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackloom.functions import paths, similarity, text
from trackloom.operators import blocking, library, matching, unpack, widen
from trackloom.plans import oracle
from trackloom.session import table
from trackloom.sinks import playlists as sinks
from trackloom.sources import playlists as sources

Query = Callable[[SparkSession, str], DataFrame]


# ---- inputs


def flacs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "flacs")


def parts_library(spark: SparkSession, d: str) -> DataFrame:
    """A library told from the parts table: paths with brand and type folders, the names as norms."""
    p = table(spark, d, "part")
    folder = F.concat(F.lit("/music/"), "p_brand", F.lit("/"), "p_type", F.lit(" ("), (1990 + F.col("p_size") % 30).cast("string"), F.lit(")/"))
    name = F.concat(F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.lit(" - "), "p_name", F.lit(".flac"))
    return p.select(F.col("p_partkey").alias("lib_id"), F.concat(folder, name).alias("path"), F.lower("p_name").alias("norm"))


def parts_playlist(spark: SparkSession, d: str) -> DataFrame:
    """A playlist told from every part: "BRAND - name", a bare name, or noise, in turn."""
    kind = F.col("p_partkey") % 3
    track = F.when(kind == 0, F.concat(F.upper("p_brand"), F.lit(" - "), "p_name")).when(kind == 1, F.col("p_name")).otherwise(F.concat(F.reverse("p_name"), F.lit(" Live")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("pos"), track.alias("track"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    """(pos, track): all playlist entries as flat text."""
    tracks = sources.json_tracks(table(spark, d, "matches").select("match_id", F.concat(F.lit("["), "query_track", F.lit("]")).alias("value")), keep=("match_id",))
    return tracks.where("track <> ''").select(F.col("match_id").alias("pos"), "track")


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The library as first scanned, and as a later scan of /music found it."""
    f = flacs(spark, d)
    row = F.struct("mtime", "norm", "title")
    old = f.groupBy("path").agg(F.min_by(row, "flac_id").alias("r")).select("path", "r.*")
    new = f.where(library.under("path", "/music")).groupBy("path").agg(F.max_by(row, "flac_id").alias("r")).select("path", "r.*")
    return old, new


def _tenths():
    """The score in whole tenths."""
    return F.bround(F.col("score") * 10, 0).cast("int").alias("tenths")


# ---- library


def normalize_strings(spark, d):
    return flacs(spark, d).select("flac_id", text.squash("path").alias("path_squashed"), text.squash("norm").alias("norm_squashed"))


def library_recent(spark, d):
    return library.recent(flacs(spark, d).groupBy("path").agg(F.max("mtime").alias("mtime")), 100)


def library_search(spark, d):
    return library.search(flacs(spark, d), artist="radio", album="symphony").select("flac_id", "path")


def library_tracks(spark, d):
    return library.all_tracks(flacs(spark, d)).select("flac_id", "path", F.col("format.sample_rate").alias("sample_rate"))


def library_dedup_norm(spark, d):
    return library.last_by_norm(flacs(spark, d), "flac_id")


def hidden_filter(spark, d):
    return flacs(spark, d).where(~paths.hidden("path")).select("flac_id", "path")


def refresh_changes(spark, d):
    old, new = snapshots(spark, d)
    return library.changed(new, old).select("path", "mtime")


def refresh_purge(spark, d):
    old, new = snapshots(spark, d)
    return library.purge(old, new, "/music").select("path", "mtime")


def refresh_upsert(spark, d):
    old, new = snapshots(spark, d)
    return library.upsert(old, new).select("path", "mtime", "norm")


def schema_migrate(spark, d):
    return library.migrated(flacs(spark, d)).select("flac_id", "track_number", "format_json")


def row_validation(spark, d):
    f = flacs(spark, d).withColumn("track_number", F.col("trackno").cast("string"))
    return library.valid_rows(f).select("path", "norm", "mtime", "artist", "album", "title", "year")


def stub_metadata(spark, d):
    return library.stub_rows(flacs(spark, d), "norm-").select("path", "title", "norm", "mtime")


def parse_path_v1(spark, d):
    return paths.parse_path(flacs(spark, d).select("flac_id", "path")).select("flac_id", "artist", "album", "title", "trackno", "yr")


def parse_path_v2(spark, d):
    return paths.parse_path_by_folder(flacs(spark, d).select("flac_id", "path")).select("flac_id", "artist", "album", "title", "trackno", "yr")


def sample_rates(spark, d):
    return library.odd_rates(flacs(spark, d))


def nearest_rate(spark, d):
    return library.nearest_rate(library.odd_rates(flacs(spark, d)))


def tag_coalesce(spark, d):
    """Tags of each file, exact duplicates of a key reduced to the first, merged by preference of keys."""
    tags = table(spark, d, "flac_tags").where("path is not null and tag_key in ('artist','ARTIST','TPE1','album','ALBUM','TALB','title','TITLE','TIT2','tracknumber','TRACKNUMBER','TRCK','date','DATE','year','YEAR','TDRC')")
    one = tags.groupBy("path", "tag_key").agg(F.min_by("tag_value", F.when(F.col("tag_value").isNotNull(), F.col("tag_id"))).alias("tag_value")).where("tag_value is not null")
    maps = one.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("tag_key", "tag_value"))).alias("tags"))
    return maps.select("path", library.merged_tags(F.col("tags")).alias("t")).select("path", "t.*")


# ---- text and scores


def title_norm(spark, d):
    return flacs(spark, d).select("flac_id", text.canon("path").alias("canonical"))


def title_norm_any(spark, d):
    return flacs(spark, d).select("flac_id", *(text.canon(c).alias(c) for c in ("artist", "album", "title")))


def token_split(spark, d):
    c = flacs(spark, d).select("flac_id", text.canon("path").alias("t"))
    return c.select("flac_id", F.array_join(text.core("t"), " ").alias("core"), F.array_join(text.junk("t"), " ").alias("junk"))


def index_postings(spark, d):
    return blocking.postings(flacs(spark, d))


def _options(spark, d):
    return matching.choices(matching.lookup_with(parts_library(spark, d), "lib_id"), "lib_id", True)


def _asked(spark, d):
    return matching.asked(parts_playlist(spark, d), True)


def _hits(spark, d):
    options = _options(spark, d)
    open_ = _asked(spark, d).join(options.select(F.col("norm").alias("norm_query")), "norm_query", "left_anti")
    return blocking.candidates(open_, options)


def block_candidates(spark, d):
    return _hits(spark, d)


def exact_match(spark, d):
    return blocking.exact(_asked(spark, d), _options(spark, d)).select("track", "norm_query", "path")


def _title_pairs(spark, d):
    """Pairs of distinct part titles with the same first word."""
    t = table(spark, d, "part").select(text.canon("p_name", True).alias("t")).distinct().withColumn("w", F.split("t", " ")[0])
    return t.select("w", F.col("t").alias("a")).join(t.select("w", F.col("t").alias("b")), "w")


def phrase_score(spark, d):
    return _title_pairs(spark, d).where("a <> b").select("a", "b", F.round(similarity.phrase(F.col("a"), F.col("b")), 6).alias("score"))


def token_overlap(spark, d):
    return _title_pairs(spark, d).select("a", "b", F.round(similarity.overlap(F.col("a"), F.col("b")), 6).alias("score"))


def word_overlap(spark, d):
    return _hits(spark, d).select("norm_query", "norm", F.round(similarity.word_share("norm_query", "norm"), 6).alias("share"))


def series_bonus(spark, d):
    """The bonus of every document, whatever its script; SQL cannot state the compatibility form."""
    c = table(spark, d, "documents").select("doc_id", text.canon("text").alias("t"))
    return c.select("doc_id", similarity.series_bonus(F.col("t"), F.col("t")).alias("bonus"))


def length_ratio(spark, d):
    return flacs(spark, d).where("artist is not null and album is not null").select("flac_id", similarity.length_ratio("artist", "album").alias("ratio"))


def indel_ratio(spark, d):
    """Edit ratio of each file's artist and album by the column expression."""
    return flacs(spark, d).where("artist is not null and album is not null").select("flac_id", F.round(similarity.ratio("artist", "album"), 6).alias("ratio"))


def weighted_ratio(spark, d):
    return flacs(spark, d).where("artist is not null and album is not null").select("flac_id", similarity.weighted_ratio("artist", "album").alias("ratio"))


def score_v1(spark, d):
    return matching.scored(_asked(spark, d), _options(spark, d), False).select("track", "norm", _tenths())


def score_v2(spark, d):
    """Ratio score of each file against its own path's fields."""
    f = paths.parse_path_by_folder(flacs(spark, d).select("flac_id", "path", *(F.col(c).alias(f"f_{c}") for c in ("artist", "album", "title", "duration"))))
    q = {"artist": F.col("artist"), "album": F.col("album"), "title": F.col("title"), "duration": F.lit(None).cast("double")}
    c = {k: F.col(f"f_{k}") for k in q}
    return f.select("flac_id", similarity.ratio_score(q, c, similarity.edit_ratio).alias("score"))


# ---- matchers


def _best(spark, d):
    return matching.best(parts_playlist(spark, d), parts_library(spark, d), "lib_id", True)


def _one(spark, d):
    return matching.one_to_one(_best(spark, d), parts_playlist(spark, d))


def match_best(spark, d):
    """Best of the files that share an index word, which SQL can state; the matchers below fall back to similar files as well."""
    return matching.best(parts_playlist(spark, d), parts_library(spark, d), "lib_id", True, False).select("pos", "track", "norm", "path", _tenths())


def match_one_to_one(spark, d):
    return _one(spark, d).select("pos", "track", "path", _tenths())


def match_counts(spark, d):
    return matching.counts(parts_playlist(spark, d), _one(spark, d))


def match_classify(spark, d):
    return matching.classify(_best(spark, d), parts_playlist(spark, d)).select("pos", "track", "status")


def review_topk(spark, d):
    return matching.review_candidates(parts_playlist(spark, d), parts_library(spark, d), "lib_id", 5, True, "words").select("track", "rank", "path", _tenths())


def manual_topk(spark, d):
    top = matching.manual_candidates(parts_playlist(spark, d), _one(spark, d), parts_library(spark, d), "lib_id", 5, True, "words")
    return top.select("track", "rank", "path", _tenths())


def unmatched_split(spark, d):
    return matching.unmatched(parts_playlist(spark, d), _one(spark, d))


def decision_overlay(spark, d):
    one = _one(spark, d)
    decisions = one.where("path is null and contains(track, ' - ')").select("track", F.concat(F.lit("/chosen/"), "track").alias("choice"))
    return matching.overlay(one, decisions).select("pos", "track", "path")


def match_entries(spark, d):
    """The playlists' entries against the library by phrases and words."""
    return matching.one_to_one(matching.best(entries(spark, d), flacs(spark, d), "flac_id"), entries(spark, d)).select("pos", "track", "path", _tenths())


def review_entries(spark, d):
    """The five best files of each entry that ends without one, of the fifty most like it in the whole library."""
    one = matching.one_to_one(matching.best(entries(spark, d), flacs(spark, d), "flac_id"), entries(spark, d)).where("path is null")
    open_ = entries(spark, d).join(one.select("track"), "track", "left_semi")
    return matching.review_candidates(open_, flacs(spark, d), "flac_id").select("track", "rank", "path", _tenths())


def classify_entries(spark, d):
    """The entries of the playlists as matched, for review, or unmatched."""
    return matching.classify(matching.best(entries(spark, d), flacs(spark, d), "flac_id"), entries(spark, d)).select("pos", "track", "status", "path")


def _structs(spark, d):
    tracks = table(spark, d, "matches").select("match_id", F.concat(F.lit("["), "query_track", F.lit("]")).alias("value"))
    return sources.json_structs(tracks, keep=("match_id",)).select(F.col("match_id").alias("pos"), "artist", "album", "title", "duration")


def match_v2(spark, d):
    return matching.match_by_ratio(_structs(spark, d), flacs(spark, d))


def match_v2_counts(spark, d):
    return matching.status_counts(match_v2(spark, d))


def match_simple(spark, d):
    return matching.match_simple(entries(spark, d), flacs(spark, d), "flac_id").select("pos", "track", "path", F.round("score", 4).alias("score"))


def test_match_entry(spark, d):
    f = flacs(spark, d)
    index = lambda c: f.where(F.col(c).isNotNull()).select(text.squash(c).alias("key"), "path")
    return matching.entry_paths(f.select(F.col("flac_id").alias("entry_id"), "artist", "title"), f, index("album"), index("title"))


# ---- playlists in and out


def playlist_lines(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("value"))
    return sources.track_lines(docs, keep=("doc_id",))


def playlist_json(spark, d):
    return entries(spark, d).select(F.col("pos").alias("match_id"), "track")


def m3u_annotated(spark, d):
    return sinks.annotated_lines(_one(spark, d))


def m3u_plain(spark, d):
    return sinks.m3u_lines(_one(spark, d))


def json_mapping(spark, d):
    return sinks.mapping_lines(_one(spark, d))


def songshift_json(spark, d):
    return sinks.songshift_items(unmatched_split(spark, d))


def match_report_json(spark, d):
    return sinks.report_items(match_v2(spark, d), _structs(spark, d))


# ---- attribute-value rows and packed values


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return widen.filled(table(spark, d, "flac_tags"))


def p2_wide(spark: SparkSession, d: str) -> DataFrame:
    """The wide table; ``failures`` tells the number of unreadable values of each field that has any, as "field=n" by field."""
    told = F.transform(F.map_entries("cast_failures"), lambda e: F.concat_ws("=", e["key"], e["value"]["n"].cast("string")))
    w = widen.wide(table(spark, d, "flac_tags"))
    return w.withColumn("failures", F.array_join(F.array_sort(told), ",")).drop("cast_failures")


def p2_failures(spark: SparkSession, d: str) -> DataFrame:
    return widen.failures(table(spark, d, "flac_tags"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_values(spark, d).select("src", "rec_id", "pos")


def p4_values(spark: SparkSession, d: str) -> DataFrame:
    return unpack.unpack(table(spark, d, "flacs"), table(spark, d, "flac_tags"), table(spark, d, "tag_terms"))


INPUTS = {"flacs", "parts_library", "parts_playlist", "entries", "snapshots", "table", "queries", "oracle_sql"}


def queries() -> dict[str, Query]:
    return {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and n[0] != "_" and n not in INPUTS}


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
