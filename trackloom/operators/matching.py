"""Matchers: one best library file for each playlist entry, classification, review and overlays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from trackloom.config import Config
from trackloom.functions.paths import hidden, parse_path, query_text
from trackloom.functions.similarity import TextBlock, TrackBlock, WeightedBlock, describe, series_flags, track_score, word_share
from trackloom.functions.text import index_words, query_words, squash, strip
from trackloom.operators.blocking import candidates, candidates_exist, scan_in_blocks
from trackloom.operators.library import last_by_norm
from trackloom.session import cut


def choices(library: DataFrame, order: str, ascii_only: bool = False) -> DataFrame:
    """(norm, path, c): one path a norm, the last by ``order``, with its described metadata, parsed once."""
    own = parse_path(last_by_norm(library, order))
    return own.select("norm", "path", describe("artist", "title", "album", "path", "yr", None, ascii_only).alias("c"))


def asked(playlist: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(track, pos, copies, norm_query, search_text, s): distinct tracks at their first position, described as sources."""
    own = playlist.where("track is not null").groupBy("track").agg(F.min("pos").alias("pos"), F.count("*").alias("copies")).withColumn("norm_query", squash("track"))
    parsed = parse_path(own.where("norm_query <> ''"), "track", "s_")
    # the search text is cut from the squashed track, the metadata from the track as given
    from_norm = parse_path(parsed, "norm_query", "n_")
    return from_norm.select(
        "track", "pos", "copies", "norm_query", query_text("norm_query", "n_artist", "n_title", "n_album").alias("search_text"),
        describe("s_artist", "s_title", "s_album", "track", "s_yr", None, ascii_only).alias("s"),
    )


FIELDS = ("title", "artist", "album")
#: Files that a query without an index hit, or a review, is seeded with.
SEED = 50
#: Rows and queries of a block when the most similar are sought, which is much work for each query and some for each block of rows.
LIKE = (20_000, 120)
#: Rows and queries of a block when the best candidates are sought.
TRACKS = (50_000, 4_000)


def scored(queries: DataFrame, options: DataFrame, fallback: bool = True) -> DataFrame:
    """(track, pos, copies, norm_query, norm, path, score): every candidate of a query that no norm equals, with its score.

    Candidates share an index word; a query that shares none with any file has the ``SEED`` norms most
    like it (``fallback``).
    """
    open_ = queries.join(options.select(F.col("norm").alias("norm_query")), "norm_query", "left_anti")
    pairs = candidates(open_, options)
    if fallback:
        none = open_.select("norm_query").distinct().join(candidates_exist(open_, options), "norm_query", "left_anti")
        pairs = pairs.unionByName(fuzzy_top(none, options, SEED).select("norm_query", "norm"))
    return rescored(open_, pairs, options)


def likely(queries: DataFrame, options: DataFrame, fallback: bool = True) -> DataFrame:
    """Rows of ``scored`` that may be a query's best, among them the best: no pair of query and candidate is ever a row, they meet in blocks."""
    open_ = queries.join(options.select(F.col("norm").alias("norm_query")), "norm_query", "left_anti")
    own = open_.select("track", F.array_join(query_words("search_text"), " ").alias("words"), *_described("s"))
    rows = options.select("norm", F.array_join(index_words("norm"), "\n").alias("words"), *_described("c"))

    def prepare(b: pd.DataFrame) -> TrackBlock:
        b = b.sort_values("norm", ignore_index=True)
        return TrackBlock(b["norm"].tolist(), [w.split("\n") if w else [] for w in b["words"]], *(b[f].tolist() for f in ("title", "artist", "album")), b["series"].to_numpy(), b["year"].to_numpy(float))

    def run(a: pd.DataFrame, block: TrackBlock, known: dict) -> pd.DataFrame:
        out = []
        for r in a.itertuples():
            least = known.get(r.track, 0.0)
            top, at = block.best(r.words.split(), r.title, r.artist, r.album, r.series, float("nan") if r.year is None else float(r.year), least)
            known[r.track] = max(top, least)
            out += [(r.track, block.norms[i]) for i in at]
        return pd.DataFrame(out, columns=["track", "norm"])

    pairs = scan_in_blocks(own, rows, prepare, run, "track string, norm string", TRACKS)
    tops = rescored(open_, pairs, options, "track")
    if not fallback:
        return tops
    none = open_.select("norm_query").distinct().join(candidates_exist(open_, options), "norm_query", "left_anti")
    return tops.unionByName(rescored(open_, fuzzy_top(none, options, SEED).select("norm_query", "norm"), options))


def _described(name: str) -> list[Column]:
    """What a track block needs of a description."""
    return [*(F.col(f"{name}.{f}").alias(f) for f in FIELDS), series_flags(F.col(f"{name}.series")).alias("series"), F.col(f"{name}.year").alias("year")]


def rescored(queries: DataFrame, pairs: DataFrame, options: DataFrame, key: str = "norm_query") -> DataFrame:
    """The queries with their candidates of ``pairs`` (``key``, norm) and the scores of those."""
    own = queries.join(pairs, key).join(options, "norm")
    return own.withColumn("score", track_score(F.col("s"), F.col("c"))).select("track", "pos", "copies", "norm_query", "norm", "path", "score")


def best(playlist: DataFrame, library: DataFrame, order: str, ascii_only: bool = False, fallback: bool = True) -> DataFrame:
    """(track, pos, copies, norm_query, norm, path, score): the best candidate of each query.

    A norm equal to the query scores 100. Else the best of the files that share an index word, or
    where none does of those most like the query; ties go to the smaller norm. An empty library gives
    no rows.
    """
    queries, options = cut(asked(playlist, ascii_only)), cut(choices(lookup_with(library, order), order, ascii_only))  # read many times, told once
    sure = queries.join(options.select(F.col("norm").alias("norm_query"), "path"), "norm_query").select("track", "pos", "copies", "norm_query", F.col("norm_query").alias("norm"), "path", F.lit(100.0).alias("score"))
    # max of (score, reversed order of norm) needs no sort: the smallest (-score, norm) wins
    top = likely(queries, options, fallback).groupBy("track", "pos", "copies", "norm_query").agg(F.min(F.struct((-F.col("score")).alias("minus"), "norm", "path")).alias("b"))
    return sure.unionByName(top.select("track", "pos", "copies", "norm_query", "b.norm", "b.path", (-F.col("b.minus")).alias("score")))


def lookup_with(library: DataFrame, order: str) -> DataFrame:
    """Lookup rows that keep the column telling their order of arrival."""
    return library.select("path", "norm", order).where(~hidden("path"))


def one_to_one(matches: DataFrame, playlist: DataFrame, conf: Config = Config()) -> DataFrame:
    """(pos, track, path, score): every track with its file or null; each file goes to the first track that may have it.

    Accepted are scores from the threshold with enough shared words. ``compat``: a track that occurs
    more than once keeps its file used but ends without it; ``keep_first`` leaves it the file.
    """
    fit = matches.where((F.col("score") >= conf.threshold_auto_match) & (word_share("norm_query", "norm") >= conf.word_overlap_reject))
    firsts = fit.groupBy("path").agg(F.min_by(F.struct("track", "copies", "score"), F.struct("pos", "track")).alias("f")).select("path", "f.*")
    won = firsts.where("copies = 1") if conf.dup_policy == "compat" else firsts
    tracks = playlist.where("track is not null").groupBy("track").agg(F.min("pos").alias("pos"))
    return tracks.join(won.select("track", "path", "score"), "track", "left").select("pos", "track", "path", "score")


def classify(matches: DataFrame, playlist: DataFrame, conf: Config = Config()) -> DataFrame:
    """(pos, track, status, path, score): auto, review or unmatched; a good score without shared words is unmatched."""
    near = matches.withColumn("ok", word_share("norm_query", "norm") >= conf.word_overlap_reject)
    auto = F.col("ok") & (F.col("score") >= conf.threshold_auto_match)
    firsts = near.where(auto).groupBy("path").agg(F.min(F.struct("pos", "track")).alias("first"))  # combined before the shuffle, so that a popular file is no task of its own
    ranked = near.withColumn("auto", auto).join(firsts, "path", "left").withColumn("taken", F.coalesce(F.col("first") < F.struct("pos", "track"), F.lit(False)))
    band = F.col("ok") & (F.col("score") >= conf.threshold_review_min) & (F.col("score") < conf.threshold_auto_match)
    status = F.when(F.col("taken"), "unmatched").when(F.col("auto"), "auto").when(band, "review").otherwise("unmatched")
    told = ranked.withColumn("status", status)
    tracks = playlist.where("track is not null").groupBy("track").agg(F.min("pos").alias("pos")).where(squash("track") != "")
    out = tracks.join(told.select("track", "status", "path", "score"), "track", "left")
    return out.select("pos", "track", F.coalesce("status", F.lit("unmatched")).alias("status"), F.when(F.col("status") == "auto", F.col("path")).alias("path"), "score")


def review_candidates(playlist: DataFrame, library: DataFrame, order: str, k: int = 5, ascii_only: bool = False, seed: str = "fuzzy") -> DataFrame:
    """(track, rank, path, score): the k best files of each track that no norm equals; by score, then norm.

    ``seed``: "fuzzy" ranks the norms most like the track, ten times k and ``SEED`` at least, found over
    the whole library in blocks; "words" all files that share an index word with it; "both" either.
    """
    queries, options = cut(asked(playlist, ascii_only)), cut(choices(lookup_with(library, order), order, ascii_only))
    open_ = queries.join(options.select(F.col("norm").alias("norm_query")), "norm_query", "left_anti")
    like = lambda: fuzzy_top(open_.select("norm_query"), options, max(10 * k, SEED)).select("norm_query", "norm")
    pairs = like() if seed == "fuzzy" else candidates(open_, options) if seed == "words" else candidates(open_, options).unionByName(like()).distinct()
    rank = F.row_number().over(Window.partitionBy("track").orderBy(F.desc("score"), "norm"))
    return rescored(open_, pairs, options).withColumn("rank", rank).where(F.col("rank") <= k).select("track", "rank", "path", "score")


def overlay(auto: DataFrame, decisions: DataFrame) -> DataFrame:
    """Matches with people's decisions (track, choice) laid over: a choice replaces, a null choice takes away, no row leaves."""
    own = decisions.select("track", F.struct("choice").alias("_decided"))
    path = F.when(F.col("_decided").isNotNull(), F.col("_decided.choice")).otherwise(F.col("path"))
    return auto.join(own, "track", "left").withColumn("path", path).drop("_decided")


def unmatched(playlist: DataFrame, matches: DataFrame) -> DataFrame:
    """(pos, artist, track) of each entry without a file, copies kept: split once at " - ", else by an unknown artist."""
    none = playlist.where("track is not null").join(matches.where("path is not null").select("track"), "track", "left_anti")
    cut = F.split("track", " - ", 2)
    two = F.size(cut) == 2
    return none.select("pos", F.when(two, strip(cut[0])).otherwise("Unknown Artist").alias("artist"), strip(F.when(two, cut[1]).otherwise(F.col("track"))).alias("track"))


def counts(playlist: DataFrame, matches: DataFrame) -> DataFrame:
    """(matched, unmatched): distinct tracks with a file; entries less those."""
    n = playlist.where("track is not null").agg(F.count("*").alias("n"))
    m = matches.agg(F.count_if(F.col("path").isNotNull()).alias("matched"))
    return m.select("matched", (n.select("n").scalar() - F.col("matched")).alias("unmatched"))


def entry_paths(entries: DataFrame, library: DataFrame, artists: DataFrame | None = None, titles: DataFrame | None = None) -> DataFrame:
    """(entry_id, path): equi-lookup of the squashed artist, else title; an artist index goes before a title index before the norms."""
    key = squash(F.when(F.coalesce("artist", F.lit("")) != "", F.col("artist")).otherwise(F.coalesce("title", F.lit(""))))
    out = entries.select("entry_id", key.alias("key"))
    found = []
    for n, (index, name) in enumerate(((artists, "key"), (titles, "key"), (library, "norm"))):
        if index is not None:
            first = index.groupBy(F.col(name).alias("key")).agg(F.min("path").alias(f"p{n}"))
            out, found = out.join(first, "key", "left"), [*found, f"p{n}"]
    return out.select("entry_id", F.coalesce(*found).alias("path"))


# ---- whole scans by edit ratio

#: Rows with the best bounds that are scored first, by which most of the others are left out.
FIRST = 200


def best_by_ratio(queries: DataFrame, library: DataFrame, normalised: bool = False) -> DataFrame:
    """(pos, score, path): best file of each (pos, artist, title, album, duration) by the ratio score, over all rows.

    Every query meets every row in blocks; each block gives one row a query. Ties: the smaller path.
    A query that scores 0 everywhere has a null path and score 0.
    """
    q = queries.select("pos", *(squash(c).alias(c) for c in FIELDS), F.col("duration").cast("double").alias("duration"))
    lib = library.select("path", *(squash(c).alias(c) for c in FIELDS), F.col("duration").cast("double").alias("duration"))
    weight = 1.0 if normalised else 2.0

    def prepare(b: pd.DataFrame) -> tuple:
        b = b.sort_values("path", ignore_index=True)
        kinds = {f: pd.factorize(b[f]) for f in FIELDS}
        blocks = {f: TextBlock(list(u)) for f, (_, u) in kinds.items()}
        there = {f: ((blocks[f].lengths > 0)[kinds[f][0]] if len(blocks[f].lengths) else np.zeros(len(b), dtype=bool)) & (kinds[f][0] >= 0) for f in FIELDS}
        dur = b["duration"].to_numpy(float)
        return b["path"], np.where(dur != 0, dur, np.nan), {f: k for f, (k, _) in kinds.items()}, blocks, there, {}

    def run(a: pd.DataFrame, ready: tuple, known: dict) -> pd.DataFrame:
        paths, dur, kinds, blocks, there, shares = ready
        dur_there = ~np.isnan(dur)

        def ratios(f: str, text: str, rows: np.ndarray) -> np.ndarray:
            own, codes = exact.setdefault(f, np.full(len(blocks[f].texts), -1.0)), kinds[f][rows]
            need = np.unique(codes[codes >= 0])
            need = need[own[need] < 0]
            if len(need):
                own[need] = blocks[f].ratios(text, need)
            return own[codes]

        out = []
        for r in a.itertuples():
            texts = {f: getattr(r, f) for f in FIELDS if getattr(r, f) and len(blocks[f].texts)}
            lasting = bool(r.duration) and r.duration == r.duration

            def at_most() -> np.ndarray:
                """What the scores are at most, in single precision and a little above."""
                asked = (*texts, *(["duration"] if lasting else []))
                if asked not in shares:
                    shares[asked] = 1 / np.maximum(sum((dur_there if f == "duration" else there[f]).astype(np.float32) for f in asked) if asked else np.zeros(len(dur), dtype=np.float32), 1)
                total = np.zeros(len(dur), dtype=np.float32)
                for f, text in texts.items():
                    bound = np.where(blocks[f].lengths > 0, blocks[f].bounds(text) * (weight if f == "title" else 1.0), 0.0)
                    total += np.append(bound, 0.0).astype(np.float32)[kinds[f]]  # the last is for none
                if lasting:
                    apart = np.abs(dur - r.duration)
                    steps = dur_there.astype(np.int8) * 2 + (apart <= 10) + (apart <= 5) + (apart <= 2)
                    total += steps * np.float32(20)
                return total * shares[asked] + np.float32(0.01)

            def whole(rows: np.ndarray, of: Callable[[str, str], np.ndarray]) -> np.ndarray:
                """Scores of rows, the ratios given by field and text."""
                total, parts = np.zeros(len(rows)), np.zeros(len(rows))
                for f, text in texts.items():
                    total += np.where(there[f][rows], of(f, text) * (weight if f == "title" else 1.0), 0.0)
                    parts += there[f][rows]
                if lasting:
                    apart = np.abs(dur[rows] - r.duration)
                    total += np.where(dur_there[rows], np.select([apart <= 2, apart <= 5, apart <= 10], [100.0, 80.0, 60.0], 40.0), 0.0)
                    parts += dur_there[rows]
                return np.where(parts > 0, total / np.maximum(parts, 1), 0.0).astype(np.int64)

            exact: dict[str, np.ndarray] = {}  # ratios of this query worked out so far, else -1
            most = at_most()
            n = min(FIRST, len(most) - 1)
            rows = np.argpartition(-most, n)[: n + 1]
            score = whole(rows, lambda f, text: ratios(f, text, rows))
            least = max(int(score.max()), known.get(r.pos, 0))
            rows = np.flatnonzero(most >= least)  # in the order of paths
            if not len(rows):
                continue
            score = whole(rows, lambda f, text: ratios(f, text, rows))
            i = int(score.argmax())
            if score[i] >= least:
                known[r.pos] = int(score[i])
                out.append((r.pos, int(score[i]), paths[rows[i]] if score[i] > 0 else None))
        return pd.DataFrame(out, columns=["pos", "score", "path"])

    tops = scan_in_blocks(q, lib, prepare, run, "pos long, score long, path string")
    top = F.min(F.struct((-F.col("score")).alias("minus"), F.col("path").isNull().alias("none"), "path")).alias("b")
    return tops.groupBy("pos").agg(top).select("pos", (-F.col("b.minus")).alias("score"), F.col("b.path").alias("path"))


def match_by_ratio(queries: DataFrame, library: DataFrame, auto: int = 88, review: int = 70) -> DataFrame:
    """(pos, score, status, path): matched, review or unmatched; the latter without path, its score kept. Files may repeat."""
    done = queries.select("pos").join(best_by_ratio(queries, library), "pos", "left").select("pos", F.coalesce("score", F.lit(0)).alias("score"), "path")
    status = F.when(F.col("score") >= auto, "matched").when(F.col("score") >= review, "review").otherwise("unmatched")
    return done.select("pos", "score", status.alias("status"), F.when(F.col("score") >= review, F.col("path")).alias("path"))


def status_counts(matches: DataFrame) -> DataFrame:
    named = {s: F.count_if(F.col("status") == s).alias(s) for s in ("matched", "review", "unmatched")}
    return matches.agg(*named.values())


def match_simple(playlist: DataFrame, library: DataFrame, order: str, threshold: float = 85) -> DataFrame:
    """(pos, track, path, score): best norm by edit ratio over the whole library, from the threshold; files may repeat.

    Equal norms score 100. All rows are scored, not a seed of them; ties go to the smaller norm.
    """
    own = playlist.where("track is not null").groupBy("track").agg(F.min("pos").alias("pos")).withColumn("norm_query", squash("track"))
    lib = last_by_norm(lookup_with(library, order), order)

    def prepare(b: pd.DataFrame) -> tuple:
        b = b.sort_values("norm", ignore_index=True)
        return b["norm"], b["path"], TextBlock(b["norm"].tolist())

    def run(a: pd.DataFrame, ready: tuple, known: dict) -> pd.DataFrame:
        norms, paths, block = ready
        out = []
        for q in a["norm_query"]:
            least = known.get(q, threshold)
            rows = np.flatnonzero(block.bounds(q) + 1e-9 >= least)  # what is below the threshold is left out at the end anyway
            if len(rows):
                score = block.ratios(q, rows)
                i = int(score.argmax())
                if score[i] >= least:
                    known[q] = float(score[i])
                    out.append((q, known[q], norms[rows[i]], paths[rows[i]]))
        return pd.DataFrame(out, columns=["norm_query", "score", "norm", "path"])

    tops = scan_in_blocks(own.select("norm_query").distinct(), lib.select("norm", "path"), prepare, run, "norm_query string, score double, norm string, path string")
    top = tops.groupBy("norm_query").agg(F.min(F.struct((-F.col("score")).alias("minus"), "norm", "path")).alias("b"))
    found = top.select("norm_query", (-F.col("b.minus")).alias("score"), F.col("b.path").alias("path")).where((F.col("score") >= threshold) & (F.col("score") > 0))
    return own.join(found, "norm_query", "left").select("pos", "track", "path", "score")




def fuzzy_top(queries: DataFrame, library: DataFrame, k: int = 50) -> DataFrame:
    """(norm_query, rank, norm, path, score): the k norms most like each query by the weighted ratio, over the whole library.

    Every block gives at most k rows a query. Ties: the smaller norm.
    """

    def prepare(b: pd.DataFrame) -> tuple:
        norms = b["norm"].tolist()
        return norms, b["path"].tolist(), WeightedBlock(norms)

    def run(a: pd.DataFrame, ready: tuple, known: dict) -> pd.DataFrame:
        norms, paths, block = ready
        rows = []
        for q in a["norm_query"]:
            top = block.top(q, k, known.get(q, 0))
            if len(top) == k:  # no later row that is worse is among the k best
                known[q] = max(known.get(q, 0), top[-1][0])
            rows += [(q, norms[i], paths[i], s) for s, i in top]
        return pd.DataFrame(rows, columns=["norm_query", "norm", "path", "score"])

    tops = scan_in_blocks(queries.select("norm_query").distinct(), library.select("norm", "path"), prepare, run, "norm_query string, norm string, path string, score int", LIKE)
    rank = F.row_number().over(Window.partitionBy("norm_query").orderBy(F.desc("score"), "norm"))
    return tops.withColumn("rank", rank).where(F.col("rank") <= k).select("norm_query", "rank", "norm", "path", "score")


def manual_candidates(playlist: DataFrame, matches: DataFrame, library: DataFrame, order: str, k: int = 5, ascii_only: bool = False, seed: str = "both") -> DataFrame:
    """The k best files of each track that ended without one, of those that share a word with it or are most like it."""
    open_ = playlist.join(matches.where("path is null").select("track"), "track", "left_semi")
    return review_candidates(open_, library, order, k, ascii_only, seed)
