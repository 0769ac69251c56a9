"""Command line: get, match, list, out, config over a library of snapshots."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import asdict, replace

from pyspark.sql import functions as F

from trackloom import config
from trackloom.functions.paths import parse_path_by_folder
from trackloom.operators import library as lib
from trackloom.operators import matching
from trackloom.plans.run import KINDS, run_matcher
from trackloom.session import local_session, ship
from trackloom.sinks import playlists as sinks
from trackloom.sources.files import scan
from trackloom.sources.playlists import read_playlist, read_structs


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trackloom")
    p.add_argument("--config", help="JSON file of settings")
    p.add_argument("--root", action="append", help="library root, may be repeated")
    p.add_argument("--library", help="folder of the library's snapshots")
    sub = p.add_subparsers(dest="command", required=True)
    get = sub.add_parser("get").add_subparsers(dest="what", required=True)
    get.add_parser("library")
    get.add_parser("playlist").add_argument("playlist")
    match = sub.add_parser("match").add_subparsers(dest="what", required=True)
    auto = match.add_parser("auto")
    auto.add_argument("playlist")
    auto.add_argument("--backend", default="smart")
    review = match.add_parser("review")
    review.add_argument("playlist")
    review.add_argument("--decisions", help="Parquet of (track, choice)")
    review.add_argument("--output")
    ratio = match.add_parser("ratio")
    ratio.add_argument("playlist")
    ratio.add_argument("--threshold", type=int, default=88)
    ratio.add_argument("--output")
    listed = sub.add_parser("list").add_subparsers(dest="what", required=True)
    listed.add_parser("tracks")
    listed.add_parser("recent").add_argument("--n", type=int, default=100)
    out = sub.add_parser("out").add_subparsers(dest="what", required=True)
    for kind in ("m3u", "json", "songshift"):
        o = out.add_parser(kind)
        o.add_argument("playlist")
        o.add_argument("--output")
    run = sub.add_parser("run")
    run.add_argument("playlist")
    run.add_argument("--out", default="m3u", choices=KINDS)
    run.add_argument("--threshold", type=int, default=int(os.environ.get(config.PREFIX + "AUTO_THRESHOLD", 60)))
    run.add_argument("--title-threshold", type=int, default=int(os.environ.get(config.PREFIX + "TITLE_THRESHOLD", 70)))
    c = sub.add_parser("config")
    c.add_argument("what", choices=("show", "init", "set"))
    c.add_argument("pairs", nargs="*", help="name=value of settings to set")
    return p


FIELDS = ("artist", "album", "title")


def review_report(playlist, library, conf, output: str | None) -> int:
    """Print each track as auto, review or unmatched, those not matched with their best files; write the matched ones."""
    told = matching.classify(matching.best(playlist, library, "mtime"), playlist, conf)
    open_ = playlist.join(told.where("status <> 'auto'").select("track"), "track", "left_semi")
    top = matching.review_candidates(open_, library, "mtime").groupBy("track").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "score"))).alias("top"))  # five a track
    counts = {}
    for r in told.join(top, "track", "left").orderBy("pos").toLocalIterator():
        counts[r["status"]] = counts.get(r["status"], 0) + 1
        print(r["status"], r["track"], *([r["path"]] if r["path"] else []), sep="\t")
        for c in (r["top"] or []) if r["status"] != "auto" else []:
            print("", c["rank"], c["score"], c["path"], sep="\t")
    print(*(f"{s}={counts.get(s, 0)}" for s in ("auto", "review", "unmatched")))
    if output:
        sinks.write_m3u(told, output)
    return 0


def main(argv: list[str] | None = None, spark=None) -> int:
    a = arguments().parse_args(argv)
    conf = config.load(a.config)
    conf = replace(conf, library_roots=tuple(a.root) if a.root else conf.library_roots, db_path=a.library or conf.db_path)
    if a.command == "config" and a.what in ("init", "set"):
        if not a.config:
            print("--config names no file", file=sys.stderr)
            return 1
        config.save(conf if a.what == "init" else config.changed(conf, dict(p.split("=", 1) for p in a.pairs)), a.config)
        return 0
    if a.command == "config":
        print("\n".join(f"{k}={v}" for k, v in asdict(conf).items()))
        return 0
    spark = spark or local_session()
    ship(spark)
    store = lib.Snapshots(spark, str(config.guarded(conf.db_path)))
    if (a.command, a.what) == ("get", "library"):
        if not conf.library_roots:
            print("no library root", file=sys.stderr)
            return 1
        for root in conf.library_roots:
            store.refresh(scan(spark, root), root, conf.norm_prefix)
        print(store.read().count())
        return 0
    if a.command == "run":
        found = run_matcher(spark, a.playlist, store, a.out, conf.library_roots, a.threshold, a.title_threshold, conf=conf)
        return 0 if found is not None else 1
    if a.command == "list":
        rows = store.read() if a.what == "tracks" else lib.recent(store.read(), a.n)
        line = F.col("path") if a.what == "tracks" else F.concat_ws(" ", F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd HH:mm:ss"), "norm", F.lit("→"), "path")
        for r in rows.select(line.alias("line")).toLocalIterator():
            print(r["line"])
        return 0
    if (a.command, a.what) == ("match", "ratio"):
        queries = read_structs(spark, a.playlist)
        own = lib.migrated(store.read())
        told = parse_path_by_folder(own.select("path", *(F.col(c).alias(f"{c}_kept") for c in FIELDS), (F.col("duration") if "duration" in own.columns else F.lit(None)).cast("int").alias("duration")))
        tracks = told.select("path", "duration", *(F.when(F.trim("artist_kept" if c == "title" else f"{c}_kept") != "", F.col(f"{c}_kept")).otherwise(F.col(c)).alias(c) for c in FIELDS))  # a title without artist is the mere stem
        done = matching.match_by_ratio(queries, tracks, a.threshold, min(70, a.threshold))
        if a.output and a.output.endswith(".m3u"):
            sinks.write_m3u(done.where("status = 'matched'"), a.output)
        elif a.output:
            sinks.write_report(done, queries, a.output)
        print(*(f"{k}={v}" for k, v in matching.status_counts(done).first().asDict().items()))
        return 0
    playlist = read_playlist(spark, a.playlist)
    if playlist is None or playlist.isEmpty():
        print("no tracks", file=sys.stderr)
        return 1
    if a.command == "get":
        print(playlist.count())
        return 0
    library = store.read()
    if a.command == "match" and a.what == "review" and not a.decisions:
        return review_report(playlist, library, conf, a.output)
    if a.command == "match" and a.what == "auto" and a.backend == "simple":
        found = matching.match_simple(playlist, library, "mtime", conf.threshold_auto_match)
    else:
        if a.command == "match" and a.what == "auto" and a.backend != "smart":
            print(f"unknown backend {a.backend}, using smart", file=sys.stderr)
        found = matching.one_to_one(matching.best(playlist, library, "mtime"), playlist, conf)
    if a.command == "match" and a.what == "review" and a.decisions:
        found = matching.overlay(found, spark.read.parquet(a.decisions))
    if a.command == "out":
        if a.what == "songshift":
            sinks.write_songshift(matching.unmatched(playlist, found), a.output or config.output_path("{playlist_name}.songshift.json", a.playlist))
        elif a.what == "json":
            sinks.write_json(found, config.output_path(conf.match_output_path_json, a.playlist, a.output))
        else:
            sinks.write_m3u(found, config.output_path(conf.match_output_path_m3u, a.playlist, a.output), annotated=True)
        return 0
    if getattr(a, "output", None):
        sinks.write_m3u(found, a.output)
    n = matching.counts(playlist, found).first()
    print(f"matched={n['matched']} unmatched={n['unmatched']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
