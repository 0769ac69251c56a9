"""The matcher from a playlist file to an output file in one call."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from trackloom import config
from trackloom.operators import library as lib
from trackloom.operators import matching
from trackloom.sinks import playlists as sinks
from trackloom.sources.files import scan
from trackloom.sources.playlists import read_playlist

#: Kinds of output; "csv" has always been written as JSON.
KINDS = ("m3u", "json", "csv", "both")


def run_matcher(spark: SparkSession, playlist: str, store: lib.Snapshots, out: str = "m3u", roots: tuple[str, ...] = (), threshold: int = 60, review: int = 60, decisions: DataFrame | None = None, conf: config.Config = config.Config()) -> DataFrame | None:
    """Refresh the roots, match the playlist, lay decisions over, write; the matches, or None without tracks.

    An M3U file is written only if at least one track has a file.
    """
    if out not in KINDS:
        raise ValueError(f"out is one of {KINDS}")
    for root in roots:
        store.refresh(scan(spark, root), root, conf.norm_prefix)
    tracks = read_playlist(spark, playlist)
    if tracks is None or tracks.isEmpty():
        return None
    own = replace(conf, threshold_auto_match=threshold, threshold_review_min=min(review, threshold))
    found = matching.one_to_one(matching.best(tracks, store.read(), "mtime"), tracks, own)
    if decisions is not None:
        found = matching.overlay(found, decisions)
    if out in ("json", "csv", "both"):
        sinks.write_json(found, config.output_path(own.match_output_path_json, playlist))
    if out in ("m3u", "both") and not found.where("path is not null").isEmpty():
        sinks.write_m3u(found, config.output_path(own.match_output_path_m3u, playlist), annotated=True)
    return found
