import os

import pytest
from pyspark.sql import functions as F

from trackloom import config
from trackloom.operators import library as lib
from trackloom.sources import files, playlists
from trackloom.sinks import playlists as sinks
from trackloom.streaming import watch


@pytest.fixture()
def music(tmp_path):
    root = tmp_path / "music"
    (root / "_deep" / ".more").mkdir(parents=True)
    for name in ("one.flac", "TWO.FLAC", "._one.flac", "_deep/three.mp3", "_deep/.more/four.ogg", "note.txt", ".flac"):
        (root / name).write_bytes(b"" if "four" in name else b"x")
    return root


def test_scan(spark, music):
    names = lambda df: sorted(os.path.basename(r["path"]) for r in df.collect())
    assert names(files.scan(spark, str(music))) == ["._one.flac", "TWO.FLAC", "four.ogg", "one.flac", "three.mp3"]
    assert names(files.scan_flac(spark, str(music))) == ["._one.flac", "TWO.FLAC", "one.flac"]
    assert "TWO.FLAC" not in names(files.scan_wide(spark, [str(music), "/no/such/root"]))
    assert files.scan_wide(spark, ["/no/such/root"]).count() == 0
    with pytest.raises(OSError):
        files.scan(spark, "/no/such/root")


def test_refresh(spark, music, tmp_path):
    store = lib.Snapshots(spark, str(tmp_path / "lib"))
    first = store.refresh(files.scan(spark, str(music)), str(music))
    assert first.count() == 5 and first.where("norm = 'two'").count() == 1
    before = sorted(first.select("path", "mtime").collect())
    again = store.refresh(files.scan(spark, str(music)), str(music))
    assert sorted(again.select("path", "mtime").collect()) == before
    (music / "one.flac").unlink()
    os.utime(music / "TWO.FLAC", (10, 10))
    last = store.refresh(files.scan(spark, str(music)), str(music))
    assert last.count() == 4 and last.where("mtime = 10").count() == 1
    other = spark.createDataFrame([(str(music) + "2/x.flac", 1, 1)], "path string, mtime long, length long")
    assert lib.purge(lib.upsert(last, lib.stub_rows(other)), last.limit(0), str(music)).count() == 1  # a neighbour folder stays


def test_rows(spark, got):
    raw = [("p", "n", "7", "", "al", None, "", "1", None, 3), ("q", "n", "-5", "a", None, "t", "2", "", "{}", 3), (None, "n", "1", "", "", "", "", "", "", 3), ("r", "", "1", "", "", "", "", "", "", 3), ("s", "n", "bad", "", "", "", "", "", "", 3)]
    df = spark.createDataFrame(raw, "path string, norm string, mtime string, artist string, album string, title string, track_number string, year string, format_json string, clash int")
    assert got(lib.valid_rows(df).select("path", "mtime", "artist", "title", "year", "format_json")) == [
        ("p", 7, None, "", "1", "{}"), ("q", 0, "a", "t", None, "{}"), ("s", 0, None, "", None, "{}")]
    old = spark.createDataFrame([("p", 3), ("q", None)], "path string, trackno int")
    assert got(lib.migrated(old)) == [("p", "3", "{}"), ("q", None, "{}")]


def test_search_recent_and_format(spark, got):
    df = spark.createDataFrame([("/b", "n", 2, "Ann", "Blue", '{"sample_rate": 96000}'), ("/a", "n", 2, "ANN x", None, "bad"), ("/c", "n", 1, None, "Blue", None)], "path string, norm string, mtime long, artist string, album string, format_json string")
    assert [r["path"] for r in lib.search(df, artist="ann").collect()] == ["/a", "/b"]
    assert [r["path"] for r in lib.search(df, artist="ann", album="b%e").collect()] == ["/b"]
    assert [r["path"] for r in lib.recent(df, 2).collect()] == ["/a", "/b"]
    for bad in (0, -1, True, "3"):
        with pytest.raises(ValueError):
            lib.recent(df, bad)
    assert got(lib.all_tracks(df).select("path", "format.sample_rate")) == [("/a", None), ("/b", 96000), ("/c", None)]
    assert got(lib.last_by_norm(df, "mtime")) == [("n", "/b")]


def test_rates_and_tags(spark, got):
    df = spark.createDataFrame([('{"tags": {"SAMPLERATE": "96000"}}',), ('{"tags": {"sample_rate": "44100"}}',), ('{"tags": {"SAMPLERATE": "46050"}}',), ("x",), (None,), ('{"tags": {"SAMPLERATE": "88200"}}',)], "format_json string")
    assert got(lib.odd_rates(df)) == [(46050,), (88200,), (96000,)]
    assert got(lib.nearest_rate(lib.odd_rates(df))) == [(46050, 44100), (88200, 48000), (96000, 48000)]
    tags = spark.createDataFrame([({"ARTIST": "B", "artist": "A", "TRCK": "1/12", "TDRC": "1999-05-01"},), ({"TRCK": "x", "date": "ab"},)], "m map<string,string>")
    assert got(tags.select(lib.merged_tags(F.col("m")).alias("t")).select("t.*")) == [("A", None, None, 1, 1999), (None, None, None, None, None)]


def test_playlists(spark, tmp_path, music, got):
    text = tmp_path / "a.M3U8"
    text.write_bytes("﻿#EXTM3U\r\nAnn - Sky\r\n\r\n  #kept\n#gone\n  x  \n".encode())
    assert [r["track"] for r in playlists.read_playlist(spark, str(text)).orderBy("pos").collect()] == ["﻿#EXTM3U", "Ann - Sky", "#kept", "x"]
    for n, body in enumerate(('[{"tracks": [{"artist": " Ann ", "title": "Sky", "album": null}, "plain", {"x": 1}]}, {"tracks": ["no"]}]', '{"tracks": [{"artist": "Ann", "title": "Sky"}, "plain", {"x": 1}]}', '[{"artist": "Ann", "title": "Sky"}, "plain", {"x": 1}]')):
        p = tmp_path / f"{n}.json"
        p.write_text(body)
        assert [r["track"] for r in playlists.read_playlist(spark, str(p)).orderBy("pos").collect()] == ["Ann Sky", "plain", '{"x":1}']
        assert playlists.read_structs(spark, str(p)).count() == 3
    for body in ("3", "not json", '{"a": 1}', "[]"):
        (tmp_path / "odd.json").write_text(body)
        assert playlists.read_playlist(spark, str(tmp_path / "odd.json")).count() == 0
    with pytest.raises(ValueError):
        (tmp_path / "odd.json").write_text('{"a": 1}')
        playlists.read_structs(spark, str(tmp_path / "odd.json"))
    assert playlists.read_playlist(spark, str(tmp_path / "none.m3u")) is None and playlists.read_playlist(spark, str(music / "note.doc")) is None
    assert playlists.read_playlist(spark, str(music)).count() == 5


def test_sinks(spark, tmp_path):
    import json

    df = spark.createDataFrame([(0, "Ä \"q\"", "/m/ä.flac", 100, "matched"), (1, "none", None, 3, "unmatched"), (2, "b", "/m/b.flac", 90, "matched")], "pos long, track string, path string, score long, status string")
    out = tmp_path / "deep" / "o"
    assert sinks.write_m3u(df, f"{out}.m3u") == 2 and (tmp_path / "deep/o.m3u").read_text() == "#EXTM3U\n/m/ä.flac\n/m/b.flac\n"
    sinks.write_m3u(df, f"{out}2.m3u", annotated=True)
    assert (tmp_path / "deep/o2.m3u").read_text() == f"#EXTM3U\n\n# Track 1: Ä \"q\"\n# {'=' * 60}\n/m/ä.flac\n\n# Track 2: b\n# {'=' * 60}\n/m/b.flac\n"
    sinks.write_json(df, f"{out}.json")
    assert json.loads((tmp_path / "deep/o.json").read_text()) == {'Ä "q"': "/m/ä.flac", "none": None, "b": "/m/b.flac"}
    sinks.write_json(df.limit(0), f"{out}0.json")
    assert json.loads((tmp_path / "deep/o0.json").read_text()) == {}
    rest = spark.createDataFrame([(1, "Ann", "Sky")], "pos long, artist string, track string")
    sinks.write_songshift(rest, f"{out}.s.json")
    assert json.loads((tmp_path / "deep/o.s.json").read_text()) == [{"service": "qobuz", "serviceId": None, "name": "Unmatched Tracks", "tracks": [{"artist": "Ann", "track": "Sky"}]}]
    q = spark.createDataFrame([(0, "a", None, "t", 3), (1, None, None, None, None), (2, "b", None, "u", None)], "pos long, artist string, album string, title string, duration int")
    sinks.write_report(df.drop("track"), q, f"{out}.r.json")
    report = json.loads((tmp_path / "deep/o.r.json").read_text())
    assert (report["matched"], report["review"], report["unmatched"]) == (2, 0, 1) and report["matches"][1]["match"] is None


def test_stream(spark, tmp_path):
    store = lib.Snapshots(spark, str(tmp_path / "lib"))
    scans = str(tmp_path / "scans")
    spark.createDataFrame([("/m/a.flac", 1, 1), ("/m/a.flac", 2, 1), ("/m/b.flac", 1, 1)], watch.SCAN).write.parquet(scans)
    watch.follow(spark, scans, store, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["mtime"] for r in store.read().collect()) == [1, 2]
    spark.createDataFrame([("/m/b.flac", 5, 1), ("/m/c.flac", 1, 1)], watch.SCAN).write.mode("append").parquet(scans)
    watch.follow(spark, scans, store, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["norm"], r["mtime"]) for r in store.read().collect()) == [("a", 2), ("b", 5), ("c", 1)]


def test_config(tmp_path):
    f = tmp_path / "c.json"
    f.write_text('{"THRESHOLD_AUTO_MATCH": 91, "LIBRARY_ROOTS": ["/a"], "THRESHOLD_REVIEW_MIN": "bad"}')
    c = config.load(f, {"TRACKLOOM_LIBRARY_ROOTS": "/x, /y", "TRACKLOOM_WORD_OVERLAP_REJECT": "0.3"})
    assert (c.threshold_auto_match, c.library_roots, c.threshold_review_min, c.word_overlap_reject) == (91, ("/x", "/y"), 70, 0.3)
    with pytest.warns(UserWarning):
        config.Config(threshold_auto_match=60)
    assert config.output_path("{playlist_name}.m3u", "/p/mine.json") == "mine.m3u" and config.output_path("t", "p", "e") == "e"
    with pytest.raises(ValueError):
        config.guarded("../x")


def test_cli(spark, tmp_path, music, capsys):
    from trackloom.cli import main

    base = ["--library", str(tmp_path / "lib"), "--root", str(music)]
    assert main([*base, "get", "library"], spark) == 0 and capsys.readouterr().out == "5\n"
    p = tmp_path / "p.txt"
    p.write_text("one\nnothing here\n")
    assert main([*base, "get", "playlist", str(p)], spark) == 0
    assert main([*base, "match", "auto", str(p)], spark) == 0 and "matched=1 unmatched=1" in capsys.readouterr().out
    assert main([*base, "match", "auto", str(p), "--backend", "simple"], spark) == 0
    for kind in ("m3u", "json", "songshift"):
        assert main([*base, "out", kind, str(p), "--output", str(tmp_path / kind)], spark) == 0 and (tmp_path / kind).exists()
    assert main([*base, "list", "recent", "--n", "2"], spark) == 0
    j = tmp_path / "p.json"
    j.write_text('[{"title": "one"}]')
    assert main([*base, "match", "ratio", str(j), "--output", str(tmp_path / "r.json")], spark) == 0
    assert main([*base, "match", "auto", "/no/such"], spark) == 1
    assert main(["config", "show"]) == 0
    assert main([*base, "match", "review", str(p), "--output", str(tmp_path / "rev.m3u")], spark) == 0
    told = capsys.readouterr().out
    assert "auto\tone" in told and "unmatched\tnothing here" in told and "auto=1 review=0 unmatched=1" in told
    c = str(tmp_path / "conf" / "c.json")
    assert main(["config", "init"]) == 1 and main(["--config", c, "config", "init"]) == 0 and main(["--config", c, "config", "set", "threshold_auto_match=91"]) == 0
    assert config.load(c, {}).threshold_auto_match == 91


def test_ratio_of_scanned_library(spark, tmp_path, capsys):
    """The second engine knows artist and album of scanned files from their folders."""
    from trackloom.cli import main

    folder = tmp_path / "music" / "Ann Lee" / "Blue"
    folder.mkdir(parents=True)
    for name in ("01 - Red Sky.flac", "02 - Green Sea.flac"):
        (folder / name).write_bytes(b"x")
    base = ["--library", str(tmp_path / "lib"), "--root", str(tmp_path / "music")]
    assert main([*base, "get", "library"], spark) == 0
    j = tmp_path / "p.json"
    j.write_text('[{"artist": "Ann Lee", "title": "Red Sky", "album": "Blue"}, {"artist": "Bob", "title": "Qxz"}]')
    assert main([*base, "match", "ratio", str(j), "--output", str(tmp_path / "r.m3u")], spark) == 0
    assert (tmp_path / "r.m3u").read_text().splitlines()[1:] == [str(folder / "01 - Red Sky.flac")]


def test_snapshots_keep_one_writer(spark, tmp_path):
    store = lib.Snapshots(spark, str(tmp_path / "lib"))
    rows = spark.createDataFrame([("/m/a.flac", 1)], "path string, mtime long")
    assert store.refresh(rows, "/m").count() == 1 and store.refresh(rows.limit(0), "/m").count() == 0
    (tmp_path / "lib" / "LOCK").write_text("")
    with pytest.raises(RuntimeError):
        store.refresh(rows, "/m")


def test_run_and_tables(spark, tmp_path, music, data):
    from trackloom.plans.run import run_matcher

    p = tmp_path / "list.txt"
    p.write_text("one\n")
    store = lib.Snapshots(spark, str(tmp_path / "lib"))
    conf = config.Config(match_output_path_m3u=str(tmp_path / "{playlist_name}.m3u"), match_output_path_json=str(tmp_path / "{playlist_name}.json"))
    assert run_matcher(spark, str(p), store, "both", (str(music),), conf=conf).count() == 1
    assert (tmp_path / "list.m3u").exists() and (tmp_path / "list.json").exists()
    assert run_matcher(spark, "/none", store) is None
    with pytest.raises(ValueError):
        run_matcher(spark, str(p), store, "xml")
    assert lib.columns_of(spark, data, "flac_tags") == ["tag_id", "path", "tag_key", "tag_value"]
    with pytest.raises(ValueError):
        lib.columns_of(spark, data, "orders; drop")
    old = spark.createDataFrame([("a", 1), ("b", 1)], "path string, mtime long")
    new = spark.createDataFrame([("b", 1), ("c", 3)], "path string, mtime long")
    assert sorted(map(tuple, lib.rescanned(old, new).collect())) == [("a", 1), ("b", 1), ("c", 3)]
