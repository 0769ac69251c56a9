"""The library table: looking up, searching, refreshing as a difference of snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trackloom import schemas
from trackloom.functions.paths import hidden, stem
from trackloom.functions.text import squash


def lookup(library: DataFrame) -> DataFrame:
    """(path, norm) without hidden companions."""
    return library.select("path", "norm").where(~hidden("path"))


def all_tracks(library: DataFrame) -> DataFrame:
    """The library with ``format``, its decoded format_json; unreadable JSON gives a struct of nulls."""
    return library.withColumn("format", F.coalesce(F.from_json("format_json", schemas.FORMAT), F.from_json(F.lit("{}"), schemas.FORMAT)))


def recent(library: DataFrame, n: int = 100) -> DataFrame:
    """The n rows changed last; ties by path, then by all of the row's other columns' order."""
    if isinstance(n, bool) or not isinstance(n, int) or n <= 0:
        raise ValueError("n is a positive integer")
    return library.orderBy(F.desc("mtime"), "path").limit(n)


def search(library: DataFrame, artist: str | None = None, album: str | None = None, title: str | None = None, limit: int = 100) -> DataFrame:
    """Rows whose fields hold the given texts, letter case aside; % and _ are wildcards; null fields do not match; by path."""
    for name, text in (("artist", artist), ("album", album), ("title", title)):
        if text:
            library = library.where(F.col(name).ilike(f"%{text}%"))
    return library.orderBy("path").limit(limit)


def last_by_norm(library: DataFrame, order: str) -> DataFrame:
    """(norm, path): of equal norms the row that came last by ``order``, then by path; map-side combined."""
    return library.where("norm is not null").groupBy("norm").agg(F.max_by("path", F.struct(order, "path")).alias("path"))


def under(path: Column | str, root: str) -> Column:
    """Whether a path lies in the folder ``root``, not beside it."""
    return F.startswith(F.col(path) if isinstance(path, str) else path, F.lit(root.rstrip("/") + "/"))


def changed(scan: DataFrame, old: DataFrame) -> DataFrame:
    """Rows of the scan (path, mtime, ...) that the library lacks or has with another mtime, older ones included."""
    had = old.select("path", F.struct("mtime").alias("_had"))
    differs = F.col("_had").isNull() | (F.col("mtime") != F.col("_had.mtime"))
    return scan.join(had, "path", "left").where(differs).drop("_had")


def vanished(old: DataFrame, scan: DataFrame, root: str) -> DataFrame:
    """Library rows under ``root`` whose file the scan did not meet."""
    return old.where(under("path", root)).join(scan.select("path"), "path", "left_anti")


def purge(old: DataFrame, scan: DataFrame, root: str) -> DataFrame:
    """Library without its vanished rows; rows of other roots stay."""
    here = F.coalesce(under("path", root), F.lit(False))
    return old.where(here).join(scan.select("path"), "path", "left_semi").unionByName(old.where(~here))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` in place of those with their path, the rest as it was."""
    return old.join(new.select("path"), "path", "left_anti").unionByName(new, allowMissingColumns=True)


def migrated(library: DataFrame) -> DataFrame:
    """The library in the text schema: missing track_number and format_json are added, the former filled from trackno."""
    have = set(library.columns)
    for name in ("track_number", "format_json"):
        if name not in have:
            library = library.withColumn(name, F.lit(None).cast("string"))
    if "trackno" in have:
        library = library.withColumn("track_number", F.coalesce("track_number", F.col("trackno").cast("string"))).drop("trackno")
    return library.withColumn("format_json", F.coalesce("format_json", F.lit("{}")))


def valid_rows(rows: DataFrame) -> DataFrame:
    """Rows fit for the library: path and norm there; empty artist, album and year null, empty title "", bad mtime 0."""
    some = lambda c: F.when(F.col(c).cast("string") != "", F.col(c).cast("string")).alias(c)
    number = F.col("mtime").try_cast("long")
    return rows.where((F.col("path") != "") & (F.col("norm") != "")).select(
        "path", "norm", F.greatest(F.coalesce(number, F.lit(0)), F.lit(0)).cast("long").alias("mtime"), some("artist"), some("album"),
        F.coalesce("title", F.lit("")).alias("title"), some("track_number"), some("year"), F.when(F.col("format_json") != "", F.col("format_json")).otherwise("{}").alias("format_json"),
    )


def stub_rows(scan: DataFrame, norm_prefix: str = "") -> DataFrame:
    """Library rows told by path and mtime alone: the title is the stem, the norm its squashed form after the prefix."""
    title = stem("path")
    flat = squash(title)
    norm = F.concat(F.lit(norm_prefix), F.when(flat != "", flat).otherwise(title))
    blank = [F.lit(None).cast("string").alias(c) for c in ("artist", "album")]
    more = [F.lit(None).cast("string").alias(c) for c in ("track_number", "year")]
    return scan.select("path", norm.alias("norm"), F.coalesce(F.col("mtime").cast("long"), F.lit(0)).alias("mtime"), *blank, title.alias("title"), *more, F.lit("{}").alias("format_json"))


def refreshed(old: DataFrame, scan: DataFrame, root: str, norm_prefix: str = "") -> DataFrame:
    """The library after a scan of ``root``: vanished rows gone, new and changed files upserted."""
    kept = purge(migrated(old), scan, root)
    return upsert(kept, valid_rows(stub_rows(changed(scan, kept), norm_prefix)))


def rescanned(old: DataFrame, rows: DataFrame) -> DataFrame:
    """The library after a whole rescan: every row upserted whether changed or not, nothing purged."""
    return upsert(old, rows.dropDuplicates(["path"]))


def columns_of(spark: SparkSession, folder: str, name: str) -> list[str]:
    """Column names of one of the known tables; another name is an error."""
    if name not in schemas.TABLES:
        raise ValueError(f"unknown table {name}")
    return spark.read.parquet(f"{folder}/{name}.parquet").columns


class Snapshots:
    """A library kept as versioned Parquet folders with a pointer, so that a refresh never overwrites what it reads.

    Works on any file system Spark knows. A refresh holds the file LOCK, made only where there is
    none; a second refresh meanwhile is an error, so that none is lost.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, str(folder).rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.folder}/{name}")

    @property
    def current(self) -> str | None:
        """Name of the version that the pointer, the newest file CURRENT-n-version, names."""
        found = self._pointers()
        return found[-1][1] if found else None

    def _pointers(self) -> list[tuple[int, str]]:
        """(n, version) of the pointer files CURRENT-n-version, oldest first."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(self._path(self.folder)))
        return sorted((int(n), v) for _, n, v in (x.split("-") for x in names if x.startswith("CURRENT-")))

    def read(self) -> DataFrame:
        if (at := self.current) is None:
            return self.spark.createDataFrame([], schemas.LIBRARY_TEXT)
        return self.spark.read.parquet(f"{self.folder}/{at}")

    def write(self, library: DataFrame) -> DataFrame:
        """Write a new version, then a new pointer; the version before stays for readers."""
        before = self._pointers()
        name = f"v{uuid.uuid4().hex}"
        library.write.parquet(f"{self.folder}/{name}")
        self._fs.create(self._at(f"CURRENT-{before[-1][0] + 1 if before else 0}-{name}"), False).close()
        for n, old in before[:-1]:
            self._fs.delete(self._at(old), True)
            self._fs.delete(self._at(f"CURRENT-{n}-{old}"), False)
        return self.read()

    def refresh(self, scan: DataFrame, root: str, norm_prefix: str = "") -> DataFrame:
        self._fs.mkdirs(self._path(self.folder))
        if not self._fs.createNewFile(self._at("LOCK")):
            raise RuntimeError(f"{self.folder} is being refreshed (remove LOCK if that ended early)")
        try:
            return self.write(refreshed(self.read(), scan, root, norm_prefix))
        finally:
            self._fs.delete(self._at("LOCK"), False)


def odd_rates(library: DataFrame, usual: int = 44100) -> DataFrame:
    """Distinct sample rates told by format_json's tags other than the usual one, ascending."""
    told = F.coalesce(*(F.nullif(F.get_json_object("format_json", p), F.lit("")) for p in ("$.tags.SAMPLERATE", "$.tags.sample_rate")))
    return library.select(told.try_cast("int").alias("rate")).where(F.col("rate") != usual).distinct().orderBy("rate")


def nearest_rate(rates: DataFrame, targets: tuple[int, ...] = (44100, 48000)) -> DataFrame:
    """(rate, target): nearest target of each rate; of two equally near the first named."""
    ranked = F.array(*(F.struct(F.abs(F.col("rate") - t).alias("far"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(targets)))
    return rates.select("rate", F.array_min(ranked)["t"].alias("target"))


def merged_tags(tags: Column) -> Column:
    """Struct of artist, album, title, trackno, year from a map of tag keys to values: the first key there wins."""
    # Keys by container, in order of preference.
    keys = {"artist": "artist ARTIST TPE1 ©ART", "album": "album ALBUM TALB ©alb", "title": "title TITLE TIT2 ©nam",
            "trackno": "tracknumber TRACKNUMBER TRCK trkn", "year": "date DATE year YEAR TDRC ©day"}
    first = {f: F.coalesce(*(F.try_element_at(tags, F.lit(k)) for k in ks.split())) for f, ks in keys.items()}
    return F.struct(
        first["artist"].alias("artist"), first["album"].alias("album"), first["title"].alias("title"),
        F.trim(F.split_part(first["trackno"], F.lit("/"), F.lit(1))).try_cast("int").alias("trackno"), F.left(first["year"], F.lit(4)).try_cast("int").alias("year"),
    )
