"""Library rows from a stream of scan files.

New scan files (Parquet rows of path, mtime, length) are taken as they come; each micro-batch is
upserted into the snapshots, the newest scan of a path winning. A stream never tells of deleted
files: ``Snapshots.refresh`` over a whole scan does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from trackloom.operators.library import Snapshots, changed, stub_rows, upsert, valid_rows

SCAN = "path string, mtime long, length long"


def newest(scan: DataFrame) -> DataFrame:
    """The latest row of each path."""
    return scan.groupBy("path").agg(F.max(F.struct("mtime", "length")).alias("r")).select("path", "r.mtime", "r.length")


def follow(spark: SparkSession, folder: str, library: Snapshots, checkpoint: str, norm_prefix: str = "") -> StreamingQuery:
    """Upsert every scan file that is in ``folder`` now and was not taken before, then end."""

    def take(batch: DataFrame, _: int) -> None:
        old = library.read()
        library.write(upsert(old, valid_rows(stub_rows(changed(newest(batch), old), norm_prefix))))

    scans = spark.readStream.schema(SCAN).parquet(folder)
    return scans.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(scans: DataFrame, minutes: int = 10, late: str = "1 hour") -> DataFrame:
    """Files and bytes scanned in each window of a stream with scanned_at, rows later than ``late`` left out."""
    return scans.withWatermark("scanned_at", late).groupBy(F.window("scanned_at", f"{minutes} minutes")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).select("window.start", "window.end", "files", "bytes")
