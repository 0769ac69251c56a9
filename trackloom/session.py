"""Session helpers: a local session for tests and lineage cutting that survives lost executors."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def local_session(cores: int | None = None, partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores or os.environ.get('BENCH_CPUS', '*')}]")
        .appName("trackloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is
    unset and the master is local (tests on one machine) a temporary folder takes its place.
    """
    spark = df.sparkSession
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="trackloom-"))
    out = df.checkpoint(eager=True)
    let_go(spark)  # of what earlier cuts left
    return out


def let_go(spark: SparkSession) -> None:
    """Have the shuffle and checkpoint files of plans that nothing refers to any more removed now, not when the driver happens to collect its garbage: until then the disk holds all that was ever shuffled."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, by_rows: bool = False) -> DataFrame:
    """``df`` over all cores if it comes in fewer partitions, as a table of few files does before costly work on each row.

    ``by_rows``: also after a shuffle, whose partitions adaptive execution joins by their bytes and not by their work.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if by_rows:
        return df.repartition(max(cores, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def numbered(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Add ``name``, the number (from 1) of each row in the order of ``by``, without one task that gets all: rows are sorted in ranges, and each range starts where those before it end."""
    ranges = cut(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range")
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n"))  # a row a range
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return ranges.join(starts, "_range").withColumn(name, F.row_number().over(within.orderBy(*by)) + F.col("_start")).drop("_range", "_start")


def in_parts(left: DataFrame, right: DataFrame, on: list[str], size: int) -> DataFrame:
    """Inner join on ``on`` in which a key of more than ``size`` rows on the right is split in parts, the left's rows going to each, so that no task gets a hot key whole."""
    parts = right.groupBy(*on).agg(F.count("*").alias("_rows")).where(F.col("_rows") > size).select(*on, F.ceil(F.col("_rows") / size).cast("int").alias("_parts"))
    cut_up = right.join(parts, on, "left").withColumn("_part", F.pmod(F.xxhash64(*right.columns), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copied = left.join(parts, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return copied.join(cut_up, [*on, "_part"]).drop("_part")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a session, so that their Python finds it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).parent
    at = Path(tempfile.mkdtemp(prefix="trackloom-")) / "trackloom.zip"  # read by the driver alone, which serves it
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(app)
