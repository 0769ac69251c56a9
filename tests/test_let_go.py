import time

from pyspark.sql import functions as F

from trackloom.session import cut


def test_later_cuts_leave_no_shuffle_files(spark):
    """What was shuffled for a table that is cut is off the disk a few cuts later, without waiting for the driver's garbage collection."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = files()
    out = cut(spark.range(5000).groupBy((F.col("id") % 977).alias("k")).agg(F.count("*").alias("n")))
    made = files() - before
    for _ in range(5):
        cut(spark.range(10))
        time.sleep(1)  # what Python lets go of reaches the JVM a little later
    assert made and not files() & made
    assert out.count() == 977
