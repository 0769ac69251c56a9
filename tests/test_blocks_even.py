import pandas as pd
from pyspark.sql import functions as F

from trackloom.operators import blocking


def test_a_part_holds_one_block_where_there_are_parts_enough(spark):
    """Blocks go to parts by their numbers, so that no task has several while others have none."""
    library = spark.range(100).select(F.col("id").cast("string").alias("norm"))
    queries = spark.range(3).select(F.col("id").cast("string").alias("q"))
    run = lambda a, size, known: pd.DataFrame({"q": a["q"], "size": size})
    out = blocking.scan_in_blocks(queries, library, len, run, "q string, size long", (5, 10)).withColumn("task", F.spark_partition_id())
    per = out.where("q = '0'").groupBy("task").agg(F.count("*").alias("blocks"), F.sum("size").alias("rows")).collect()
    assert sum(r["rows"] for r in per) == 100 and len(per) > 10 and all(r["blocks"] == 1 for r in per)
