"""Row numbers without a window over everything: a range sort, then a count per partition."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage into the folder that the session names; one of its own only on one machine where none is named."""
    spark: SparkSession = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="colscope-"))
    return df.checkpoint(eager=True)


def number_rows(df: DataFrame, keys: list[str], out: str = "_i") -> DataFrame:
    """``df`` with a column ``out`` that numbers all rows from 0 in the order of ``keys``; rows of equal keys in any order.

    Rows are range-sorted; one count a partition passes through the driver. No key's rows are sorted in one task by force:
    partitions are cut by value, so keys should be nearly distinct.
    """
    marked = checkpoint(df.orderBy(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part, low = F.shiftright("_at", 33), F.lit((1 << 33) - 1)
    starts, total = [], 0
    for p, n in sorted((r["p"], r["n"]) for r in marked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
        starts.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, "_p long, _start long")
    return marked.join(F.broadcast(offsets), part == F.col("_p")).withColumn(out, F.col("_start") + F.col("_at").bitwiseAND(low)).drop("_at", "_p", "_start")
