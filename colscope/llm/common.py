"""What the corpus operators share: the shared checkpoint folder and word rules."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_BREAK = "[ \\t\\n\\x0B\\f\\r]+"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the session names in spark.checkpoint.dir; a folder of its own only on one machine without a name."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="colscope-"))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker, which Spark keeps for other tasks, gives its free memory back to the system."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return each


#: Rows and bytes of an Arrow batch of texts, where the session has Spark's defaults (10,000 rows, 64 MB).
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker and the JVM beside it hold of the texts at a time; a session's own settings stay."""
    for key, usual, ours in (("spark.sql.execution.arrow.maxRecordsPerBatch", ("10000",), BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ("67108864", "67108864b", "64MB"), BATCH_BYTES)):
        if spark.conf.get(key) in usual:
            spark.conf.set(key, str(ours))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there: lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def id_crc(col: Column) -> Column:
    """crc32 of an id written as text; null for a null id."""
    return F.crc32(col.cast("string"))


def ascii_words(text: Column) -> Column:
    """Words between ASCII white space, A-Z in lower case; null text gives no words."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, WORD_BREAK), "")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
