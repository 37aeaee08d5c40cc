"""The corpus pipeline: from raw documents to packed training sequences, one operator a stage.

Every stage works on all documents that the one before it kept; all but the last return the columns of documents. A
document is a row; rows that repeat both doc_id and text are one document from the third stage on.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colscope.llm.common import cut, ensure_checkpoint_dir, read, small_batches
from colscope.llm.decontaminate import contained_items
from colscope.llm.jaccard import jaccard_components
from colscope.llm.line_dedup import line_dedup
from colscope.llm.packing import pack
from colscope.llm.quality import score_quality, train_quality
from colscope.llm.queries import tokenizer_path

#: Keys of documents up to this number (some 40 bytes each) are broadcast.
BROADCAST_ROWS = 1_000_000


def _key() -> Column:
    """What names a document: id and text, ids before nulls."""
    return F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"))


def _shielded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that sees doc_id, text and one struct of all other columns, so that no name of theirs can clash."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        others = [c for c in docs.columns if c not in ("doc_id", "text")]
        row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("_"))
        out = stage(spark, docs.select("doc_id", "text", row.alias("_row")), sf_dir)
        return out.select(*[F.col("_row")[c].alias(c) if c in others else F.col(c) for c in docs.columns])

    return run


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents whose key is not in ``keys`` (one column k, no repeats).

    Keys are counted first: up to BROADCAST_ROWS go to every executor and the texts stay where they are; more are joined
    by shuffling both sides.
    """
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(keys) if few else keys, F.col("doc_id").eqNullSafe(F.col("k.id")) & (F.xxhash64("text") == F.col("k.th")), "left_anti")


@_shielded
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier, learned from the labels, does not reject."""
    model = train_quality(docs, read(spark, sf_dir, "labels"))
    return score_quality(docs, model).where(F.col("predicted") == 1).select(*docs.columns)


@_shielded
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove later occurrences of repeated windows of three lines; a document that loses every line goes."""
    out = line_dedup(docs).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    if "n_chars" in docs.schema["_row"].dataType.names:
        changed = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("_row.n_chars")).cast("long")
        out = out.withColumn("_row", F.col("_row").withField("n_chars", changed))
    return out.select(*docs.columns)


@_shielded
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of similarity 0.75 or more the one of lowest doc_id stays."""
    groups = cut(jaccard_components(docs.select(_key().alias("doc_id"), "text")))
    sizes = groups.groupBy(F.col("doc_id").alias("k")).agg(F.count("*").alias("n"), F.first(F.col("doc_id") == F.col("component_id")).alias("stays"))
    away = cut(sizes.where(~F.col("stays") | (F.col("n") > 1)))
    kept = _without(docs, away.select("k"))
    repeated = away.where("stays").select("k")
    if repeated.isEmpty():
        return kept
    rows = docs.withColumn("_th", F.xxhash64("text")).join(repeated, F.col("doc_id").eqNullSafe(F.col("k.id")) & (F.col("_th") == F.col("k.th")), "left_semi")
    one = rows.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "_th").orderBy(F.lit(0)))).where("_r = 1")
    return kept.unionByName(one.select(*docs.columns))


@_shielded
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold three quarters or more of a benchmark item's shingles."""
    found = contained_items(docs.select(_key().alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    return _without(docs, cut(found.select(F.col("doc_id").alias("k")).distinct()))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenize and pack what is left into sequences of 4096 tokens: a row per piece."""
    small_batches(spark)
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", lines),
    ("ngram_jaccard", near_copies),
    ("decontaminate", decontaminate),
    ("packing", packed),
]

#: Trained models and tokenization have no SQL form; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it lies; what reads it has been written elsewhere by then."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared checkpoint folder and read again.

    A stage's folder goes as soon as the next stage is written; that of the last stays, for the result is read from it.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
        if before is not None:
            _remove(spark, before)
        before = path
    return docs
