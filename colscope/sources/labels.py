"""Hand labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colscope.errors import CatalogError
from colscope.functions.constants import SEVERITY

SCHEMA = "table string, column string, data_type string, label string"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True)
    if set(SCHEMA.replace(" string", "").split(", ")) - set(raw.columns):
        raise CatalogError(f"{path}: columns table, column, data_type, label are needed")
    return raw.withColumn("row", F.monotonically_increasing_id())


def check_labels(raw: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    """Rows that cannot be labels, each with what is wrong; ``raw`` needs row, table, column, label."""
    words = list(vocabulary or SEVERITY)
    label = F.lower(F.trim(F.coalesce("label", F.lit(""))))
    return raw.withColumn("fault", F.when(label == "", "blank label").when(~label.isin(words), "unknown label")).where(F.col("fault").isNotNull())


def clean_labels(raw: DataFrame) -> DataFrame:
    """(table_name, column_name, label) in capitals and small letters; of repeated keys the last row counts."""
    key = [F.upper(F.trim("table")).alias("table_name"), F.upper(F.trim("column")).alias("column_name")]
    rows = raw.select(*key, F.lower(F.trim("label")).alias("label"), "row")
    last = Window.partitionBy("table_name", "column_name").orderBy(F.desc("row"))
    return rows.withColumn("r", F.row_number().over(last)).where(F.col("r") == 1).select("table_name", "column_name", "label")


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    raw = read_labels(spark, path)
    if raw.isEmpty():
        raise CatalogError(f"{path} has no rows")
    if faults := check_labels(raw).orderBy("row").limit(3).collect():
        raise CatalogError(f"{path}: " + "; ".join(f"row {f['row'] + 2}: {f['fault']} {f['label']!r}" for f in faults))
    return clean_labels(raw)


def missing_labels(columns: DataFrame, labels: DataFrame) -> DataFrame:
    """Columns without a label, names compared without regard to case."""
    key = columns.select("table_name", "column_name", F.upper("table_name").alias("t"), F.upper("column_name").alias("c"))
    known = labels.select(F.col("table_name").alias("t"), F.col("column_name").alias("c"))
    return key.join(known, ["t", "c"], "left_anti").select("table_name", "column_name")


def align_labels(columns: DataFrame, labels: DataFrame) -> DataFrame:
    """Columns with their labels; any column without one is an error that names the first three."""
    if lacking := missing_labels(columns, labels).orderBy("table_name", "column_name").limit(3).collect():
        raise CatalogError("no label for " + ", ".join(f"{r[0]}.{r[1]}" for r in lacking))
    keyed = labels.select(F.col("table_name").alias("t"), F.col("column_name").alias("c"), "label")
    return columns.join(keyed, (F.upper("table_name") == F.col("t")) & (F.upper("column_name") == F.col("c"))).drop("t", "c")


def corpus_columns(labels: DataFrame) -> DataFrame:
    """The columns that a label file names, in file order, with their declared types."""
    return labels.select(F.upper(F.trim("table")).alias("table_name"), F.upper(F.trim("column")).alias("column_name"), "data_type", "label", F.col("row").alias("pos"))
