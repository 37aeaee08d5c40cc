"""What is written: feature blocks, verdicts, label forms, DDL, comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.functions.text import escape_quotes, quote_identifier

BLOCKS = ("e_text", "e_type", "e_rest", "e_stat", "e_table", "e_conflict", "e_name", "name_intrinsic", "phi")


def write_blocks(blocks: DataFrame, path: str, options: dict[str, str]) -> None:
    """Blocks as parquet of double arrays beside a one-row table of how they were made."""
    wide = blocks.withColumns({c: F.col(c).cast("array<double>") for c in BLOCKS if c in blocks.columns})
    wide.write.mode("overwrite").parquet(f"{path}/blocks")
    spark: SparkSession = blocks.sparkSession
    spark.createDataFrame(sorted(options.items()), "name string, value string").write.mode("overwrite").parquet(f"{path}/meta")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """All blocks in double width; blocks that were not made are absent columns."""
    blocks = spark.read.parquet(f"{path}/blocks")
    return blocks.withColumns({c: F.col(c).cast("array<double>") for c in BLOCKS if c in blocks.columns})


def verdict_rows(named: DataFrame) -> DataFrame:
    """key, truth, cluster_id, predicted."""
    return named.select("key", "truth", F.col("cluster").alias("cluster_id"), "predicted")


def health_rows(verdicts: DataFrame) -> DataFrame:
    """key, predicted_label, confidence (empty where undefined, else four places), severity, low_support, recommendation."""
    return verdicts.select("key", "predicted_label", F.when(F.isnan("confidence"), None).otherwise(F.round("confidence", 4)).alias("confidence"), "severity", "low_support", "recommendation")


def label_form(columns: DataFrame) -> DataFrame:
    """A row per column with an empty label, to be filled in by hand."""
    return columns.select(F.col("table_name").alias("table"), F.col("column_name").alias("column"), "data_type", F.lit("").alias("label"))


def write_csv(df: DataFrame, path: str, parts: int | None = 1) -> None:
    """CSV with a header in a folder: one file, as catalogs are small; None leaves the files of a large table to Spark."""
    (df if parts is None else df.coalesce(parts)).write.mode("overwrite").csv(path, header=True, emptyValue="")


def create_table_statements(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """(table_name, statement): CREATE TABLE with columns in order and the primary key that was chosen."""
    line = F.concat(F.lit("  "), quote_identifier(F.col("column_name")), F.lit(" "), F.col("data_type"), F.when(~F.col("nullable"), " NOT NULL").otherwise(""))
    lines = columns.groupBy("table_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    key = F.when(F.col("pk_column").isNotNull(), F.array(F.concat(F.lit("  PRIMARY KEY ("), quote_identifier(F.col("pk_column")), F.lit(")")))).otherwise(F.array().cast("array<string>"))
    body = F.array_join(F.concat("lines", key), ",\n")
    return lines.join(keys, "table_name", "left").select("table_name", F.concat(F.lit("CREATE TABLE "), quote_identifier(F.col("table_name")), F.lit(" (\n"), body, F.lit("\n);")).alias("statement"))


def foreign_key_statements(links: DataFrame) -> DataFrame:
    q = quote_identifier
    return links.select("table_name", "column_name", F.concat(F.lit("ALTER TABLE "), q(F.col("table_name")), F.lit(" ADD FOREIGN KEY ("), q(F.col("column_name")), F.lit(") REFERENCES "), q(F.col("ref_table")), F.lit(" ("), q(F.col("ref_column")), F.lit(");")).alias("statement"))


def write_ddl(columns: DataFrame, keys: DataFrame, links: DataFrame, path: str) -> None:
    """All CREATE TABLE statements, then all foreign keys, as text."""
    first = create_table_statements(columns, keys).select(F.lit(0).alias("o"), F.col("table_name").alias("a"), F.lit("").alias("b"), F.col("statement").alias("value"))
    then = foreign_key_statements(links).select(F.lit(1).alias("o"), F.col("table_name").alias("a"), F.col("column_name").alias("b"), F.col("statement").alias("value"))
    first.unionAll(then).orderBy("o", "a", "b").select("value").coalesce(1).write.mode("overwrite").text(path)


def comment_statements(comments: DataFrame, existing: DataFrame) -> DataFrame:
    """COMMENT statements for tables that exist; ``comments`` has table_name, column_name (null: the table), comment."""
    target: Column = F.when(F.col("column_name").isNull(), F.concat(F.lit("TABLE "), quote_identifier(F.col("table_name")))).otherwise(F.concat(F.lit("COLUMN "), quote_identifier(F.col("table_name")), F.lit("."), quote_identifier(F.col("column_name"))))
    kept = comments.join(existing.select("table_name").distinct(), "table_name", "left_semi")
    return kept.select("table_name", "column_name", F.concat(F.lit("COMMENT ON "), target, F.lit(" IS '"), escape_quotes(F.col("comment")), F.lit("'")).alias("statement"))


def first_documents(documents: DataFrame, n: int = 5) -> DataFrame:
    """The first documents in catalog order, for a dry run."""
    return documents.orderBy("pos").limit(n)
