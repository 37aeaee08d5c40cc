"""The catalog's own jobs: feature blocks, label form, DDL, verification and comments."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.errors import CatalogError, SourceError
from colscope.functions.embedding import Embedder, LetterCounts, TransformerMean
from colscope.functions.text import document
from colscope.operators.rank import checkpoint
from colscope.plans.features import build_blocks
from colscope.sources import catalog, labels, sinks
from colscope.sources.config import jdbc_options, load_config

#: The encoder that needs no model.
LETTERS = "letters"


def add_source(p: argparse.ArgumentParser) -> None:
    """Where the dictionary views come from: a folder of parquet tables, or a database."""
    where = p.add_mutually_exclusive_group(required=True)
    where.add_argument("--views", metavar="FOLDER")
    where.add_argument("--config", metavar="FILE")
    p.add_argument("--owner")


def add_verbs(verbs) -> None:
    b = verbs.add_parser("build", help="feature blocks of a schema")
    add_source(b)
    b.add_argument("--out")
    b.add_argument("--model", default="paraphrase-multilingual-MiniLM-L12-v2", help=f"a sentence encoder, or {LETTERS} for counts of letters")
    b.add_argument("--text", choices=("documents", "anchors"), default="documents")
    b.add_argument("--mismatch", action="store_true")
    b.add_argument("--conflict-mode", choices=("hard", "soft"), default="hard")
    b.add_argument("--query-prefix", default="")
    b.add_argument("--no-table-comment", action="store_true")
    b.add_argument("--dry-run", action="store_true", help="show the first documents and stop, without an encoder")
    for name, text in (("labels", "a label form to fill in"), ("snapshot", "the views as parquet tables")):
        v = verbs.add_parser(name, help=text)
        add_source(v)
        v.add_argument("--out", required=True)
    d = verbs.add_parser("ddl", help="statements that create the tables of a label file")
    d.add_argument("--labels", required=True)
    d.add_argument("--out", required=True)
    v = verbs.add_parser("verify", help="compare a schema with a label file")
    add_source(v)
    v.add_argument("--labels", required=True)
    c = verbs.add_parser("comments", help="comment statements for tables that exist, from a CSV of table, column, comment")
    add_source(c)
    c.add_argument("--comments", required=True)
    c.add_argument("--apply", action="store_true", help="run them in the database of --config")


def views(spark: SparkSession, a: argparse.Namespace) -> tuple[dict[str, DataFrame], str]:
    if a.config:
        return catalog.jdbc_views(spark, jdbc_options(load_config(a.config)), a.owner)
    if not a.owner:
        raise CatalogError("a folder of views has no session, so --owner is needed")
    return catalog.parquet_views(spark, a.views), catalog.normal_owner(a.owner)


def make_encoder(model: str) -> Callable[[], Embedder]:
    return LetterCounts if model == LETTERS else lambda: TransformerMean(model)


def build(spark: SparkSession, a: argparse.Namespace) -> str:
    rows = checkpoint(catalog.catalog(*views(spark, a)))
    head = f"{rows.select('table_name').distinct().count()} tables, {rows.count()} columns"
    if a.dry_run:
        shown = sinks.first_documents(rows.withColumn("document", document(not a.no_table_comment, a.query_prefix)))
        return "\n".join([head, *[f"{r['table_name']}.{r['column_name']}\n    {r['document']}" for r in shown.collect()]])
    if not a.out:
        raise CatalogError("--out is needed")
    blocks = build_blocks(rows, make_encoder(a.model), text=a.text, mismatch=a.mismatch, mode=a.conflict_mode, prefix=a.query_prefix, include_table_comment=not a.no_table_comment)
    options = {"model": a.model, "text": a.text, "mismatch": str(a.mismatch), "conflict_mode": a.conflict_mode, "query_prefix": a.query_prefix, "table_comment": str(not a.no_table_comment)}
    sinks.write_blocks(blocks, a.out, options)
    return f"{head}, blocks in {a.out}"


def label_form(spark: SparkSession, a: argparse.Namespace) -> str:
    sinks.write_csv(sinks.label_form(catalog.catalog(*views(spark, a)).orderBy("pos")), a.out)
    return f"label form in {a.out}"


def snapshot(spark: SparkSession, a: argparse.Namespace) -> str:
    found, owner = views(spark, a)
    catalog.snapshot(found, a.out)
    return f"views of {owner} in {a.out}"


def ddl(spark: SparkSession, a: argparse.Namespace) -> str:
    columns = checkpoint(labels.corpus_columns(labels.read_labels(spark, a.labels)).withColumn("nullable", F.lit(True)))
    keys = checkpoint(catalog.choose_primary_key(columns))
    links = checkpoint(catalog.infer_foreign_keys(columns, keys))
    sinks.write_ddl(columns, keys, links, a.out)
    return f"{columns.select('table_name').distinct().count()} tables, {columns.count()} columns, {keys.count()} primary keys, {links.count()} foreign keys in {a.out}"


def verify(spark: SparkSession, a: argparse.Namespace) -> tuple[str, bool]:
    """What either side lacks, counts of both, and whether they agree."""
    wanted = labels.corpus_columns(labels.read_labels(spark, a.labels)).select("table_name", "column_name").distinct()
    rows = checkpoint(catalog.catalog(*views(spark, a)))
    lines = []
    for what, on in (("tables", ["table_name"]), ("columns", ["table_name", "column_name"])):
        off = catalog.schema_difference(wanted, rows, on).orderBy("status", *on).collect()
        for status in ("missing", "extra"):
            if names := [".".join(r[c] for c in on) for r in off if r["status"] == status]:
                lines.append(f"{status} {what}: {', '.join(names)}")
    same = not lines
    counts = rows.agg(F.countDistinct("table_name").alias("t"), F.count("*").alias("c"), F.count_if("is_primary_key").alias("p"), F.count_if("is_foreign_key").alias("f")).first()
    lines.append(f"{counts['t']} tables, {counts['c']} columns, {counts['p']} primary key columns, {counts['f']} foreign key columns")
    lines.append("the schema is that of the label file" if same else "the schema is not that of the label file")
    return "\n".join(lines), same


def run_statements(spark: SparkSession, statements: list[str], options: dict[str, str]) -> None:
    """Run statements of a database one after another, in one transaction, on the driver: one per commented object."""
    jvm = spark.sparkContext._jvm
    try:
        jvm.java.lang.Class.forName(options["driver"])
        connection = jvm.java.sql.DriverManager.getConnection(options["url"], options["user"], options["password"])
        try:
            connection.setAutoCommit(False)
            statement = connection.createStatement()
            for s in statements:
                statement.execute(s)
            connection.commit()
        finally:
            connection.rollback()
            connection.close()
    except Exception as e:  # the driver's errors have no common class
        raise SourceError(f"a statement failed: {e}") from e


def comments(spark: SparkSession, a: argparse.Namespace) -> str:
    if a.apply and not a.config:
        raise CatalogError("--apply needs the database of --config")
    found, owner = views(spark, a)
    wanted = spark.read.csv(a.comments, header=True).select(F.col("table").alias("table_name"), F.col("column").alias("column_name"), "comment")
    existing = catalog.tables(found, owner)
    skipped = sorted(r[0] for r in wanted.select("table_name").distinct().join(existing, "table_name", "left_anti").collect())
    made = [r["statement"] for r in sinks.comment_statements(wanted, existing).orderBy("table_name", F.col("column_name").asc_nulls_first()).collect()]
    if a.apply:
        run_statements(spark, made, jdbc_options(load_config(a.config)))
    return "\n".join([*[f"skipped: no table {t}" for t in skipped], *([f"{len(made)} comments applied"] if a.apply else [f"{s};" for s in made])])


VERBS = {"build": build, "labels": label_form, "snapshot": snapshot, "ddl": ddl, "verify": verify, "comments": comments}
