"""Data-dictionary views as DataFrames, and the catalog that is assembled from them.

A `Views` maps the names of the dictionary views to DataFrames with lower-case columns, from JDBC, parquet or anywhere.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colscope.errors import CatalogError, ConnectionFailed
from colscope.functions.types import canonical_type

Views = Mapping[str, DataFrame]

#: The columns read of each dictionary view.
VIEW_COLUMNS = {
    "all_tables": "owner table_name num_rows",
    "all_tab_cols": "owner table_name column_name data_type nullable data_length data_precision data_scale data_default identity_column virtual_column char_length column_id",
    "all_constraints": "owner constraint_name table_name constraint_type r_owner r_constraint_name status validated",
    "all_cons_columns": "owner constraint_name table_name column_name position",
    "all_ind_columns": "table_owner table_name index_name column_name column_position",
    "all_tab_statistics": "owner table_name stale_stats num_rows last_analyzed",
    "all_tab_comments": "owner table_name comments",
    "all_col_comments": "owner table_name column_name comments",
}


def jdbc_views(spark: SparkSession, options: dict[str, str], owner: str | None = None) -> tuple[dict[str, DataFrame], str]:
    """The views of one owner (the session's own by default), filtered in the database; and that owner."""
    reader = spark.read.format("jdbc").options(**options)
    try:
        name = normal_owner(owner) if owner else reader.option("query", "SELECT USER AS u FROM dual").load().first()[0]
        quoted, out = name.replace("'", "''"), {}
        for view, columns in VIEW_COLUMNS.items():
            key = columns.split()[0]
            # referenced keys may belong to other owners, so constraints are read whole
            where = "" if view in ("all_constraints", "all_cons_columns") else f" WHERE {key} = '{quoted}'"
            out[view] = lower_columns(reader.option("query", f"SELECT {', '.join(columns.split())} FROM {view}{where}").load())
    except Exception as e:  # the driver's errors have no common class
        raise ConnectionFailed(f"the catalog cannot be read: {e}") from e
    return out, name


def parquet_views(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """A snapshot of the views, one parquet table each."""
    return {view: lower_columns(spark.read.parquet(f"{folder}/{view}")) for view in VIEW_COLUMNS}


def snapshot(views: Views, folder: str) -> None:
    for name, df in views.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def normal_owner(owner: str) -> str:
    bare = owner.strip()
    return bare[1:-1] if len(bare) > 1 and bare[0] == bare[-1] == '"' else bare.upper()


def tables(views: Views, owner: str) -> DataFrame:
    return views["all_tables"].where(F.col("owner") == owner).select("table_name", F.col("num_rows").cast("long").alias("row_count_approx"))


def columns(views: Views, owner: str) -> DataFrame:
    """Attributes of each column; flags as booleans, a character length of 0 as null."""
    return views["all_tab_cols"].where(F.col("owner") == owner).select(
        "table_name", "column_name", F.col("column_id").cast("int").alias("column_id"), "data_type",
        F.coalesce(F.col("nullable") == "Y", F.lit(False)).alias("nullable"),
        F.col("data_length").cast("int").alias("data_length"), F.nullif(F.col("char_length").cast("int"), F.lit(0)).alias("char_length"),
        F.col("data_precision").cast("int").alias("data_precision"), F.col("data_scale").cast("int").alias("data_scale"),
        F.col("data_default").cast("string").alias("default_value"),
        F.coalesce(F.col("identity_column") == "YES", F.lit(False)).alias("is_identity"), F.coalesce(F.col("virtual_column") == "YES", F.lit(False)).alias("is_virtual"),
    )


def key_columns(views: Views, owner: str, kind: str) -> DataFrame:
    """Distinct (table, column) of primary (P) or unique (U) constraints, members of composite ones included."""
    constraints = views["all_constraints"].where((F.col("owner") == owner) & (F.col("constraint_type") == kind)).select("owner", "constraint_name")
    members = views["all_cons_columns"].select("owner", "constraint_name", "table_name", "column_name")
    return constraints.join(members, ["owner", "constraint_name"]).select("table_name", "column_name").distinct()


def foreign_keys(views: Views, owner: str) -> DataFrame:
    """(table, column, fk, referenced table and column, position), columns paired by position, across owners."""
    c, m = views["all_constraints"], views["all_cons_columns"]
    own = c.where((F.col("owner") == owner) & (F.col("constraint_type") == "R")).select("owner", "constraint_name", "r_owner", "r_constraint_name")
    mine = m.select("owner", "constraint_name", "table_name", "column_name", "position")
    target = c.select(F.col("owner").alias("r_owner"), F.col("constraint_name").alias("r_constraint_name"))
    theirs = m.select(F.col("owner").alias("r_owner"), F.col("constraint_name").alias("r_constraint_name"), F.col("table_name").alias("ref_table"), F.col("column_name").alias("ref_column"), "position")
    return own.join(mine, ["owner", "constraint_name"]).join(target, ["r_owner", "r_constraint_name"]).join(theirs, ["r_owner", "r_constraint_name", "position"]).select("table_name", "column_name", F.col("constraint_name").alias("fk_name"), "ref_table", "ref_column", F.col("position").cast("int").alias("position"))


def one_foreign_key(keys: DataFrame) -> DataFrame:
    """One foreign key a column: the last by name, where a column stands in several."""
    last = Window.partitionBy("table_name", "column_name").orderBy(F.desc("fk_name"), "ref_table", "ref_column")
    return keys.withColumn("r", F.row_number().over(last)).where(F.col("r") == 1).drop("r", "position")


def ordered_columns(df: DataFrame, by: list[str], column: str, position: str) -> DataFrame:
    """Per group the columns in the order of their positions."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(column).alias("c"))))
    return df.groupBy(*by).agg(F.transform(pairs, lambda x: x["c"]).alias("columns"))


def fk_columns(views: Views, owner: str) -> DataFrame:
    """Per (table, fk) its own columns by position, whether or not their target can be resolved."""
    constraints = views["all_constraints"].where((F.col("owner") == owner) & (F.col("constraint_type") == "R")).select("owner", "constraint_name")
    members = constraints.join(views["all_cons_columns"].select("owner", "constraint_name", "table_name", "column_name", "position"), ["owner", "constraint_name"])
    return ordered_columns(members.withColumnRenamed("constraint_name", "fk_name"), ["table_name", "fk_name"], "column_name", "position")


def index_columns(views: Views, owner: str) -> DataFrame:
    own = views["all_ind_columns"].where(F.col("table_owner") == owner)
    return ordered_columns(own, ["table_name", "index_name"], "column_name", "column_position")


def redundant_indexes(views: Views, owner: str) -> DataFrame:
    """(table, column, single, composite): composite indexes whose leading column has an index of its own.

    Of several single-column indexes on the column, the last by name is reported.
    """
    own = views["all_ind_columns"].where(F.col("table_owner") == owner)
    shape = own.groupBy("table_name", "index_name").agg(F.count("*").alias("n"), F.min_by("column_name", "column_position").alias("column_name"))
    single = shape.where("n = 1").groupBy("table_name", "column_name").agg(F.max("index_name").alias("single_index"))
    composite = shape.where("n > 1").select("table_name", "column_name", F.col("index_name").alias("composite_index"))
    return composite.join(single, ["table_name", "column_name"])


def statistics(views: Views, owner: str) -> DataFrame:
    return views["all_tab_statistics"].where(F.col("owner") == owner).select("table_name", F.coalesce(F.col("stale_stats") == "YES", F.lit(False)).alias("stale"), F.col("num_rows").cast("long").alias("num_rows"), F.date_format("last_analyzed", "yyyy-MM-dd'T'HH:mm:ss").alias("last_analyzed"))


def weak_constraints(views: Views, owner: str) -> DataFrame:
    """Constraints that are not both enabled and validated, missing states included."""
    sound = F.col("status").eqNullSafe("ENABLED") & F.col("validated").eqNullSafe("VALIDATED")
    return views["all_constraints"].where((F.col("owner") == owner) & ~sound).select("table_name", "constraint_name", "constraint_type", "status", "validated")


def table_comments(views: Views, owner: str) -> DataFrame:
    return views["all_tab_comments"].where((F.col("owner") == owner) & F.col("comments").isNotNull()).select("table_name", F.col("comments").alias("table_comment"))


def column_comments(views: Views, owner: str) -> DataFrame:
    return views["all_col_comments"].where((F.col("owner") == owner) & F.col("comments").isNotNull()).select("table_name", "column_name", "comments")


def catalog(views: Views, owner: str) -> DataFrame:
    """One row per column of the owner's tables, with keys, index, comments and `pos`, its place in the catalog.

    Columns of views drop out, since only tables are kept; what has no match is false or null.
    """
    missing = [v for v in VIEW_COLUMNS if v not in views]
    if missing:
        raise CatalogError(f"views are missing: {', '.join(missing)}")
    on = ["table_name", "column_name"]

    def flag(df: DataFrame, name: str) -> DataFrame:
        return df.select(*on).distinct().withColumn(name, F.lit(True))

    indexed = views["all_ind_columns"].where(F.col("table_owner") == owner)
    targets = one_foreign_key(foreign_keys(views, owner)).select(*on, F.col("ref_table").alias("fk_references_table"), F.col("ref_column").alias("fk_references_column"), "fk_name")
    out = tables(views, owner).join(columns(views, owner), "table_name")
    for part in (flag(key_columns(views, owner, "P"), "is_primary_key"), flag(key_columns(views, owner, "U"), "is_unique"), flag(indexed, "is_indexed"), targets, column_comments(views, owner)):
        out = out.join(part, on, "left")
    out = out.join(table_comments(views, owner), "table_name", "left")
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("is_primary_key", "is_unique", "is_indexed")}
    in_table = Window.partitionBy("table_name").orderBy("column_id", "column_name")
    widths = out.groupBy("table_name").agg(F.count("*").alias("_n"))
    before = Window.orderBy("table_name").rowsBetween(Window.unboundedPreceding, -1)
    # one row a table: the only ordering over the whole catalog is of its tables
    starts = widths.select("table_name", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return out.withColumns({**flags, "is_foreign_key": F.col("fk_name").isNotNull(), "_r": F.row_number().over(in_table)}).join(starts, "table_name").withColumn("pos", (F.col("_start") + F.col("_r") - 1).cast("int")).drop("_start", "_r")


def catalog_json(catalog_rows: DataFrame) -> DataFrame:
    """Per table its nested JSON; only tables and their columns are in it."""
    hidden = ("table_name", "row_count_approx", "table_comment", "pos")
    fields = F.struct("pos", *[c for c in catalog_rows.columns if c not in hidden])
    nested = catalog_rows.groupBy("table_name", "row_count_approx", "table_comment").agg(F.array_sort(F.collect_list(fields)).alias("columns"))
    return nested.select("table_name", F.to_json(F.struct("table_name", "table_comment", "row_count_approx", "columns")).alias("json"))


def table_list(catalog_rows: DataFrame) -> DataFrame:
    """Tables with their numbers of columns, by first place in the catalog."""
    return catalog_rows.groupBy("table_name").agg(F.count("*").alias("n_columns"), F.min("pos").alias("first"))


def schema_catalog(spark: SparkSession, frames: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, column_id, data_type, nullable) of any DataFrames, from their schemas alone."""
    rows = [(t, f.name, i + 1, f.dataType.simpleString(), f.nullable) for t, df in frames.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, column_id int, data_type string, nullable boolean")


def schema_difference(expected: DataFrame, actual: DataFrame, on: list[str]) -> DataFrame:
    """Rows of either side that the other lacks: status `missing` (expected only) or `extra` (actual only)."""
    missing = expected.select(*on).subtract(actual.select(*on)).withColumn("status", F.lit("missing"))
    return missing.unionByName(actual.select(*on).subtract(expected.select(*on)).withColumn("status", F.lit("extra")))


def choose_primary_key(rows: DataFrame) -> DataFrame:
    """Per table the number column that looks like its key: ID, else the first that starts ID_ or ends _ID.

    ``rows`` needs table_name, column_name, data_type, pos.
    """
    name = F.col("column_name")
    rank = F.when(name == "ID", 0).when(name.startswith("ID_") | name.endswith("_ID"), 1)
    first = Window.partitionBy("table_name").orderBy("rank", "pos")
    fitting = rows.where(F.col("data_type").startswith("NUMBER")).withColumn("rank", rank).where(F.col("rank").isNotNull())
    return fitting.withColumn("r", F.row_number().over(first)).where(F.col("r") == 1).select("table_name", F.col("column_name").alias("pk_column"))


def infer_foreign_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Number columns `X_ID` to the first other table, in catalog order, named X, XS or X without its S, that has a key.

    The `or` of names is an equality of stems: every table answers to its name and to its name without a last S.
    """
    order = rows.groupBy("table_name").agg(F.min("pos").alias("first")).join(keys, "table_name")
    alias = order.select(F.col("table_name").alias("ref_table"), F.col("pk_column").alias("ref_column"), "first", F.explode(F.array_distinct(F.array(F.col("table_name"), F.regexp_replace("table_name", "S$", "")))).alias("stem"))
    asked = rows.where(F.col("data_type").startswith("NUMBER") & F.col("column_name").endswith("_ID")).withColumn("stem", F.expr("substring(column_name, 1, length(column_name) - 3)"))
    met = asked.join(alias, "stem").where(F.col("ref_table") != F.col("table_name"))
    best = Window.partitionBy("table_name", "column_name").orderBy("first", "ref_table")
    return met.withColumn("r", F.row_number().over(best)).where(F.col("r") == 1).select("table_name", "column_name", "ref_table", "ref_column")


def rollups(rows: DataFrame) -> DataFrame:
    """Counts per table, per canonical type and over all, in one pass: level, name, n and how many carry each constraint."""
    typed = rows.withColumn("type", canonical_type(F.col("data_type")))
    flags = {"primary_keys": "is_primary_key", "foreign_keys": "is_foreign_key", "uniques": "is_unique", "nullables": "nullable"}
    counted = typed.groupingSets([["table_name"], ["type"], []], "table_name", "type").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), *[F.count_if(F.col(c)).alias(n) for n, c in flags.items()])
    level = F.when(F.col("g") == 1, "table").when(F.col("g") == 2, "type").otherwise("all")
    return counted.select(level.alias("level"), F.coalesce("table_name", "type", F.lit("")).alias("name"), "n", *flags)
