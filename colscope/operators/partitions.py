"""Partitions of rows: contingency, agreement, naming, composition.

Every function takes optional ``by`` columns and then works on each of their groups at once, so that a grid of
configurations or resamples is one query. -1 is noise: an ordinary cluster for scores and names, none for cluster info.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ALL = "_all"
#: Terms of a sum that one row lists.
CHUNK = 65_536


def _grouped(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, by) if by else (df.withColumn(_ALL, F.lit(0)), [_ALL])


def contingency(df: DataFrame, truth: str, cluster: str, by: list[str] | None = None) -> DataFrame:
    """Counts of (truth, cluster) with both marginals and the total, as n, a, b, total."""
    df, keys = _grouped(df, by or [])
    cells = df.groupBy(*keys, F.col(truth).alias("truth"), F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))
    a = cells.groupBy(*keys, "truth").agg(F.sum("n").alias("a"))
    b = cells.groupBy(*keys, "cluster").agg(F.sum("n").alias("b"))
    total = cells.groupBy(*keys).agg(F.sum("n").alias("total"))
    return cells.join(a, [*keys, "truth"]).join(b, [*keys, "cluster"]).join(total, keys)


def _two(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1) / 2


def log_factorial(n: Column) -> Column:
    """ln n!: exact below 24, Stirling's series above."""
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(24)])
    x = F.greatest(n.cast("double"), F.lit(1.0))
    series = F.lit(0.5 * math.log(2 * math.pi)) + F.log(x) * (x + 0.5) - x + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5))
    return F.when(n < 24, F.get(small, n.cast("int"))).otherwise(series)


def expected_information(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Expected mutual information of partitions with the same marginals, by the hypergeometric sum over cell counts.

    Equal marginals are summed once and weighted, so the sum grows with the number of distinct group sizes. Counts farther
    than 20 sqrt(least marginal) from their mean have by Hoeffding's bound a probability under exp(-800), which is no
    double but zero, and are left out; the others are listed CHUNK at a time, so no row holds a long array.
    """
    a = cells.select(*keys, "truth", "a", "total").distinct().groupBy(*keys, "a", "total").agg(F.count("*").alias("na"))
    b = cells.select(*keys, "cluster", "b").distinct().groupBy(*keys, "b").agg(F.count("*").alias("nb"))
    mean, reach = F.col("a").cast("double") * F.col("b") / F.col("total"), F.lit(20.0) * F.sqrt(F.least("a", "b").cast("double"))
    low = F.greatest(F.lit(1).cast("long"), F.col("a") + F.col("b") - F.col("total"), F.floor(mean - reach).cast("long"))
    high = F.least(F.col("a"), F.col("b"), F.ceil(mean + reach).cast("long"))
    chunks = a.join(b, keys).withColumns({"low": low, "high": high}).where("low <= high").withColumn("from", F.explode(F.sequence(F.col("low"), F.col("high"), F.lit(CHUNK).cast("long"))))
    pairs = chunks.withColumn("k", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + (CHUNK - 1), F.col("high")))))
    n, x, y, k = (F.col(c) for c in ("total", "a", "b", "k"))
    weight = log_factorial(x) + log_factorial(y) + log_factorial(n - x) + log_factorial(n - y) - log_factorial(n) - log_factorial(k) - log_factorial(x - k) - log_factorial(y - k) - log_factorial(n - x - y + k)
    term = F.col("na") * F.col("nb") * k / n * F.log(n * k / (x.cast("double") * y)) * F.exp(weight)
    return pairs.groupBy(*keys).agg(F.sum(term).alias("emi"))


def agreement(df: DataFrame, truth: str, cluster: str, by: list[str] | None = None, kept: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """ari, nmi, ami and v_measure of a partition against a truth, with n_rows and n_groups.

    ``kept`` may write the contingency out: else the plan has it five times.
    """
    cells = kept(contingency(df, truth, cluster, by))
    keys = by or [_ALL]
    n, total = F.col("n").cast("double"), F.col("total").cast("double")
    joint = cells.groupBy(*keys).agg(F.sum(_two(F.col("n"))).alias("same"), F.sum(n / total * F.log(total * n / (F.col("a").cast("double") * F.col("b")))).alias("mi"), F.first("total").alias("n_rows"))

    def side(name: str, count: str) -> DataFrame:
        rows = cells.select(*keys, name, count, "total").distinct()
        p = F.col(count).cast("double") / F.col("total")
        return rows.groupBy(*keys).agg(F.sum(_two(F.col(count))).alias(f"pairs_{count}"), (-F.sum(p * F.log(p))).alias(f"h_{count}"), F.count("*").alias(f"k_{count}"))

    out = joint.join(side("truth", "a"), keys).join(side("cluster", "b"), keys).join(expected_information(cells, keys), keys, "left")
    pairs = _two(F.col("n_rows"))
    expected = F.col("pairs_a") * F.col("pairs_b") / F.when(pairs == 0, F.lit(1.0)).otherwise(pairs)
    most = (F.col("pairs_a") + F.col("pairs_b")) / 2
    mean = (F.col("h_a") + F.col("h_b")) / 2
    alone = (F.col("k_a") == 1) & (F.col("k_b") == 1)
    emi = F.coalesce("emi", F.lit(0.0))
    nmi = F.when(alone | (mean == 0), F.lit(1.0)).otherwise(F.col("mi") / mean)
    return out.select(
        *(by or []), F.col("n_rows"), F.col("k_b").alias("n_groups"),
        F.when(most == expected, F.lit(1.0)).otherwise((F.col("same") - expected) / (most - expected)).alias("ari"),
        nmi.alias("nmi"),
        F.when(alone, F.lit(1.0)).when(F.abs(mean - emi) < 1e-15, F.lit(0.0)).otherwise((F.col("mi") - emi) / (mean - emi)).alias("ami"),
        nmi.alias("v_measure"),
    )


def majority_labels(df: DataFrame, truth: str, cluster: str, pos: str, by: list[str] | None = None) -> DataFrame:
    """The commonest truth of each cluster, noise included; ties go to the one met first in ``pos``."""
    keys = [*(by or []), cluster]
    counts = df.groupBy(*keys, truth).agg(F.count("*").alias("_n"), F.min(pos).alias("_first"))
    best = Window.partitionBy(*keys).orderBy(F.desc("_n"), "_first")
    return counts.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*keys, F.col(truth).alias("predicted"))


def name_clusters(df: DataFrame, truth: str, cluster: str, pos: str, by: list[str] | None = None) -> DataFrame:
    """Rows with the name of their cluster as ``predicted``."""
    return df.join(majority_labels(df, truth, cluster, pos, by), [*(by or []), cluster])


def label_scores(named: DataFrame, truth: str, by: list[str] | None = None) -> DataFrame:
    """accuracy and f1_macro of ``predicted``; the macro mean is over the labels of either side, undefined F1 is 0."""
    named, keys = _grouped(named, by or [])
    cells = named.groupBy(*keys, F.col(truth).alias("t"), F.col("predicted").alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    sides = cells.select(*keys, F.col("t").alias("label"), "n", F.lit(0).cast("long").alias("m"), hit.alias("tp")).unionAll(cells.select(*keys, F.col("p").alias("label"), F.lit(0).cast("long"), F.col("n"), F.lit(0).cast("long")))
    each = sides.groupBy(*keys, "label").agg(F.sum("n").alias("support"), F.sum("m").alias("named"), F.sum("tp").alias("tp"))
    f1 = 2.0 * F.col("tp") / (F.col("support") + F.col("named"))
    out = each.groupBy(*keys).agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(f1).alias("f1_macro"))
    return out if by else out.drop(_ALL)


def score(df: DataFrame, truth: str, cluster: str, pos: str, table: str | None = None, by: list[str] | None = None, kept: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """One row per configuration: agreement, accuracy and F1 after naming, leakage to tables (NaN without tables)."""
    keyed, keys = _grouped(df, by or [])
    base = agreement(keyed, truth, cluster, keys, kept).join(label_scores(name_clusters(keyed, truth, cluster, pos, keys), truth, keys), keys)
    if table is None:
        return base.withColumn("table_ari", F.lit(float("nan"))).drop(_ALL)
    return base.join(agreement(keyed, table, cluster, keys, kept).select(*keys, F.col("ari").alias("table_ari")), keys).drop(_ALL)


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    """Rows per cluster and whether it is noise."""
    return df.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n")).withColumn("is_noise", F.col("cluster") == -1)


def centroids(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(cluster, dim, value): the mean vector of each cluster but noise."""
    parts = df.where(F.col(cluster) != -1).select(F.col(cluster).alias("cluster"), F.posexplode(vector).alias("dim", "x"))
    return parts.groupBy("cluster", "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def centroid_vectors(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("dim", "value")))
    return centroids(df, cluster, vector).groupBy("cluster").agg(F.transform(ordered, lambda x: x["value"]).alias("centroid"))


def members(df: DataFrame, cluster: str, wanted: int) -> DataFrame:
    return df.where(F.col(cluster) == wanted)


def composition(df: DataFrame, cluster: str, table: str, truth: str, pos: str, key: str, labels: int = 3, shown: int = 6) -> DataFrame:
    """Per cluster: n, distinct tables, its commonest labels with counts, its first members."""
    base = df.groupBy(cluster).agg(F.count("*").alias("n"), F.countDistinct(table).alias("n_tables"))
    counts = df.groupBy(cluster, truth).agg(F.count("*").alias("c"), F.min(pos).alias("first"))
    rank = Window.partitionBy(cluster).orderBy(F.desc("c"), "first")
    top = counts.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= labels).groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat(F.col(truth).cast("string"), F.lit(":"), F.col("c").cast("string")).alias("x")))), lambda x: x["x"]), ",").alias("top_labels"))
    early = Window.partitionBy(cluster).orderBy(pos)
    first = df.withColumn("r", F.row_number().over(early)).where(F.col("r") <= shown).groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(key).cast("string").alias("x")))), lambda x: x["x"]), ",").alias("members"))
    return base.join(top, cluster).join(first, cluster)


def dominant_labels(df: DataFrame, table: str, truth: str, pos: str, clean: str = "clean", share: float = 0.5, none: str = "sin_problema_de_tabla") -> DataFrame:
    """Per table its commonest label but ``clean``, if that covers ``share`` of all its rows; else ``none``."""
    total = df.groupBy(table).agg(F.count("*").alias("total"))
    counts = df.where(F.col(truth) != clean).groupBy(table, truth).agg(F.count("*").alias("c"), F.min(pos).alias("first"))
    rank = Window.partitionBy(table).orderBy(F.desc("c"), "first")
    best = counts.withColumn("r", F.row_number().over(rank)).where("r = 1").select(table, F.col(truth).alias("best"), "c")
    return total.join(best, table, "left").select(table, F.when(F.coalesce(F.col("c") / F.col("total") >= share, F.lit(False)), F.col("best").cast("string")).otherwise(F.lit(none)).alias("table_label"))


def first_seen(df: DataFrame, column: str, pos: str) -> DataFrame:
    """Distinct values in the order in which they appear."""
    return df.groupBy(column).agg(F.min(pos).alias("first"))
