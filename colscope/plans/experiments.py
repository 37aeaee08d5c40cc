"""Evaluations: scored partitions, grids, blind choices, two levels, resamples and their intervals."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colscope.errors import CatalogError, ClusteringError
from colscope.functions.constants import CONFLICT_WEIGHTS, GRID, K_RANGE, MIN_CLUSTER_SIZE, MIN_SAMPLES, REDUCED, STRUCTURE_WEIGHTS
from colscope.functions.vectors import conflicting
from colscope.operators import clustering, kernels
from colscope.operators.features import fuse, require, sibling_signals, sweep_weights, table_naming
from colscope.operators.partitions import agreement, dominant_labels, score
from colscope.operators.rank import number_rows
from colscope.operators.reduction import Reducer

#: Bins of lots, in which the cut of a resample is looked for.
LOT_BINS = 4096

#: Two columns of every dataset here besides its blocks: key (long, catalog order) and table_name; label if it is scored.


def reduced(ds: DataFrame, weights: tuple[float, ...], k: int = REDUCED) -> DataFrame:
    """key and vector: the fused blocks, reduced."""
    return Reducer("pca", k).fit_transform(fuse(ds, weights).select("key", F.col("phi").alias("vector"))).select("key", F.col("reduced").alias("vector"))


def run_clustering(ds: DataFrame, weights: tuple[float, ...], method: str = "hdbscan", k: int = REDUCED, **options) -> DataFrame:
    options = options or {"min_cluster_size": MIN_CLUSTER_SIZE, "min_samples": MIN_SAMPLES}
    return kernels.cluster(reduced(ds, weights, k), method, **options)


def evaluate(name: str, ds: DataFrame, weights: tuple[float, ...], **options) -> DataFrame:
    """One scored row of a named configuration."""
    found = run_clustering(ds, weights, **options)
    return score(ds.join(found, "key"), "label", "cluster", "key", "table_name").withColumn("config", F.lit(name))


def stability_grid(points: DataFrame, grid: list[tuple[int, int]] | None = None) -> DataFrame:
    """(cell, min_cluster_size, min_samples, key, cluster, validity): a task for each min_samples, whose cells share a spanning tree.

    Before, every task has all rows and finds the nearest of some, which all trees begin with.
    """
    cells = list(enumerate(grid or GRID))
    points, each = clustering.checkpoint(points.select("key", "vector")), sorted({m for _, (_, m) in cells})
    slices = points.sparkSession.sparkContext.defaultParallelism
    dealt = points.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).groupBy("_slice")

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        first, x = int(pdf["_slice"].iloc[0]), kernels._matrix(pdf)
        del pdf
        x = x[kernels.distinct(x)[0]]
        mine = np.arange(first, len(x), slices)
        blocks = [mine[a : a + kernels.BLOCK] for a in range(0, len(mine), kernels.BLOCK)]
        found = [(at, *kernels.near_rows(x, at, kernels.near_depth(len(x), each[-1]))) for at in blocks]
        return pd.DataFrame([tuple(part.tobytes() for part in parts) for parts in found], columns=["at", "near", "far"])

    def run(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        samples, x, keys = int(pdf["min_samples"].iloc[0]), kernels._matrix(pdf), pdf["key"].to_numpy()
        del pdf
        at = np.concatenate([np.frombuffer(b, np.int64) for b in found["at"]])
        known = tuple(np.concatenate([np.frombuffer(b, t) for b in found[c]]).reshape(len(at), -1)[np.argsort(at)] for c, t in (("near", np.int32), ("far", np.float64)))
        edges = kernels.density_edges(x, samples, found=known) if len(x) > 1 else None
        parts = []
        for cell, (size, own) in cells:
            if own == samples:
                labels, validity = kernels.hdbscan(x, size, samples, edges=edges)
                parts.append(pd.DataFrame({"cell": cell, "min_cluster_size": size, "min_samples": samples, "key": keys, "cluster": labels.astype("int32"), "validity": validity}))
        return pd.concat(parts)

    found = dealt.applyInPandas(near, "at binary, near binary, far binary")
    spread = [df.withColumn("min_samples", F.explode(F.array(*[F.lit(m) for m in each]))).groupBy("min_samples") for df in (points, found)]
    return spread[0].cogroup(spread[1]).applyInPandas(run, "cell int, min_cluster_size int, min_samples int, key long, cluster int, validity double")


def grid_scores(ds: DataFrame, grid_rows: DataFrame) -> DataFrame:
    """Scores, validity and noise share of each cell."""
    by = ["cell", "min_cluster_size", "min_samples"]
    grid_rows = clustering.checkpoint(grid_rows)  # every score reads it
    own = grid_rows.groupBy(*by).agg(F.first("validity").alias("validity"), F.avg((F.col("cluster") == -1).cast("double")).alias("noise_share"))
    return score(grid_rows.join(ds.select("key", "label", "table_name"), "key"), "label", "cluster", "key", "table_name", by, clustering.checkpoint).join(own, by)


def choose_cell(cells: DataFrame) -> DataFrame:
    """The cell of the highest defined validity, the first of equals; no row if none is defined."""
    return cells.where(~F.isnan("validity")).orderBy(F.desc("validity"), "cell").limit(1)


def ward(points: DataFrame, k_range: tuple[int, int] = K_RANGE) -> DataFrame:
    """(key, cluster): Ward's tree cut at the k of the best silhouette; one task grows the tree, the silhouettes are dealt to all."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        cuts = kernels.ward_cuts(kernels._matrix(pdf), k_range) or [np.zeros(len(pdf), int)]
        return pdf[["key", "vector"]].assign(cuts=np.stack(cuts, axis=1).astype("int32").tolist())

    vector = points.schema["vector"].dataType.simpleString()
    found = clustering.checkpoint(points.select("key", "vector").withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(cut, f"key long, vector {vector}, cuts array<int>"))
    first = found.select(F.size("cuts").alias("n")).first()
    if first is None or first["n"] == 1:
        return found.select("key", F.col("cuts")[0].alias("cluster"))
    slices = points.sparkSession.sparkContext.defaultParallelism

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", ignore_index=True)
        x, cuts, mine = kernels._matrix(pdf), np.array(pdf["cuts"].tolist()), np.arange(int(pdf["_slice"].iloc[0]), len(pdf), slices)
        del pdf
        return pd.DataFrame({"sums": [kernels.silhouette_sums(kernels.Rows(x), cuts, mine).tolist()]})

    dealt = found.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).groupBy("_slice")
    sums = np.sum([r["sums"] for r in dealt.applyInPandas(judge, "sums array<double>").collect()], axis=0)  # a row of every slice
    n = found.count()
    return found.select("key", F.col("cuts")[kernels.best_cut([s / n for s in sums])].alias("cluster"))


def blind_partition(ds: DataFrame, weights: tuple[float, ...], algorithm: str = "ward") -> DataFrame:
    """(key, cluster) chosen without labels: ward by silhouette, hdbscan by validity with noise reassigned, or two-level."""
    if algorithm not in ("ward", "hdbscan", "two-level"):
        raise ClusteringError(f"unknown algorithm {algorithm}")
    if algorithm == "two-level":
        return two_level(ds, weights)
    points = clustering.checkpoint(reduced(ds, weights))
    if algorithm == "ward":
        return ward(points)
    grid = clustering.checkpoint(stability_grid(points))
    best = choose_cell(grid.select("cell", "validity").distinct()).select("cell")
    found = grid.join(F.broadcast(best), "cell").select("key", "cluster").join(points, "key")
    return clustering.reassign_noise(found).select("key", "cluster")


def table_groups(ds: DataFrame) -> DataFrame:
    """(table_name, grp): anomaly groups of tables by how they name their columns."""
    for block in ("e_name", "name_intrinsic", "e_conflict"):
        require(ds, block, "the two-level partition")
    signals = sibling_signals(ds, "key", "table_name", "column_name", "e_name").join(ds.select("key", F.col("name_intrinsic")[0].alias("emptiness"), F.col("name_intrinsic")[1].alias("divergence"), conflicting(F.col("e_conflict")).alias("conflicting")), "key")
    named = table_naming(signals, "table_name").join(ds.groupBy("table_name").agg(F.count("*").alias("n_columns"), F.min("key").alias("key")), "table_name")
    features = named.select("table_name", "key", "n_columns", F.array("emptiness", "divergence", "atypical", "clash", "heterogeneity", "conflict_rate").alias("features"))
    return clustering.flag_tables(features)


def two_level(ds: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Columns of normal tables by their cluster, those of anomalous tables by their table's group."""
    found = ward(reduced(ds, weights)).join(ds.select("key", "table_name"), "key")
    return clustering.combine_levels(found, table_groups(ds)).select("key", "cluster")


def two_level_scores(ds: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Scores of the two-level partition, and of the table groups against the tables' dominant labels."""
    groups = clustering.checkpoint(table_groups(ds))
    found = clustering.combine_levels(ward(reduced(ds, weights)).join(ds.select("key", "table_name"), "key"), groups)
    base = score(found.join(ds.select("key", "label"), "key"), "label", "cluster", "key", "table_name")
    tables = groups.join(dominant_labels(ds, "table_name", "label", "key"), "table_name")
    level = agreement(tables, "table_label", "grp").select(F.col("ari").alias("tables_ari"), F.col("ami").alias("tables_ami"))
    return base.join(level, F.lit(True)).withColumn("flagged", F.lit(groups.where("grp <> -1").count()))


def over_wordings(ds: DataFrame, weights: tuple[float, ...] = CONFLICT_WEIGHTS, algorithm: str = "ward") -> DataFrame:
    """Blind scores under each wording of the prototypes."""
    require(ds, "e_conflict_variants", "robustness")
    names = sorted(r[0] for r in ds.select(F.explode(F.map_keys("e_conflict_variants"))).distinct().collect())
    out = None
    for w in names:
        variant = ds.withColumn("e_conflict", F.col("e_conflict_variants")[w])
        row = score(ds.join(blind_partition(variant, weights, algorithm), "key"), "label", "cluster", "key", "table_name").withColumn("wording", F.lit(w))
        out = row if out is None else out.unionByName(row)
    return out


def summarise_wordings(rows: DataFrame, metric: str = "ari") -> DataFrame:
    return rows.agg(F.avg(metric).alias("mean"), F.min(metric).alias("low"), F.max(metric).alias("high"), F.min("n_groups").alias("least_groups"))


def late_fusion(views: DataFrame, threshold: float = 0.5, linkage: str = "average") -> DataFrame:
    """(key, cluster): the consensus of several partitions (view, key, cluster), clusters numbered by their least key.

    Rows of one signature, the clusters that the views give them, are as far from each other as their noise and no nearer to
    any other row: below the threshold they are one cluster at once, else each stays alone. Average linkage therefore runs
    over signatures and their numbers of rows; other linkages hold a square of distances over rows.
    """
    if linkage != "average":
        return _late_fusion_square(views, threshold, linkage)
    n = views.agg(F.countDistinct("view").alias("n")).first()["n"]
    part = F.when(F.col("cluster") != -1, F.concat(F.col("view").cast("string"), F.lit(":"), F.col("cluster").cast("string")))
    rows = clustering.checkpoint(views.groupBy("key").agg(F.array_sort(F.collect_list(part)).alias("parts")).withColumn("near", F.lit(1.0) - F.size("parts") / F.lit(max(n, 1)) < threshold))
    kinds = rows.where("near").groupBy("parts").agg(F.min("key").alias("key"), F.count("*").alias("n")).withColumn("_g", F.lit(0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        root = kernels.average_roots(pdf["parts"].tolist(), pdf["n"].to_numpy(np.int64), n, threshold)
        return pdf[["parts"]].assign(root=pdf["key"].to_numpy()[root])

    roots = kinds.groupBy("_g").applyInPandas(run, "parts array<string>, root long")
    found = clustering.checkpoint(rows.where("near").join(roots, "parts").select("key", "root").unionAll(rows.where("not near").select("key", F.col("key").alias("root"))))
    numbered = number_rows(found.select("root").distinct(), ["root"], "cluster")
    return found.join(numbered, "root").select(F.col("key").cast("long").alias("key"), F.col("cluster").cast("int").alias("cluster"))


def _late_fusion_square(views: DataFrame, threshold: float, linkage: str) -> DataFrame:
    agree = clustering.co_association(views)
    keys = views.select("key").distinct()
    lists = agree.select(F.col("a").alias("key"), F.struct("b", "share").alias("p")).groupBy("key").agg(F.collect_list("p").alias("pairs"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key").reset_index(drop=True)
        place = {k: i for i, k in enumerate(pdf["key"])}
        if len(pdf) > kernels.MOST_ROWS:
            raise ClusteringError(f"{len(pdf)} rows in a consensus")
        m = np.eye(len(pdf))
        for i, pairs in enumerate(pdf["pairs"]):
            for p in pairs if pairs is not None else ():
                m[i, place[p["b"]]] = m[place[p["b"]], i] = p["share"]
        return pdf[["key"]].assign(cluster=kernels.consensus(m, threshold, linkage).astype("int32"))

    return keys.join(lists, "key", "left").withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(run, "key long, cluster int")


def late_fusion_scores(ds: DataFrame, views: dict[str, tuple[float, ...]], threshold: float = 0.5, linkage: str = "average", **options) -> DataFrame:
    """One scored row: every view clustered by its weights, their consensus scored, without leakage to tables."""
    found = None
    for name, weights in views.items():
        part = run_clustering(ds, weights, **options).select(F.lit(name).alias("view"), "key", "cluster")
        found = part if found is None else found.unionAll(part)
    fused = late_fusion(clustering.checkpoint(found), threshold, linkage)
    return score(ds.join(fused, "key"), "label", "cluster", "key").withColumn("config", F.lit(f"late fusion of {', '.join(views)}"))


def alpha_sweep(ds: DataFrame, base: tuple[float, ...], alphas: tuple[float, ...] = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    out = None
    for a in alphas:
        row = evaluate(f"alpha={a:g}", ds, sweep_weights(a, base))
        out = row if out is None else out.unionByName(row)
    return out


def ablation(datasets: dict[str, DataFrame], weights: tuple[float, ...]) -> DataFrame:
    """Each dataset under the weights, and the structure-only floor of the first."""
    rows = [evaluate(name, ds, weights) for name, ds in datasets.items()]
    rows.append(evaluate("structure only", next(iter(datasets.values())), STRUCTURE_WEIGHTS))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def compare_algorithms(ds: DataFrame, points: DataFrame, methods: tuple[str, ...] = clustering.METHODS) -> DataFrame:
    """One row per algorithm on the same points, k the number of labels; a failure is a row with its message."""
    k = ds.select("label").distinct().count()
    rows = []
    for name in methods:
        try:
            found = clustering.fit_predict(points, name, k, **({"eps": "auto"} if name == "dbscan" else {}))
            row = score(ds.join(found, "key"), "label", "cluster", "key", "table_name").select("n_groups", "ari", "nmi", "ami").first()
            rows.append((name, row["n_groups"], row["ari"], row["nmi"], row["ami"], None))
        except Exception as e:  # a method that fails is part of the comparison
            rows.append((name, None, None, None, None, str(e)[:200]))
    return points.sparkSession.createDataFrame(rows, "algorithm string, n_groups long, ari double, nmi double, ami double, error string").orderBy(F.desc_nulls_last("ari"))


def resamples(ds: DataFrame, n: int, share: float = 0.8, seed: int = 0, key: str = "key") -> DataFrame:
    """(resample, key): draws without replacement of max(2, round(share * rows)) rows each, the same for every configuration.

    A row's rank within a resample is that of a linear congruence of (key, resample, seed), which SQL can repeat. The cut
    is found without sorting a resample: lots are counted in LOT_BINS bins, whole bins below the cut are taken as they are,
    and only the bin that holds it is ranked.
    """
    if not 0 < share <= 1:
        raise CatalogError("the share of a resample must be above 0 and at most 1")
    size = max(2, round(share * ds.count()))
    drawn = ds.select(key).join(ds.sparkSession.range(n).select(F.col("id").cast("int").alias("resample")), F.lit(True))
    drawn = drawn.withColumn("_lot", draw_lot(key, seed)).withColumn("_bin", F.expr(f"_lot div {2**31 // LOT_BINS}"))
    counts = drawn.groupBy("resample", "_bin").agg(F.count("*").alias("_n"))
    below = F.sum("_n").over(Window.partitionBy("resample").orderBy("_bin"))  # LOT_BINS rows a resample
    cuts = counts.withColumn("_upto", below).where((F.col("_upto") >= size) & (F.col("_upto") - F.col("_n") < size))
    cuts = F.broadcast(cuts.select("resample", F.col("_bin").alias("_cut"), (F.lit(size) - F.col("_upto") + F.col("_n")).alias("_left")))
    met = drawn.join(cuts, "resample").where(F.col("_bin") <= F.col("_cut"))
    rank = F.row_number().over(Window.partitionBy("resample").orderBy("_lot", key))
    last = met.where(F.col("_bin") == F.col("_cut")).withColumn("_r", rank).where(F.col("_r") <= F.col("_left"))
    return met.where(F.col("_bin") < F.col("_cut")).select("resample", key).unionAll(last.select("resample", key))


def draw_lot(key: str = "key", seed: int = 0):
    first = (F.col(key) * 48271 + (F.col("resample") + 1) * 69621 + seed * 16807) % 2147483647
    return (first * first + 12345) % 2147483647


def bootstrap(ds: DataFrame, partitions: dict[str, DataFrame], n: int = 200, share: float = 0.8, seed: int = 0) -> DataFrame:
    """(config, resample, ari, ami, table_ari) of frozen partitions re-scored on every resample."""
    drawn = resamples(ds, n, share, seed).join(ds.select("key", "label", "table_name"), "key")
    out = None
    for name, p in partitions.items():
        part = drawn.join(p, "key").withColumn("config", F.lit(name))
        out = part if out is None else out.unionByName(part)
    by = ["config", "resample"]
    out = clustering.checkpoint(out.select(*by, "label", "table_name", "cluster"))  # both agreements read it several times
    tables = agreement(out, "table_name", "cluster", by).select(*by, F.col("ari").alias("table_ari"))
    return agreement(out, "label", "cluster", by).select(*by, "ari", "ami").join(tables, by)


def bootstrap_pipeline(ds: DataFrame, scorers: dict[str, Callable[[pd.DataFrame], dict[str, float]]], n: int = 200, share: float = 0.8, seed: int = 0) -> DataFrame:
    """(config, resample, ari, ami, table_ari) with the whole pipeline run again on every resample, a task each."""
    return _scored(resamples(ds, n, share, seed).join(ds, "key").repartition(max(n, 1), "resample"), scorers)


def point_estimates(ds: DataFrame, scorers: dict[str, Callable[[pd.DataFrame], dict[str, float]]]) -> DataFrame:
    """(config, ari, ami, table_ari) of the pipeline on all rows."""
    return _scored(ds.withColumn("resample", F.lit(-1)), scorers).drop("resample")


def _scored(drawn: DataFrame, scorers: dict[str, Callable[[pd.DataFrame], dict[str, float]]]) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key").reset_index(drop=True)
        found = {name: s(pdf) for name, s in scorers.items()}
        return pd.DataFrame([{"config": name, "resample": int(pdf["resample"].iloc[0]), **{m: x.get(m, math.nan) for m in ("ari", "ami", "table_ari")}} for name, x in found.items()])

    return drawn.groupBy("resample").applyInPandas(run, "config string, resample int, ari double, ami double, table_ari double")


def intervals(rows: DataFrame, metric: str, level: float = 0.95) -> DataFrame:
    """Per configuration the two-sided percentile interval of a metric."""
    tail = (1 - level) / 2
    q = rows.groupBy("config").agg(F.avg(metric).alias("mean"), F.percentile(metric, F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    return q.select("config", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def paired_difference(rows: DataFrame, a: str, reference: str, metric: str, level: float = 0.95) -> DataFrame:
    """Differences on the same resamples: mean, interval, and the share of resamples that ``a`` wins."""
    x = rows.where(F.col("config") == a).select("resample", F.col(metric).alias("x"))
    y = rows.where(F.col("config") == reference).select("resample", F.col(metric).alias("y"))
    tail = (1 - level) / 2
    d = x.join(y, "resample").select((F.col("x") - F.col("y")).alias("d"))
    q = d.agg(F.avg("d").alias("mean"), F.percentile("d", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"), F.avg((F.col("d") > 0).cast("double")).alias("wins"))
    return q.select("mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "wins")


def compare_intervals(point: DataFrame, rows: DataFrame, metrics: tuple[str, ...] = ("ari", "ami")) -> DataFrame:
    """Per metric and configuration the estimate on all rows and the interval over the resamples."""
    out = None
    for m in metrics:
        row = point.select("config", F.lit(m).alias("metric"), F.col(m).alias("point"), "table_ari").join(intervals(rows, m), "config")
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("metric"), "config")


def compare_differences(rows: DataFrame, pairs: list[tuple[str, str]], metrics: tuple[str, ...] = ("ari", "ami")) -> DataFrame:
    """Paired differences of each pair (configuration, reference)."""
    out = None
    for a, reference in pairs:
        for m in metrics:
            row = paired_difference(rows, a, reference, m).select(F.lit(f"{a} - {reference}").alias("comparison"), F.lit(m).alias("metric"), "mean", "low", "high", "wins")
            out = row if out is None else out.unionAll(row)
    return out


def mean_over_wordings(rows: DataFrame) -> DataFrame:
    return rows.groupBy("config", "resample").agg(*[F.avg(m).alias(m) for m in ("ari", "ami", "table_ari")])


def precision_gap(ds: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """ARI of the pipeline at single and at double width."""
    out = None
    for kind in ("float", "double"):
        cast = ds.withColumns({c: F.col(c).cast(f"array<{kind}>").cast("array<double>") for c in ds.columns if c.startswith("e_") and ds.schema[c].dataType.simpleString().startswith("array<")})
        points = fuse(cast, weights).select("key", F.col("phi").cast(f"array<{kind}>").cast("array<double>").alias("vector"))
        row = agreement(ds.join(kernels.cluster(points, "hdbscan", min_samples=MIN_SAMPLES), "key"), "label", "cluster").select(F.lit(kind).alias("width"), "ari")
        out = row if out is None else out.unionAll(row)
    return out
