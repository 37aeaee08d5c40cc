"""Clustering in DataFrame operations: range joins, density clusters, nearest neighbours, consensus, anomaly flags.

Rows carry ``key`` (long, whose order breaks ties) and ``vector``. Distances are Euclidean.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colscope.errors import ClusteringError
from colscope.functions.constants import MIN_JUDGED
from colscope.functions.vectors import distance, norm
from colscope.operators.blocks import _apart, _blocks
from colscope.operators.features import zscore
from colscope.operators.kernels import cluster
from colscope.operators.partitions import centroid_vectors, cluster_sizes
from colscope.operators.rank import checkpoint, number_rows


#: Rows whose distances part others into bands.
PIVOTS = 2


def _distances(a: dict, b: dict) -> np.ndarray:
    """Euclidean distances, exact for equal keys and free of cancellation near zero."""
    s, t = (a["x"] * a["x"]).sum(axis=1), (b["x"] * b["x"]).sum(axis=1)
    d = np.sqrt(np.clip(s[:, None] + t[None, :] - 2 * a["x"] @ b["x"].T, 0, None))
    for i, j in np.argwhere(d < 1e-5 * np.sqrt(np.maximum(s[:, None] + t[None, :], 1e-300))):
        d[i, j] = np.sqrt(((a["x"][i] - b["x"][j]) ** 2).sum())
    d[a["key"][:, None] == b["key"][None, :]] = 0.0
    return d


def _moved(place: int, step: int) -> Column:
    """The bands with that at ``place`` moved by ``step``."""
    return F.transform("_band", lambda x, i: F.when(i == place, x + step).otherwise(x))


def close_pairs(df: DataFrame, eps: float, metric: str = "euclidean") -> DataFrame:
    """(a, b, d) of all ordered pairs within ``eps``, each row with itself too.

    Distances to a fixed point of two vectors within eps of each other differ by at most eps (triangle inequality). The
    fixed points are the origin and PIVOTS rows, so that vectors of equal length fall into bands too; blocks hold rows of
    one band and only meet blocks of bands beside it, by an equi-join; the distances of two blocks are one matrix product.
    """
    if metric == "cosine":
        n = norm(F.col("vector"))
        unit_rows = df.withColumn("vector", F.transform("vector", lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n)))
        pairs = close_pairs(unit_rows, (2 * max(eps, 0.0)) ** 0.5 * (1 + 1e-12) + 1e-12)
        return pairs.withColumn("d", F.col("d") * F.col("d") / 2).where(F.col("d") <= eps)
    if metric != "euclidean":
        raise ClusteringError(f"unknown metric {metric}")
    # a row meets bands beside its own by reaching into them; the margin keeps rounding from parting equal distances
    wide = F.lit(max(eps * (1 + 1e-9) + 1e-9, 1e-9))
    fixed = [r["vector"] for r in df.orderBy(F.xxhash64("key")).limit(PIVOTS).select(F.col("vector").cast("array<double>").alias("vector")).collect()]
    far = [norm(F.col("vector")), *[distance(F.transform("vector", lambda x: x.cast("double")), F.array(*[F.lit(x) for x in p])) for p in fixed]]
    packed = checkpoint(_blocks(df, [], [], F.array(*[F.floor(d / wide) for d in far])))
    left = packed
    for k in range(len(far)):
        left = left.withColumn("_band", F.explode(F.array(*[_moved(k, step) for step in (-1, 0, 1)])))

    def run(_: list, a: dict, b: dict) -> list[np.ndarray]:
        d = _distances(a, b)
        i, j = np.nonzero(d <= eps)
        return [a["key"][i], b["key"][j], d[i, j]]

    return _apart(left, packed, ["_band"], run, "a long, b long, d double", [], [])


def connected(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, root): the least key that each node reaches over pairs (a, b), by least-label steps and pointer jumps."""
    both = checkpoint(pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = checkpoint(nodes.select("key", F.col("key").alias("root")))
    while True:
        least = both.join(now.select(F.col("key").alias("b"), "root"), "b").groupBy(F.col("a").alias("key")).agg(F.min("root").alias("m"))
        step = now.join(least, "key", "left").select("key", "root", F.least("root", F.coalesce("m", "root")).alias("new"))
        jump = step.join(step.select(F.col("key").alias("k2"), F.col("new").alias("up")), F.col("new") == F.col("k2")).select("key", "root", F.least("new", "up").alias("new"))
        jump = checkpoint(jump)
        if jump.where("new <> root").isEmpty():
            return now
        now = jump.select("key", F.col("new").alias("root"))


def dbscan(df: DataFrame, eps: float, min_samples: int | None = None, metric: str = "euclidean") -> DataFrame:
    """(key, cluster): density clusters numbered by their first core row, -1 for noise.

    A row is core with ``min_samples`` rows within eps, itself included (default 5 % of the rows, 2 at least). A border row
    goes to the first cluster that reaches it.
    """
    if min_samples is None:
        min_samples = max(2, int(df.count() * 0.05))
    pairs = checkpoint(close_pairs(df, eps, metric))
    core = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples).select(F.col("a").alias("key"))
    core = checkpoint(core)
    among = pairs.join(core.withColumnRenamed("key", "a"), "a", "left_semi").join(core.withColumnRenamed("key", "b"), "b", "left_semi")
    roots = connected(among, core)
    heads = roots.select("root").distinct()
    numbered = heads.withColumn("cluster", (F.row_number().over(Window.orderBy("root")) - 1).cast("int"))  # one row a cluster
    placed = roots.join(numbered, "root").select("key", "cluster")
    border = pairs.join(placed.select(F.col("key").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("key")).agg(F.min("cluster").alias("near"))
    return df.select("key").join(placed, "key", "left").join(border, "key", "left").select("key", F.coalesce("cluster", "near", F.lit(-1)).cast("int").alias("cluster"))


def nearest(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """(q, key, d, r) of the k nearest points of each query, ties by key.

    Blocks of queries meet blocks of points; only the k best of a block go on to be ranked.
    """

    def run(_: list, a: dict, b: dict) -> list[np.ndarray]:
        d = np.round(_distances(a, b), 12)
        order = np.lexsort((np.broadcast_to(b["key"], d.shape), d), axis=1)[:, :k]
        rows = np.repeat(np.arange(len(d)), order.shape[1])
        return [a["key"][rows], b["key"][order.ravel()], d[rows, order.ravel()]]

    near = _apart(_blocks(queries, [], []), _blocks(points, [], []), [], run, "q long, key long, d double", [], [])
    rank = Window.partitionBy("q").orderBy("d", "key")
    return near.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k)


def reassign_noise(df: DataFrame, k: int = 3) -> DataFrame:
    """Noise rows take the commonest cluster of their k nearest clustered rows, the least of equals; others stay."""
    noise, rest = df.where("cluster = -1"), df.where("cluster <> -1")
    votes = nearest(noise, rest, k).join(rest.select("key", "cluster"), "key").groupBy("q", "cluster").agg(F.count("*").alias("n"))
    best = votes.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("n"), "cluster"))).where("r = 1").select(F.col("q").alias("key"), F.col("cluster").alias("voted"))
    return df.join(best, "key", "left").withColumn("cluster", F.coalesce("voted", "cluster")).drop("voted")


def co_association(views: DataFrame) -> DataFrame:
    """(a, b, share): in what share of the views two different rows have one cluster; noise agrees with none.

    ``views`` has view, key, cluster. Pairs that never agree are absent.
    """
    n = views.agg(F.countDistinct("view").alias("n"))
    kept = views.where("cluster <> -1")
    a, b = kept.select("view", "cluster", F.col("key").alias("a")), kept.select("view", "cluster", F.col("key").alias("b"))
    return a.join(b, ["view", "cluster"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("c")).crossJoin(F.broadcast(n)).select("a", "b", (F.col("c") / F.col("n")).alias("share"))


def silhouette(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean Euclidean silhouette of (key, vector, cluster); rows alone in their cluster count 0."""
    keys = by or []
    packed = checkpoint(_blocks(df.withColumn("cluster", F.col("cluster").cast("long")), ["cluster"], keys))
    kinds = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)

    def run(group: list, a: dict, b: dict) -> list:
        names, inverse = np.unique(b["cluster"], return_inverse=True)
        sums = _distances(a, b) @ np.eye(len(names))[inverse]
        n, m = sums.shape
        return [*[[g] * (n * m) for g in group], np.repeat(a["key"], m), np.repeat(a["cluster"], m), np.tile(names, n), sums.ravel(), np.tile(np.bincount(inverse, minlength=m), n)]

    parts = _apart(packed, packed, keys, run, f"{kinds}a long, ca long, cb long, s double, n long", keys, ["cluster"])
    sums = parts.groupBy(*keys, "a", "ca", "cb").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own = F.max(F.when(F.col("ca") == F.col("cb"), F.col("s") / F.greatest(F.col("n") - 1, F.lit(1))))
    size = F.max(F.when(F.col("ca") == F.col("cb"), F.col("n")))
    other = F.min(F.when(F.col("ca") != F.col("cb"), F.col("s") / F.col("n")))
    each = sums.groupBy(*keys, "a").agg(own.alias("own"), size.alias("size"), other.alias("other"))
    value = F.when((F.col("size") == 1) | (F.greatest("own", "other") == 0), F.lit(0.0)).otherwise((F.col("other") - F.col("own")) / F.greatest("own", "other"))
    return each.groupBy(*keys).agg(F.avg(value).alias("silhouette"))


def knee(curve: DataFrame, value: str = "d") -> DataFrame:
    """eps: the value of a sorted curve farthest from the line between its ends.

    The curve is one number a row. Fewer than four: the largest; a flat line: the middle; never under 1e-6.
    """
    total = curve.agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    # equal values differ in their lot, so that a range sort may part them
    ranked = number_rows(curve.select(F.col(value).alias("v"), F.monotonically_increasing_id().alias("_lot")), ["v", "_lot"], "i").crossJoin(F.broadcast(total))
    dx, dy = (F.col("n") - 1).cast("double"), F.col("high") - F.col("low")
    t = (F.col("i") * dx + (F.col("v") - F.col("low")) * dy) / (dx * dx + dy * dy)
    off = F.pow(F.col("i") - t * dx, 2) + F.pow(F.col("v") - F.col("low") - t * dy, 2)
    inner = (F.col("i") > 0) & (F.col("i") < F.col("n") - 1)
    far = F.max_by("v", F.when(inner, F.struct(F.round(off, 12).alias("o"), (-F.col("i")).alias("i"))))
    picked = ranked.agg(F.when(F.first("n") < 4, F.first("high")).when((F.first("high") == F.first("low")), F.first("high")).otherwise(far).alias("eps"))
    return picked.select(F.greatest("eps", F.lit(1e-6)).alias("eps"))


def k_distances(df: DataFrame, k: int = 5) -> DataFrame:
    """Distance of each row to its k-th neighbour, counting itself as the first of k + 1; fewer rows: the farthest."""
    n = df.count()
    return nearest(df, df, min(k + 1, n)).groupBy("q").agg(F.max("d").alias("d"))


def auto_eps(df: DataFrame, k: int = 5) -> float:
    row = knee(k_distances(df, k)).first()
    return float(row["eps"]) if row and row["eps"] is not None else 1e-6


def tukey_fence(df: DataFrame, column: str) -> DataFrame:
    """Third quartile plus one and a half interquartile ranges, quartiles by linear interpolation."""
    q = df.agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    return q.select((F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("fence"))


def table_distances(features: DataFrame, vector: str = "features") -> DataFrame:
    """Tables with their standardised features ``z`` and the distance ``d`` from the median of every feature."""
    scaled = zscore(features, vector, "_z")
    varying = scaled.select(F.posexplode("_z").alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("v"), F.median("x").alias("m"))
    middle = varying.agg(F.sum("v").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("med"))
    joined = scaled.crossJoin(F.broadcast(middle))  # one row: as many numbers as there are features
    scale = F.sqrt(F.when(F.col("total") > 1e-12, F.col("total")).otherwise(F.lit(1.0)))
    return joined.withColumn("z", F.transform("_z", lambda x: x / scale)).withColumn("d", distance(F.col("z"), F.transform("med", lambda x: x / scale))).drop("_z", "total", "med")


def flag_tables(features: DataFrame, n_columns: str | None = "n_columns", min_columns: int = MIN_JUDGED) -> DataFrame:
    """(table_name, grp): -1 for normal tables, else the group of the anomalous table.

    ``features`` has table_name, key, features. Narrow tables are held out; of fewer than four judged tables none is
    flagged. Anomalous tables lie beyond Tukey's fence; those within the fence of each other form one group, and groups
    are numbered by their first table.
    """
    judged = features.where(F.col(n_columns) >= min_columns) if n_columns else features
    none = features.select("table_name", F.lit(-1).alias("grp"))
    if judged.limit(4).count() < 4:
        return none
    measured = checkpoint(table_distances(judged))
    fence = tukey_fence(measured, "d").first()["fence"]
    odd = checkpoint(measured.where(F.col("d") > fence).select("table_name", "key", F.col("z").alias("vector")))
    if odd.isEmpty():
        return none
    roots = connected(close_pairs(odd, fence).where("a <> b"), odd)
    groups = roots.withColumn("grp", (F.dense_rank().over(Window.orderBy("root")) - 1).cast("int")).join(odd.select("key", "table_name"), "key")
    return features.select("table_name").join(groups.select("table_name", "grp"), "table_name", "left").withColumn("grp", F.coalesce("grp", F.lit(-1)))


def combine_levels(columns: DataFrame, groups: DataFrame) -> DataFrame:
    """Columns of normal tables keep their cluster; those of anomalous tables take their table's group, above all clusters."""
    top = columns.agg((F.coalesce(F.max("cluster"), F.lit(-1)) + 1).alias("offset"))
    known = columns.join(groups, "table_name", "left").crossJoin(F.broadcast(top))
    checked = F.when(F.col("grp").isNull(), F.raise_error(F.concat(F.lit("no group for table "), F.col("table_name"))).cast("int")).otherwise(F.col("grp"))
    return known.withColumn("cluster", F.when(checked == -1, F.col("cluster")).otherwise(F.col("offset") + F.col("grp"))).drop("grp", "offset")


def kmeans(df: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """(key, cluster) by MLlib's k-means, k capped at the rows."""
    n = df.limit(k).count()
    if n < 2:
        return df.select("key", F.lit(0).alias("cluster"))
    data = df.select("key", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    return KMeans(k=min(k, n), seed=seed, initSteps=5, maxIter=100).fit(data).transform(data).select("key", F.col("prediction").alias("cluster"))


METHODS = ("kmeans", "dbscan", "agglomerative", "meanshift", "hdbscan")


def fit_predict(df: DataFrame, method: str, n_clusters: int = 5, seed: int = 42, **options) -> DataFrame:
    """(key, cluster) by any method of METHODS; no rows give no rows, an unknown method is an error.

    dbscan takes eps (0.5, or `auto` for the knee of the distances to the fifth neighbour), min_samples and metric.
    """
    if method not in METHODS:
        raise ClusteringError(f"unknown method {method}")
    if df.isEmpty():
        return df.select("key", F.lit(0).alias("cluster"))
    if method == "kmeans":
        return kmeans(df, n_clusters, seed)
    if method == "dbscan":
        eps = options.get("eps", 0.5)
        return dbscan(df, auto_eps(df) if eps == "auto" else eps, options.get("min_samples"), options.get("metric", "euclidean"))
    return cluster(df, method, **({"k": n_clusters} if method == "agglomerative" else {}), **options)


def describe(found: DataFrame, df: DataFrame) -> DataFrame:
    """Per cluster its size and, but for noise, its mean vector as ``centroid``."""
    rows = found.join(df, "key")
    return cluster_sizes(rows, "cluster").join(centroid_vectors(rows, "cluster", "vector"), "cluster", "left")
