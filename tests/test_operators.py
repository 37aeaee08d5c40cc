import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colscope.errors import CatalogError, ClusteringError
from colscope.operators import clustering, features, forest, kernels, partitions
from colscope.operators.reduction import Reducer
from colscope.plans import experiments


def part(spark, truth, cluster):
    return spark.createDataFrame([(i, t, c, f"t{i % 3}") for i, (t, c) in enumerate(zip(truth, cluster, strict=True))], "key long, label string, cluster int, table_name string")


def test_metrics_of_known_partitions(spark):
    same = partitions.agreement(part(spark, "aabbcc", [0, 0, 1, 1, 2, 2]), "label", "cluster").first()
    assert (same["ari"], round(same["nmi"], 9), round(same["ami"], 9), same["n_groups"]) == (1.0, 1.0, 1.0, 3)
    mixed = partitions.agreement(part(spark, "aaabbb", [0, 0, 1, 1, 2, 2]), "label", "cluster").first()
    assert abs(mixed["ari"] - 0.24242424) < 1e-6 and abs(mixed["nmi"] - 0.51581) < 1e-4 and abs(mixed["ami"] - 0.298792) < 1e-5
    one = partitions.agreement(part(spark, "aaaa", [0, 0, 0, 0]), "label", "cluster").first()
    assert (one["ari"], one["nmi"], one["ami"]) == (1.0, 1.0, 1.0)
    apart = partitions.agreement(part(spark, "aabb", [0, 1, 0, 1]), "label", "cluster").first()
    assert abs(apart["ari"] + 0.5) < 1e-12


def test_log_factorial(spark):
    got = spark.range(0, 3000).select("id", partitions.log_factorial(F.col("id")).alias("f")).collect()
    assert all(abs(r["f"] - math.lgamma(r["id"] + 1)) < 1e-9 * max(1, r["f"]) for r in got)


def test_names_break_ties_by_first_row(spark):
    df = part(spark, "babacc", [0, 0, 0, 0, -1, 1])
    got = {r["cluster"]: r["predicted"] for r in partitions.majority_labels(df, "label", "cluster", "key").collect()}
    assert got == {0: "b", -1: "c", 1: "c"}
    full = partitions.score(df, "label", "cluster", "key").first()
    assert abs(full["accuracy"] - 4 / 6) < 1e-12 and math.isnan(full["table_ari"])
    assert abs(full["f1_macro"] - (0.0 + 2 * 2 / 6 + 1.0) / 3) < 1e-12


def test_dominant_labels(spark):
    df = spark.createDataFrame([(0, "x", "clean"), (1, "x", "eav"), (2, "x", "eav"), (3, "y", "clean"), (4, "y", "clean"), (5, "y", "eav")], "key long, t string, l string")
    got = {r["t"]: r["table_label"] for r in partitions.dominant_labels(df, "t", "l", "key").collect()}
    assert got == {"x": "eav", "y": "sin_problema_de_tabla"}


def blobs(spark, n=15, seed=1):
    rnd = np.random.default_rng(seed)
    x = np.concatenate([rnd.normal(c, 0.1, (n, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    return spark.createDataFrame([(i, [float(a) for a in v], i // n) for i, v in enumerate(x)], "key long, vector array<double>, label int")


def labels_of(df):
    return [r["cluster"] for r in df.orderBy("key").collect()]


def test_dbscan_and_knee(spark):
    df = blobs(spark).unionAll(spark.createDataFrame([(99, [50.0, 50.0], 3)], "key long, vector array<double>, label int"))
    assert labels_of(clustering.dbscan(df, 1.0, 3)) == [0] * 15 + [1] * 15 + [2] * 15 + [-1]
    assert 0 < clustering.auto_eps(blobs(spark)) < 1
    two = spark.createDataFrame([(0, [0.0]), (1, [3.0])], "key long, vector array<double>")
    assert clustering.auto_eps(two) == 3.0
    assert labels_of(clustering.dbscan(two, 1.0)) == [-1, -1]
    line = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(12)], "key long, vector array<double>")
    assert labels_of(clustering.dbscan(line, 1.0, 3)) == [0] * 12
    with pytest.raises(ClusteringError):
        clustering.dbscan(two, 1.0, 2, "odd")


def test_close_pairs_are_all_pairs(spark):
    rnd = random.Random(3)
    x = {i: [rnd.uniform(-2, 2) for _ in range(3)] for i in range(60)}
    df = spark.createDataFrame(list(x.items()), "key long, vector array<double>")
    for metric, eps in (("euclidean", 0.9), ("cosine", 0.05)):
        got = {(r["a"], r["b"]) for r in clustering.close_pairs(df, eps, metric).collect()}
        m = kernels.distances(np.array(list(x.values())), metric)
        assert got == {(i, j) for i in x for j in x if i == j or m[i, j] <= eps}


def test_reassign_and_consensus(spark):
    rows = blobs(spark).withColumn("cluster", F.when(F.col("key").isin(3, 20, 40), -1).otherwise(F.col("label")))
    assert labels_of(clustering.reassign_noise(rows)) == [0] * 15 + [1] * 15 + [2] * 15
    alone = rows.withColumn("cluster", F.lit(-1))
    assert set(labels_of(clustering.reassign_noise(alone))) == {-1}
    views = spark.createDataFrame([(0, 1, 0), (0, 2, 0), (0, 3, -1), (1, 1, 4), (1, 2, 5), (1, 3, -1)], "view int, key long, cluster int")
    assert [(r["a"], r["b"], r["share"]) for r in clustering.co_association(views).collect()] == [(1, 2, 0.5)]


def test_flags(spark):
    rnd = random.Random(5)
    made = [(f"t{i}", i, 5, [rnd.gauss(0, 0.1) for _ in range(3)]) for i in range(18)] + [("odd", 18, 5, [9.0, 9.0, 9.0]), ("odd2", 19, 5, [9.0, 9.0, 9.1]), ("thin", 20, 2, [90.0, 0.0, 0.0])]
    df = spark.createDataFrame(made, "table_name string, key long, n_columns int, features array<double>")
    got = {r["table_name"]: r["grp"] for r in clustering.flag_tables(df).collect()}
    assert got["odd"] == got["odd2"] == 0 and got["thin"] == -1 and all(got[f"t{i}"] == -1 for i in range(18))
    assert {r["grp"] for r in clustering.flag_tables(df.limit(3)).collect()} == {-1}
    columns = spark.createDataFrame([(0, "t1", 4), (1, "odd", 2)], "key long, table_name string, cluster int")
    assert labels_of(clustering.combine_levels(columns, clustering.flag_tables(df))) == [4, 5]
    with pytest.raises(Exception, match="no group"):
        clustering.combine_levels(columns.withColumn("table_name", F.lit("nope")), clustering.flag_tables(df)).collect()


def test_kernels(spark):
    x = np.array([r["vector"] for r in blobs(spark).orderBy("key").collect()])
    want = [0] * 15 + [1] * 15 + [2] * 15
    for linkage in ("ward", "single", "complete", "average"):
        assert kernels.agglomerative(x, 3, linkage).tolist() == want
    labels, k, s = kernels.ward_by_silhouette(x)
    assert (labels.tolist(), k) == (want, 3) and s > 0.9
    assert kernels.ward_by_silhouette(np.zeros((5, 2)))[1] == 1
    assert kernels.mean_shift(x, 1.0).tolist() in ([want, *[[p[i] for i in want] for p in ((0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))]])
    found, validity = kernels.hdbscan(np.vstack([x, [[40, 40]]]), 5, 3)
    assert len(set(found[:45])) == 3 and found[45] == -1 and validity > 0.5
    assert kernels.hdbscan(x[:3])[0].tolist() == [-1] * 3
    assert kernels.consensus(np.array([[1, 0.6, 0], [0.6, 1, 0.5], [0, 0.5, 1]]), 0.5).tolist() == [0, 0, 1]
    assert kernels.consensus(np.empty((0, 0))).tolist() == []
    with pytest.raises(ClusteringError):
        kernels.merges(np.zeros((2, 2)), "odd")
    with pytest.raises(ClusteringError):
        kernels.agglomerative(x[:1])
    s = clustering.silhouette(blobs(spark).withColumnRenamed("label", "cluster")).first()["silhouette"]
    assert abs(s - kernels.silhouette(x, np.array(want))) < 1e-9


def test_linkage_heights_match_brute_force():
    rnd = np.random.default_rng(4)
    for _ in range(10):
        d = kernels.distances(rnd.normal(size=(9, 2)))
        for linkage, join in (("single", np.min), ("complete", np.max), ("average", np.mean)):
            groups, want = [[i] for i in range(9)], []
            while len(groups) > 1:
                h, a, b = min((join(d[np.ix_(groups[i], groups[j])]), i, j) for i in range(len(groups)) for j in range(i))
                want.append(h)
                groups[b] += groups.pop(a)
            assert np.allclose([m[2] for m in kernels.merges(d, linkage)], want)


def test_trees_without_squares_of_distances():
    rnd = np.random.default_rng(6)
    for n in (2, 3, 40, 300):
        x = rnd.normal(size=(n, 3))
        for made, linkage in ((kernels.ward_merges(x), "ward"), (kernels.single_merges(x), "single")):
            assert np.allclose([m[2] for m in made], [m[2] for m in kernels.merges(kernels.distances(x), linkage)])
            for k in (1, 2, n // 2 or 1):
                assert kernels.cut_tree(n, made, k=k).tolist() == kernels.cut_tree(n, kernels.merges(kernels.distances(x), linkage), k=k).tolist()
    x = rnd.normal(size=(200, 3))
    d, k = kernels.distances(x), 4
    core = np.sort(d, axis=1)[:, k]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    np.fill_diagonal(reach, np.inf)
    assert np.isclose(sum(e[2] for e in kernels.spanning_tree(kernels.Rows(x), core)), sum(m[2] for m in kernels.merges(np.where(np.isinf(reach), 0, reach), "single")))


def test_density_clusters_of_many_rows():
    rnd = np.random.default_rng(7)
    x = np.vstack([rnd.normal(c, 0.1, (4500, 2)) for c in ((0, 0), (5, 5), (0, 9))])
    labels, validity = kernels.hdbscan(x, 200, 20)
    assert len(x) > kernels.MOST_ROWS and validity > 0.5 and sorted(np.bincount(labels[labels >= 0]))[0] > 4000
    with pytest.raises(ClusteringError):
        kernels.mean_shift(x)


def test_reduction(spark):
    df = blobs(spark)
    r = Reducer("pca", 2)
    got = r.fit_transform(df).orderBy("key").collect()
    x = np.array([g["vector"] for g in got])
    y = np.array([g["reduced"] for g in got])
    assert np.allclose(y.mean(axis=0), 0, atol=1e-9) and np.allclose(kernels.distances(x), kernels.distances(y), atol=1e-6)
    assert abs(sum(r.explained_variance_ratio()) - 1) < 1e-9 and r.components().shape == (2, 2)
    assert Reducer("umap", 2).fit_transform(df).count() == 45
    s = Reducer("svd", 2)
    assert s.fit_transform(df).count() == 45 and s.transform(df).count() == 45
    assert len(Reducer("tsne", 2).fit_transform(df).first()["reduced"]) == 2
    assert Reducer("pca", 0).fit_transform(df).first()["reduced"] == Reducer("pca", 0).fit_transform(df).first()["vector"]
    with pytest.raises(ClusteringError):
        Reducer("odd")
    with pytest.raises(ClusteringError):
        Reducer("pca").transform(df)


def test_blocks(spark):
    rows = [(i, "t", [float(i), 1.0], [float(i % 2)] * 3) for i in range(8)]
    df = spark.createDataFrame(rows, "key long, table_name string, e_text array<double>, e_type array<double>")
    phi = np.array([r["phi"] for r in features.fuse(df, (0.5, 0.0, 0, 0, 0, 0)).orderBy("key").collect()])
    assert phi.shape == (8, 5) and np.allclose(phi[:, 2:], 0) and abs(phi.var(axis=0).sum() - 0.25) < 1e-9 and np.allclose(phi[:, 1], 0)
    features.assert_blocks(df, ["e_text", "e_type"])
    with pytest.raises(CatalogError):
        features.assert_blocks(df.unionAll(spark.createDataFrame([(9, "t", None, [1.0])], df.schema)), ["e_text", "e_type"])
    with pytest.raises(CatalogError):
        features.scale_conflict(df.withColumn("e_conflict", F.col("e_text")))
    with pytest.raises(CatalogError):
        features.weight_shares((1.0,), "zscore")
    with pytest.raises(CatalogError):
        features.require(df, "e_conflict", "it")
    tied = features.degeneracy(df, "e_type").first()
    assert (tied["n_distinct"], tied["tied_share"], tied["largest"]) == (2, 1.0, 4)
    index = spark.createDataFrame([(0, 3), (1, 3), (2, 0)], "out_pos int, key long")
    assert [r["key"] for r in features.gather(df, index, "key").orderBy("out_pos").collect()] == [3, 3, 0]


def test_siblings_match_brute_force(spark):
    rnd = np.random.default_rng(7)
    x = rnd.normal(size=(14, 4))
    table = ["a"] * 6 + ["b"] * 7 + ["c"]
    name = [f"n{i % 4}" for i in range(14)]
    df = spark.createDataFrame([(i, table[i], name[i], x[i].tolist()) for i in range(14)], "key long, t string, name string, v array<double>")
    got = {r["key"]: r for r in features.sibling_signals(df, "key", "t", "name", "v").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(14):
        others = [j for j in range(14) if table[j] == table[i] and j != i]
        if not others:
            assert (got[i]["atypical"], got[i]["clash"], got[i]["heterogeneity"]) == (0, 0, 0)
            continue
        c = u[others].mean(axis=0)
        assert abs(got[i]["atypical"] - (1 - u[i] @ c / np.linalg.norm(c))) < 1e-9
        assert abs(got[i]["clash"] - max(u[i] @ u[j] for j in others if name[j] != name[i])) < 1e-9
        group = [*others, i]
        assert abs(got[i]["heterogeneity"] - (1 - np.mean([u[a] @ u[b] for a in group for b in group if a < b]))) < 1e-9


def test_folds_and_forest(spark):
    labels = ["x"] * 7 + ["y"] * 5 + ["z"]
    df = spark.createDataFrame(list(enumerate(labels)), "key long, label string")
    got = forest.stratified_folds(df, "label", "key", 3).collect()
    order = sorted(range(13), key=lambda i: ("xyz".index(labels[i]), i))
    share = {(c, i): [labels[j] for j in order][i::3].count(c) for c in "xyz" for i in range(3)}
    for c in "xyz":
        rows = sorted((r["key"], r["fold"]) for r in got if r["label"] == c)
        assert [f for _, f in rows] == [i for i in range(3) for _ in range(share[c, i])]
    assert [r["label"] for r in forest.low_support(df, "label", 3).collect()] == ["z"]
    data = blobs(spark).withColumn("raw", F.col("vector"))
    oof = forest.out_of_fold(data, "label", "key", 3, 10).collect()
    assert len(oof) == 45 and np.mean([str(r["label"]) == r["predicted"] for r in oof]) > 0.95
    model, names = forest.fit_forest(data, "label", 5)
    with pytest.raises(CatalogError):
        forest.predict(model, names, data.withColumn("raw", F.array(F.lit(1.0))))


def test_health(spark):
    df = spark.createDataFrame([(0, "eav", 1.0), (1, "clean", 0.5), (2, "eav", float("nan"))], "key long, predicted string, confidence double")
    support = spark.createDataFrame([("eav", 9), ("clean", 2)], "label string, support long")
    rows = forest.verdicts(df, support)
    assert abs(forest.health_score(rows).first()["health"] - 100 * (1 - 2 / 3)) < 1e-9
    assert {r["key"]: r["low_support"] for r in rows.collect()} == {0: False, 1: True, 2: False}
    assert forest.health_score(rows.limit(0)).first()["health"] == 100.0
    by = {r["label"]: (r["n"], r["mean_confidence"], r["penalty"]) for r in forest.health_by_label(rows.withColumnRenamed("predicted_label", "label")).collect()}
    assert by == {"eav": (2, 1.0, 6.0), "clean": (1, 0.5, 0.0)}


def test_method_registry(spark):
    df = blobs(spark).select("key", "vector")
    for method in clustering.METHODS:
        found = clustering.fit_predict(df, method, 3, **({"eps": "auto"} if method == "dbscan" else {}))
        assert found.count() == 45 and set(found.columns) == {"key", "cluster"}
    about = {r["cluster"]: r for r in clustering.describe(clustering.fit_predict(df, "agglomerative", 3), df).collect()}
    assert {c: r["n"] for c, r in about.items()} == {0: 15, 1: 15, 2: 15} and abs(about[1]["centroid"][0] - 5) < 0.2
    assert clustering.fit_predict(df.limit(0), "kmeans").count() == 0
    with pytest.raises(ClusteringError):
        clustering.fit_predict(df, "odd")


def test_forest_baseline(spark):
    data = blobs(spark).withColumn("raw", F.col("vector"))
    rows = {r["fold"]: r for r in forest.baseline(data, "label", "key", 3, 10).collect()}
    assert set(rows) == {-1, 0, 1, 2} and rows[-1]["n"] == 45 and rows[-1]["f1_macro"] > 0.95
    model, _ = forest.fit_forest(data, "label", 5)
    best = forest.importances(model, 1)
    assert len(best) == 1 and best[0][1] >= 0.3
    assert [r["support"] for r in forest.rarest(data.limit(20), "label", 1).collect()] == [5]


def test_clashes_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(features, "dot", lambda a, b, dot=features.dot: seen.append(1) or dot(a, b))
    seen = []
    monkeypatch.setattr("colscope.operators.blocks.BLOCK", 8)
    rnd = np.random.default_rng(8)
    x = np.repeat(rnd.normal(size=(30, 3)), 2, axis=0)
    x[7] = 0
    df = spark.createDataFrame([(i, "ab"[i % 2 * (i < 50)], f"n{i % 5}" if i != 9 else None, x[i].tolist()) for i in range(60)], "key long, t string, name string, v array<double>")
    got = {r["key"]: r["clash"] for r in features.sibling_signals(df, "key", "t", "name", "v").collect()}
    assert len(seen) <= 4  # no pair of rows meets in an expression of its own
    u = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) == 0, 1, np.linalg.norm(x, axis=1, keepdims=True))
    for i in range(60):
        others = [j for j in range(60) if i % 2 * (i < 50) == j % 2 * (j < 50) and j % 5 != i % 5 and 9 not in (i, j)]
        assert abs(got[i] - max((u[j] @ u[i] for j in others), default=0)) < 1e-12


def test_consensus_of_signatures(spark, monkeypatch):
    rnd = np.random.default_rng(11)
    monkeypatch.setattr(kernels, "MOST_ROWS", 20)  # no square of rows is held
    for trial in range(3):
        at = rnd.integers(-1, 3, size=(3, 60))
        views = spark.createDataFrame([(v, 7 + 2 * i, int(at[v, i])) for v in range(3) for i in range(60)], "view int, key long, cluster int")
        agree = ((at[:, :, None] == at[:, None, :]) & (at[:, :, None] >= 0)).sum(axis=0) / 3
        np.fill_diagonal(agree, 1.0)
        for threshold in (0.5, 0.9):
            got = {r["key"]: r["cluster"] for r in experiments.late_fusion(views, threshold).collect()}
            labels = [got[7 + 2 * i] for i in range(60)]
            assert list(dict.fromkeys(labels)) == list(range(len(set(labels)))) and len(got) == 60
            apart = lambda a, b: 1 - agree[np.ix_(a, b)].mean()
            groups = [[i for i in range(60) if labels[i] == c] for c in sorted(set(labels))]
            # no two clusters are nearer than the threshold; copies are together unless their noise keeps them apart
            assert all(apart(a, b) >= threshold - 1e-9 for k, a in enumerate(groups) for b in groups[:k])
            for i in range(60):
                for j in range(i):
                    if (at[:, i] == at[:, j]).all():
                        assert (labels[i] == labels[j]) == (1 - agree[i, j] < threshold)
    one = spark.createDataFrame([(0, 5, 1), (1, 5, 2)], "view int, key long, cluster int")
    assert labels_of(experiments.late_fusion(one)) == [0]
    assert experiments.late_fusion(one.limit(0)).count() == 0


def test_average_roots_match_the_tree():
    rnd = np.random.default_rng(3)
    for _ in range(20):
        at = rnd.integers(0, 4, size=(30, 7))  # seven views leave few ties
        at = np.unique(at, axis=0)
        agree = (at[:, None, :] == at[None, :, :]).mean(axis=2)
        got = kernels.average_roots([[f"{v}:{c}" for v, c in enumerate(r)] for r in at], np.ones(len(at), int), 7, 0.99)
        assert len(got) == len(at) and all(got[g] == g for g in got)
    far = kernels.average_roots([["a"], ["a", "b"], ["c"]], np.array([1, 1, 1]), 2, 0.6)
    assert far.tolist() == [0, 0, 2]


def test_table_naming_from_blocks(spark, monkeypatch):
    monkeypatch.setattr("colscope.operators.blocks.BLOCK", 4)
    rows = [(i, "ab"[i // 12], str(i % 7), [float(i % 5 + 1), float(i % 3), 1.0]) for i in range(24)]
    df = spark.createDataFrame(rows, "key long, t string, name string, v array<double>")
    met = []
    monkeypatch.setattr(features, "_clashes", lambda rows, clashes=features._clashes: met.append(1) or clashes(rows))
    signals = features.sibling_signals(df, "key", "t", "name", "v").withColumns({c: F.lit(0.0) for c in ("emptiness", "divergence", "conflicting")})
    got = {r["t"]: r for r in features.table_naming(signals, "t").collect()}
    u = {i: np.array(v) / np.linalg.norm(v) for i, _, _, v in rows}
    for t in "ab":
        own = [r for r in rows if r[1] == t]
        assert met and abs(got[t]["clash"] - max(u[a[0]] @ u[b[0]] for a in own for b in own if a[2] != b[2])) < 1e-12


def test_ward_in_rounds_matches_chains():
    rnd = np.random.default_rng(12)
    for x in (rnd.normal(size=(300, 3)), rnd.normal(size=(200, 8)) + 1e6, np.repeat(rnd.normal(size=(20, 2)), 9, axis=0), np.zeros((7, 2))):
        tree, want = kernels.ward_merges(x), kernels.merges(kernels.distances(x - x.mean(axis=0)), "ward")
        assert len(tree) == len(x) - 1 and max(abs(a[2] - b[2]) for a, b in zip(tree, want, strict=True)) < 1e-5
        for k in range(1, min(len(x), 20)):
            assert (kernels.cut_tree(len(x), tree, k=k) == kernels.cut_tree(len(x), want, k=k)).all() or x[0, 0] == x[1, 0] or x[0, 0] > 1e5
    assert max(kernels.cut_tree(180, kernels.ward_merges(np.repeat(rnd.normal(size=(20, 2)), 9, axis=0)), k=20)) == 19


def test_agglomerative_in_few_rounds(monkeypatch):
    calls, nearest = [], kernels._ward_nearest
    monkeypatch.setattr(kernels, "_ward_nearest", lambda mean, size, todo: calls.append(len(todo)) or nearest(mean, size, todo))
    assert len(set(kernels.agglomerative(np.random.default_rng(2).normal(size=(2000, 5)), 10).tolist())) == 10
    assert len(calls) < 60 and sum(calls) < 5 * 2000  # a step of a chain is no pass over all rows of its own


def test_ward_silhouettes_are_dealt(spark):
    got = labels_of(experiments.ward(blobs(spark)))
    assert got == [0] * 15 + [1] * 15 + [2] * 15
    x = np.array([r["vector"] for r in blobs(spark).orderBy("key").collect()])
    cuts = np.stack(kernels.ward_cuts(x), axis=1)
    parts = [kernels.silhouette_sums(kernels.Rows(x), cuts, np.arange(i, 45, 4)) for i in range(4)]
    want = kernels.silhouettes(kernels.Rows(x), list(cuts.T))
    assert np.allclose(np.sum(parts, axis=0) / 45, want) and kernels.best_cut(want) == 1
    for rows in (0, 1, 2):
        assert experiments.ward(blobs(spark).limit(rows)).count() == rows


def test_mean_shift_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(kernels, "MOST_ROWS", 20)  # no square of rows is held
    x = np.array([r["vector"] for r in blobs(spark).orderBy("key").collect()])
    for bandwidth in (None, 1.0):
        want = kernels.mean_shift(x, bandwidth)
        assert labels_of(kernels.cluster(blobs(spark).select("key", "vector"), "meanshift", bandwidth=bandwidth)) == want.tolist()
        wide = bandwidth or float(np.sort(kernels.Rows(x).rows(np.arange(45)), axis=1)[:, 12].mean())
        peaks = {}
        for p in x:
            for _ in range(300):
                near = x[((x - p) ** 2).sum(axis=1) <= wide**2]
                if np.linalg.norm(near.mean(axis=0) - p) < 1e-3 * wide:
                    break
                p = near.mean(axis=0)
            peaks[tuple(p)] = len(near)
        kept = []
        for p in map(np.array, sorted(peaks, key=lambda p: (peaks[p], p), reverse=True)):
            if all(np.linalg.norm(p - q) > wide for q in kept):
                kept.append(p)
        assert want.tolist() == np.argmin([((x - p) ** 2).sum(axis=1) for p in kept], axis=0).tolist()
    assert kernels.cluster(blobs(spark).limit(0).select("key", "vector"), "meanshift").count() == 0


def test_one_forest_at_a_time(spark, monkeypatch):
    import weakref

    models, fit = [], forest.fit_forest

    def watched(*args):
        assert all(m() is None for m in models)
        model, names = fit(*args)
        models.append(weakref.ref(model))
        return model, names

    monkeypatch.setattr(forest, "fit_forest", watched)
    found = forest.out_of_fold(blobs(spark).withColumn("raw", F.col("vector")), "label", "key", 3, 4)
    assert len(models) == 3 and all(m() is None for m in models)
    assert "UDF" not in found._jdf.queryExecution().optimizedPlan().toString()  # no model in the plan
    assert found.count() == 45


def test_grid_shares_spanning_trees():
    x = np.random.default_rng(6).normal(size=(120, 3))
    d = kernels.Rows(x).rows(np.arange(120))
    for samples in (2, 5):
        edges, core = kernels.density_edges(x, samples), np.sort(d, axis=1)[:, samples]
        reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
        want = kernels.merges(reach, "single")
        assert np.allclose(sorted(e[2] for e in edges), [m[2] for m in want])
        for size in (5, 8):
            assert kernels.hdbscan(x, size, samples, edges=edges)[0].tolist() == kernels.hdbscan(x, size, samples)[0].tolist()


def test_blocks_of_distances_stay_small():
    assert max(at.stop - at.start for at in kernels.Rows(np.zeros((100_000, 1))).blocks()) * 100_000 <= 1 << 21


def test_core_distances_keep_no_blocks(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(kernels, "spanning_tree", lambda d, core: core)
    x = np.random.default_rng(1).normal(size=(3000, 2))
    tracemalloc.start()
    kernels.density_edges(x, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45e6  # a square would take 72 MB


def test_spanning_tree_from_near_rows(monkeypatch):
    monkeypatch.setattr(kernels, "Rows", None)  # a distance of every row to every row outside the tree, before
    monkeypatch.setattr(kernels, "MOST_CELLS", 4000)  # blocks of a few rows
    rnd = np.random.default_rng(8)
    apart = np.vstack([rnd.normal(9 * c, 0.1, (30, 4)) for c in range(12)])  # nothing near leads out of a cluster
    shared = rnd.normal(size=(90, 3))[rnd.integers(0, 90, 240)]
    for x in (rnd.normal(size=(2, 3)), rnd.normal(size=(400, 8)), apart, rnd.random((2500, 1)), shared, np.ones((9, 2)), np.indices((15, 15)).reshape(2, -1).T):
        gap = x[:, None, :] - x[None, :, :]
        d = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
        for samples in (2, 5, 20):
            core = np.sort(d, axis=1)[:, min(samples, len(x) - 1)]
            reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
            want, best, source, left, j = [], np.full(len(x), np.inf), np.zeros(len(x), int), np.ones(len(x), bool), 0
            for _ in range(len(x) - 1):
                left[j] = False
                closer = reach[j] < best
                best[closer], source[closer] = reach[j][closer], j
                j = int(np.where(left, best, np.inf).argmin())
                want.append((int(source[j]), j, float(best[j])))
            found = kernels.density_edges(x, samples)
            if x is shared:  # which copy an edge leaves is open
                assert sorted(e[2] for e in found) == sorted(e[2] for e in want)
            else:
                assert found == want
            for size in (5, 8):
                assert kernels.hdbscan(x, size, samples, edges=found)[0].tolist() == kernels.hdbscan(x, size, samples, edges=want)[0].tolist()


def test_grid_deals_near_rows(spark):
    rnd = np.random.default_rng(9)
    x = np.vstack([rnd.normal(c, 0.3, (60, 3)) for c in (0, 2, 9)])[rnd.integers(0, 180, 200)]  # with copies
    points = spark.createDataFrame([(7 * i, v) for i, v in enumerate(x.tolist())], "key long, vector array<double>")
    grid = [(5, 2), (8, 2), (6, 30)]
    found = experiments.stability_grid(points, grid)
    assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().optimizedPlan().toString()  # one task measured all distances before
    found = found.orderBy("cell", "key").toPandas()
    for cell, (size, samples) in enumerate(grid):
        labels, validity = kernels.hdbscan(x, size, samples)
        own = found[found["cell"] == cell]
        assert own["cluster"].tolist() == labels.tolist() and own["key"].tolist() == list(range(0, 1400, 7))
        assert np.allclose(own["validity"], validity, equal_nan=True)
    assert experiments.stability_grid(points.limit(0), grid).count() == 0
    assert [r["cluster"] for r in experiments.stability_grid(points.limit(1), grid).collect()] == [-1, -1, -1]


def test_tsne_beyond_a_square_of_rows(spark, monkeypatch):
    monkeypatch.setattr(kernels, "MOST_ROWS", 20)  # refused before
    got = Reducer("tsne", 2).fit_transform(blobs(spark)).orderBy("key").collect()
    x, y = np.array([r["vector"] for r in got]), np.array([r["reduced"] for r in got])
    assert y.shape == (45, 2) and np.allclose(y, kernels.tsne(x))
    x = np.concatenate([x + [0, 0.01 * i] for i in range(4)])
    for cells in (kernels.MOST_CELLS, 600):  # pairs of all rows; a grid and near rows
        monkeypatch.setattr(kernels, "MOST_CELLS", cells)
        y = kernels.tsne(x, perplexity=10.0)
        near = np.argsort(kernels.Rows(y).rows(np.arange(180)), axis=1)[:, 1:6]
        assert (near % 45 // 15 == np.arange(180)[:, None] % 45 // 15).mean() > 0.99
    assert len(Reducer("tsne", 1).fit_transform(blobs(spark)).first()["reduced"]) == 1
    for rows in (0, 1, 2):
        assert Reducer("tsne", 2).fit_transform(blobs(spark).limit(rows)).count() == rows


def test_tsne_forces(monkeypatch):
    rnd = np.random.default_rng(8)
    for y in (rnd.normal(size=(1500, 2)) * 1e-4, rnd.normal(size=(1500, 2)) * 15, rnd.normal(size=(1500, 1)) * 15, np.zeros((1500, 2))):
        push = kernels.Pushes()
        (force, total), (want, sure) = push(y), push.pairs(y)
        assert push.kernels and abs(total / sure - 1) < 1e-3 and np.linalg.norm(force - want) <= 0.02 * np.linalg.norm(want) + 1e-9
    x = np.concatenate([rnd.normal(size=(60, 3)), np.full((20, 3), 20.0)])
    near, p = kernels.tsne_neighbours(x, np.arange(80), 10.0)
    entropy = -(p[:60] * np.log(p[:60] + 1e-300)).sum(axis=1)
    assert near.shape == (80, 79) and np.allclose(p.sum(axis=1), 1) and np.allclose(entropy, math.log(10), atol=1e-4)
    y, full = rnd.normal(size=(80, 2)), np.zeros((80, 80))
    full[np.arange(80)[:, None], near] = p
    gaps = y[:, None] - y[None]
    want = ((full + full.T) / (1 + (gaps**2).sum(axis=2)))[:, :, None] * gaps
    assert np.allclose(kernels.pulls(y, near.astype(int), p), want.sum(axis=1))
    monkeypatch.setattr(kernels, "MOST_CELLS", 100)
    few, share = kernels.tsne_neighbours(x, np.arange(5), 10.0)
    d = kernels.Rows(x).rows(np.arange(5))
    assert few.shape == share.shape == (5, 31) and all(set(few[i]) == set(np.argsort(d[i])[1:32]) for i in range(5))


def test_ward_search_stays_in_tiles():
    import tracemalloc

    mean, todo = np.random.default_rng(4).normal(size=(20_000, 3)), np.arange(300, 600)
    size = np.where(np.arange(20_000) % 3 == 0, 2.0, 1.0)
    todo = todo[np.argsort(size[todo], kind="stable")]
    tracemalloc.start()
    near, far = kernels._ward_nearest(mean, size, todo)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15e6  # a block of rows by all clusters would take 20 MB and as much again for its weights
    for i, j, h in zip(todo, near, far, strict=True):
        d = 2 * size[i] * size / (size[i] + size) * ((mean - mean[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        assert j == d.argmin() and abs(h - d[j]) < 1e-12
