"""Command line: `experiment` scores configurations, `score` reports health, and the catalog's own jobs of ``admin``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.errors import SchemaQualityError
from colscope.functions.constants import CONFLICT_WEIGHTS, DEFAULT_WEIGHTS, FOLDS, FUSED_WEIGHTS, STRUCTURE_WEIGHTS
from colscope.operators import forest
from colscope.operators.features import raw_features, require, sweep_weights, without_tables
from colscope.operators.partitions import composition, name_clusters
from colscope.plans import admin, blind, experiments, report
from colscope.sources.labels import align_labels, load_labels
from colscope.sources.sinks import health_rows, read_blocks, verdict_rows, write_csv


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="colscope")
    verbs = p.add_subparsers(dest="verb", required=True)
    e = verbs.add_parser("experiment")
    e.add_argument("--blocks", required=True)
    e.add_argument("--labels", required=True)
    e.add_argument("--csv")
    e.add_argument("--alpha", type=float)
    e.add_argument("--without-tables", nargs="*", default=[])
    e.add_argument("--bootstrap", type=int, default=0)
    e.add_argument("--bootstrap-frac", type=float, default=0.8)
    e.add_argument("--bootstrap-mode", choices=("subsample", "fixed"), default="subsample")
    e.add_argument("--ablation", nargs="+", metavar="BLOCKS")
    for flag in ("sweep", "baselines", "conflict", "robustness", "two-level", "stability"):
        e.add_argument(f"--{flag}", action="store_true")
    s = verbs.add_parser("score")
    s.add_argument("--reference", required=True)
    s.add_argument("--labels", required=True)
    s.add_argument("--target")
    s.add_argument("--folds", type=int, default=FOLDS)
    s.add_argument("--csv")
    admin.add_verbs(verbs)
    return p


def resampled(ds: DataFrame, n: int, share: float) -> str:
    """Intervals and paired differences with the blind pipeline run again on every resample."""
    ds = experiments.clustering.checkpoint(blind.inputs(ds))
    scorers = blind.configurations("e_name" in ds.columns and "name_intrinsic" in ds.columns)
    rows = experiments.clustering.checkpoint(experiments.bootstrap_pipeline(ds, scorers, n, share))
    first = next(iter(scorers))
    pairs = [(x, first) for x in scorers if x != first] + [(x, "conflict mean / ward") for x in scorers if x == "two-level mean"]
    shown = experiments.compare_intervals(experiments.point_estimates(ds, scorers), rows)
    head = f"Bootstrap, {n} resamples, the whole pipeline run again on {share:.0%} of the columns; points are of all columns"
    return f"{head}\n{report.intervals(shown, experiments.compare_differences(rows, pairs))}"


def labelled(spark: SparkSession, blocks: str, labels: str, without: list[str]) -> DataFrame:
    ds = align_labels(read_blocks(spark, blocks), load_labels(spark, labels)).withColumn("key", F.col("pos").cast("long"))
    return without_tables(ds, without)


def conflicts(ds: DataFrame) -> list[str]:
    """Three configurations, blind by ward and by hdbscan, and what the clusters of the fused one hold."""
    weights = {"document": sweep_weights(1.0, DEFAULT_WEIGHTS), "conflict": CONFLICT_WEIGHTS, "conflict fused": FUSED_WEIGHTS}
    found = experiments.clustering.checkpoint(blind.partitions(blind.inputs(ds), {f"{name} / {a}": (w, a, None) for name, w in weights.items() for a in ("ward", "hdbscan")}))
    fused = found.where("config = 'conflict fused / ward'").join(ds, "key").withColumn("name", F.concat_ws(".", "table_name", "column_name"))
    return [report.scores(blind.scored(ds, found).orderBy("config")), report.frame(composition(fused, "cluster", "table_name", "label", "key", "name").orderBy("cluster"))]


def wordings(ds: DataFrame, algorithm: str) -> list[str]:
    """The fused conflict configuration under every wording, and the mean and ends of it."""
    rows = experiments.clustering.checkpoint(blind.scored(ds, blind.partitions(blind.inputs(ds), blind.wording_runs(ds, FUSED_WEIGHTS, algorithm))))
    return [report.scores(rows.orderBy("config")), report.frame(experiments.summarise_wordings(rows))]


def two_levels(ds: DataFrame) -> list[str]:
    runs = {"document / ward": (sweep_weights(1.0, DEFAULT_WEIGHTS), "ward", None), "conflict fused / ward": (FUSED_WEIGHTS, "ward", None), "conflict fused / two-level": (FUSED_WEIGHTS, "two-level", None)}
    return [report.scores(blind.scored(ds, blind.partitions(blind.inputs(ds), runs)).orderBy("config")), report.frame(experiments.two_level_scores(ds, FUSED_WEIGHTS)), *wordings(ds, "two-level")]


def verdicts(ds: DataFrame) -> DataFrame:
    """A row per column: its label, its cluster by structure alone, and that cluster's name."""
    named = name_clusters(ds.join(experiments.run_clustering(ds, STRUCTURE_WEIGHTS), "key"), "label", "cluster", "key")
    return verdict_rows(named.select(F.concat_ws(".", "table_name", "column_name").alias("key"), F.col("label").alias("truth"), "cluster", "predicted", "pos").orderBy("pos"))


def experiment(spark: SparkSession, a: argparse.Namespace) -> str:
    ds = labelled(spark, a.blocks, a.labels, a.without_tables)
    if a.conflict or a.stability or a.bootstrap:
        require(ds, "e_conflict", "this run")
    if a.robustness or a.two_level or (a.bootstrap and a.bootstrap_mode == "subsample"):
        require(ds, "e_conflict_variants", "this run")
    if a.two_level:
        require(ds, "e_name", "this run")
        require(ds, "name_intrinsic", "this run")
    weights = DEFAULT_WEIGHTS
    if a.alpha is not None:
        weights = experiments.sweep_weights(a.alpha, weights)
    scored = experiments.evaluate("fused", ds, weights).unionByName(experiments.evaluate("structure only", ds, STRUCTURE_WEIGHTS))
    parts = [report.scores(scored)]
    if a.sweep:
        parts.append(report.scores(experiments.alpha_sweep(ds, weights)))
    if a.ablation:
        others = {Path(path).name: labelled(spark, path, a.labels, a.without_tables) for path in a.ablation}
        parts.append(report.scores(experiments.ablation({"full": ds} | others, weights)))
    if a.conflict:
        parts += conflicts(ds)
    if a.stability:
        parts.append(report.frame(experiments.grid_scores(ds, experiments.stability_grid(experiments.reduced(ds, CONFLICT_WEIGHTS)))))
    if a.robustness:
        for algorithm in ("ward", "hdbscan"):
            parts += wordings(ds, algorithm)
    if a.two_level:
        parts += two_levels(ds)
    if a.baselines:
        parts.append(report.frame(forest.baseline(raw_features(ds), "label", "key").orderBy("fold")))
        parts.append(report.frame(experiments.compare_algorithms(ds, experiments.reduced(ds, weights))))
    if a.bootstrap and a.bootstrap_mode == "fixed":
        frozen = {"document": experiments.blind_partition(ds, DEFAULT_WEIGHTS), "conflict": experiments.blind_partition(ds, CONFLICT_WEIGHTS)}
        rows = experiments.clustering.checkpoint(experiments.bootstrap(ds, frozen, a.bootstrap, a.bootstrap_frac))
        parts.append(report.intervals(experiments.intervals(rows, "ari"), experiments.paired_difference(rows, "conflict", "document", "ari")))
    elif a.bootstrap:
        parts.append(resampled(ds, a.bootstrap, a.bootstrap_frac))
    if a.csv:
        write_csv(verdicts(ds), a.csv)
    return "\n\n".join(parts)


def score(spark: SparkSession, a: argparse.Namespace) -> str:
    ds = align_labels(read_blocks(spark, a.reference), load_labels(spark, a.labels)).withColumn("key", F.col("pos").cast("long"))
    conflict = "e_conflict" in ds.columns
    raw = raw_features(ds, conflict=conflict)
    if a.target:
        model, names = forest.fit_forest(raw, "label")
        found = forest.predict(model, names, raw_features(read_blocks(spark, a.target), conflict=conflict).withColumn("key", F.col("pos").cast("long")))
    else:
        found = forest.out_of_fold(raw, "label", "key", a.folds)
    support = forest.label_support(ds, "label")
    rows = experiments.clustering.checkpoint(forest.verdicts(found, support, a.folds))
    if a.csv:
        write_csv(health_rows(rows), a.csv)
    value = forest.health_score(rows).first()["health"]
    return report.health(value, forest.health_by_label(rows.withColumnRenamed("predicted_label", "label")).orderBy(F.desc("penalty")), support.where(F.col("support") < a.folds))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("colscope").getOrCreate()
    try:
        out = ({"experiment": experiment, "score": score} | admin.VERBS)[a.verb](spark, a)
        text, good = out if isinstance(out, tuple) else (out, True)
        print(text)
    except SchemaQualityError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0 if good else 1


if __name__ == "__main__":
    sys.exit(main())
