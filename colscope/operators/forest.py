"""Label health: a random forest, its out-of-fold verdicts, and scores of health."""

from __future__ import annotations

import gc

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colscope.errors import CatalogError
from colscope.functions.constants import FOLDS, RECOMMENDATION, SEED, SEVERITY, TREES
from colscope.operators.partitions import label_scores
from colscope.operators.rank import checkpoint, number_rows


def stratified_folds(df: DataFrame, label: str, pos: str, folds: int = FOLDS) -> DataFrame:
    """Rows with a ``fold``: every fold gets its share of each label, a label's rows fill the folds in order of ``pos``.

    The share of fold i is the number of that label at places i, i + folds, ... of the labels sorted by first appearance.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("_n"), F.min(pos).alias("_first"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # numbered by label and place over range partitions: few labels do not mean few tasks
    numbered = number_rows(df, [label, pos], "_g")
    heads = numbered.groupBy(F.col(label).alias("_l")).agg(F.min("_g").alias("_head"))
    ranked = numbered.join(F.broadcast(heads), F.col(label).eqNullSafe(F.col("_l"))).withColumn("_r", F.col("_g") - F.col("_head")).drop("_g", "_head", "_l").join(starts, label)

    def upto(i: int):
        """Rows of the label that stand at places below its end with place mod folds <= i, summed over those folds."""
        out = F.lit(0)
        for j in range(i + 1):
            out = out + F.floor((F.col("_start") + F.col("_n") - 1 - j) / folds) - F.floor((F.col("_start") - 1 - j) / folds)
        return out

    fold = F.lit(folds - 1)
    for i in reversed(range(folds - 1)):
        fold = F.when(F.col("_r") < upto(i), F.lit(i)).otherwise(fold)
    return ranked.withColumn("fold", fold.cast("int")).drop("_r", "_n", "_first", "_start")


def label_support(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("support"))


def low_support(df: DataFrame, label: str, folds: int = FOLDS) -> DataFrame:
    """Labels with fewer rows than folds: no verdict on them was ever tested fairly."""
    return label_support(df, label).where(F.col("support") < folds)


def _prepared(df: DataFrame, label: str, names: list[str]) -> DataFrame:
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = df.count()
    weight = F.lit(float(total)) / (F.lit(float(len(names))) * F.col("_n"))
    code = F.array_position(F.array(*[F.lit(x) for x in names]), F.col(label).cast("string")) - 1
    return df.join(F.broadcast(sizes), label).withColumn("_w", weight).withColumn("_y", code.cast("double")).withColumn("_v", array_to_vector(F.col("raw").cast("array<double>")))


def fit_forest(df: DataFrame, label: str, trees: int = TREES, seed: int = SEED) -> tuple[RandomForestClassificationModel, list[str]]:
    """A forest over ``raw`` with balanced classes, and the names behind its classes."""
    names = sorted(str(r[0]) for r in df.select(label).distinct().collect())
    model = RandomForestClassifier(featuresCol="_v", labelCol="_y", weightCol="_w", numTrees=trees, seed=seed, maxDepth=12, featureSubsetStrategy="sqrt")
    return model.fit(_prepared(df, label, names)), names


def predict(model: RandomForestClassificationModel, names: list[str], df: DataFrame) -> DataFrame:
    """Rows with ``predicted`` and ``confidence``, the largest class probability."""
    width = df.select(F.size("raw").alias("w")).first()
    if width is not None and width["w"] != model.numFeatures:
        raise CatalogError(f"the model knows {model.numFeatures} features, the data have {width['w']}")
    scored = model.transform(df.withColumn("_v", array_to_vector(F.col("raw").cast("array<double>"))))
    label = F.get(F.array(*[F.lit(x) for x in names]), F.col("prediction").cast("int"))
    return scored.withColumn("predicted", label).withColumn("confidence", F.array_max(vector_to_array("probability"))).drop("_v", "rawPrediction", "probability", "prediction")


def out_of_fold(df: DataFrame, label: str, pos: str, folds: int = FOLDS, trees: int = TREES) -> DataFrame:
    """Every row predicted by a forest that was fitted without its fold.

    Each fold's predictions are written before the next forest is fitted, so the driver holds one forest at a time.
    """
    parted = checkpoint(stratified_folds(df, label, pos, folds))
    out = None
    for i in range(folds):
        test = parted.where(F.col("fold") == i)
        if test.isEmpty():
            continue
        model, names = fit_forest(parted.where(F.col("fold") != i).drop("fold"), label, trees)
        part = checkpoint(predict(model, names, test))
        del model
        gc.collect()  # the driver's JVM lets go of a model once Python does
        df.sparkSession.sparkContext._jvm.System.gc()
        out = part if out is None else out.unionByName(part)
    return out


def severities(df: DataFrame) -> DataFrame:
    """(label, severity, recommendation) as a DataFrame."""
    rows = [(k, v, RECOMMENDATION[k]) for k, v in SEVERITY.items()]
    return df.sparkSession.createDataFrame(rows, "label string, severity int, recommendation string")


def verdicts(predictions: DataFrame, support: DataFrame, folds: int = FOLDS) -> DataFrame:
    """key, predicted_label, confidence, severity, low_support, recommendation; ``support`` has label and support."""
    dim = severities(predictions)
    known = support.select(F.col("label").alias("_l"), (F.col("support") < folds).alias("low_support"))
    rows = predictions.select("key", F.col("predicted").alias("label"), "confidence")
    out = rows.join(F.broadcast(dim), "label", "left").join(known, F.col("label") == F.col("_l"), "left")
    return out.select("key", F.col("label").alias("predicted_label"), "confidence", "severity", F.coalesce("low_support", F.lit(True)).alias("low_support"), "recommendation")


def health_score(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """100 less the mean penalty as a share of the worst: severity times confidence, an undefined confidence counts 1."""
    penalty = F.col("severity") * F.nanvl(F.coalesce("confidence", F.lit(1.0)), F.lit(1.0))
    value = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (1 - F.avg(penalty) / max(SEVERITY.values()))))
    return df.groupBy(*(by or [])).agg(F.coalesce(value, F.lit(100.0)).alias("health"))


def health_by_label(df: DataFrame, label: str = "label") -> DataFrame:
    """Per label: rows, severity, mean confidence where defined, and total penalty."""
    conf = F.when(F.isnan("confidence"), None).otherwise(F.col("confidence"))
    penalty = F.col("severity") * F.nanvl(F.coalesce("confidence", F.lit(1.0)), F.lit(1.0))
    return df.groupBy(label).agg(F.count("*").alias("n"), F.max("severity").alias("severity"), F.avg(conf).alias("mean_confidence"), F.sum(penalty).alias("penalty"))


def importances(model: RandomForestClassificationModel, n: int = 10) -> list[tuple[int, float]]:
    """The n most important features, the most important first, ties by place."""
    values = model.featureImportances.toArray().tolist()
    return sorted(enumerate(values), key=lambda x: (-x[1], x[0]))[:n]


def baseline(df: DataFrame, label: str, pos: str, folds: int = FOLDS, trees: int = TREES) -> DataFrame:
    """F1 macro and accuracy of the forest's out-of-fold verdicts, fold by fold and over all: fold, n, accuracy, f1_macro."""
    found = checkpoint(out_of_fold(df, label, pos, folds, trees).select("fold", label, "predicted")).withColumn("truth", F.col(label).cast("string"))
    each = label_scores(found, "truth", ["fold"]).join(found.groupBy("fold").agg(F.count("*").alias("n")), "fold")
    return each.select("fold", "n", "accuracy", "f1_macro").unionByName(label_scores(found, "truth").select(F.lit(-1).alias("fold"), F.lit(found.count()).alias("n"), "accuracy", "f1_macro"))


def rarest(df: DataFrame, label: str, n: int = 4) -> DataFrame:
    """The n labels of least support, the fewest rows first."""
    return label_support(df, label).orderBy("support", label).limit(n)
