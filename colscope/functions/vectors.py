"""Dense vectors in array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.functions.constants import CATEGORY, CONCEPTS, FAMILIES
from colscope.functions.types import category, concepts_allowed


def hold(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns that are computed once a row: the optimizer copies a projection into every place that reads it, but not
    across a generator.
    """
    for name, value in columns.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Scaled to length one; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    na, nb = norm(a), norm(b)
    return dot(a, b) / (F.when(na == 0, F.lit(1.0)).otherwise(na) * F.when(nb == 0, F.lit(1.0)).otherwise(nb))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def literal_matrix(rows: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in rows])


def similarities(v: Column, prototypes: Column) -> Column:
    """Cosine with each prototype."""
    return F.transform(prototypes, lambda p: cosine(v, p))


def first_argmax(sims: Column) -> Column:
    """Place of the largest value, from 0; the first among equals."""
    return F.array_position(sims, F.array_max(sims)).cast("int") - 1


def margin(sims: Column) -> Column:
    """Best less second best."""
    ranked = F.sort_array(sims, asc=False)
    return ranked[0] - ranked[1]


def one_hot(place: Column, width: int) -> Column:
    return F.array(*[(place == i).cast("double") for i in range(width)])


def softmax(sims: Column, temperature: float) -> Column:
    top = F.array_max(sims)
    raised = F.transform(sims, lambda x: F.exp((x - top) / F.lit(temperature)))
    return F.transform(raised, lambda x: x / total(raised))


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda x: x * F.log(x + F.lit(1e-12))))


def emptiness(sims: Column) -> Column:
    """How far a name is from every prototype."""
    return F.lit(1.0) - F.array_max(sims)


def type_mismatch(sims: Column, data_type: Column) -> Column:
    """How much nearer the best concept is than the best that the declared type may hold; 0 for unknown types."""
    of = category(data_type)
    out = F.lit(0.0)
    for name in sorted(set(CATEGORY.values())):
        allowed = [i for i, ok in enumerate(concepts_allowed(name)) if ok]
        best = F.array_max(F.array(*[sims[i] for i in allowed])) if allowed else None
        gap = F.greatest(F.lit(0.0), F.array_max(sims) - best) if allowed else F.lit(0.0)
        out = F.when(of == name, gap).otherwise(out)
    return out


def anchor_block(sims: Column, data_type: Column) -> Column:
    """Concept similarities and the type mismatch."""
    return F.concat(sims, F.array(type_mismatch(sims, data_type)))


def expectation(sims: Column, mode: str = "hard", temperature: float = 0.05) -> Column:
    """The families that a name suggests: one-hot of the nearest, or a softmax of the cosines."""
    if mode not in ("hard", "soft"):
        raise ValueError(f"mode must be hard or soft, not {mode!r}")
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    return one_hot(first_argmax(sims), len(FAMILIES)) if mode == "hard" else softmax(sims, temperature)


def conflict_block(sims: Column, declared: Column, primary_key: Column, foreign_key: Column, mode: str = "hard", temperature: float = 0.05) -> Column:
    """Fourteen numbers: expected less declared, declared, confidence, and whether a reference is unbacked.

    A name that reads as a reference is no conflict on a primary key, nor on a number or text without a foreign key; the
    latter is the finding of its own in the last place.
    """
    expected = expectation(sims, mode, temperature)
    confidence = margin(sims) if mode == "hard" else entropy(expected)
    reads = first_argmax(sims) == FAMILIES.index("reference")
    key, foreign = F.coalesce(primary_key, F.lit(False)), F.coalesce(foreign_key, F.lit(False))
    holds = (declared[FAMILIES.index("amount")] > 0) | (declared[FAMILIES.index("text")] > 0)
    unbacked = reads & ~key & ~foreign & holds
    diff = F.zip_with(expected, declared, lambda e, d: F.when(reads & key | unbacked, F.lit(0.0)).otherwise(e - d))
    return F.concat(diff, declared, F.array(confidence), F.array(unbacked.cast("double")))


def conflicting(block: Column) -> Column:
    """Whether any of the first six numbers of a conflict block is above a half."""
    return F.exists(F.slice(block, 1, len(FAMILIES)), lambda x: x > 0.5)


CONCEPT_ORDER = list(CONCEPTS)
