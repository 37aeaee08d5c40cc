"""Quality classifier: Naive Bayes support vectors over character n-gram indicators."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import cut, id_crc

#: Hashed feature space, longest n-gram in bytes and in words, labelled texts that training reads at most, bytes of text for
#: each time that a byte n-gram must occur to be indicated (so that very long texts do not indicate everything).
BITS, LONGEST, REPEATS, TRAIN_ROWS, RARE = 18, 4, 6, 4000, 1 << 16
THRESHOLD = 0.3


def features(data: bytes) -> np.ndarray:
    """Sorted hashed indicators of a text's n-grams; each text counts a gram once.

    Byte n-grams of 1 to LONGEST bytes, and 1 to REPEATS-grams of words over the alphabet {same as the word before it,
    another word}, which tell stuttering from prose in any vocabulary. A byte n-gram counts if it occurs once, and once
    more for every RARE bytes of text.
    """
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    seen = np.zeros(1 << BITS, bool)
    code, more = np.zeros(len(raw), np.uint32), len(raw) // RARE
    for n in range(1, LONGEST + 1):
        if len(raw) < n:
            break
        code = (code[: len(raw) - n + 1] << np.uint32(8)) | raw[n - 1 :]
        at = ((code * np.uint32(2654435761)) ^ np.uint32(n * 40503)) >> np.uint32(32 - BITS)
        if more:
            seen |= np.bincount(at, minlength=1 << BITS) > more
        else:
            seen[at] = True
    words = data.lower().split()
    same = np.fromiter(map(eq, words[1:], words), np.uint32, max(len(words) - 1, 0))
    code = np.zeros(len(same), np.uint32)
    for n in range(1, min(REPEATS, len(same)) + 1):
        code = (code[: len(same) - n + 1] << np.uint32(1)) | same[n - 1 :]
        seen[((code + np.uint32(n << 24)) * np.uint32(2246822519)) >> np.uint32(32 - BITS)] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, f: np.ndarray) -> float:
        return float(self.weights[f].sum() + self.bias) / max(1.0, len(f)) ** 0.5

    def score(self, f: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(f) + self.shift, -40, 40))))


class Rows:
    """Indicator rows, each as its grams or, if that is smaller, as one bit a gram: 32 KB a row at most."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed

    def __len__(self) -> int:
        return len(self.packed)

    def __getitem__(self, i: int) -> np.ndarray:
        return unpack(self.packed[i])


def pack(f: np.ndarray) -> bytes:
    if 4 * len(f) < 1 << (BITS - 3):
        return f.astype(np.int32).tobytes()
    seen = np.zeros(1 << BITS, bool)
    seen[f] = True
    return np.packbits(seen).tobytes()


def unpack(data: bytes) -> np.ndarray:
    if len(data) < 1 << (BITS - 3):
        return np.frombuffer(data, np.int32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8))).astype(np.int32)


def log_count_ratio(rows, keep: np.ndarray, y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log of (share of a gram in class 1) / (share in class 0), from smoothed counts of indicators of the rows ``keep``."""
    p, q = np.full(1 << BITS, smooth), np.full(1 << BITS, smooth)
    for i in keep:
        (p if y[i] > 0 else q)[rows[i]] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(rows, keep: np.ndarray, ratio: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Linear hinge-loss weights over rows x_i = ratio at the row's grams, scaled to unit length, plus a bias feature.

    Each step solves one dual variable exactly within [0, cost]; only the rows ``keep`` are used.
    """
    w, b, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(y))
    scale = np.zeros(len(y))
    for i in keep:
        scale[i] = 1.0 / max(float(np.linalg.norm(ratio[rows[i]])), 1e-9)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(keep):
            f = rows[i]
            x = ratio[f] * scale[i]
            gradient = y[i] * (w[f] @ x + b) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                w[f] += step * x
                b += step
    return w, b


def _sigmoid_fit(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling by Newton steps, with smoothed targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + c, -40, 40)))
        g, s = p - t, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * m * m).sum() + 1e-3, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-3]])
        da, dc = np.linalg.solve(h, [(g * m).sum(), g.sum()])
        a, c = a - da, c - dc
        if abs(da) + abs(dc) < 1e-9:
            break
    return float(a), float(c)


def fit(rows: Rows | list[np.ndarray], labels: np.ndarray, folds: int = 3) -> Model:
    """Weights from all rows; the sigmoid from margins that models of the other folds give."""
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    if len(rows) == 0 or len(set(y.tolist())) < 2:
        share = float((y > 0).mean()) if len(rows) else 0.5
        return Model(np.zeros(1 << BITS), 0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))

    def train(keep: np.ndarray) -> Model:
        ratio = log_count_ratio(rows, keep, y)
        w, b = dual_coordinate_descent(rows, keep, ratio, y)
        return Model(w * ratio, b, 1.0, 0.0)

    margins, fold = np.zeros(len(rows)), np.arange(len(rows)) % folds
    for k in range(folds):
        if len(set(y[fold != k].tolist())) == 2:
            m = train(np.flatnonzero(fold != k))
            for i in np.flatnonzero(fold == k):
                margins[i] = m.margin(rows[i])
    model = train(np.arange(len(rows)))
    model.slope, model.shift = _sigmoid_fit(margins, y)
    return model


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        f = [pack(features(t or b"")) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("quality"), pa.array(f, pa.binary())], names=["at", "quality", "f"])


def train_quality(docs: DataFrame, labels_table: DataFrame, train_rows: int = TRAIN_ROWS, folds: int = 5) -> Model:
    """Fit on at most ``train_rows`` labelled texts whose crc32(doc_id as text) mod ``folds`` is not 0.

    Every text of a labelled doc_id is a candidate, once however often its row repeats; those of the lowest hash of
    (doc_id, text) are taken, so the sample does not hang on the order of the rows. Labels of any numeric type are read
    as integers, above 0 is class 1; a doc_id with contradicting labels counts as class 0, as one mark against it is
    enough. Rows with a null id or label teach nothing. What reaches the driver is 32 KB a sampled text at most.
    """
    marked = labels_table.where(F.col("quality").isNotNull() & (F.pmod(id_crc(F.col("doc_id")), F.lit(folds)) != 0))
    usable = marked.groupBy(F.col("doc_id").alias("l_id")).agg((F.min("quality") > 0).cast("int").alias("quality"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    held = keyed.select("doc_id", "th").join(usable, F.col("doc_id") == F.col("l_id")).groupBy("doc_id", "th").agg(F.max("quality").alias("quality"))
    sample = cut(held.withColumn("at", F.xxhash64(F.lit(11), "doc_id", "th")).orderBy("at", "doc_id", "th").limit(train_rows))
    sample = sample.select(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th"), "quality", "at")
    chosen = keyed.join(F.broadcast(sample), (F.col("doc_id") == F.col("s_id")) & (F.col("th") == F.col("s_th"))).groupBy("doc_id", "th").agg(F.first("at").alias("at"), F.first("quality").alias("quality"), F.first("text").alias("text"))
    made = chosen.select("at", "quality", "text").mapInArrow(_feature_rows, "at long, quality int, f binary")
    got = sorted(((r["at"], bytes(r["f"]), r["quality"]) for r in made.toLocalIterator()), key=lambda x: x[:2])
    return fit(Rows([f for _, f, _ in got]), np.array([y for _, _, y in got]))


def score_quality(docs: DataFrame, model: Model, keep_columns: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text: ``keep_columns`` (default all of ``docs``), then score (0 to 1) and predicted (0 or 1).

    Defined cases: null and empty texts have no grams and get the score of the bias alone; columns of ``docs`` named
    score or predicted are replaced; an empty table gives no rows; without labels of both classes all scores are equal.
    """
    keep = [c for c in (keep_columns or docs.columns) if c not in ("score", "predicted")]
    small = Model(model.weights.astype(np.float32), model.bias, model.slope, model.shift)
    held = docs.sparkSession.sparkContext.broadcast(small)
    schema = docs.select(*[f"`{c}`" for c in keep]).schema.add("score", "double").add("predicted", "integer")
    at, n = "__text", len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            s = np.array([m.score(features(t or b"")) for t in batch.column(n).cast(pa.binary()).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return docs.select(*[f"`{c}`" for c in keep], F.col("text").alias(at)).mapInArrow(run, schema)
