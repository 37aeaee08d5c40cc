"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colscope.llm.common import id_crc

#: Grams in a profile (of one to three characters), distinct words that a worker counts before it passes them on; runs that
#: hold all letters, and number forms that are none.
DEPTH, REMEMBERED = 400, 200_000
WORDS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def letter_words(text: str | None) -> list[str]:
    """Runs of letters (Unicode category L) in lower case; fractions, Roman numerals and the like part words."""
    runs = WORDS.findall((text or "").lower())
    if all(map(str.isalpha, runs)):
        return runs
    return [w for run in runs for w in ("".join([c if c.isalpha() else " " for c in run]).split() if not run.isalpha() else [run])]


def gram_codes(words: list[str], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """All n-grams of the words, each word between blanks, packed into 21 bits a code point; a blank alone is no gram.

    With a weight per word, also the weight of each gram.
    """
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    blank = c == 32
    pairs = (c[:-1] << 21) | c[1:]
    triples = (pairs[:-1] << 21) | c[2:]
    within, letters = ~blank[1:-1], ~blank
    codes = np.concatenate([c[letters], pairs, triples[within]])
    if weights is None:
        return codes, None
    of = weights[np.minimum(np.cumsum(blank) - 1, len(words) - 1)]
    return codes, np.concatenate([of[letters], of[:-1], of[:-2][within]])


def count_grams(words: list[str], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of the words, and their counts."""
    codes, of = gram_codes(words, weights)
    if of is None:
        codes.sort()
    else:
        order = np.argsort(codes, kind="stable")
        codes, of = codes[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.diff(np.append(first, len(codes))) if of is None else np.add.reduceat(of, first)


@dataclass
class Profiles:
    """langs in order; grams: sorted union of their profiles; ranks: a row per gram, DEPTH where a language lacks it."""

    langs: list[str]
    grams: np.ndarray
    ranks: np.ndarray


def ranked(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The DEPTH most frequent grams, most frequent first, ties by code."""
    short = counts.max(initial=0) < 1 << 16  # small numbers are sorted by radix
    return codes[np.argsort((65535 - counts).astype(np.uint16) if short else -counts, kind="stable")[:DEPTH]]


def out_of_place(top: np.ndarray, profiles: Profiles) -> np.ndarray:
    """Per language the summed rank differences as a share of the most that they could be."""
    at = np.minimum(np.searchsorted(profiles.grams, top), max(len(profiles.grams) - 1, 0))
    known = profiles.grams[at] == top
    ranks = np.where(known[:, None], profiles.ranks[at], DEPTH)
    off = np.abs(ranks - np.arange(len(top))[:, None])
    return np.where(ranks == DEPTH, DEPTH, off).sum(axis=0) / (DEPTH * len(top))


def predict(text: str | None, profiles: Profiles) -> tuple[str, float]:
    words = letter_words(text)
    if not words or not profiles.langs:
        return UNKNOWN, 0.0
    distance = out_of_place(ranked(*count_grams(words)), profiles)
    best = int(np.argmin(distance))
    return profiles.langs[best], float(1.0 - distance[best])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict[str, Counter] = defaultdict(Counter)

    def flush(lang: str) -> pa.RecordBatch:
        counted = words.pop(lang)
        codes, counts = count_grams(list(counted), np.fromiter(counted.values(), np.int64, len(counted)))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "gram", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words[lang].update(letter_words(text))
            if len(words[lang]) > REMEMBERED:
                yield flush(lang)
    for lang in [k for k, w in words.items() if w]:
        yield flush(lang)


def learn_profiles(docs: DataFrame, folds: int = 3, held: int = 1) -> Profiles:
    """Profiles from every row with a language whose crc32(doc_id as text) mod ``folds`` is not ``held``.

    Counts are summed on the executors; each language's DEPTH best rows come to the driver and nothing else does.
    """
    usable = docs.where(F.col("lang").isNotNull() & (F.pmod(id_crc(F.col("doc_id")), F.lit(folds)) != held)).select("lang", "text")
    sums = usable.mapInArrow(_count_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = sums.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= DEPTH)
    rows = best.collect()
    langs = sorted({r["lang"] for r in rows})
    grams = np.unique(np.array([r["gram"] for r in rows], np.int64))
    ranks = np.full((len(grams), len(langs)), DEPTH, np.int64)
    for r in rows:
        ranks[np.searchsorted(grams, r["gram"]), langs.index(r["lang"])] = r["r"] - 1
    return Profiles(langs, grams, ranks)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred and score (1 less the out-of-place share) of every whole text.

    Words are runs of letters in lower case. The most frequent DEPTH n-grams of a document are ranked, ties by code point,
    and held against each profile; the nearest language wins, the first by name among equals.

    Defined cases: null, empty and letterless texts are `und` with score 0, as is every text when nothing was learned;
    repeated rows give repeated results; a null doc_id is kept; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            found = [predict(t, known) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    schema = docs.select("doc_id").schema.add("lang_pred", "string").add("score", "double")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
