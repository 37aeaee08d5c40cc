"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import ascii_words, cut

WIDTH, AT_LEAST = 5, 0.75
#: Signature rows, and documents to verify, up to this number are broadcast (some 40 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def _shingles(words: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words; none if there are fewer. Widths never share a hash but by chance."""
    each = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(F.lit(width), *[words[i + k] for k in range(width)]))
    return F.when(F.size(words) >= width, each).otherwise(F.array().cast("array<bigint>"))


def item_shingles(items: DataFrame, at_least: float = AT_LEAST) -> DataFrame:
    """Distinct shingles of each item (one per item_id and text): item_id, ith, width, n, h and whether h signs the item.

    Items of fewer than five words have one shingle, as wide as they are. Items are partitioned by the binary order of
    their number n of shingles; all of a partition get signatures of one length, one more than the shingles that its
    largest member may lack. The signature is the item's lowest hashes (bottom-k MinHash). It serves as a filter with a
    guarantee, not as an estimate: a document that holds ``at_least`` of an item's shingles holds one of its signature.
    """
    words = items.select("item_id", F.xxhash64("text").alias("ith"), ascii_words(F.col("text")).alias("w")).where(F.size("w") > 0).dropDuplicates(["item_id", "ith"])
    own = _shingles(F.col("w"), WIDTH)
    for width in range(1, WIDTH):
        own = F.when(F.size("w") == width, _shingles(F.col("w"), width)).otherwise(own)
    sized = words.select("item_id", "ith", F.least(F.size("w"), F.lit(WIDTH)).alias("width"), F.array_sort(F.array_distinct(own)).alias("s")).withColumn("n", F.size("s"))
    most = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1
    lacking = F.floor(most * F.lit(1 - at_least) + F.lit(1e-9)).cast("int")
    return sized.select("item_id", "ith", "width", "n", lacking.alias("k"), F.posexplode("s").alias("rank", "h")).select("item_id", "ith", "width", "n", "h", (F.col("rank") <= F.col("k")).alias("signs"))


def contained_items(docs: DataFrame, items: DataFrame, at_least: float = AT_LEAST) -> DataFrame:
    """Every (document, item) with at least ``at_least`` of the item's distinct five-word shingles in the document.

    Returns doc_id, item_id, n_shingles (the item's), n_found, containment. Words are as in ``ascii_words``. A document is
    a (doc_id, text), an item an (item_id, text): two texts under one item_id are two items and never add up.

    The corpus is read and shingled once; only documents that meet a signature are read again and counted exactly.

    Defined cases: null or empty texts on either side match nothing; items of fewer than five words count as one shingle
    of their own width; documents too short for a width have no shingles of it; rows that repeat id and text are one, on
    both sides; a null doc_id or item_id is reported as null; other columns are ignored.
    """
    shingles = cut(item_shingles(items, at_least))
    found = shingles.groupBy("width").agg(F.count("*").alias("n")).collect()
    widths = sorted(r["width"] for r in found)
    if not widths:
        return shingles.select(*[F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "item_id"], *[F.lit(0).cast(t).alias(c) for c, t in (("n_shingles", "long"), ("n_found", "long"), ("containment", "double"))]).limit(0)
    hinted = F.broadcast if sum(r["n"] for r in found) <= BROADCAST_ROWS else (lambda x: x)
    base = docs.select(F.col("doc_id").alias("d_id"), F.xxhash64("text").alias("d_th"), "text")

    def probes(source: DataFrame, extra: list[str]) -> DataFrame:
        split = source.select(*extra, ascii_words(F.col("text")).alias("w"))
        return split.select(*extra, F.explode(F.concat(*[_shingles(F.col("w"), width) for width in widths])).alias("h"))

    signed = shingles.where("signs").select("item_id", "ith", "h")
    hits = cut(probes(base, ["d_id", "d_th"]).join(hinted(signed), "h").select("d_id", "d_th", "item_id", "ith").distinct())
    wanted = hits.groupBy("d_id", "d_th").agg(F.collect_list(F.struct("item_id", "ith")).alias("cand")).select(F.col("d_id").alias("c_id"), F.col("d_th").alias("c_th"), "cand")
    wanted = F.broadcast(wanted) if hits.count() <= BROADCAST_ROWS else wanted
    searched = base.join(wanted, F.col("d_id").eqNullSafe(F.col("c_id")) & (F.col("d_th") == F.col("c_th"))).select("d_id", "d_th", "text", "cand")
    exact = (
        probes(searched, ["d_id", "d_th", "cand"]).join(hinted(shingles.select("item_id", "ith", "n", "h")), "h")
        .where(F.exists("cand", lambda c: c["item_id"].eqNullSafe(F.col("item_id")) & (c["ith"] == F.col("ith"))))
        .select("d_id", "d_th", "item_id", "ith", "n", "h").distinct()
        .groupBy("d_id", "d_th", "item_id", "ith", "n").agg(F.count("*").alias("n_found"))
    )
    containment = F.col("n_found") / F.col("n")
    return exact.where(containment >= at_least).select(F.col("d_id").alias("doc_id"), "item_id", F.col("n").cast("long").alias("n_shingles"), F.col("n_found").cast("long").alias("n_found"), containment.alias("containment"))
