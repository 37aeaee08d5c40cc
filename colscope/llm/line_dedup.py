"""Line dedup over overlapping three-line windows, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 3


def _text_key() -> Column:
    """The first 60 bits of a text's MD5, which any SQL engine can repeat."""
    return F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("_id"), _text_key().alias("_th"), F.split("text", "\n", -1).alias("_lines"))


def line_windows(docs: DataFrame) -> DataFrame:
    """One row per window of three consecutive lines: document key, position, 128 bits of hash."""
    lines = F.col("_lines")
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(SPAN), x).alias("b")))
    per_doc = _keyed(docs).select("_id", "_th", hashed.alias("_h"))
    h = F.col("_h")
    windows = F.transform(
        F.sequence(F.lit(0), F.size(h) - SPAN),
        lambda i: F.struct(
            F.xxhash64(*[h[i + k]["a"] for k in range(SPAN)]).alias("h1"),
            F.xxhash64(*[h[i + k]["b"] for k in range(SPAN)]).alias("h2"),
        ),
    )
    out = per_doc.select("_id", "_th", F.posexplode(F.when(F.size(h) >= SPAN, windows)).alias("pos", "w"))
    return out.select(F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"), F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_th").alias("th"), F.col("pos").alias("pos")).alias("at"))


def removed_spans(docs: DataFrame) -> DataFrame:
    """Per document key (_id, _th) the maximal covered line ranges, as a sorted array of (s, e), e exclusive."""
    windows = line_windows(docs)
    repeated = windows.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.max("at").alias("last")).where(F.col("first") < F.col("last")).select("h1", "h2", "first")
    later = windows.join(repeated, ["h1", "h2"]).where(F.col("at") > F.col("first")).select(F.col("at.id").alias("_id"), F.col("at.th").alias("_th"), F.col("at.pos").alias("pos")).distinct()
    in_doc = Window.partitionBy("_id", "_th").orderBy("pos")
    islands = later.withColumn("new", (F.col("pos") > F.coalesce(F.lag("pos").over(in_doc), F.lit(-SPAN - 1)) + SPAN).cast("int")).withColumn("island", F.sum("new").over(in_doc))
    spans = islands.groupBy("_id", "_th", "island").agg(F.min("pos").alias("s"), (F.max("pos") + SPAN).alias("e"))
    return spans.groupBy("_id", "_th").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """Remove every later occurrence of a repeated window of three lines.

    Lines are what stands between newline characters, compared as they are, blank ones included. A window is three
    consecutive lines of one document. Of equal windows the first by (doc_id, MD5 of the text, position) stays; the lines
    that any later one covers go, overlaps merged. All columns of ``docs`` are kept; ``text`` holds the lines that stay and these
    columns are appended (replacing any of the same name): n_lines, n_removed (long), spans (array of line ranges).

    Defined cases: null text has no lines and stays null; texts of fewer than three lines are never changed; null doc_ids
    come after all others; rows that repeat both doc_id and text count as one document and get the same result; other
    columns pass through whatever their names. A document whose lines all go gets an empty text and n_removed = n_lines.
    """
    spans = removed_spans(docs).withColumnsRenamed({"_id": "__s_id", "_th": "__s_th", "spans": "__spans"})
    keyed = docs.drop("n_lines", "n_removed", "spans").withColumn("__th", _text_key())
    joined = keyed.join(spans, keyed["doc_id"].eqNullSafe(F.col("__s_id")) & (F.col("__th") == F.col("__s_th")), "left")
    lines, cut = F.split("text", "\n", -1), F.col("__spans")
    kept = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size(cut)),
            lambda i: F.slice(
                lines,
                F.when(i == 0, 1).otherwise(F.get(cut, i - 1)["e"] + 1),
                F.when(i == F.size(cut), F.size(lines)).otherwise(F.get(cut, i)["s"]) - F.when(i == 0, 0).otherwise(F.get(cut, i - 1)["e"]),
            ),
        )
    )
    removed = F.coalesce(F.aggregate(cut, F.lit(0), lambda a, x: a + x["e"] - x["s"]), F.lit(0)).cast("long")
    return joined.select(
        *[F.when(cut.isNull(), F.col("text")).otherwise(F.concat_ws("\n", kept)).alias("text") if c == "text" else F.col(c) for c in keyed.columns if c != "__th"],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        removed.alias("n_removed"),
        F.coalesce(cut, F.array().cast("array<struct<s:int,e:int>>")).alias("spans"),
    )
