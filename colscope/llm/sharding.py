"""Sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import cut

PRIME, ROUNDS = 2**31 - 1, 6


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Multiplier and offset of each round, by a multiplicative generator from the seed."""
    keys, x = [], (seed * 2 + 1) % PRIME
    for _ in range(ROUNDS):
        pair = []
        for _ in range(2):
            x = x * 48271 % PRIME
            pair.append(x)
        keys.append((pair[0], pair[1]))
    return keys


def grid(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square grid that holds n cells; at most one row of it is spare."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The image of row numbers below n: rounds over the two grid coordinates, walked on while outside [0, n)."""
    a, b = grid(n)
    out, todo = np.array(x, np.int64), np.arange(len(x))
    while len(todo):
        left, right = np.divmod(out[todo], b)
        for k, (mul, add) in enumerate(round_keys(seed)):
            t = ((right if k % 2 == 0 else left) * mul + add) % PRIME
            t = t * t % PRIME // 8
            if k % 2 == 0:
                left = (left + t) % a
            else:
                right = (right + t) % b
        out[todo] = left * b + right
        todo = todo[out[todo] >= n]
    return out


def number_rows(rows: DataFrame, keys: list[str], nulls_first: bool = False) -> tuple[DataFrame, int]:
    """Number all rows from 0 in the order of ``keys``, nulls last or first; equal rows are spread, whatever their number.

    A range sort, then a count per partition: only those counts, one a partition, pass through the driver.
    """
    salted = cut(rows.withColumn("_salt", F.monotonically_increasing_id()))
    ordered = salted.orderBy(*[F.col(k).asc_nulls_first() if nulls_first else F.col(k).asc_nulls_last() for k in keys], "_salt").drop("_salt")
    numbered = cut(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part, low = F.shiftright("_at", 33), F.lit((1 << 33) - 1)
    counts = sorted((r["p"], r["n"]) for r in numbered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(starts, "_p long, _start long")
    out = numbered.join(F.broadcast(offsets), part == F.col("_p")).withColumn("row", F.col("_start") + F.col("_at").bitwiseAND(low))
    return out.drop("_at", "_p", "_start"), total


def shard(docs: DataFrame, shards: int = 40, seed: int = 20240) -> DataFrame:
    """Deal all documents into ``shards`` shards under the law `rows`: counts are at most one apart.

    Rows are numbered by (doc_id, crc32 of the text, size); a keyed Feistel permutation of those numbers is the shuffle,
    so shard and slot of a row follow from its number, the row count and the seed alone. With y the image of the number,
    shard = y mod shards and slot = y div shards. Returns doc_id, size (UTF-8 bytes + 16), text_crc32, law, shard, slot,
    grown_shard (null: only the law `key` has it) and row.

    Defined cases: null text has size 16 and the crc of no bytes; null doc_ids come last; equal rows take neighbouring
    numbers in any order, which gives the same rows of the result; an empty table gives no rows; other columns are ignored.
    """
    data = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(data) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    numbered, total = number_rows(slim, ["doc_id", "text_crc32", "size"])

    @F.pandas_udf("long")
    def image(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), total, seed))

    placed = numbered.withColumn("_y", image("row"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("_y", F.lit(shards)).cast("int").alias("shard"), F.expr(f"_y div {int(shards)}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row")


def shard_sql(shards: int = 40, seed: int = 20240) -> str:
    """DuckDB SQL of the same result over the view ``documents``."""
    step, left, right = [], "l0", "r0"
    for k, (mul, add) in enumerate(round_keys(seed)):
        arg, t = (right, f"t{k}") if k % 2 == 0 else (left, f"t{k}")
        step.append(f"(({arg} * {mul} + {add}) % {PRIME}) AS u{k}")
        step.append(f"(u{k} * u{k} % {PRIME} // 8) AS {t}")
        if k % 2 == 0:
            step.append(f"(({left} + {t}) % a) AS l{k + 1}")
            left = f"l{k + 1}"
        else:
            step.append(f"(({right} + {t}) % b) AS r{k + 1}")
            right = f"r{k + 1}"
    feistel = f"SELECT row, n, a, b, x // b AS l0, x % b AS r0, {', '.join(step)}, {left} * b + {right} AS y"
    return f"""
WITH RECURSIVE tbl AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS bytes FROM documents),
s AS (
  SELECT rid, doc_id, octet_length(bytes) + 16 AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(bytes), '..'), lambda h: ('0x' || h)::BIGINT),
      lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM d, tbl),
r AS (SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY doc_id NULLS LAST, text_crc32, size) - 1 AS row, count(*) OVER () AS n FROM s),
g AS (SELECT row, n, a, greatest(1, (n + a - 1) // a) AS b FROM (SELECT row, n, floor(sqrt(greatest(n - 1, 0)))::BIGINT + 1 AS a FROM r)),
walk(row, n, a, b, y) AS (
  SELECT row, n, a, b, y FROM ({feistel} FROM (SELECT *, row AS x FROM g))
  UNION ALL
  SELECT row, n, a, b, y FROM ({feistel} FROM (SELECT row, n, a, b, y AS x FROM walk WHERE y >= n)))
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (y % {shards})::INTEGER AS shard, y // {shards} AS slot, NULL::INTEGER AS grown_shard
FROM r JOIN walk USING (row) WHERE y < walk.n
"""
