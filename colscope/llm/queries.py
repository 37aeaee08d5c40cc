"""The queries that apply each corpus operator to its whole table, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.llm.common import id_crc, read
from colscope.llm.decontaminate import contained_items
from colscope.llm.fingerprint import fingerprint_edits
from colscope.llm.html_tree import extract
from colscope.llm.jaccard import jaccard_components
from colscope.llm.language import identify, learn_profiles
from colscope.llm.line_dedup import line_dedup
from colscope.llm.packing import pack
from colscope.llm.quality import score_quality, train_quality
from colscope.llm.sharding import shard, shard_sql
from colscope.llm.suffix_dedup import remove_repeats


def _held_out(folds: int, remainder: int) -> Column:
    return F.coalesce(F.pmod(id_crc(F.col("doc_id")), F.lit(folds)) == remainder, F.lit(False)).alias("held_out")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, learn_profiles(docs, folds=3, held=1)).select("doc_id", _held_out(3, 1), "lang_pred", "score")


#: CRC-32 by table, as in ``shard_sql``; words are counted once a document, and ties of rank go by code point.
OP1_SQL = r"""
WITH tbl AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, text,
    coalesce(xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda h: ascii(h)::BIGINT), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295::BIGINT), 4294967295) % 3 = 1, false) AS held_out
  FROM documents, tbl),
w AS (
  SELECT rid, ' ' || word || ' ' AS p, count(*) AS n
  FROM (SELECT rid, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')) AS word FROM d) GROUP BY ALL),
g AS (
  SELECT rid, gram, sum(n) AS n
  FROM (SELECT rid, n, p[i:i + k - 1] AS gram FROM (SELECT rid, n, p, k, unnest(range(1, length(p) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS t(k)))
  WHERE gram <> ' ' GROUP BY ALL),
prof AS (
  SELECT lang, gram, r FROM (
    SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, length(gram), gram) - 1 AS r
    FROM g JOIN d USING (rid) WHERE lang IS NOT NULL AND doc_id IS NOT NULL AND NOT held_out GROUP BY lang, gram) WHERE r < 400),
top AS (SELECT * FROM (SELECT rid, gram, row_number() OVER (PARTITION BY rid ORDER BY n DESC, length(gram), gram) - 1 AS r FROM g) WHERE r < 400),
off AS (
  SELECT rid, l.lang, sum(coalesce(abs(prof.r - top.r), 400))::DOUBLE / (400 * count(*)) AS x
  FROM top CROSS JOIN (SELECT DISTINCT lang FROM prof) l LEFT JOIN prof ON prof.lang = l.lang AND prof.gram = top.gram GROUP BY ALL),
best AS (SELECT rid, lang, x, row_number() OVER (PARTITION BY rid ORDER BY x, lang) AS k FROM off)
SELECT d.doc_id, d.held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(1.0::DOUBLE - x, 0)::DOUBLE AS score
FROM d LEFT JOIN best ON best.rid = d.rid AND k = 1
"""


def op2_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(read(spark, sf_dir, "documents"))


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents")).drop("row")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = """
WITH d AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (
  SELECT doc_id, text, i AS pos, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS k
  FROM (SELECT doc_id, text, ls, unnest(range(1, greatest(len(ls) - 1, 1))) AS i FROM d)),
later AS (
  SELECT doc_id, text, pos FROM (SELECT *, rank() OVER (PARTITION BY k ORDER BY doc_id NULLS LAST, md5(text)[1:15], pos) AS r FROM w) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, text, pos + o AS line FROM later, (VALUES (0), (1), (2)) AS t(o)),
n AS (SELECT doc_id, text, count(*) AS n_removed, list(line) AS lines, count(*) FILTER (new) AS n_spans
      FROM (SELECT *, coalesce(line - lag(line) OVER (PARTITION BY doc_id, text ORDER BY line), 2) > 1 AS new FROM gone) GROUP BY ALL)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(coalesce(CASE WHEN lines IS NULL THEN text ELSE
    array_to_string(list_filter(list_transform(ls, lambda x, i: CASE WHEN list_contains(lines, i) THEN NULL ELSE x END), lambda x: x IS NOT NULL), chr(10)) END, '')) AS kept_sha256
FROM documents LEFT JOIN d USING (doc_id, text) LEFT JOIN n USING (doc_id, text)
"""


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT rid, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
e AS (
  SELECT a, b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.rid <> y.rid GROUP BY ALL)
  JOIN n p ON p.rid = a JOIN n q ON q.rid = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT rid, rid AS other FROM w UNION SELECT reach.rid, e.b FROM reach JOIN e ON e.a = reach.other)
SELECT w.doc_id, any_value(coalesce(n.n, 0))::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM reach JOIN w ON w.rid = reach.rid JOIN w o ON o.rid = reach.other LEFT JOIN n ON n.rid = w.rid GROUP BY w.rid, w.doc_id
"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train_quality(docs, read(spark, sf_dir, "labels"), folds=5)
    return score_quality(docs, model, ["doc_id"]).select("doc_id", _held_out(5, 0), "score", "predicted")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))


#: Windows are slices of the bytes; what is kept is put together as hexadecimal digits, two a byte.
OP9_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS h FROM documents),
w AS (SELECT rid, p, h[p + 1:p + 200] AS k FROM (SELECT rid, h, unnest(range(0, greatest(octet_length(h) - 199, 0))) AS p FROM d)),
many AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT rid, p, coalesce(p > lag(p) OVER (PARTITION BY rid ORDER BY p) + 200, true) AS new FROM w SEMI JOIN many USING (k)),
span AS (
  SELECT rid, min(p) AS s, max(p) + 200 AS e
  FROM (SELECT rid, p, sum(new::INT) OVER (PARTITION BY rid ORDER BY p) AS island FROM hit) GROUP BY rid, island),
kept AS (
  SELECT d.rid, string_agg(hex(h[s + 1:e]), '' ORDER BY s) AS k
  FROM d JOIN (
    SELECT rid, coalesce(lag(e) OVER o, 0) AS s, s AS e FROM span WINDOW o AS (PARTITION BY rid ORDER BY s)
    UNION ALL SELECT rid, max(e), 1000000000000 FROM span GROUP BY rid) USING (rid) GROUP BY d.rid),
n AS (SELECT rid, sum(e - s) AS n_removed, count(*) AS n_spans FROM span GROUP BY rid)
SELECT doc_id, octet_length(h)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(CASE WHEN k IS NULL THEN h ELSE unhex(k) END) AS kept_sha256
FROM d LEFT JOIN n USING (rid) LEFT JOIN kept USING (rid)
"""


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH i AS (SELECT DISTINCT item_id, text, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM benchmark),
d AS (SELECT DISTINCT doc_id, text, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents),
it AS (SELECT DISTINCT item_id, text, k, array_to_string(ws[j:j + k - 1], ' ') AS g FROM (
  SELECT item_id, text, ws, least(len(ws), 5) AS k, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) AS j FROM i WHERE len(ws) > 0)),
n AS (SELECT *, count(*) OVER (PARTITION BY item_id, text) AS n FROM it),
s AS (SELECT DISTINCT doc_id, text, k, array_to_string(ws[j:j + k - 1], ' ') AS g FROM (
  SELECT doc_id, text, ws, k, unnest(range(1, len(ws) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM it) WHERE len(ws) >= k))
SELECT s.doc_id, n.item_id, any_value(n.n)::BIGINT AS n_shingles, count(*)::BIGINT AS n_found, count(*)::DOUBLE / any_value(n.n) AS containment
FROM s JOIN n ON s.k = n.k AND s.g = n.g
GROUP BY s.doc_id, s.text, n.item_id, n.text HAVING count(*) >= 0.75 * any_value(n.n)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_lz_fingerprint": op2_lz_fingerprint,
    "op3_feistel_shards": op3_feistel_shards,
    "op4_line_dedup": op4_line_dedup,
    "op5_main_text": op5_main_text,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_quality": op7_quality,
    "op8_packing": op8_packing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_decontaminate": op10_decontaminate,
}
ORACLE_SQL: dict[str, str] = {
    "op1_language_id": OP1_SQL,
    "op3_feistel_shards": shard_sql(),
    "op4_line_dedup": OP4_SQL,
    "op6_ngram_jaccard": OP6_SQL,
    "op9_suffix_dedup": OP9_SQL,
    "op10_decontaminate": OP10_SQL,
}
