"""Registered queries over the driver's tables and a written-out catalog, with the SQL that each must equal."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.functions import text, types, vectors
from colscope.functions.constants import ABBREVIATIONS, CANONICAL_ORDER, CATEGORY, CONCEPT_CATEGORIES, CONCEPTS, CONFLICT_WEIGHTS, DEFAULT_WEIGHTS, RECOMMENDATION, SEVERITY, STRUCTURE_WEIGHTS, TEMPERATURE, WORDINGS
from colscope.functions.embedding import LetterCounts, letter_counts
from colscope.operators import clustering, features, forest, kernels, partitions
from colscope.operators.features import sweep_weights
from colscope.operators.reduction import Reducer
from colscope.plans import blind, experiments, fixtures, sql
from colscope.sources import catalog, labels, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def query(name: str, oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), "label")


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) + F.lit(0.0) for n in names})


SCORES = ("ari", "nmi", "ami", "v_measure")


def flat(df: DataFrame, keys: list[str], vector: str, places: int = 6) -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias("dim", "value")).withColumn("value", F.round(F.col("value").cast("double"), places) + F.lit(0.0))


# ── Partitions ──

CENTROIDS_SQL = f"""cent AS (SELECT label AS c, dim, avg(x) AS m FROM (SELECT label, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2),
cv AS (SELECT c, list(m ORDER BY dim) AS v FROM cent GROUP BY c),
sims AS (SELECT vec_id, label, c, {sql.cosine("e", "v")} AS s FROM (SELECT vec_id, label, list_transform(embedding, lambda q: q::DOUBLE) AS e FROM embeddings), cv),
near AS (SELECT vec_id, label, arg_max(c, s) AS c FROM sims GROUP BY vec_id, label)"""


def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding with the centroid that it is nearest to by cosine; a row per label is broadcast."""
    rows = points(spark, sf_dir)
    centres = partitions.centroid_vectors(rows, "label", "vector").withColumnRenamed("cluster", "c")
    sims = rows.crossJoin(F.broadcast(centres)).select("key", "label", "c", vectors.cosine(F.col("vector"), F.col("centroid")).alias("s"))
    return sims.groupBy("key", "label").agg(F.max_by("c", F.struct("s", -F.col("c"))).alias("cluster"))


@query("nearest_centroid_score", f"WITH {CENTROIDS_SQL}, {sql.agreement_ctes('SELECT 0 AS g, label AS t, c FROM near')} SELECT {sql.AGREE_COLUMNS}, (SELECT round(avg((label = c)::INT), 6) FROM near) AS accuracy FROM agree")
def nearest_centroid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest_centroid(spark, sf_dir).withColumn("g", F.lit(0))
    hit = near.groupBy("g").agg(F.avg((F.col("label") == F.col("cluster")).cast("double")).alias("accuracy"))
    return rounded(partitions.agreement(near, "label", "cluster", ["g"]).join(hit, "g").drop("g"), *SCORES, "accuracy")


@query("partition_metrics_orders", sql.agreement("SELECT 0 AS g, o_orderstatus AS t, o_orderpriority AS c FROM orders"))
def partition_metrics_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(partitions.agreement(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"), *SCORES)


@query("partition_metrics_docs", sql.agreement("SELECT 0 AS g, lang AS t, source AS c FROM documents"))
def partition_metrics_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(partitions.agreement(table(spark, sf_dir, "documents"), "lang", "source"), *SCORES)


@query("partition_metrics_by_group", f"WITH {sql.agreement_ctes('SELECT c_nationkey AS g, c_mktsegment AS t, c_custkey % 4 AS c FROM customer')} SELECT g AS c_nationkey, {sql.AGREE_COLUMNS} FROM agree")
def partition_metrics_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("c", F.col("c_custkey") % 4)
    return rounded(partitions.agreement(rows, "c_mktsegment", "c", ["c_nationkey"]), *SCORES)


@query("table_leakage_ari", f"WITH {sql.agreement_ctes('SELECT 0 AS g, vec_id % 20 AS t, label AS c FROM embeddings')} SELECT round(ari, 6) AS table_ari FROM agree")
def table_leakage_ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).withColumn("table_name", F.col("key") % 20)
    return rounded(partitions.agreement(rows, "table_name", "label").select(F.col("ari").alias("table_ari")), "table_ari")


VOTES_SQL = """votes AS (SELECT source, lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1, 2),
named AS (SELECT source, lang AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, first) AS r FROM votes) WHERE r = 1)"""


@query("majority_vote", f"WITH {VOTES_SQL} SELECT * FROM named")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.majority_labels(table(spark, sf_dir, "documents"), "lang", "source", "doc_id")


@query("cluster_naming", f"""WITH {VOTES_SQL}, d AS (SELECT lang AS t, predicted AS p FROM documents JOIN named USING (source)),
lab AS (SELECT t AS l FROM d UNION SELECT p FROM d),
f AS (SELECT l, 2.0 * (SELECT count(*) FROM d WHERE t = l AND p = l) / ((SELECT count(*) FROM d WHERE t = l) + (SELECT count(*) FROM d WHERE p = l)) AS f1 FROM lab)
SELECT (SELECT round(avg((t = p)::INT), 6) FROM d) AS accuracy, round(avg(f1), 6) AS f1_macro FROM f""")
def cluster_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = partitions.name_clusters(table(spark, sf_dir, "documents"), "lang", "source", "doc_id")
    return rounded(partitions.label_scores(named, "lang"), "accuracy", "f1_macro")


@query("score_bundle", f"""WITH {VOTES_SQL}, d AS (SELECT lang AS t, predicted AS p FROM documents JOIN named USING (source)), lab AS (SELECT t AS l FROM d UNION SELECT p FROM d),
f AS (SELECT avg(2.0 * (SELECT count(*) FROM d WHERE t = l AND p = l) / ((SELECT count(*) FROM d WHERE t = l) + (SELECT count(*) FROM d WHERE p = l))) AS f1 FROM lab),
{sql.agreement_ctes("SELECT 0 AS g, lang AS t, source AS c FROM documents UNION ALL SELECT 1, (doc_id % 10)::VARCHAR, source FROM documents")}
SELECT {sql.AGREE_COLUMNS}, (SELECT round(avg((t = p)::INT), 6) FROM d) AS accuracy, (SELECT round(f1, 6) FROM f) AS f1_macro, (SELECT round(ari, 6) FROM agree WHERE g = 1) AS table_ari FROM agree WHERE g = 0""")
def score_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("tab", (F.col("doc_id") % 10).cast("string"))
    return rounded(partitions.score(rows, "lang", "source", "doc_id", "tab"), *SCORES, "accuracy", "f1_macro", "table_ari")


@query("cluster_sizes", "SELECT CASE WHEN vec_id % 10 = 0 THEN -1 ELSE label END AS cluster, count(*) AS n, bool_or(vec_id % 10 = 0) AS is_noise FROM embeddings GROUP BY 1")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.cluster_sizes(noisy(spark, sf_dir), "cluster")


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with their label as cluster, a tenth of them noise."""
    return points(spark, sf_dir).withColumn("cluster", F.when(F.col("key") % 10 == 0, -1).otherwise(F.col("label")))


NOISY = "SELECT vec_id AS key, list_transform(embedding, lambda q: q::DOUBLE) AS v, CASE WHEN vec_id % 10 = 0 THEN -1 ELSE label END AS cluster, label FROM embeddings"


@query("cluster_centroids", f"SELECT cluster, dim, round(avg(x), 6) AS value FROM (SELECT cluster, unnest(range(0, len(v))) AS dim, unnest(v) AS x FROM ({NOISY}) WHERE cluster <> -1) GROUP BY 1, 2")
def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(partitions.centroids(noisy(spark, sf_dir), "cluster", "vector"), "value")


@query("cluster_members", "SELECT vec_id AS key FROM embeddings WHERE vec_id % 10 = 0")
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.members(noisy(spark, sf_dir), "cluster", -1).select("key")


@query("cluster_composition", """WITH b AS (SELECT source, count(*) AS n, count(DISTINCT doc_id % 10) AS n_tables FROM documents GROUP BY 1),
c AS (SELECT source, lang, count(*) AS c, min(doc_id) AS f FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c DESC, f) AS r FROM c),
t AS (SELECT source, string_agg(lang || ':' || c, ',' ORDER BY r) AS top_labels FROM r WHERE r <= 3 GROUP BY 1),
m AS (SELECT source, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS members FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 6 GROUP BY 1)
SELECT * FROM b JOIN t USING (source) JOIN m USING (source)""")
def cluster_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("tab", F.col("doc_id") % 10)
    return partitions.composition(rows, "source", "tab", "lang", "doc_id", "doc_id")


@query("table_dominant_label", """WITH c AS (SELECT source, lang, count(*) AS c, min(doc_id) AS f FROM documents WHERE lang <> 'en' GROUP BY 1, 2),
b AS (SELECT source, lang, c FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c DESC, f) AS r FROM c) WHERE r = 1), t AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
SELECT source, CASE WHEN coalesce(c / n >= 0.16, false) THEN lang ELSE 'sin_problema_de_tabla' END AS table_label FROM t LEFT JOIN b USING (source)""")
def table_dominant_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.dominant_labels(table(spark, sf_dir, "documents"), "source", "lang", "doc_id", clean="en", share=0.16)


@query("first_appearance", "SELECT source, min(doc_id) AS first FROM documents GROUP BY 1")
def first_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.first_seen(table(spark, sf_dir, "documents"), "source", "doc_id")


# ── Vectors and blocks ──


@query("degeneracy", """SELECT count(*) AS n_distinct, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6) AS tied_share, max(n) AS largest
FROM (SELECT round(l_quantity, 9), round(l_discount, 9), round(l_tax, 9), count(*) AS n FROM lineitem GROUP BY 1, 2, 3)""")
def degeneracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.degeneracy(table(spark, sf_dir, "lineitem").withColumn("v", F.array("l_quantity", "l_discount", "l_tax")), "v"), "tied_share")


def part_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("key"), F.array(F.col("p_size").cast("double"), "p_retailprice").alias("e_text"), F.array(*[(k % 3 == i).cast("double") for i in range(3)]).alias("e_type"),
        F.array((k % 2).cast("double"), F.lit(1.0)).alias("e_rest"), F.array(F.log1p("p_retailprice")).alias("e_stat"), F.array(*[(k % (i + 2)).cast("double") / (i + 2) for i in range(14)]).alias("e_conflict"),
    )


PART_BLOCKS = {
    "e_text": "SELECT p_partkey AS key, [p_size::DOUBLE, p_retailprice] AS v FROM part", "e_type": "SELECT p_partkey AS key, list_transform(range(0, 3), lambda i: (p_partkey % 3 = i)::INT::DOUBLE) AS v FROM part",
    "e_rest": "SELECT p_partkey AS key, [(p_partkey % 2)::DOUBLE, 1.0::DOUBLE] AS v FROM part", "e_stat": "SELECT p_partkey AS key, [ln(1 + p_retailprice)] AS v FROM part",
    "e_conflict": "SELECT p_partkey AS key, list_transform(range(0, 14), lambda i: (p_partkey % (i + 2))::DOUBLE / (i + 2)) AS v FROM part",
}


def _variance(block: str) -> str:
    return f"SELECT '{block}' AS block, sum(v) AS variance FROM (SELECT dim, var_pop(x) AS v FROM ({sql.long_form(PART_BLOCKS[block], 'key', 'v')}) GROUP BY dim)"


@query("variance_shares", f"WITH b AS ({' UNION ALL '.join(_variance(b) for b in ('e_text', 'e_type', 'e_rest', 'e_stat'))}) SELECT block, round(variance, 4) AS variance, round(variance / sum(variance) OVER (), 6) AS share FROM b")
def variance_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(features.block_variances(part_blocks(spark, sf_dir), ["e_text", "e_type", "e_rest", "e_stat"]), "share"), "variance", places=4)


@query("zscore_block", f"SELECT key, dim, round(z, 6) + 0 AS value FROM ({sql.zscores(sql.long_form(PART_BLOCKS['e_text'], 'key', 'v'))})")
def zscore_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(features.zscore(part_blocks(spark, sf_dir), "e_text", "z"), ["key"], "z")


@query("unit_variance_block", f"WITH l AS ({sql.long_form(PART_BLOCKS['e_type'], 'key', 'v')}), s AS (SELECT sqrt(sum(v)) AS s FROM (SELECT var_pop(x) AS v FROM l GROUP BY dim)) SELECT key, dim, round(x / s, 6) AS value FROM l, s")
def unit_variance_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(features.unit_variance(part_blocks(spark, sf_dir), "e_type", "u"), ["key"], "u")


@query("normalised_block", f"WITH z AS ({sql.zscores(sql.long_form(PART_BLOCKS['e_type'], 'key', 'v'))}) SELECT key, dim, round(z / sqrt((SELECT count(DISTINCT dim) FROM z WHERE std > 0)), 6) + 0 AS value FROM z")
def normalised_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(features.normalise(part_blocks(spark, sf_dir), "e_type", "u"), ["key"], "u")


CONFLICT_SCALED = f"""z AS ({sql.zscores(sql.long_form(PART_BLOCKS["e_conflict"], "key", "v"))}),
conf AS (SELECT key, dim, z / sqrt(CASE WHEN dim < 12 THEN 6 ELSE 1 END) * CASE WHEN dim < 6 THEN 1.0 WHEN dim < 12 THEN 0.7 WHEN dim = 12 THEN 0.5 ELSE 0.7 END AS value FROM z)"""


@query("conflict_subblocks", f"WITH {CONFLICT_SCALED} SELECT key, dim, round(value, 6) + 0 AS value FROM conf")
def conflict_subblocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(features.scale_conflict(part_blocks(spark, sf_dir)), ["key"], "e_conflict")


def _fused(block: str, weight: float, off: int) -> str:
    return f"SELECT key, dim + {off} AS dim, z / sqrt((SELECT greatest(count(DISTINCT dim), 1) FROM z_{block} WHERE std > 0)) * {weight} AS value FROM z_{block}"


@query("fused_phi", f"""WITH {", ".join(f"z_{b} AS ({sql.zscores(sql.long_form(PART_BLOCKS[b], 'key', 'v'))})" for b in ("e_text", "e_type", "e_rest", "e_stat"))}, {CONFLICT_SCALED},
tot AS (SELECT sqrt(sum(v)) AS s FROM (SELECT var_pop(value) AS v FROM conf GROUP BY dim)),
phi AS ({_fused("e_text", 0.2, 0)} UNION ALL {_fused("e_type", 0.3, 2)} UNION ALL {_fused("e_rest", 0.5, 5)} UNION ALL {_fused("e_stat", 0.1, 7)} UNION ALL SELECT key, dim + 8, value / s * 1.5 FROM conf, tot)
SELECT key, dim, round(value, 6) + 0 AS value FROM phi""")
def fused_phi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(features.fuse(part_blocks(spark, sf_dir), (0.2, 0.3, 0.5, 0.1, 0.0, 1.5)), ["key"], "phi")


@query("weights_grid", "SELECT a AS alpha, w.i AS part, round(CASE w.i WHEN 0 THEN a ELSE (1 - a) * w.b / 0.6 END, 6) AS weight FROM (VALUES (0.0::DOUBLE), (0.1), (0.25), (0.5), (0.75), (1.0)) t(a), (VALUES (0, 0.4::DOUBLE), (1, 0.3), (2, 0.25), (3, 0.05)) w(i, b)")
def weights_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(a, i, float(w)) for a in (0.0, 0.1, 0.25, 0.5, 0.75, 1.0) for i, w in enumerate(features.sweep_weights(a, DEFAULT_WEIGHTS)[:4])]
    return rounded(spark.createDataFrame(rows, "alpha double, part int, weight double"), "weight")


@query("variance_share_of_weights", "SELECT i AS part, round(w * w / sum(w * w) OVER (), 6) AS share FROM (VALUES (0, 0.4::DOUBLE), (1, 0.3), (2, 0.25), (3, 0.05), (4, 0.0), (5, 0.0)) t(i, w)")
def variance_share_of_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spark.createDataFrame(list(enumerate(features.weight_shares(DEFAULT_WEIGHTS))), "part int, share double"), "share")


@query("raw_features", f"""WITH w AS (SELECT p_partkey AS key, ln(1 + count(*) OVER (PARTITION BY p_brand)) AS w FROM part), t AS ({sql.long_form(PART_BLOCKS["e_text"], "key", "v")}), y AS ({sql.long_form(PART_BLOCKS["e_type"], "key", "v")}), r AS ({sql.long_form(PART_BLOCKS["e_rest"], "key", "v")}), s AS ({sql.long_form(PART_BLOCKS["e_stat"], "key", "v")})
SELECT key, dim, round(x, 6) AS value FROM t UNION ALL SELECT key, dim + 2, round(x, 6) FROM y UNION ALL SELECT key, dim + 5, round(x, 6) FROM r UNION ALL SELECT key, dim + 7, round(x, 6) FROM s UNION ALL SELECT key, 8, round(w, 6) FROM w""")
def raw_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_blocks(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("table_name")), "key")
    return flat(features.raw_features(rows), ["key"], "raw")


@query("subset_gather", "SELECT i AS out_pos, doc_id, n_chars FROM (SELECT unnest(range(0, 300)) AS i) JOIN documents ON doc_id = (i * 7) % 100")
def subset_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = spark.range(300).select(F.col("id").alias("out_pos"), ((F.col("id") * 7) % 100).alias("doc_id"))
    return features.gather(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), index, "doc_id").select("out_pos", "doc_id", "n_chars")


@query("whole_gather", "SELECT ((doc_id * 3 + i) * 48271) % 2147483647 AS out_pos, doc_id, n_chars FROM documents, (SELECT unnest(range(0, 3)) AS i)")
def whole_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document three times, at positions scattered by a congruence."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    copies = rows.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    index = copies.select("doc_id", (((F.col("doc_id") * 3 + F.col("i")) * 48271) % 2147483647).alias("out_pos"))
    return features.gather(rows, index, "doc_id").select("out_pos", "doc_id", "n_chars")


@query("drop_groups", "SELECT source, count(*) AS n FROM documents WHERE source NOT IN ('src0', 'src3') GROUP BY 1")
def drop_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumnRenamed("source", "table_name")
    return features.without_tables(rows, ["src0", "src3"]).groupBy(F.col("table_name").alias("source")).agg(F.count("*").alias("n"))


@query("key_split", "SELECT split_part(url, '.', 1) AS head, count(*) AS n FROM pages GROUP BY 1")
def key_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(text.table_of(F.col("url")).alias("head")).agg(F.count("*").alias("n"))


@query("table_similarity", f"""WITH m AS (SELECT label AS g, dim, avg(x) AS m FROM (SELECT label, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2), l AS (SELECT g, list(m ORDER BY dim) AS v FROM m GROUP BY g)
SELECT a.g AS g1, b.g AS g2, round({sql.cosine("a.v", "b.v")}, 6) AS cosine FROM l a, l b""")
def table_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.group_cosines(points(spark, sf_dir), "label", "vector"), "cosine")


# ── Names, types and documents over the written-out catalog ──


def name_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(fixtures.NAMES)), "pos int, name string")


NAMES_SQL = fixtures.values(["pos", "name"], list(enumerate(fixtures.NAMES)))


@query("camel_split", f"SELECT pos, {sql.camel('name')} AS out FROM ({NAMES_SQL})")
def camel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_rows(spark).select("pos", text.camel_split(F.col("name")).alias("out"))


@query("prefix_strip", f"SELECT pos, {sql.prefix(chr(114) + 'eplace(name, ' + chr(39) + '_' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ')')} AS out FROM ({NAMES_SQL})")
def prefix_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_rows(spark).select("pos", text.drop_prefix(text.underscore_split(F.col("name"))).alias("out"))


@query("abbrev_expand", f"SELECT pos, coalesce({sql.mapping(ABBREVIATIONS)}[trim(lower(name), '.,;:!?()[]{{}}')], name) AS out FROM ({NAMES_SQL})")
def abbrev_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_rows(spark).select("pos", text.expand_token(F.col("name")).alias("out"))


@query("name_pipeline", f"SELECT pos, CASE WHEN pos % 3 = 0 THEN {sql.name(chr(39) + 'tblEMP_Info' + chr(39), ABBREVIATIONS)} || ': ' ELSE '' END || {sql.name('name', ABBREVIATIONS)} || CASE WHEN pos % 4 = 1 THEN ' | nota' ELSE '' END AS out FROM ({NAMES_SQL})")
def name_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = name_rows(spark).withColumn("t", F.when(F.col("pos") % 3 == 0, "tblEMP_Info")).withColumn("c", F.when(F.col("pos") % 4 == 1, " nota ").otherwise("  "))
    return rows.select("pos", text.full_name(F.col("name"), F.col("t"), F.col("c")).alias("out"))


@query("name_pipeline_parts", f"SELECT p_partkey, {sql.name('p_type', ABBREVIATIONS)} AS out FROM part")
def name_pipeline_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.clean_name(F.col("p_type")).alias("out"))


def catalog_rows(spark: SparkSession) -> DataFrame:
    return catalog.catalog(fixtures.views(spark), fixtures.OWNER)


@query("catalog_assembly", f"WITH {fixtures.CATALOG_SQL} SELECT pos::INTEGER AS pos, table_name, column_name, data_type, nullable, data_length::INTEGER AS data_length, char_length::INTEGER AS char_length, is_primary_key, is_unique, is_indexed, fk_name IS NOT NULL AS is_foreign_key, fk_name, fk_references_table, comments, table_comment, row_count_approx FROM cat")
def catalog_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_rows(spark).select("pos", "table_name", "column_name", "data_type", "nullable", "data_length", "char_length", "is_primary_key", "is_unique", "is_indexed", "is_foreign_key", "fk_name", "fk_references_table", "comments", "table_comment", "row_count_approx")


@query("fk_resolution", f"WITH {fixtures.CATALOG_SQL} SELECT table_name, column_name, fk_name, ref_table, ref_column, position::INTEGER AS position FROM fk")
def fk_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.foreign_keys(fixtures.views(spark), fixtures.OWNER)


@query("pk_unique_flags", f"WITH {fixtures.CATALOG_SQL} SELECT kind, table_name, column_name FROM keyed WHERE kind IN ('P', 'U')")
def pk_unique_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fixtures.views(spark)
    return catalog.key_columns(v, fixtures.OWNER, "P").withColumn("kind", F.lit("P")).unionByName(catalog.key_columns(v, fixtures.OWNER, "U").withColumn("kind", F.lit("U")))


@query("fk_columns", f"WITH {fixtures.CATALOG_SQL} SELECT m.table_name, c.constraint_name AS fk_name, string_agg(m.column_name, ',' ORDER BY position) AS columns FROM all_constraints c JOIN all_cons_columns m USING (owner, constraint_name) WHERE c.owner = 'APP' AND constraint_type = 'R' GROUP BY 1, 2")
def fk_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.fk_columns(fixtures.views(spark), fixtures.OWNER).withColumn("columns", F.array_join("columns", ","))


@query("index_columns", f"WITH {fixtures.CATALOG_SQL} SELECT table_name, index_name, string_agg(column_name, ',' ORDER BY column_position) AS columns FROM all_ind_columns WHERE table_owner = 'APP' GROUP BY 1, 2")
def index_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.index_columns(fixtures.views(spark), fixtures.OWNER).withColumn("columns", F.array_join("columns", ","))


@query("redundant_indexes", f"""WITH {fixtures.CATALOG_SQL}, s AS (SELECT table_name, index_name, count(*) AS n, arg_min(column_name, column_position) AS column_name FROM all_ind_columns WHERE table_owner = 'APP' GROUP BY 1, 2)
SELECT c.table_name, c.column_name, max(s.index_name) AS single_index, c.index_name AS composite_index FROM s c JOIN s ON s.n = 1 AND c.n > 1 AND s.table_name = c.table_name AND s.column_name = c.column_name GROUP BY 1, 2, 4""")
def redundant_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.redundant_indexes(fixtures.views(spark), fixtures.OWNER)


@query("table_statistics", f"WITH {fixtures.view_sql('all_tab_statistics')} SELECT table_name, coalesce(stale_stats = 'YES', false) AS stale, num_rows, strftime(last_analyzed, '%Y-%m-%dT%H:%M:%S') AS last_analyzed FROM all_tab_statistics")
def table_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.statistics(fixtures.views(spark), fixtures.OWNER)


@query("constraint_status", f"WITH {fixtures.CATALOG_SQL} SELECT table_name, constraint_name, constraint_type, status, validated FROM all_constraints WHERE owner = 'APP' AND NOT (status IS NOT DISTINCT FROM 'ENABLED' AND validated IS NOT DISTINCT FROM 'VALIDATED')")
def constraint_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.weak_constraints(fixtures.views(spark), fixtures.OWNER)


@query("catalog_comments", f"WITH {fixtures.CATALOG_SQL} SELECT table_name, NULL::VARCHAR AS column_name, comments AS note FROM all_tab_comments WHERE owner = 'APP' AND comments IS NOT NULL UNION ALL SELECT table_name, column_name, comments FROM all_col_comments WHERE owner = 'APP' AND comments IS NOT NULL")
def catalog_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fixtures.views(spark)
    return catalog.table_comments(v, fixtures.OWNER).select("table_name", F.lit(None).cast("string").alias("column_name"), F.col("table_comment").alias("note")).unionByName(catalog.column_comments(v, fixtures.OWNER).withColumnRenamed("comments", "note"))


@query("catalog_rollups", f"""WITH {fixtures.CATALOG_SQL}, t AS (SELECT *, {sql.canonical("data_type")} AS type FROM cat)
SELECT CASE grouping(table_name, type) WHEN 1 THEN 'table' WHEN 2 THEN 'type' ELSE 'all' END AS level, coalesce(table_name, type, '') AS name, count(*) AS n, count(*) FILTER (is_primary_key) AS primary_keys, count(fk_name) AS foreign_keys, count(*) FILTER (is_unique) AS uniques, count(*) FILTER (nullable) AS nullables
FROM t GROUP BY GROUPING SETS ((table_name), (type), ())""")
def catalog_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.rollups(catalog_rows(spark))


@query("type_prose", f"WITH {fixtures.CATALOG_SQL} SELECT pos::INTEGER AS pos, {sql.TYPE_PROSE} AS prose FROM ({sql.TYPED})")
def type_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_rows(spark).select("pos", text.type_prose(F.col("data_type"), F.col("data_length"), F.col("data_precision"), F.col("data_scale")).alias("prose"))


@query("constraint_prose", f"WITH {fixtures.CATALOG_SQL} SELECT pos::INTEGER AS pos, {sql.CONSTRAINT_PROSE} AS prose FROM cat")
def constraint_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_rows(spark).select("pos", text.constraint_prose().alias("prose"))


ES = text.document_abbreviations()


@query("column_document", f"""WITH {fixtures.CATALOG_SQL}, s AS (SELECT pos, concat_ws(', ', 'tabla ' || {sql.name("table_name", ES)}, 'columna ' || {sql.name("column_name", ES)}, 'tipo ' || {sql.TYPE_PROSE}, {sql.CONSTRAINT_PROSE}) AS a,
 CASE WHEN trim(coalesce(table_comment, '')) <> '' THEN 'La tabla contiene: ' || trim(table_comment) END AS b, CASE WHEN trim(coalesce(comments, '')) <> '' THEN trim(comments) END AS c FROM ({sql.TYPED}))
SELECT pos::INTEGER AS pos, concat_ws('. ', rtrim(a, '. '), rtrim(b, '. '), rtrim(c, '. ')) || '.' AS document FROM s""")
def column_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_rows(spark).select("pos", text.document().alias("document"))


CANON = sql.canonical("data_type")


@query("type_onehot", f"WITH {fixtures.CATALOG_SQL}, t AS (SELECT pos, {CANON} AS t FROM cat) SELECT pos::INTEGER AS pos, unnest(range(0, 12))::INTEGER AS dim, unnest(list_transform({CANONICAL_ORDER}, lambda v: (v = t)::INT::DOUBLE)) AS value FROM t")
def type_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(catalog_rows(spark).withColumn("v", types.type_block(F.col("data_type"))), ["pos"], "v")


@query("constraint_bits", f"WITH {fixtures.CATALOG_SQL} SELECT pos::INTEGER AS pos, unnest(range(0, 5))::INTEGER AS dim, unnest([is_primary_key::INT, (fk_name IS NOT NULL)::INT, is_unique::INT, is_indexed::INT, nullable::INT])::DOUBLE AS value FROM cat")
def constraint_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(catalog_rows(spark).withColumn("v", types.constraint_block()), ["pos"], "v")


@query("stat_block", f"WITH {fixtures.CATALOG_SQL} SELECT pos::INTEGER AS pos, round(ln(1 + coalesce(data_length, 0)), 4) AS value FROM cat")
def stat_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(catalog_rows(spark).select("pos", types.stat_block(F.col("data_length"))[0].cast("double").alias("value")), "value", places=4)


@query("declared_family", f"WITH {fixtures.CATALOG_SQL} SELECT pos::INTEGER AS pos, unnest(range(0, 6))::INTEGER AS dim, unnest({sql.DECLARED}) AS value FROM ({sql.TYPED})")
def declared_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(catalog_rows(spark).withColumn("v", types.declared_family()), ["pos"], "v")


@query("generic_names", "SELECT pos, regexp_full_match(name, '[A-Z]{1,4}_?[0-9]{0,4}') AS generic FROM (" + NAMES_SQL + ")")
def generic_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_rows(spark).select("pos", types.generic_name(F.col("name")).alias("generic"))


def named_catalog(spark: SparkSession) -> DataFrame:
    rows = vectors.hold(catalog_rows(spark), name_text=text.clean_name(F.col("column_name"), ES))
    return vectors.hold(rows, _v=letter_counts(F.col("name_text")))


def prototypes(texts: dict[str, str]):
    return vectors.literal_matrix(LetterCounts().encode(list(texts.values())).tolist())


def proto_sql(texts: dict[str, str]) -> str:
    return "[" + ", ".join("[" + ", ".join(f"{x}::DOUBLE" for x in row) + "]" for row in LetterCounts().encode(list(texts.values()))) + "]"


def sims_sql(texts: dict[str, str]) -> str:
    """CTE ``s``: catalog rows with declared and sims."""
    return f"""WITH {fixtures.CATALOG_SQL}, nm AS (SELECT *, {sql.name("column_name", ES)} AS name_text FROM ({sql.TYPED})), lv AS (SELECT *, {sql.letters("name_text")} AS v, {sql.DECLARED} AS declared FROM nm),
s AS (SELECT *, list_transform({proto_sql(texts)}, lambda p: {sql.cosine("v", "p")}) AS sims FROM lv)"""


ORIG = WORDINGS["orig"]


def _conflict_sql(expected: str, confidence: str) -> str:
    return f"""{sims_sql(ORIG)}, e AS (SELECT *, {expected} AS expected, list_position(sims, list_max(sims)) = 3 AS reads FROM s),
u AS (SELECT *, reads AND NOT is_primary_key AND fk_name IS NULL AND (declared[2] > 0 OR declared[4] > 0) AS unbacked, {confidence} AS confidence FROM e),
b AS (SELECT pos, list_concat(list_transform(list_zip(expected, declared), lambda p: CASE WHEN (reads AND is_primary_key) OR unbacked THEN 0.0 ELSE p[1] - p[2] END), declared, [confidence], [unbacked::INT::DOUBLE]) AS v FROM u)
SELECT pos::INTEGER AS pos, unnest(range(0, 14))::INTEGER AS dim, round(unnest(v), 6) + 0 AS value FROM b"""


@query("conflict_block_hard", _conflict_sql("list_transform(range(1, 7), lambda i: (i = list_position(sims, list_max(sims)))::INT::DOUBLE)", "list_reverse_sort(sims)[1] - list_reverse_sort(sims)[2]"))
def conflict_block_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.hold(named_catalog(spark), sims=vectors.similarities(F.col("_v"), prototypes(ORIG)), declared=types.declared_family())
    return flat(rows.withColumn("v", vectors.conflict_block(F.col("sims"), F.col("declared"), F.col("is_primary_key"), F.col("is_foreign_key"))), ["pos"], "v")


SOFT = f"list_transform(list_transform(sims, lambda x: exp((x - list_max(sims)) / {TEMPERATURE})), lambda x: x / list_sum(list_transform(sims, lambda y: exp((y - list_max(sims)) / {TEMPERATURE}))))"


@query("conflict_block_soft", _conflict_sql(SOFT, "-list_sum(list_transform(expected, lambda p: p * ln(p + 1e-12)))"))
def conflict_block_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.hold(named_catalog(spark), sims=vectors.similarities(F.col("_v"), prototypes(ORIG)), declared=types.declared_family())
    return flat(rows.withColumn("v", vectors.conflict_block(F.col("sims"), F.col("declared"), F.col("is_primary_key"), F.col("is_foreign_key"), "soft", TEMPERATURE)), ["pos"], "v")


_ALLOWED = {c: [i + 1 for i, a in enumerate(CONCEPT_CATEGORIES.values()) if c in a] for c in sorted(set(CATEGORY.values()))}
_CATEGORY_SQL = f"CASE {sql.FAMILY} WHEN 'amount' THEN 'number' ELSE {sql.FAMILY} END"
MISMATCH_SQL = "CASE " + " ".join(f"WHEN {_CATEGORY_SQL} = '{c}' THEN greatest(0.0, list_max(sims) - list_max([{', '.join(f'sims[{i}]' for i in ix)}]))" for c, ix in _ALLOWED.items() if ix) + " ELSE 0.0 END"


@query("anchor_block", f"{sims_sql(CONCEPTS)} SELECT pos::INTEGER AS pos, unnest(range(0, 12))::INTEGER AS dim, round(unnest(list_concat(sims, [{MISMATCH_SQL}])), 6) AS value FROM s")
def anchor_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.hold(named_catalog(spark), sims=vectors.similarities(F.col("_v"), prototypes(CONCEPTS)))
    return flat(rows.withColumn("v", vectors.anchor_block(F.col("sims"), F.col("data_type"))), ["pos"], "v")


@query("conflicting_columns", _conflict_sql("list_transform(range(1, 7), lambda i: (i = list_position(sims, list_max(sims)))::INT::DOUBLE)", "0.0").split("SELECT pos::INTEGER AS pos, unnest(range(0, 14))")[0] + "SELECT pos::INTEGER AS pos, list_max(v[1:6]) > 0.5 AS conflicting FROM b")
def conflicting_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.hold(named_catalog(spark), sims=vectors.similarities(F.col("_v"), prototypes(ORIG)), declared=types.declared_family())
    block = vectors.conflict_block(F.col("sims"), F.col("declared"), F.col("is_primary_key"), F.col("is_foreign_key"))
    return rows.select("pos", vectors.conflicting(block).alias("conflicting"))


@query("type_mismatch", f"{sims_sql(CONCEPTS)} SELECT pos::INTEGER AS pos, round({MISMATCH_SQL}, 6) AS mismatch FROM s")
def type_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.hold(named_catalog(spark), sims=vectors.similarities(F.col("_v"), prototypes(CONCEPTS)))
    return rounded(rows.select("pos", vectors.type_mismatch(F.col("sims"), F.col("data_type")).alias("mismatch")), "mismatch")


@query("emptiness", f"{sims_sql(ORIG)} SELECT pos::INTEGER AS pos, round(1 - list_max(sims), 6) AS emptiness FROM s")
def emptiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.hold(named_catalog(spark), sims=vectors.similarities(F.col("_v"), prototypes(ORIG)))
    return rounded(rows.select("pos", vectors.emptiness(F.col("sims")).alias("emptiness")), "emptiness")


@query("divergence", f"""WITH w AS (SELECT p_partkey, list_filter(string_split({sql.name("p_type", ABBREVIATIONS)}, ' '), lambda w: length(w) > 1 AND w NOT IN ('de', 'del', 'la', 'el', 'los', 'las', 'o', 'y')) AS ws FROM part),
x AS (SELECT p_partkey, unnest(range(0, len(ws))) AS i, unnest(ws) AS word FROM w), v AS (SELECT *, {sql.letters("word")} AS v FROM x),
d AS (SELECT a.p_partkey, min({sql.cosine("a.v", "b.v")}) AS m FROM v a JOIN v b ON a.p_partkey = b.p_partkey AND a.i < b.i GROUP BY 1)
SELECT p_partkey, round(coalesce(1 - m, 0), 6) AS divergence FROM part LEFT JOIN d USING (p_partkey)""")
def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_partkey", text.clean_name(F.col("p_type")).alias("name"))
    words = names.select(F.explode(text.content_words(F.col("name"))).alias("word")).distinct().withColumn("vector", letter_counts(F.col("word")))
    return rounded(features.divergence(names, "p_partkey", "name", words), "divergence")


def siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).withColumn("name", (F.col("key") % 7).cast("string"))
    return features.sibling_signals(rows, "key", "label", "name", "vector")


SIBLINGS_SQL = f"""u AS (SELECT vec_id AS key, label, vec_id % 7 AS name, list_transform(e, lambda q: q / sqrt(list_sum(list_transform(e, lambda z: z * z)))) AS v FROM (SELECT *, list_transform(embedding, lambda q: q::DOUBLE) AS e FROM embeddings)),
flat AS (SELECT key, label, unnest(range(0, len(v))) AS dim, unnest(v) AS x FROM u), tot AS (SELECT label, dim, sum(x) AS s, count(*) AS n FROM flat GROUP BY 1, 2),
rest AS (SELECT key, label, list(s - x ORDER BY dim) AS r, any_value(n) AS n FROM flat JOIN tot USING (label, dim) GROUP BY 1, 2),
pr AS (SELECT a.key, a.label, avg({sql.cosine("a.v", "b.v")}) AS dummy, sum({sql.cosine("a.v", "b.v")}) AS ps, max(CASE WHEN a.name <> b.name THEN {sql.cosine("a.v", "b.v")} END) AS clash FROM u a JOIN u b ON a.label = b.label AND a.key <> b.key GROUP BY 1, 2),
het AS (SELECT label, 1 - sum(ps) / (count(*) * (count(*) - 1)) AS h FROM pr GROUP BY 1),
sib AS (SELECT u.key, u.label, 1 - {sql.cosine("u.v", "r")} AS atypical, coalesce(clash, 0) AS clash, h AS heterogeneity FROM u JOIN rest USING (key) JOIN pr USING (key) JOIN het ON het.label = u.label)"""


@query("sibling_signals", f"WITH {SIBLINGS_SQL} SELECT key, label, round(atypical, 6) AS atypical, round(clash, 6) AS clash, round(heterogeneity, 6) AS heterogeneity FROM sib")
def sibling_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(siblings(spark, sf_dir), "atypical", "clash", "heterogeneity")


@query("table_naming", f"WITH {SIBLINGS_SQL} SELECT label, round(avg((key % 5) / 5.0), 6) AS emptiness, round(avg((key % 3) / 3.0), 6) AS divergence, round(avg(atypical), 6) AS atypical, round(max(clash), 6) AS clash, round(avg(heterogeneity), 6) AS heterogeneity, round(avg((key % 2)::DOUBLE), 6) AS conflict_rate FROM sib GROUP BY label")
def table_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = siblings(spark, sf_dir).withColumns({"emptiness": (F.col("key") % 5) / 5.0, "divergence": (F.col("key") % 3) / 3.0, "conflicting": F.col("key") % 2})
    return rounded(features.table_naming(rows, "label"), "emptiness", "divergence", "atypical", "clash", "heterogeneity", "conflict_rate")


# ── The driver's own tables as a catalog ──

_TYPE = "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE data_type END"
_OWN = f"own AS (SELECT table_name, column_name, ordinal_position::INTEGER AS column_id, {_TYPE} AS data_type FROM information_schema.columns WHERE table_name IN ({', '.join(map(fixtures.literal, TABLES))}))"


def own_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.schema_catalog(spark, {t: table(spark, sf_dir, t) for t in TABLES})


@query("fixture_catalog", f"WITH {_OWN} SELECT * FROM own")
def fixture_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return own_catalog(spark, sf_dir).drop("nullable")


_STATS = f"{_OWN}, st AS (SELECT table_name, round(ln(1 + count(*)), 6) AS log_columns, 1.0::DOUBLE AS nullable_ratio, round(count(DISTINCT data_type) / count(*), 6) AS type_ratio, 0.0::DOUBLE AS generic_rate, round(avg((column_id % 2)::DOUBLE), 6) AS commented_ratio FROM own GROUP BY 1)"


def own_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.table_stats(own_catalog(spark, sf_dir).withColumn("comments", F.when(F.col("column_id") % 2 == 1, "x")))


@query("table_stats", f"WITH {_STATS} SELECT * FROM st")
def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(own_stats(spark, sf_dir), "log_columns", "nullable_ratio", "type_ratio", "generic_rate", "commented_ratio")


@query("table_block_attach", f"WITH {_STATS} SELECT o.table_name, o.column_name, d.dim::INTEGER AS dim, CASE d.dim WHEN 0 THEN coalesce(log_columns, 0) WHEN 1 THEN coalesce(nullable_ratio, 0) WHEN 2 THEN coalesce(type_ratio, 0) WHEN 3 THEN coalesce(generic_rate, 0) ELSE coalesce(commented_ratio, 0) END AS value FROM own o LEFT JOIN (SELECT * FROM st WHERE table_name <> 'events') s USING (table_name), (SELECT unnest(range(0, 5)) AS dim) d")
def table_block_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = own_stats(spark, sf_dir).where("table_name <> 'events'")
    return flat(features.attach_table_block(own_catalog(spark, sf_dir), known), ["table_name", "column_name"], "e_table")


@query("table_widths", f"WITH {_OWN} SELECT table_name, count(*) AS n_columns FROM own GROUP BY 1")
def table_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table_list(own_catalog(spark, sf_dir).withColumn("pos", F.col("column_id"))).select("table_name", "n_columns")


@query("schema_diff", "SELECT doc_id AS key, 'missing' AS status FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1) UNION ALL SELECT user_id, 'extra' FROM (SELECT doc_id AS user_id FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM documents WHERE lang = 'en')")
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a good label, and good labels of documents in other languages than English."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "lang")
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("key"))
    return catalog.schema_difference(docs, good, ["key"]).where("status = 'missing'").unionAll(catalog.schema_difference(docs.where("lang = 'en'"), good, ["key"]).where("status = 'extra'"))


@query("missing_labels", "SELECT source AS table_name, doc_id::VARCHAR AS column_name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = table(spark, sf_dir, "labels").join(docs.select("doc_id", "source"), "doc_id").select(F.upper("source").alias("table_name"), F.col("doc_id").cast("string").alias("column_name"))
    return labels.missing_labels(docs.select(F.col("source").alias("table_name"), F.col("doc_id").cast("string").alias("column_name")), known)


@query("pk_choice", f"""WITH {fixtures.CATALOG_SQL}, r AS (SELECT table_name, column_name, pos, CASE WHEN column_name = 'ID' THEN 0 WHEN column_name LIKE 'ID\\_%' ESCAPE '\\' OR column_name LIKE '%\\_ID' ESCAPE '\\' THEN 1 END AS k FROM cat WHERE data_type LIKE 'NUMBER%')
SELECT table_name, arg_min(column_name, k * 1000 + pos) AS pk_column FROM r WHERE k IS NOT NULL GROUP BY 1""")
def pk_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.choose_primary_key(catalog_rows(spark))


CORPUS = [("CLIENTES", "ID", "NUMBER"), ("CLIENTES", "NOMBRE", "VARCHAR2(50)"), ("PEDIDO", "PEDIDO_ID", "NUMBER(10)"), ("PEDIDO", "CLIENTE_ID", "NUMBER"), ("PEDIDO", "TIENDAS_ID", "NUMBER"), ("TIENDA", "ID", "NUMBER"), ("TIENDAS", "ID_TIENDA", "NUMBER"), ("TIENDAS", "TIENDA_ID", "NUMBER"), ("LINEA", "PEDIDO_ID", "NUMBER"), ("LINEA", "NADA_ID", "NUMBER"), ("LINEA", "CLIENTE_ID", "VARCHAR2(3)")]


@query("fk_inference", f"""WITH c AS ({fixtures.values(["pos", "table_name", "column_name", "data_type"], [(i, *r) for i, r in enumerate(CORPUS)])}),
k AS (SELECT table_name, arg_min(column_name, CASE WHEN column_name = 'ID' THEN 0 ELSE 1000 END + pos) AS pk FROM c WHERE data_type LIKE 'NUMBER%' AND (column_name = 'ID' OR column_name LIKE 'ID!_%' ESCAPE '!' OR column_name LIKE '%!_ID' ESCAPE '!') GROUP BY 1),
t AS (SELECT table_name, min(pos) AS first, any_value(pk) AS pk FROM c JOIN k USING (table_name) GROUP BY 1),
m AS (SELECT c.table_name, c.column_name, t.table_name AS ref_table, t.pk AS ref_column, row_number() OVER (PARTITION BY c.table_name, c.column_name ORDER BY first) AS r FROM c JOIN t ON c.column_name LIKE '%!_ID' ESCAPE '!' AND c.data_type LIKE 'NUMBER%' AND t.table_name <> c.table_name
 AND (t.table_name = c.column_name[:-4] OR t.table_name = c.column_name[:-4] || 'S' OR regexp_replace(t.table_name, 'S$', '') = c.column_name[:-4]))
SELECT table_name, column_name, ref_table, ref_column FROM m WHERE r = 1""")
def fk_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(CORPUS)], "pos int, table_name string, column_name string, data_type string")
    return catalog.infer_foreign_keys(rows, catalog.choose_primary_key(rows))


def raw_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixtures.RAW_LABELS, 'row long, table string, column string, data_type string, label string')


RAW_SQL = fixtures.values(["row", "tab", "col", "data_type", "label"], fixtures.RAW_LABELS)


@query("label_validation", f"SELECT row::BIGINT AS row, CASE WHEN trim(coalesce(label, '')) = '' THEN 'blank label' ELSE 'unknown label' END AS fault FROM ({RAW_SQL}) WHERE lower(trim(coalesce(label, ''))) NOT IN ({', '.join(map(fixtures.literal, SEVERITY))})")
def label_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.check_labels(raw_labels(spark)).select("row", "fault")


@query("label_dedupe", f"SELECT upper(tab) AS table_name, upper(col) AS column_name, arg_max(lower(trim(coalesce(label, ''))), row) AS label FROM ({RAW_SQL}) GROUP BY 1, 2")
def label_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.clean_labels(raw_labels(spark).fillna("", ["label"]))


@query("label_form", f"WITH {fixtures.CATALOG_SQL} SELECT table_name AS \"table\", column_name AS \"column\", data_type, '' AS label FROM cat")
def label_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.label_form(catalog_rows(spark))


@query("ddl_statements", f"""WITH c AS ({fixtures.values(["pos", "table_name", "column_name", "data_type"], [(i, *r) for i, r in enumerate(CORPUS)])}),
k AS (SELECT table_name, arg_min(column_name, CASE WHEN column_name = 'ID' THEN 0 ELSE 1000 END + pos) AS pk FROM c WHERE data_type LIKE 'NUMBER%' AND (column_name = 'ID' OR column_name LIKE 'ID!_%' ESCAPE '!' OR column_name LIKE '%!_ID' ESCAPE '!') GROUP BY 1)
SELECT table_name, 'CREATE TABLE "' || table_name || '" (' || chr(10) || string_agg('  "' || column_name || '" ' || data_type, ',' || chr(10) ORDER BY pos) || coalesce(',' || chr(10) || '  PRIMARY KEY ("' || any_value(pk) || '")', '') || chr(10) || ');' AS statement FROM c LEFT JOIN k USING (table_name) GROUP BY table_name""")
def ddl_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, *r, True) for i, r in enumerate(CORPUS)], "pos int, table_name string, column_name string, data_type string, nullable boolean")
    return sinks.create_table_statements(rows, catalog.choose_primary_key(rows))


@query("comment_statements", f"WITH {fixtures.CATALOG_SQL} SELECT table_name, column_name, 'COMMENT ON COLUMN \"' || table_name || '\".\"' || column_name || '\" IS ''' || replace(comments, '''', '''''') || '''' AS statement FROM all_col_comments WHERE comments IS NOT NULL AND table_name IN (SELECT table_name FROM cat)")
def comment_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = catalog.column_comments(fixtures.views(spark), fixtures.OWNER).withColumnRenamed("comments", "comment")
    return sinks.comment_statements(notes, catalog_rows(spark))


# ── Clusters ──


def nation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_nationkey").cast("long").alias("key")).agg(F.count("*").alias("n_columns"), F.avg("c_acctbal").alias("a"), F.max("c_acctbal").alias("b"), F.min("c_acctbal").alias("d"), F.countDistinct("c_mktsegment").alias("e")).select(F.concat(F.lit("n"), F.col("key").cast("string")).alias("table_name"), "key", "n_columns", F.array("a", "b", "d", F.col("e").cast("double")).alias("features"))


NATION_SQL = f"""nf AS (SELECT c_nationkey AS key, count(*) AS n, [avg(c_acctbal), max(c_acctbal), min(c_acctbal), count(DISTINCT c_mktsegment)::DOUBLE] AS v FROM customer GROUP BY 1),
z AS ({sql.zscores(sql.long_form("SELECT * FROM nf WHERE n >= 3", "key", "v"))}), sc AS (SELECT key, dim, z / sqrt((SELECT greatest(count(DISTINCT dim), 1) FROM z WHERE std > 0)) AS x FROM z),
md AS (SELECT dim, median(x) AS m FROM sc GROUP BY 1), ds AS (SELECT key, sqrt(sum((x - m) ** 2)) AS d FROM sc JOIN md USING (dim) GROUP BY 1),
fence AS (SELECT quantile_cont(d, 0.75) + 1.5 * (quantile_cont(d, 0.75) - quantile_cont(d, 0.25)) AS f FROM ds)"""


@query("tukey_fence", f"WITH {NATION_SQL} SELECT round(f, 6) AS fence FROM fence")
def tukey_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = nation_features(spark, sf_dir).where("n_columns >= 3")
    return rounded(clustering.tukey_fence(clustering.table_distances(judged), "d"), "fence")


ODD_SQL = f"""{NATION_SQL}, odd AS (SELECT key FROM ds, fence WHERE d > f), near AS (SELECT a.key AS a, b.key AS b FROM (SELECT key, list(x ORDER BY dim) AS v FROM sc GROUP BY 1) a, (SELECT key, list(x ORDER BY dim) AS v FROM sc GROUP BY 1) b, fence
 WHERE a.key IN (SELECT key FROM odd) AND b.key IN (SELECT key FROM odd) AND sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) ** 2))) <= f),
reach(a, b) AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a), root AS (SELECT a AS key, min(b) AS root FROM reach GROUP BY 1), grp AS (SELECT key, dense_rank() OVER (ORDER BY root) - 1 AS g FROM root)"""


@query("anomaly_groups", f"WITH RECURSIVE {ODD_SQL} SELECT 'n' || key AS table_name, coalesce(g, -1)::INTEGER AS grp FROM nf LEFT JOIN grp USING (key)")
def anomaly_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.flag_tables(nation_features(spark, sf_dir)).withColumn("grp", F.col("grp").cast("int"))


@query("combine_levels", f"WITH RECURSIVE {ODD_SQL} SELECT c_custkey AS key, (CASE WHEN g IS NULL THEN c_custkey % 6 ELSE 6 + g END)::INTEGER AS cluster FROM customer LEFT JOIN grp ON grp.key = c_nationkey")
def combine_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 6).cast("int").alias("cluster"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("table_name"))
    return clustering.combine_levels(rows, clustering.flag_tables(nation_features(spark, sf_dir))).select("key", F.col("cluster").cast("int").alias("cluster"))


_DIST = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"


@query("eps_knee", f"""WITH e AS ({NOISY}), d AS (SELECT a.key, b.key AS k, CASE WHEN a.key = b.key THEN 0 ELSE {_DIST} END AS d FROM e a, e b), r AS (SELECT key, d, row_number() OVER (PARTITION BY key ORDER BY d, k) AS r FROM d), kd AS (SELECT key, max(d) AS d FROM r WHERE r <= 6 GROUP BY 1),
c AS (SELECT d AS y, row_number() OVER (ORDER BY d) - 1 AS x, count(*) OVER () - 1.0 AS dx, max(d) OVER () - min(d) OVER () AS dy, min(d) OVER () AS lo FROM kd), t AS (SELECT *, (x * dx + (y - lo) * dy) / (dx * dx + dy * dy) AS t FROM c)
SELECT round(greatest(arg_min(y, -round((x - t * dx) ** 2 + (y - lo - t * dy) ** 2, 12) + x * 1e-15), 1e-6), 6) AS eps FROM t WHERE x > 0 AND x < dx""")
def eps_knee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clustering.knee(clustering.k_distances(points(spark, sf_dir))), "eps")


EPS, CORE = 0.62, 5


@query("dbscan", f"""WITH RECURSIVE e AS ({NOISY}), near AS MATERIALIZED (SELECT a.key AS a, b.key AS b FROM e a, e b WHERE a.key = b.key OR {_DIST} <= {EPS}), core AS (SELECT a AS key FROM near GROUP BY 1 HAVING count(*) >= {CORE}),
ce AS (SELECT a, b FROM near WHERE a IN (SELECT key FROM core) AND b IN (SELECT key FROM core)), reach(a, b) AS (SELECT a, b FROM ce UNION SELECT r.a, n.b FROM reach r JOIN ce n ON r.b = n.a),
root AS (SELECT a AS key, min(b) AS root FROM reach GROUP BY 1), cl AS (SELECT key, dense_rank() OVER (ORDER BY root) - 1 AS c FROM root)
SELECT e.key, coalesce(any_value(cl.c), min(o.c), -1)::INTEGER AS cluster FROM e LEFT JOIN cl ON cl.key = e.key LEFT JOIN near n ON n.a = e.key LEFT JOIN cl o ON o.key = n.b GROUP BY e.key""")
def dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.dbscan(points(spark, sf_dir), EPS, CORE)


@query("knn_reassign", f"""WITH e AS ({NOISY}), d AS (SELECT a.key, b.key AS k, b.cluster, row_number() OVER (PARTITION BY a.key ORDER BY {_DIST}, b.key) AS r FROM e a, e b WHERE a.cluster = -1 AND b.cluster <> -1),
v AS (SELECT key, cluster, count(*) AS n FROM d WHERE r <= 3 GROUP BY 1, 2), w AS (SELECT key, cluster, row_number() OVER (PARTITION BY key ORDER BY n DESC, cluster) AS r FROM v)
SELECT e.key, coalesce(w.cluster, e.cluster) AS cluster FROM e LEFT JOIN w ON w.key = e.key AND w.r = 1""")
def knn_reassign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.reassign_noise(noisy(spark, sf_dir)).select("key", "cluster")


def three_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = noisy(spark, sf_dir)
    return rows.select(F.lit(0).alias("view"), "key", "cluster").unionAll(rows.select(F.lit(1), "key", (F.col("key") % 50).cast("int"))).unionAll(rows.select(F.lit(2), "key", (F.col("label") * 7 + F.col("key") % 7).cast("int")))


@query("co_association", f"""WITH e AS ({NOISY}), v AS (SELECT 0 AS w, key, cluster FROM e UNION ALL SELECT 1, key, key % 50 FROM e UNION ALL SELECT 2, key, label * 7 + key % 7 FROM e)
SELECT a.key AS a, b.key AS b, round(count(*) / 3.0, 6) AS share FROM v a JOIN v b ON a.w = b.w AND a.cluster = b.cluster AND a.cluster <> -1 AND a.key < b.key GROUP BY 1, 2""")
def co_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clustering.co_association(three_views(spark, sf_dir)), "share")


@query("silhouette_euclid", f"""WITH e AS (SELECT key, v, label AS c FROM ({NOISY})), s AS (SELECT a.key, a.c AS ca, b.c AS cb, sum(CASE WHEN a.key = b.key THEN 0 ELSE {_DIST} END) AS s, count(*) AS n FROM e a, e b GROUP BY 1, 2, 3),
p AS (SELECT key, max(CASE WHEN ca = cb THEN s / greatest(n - 1, 1) END) AS own, max(CASE WHEN ca = cb THEN n END) AS n, min(CASE WHEN ca <> cb THEN s / n END) AS oth FROM s GROUP BY 1)
SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (oth - own) / greatest(oth, own) END), 6) AS silhouette FROM p""")
def silhouette_euclid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clustering.silhouette(points(spark, sf_dir).withColumnRenamed("label", "cluster")), "silhouette")


# ── Resamples ──

N_RESAMPLES = 20
_LOT = "(((key * 48271 + (b + 1) * 69621) % 2147483647) * ((key * 48271 + (b + 1) * 69621) % 2147483647) + 12345) % 2147483647"
def boot_sql(n: int) -> str:
    return f"""e AS (SELECT vec_id AS key, label, vec_id % 20 AS tab, CASE WHEN vec_id % 5 = 0 THEN 3 ELSE label END AS c1, CASE WHEN vec_id % 3 = 0 THEN 3 ELSE label END AS c2 FROM embeddings), b AS (SELECT unnest(range(0, {n})) AS b),
dr AS (SELECT b, e.*, row_number() OVER (PARTITION BY b ORDER BY {_LOT}, key) AS r FROM e, b), kept AS (SELECT * FROM dr WHERE r <= greatest(2, round_even(0.8 * (SELECT count(*) FROM e), 0))),
{sql.agreement_ctes("SELECT 'fifth:' || b || ':label' AS g, label AS t, c1 AS c FROM kept UNION ALL SELECT 'third:' || b || ':label', label, c2 FROM kept UNION ALL SELECT 'fifth:' || b || ':table', tab, c1 FROM kept UNION ALL SELECT 'third:' || b || ':table', tab, c2 FROM kept")},
boot AS (SELECT split_part(g, ':', 1) AS config, split_part(g, ':', 2)::INTEGER AS resample, max(CASE WHEN g LIKE '%label' THEN ari END) AS ari, max(CASE WHEN g LIKE '%label' THEN ami END) AS ami, max(CASE WHEN g LIKE '%table' THEN ari END) AS table_ari FROM agree GROUP BY 1, 2)"""


BOOT_SQL = boot_sql(N_RESAMPLES)


def boot(spark: SparkSession, sf_dir: str, n_resamples: int = N_RESAMPLES) -> DataFrame:
    ds = points(spark, sf_dir).withColumn("table_name", F.col("key") % 20)
    frozen = {name: ds.select("key", F.when(F.col("key") % n == 0, 3).otherwise(F.col("label")).alias("cluster")) for name, n in (("fifth", 5), ("third", 3))}
    return experiments.bootstrap(ds, frozen, n_resamples)


@query("bootstrap_fixed", f"WITH {BOOT_SQL} SELECT config, resample, round(ari, 6) AS ari, round(ami, 6) AS ami, round(table_ari, 6) AS table_ari FROM boot")
def bootstrap_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(boot(spark, sf_dir), "ari", "ami", "table_ari")


@query("bootstrap_fixed_200", f"WITH {boot_sql(200)} SELECT config, resample, round(ari, 6) AS ari, round(ami, 6) AS ami, round(table_ari, 6) AS table_ari FROM boot")
def bootstrap_fixed_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(boot(spark, sf_dir, 200), "ari", "ami", "table_ari")


@query("bootstrap_interval", f"WITH {BOOT_SQL} SELECT config, round(avg(ari), 6) AS mean, round(quantile_cont(ari, 0.025), 6) AS low, round(quantile_cont(ari, 0.975), 6) AS high FROM boot GROUP BY 1")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(experiments.intervals(boot(spark, sf_dir), "ari"), "mean", "low", "high")


@query("paired_difference", f"WITH {BOOT_SQL}, d AS (SELECT a.ari - b.ari AS d FROM boot a JOIN boot b USING (resample) WHERE a.config = 'fifth' AND b.config = 'third') SELECT round(avg(d), 6) AS mean, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, avg((d > 0)::INT) AS wins FROM d")
def paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(experiments.paired_difference(boot(spark, sf_dir), "fifth", "third", "ari"), "mean", "low", "high")


@query("wording_mean", f"WITH {BOOT_SQL} SELECT 'all' AS config, resample, round(avg(ari), 6) AS ari, round(avg(ami), 6) AS ami, round(avg(table_ari), 6) AS table_ari FROM boot GROUP BY 2")
def wording_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(experiments.mean_over_wordings(boot(spark, sf_dir).withColumn("config", F.lit("all"))), "ari", "ami", "table_ari")


# ── Health ──


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in SEVERITY])
    rows = table(spark, sf_dir, "labels").select("doc_id", F.get(names, (F.col("doc_id") % 10).cast("int")).alias("label"), F.when(F.col("doc_id") % 7 == 0, F.lit(float("nan"))).otherwise((F.col("doc_id") % 100) / 100.0).alias("confidence"))
    return rows.join(F.broadcast(forest.severities(rows)), "label")


JUDGED = f"j AS (SELECT doc_id, {list(SEVERITY)}[doc_id % 10 + 1] AS label, {list(SEVERITY.values())}[doc_id % 10 + 1] AS severity, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (doc_id % 100) / 100.0 END AS confidence FROM labels)"


@query("health_rollup", f"WITH {JUDGED} SELECT label, count(*) AS n, max(severity)::INTEGER AS severity, round(avg(confidence), 6) AS mean_confidence, round(sum(severity * coalesce(confidence, 1)), 6) AS penalty FROM j GROUP BY 1")
def health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(forest.health_by_label(judged(spark, sf_dir)), "mean_confidence", "penalty")


@query("health_score", f"WITH {JUDGED} SELECT round(greatest(0, least(100, 100 * (1 - avg(severity * coalesce(confidence, 1)) / 3))), 6) AS health FROM j")
def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(forest.health_score(judged(spark, sf_dir)), "health")


@query("low_support", "SELECT n_chars, count(*) AS support FROM documents GROUP BY 1 HAVING count(*) < 3")
def low_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.low_support(table(spark, sf_dir, "documents"), "n_chars", 3)


@query("rarest_labels", "SELECT lang, count(*) AS support FROM documents GROUP BY 1 ORDER BY 2, 1 LIMIT 2")
def rarest_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.rarest(table(spark, sf_dir, "documents"), "lang", 2)


@query("robustness_summary", f"WITH {sql.agreement_ctes("SELECT w AS g, label AS t, CASE WHEN vec_id % (w + 2) = 0 THEN 3 ELSE label END AS c FROM embeddings, (SELECT unnest(range(0, 3)) AS w)")} SELECT round(avg(ari), 6) AS mean, round(min(ari), 6) AS low, round(max(ari), 6) AS high, min(n_groups) AS least_groups FROM agree")
def robustness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).crossJoin(F.broadcast(spark.range(3).select(F.col("id").alias("w"))))
    rows = rows.withColumn("c", F.when(F.col("key") % (F.col("w") + 2) == 0, 3).otherwise(F.col("label")))
    return rounded(experiments.summarise_wordings(partitions.agreement(rows, "label", "c", ["w"])), "mean", "low", "high")


@query("operating_point", "SELECT c_nationkey AS cell, round(avg(c_acctbal), 6) AS validity FROM customer WHERE c_nationkey <> 3 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("cell")).agg(F.avg(F.when(F.col("c_nationkey") == 3, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))).alias("validity"))
    return rounded(experiments.choose_cell(cells), "validity")


@query("stratified_folds", """WITH c AS (SELECT quality, count(*) AS n, min(doc_id) AS f FROM labels GROUP BY 1), s AS (SELECT quality, n, coalesce(sum(n) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM c),
y AS (SELECT quality, unnest(range(st::BIGINT, (st + n)::BIGINT)) % 5 AS fold FROM s), al AS (SELECT quality, fold, count(*) AS k FROM y GROUP BY 1, 2), cu AS (SELECT *, sum(k) OVER (PARTITION BY quality ORDER BY fold) AS upto FROM al),
r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS r FROM labels)
SELECT doc_id, r.quality, min(fold)::INTEGER AS fold FROM r JOIN cu ON cu.quality = r.quality AND r.r <= upto GROUP BY 1, 2""")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.stratified_folds(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id")


# ── Sinks, scans and block jobs ──


@query("verdict_rows", f"WITH {VOTES_SQL} SELECT doc_id AS key, lang AS truth, source AS cluster_id, predicted FROM documents JOIN named USING (source)")
def verdict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = partitions.name_clusters(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "lang", "source", "doc_id")
    return sinks.verdict_rows(named.select(F.col("doc_id").alias("key"), F.col("lang").alias("truth"), F.col("source").alias("cluster"), "predicted"))


FAULTS = list(SEVERITY)
PREDICTED_SQL = f"p AS (SELECT doc_id AS key, ([{', '.join(map(fixtures.literal, FAULTS))}])[1 + (doc_id * doc_id) % {len(FAULTS)}] AS label, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (n_chars % 1000) / 999.0::DOUBLE END AS confidence FROM documents)"


@query("health_rows", f"""WITH {PREDICTED_SQL}, u AS (SELECT label, count(*) AS support FROM p GROUP BY 1 HAVING count(*) % 2 = 0),
s AS ({fixtures.values(["label", "severity", "recommendation"], [(k, v, RECOMMENDATION[k]) for k, v in SEVERITY.items()])})
SELECT key, p.label AS predicted_label, round(confidence, 4) AS confidence, severity::INTEGER AS severity, coalesce(support < 5, true) AS low_support, recommendation FROM p JOIN s USING (label) LEFT JOIN u USING (label)""")
def health_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict a row as the health file holds it; every other label has no support in the reference."""
    docs = table(spark, sf_dir, "documents")
    names = F.array(*[F.lit(x) for x in FAULTS])
    confidence = F.when(F.col("doc_id") % 7 == 0, F.lit(float("nan"))).otherwise((F.col("n_chars") % 1000) / F.lit(999.0))
    rows = docs.select(F.col("doc_id").alias("key"), F.get(names, ((F.col("doc_id") * F.col("doc_id")) % len(FAULTS)).cast("int")).alias("predicted"), confidence.alias("confidence"))
    support = rows.groupBy(F.col("predicted").alias("label")).agg(F.count("*").alias("support")).where("support % 2 = 0")
    return sinks.health_rows(forest.verdicts(rows, support))


@query("replace_block", "SELECT vec_id AS key, dim, round(v, 6) + 0 AS value FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS dim, unnest(list_reverse(embedding))::DOUBLE AS v FROM embeddings)")
def replace_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).withColumnRenamed("vector", "e_conflict")
    return flat(features.with_block(rows, F.reverse("e_conflict")), ["key"], "e_conflict")


@query("block_check", "SELECT count(*) AS n, min(len(embedding))::INTEGER AS low, max(len(embedding))::INTEGER AS high FROM embeddings")
def block_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check of the blocks' rows passes, or is an error; what it saw."""
    rows = points(spark, sf_dir).withColumnRenamed("vector", "e_text")
    features.assert_blocks(rows, ["e_text", "e_type"])
    return rows.agg(F.count("*").alias("n"), F.min(F.size("e_text")).alias("low"), F.max(F.size("e_text")).alias("high"))


@query("owner_names", "SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE upper(c_mktsegment) END AS owner FROM customer")
def owner_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners as they are typed: quoted, in small letters, or between blanks."""
    k, word = F.col("c_custkey") % 3, F.lower("c_mktsegment")
    typed = F.when(k == 0, F.concat(F.lit('"'), word, F.lit('"'))).when(k == 1, word).otherwise(F.concat(F.lit("  "), word, F.lit(" ")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), text.owner_name(typed).alias("owner"))


@query("prefixed_document", f"SELECT pos, 'query: ' || document AS document FROM ({ORACLE_SQL['column_document']})")
def prefixed_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_rows(spark).select("pos", text.document(prefix="query: ").alias("document"))


@query("corpus_scan", f"SELECT upper(trim(tab)) AS table_name, upper(trim(col)) AS column_name, data_type, label, row::BIGINT AS pos FROM ({RAW_SQL})")
def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.corpus_columns(raw_labels(spark))


@query("stored_blocks", f"SELECT key, dim, round(x, 6) + 0 AS value FROM ({sql.long_form(PART_BLOCKS['e_text'], 'key', 'v')})")
def stored_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks written and read again: in double width, whatever they were made in."""
    clustering.checkpoint(spark.range(1))  # a folder must be named
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/blocks-{uuid.uuid4().hex}"
    blocks = part_blocks(spark, sf_dir).select("key", F.col("e_text").cast("array<double>").alias("e_text"))
    sinks.write_blocks(blocks, folder, {"made_by": "stored_blocks"})
    return flat(sinks.read_blocks(spark, folder), ["key"], "e_text")


@query("view_sizes", f"WITH e AS ({NOISY}), v AS (SELECT 0 AS view, cluster FROM e UNION ALL SELECT 1, key % 50 FROM e UNION ALL SELECT 2, label * 7 + key % 7 FROM e) SELECT view, cluster::INTEGER AS cluster, count(*) AS n FROM v GROUP BY 1, 2")
def view_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views stacked into one table, as consensus reads them."""
    return three_views(spark, sf_dir).groupBy("view", "cluster").agg(F.count("*").alias("n"))


@query("k_distances", f"WITH e AS ({NOISY}), d AS (SELECT a.key, b.key AS k, CASE WHEN a.key = b.key THEN 0 ELSE {_DIST} END AS d FROM e a, e b), r AS (SELECT key, d, row_number() OVER (PARTITION BY key ORDER BY d, k) AS r FROM d) SELECT key AS q, round(max(d), 6) AS d FROM r WHERE r <= 6 GROUP BY 1")
def k_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clustering.k_distances(points(spark, sf_dir)), "d")


@query("svd_lengths", "SELECT vec_id AS key, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS length FROM embeddings")
def svd_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many singular directions as numbers turn the vectors and keep their lengths."""
    rows = points(spark, sf_dir)
    width = rows.select(F.size("vector").alias("w")).first()["w"]
    return rounded(Reducer("svd", width).fit_transform(rows).select("key", vectors.norm(F.col("reduced")).alias("length")), "length")


@query("pca_lengths", """WITH l AS (SELECT vec_id AS key, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT dim, avg(x) AS m FROM l GROUP BY 1)
SELECT key, round(sqrt(sum((x - m) ** 2)), 6) AS length FROM l JOIN m USING (dim) GROUP BY 1""")
def pca_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many principal directions as numbers turn the centred vectors and keep their lengths."""
    rows = points(spark, sf_dir)
    width = rows.select(F.size("vector").alias("w")).first()["w"]
    return rounded(Reducer("pca", width).fit_transform(rows).select("key", vectors.norm(F.col("reduced")).alias("length")), "length")


# ── Learned and iterative operators: no SQL form ──


@query("kmeans")
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.kmeans(points(spark, sf_dir), 10)


@query("agglomerative")
def agglomerative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.cluster(points(spark, sf_dir), "agglomerative", k=10)


@query("ward_silhouette")
def ward_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.ward(points(spark, sf_dir))


@query("meanshift")
def meanshift(spark: SparkSession, sf_dir: str) -> DataFrame:
    reduced = Reducer("pca", 3).fit_transform(points(spark, sf_dir)).select("key", F.col("reduced").alias("vector"))
    return kernels.cluster(reduced, "meanshift")


@query("hdbscan_grid")
def hdbscan_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = points(spark, sf_dir).withColumn("table_name", F.col("key") % 20)
    return experiments.grid_scores(ds, experiments.stability_grid(ds.select("key", "vector")))


@query("consensus")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.late_fusion(three_views(spark, sf_dir))


@query("pca")
def pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Reducer("pca", 20).fit_transform(points(spark, sf_dir)).select("key", F.posexplode("reduced").alias("dim", "value"))


@query("svd")
def svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Reducer("svd", 5).fit_transform(points(spark, sf_dir)).select("key", F.posexplode("reduced").alias("dim", "value"))


@query("tsne")
def tsne(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Reducer("tsne", 2).fit_transform(points(spark, sf_dir)).select("key", F.posexplode("reduced").alias("dim", "value"))


@query("cluster_description")
def cluster_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir)
    return clustering.describe(clustering.fit_predict(rows, "hdbscan", min_cluster_size=5, min_samples=2), rows)


@query("forest_baseline")
def forest_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).withColumn("raw", F.col("vector").cast("array<double>"))
    return forest.baseline(rows, "label", "key")


@query("forest_oof")
def forest_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).withColumn("raw", F.col("vector").cast("array<double>"))
    return forest.out_of_fold(rows, "label", "key").select("key", "label", "predicted", "confidence", "fold")


def dataset(spark: SparkSession) -> DataFrame:
    """The written-out catalog with all its blocks, encoded by letter counts, and its families as labels."""
    from colscope.plans.features import build_blocks

    blocks = build_blocks(clustering.checkpoint(catalog_rows(spark)), LetterCounts)  # one plan of both took over 1500 MB of the driver
    family = F.coalesce(types.category(F.col("data_type")), F.lit("other"))
    return clustering.checkpoint(blocks.withColumn("key", F.col("pos").cast("long")).withColumn("label", family))


@query("feature_blocks")
def feature_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset(spark).select("key", "table_name", "column_name", "document", "e_text", "e_type", "e_rest", "e_stat", "e_table", "e_conflict", "e_name", "name_intrinsic")


@query("two_level")
def two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.two_level_scores(dataset(spark), DEFAULT_WEIGHTS)


@query("robustness")
def robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.over_wordings(dataset(spark))


@query("bootstrap_pipeline")
def bootstrap_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blind pipeline again on each of 200 resamples, for all configurations of the verb."""
    return experiments.bootstrap_pipeline(blind.inputs(dataset(spark)), blind.configurations(names=True))


@query("algorithm_comparison")
def algorithm_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = dataset(spark)
    return experiments.compare_algorithms(ds, clustering.checkpoint(experiments.reduced(ds, DEFAULT_WEIGHTS)))


@query("evaluate")
def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.evaluate("fused", dataset(spark), DEFAULT_WEIGHTS)


@query("alpha_sweep")
def alpha_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.alpha_sweep(dataset(spark), DEFAULT_WEIGHTS)


@query("late_fusion_scores")
def late_fusion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.late_fusion_scores(dataset(spark), {"document": sweep_weights(1.0, DEFAULT_WEIGHTS), "structure": STRUCTURE_WEIGHTS, "conflict": CONFLICT_WEIGHTS})


@query("health_reference")
def health_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the written-out catalog by a forest that did not see the row."""
    ds = features.raw_features(dataset(spark))
    return sinks.health_rows(forest.verdicts(forest.out_of_fold(ds, "label", "key"), forest.label_support(ds, "label")))


@query("health_target")
def health_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on a target by a forest of the reference; here the target is the reference."""
    ds = features.raw_features(dataset(spark))
    model, names = forest.fit_forest(ds, "label")
    return sinks.health_rows(forest.verdicts(forest.predict(model, names, ds.drop("label")), forest.label_support(ds, "label")))
