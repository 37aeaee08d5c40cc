"""The feature job: catalog rows to feature blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.functions import types
from colscope.functions.constants import CONCEPTS, TEMPERATURE, WORDINGS
from colscope.functions.embedding import Embedder, encode_distinct
from colscope.functions.text import clean_name, content_words, document, document_abbreviations
from colscope.functions.vectors import anchor_block, conflict_block, emptiness, hold, literal_matrix, similarities, type_mismatch, unit
from colscope.operators.features import attach_table_block, divergence, table_stats


def build_blocks(catalog: DataFrame, make: Callable[[], Embedder], text: str = "documents", mismatch: bool = False, mode: str = "hard", temperature: float = TEMPERATURE, prefix: str = "", include_table_comment: bool = True, wordings: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Catalog rows with e_text, e_type, e_rest, e_stat, e_table, e_conflict and its wordings, e_name, name_intrinsic.

    ``text`` is `documents` (their vectors) or `anchors` (concept similarities of the names). Prototypes are encoded once,
    on the driver; names and documents on the executors, each distinct text once.
    """
    wordings = wordings or WORDINGS
    embedder = make()

    def prototypes(texts: dict[str, str]):
        return literal_matrix([[float(x) for x in v] for v in embedder.encode(list(texts.values()))])

    rows = catalog.withColumns({"document": document(include_table_comment, prefix), "name_text": clean_name(F.col("column_name"), document_abbreviations())})
    rows = rows.withColumns({"e_type": types.type_block(F.col("data_type")), "e_rest": types.constraint_block(), "e_stat": types.stat_block(F.col("data_length"))})
    rows = hold(rows, _declared=types.declared_family())
    rows = encode_distinct(rows, "name_text", make, "_name").withColumn("e_name", unit(F.col("_name")))
    rows = hold(rows, _concepts=similarities(F.col("_name"), prototypes(CONCEPTS)))
    concepts = F.col("_concepts")
    if text == "anchors":
        rows = rows.withColumn("e_text", anchor_block(concepts, F.col("data_type")))
    else:
        rows = encode_distinct(rows, "document", make, "e_text")
        if mismatch:
            rows = rows.withColumn("e_text", F.concat("e_text", F.array(type_mismatch(concepts, F.col("data_type")))))
    for name, family in wordings.items():
        rows = hold(rows, **{f"_sims_{name}": similarities(F.col("_name"), prototypes(family))})
        sims = F.col(f"_sims_{name}")
        rows = rows.withColumn(f"e_conflict_{name}", conflict_block(sims, F.col("_declared"), F.col("is_primary_key"), F.col("is_foreign_key"), mode, temperature))
        if name == next(iter(wordings)):
            rows = rows.withColumn("_emptiness", emptiness(sims))
    first = next(iter(wordings))
    rows = rows.withColumn("e_conflict", F.col(f"e_conflict_{first}")).withColumn("e_conflict_variants", F.create_map(*[x for w in wordings for x in (F.lit(w), F.col(f"e_conflict_{w}"))])).drop(*[f"e_conflict_{w}" for w in wordings])
    words = encode_distinct(rows.select(F.explode(content_words(F.col("name_text"))).alias("word")).distinct(), "word", make, "vector")
    spread = divergence(rows, "pos", "name_text", words)
    rows = rows.join(spread, "pos").withColumn("name_intrinsic", F.array("_emptiness", "divergence"))
    return attach_table_block(rows, table_stats(catalog)).drop("_name", "_declared", "_emptiness", "divergence", "_concepts", *[f"_sims_{w}" for w in wordings])


def use_wording(blocks: DataFrame, wording: str) -> DataFrame:
    return blocks.withColumn("e_conflict", F.col("e_conflict_variants")[wording])
