"""Declared types as column expressions: canonical type, family, blocks of features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colscope.functions.constants import CANONICAL, CANONICAL_ORDER, CATEGORY, CATEGORY_FAMILY, CONCEPT_CATEGORIES, CONSTRAINT_ORDER, FAMILIES
from colscope.functions.text import literal_map


def canonical_type(data_type: Column) -> Column:
    """One of twelve types: capitals, cut at the first bracket and then the first blank; OTHER if unknown."""
    bare = F.substring_index(F.trim(F.substring_index(F.upper(F.coalesce(data_type, F.lit(""))), "(", 1)), " ", 1)
    return F.coalesce(F.element_at(literal_map(CANONICAL), bare), F.lit("OTHER"))


def type_block(data_type: Column) -> Column:
    """One-hot of the canonical type, in fixed order."""
    t = canonical_type(data_type)
    return F.array(*[(t == name).cast("float") for name in CANONICAL_ORDER])


def constraint_block() -> Column:
    return F.array(*[F.coalesce(F.col(c), F.lit(False)).cast("float") for c in CONSTRAINT_ORDER])


def stat_block(data_length: Column) -> Column:
    return F.array(F.log1p(F.coalesce(data_length, F.lit(0)).cast("double")).cast("float"))


def block_widths() -> dict[str, int]:
    return {"type": len(CANONICAL_ORDER), "rest": len(CONSTRAINT_ORDER), "stat": 1}


def category(data_type: Column) -> Column:
    """Storage category of a declared type by exact name, timestamps by their start; null if unknown."""
    t = F.upper(F.trim(F.coalesce(data_type, F.lit(""))))
    return F.element_at(literal_map(CATEGORY), F.when(t.startswith("TIMESTAMP"), "TIMESTAMP").otherwise(t))


def concepts_allowed(of: str | None) -> list[bool]:
    """For each concept, in order, whether the category may hold it."""
    return [of in allowed for allowed in CONCEPT_CATEGORIES.values()]


def stores_flag() -> Column:
    """NUMBER(1) without scale, or text of one character: how flags were stored."""
    t = F.upper(F.trim(F.coalesce("data_type", F.lit(""))))
    length = F.coalesce(F.nullif("char_length", F.lit(0)), F.col("data_length"))
    number = F.coalesce(F.col("data_precision") == 1, F.lit(False)) & (F.coalesce("data_scale", F.lit(0)) == 0)
    text = F.coalesce((length > 0) & (length <= 1), F.lit(False))
    return F.when(t == "NUMBER", number).when(t.isin("CHAR", "NCHAR", "VARCHAR2", "VARCHAR", "NVARCHAR2"), text).otherwise(False)


def declared_family() -> Column:
    """Multi-hot over the six families: by type, plus reference for a foreign key and boolean for a flag."""
    family = F.element_at(literal_map(CATEGORY_FAMILY), category(F.col("data_type")))
    extra = {"reference": F.coalesce(F.col("is_foreign_key"), F.lit(False)), "boolean": stores_flag()}
    return F.array(*[(F.coalesce(family == name, F.lit(False)) | extra.get(name, F.lit(False))).cast("double") for name in FAMILIES])


def generic_name(name: Column) -> Column:
    """Whether a name tells nothing: up to four capitals and up to four digits."""
    return name.rlike(r"^[A-Z]{1,4}_?[0-9]{0,4}$")
