"""Names and documents as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from colscope.functions.constants import ABBREVIATIONS, ABBREVIATIONS_ES, JOINERS, PREFIXES, TYPE_SENTENCES

_EDGES = ".,;:!?()[]{}"
_LOW, _UP = "a-záéíóúñ", "A-ZÁÉÍÓÚÑ"


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def document_abbreviations() -> dict[str, str]:
    """The expansions for documents: Spanish ones win."""
    return ABBREVIATIONS | ABBREVIATIONS_ES


def camel_split(text: Column) -> Column:
    """A blank where a capital follows a small letter, and before the last capital of a run that a small letter follows."""
    step = F.regexp_replace(text, f"([{_LOW}])([{_UP}])", "$1 $2")
    return F.regexp_replace(step, f"([{_UP}]+)([{_UP}][{_LOW}])", "$1 $2")


def underscore_split(text: Column) -> Column:
    return F.translate(text, "_", " ")


def drop_prefix(text: Column) -> Column:
    """Without the first redundant prefix, then trimmed; other texts stay as they are."""
    pattern = f"(?i)^({'|'.join(PREFIXES)}) "
    return F.when(text.rlike(pattern), F.trim(F.regexp_replace(text, pattern, ""))).otherwise(text)


def expand_token(token: Column, abbreviations: dict[str, str] | None = None) -> Column:
    """The expansion of a token, looked up in lower case without punctuation at its ends; else the token itself."""
    known = literal_map(abbreviations or ABBREVIATIONS)
    return F.coalesce(F.element_at(known, F.btrim(F.lower(token), F.lit(_EDGES))), token)


def _lower_capitals(token: Column) -> Column:
    return F.when((F.upper(token) == token) & (F.lower(token) != token), F.lower(token)).otherwise(token)


def clean_name(name: Column, abbreviations: dict[str, str] | None = None) -> Column:
    """Camel and underscore split, prefix dropped, abbreviations expanded, all-capital tokens in lower case."""
    tokens = F.filter(F.split(drop_prefix(underscore_split(camel_split(name))), r"\s+"), lambda t: t != "")
    return F.array_join(F.transform(tokens, lambda t: _lower_capitals(expand_token(t, abbreviations))), " ")


def full_name(name: Column, table: Column | None = None, comment: Column | None = None, abbreviations: dict[str, str] | None = None) -> Column:
    """`table: name | comment`, each part only where it is there."""
    out = clean_name(name, abbreviations)
    if table is not None:
        out = F.when(F.coalesce(table, F.lit("")) != "", F.concat(clean_name(table, abbreviations), F.lit(": "), out)).otherwise(out)
    if comment is not None:
        out = F.when(F.trim(F.coalesce(comment, F.lit(""))) != "", F.concat(out, F.lit(" | "), F.trim(comment))).otherwise(out)
    return out


def type_prose(data_type: Column, length: Column, precision: Column, scale: Column) -> Column:
    """A declared type in Spanish words: the first sentence of TYPE_SENTENCES that fits it and has all its numbers."""
    declared = F.upper(F.trim(F.coalesce(data_type, F.lit(""))))
    numbers = {"length": F.nullif(length, F.lit(0)).cast("string"), "digits": F.coalesce(F.nullif(precision, F.lit(0)).cast("string"), F.lit("varios")), "scale": F.nullif(scale, F.lit(0)).cast("string")}

    def sentence(words: str) -> Column:
        """Null if a number is missing."""
        parts = re.split(r"[{}]", words)
        return F.concat(*[numbers[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)])

    fitting = [F.when(declared.rlike(f"^({pattern})$"), sentence(words)) for pattern, words in TYPE_SENTENCES]
    return F.coalesce(*fitting, F.nullif(F.lower(declared), F.lit("")), F.lit("tipo desconocido"))


def constraint_prose() -> Column:
    """Nullability, keys, index and default of a catalog row in Spanish words."""
    target = F.col("fk_references_table")
    return F.concat_ws(
        ", ",
        F.when(F.col("nullable"), "admite nulos").otherwise("obligatorio"),
        F.when(F.col("is_primary_key"), "es clave primaria"),
        F.when(F.col("is_foreign_key") & (F.coalesce(target, F.lit("")) != ""), F.concat(F.lit("es clave foranea hacia "), F.lower(target))).when(F.col("is_foreign_key"), "es clave foranea"),
        F.when(F.col("is_unique"), "con valores unicos"),
        F.when(F.col("is_indexed"), "indexada"),
        F.when(F.coalesce(F.col("default_value"), F.lit("")) != "", F.concat(F.lit("con valor por defecto "), F.trim("default_value"))),
    )


def document(include_table_comment: bool = True, prefix: str = "") -> Column:
    """The Spanish sentence that describes a catalog row, with its comments."""
    words = document_abbreviations()
    first = F.concat_ws(", ", F.concat(F.lit("tabla "), clean_name(F.col("table_name"), words)), F.concat(F.lit("columna "), clean_name(F.col("column_name"), words)), F.concat(F.lit("tipo "), type_prose(F.col("data_type"), F.col("data_length"), F.col("data_precision"), F.col("data_scale"))), constraint_prose())
    sentences = [first]
    if include_table_comment:
        sentences.append(F.when(F.trim(F.coalesce("table_comment", F.lit(""))) != "", F.concat(F.lit("La tabla contiene: "), F.trim("table_comment"))))
    sentences.append(F.when(F.trim(F.coalesce("comments", F.lit(""))) != "", F.trim("comments")))
    return F.concat(F.lit(prefix), F.concat_ws(". ", *[F.rtrim(s, F.lit(". ")) for s in sentences]), F.lit("."))


def content_words(name: Column) -> Column:
    """The words of a clean name that carry meaning: longer than a letter and no joiner."""
    return F.filter(F.split(name, " "), lambda w: (F.length(w) > 1) & ~w.isin(JOINERS))


def owner_name(owner: Column) -> Column:
    """An owner as the catalog stores it: quoted ones without their quotes, others in capitals."""
    bare = F.trim(owner)
    return F.when(bare.rlike('^".*"$'), F.regexp_replace(bare, '^"|"$', "")).otherwise(F.upper(bare))


def quote_identifier(name: Column) -> Column:
    return F.concat(F.lit('"'), name, F.lit('"'))


def escape_quotes(text: Column) -> Column:
    return F.replace(text, F.lit("'"), F.lit("''"))


def table_of(key: Column) -> Column:
    """The table of a `TABLE.COLUMN` key: what stands before the first dot."""
    return F.substring_index(key, ".", 1)
