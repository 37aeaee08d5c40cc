"""DuckDB SQL that the registered queries must equal, put together from parts."""

from __future__ import annotations

from colscope.functions.constants import CANONICAL


def agreement_ctes(source: str) -> str:
    """CTEs up to ``agree``(g, n_rows, n_groups, ari, nmi, ami) over a source of (g, t, c)."""
    return f"""src AS ({source}),
cells AS (SELECT g, t, c, count(*) AS n FROM src GROUP BY g, t, c),
marg AS (SELECT *, sum(n) OVER (PARTITION BY g, t) AS a, sum(n) OVER (PARTITION BY g, c) AS b, sum(n) OVER (PARTITION BY g) AS nn FROM cells),
joint AS (SELECT g, sum(n * (n - 1) / 2.0) AS same, sum(n / nn * ln(nn * n / (a * b))) AS mi, any_value(nn) AS nn FROM (SELECT g, n::DOUBLE AS n, a::DOUBLE AS a, b::DOUBLE AS b, nn::DOUBLE AS nn FROM marg) GROUP BY g),
ta AS (SELECT DISTINCT g, t, a::DOUBLE AS a, nn::DOUBLE AS nn FROM marg), tb AS (SELECT DISTINCT g, c, b::DOUBLE AS b, nn::DOUBLE AS nn FROM marg),
ha AS (SELECT g, sum(a * (a - 1) / 2) AS pa, -sum(a / nn * ln(a / nn)) AS h, count(*) AS k FROM ta GROUP BY g),
hb AS (SELECT g, sum(b * (b - 1) / 2) AS pb, -sum(b / nn * ln(b / nn)) AS h, count(*) AS k FROM tb GROUP BY g),
ab AS (SELECT ta.g, a, b, ta.nn, count(*) AS w FROM ta JOIN tb USING (g) GROUP BY ta.g, a, b, ta.nn),
terms AS (SELECT *, unnest(range(greatest(1, a + b - nn)::BIGINT, least(a, b)::BIGINT + 1))::DOUBLE AS k FROM ab),
emi AS (SELECT g, sum(w * k / nn * ln(nn * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(nn - a + 1) + lgamma(nn - b + 1) - lgamma(nn + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(nn - a - b + k + 1))) AS emi FROM terms GROUP BY g),
agree AS (
  SELECT g, nn::BIGINT AS n_rows, hb.k AS n_groups,
    CASE WHEN (pa + pb) / 2 = pa * pb / (nn * (nn - 1) / 2) THEN 1.0 ELSE (same - pa * pb / (nn * (nn - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (nn * (nn - 1) / 2)) END AS ari,
    CASE WHEN (ha.k = 1 AND hb.k = 1) OR ha.h + hb.h = 0 THEN 1.0 ELSE mi / ((ha.h + hb.h) / 2) END AS nmi,
    CASE WHEN ha.k = 1 AND hb.k = 1 THEN 1.0 WHEN abs((ha.h + hb.h) / 2 - coalesce(emi, 0)) < 1e-15 THEN 0.0 ELSE (mi - coalesce(emi, 0)) / ((ha.h + hb.h) / 2 - coalesce(emi, 0)) END AS ami
  FROM joint JOIN ha USING (g) JOIN hb USING (g) LEFT JOIN emi USING (g))"""


AGREE_COLUMNS = "n_rows, n_groups, round(ari, 6) AS ari, round(nmi, 6) AS nmi, round(ami, 6) AS ami, round(nmi, 6) AS v_measure"


def agreement(source: str, prefix: str = "") -> str:
    return f"WITH {prefix}{', ' if prefix else ''}{agreement_ctes(source)} SELECT {AGREE_COLUMNS} FROM agree"


def long_form(source: str, key: str, vector: str) -> str:
    """(key, dim, x) of a vector column, dims from 0."""
    return f"SELECT {key} AS key, unnest(range(0, len({vector}))) AS dim, unnest({vector})::DOUBLE AS x FROM ({source})"


def zscores(long: str) -> str:
    """(key, dim, x, z, std) by population statistics; constant dimensions are zero."""
    return f"SELECT key, dim, x, stddev_pop(x) OVER (PARTITION BY dim) AS std, (x - avg(x) OVER (PARTITION BY dim)) / CASE WHEN stddev_pop(x) OVER (PARTITION BY dim) = 0 THEN 1 ELSE stddev_pop(x) OVER (PARTITION BY dim) END AS z FROM ({long})"


def letters(text: str) -> str:
    return f"list_transform(range(97, 123), lambda i: (length(lower({text})) - length(replace(lower({text}), chr(i::INTEGER), '')))::DOUBLE)"


def cosine(a: str, b: str) -> str:
    def size(v: str) -> str:
        return f"sqrt(list_sum(list_transform({v}, lambda q: q * q)))"

    return f"(list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2])) / ((CASE WHEN {size(a)} = 0 THEN 1 ELSE {size(a)} END) * (CASE WHEN {size(b)} = 0 THEN 1 ELSE {size(b)} END)))"


def mapping(values: dict[str, str]) -> str:
    return "MAP {" + ", ".join("'" + k.replace("'", "''") + "': '" + v.replace("'", "''") + "'" for k, v in values.items()) + "}"


def canonical(data_type: str) -> str:
    return f"coalesce({mapping(CANONICAL)}[split_part(trim(split_part(upper(coalesce({data_type}, '')), '(', 1)), ' ', 1)], 'OTHER')"


def camel(text: str) -> str:
    low, up = "a-záéíóúñ", "A-ZÁÉÍÓÚÑ"
    return f"regexp_replace(regexp_replace({text}, '([{low}])([{up}])', '\\1 \\2', 'g'), '([{up}]+)([{up}][{low}])', '\\1 \\2', 'g')"


def prefix(text: str) -> str:
    return f"CASE WHEN regexp_matches({text}, '(?i)^(tbl|col|fld|tab) ') THEN trim(regexp_replace({text}, '(?i)^(tbl|col|fld|tab) ', '')) ELSE {text} END"


def name(text: str, words: dict[str, str]) -> str:
    """The clean name of a column expression."""
    base = prefix(f"replace({camel(text)}, '_', ' ')")
    tokens = f"list_filter(regexp_split_to_array({base}, '\\s+'), lambda t: t <> '')"
    expanded = f"list_transform({tokens}, lambda t: coalesce({mapping(words)}[trim(lower(t), '.,;:!?()[]{{}}')], t))"
    return f"array_to_string(list_transform({expanded}, lambda t: CASE WHEN upper(t) = t AND lower(t) <> t THEN lower(t) ELSE t END), ' ')"


TYPE_PROSE = """CASE
 WHEN tt IN ('VARCHAR2', 'VARCHAR', 'NVARCHAR2') THEN 'texto de longitud variable' || CASE WHEN coalesce(data_length, 0) <> 0 THEN ' de hasta ' || data_length || ' caracteres' ELSE '' END
 WHEN tt IN ('CHAR', 'NCHAR') THEN 'texto de longitud fija' || CASE WHEN coalesce(data_length, 0) <> 0 THEN ' de ' || data_length || ' caracteres' ELSE '' END
 WHEN tt IN ('NUMBER', 'NUMERIC', 'DECIMAL', 'FLOAT', 'BINARY_DOUBLE', 'BINARY_FLOAT') THEN CASE WHEN coalesce(data_scale, 0) <> 0 THEN 'numero decimal con ' || coalesce(nullif(data_precision, 0)::VARCHAR, 'varios') || ' digitos y ' || data_scale || ' decimales' ELSE 'numero entero' END
 WHEN tt = 'DATE' THEN 'fecha' WHEN tt LIKE 'TIMESTAMP%' THEN 'marca de tiempo' WHEN tt LIKE 'INTERVAL%' THEN 'intervalo de tiempo'
 WHEN tt IN ('CLOB', 'NCLOB') THEN 'texto largo sin limite de longitud' WHEN tt = 'LONG' THEN 'texto largo en el tipo heredado LONG'
 WHEN tt IN ('BLOB', 'RAW', 'LONG RAW', 'BFILE') THEN 'datos binarios' WHEN tt <> '' THEN lower(tt) ELSE 'tipo desconocido' END"""

CONSTRAINT_PROSE = """concat_ws(', ', CASE WHEN nullable THEN 'admite nulos' ELSE 'obligatorio' END, CASE WHEN is_primary_key THEN 'es clave primaria' END,
 CASE WHEN fk_name IS NOT NULL THEN 'es clave foranea' || CASE WHEN coalesce(fk_references_table, '') <> '' THEN ' hacia ' || lower(fk_references_table) ELSE '' END END,
 CASE WHEN is_unique THEN 'con valores unicos' END, CASE WHEN is_indexed THEN 'indexada' END, CASE WHEN coalesce(default_value, '') <> '' THEN 'con valor por defecto ' || trim(default_value) END)"""

TYPED = "SELECT *, upper(trim(coalesce(data_type, ''))) AS tt FROM cat"


def multi_hot(values: list[str]) -> str:
    return "[" + ", ".join(values) + "]"


FAMILY = """CASE WHEN tt LIKE 'TIMESTAMP%' OR tt = 'DATE' THEN 'date' WHEN tt IN ('NUMBER', 'NUMERIC', 'DECIMAL', 'FLOAT', 'BINARY_DOUBLE', 'BINARY_FLOAT') THEN 'amount'
 WHEN tt IN ('VARCHAR2', 'VARCHAR', 'NVARCHAR2', 'CHAR', 'NCHAR', 'CLOB', 'NCLOB', 'LONG') THEN 'text' WHEN tt IN ('BLOB', 'RAW', 'BFILE') THEN 'binary' WHEN tt = 'BOOLEAN' THEN 'boolean' END"""
FLAG = """CASE WHEN tt = 'NUMBER' THEN coalesce(data_precision = 1, false) AND coalesce(data_scale, 0) = 0
 WHEN tt IN ('CHAR', 'NCHAR', 'VARCHAR2', 'VARCHAR', 'NVARCHAR2') THEN coalesce(coalesce(nullif(char_length, 0), data_length) BETWEEN 1 AND 1, false) ELSE false END"""
DECLARED = f"""[({FAMILY} IS NOT DISTINCT FROM 'date')::INT::DOUBLE, ({FAMILY} IS NOT DISTINCT FROM 'amount')::INT::DOUBLE, (fk_name IS NOT NULL)::INT::DOUBLE,
 ({FAMILY} IS NOT DISTINCT FROM 'text')::INT::DOUBLE, ({FAMILY} IS NOT DISTINCT FROM 'boolean' OR {FLAG})::INT::DOUBLE, ({FAMILY} IS NOT DISTINCT FROM 'binary')::INT::DOUBLE]"""
