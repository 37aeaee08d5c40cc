"""Text reports of small results."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame

SCORES = ("config", "n_groups", "ari", "nmi", "ami", "accuracy", "f1_macro", "table_ari")


def cell(value: object) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "n/a"
    return f"{value:.4f}" if isinstance(value, float) else str(value)


def render(columns: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    """A table of fixed widths; rows of another length are an error."""
    for r in rows:
        if len(r) != len(columns):
            raise ValueError(f"{len(columns)} columns, but a row of {len(r)}")
    text = [[cell(x) for x in r] for r in rows]
    width = [max(len(c), *(len(r[i]) for r in text)) if text else len(c) for i, c in enumerate(columns)]
    line = lambda cells: "  ".join(x.ljust(w) for x, w in zip(cells, width, strict=True)).rstrip()
    return "\n".join([line(columns), line(["-" * w for w in width]), *map(line, text)])


def frame(df: DataFrame, columns: Sequence[str] | None = None, most: int = 200) -> str:
    """A DataFrame of at most ``most`` rows as text; what is beyond is counted."""
    names = [c for c in (columns or df.columns) if c in df.columns]
    rows = df.select(*names).limit(most + 1).collect()
    more = f"\n... and more than {most} rows" if len(rows) > most else ""
    return render(names, [tuple(r) for r in rows[:most]]) + more


def scores(df: DataFrame) -> str:
    return frame(df, SCORES) + "\n\nAccuracy and F1 name clusters by the labels and are upper bounds; a high table_ari means that tables were found, not faults."


def intervals(df: DataFrame, differences: DataFrame | None = None) -> str:
    out = frame(df)
    return out if differences is None else f"{out}\n\nPaired differences\n{frame(differences)}"


def health(value: float, by_label: DataFrame, low_support: DataFrame) -> str:
    few = frame(low_support) if not low_support.isEmpty() else "none"
    return f"Health {value:.1f} of 100\n\n{frame(by_label)}\n\nLabels with fewer rows than folds (verdicts on them are untested):\n{few}"
