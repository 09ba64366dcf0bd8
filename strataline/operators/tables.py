"""Grids of cells as pipe tables, in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataline.functions import text as T


def pipe_table(rows: Column) -> Column:
    """Rows of cell texts as | a | b | lines, a rule below the first; grids with at most one filled cell a row as plain lines."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: F.replace(T.collapse(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|"))))
    kept = F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))
    wide = F.array_max(F.transform(kept, lambda r: F.size(r)))
    plain = F.array_join(F.filter(F.flatten(kept), lambda c: c != ""), "\n")
    full = lambda r: F.concat(r, F.array_repeat(F.lit(""), wide - F.size(r)))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    lined = F.transform(kept, lambda r: line(full(r)))
    ruled = F.concat(F.slice(lined, 1, 1), F.array(line(F.array_repeat(F.lit("---"), wide))), F.slice(lined, F.lit(2), F.greatest(F.size(lined) - 1, F.lit(0))))
    single = F.forall(kept, lambda r: F.size(F.filter(r, lambda c: c != "")) <= 1)
    return F.when(F.size(kept) == 0, F.lit("")).when(single, plain).otherwise(F.array_join(ruled, "\n"))
