"""Long/wide reshaping and grid completion.

``to_wide`` pivots with an explicit value list (no extra distinct job, fixed
column order). Fill applies to *absent* combinations only: the cell is wrapped
in a struct, so an absent combination gives a NULL struct (filled) while a
present cell whose text is NULL stays NULL. ``fill_missing=True`` fills NULL
cells too (used after ``complete_grid``, whose placeholders carry NULL).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortab.sources.tables import require_columns


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], names_to: str = "Stat",
            values_to: str = "Value", cast: str = "string") -> DataFrame:
    """Unpivot ``values`` columns into ``(names_to, values_to)``; mixed types are cast first."""
    require_columns(df, *ids, *values, where="to_long")
    typed = df.select(*ids, *[F.col(c).cast(cast).alias(c) for c in values])
    return typed.unpivot(list(ids), list(values), names_to, values_to)


def pivot_positional(df: DataFrame, ids: Sequence[str], names_from: str, value, names: Sequence,
                     ignorenulls: bool = True):
    """``groupBy(ids).pivot(names_from, names).agg(first(value))`` with value columns renamed by position.

    Returns ``(pivoted, [column name per entry of names])``. Renaming by
    position keeps arm values that differ only in letter case (Spark resolves
    names case-insensitively) apart until the final projection.
    """
    piv = df.groupBy(*ids).pivot(names_from, list(names)).agg(F.first(value, ignorenulls=ignorenulls))
    slots = [f"_pv{i}" for i in range(len(names))]
    return piv.toDF(*ids, *slots), slots


def to_wide(df: DataFrame, ids: Sequence[str], names_from: str, values_from: str,
            names: Sequence, fill: str | None = None, fill_missing: bool = False) -> DataFrame:
    """Pivot ``values_from`` into one column per entry of ``names`` (in that order)."""
    require_columns(df, *ids, names_from, values_from, where="to_wide")
    if fill_missing:
        piv, slots = pivot_positional(df, ids, names_from, F.col(values_from), names)
        return piv.select(*ids, *[F.coalesce(F.col(c), F.lit(fill)).alias(str(n)) for c, n in zip(slots, names)])
    piv, slots = pivot_positional(df, ids, names_from, F.struct(F.col(values_from).alias("v")), names)
    outs = []
    for slot, name in zip(slots, names):
        c = F.col(slot)
        value = c.getField("v")
        if fill is not None:
            value = F.when(c.isNull(), F.lit(fill)).otherwise(value)
        outs.append(value.alias(str(name)))
    return piv.select(*ids, *outs)


def complete_grid(df: DataFrame, col: str, values: Sequence, anchor, value_cols: Sequence[str]) -> DataFrame:
    """Give every group that has an ``anchor`` row a row for each of ``values`` in ``col``.

    Each anchor row (``col == anchor``) is exploded into itself plus one
    placeholder row per entry of ``values`` whose ``value_cols`` are NULL; all
    other rows pass through. A later pivot/aggregate that ignores NULLs then
    sees every combination, and its fill turns the placeholders into filled
    cells. No join, and the input is evaluated once: the grid is
    ``groups x len(values)`` rows made from the anchor rows themselves.
    """
    require_columns(df, col, *value_cols, where="complete_grid")
    is_anchor = F.col(col) == F.lit(anchor)
    targets = F.when(is_anchor, F.array(F.lit(anchor), *[F.lit(v) for v in values])) \
               .otherwise(F.array(F.col(col)))
    exploded = df.withColumn("_target", F.explode(targets))
    keep = F.col("_target") == F.col(col)
    out = exploded.select(*[F.col("_target").alias(col) if c == col
                            else (F.when(keep, F.col(c)).alias(c) if c in value_cols else F.col(c))
                            for c in df.columns])
    return out
