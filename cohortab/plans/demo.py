"""Demography table: numeric statistics and categorical counts per arm, wide by arm.

Two layouts:

``split``    N, Mean, Median, SD, Min, Max as separate rows (2 decimals),
             categorical ``n (p%)``; rows sorted by Variable, then Stat.
``combined`` N, ``Mean (SD)``, Median, Min, Max; rows in the order of the
             variable list, statistics in their natural order, levels sorted.

Numeric vs categorical is decided from the schema (no job). Cells for arms
without data stay NULL (no fill).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortab.operators.population import TOTAL_LABEL, apply_choices
from cohortab.operators.reshape import to_wide
from cohortab.operators.summary import (
    categorical_rows,
    numeric_rows,
    summaries,
    var_positions,
)
from cohortab.fixed import SEX_ALL  # noqa: F401  (re-exported for callers)
from cohortab.sources.tables import is_numeric, require_columns



def demo_long(df: DataFrame, trt: str, variables: Sequence[str], style: str = "split",
              total: str = TOTAL_LABEL, median: str = "exact", want_arms: bool = True, empty: str = "missing"):
    """Long text rows ``Variable, Stat, var_pos, stat_pos, trt, Value`` for all variables.

    Returns ``(long_df, arms)``: the arm list (byte order, pooled arm last)
    comes from the written statistics.
    """
    variables = list(variables)
    if not variables:
        raise ValueError("demo_table needs at least one variable")
    require_columns(df, trt, *variables, where="demo_table")
    numeric = [v for v in variables if is_numeric(df, v)]
    categorical = [v for v in variables if v not in numeric]
    stats, counts, arms = summaries(df, trt, numeric, categorical, total, median, want_arms)
    parts = []
    if numeric:
        parts.append(numeric_rows(stats, trt, style, empty))
    if categorical:
        parts.append(categorical_rows(counts, trt))
    long = reduce(lambda a, b: a.unionByName(b), parts)
    return (long.withColumn("var_pos", var_positions(variables))
                .select("Variable", "Stat", "var_pos", "stat_pos", trt, "Value"), arms)


def demo_table(df: DataFrame, trt: str, variables: Sequence[str], style: str = "split",
               arms: Sequence[str] | None = None, where: dict | None = None,
               total: str = TOTAL_LABEL, median: str = "exact", empty: str = "missing") -> DataFrame:
    """Wide demography table: ``Variable, Stat, var_pos, stat_pos, <arm>..., <total>``.

    ``empty`` tells how a group without a numeric value prints, see ``numeric_rows``.
    """
    df = apply_choices(df, where)
    long, found = demo_long(df, trt, variables, style, total, median, want_arms=arms is None, empty=empty)
    arms = list(arms) if arms is not None else found
    wide = to_wide(long, ["Variable", "Stat", "var_pos", "stat_pos"], trt, "Value", arms)
    if style == "split":
        return wide.orderBy(F.col("Variable").asc_nulls_last(), F.col("Stat").asc_nulls_last())
    return wide.orderBy("var_pos", "stat_pos")


def display(df: DataFrame) -> DataFrame:
    """Report view: ``Variable, Stat`` and the arm columns (order columns dropped)."""
    return df.drop("var_pos", "stat_pos")
