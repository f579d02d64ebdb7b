"""Lab flag tables: subjects per parameter and per worst-first flag, wide by arm.

``lab_table``: per parameter a header row (subjects with any result), then one
row per flag picked for the subjects (text order, missing last); labels are
the flag, or the parameter for the header and for a missing flag; rows with
an empty label are dropped; rows ordered by parameter name, then flag rank.

``lab_table_grid``: chosen parameters only, every parameter shows the three
flags LOW, NORMAL, HIGH (zero-filled when absent), ordered by the parameter's
pooled count (descending, then name), header first.

Plan shape: scan -> filter -> project -> grouping sets (subject, arm, param) /
(subject, param) with ``min(flag)`` -> grouping sets (arm, param, flag) /
(arm, param) with ``count`` -> written once. From the written counts: the arms,
ranks of the pooled rows joined back, join of the arm denominators, pivot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortab.operators.incidence import with_percent
from cohortab.operators.labflags import (
    FLAG_CODES,
    flag_code_expr,
    flag_counts,
    one_flag_per_subject,
    rank_flags,
)
from cohortab.operators.population import TOTAL_LABEL, choice_filter, population
from cohortab.operators.reshape import complete_grid, pivot_positional, to_wide
from cohortab.fixed import LAB_LABEL_HEADING, ZERO_CELL
from cohortab.plans.ae import denominators
from cohortab.sources.staging import staged
from cohortab.sources.tables import require_columns


def lab_counts(adlb: DataFrame, adsl: DataFrame, trt: str = "trta", param: str = "param",
               ind: str = "lbnrind", subject: str = "usubjid", adsl_trt: str = "trt01a",
               flag: str | None = "saffl", flag_value: str = "Y", params: Sequence[str] | None = None,
               total: str = TOTAL_LABEL, max_arms: int | None = None, arms: Sequence[str] | None = None):
    """Long form: ``trt, level, param, ind, n, ord_par, ord_gra, denom, cell``; plus the arm list."""
    require_columns(adlb, trt, param, ind, subject, where="lab_table")
    rows = population(adlb, flag, flag_value) if flag else adlb
    if params is not None:
        rows = choice_filter(rows, param, list(params))
    first = one_flag_per_subject(rows, trt, param, ind, subject, total)
    counts = staged(flag_counts(first, trt, param, ind), "flag-counts")
    bign, arms = denominators(adsl, adsl_trt, trt, subject, flag, flag_value, total, counts, max_arms, arms)
    ranked = rank_flags(counts, trt, param, ind, total)
    ranked = ranked.withColumn("ord_gra", F.when(F.col("level") == 1, F.lit(0).cast("long"))
                               .otherwise(F.col("ord_gra")))
    return with_percent(ranked, bign, trt, style="paste"), arms


def lab_table(adlb: DataFrame, adsl: DataFrame, trt: str = "trta", param: str = "param",
              ind: str = "lbnrind", subject: str = "usubjid", adsl_trt: str = "trt01a",
              flag: str | None = "saffl", flag_value: str = "Y", params: Sequence[str] | None = None,
              total: str = TOTAL_LABEL, arms: Sequence[str] | None = None,
              max_arms: int | None = None) -> DataFrame:
    """Output columns: ``label, <param>, ord, ord_gra, <arm>..., <total>``."""
    cells, found = lab_counts(adlb, adsl, trt, param, ind, subject, adsl_trt, flag, flag_value,
                              params, total, max_arms, arms)
    label = F.when((F.col("level") == 2) & F.col(ind).isNotNull(), F.col(ind)).otherwise(F.col(param))
    shaped = (cells.select(label.alias("label"), param, F.col("level").cast("long").alias("ord"),
                           "ord_gra", trt, "cell")
                   .filter(F.col("label").isNotNull() & (F.col("label") != F.lit(""))))
    wide = to_wide(shaped, ["label", param, "ord", "ord_gra"], trt, "cell", found, fill=ZERO_CELL)
    return wide.orderBy(F.col(param).asc_nulls_last(), F.col("ord_gra").asc_nulls_last())


def display(df: DataFrame, param: str = "param", heading: str = LAB_LABEL_HEADING) -> DataFrame:
    """Report view of a lab table: drop the order and key columns, blank heading for the labels."""
    drop = [c for c in (param, "ord", "ord_gra", "ord_par", "flag_code") if c in df.columns]
    return df.drop(*drop).withColumnRenamed("label", heading)


def lab_table_grid(adlb: DataFrame, adsl: DataFrame, trt: str = "trta", param: str = "param",
                   ind: str = "lbnrind", subject: str = "usubjid", adsl_trt: str = "trt01a",
                   flag: str | None = "saffl", flag_value: str = "Y",
                   params: Sequence[str] | None = None, total: str = TOTAL_LABEL,
                   arms: Sequence[str] | None = None, max_arms: int | None = None) -> DataFrame:
    """Output columns: ``label, <param>, ord_par, flag_code, <arm>..., <total>``.

    ``flag_code`` is 0 for the parameter row, then 1 LOW, 2 NORMAL, 3 HIGH.
    Rows for a missing or unknown flag are left out of the grid, and so is a
    missing or empty parameter (it has no label and cannot be chosen).
    """
    cells, arms = lab_counts(adlb, adsl, trt, param, ind, subject, adsl_trt, flag, flag_value,
                             params, total, max_arms, arms)
    code = F.when(F.col("level") == 1, F.lit(0)).otherwise(flag_code_expr(ind).cast("int"))
    coded = (cells.select(param, "ord_par", code.cast("long").alias("flag_code"), trt, "cell")
                  .filter(F.col("flag_code").isNotNull() & F.col(param).isNotNull() & (F.col(param) != F.lit(""))))
    grid = complete_grid(coded, "flag_code", sorted(FLAG_CODES.values()), 0, ["cell"])
    piv, slots = pivot_positional(grid, [param, "ord_par", "flag_code"], trt, F.col("cell"), arms)
    label = F.when(F.col("flag_code") == 0, F.col(param))
    for text, c in FLAG_CODES.items():
        label = label.when(F.col("flag_code") == c, F.lit(text))
    cells = [F.coalesce(F.col(s), F.lit(ZERO_CELL)).alias(str(a)) for s, a in zip(slots, arms)]
    return (piv.select(label.alias("label"), param, "ord_par", "flag_code", *cells)
               .orderBy(F.col("ord_par").asc_nulls_last(), F.col("flag_code").asc_nulls_last()))
