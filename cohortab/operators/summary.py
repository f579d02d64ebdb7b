"""Baseline summaries per arm and pooled arm, all variables in one pass.

Every variable is unpivoted to ``(Variable, x, level)`` (numeric variables
fill ``x``, categorical ones the level) and ONE aggregation with grouping sets
``(arm, Variable, level), (Variable, level)`` yields, per arm and pooled arm,
the non-missing count, mean, sample SD, min, max and rank sketch of numeric
variables and the row count of every categorical level. It is written once;
the exact median (``median_from_sketches``) reads the values a second time for
the middle bands only. Categorical percents divide by the arm's row count,
summed from the written level counts, and levels are numbered by
``running_total``. A missing level is a level of its own and counts in the base.

The arm is made text; a missing arm becomes the text ``NA`` so it forms one
more group (and one more report column) rather than vanishing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortab.functions.text import count_pct_cell, number_text, paste
from cohortab.fixed import COMBINED_STATS, SD_DIGITS_COMBINED, SPLIT_STATS, STAT_DIGITS
from cohortab.operators.denominators import arm_order
from cohortab.operators.incidence import join_null_safe
from cohortab.operators.median import median_from_sketches, number, rank_sketch
from cohortab.operators.population import TOTAL_LABEL, arm_text
from cohortab.operators.ranking import running_total
from cohortab.sources.staging import staged
from cohortab.sources.tables import reject_reserved, require_columns

# Columns the summaries add.
SUMMARY_OUTPUTS = ("Variable", "Stat", "x", "Value", "var_pos", "stat_pos", "rows", "n", "mean", "median",
                   "sd", "min", "max", "denom", "sketch", "_it")


def _arm(trt: str, total: str) -> Column:
    return arm_text(trt, total)


def _var_pos(names: Sequence[str]) -> Column:
    expr = None
    for i, v in enumerate(names, start=1):
        expr = F.when(F.col("Variable") == F.lit(v), F.lit(i)) if expr is None else \
            expr.when(F.col("Variable") == F.lit(v), F.lit(i))
    return expr.cast("long")


def summary_long(df: DataFrame, trt: str, numeric: Sequence[str], categorical: Sequence[str],
                 total: str = TOTAL_LABEL) -> DataFrame:
    """One row per input row and variable: ``trt, Variable, x (numeric), Stat (level)``.

    Numeric variables carry ``x`` (NaN as missing) and a NULL level;
    categorical ones carry the level as text and a NULL ``x``.
    """
    require_columns(df, trt, *numeric, *categorical, where="summary")
    reject_reserved([trt], SUMMARY_OUTPUTS, where="summary")
    items = [F.struct(F.lit(v).alias("Variable"), number(v).alias("x"), F.lit(None).cast("string").alias("Stat"))
             for v in numeric]
    items += [F.struct(F.lit(v).alias("Variable"), F.lit(None).cast("double").alias("x"),
                       F.col(v).cast("string").alias("Stat")) for v in categorical]
    return (df.select(_arm(trt, total).alias(trt), F.explode(F.array(*items)).alias("_it"))
              .select(trt, "_it.Variable", "_it.x", "_it.Stat"))


def summary_aggregate(long: DataFrame, trt: str, total: str = TOTAL_LABEL, median: str | None = None) -> DataFrame:
    """Both summaries in ONE aggregation with grouping sets ``(arm, Variable, level), (Variable, level)``.

    Numeric variables have a single NULL level, so their groups are (arm,
    variable); categorical variables group by level. Columns: ``trt, Variable,
    Stat, rows, n, mean, sd, min, max`` (+ the rank ``sketch`` for an exact
    median, or the ``approx`` median).
    """
    aggs = [F.count(F.lit(1)).cast("long").alias("rows"), F.count("x").cast("long").alias("n"),
            F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("min"),
            F.max("x").alias("max"), F.grouping(trt).alias("_g")]
    if median == "approx":
        aggs.append(F.percentile_approx("x", 0.5).alias("median"))
    elif median == "exact":
        aggs.append(rank_sketch("x").alias("sketch"))
    agg = long.groupingSets([[trt, "Variable", "Stat"], ["Variable", "Stat"]], trt, "Variable", "Stat").agg(*aggs)
    return agg.withColumn(trt, F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(trt))).drop("_g")


def summaries(df: DataFrame, trt: str, numeric: Sequence[str], categorical: Sequence[str],
              total: str = TOTAL_LABEL, median: str = "exact", want_arms: bool = False):
    """``(typed numeric statistics, level counts with positions, arm order)`` from the written aggregation.

    The rows are read once, and once more for the middle bands of an exact
    median. Level counts never leave the executors. The arm order is None
    unless wanted.
    """
    if median not in ("exact", "approx"):
        raise ValueError(f"unknown median mode {median!r}")
    long = summary_long(df, trt, numeric, categorical, total)
    agg = staged(summary_aggregate(long, trt, total, median if numeric else None), "summary")
    arms, stats, levels = None, None, None
    if numeric:
        stats = agg.filter(F.col("Variable").isin(list(numeric))).drop("rows", "Stat")
        if median == "exact":
            values = long.filter(F.col("Variable").isin(list(numeric))).withColumnRenamed("x", "_x")
            pooled = values.select(F.explode(F.array(F.col(trt), F.lit(total))).alias(trt), "Variable", "_x")
            med = median_from_sketches(stats.select(trt, "Variable", "n", "sketch"), pooled, [trt, "Variable"])
            stats = stats.drop("sketch").join(med, [trt, "Variable"], "left")
    if categorical:
        levels = _level_counts(agg, trt, categorical, total)
    if want_arms:
        arms = arm_order([r[0] for r in agg.select(trt).distinct().collect()], total)
    return stats, levels, arms


def _level_counts(agg: DataFrame, trt: str, categorical: Sequence[str], total: str) -> DataFrame:
    """``trt, Variable, Stat, n, denom, stat_pos`` of the categorical variables.

    ``denom`` is the arm's rows for the variable, summed from the written level
    counts (one row per arm and variable) and joined back. ``stat_pos`` numbers
    a variable's levels in sorted order (missing last): the pooled arm has every
    level once, and its levels are numbered in range partitions.
    """
    counts = agg.filter(F.col("Variable").isin(list(categorical))).select(trt, "Variable", "Stat", F.col("rows").alias("n"))
    base = counts.groupBy(trt, "Variable").agg(F.sum("n").cast("long").alias("denom"))
    pooled = counts.filter(F.col(trt) == F.lit(total)).select("Variable", "Stat")
    pos = running_total(pooled, ["Variable"], [F.col("Stat").asc_nulls_last()], name="stat_pos", of=agg)
    return join_null_safe(join_null_safe(counts, base, [trt, "Variable"]), pos, ["Variable", "Stat"])


def numeric_stats(df: DataFrame, trt: str, variables: Sequence[str], total: str = TOTAL_LABEL,
                  median: str = "exact") -> DataFrame:
    """Typed statistics: ``trt, Variable, n, mean, median, sd, min, max``.

    ``median='exact'`` is the exact middle value (mean of the two middle values
    for an even count), computed by ``exact_median`` with bounded memory;
    ``median='approx'`` uses Spark's approximate percentile in the same pass.
    """
    stats, _, _ = summaries(df, trt, list(variables), [], total, median)
    return stats.select(trt, "Variable", "n", "mean", "median", "sd", "min", "max")


EMPTY_MODES = ("missing", "limits")


def _of_nothing(stats: DataFrame) -> DataFrame:
    """What the statistics of no value are: the mean is no number, the minimum and maximum are the ends of the scale."""
    ends = {"mean": float("nan"), "min": float("inf"), "max": float("-inf")}
    return stats.withColumns({c: F.when(F.col("n") == 0, F.lit(v)).otherwise(F.col(c)) for c, v in ends.items()})


def numeric_rows(stats: DataFrame, trt: str, style: str = "split", empty: str = "missing") -> DataFrame:
    """Text rows ``Variable, Stat, stat_pos, trt, Value`` from typed statistics.

    A group without a value has missing statistics (``empty="missing"``), or
    mean ``NaN``, minimum ``Inf`` and maximum ``-Inf`` (``empty="limits"``);
    its median and SD are missing either way.
    """
    if empty not in EMPTY_MODES:
        raise ValueError(f"unknown mode for empty groups {empty!r}")
    if empty == "limits":
        stats = _of_nothing(stats)
    n_txt = F.col("n").cast("string")
    if style == "split":
        items = [n_txt] + [number_text(c, STAT_DIGITS) for c in ("mean", "median", "sd", "min", "max")]
        names = SPLIT_STATS
    elif style == "combined":
        mean_sd = paste(number_text("mean", STAT_DIGITS), " (", number_text("sd", SD_DIGITS_COMBINED), ")")
        items = [n_txt, mean_sd] + [number_text(c, STAT_DIGITS) for c in ("median", "min", "max")]
        names = COMBINED_STATS
    else:
        raise ValueError(f"unknown style {style!r}")
    packed = F.array(*[F.struct(F.lit(nm).alias("Stat"), F.lit(i).cast("long").alias("stat_pos"),
                                val.alias("Value")) for i, (nm, val) in enumerate(zip(names, items), start=1)])
    return (stats.select("Variable", trt, F.inline(packed))
                 .select("Variable", "Stat", "stat_pos", trt, "Value"))


def numeric_summary(df: DataFrame, trt: str, variables: Sequence[str], style: str = "split",
                    total: str = TOTAL_LABEL, median: str = "exact", empty: str = "missing") -> DataFrame:
    """Long text rows ``Variable, Stat, stat_pos, trt, Value``.

    ``split``: N, Mean, Median, SD, Min, Max (2 decimals); a missing SD stays NULL.
    ``combined``: N, ``Mean (SD)`` as ``mean(2) (sd(3))`` with ``NA`` for a
    missing SD, Median, Min, Max. ``empty`` as in ``numeric_rows``.
    """
    return numeric_rows(numeric_stats(df, trt, variables, total, median), trt, style, empty)


def categorical_counts(df: DataFrame, trt: str, variables: Sequence[str],
                       total: str = TOTAL_LABEL) -> DataFrame:
    """Typed level counts: ``trt, Variable, Stat (level), n, denom, stat_pos`` (one aggregation, written)."""
    return summaries(df, trt, [], list(variables), total)[1]


def categorical_rows(counts: DataFrame, trt: str) -> DataFrame:
    """Text rows ``Variable, Stat, stat_pos, trt, Value`` with ``n (p%)`` from level counts."""
    return counts.select("Variable", "Stat", "stat_pos", trt, count_pct_cell("n", "denom", style="percent").alias("Value"))


def categorical_summary(df: DataFrame, trt: str, variables: Sequence[str],
                        total: str = TOTAL_LABEL) -> DataFrame:
    """Long text rows ``Variable, Stat, stat_pos, trt, Value`` with ``n (p%)``."""
    return categorical_rows(categorical_counts(df, trt, variables, total), trt)


def var_positions(variables: Sequence[str]) -> Column:
    return _var_pos(list(variables))
