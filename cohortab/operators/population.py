"""Row selection and the pooled "Total" arm.

All of these are narrow transformations (no shuffle) except ``facet_values``,
which is a distinct over one column.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortab.fixed import ALL_CHOICE, DEFAULT_CHOICES, NA_TEXT, TOTAL_LABEL
from cohortab.sources.tables import require_columns

NA_ARM = NA_TEXT



def population(df: DataFrame, flag: str = "saffl", value: str = "Y") -> DataFrame:
    """Keep the rows of a population (e.g. safety): ``flag == value``; a missing flag is dropped."""
    require_columns(df, flag, where="population")
    return df.filter(F.col(flag) == F.lit(value))


def arm_text(trt: str, total: str | None = TOTAL_LABEL) -> Column:
    """The arm as text (missing -> ``NA``), failing the job if a real arm carries the pooled label.

    A missing arm is a group of its own, shown as ``NA`` like any other level.
    A real arm named like the pooled one would silently merge with it, so the
    check runs inside the plan (``raise_error``), with no extra job. ``total=None``
    is for tables without a pooled arm (no check).
    """
    arm = F.coalesce(F.col(trt).cast("string"), F.lit(NA_ARM))
    if total is None:
        return arm
    # The message names the arm by its column: a constant one would be folded to a
    # map literal, which no two copies of a plan share, and exchanges could not be reused.
    clash = F.concat(F.lit("arm value '"), arm, F.lit("' collides with the pooled-arm label"))
    return F.when(arm == F.lit(total), F.raise_error(clash)).otherwise(arm)


def with_total(df: DataFrame, trt: str, label: str = TOTAL_LABEL) -> DataFrame:
    """Every row twice: once under its own arm, once under the pooled arm.

    One scan and an ``explode`` of a two-element array, instead of a union of
    two scans.
    """
    require_columns(df, trt, where="with_total")
    return df.withColumn(trt, F.explode(F.array(arm_text(trt, label), F.lit(label))))


def choice_condition(col: str, choice, all_label: str = ALL_CHOICE) -> Column | None:
    """The condition of a report control; None where it keeps everything."""
    if choice is None or (isinstance(choice, str) and choice == all_label):
        return None
    if isinstance(choice, Iterable) and not isinstance(choice, str):
        return F.col(col).isin(list(choice))
    return F.col(col) == F.lit(choice)


def choice_filter(df: DataFrame, col: str, choice, all_label: str = ALL_CHOICE) -> DataFrame:
    """A report control: ``All`` (or None) keeps everything, a list keeps members, else equality."""
    condition = choice_condition(col, choice, all_label)
    if condition is None:
        return df
    require_columns(df, col, where="choice_filter")
    return df.filter(condition)


def apply_choices(df: DataFrame, choices: dict | None, all_label: str = ALL_CHOICE) -> DataFrame:
    for col, choice in (choices or {}).items():
        df = choice_filter(df, col, choice, all_label)
    return df


def facet_values(df: DataFrame, col: str) -> DataFrame:
    """The choice list of a control: the distinct non-missing values of a column, sorted (``value``)."""
    require_columns(df, col, where="facet_values")
    vals = df.select(F.col(col).alias("value")).filter(F.col("value").isNotNull()).distinct()
    return vals.orderBy(F.col("value").asc())


def default_choice(df: DataFrame, col: str, n: int = DEFAULT_CHOICES) -> DataFrame:
    """The default selection of a control: the first ``n`` values of its list (a distributed top-k)."""
    return facet_values(df, col).limit(n)
