"""Denominators: distinct subjects per arm.

``big_n`` counts the population's subjects per arm plus the pooled arm in one
aggregation with grouping sets ``(arm), ()``; the exact distinct count is
planned by Spark as a partial distinct on ``(arm, grouping id, subject)``, so
the pooled group spreads over subjects in the first shuffle instead of landing
in one task.

The result has one row per arm. Reports need the arm names on the driver anyway
(they fix the wide column order); ``report_arms`` fetches them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cohortab.operators.population import TOTAL_LABEL, arm_text, population
from cohortab.sources.tables import reject_reserved, require_columns

def big_n(adsl: DataFrame, trt: str, subject: str = "usubjid", flag: str | None = "saffl",
          value: str = "Y", total: str = TOTAL_LABEL, name: str | None = None) -> DataFrame:
    """Distinct population subjects per arm, plus the pooled arm: ``(name, N)``."""
    require_columns(adsl, trt, subject, where="big_n")
    name = name or trt
    reject_reserved([name, subject], ("N", "_subj", "_g"), where="big_n")
    pop = population(adsl, flag, value) if flag else adsl
    base = (pop.select(F.col(subject).alias("_subj"), arm_text(trt, total).alias(name))
               .filter(F.col("_subj").isNotNull()))
    agg = base.groupingSets([[name], []], name).agg(
        F.countDistinct("_subj").alias("N"), F.grouping(name).alias("_g"))
    return agg.select(
        F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(name)).alias(name),
        F.col("N").cast("long").alias("N"))


def self_big_n(df: DataFrame, trt: str, subject: str = "usubjid") -> DataFrame:
    """Denominators from the event table itself: subjects with at least one row, per arm.

    No population filter and no pooled arm.
    """
    require_columns(df, trt, subject, where="self_big_n")
    reject_reserved([trt, subject], ("N", "_subj"), where="self_big_n")
    return (df.select(F.col(subject).alias("_subj"), arm_text(trt, None).alias(trt))
              .filter(F.col("_subj").isNotNull())
              .groupBy(trt).agg(F.countDistinct("_subj").cast("long").alias("N")))


def arm_order(names, total: str | None = TOTAL_LABEL) -> list:
    """Arms sorted by byte order (missing last), then the pooled arm.

    The pooled arm is always a column when ``total`` is given, even for an
    empty population (its cells then have no denominator).
    """
    arms = sorted({a for a in names if total is None or a != total},
                  key=lambda a: (a is None, (a or "").encode("utf-8")))
    return arms + ([total] if total is not None else [])


def report_arms(denominators: DataFrame | None, events: DataFrame | None, key: str,
                total: str | None = TOTAL_LABEL, max_arms: int | None = None):
    """One job for a report's arms: ``(denominator table, arm order)``.

    ``denominators`` is the ``(key, N)`` table and ``events`` holds the arms of the
    counted rows, one row each: an arm of either is a column. The fetched denominators
    re-enter the plan as a local table. ``max_arms`` is the caller's own limit;
    by default there is none (the report has as many columns in any case).
    """
    spark = (denominators if denominators is not None else events).sparkSession
    parts = []
    if denominators is not None:
        parts.append(denominators.select(key, "N", F.lit(True).alias("_den")))
    if events is not None:
        parts.append(events.select(key, F.lit(None).cast("long").alias("N"), F.lit(False).alias("_den")))
    rows = parts[0].unionByName(parts[1]).collect() if len(parts) == 2 else parts[0].collect()
    order = arm_order([r[key] for r in rows], total)
    if max_arms is not None and len(order) > max_arms + (total is not None):
        raise ValueError(f"more than {max_arms} arms")
    schema = StructType([StructField(key, StringType(), True), StructField("N", LongType(), True)])
    return spark.createDataFrame([(r[key], r["N"]) for r in rows if r["_den"]], schema), order
