"""Lab reference-range flags: codes, one flag per subject, and flag incidence.

``one_flag_per_subject`` keeps, per subject x arm x parameter, the flag that
sorts first as text (missing last): HIGH before LOW before NORMAL, and an empty
flag before all of them. That is ``min`` over the flag text, which Spark
computes with partial aggregation (no sort, no row buffer). The pooled arm is a
second grouping set ``(subject, parameter)``, so a subject seen in two arms
still has one pooled flag.

After that step every (subject, arm, parameter) is one row, so distinct
subjects per (arm, parameter[, flag]) are plain row counts, taken with grouping
sets in one aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortab.fixed import FLAG_CODES
from cohortab.operators.incidence import join_null_safe
from cohortab.operators.population import TOTAL_LABEL, arm_text
from cohortab.operators.ranking import running_total
from cohortab.sources.staging import staged
from cohortab.sources.tables import reject_reserved, require_columns

# Columns the lab operators add.
LAB_OUTPUTS = ("level", "n", "denom", "cell", "ord_par", "ord_gra", "flag_code", "label", "_g", "_gi")



def flag_code_expr(ind: str) -> F.Column:
    c = F.col(ind)
    expr = None
    for text, code in FLAG_CODES.items():
        expr = F.when(c == F.lit(text), F.lit(float(code))) if expr is None else \
            expr.when(c == F.lit(text), F.lit(float(code)))
    return expr


def flag_code(df: DataFrame, ind: str = "lbnrind", name: str = "lbnrindn") -> DataFrame:
    """Add the numeric flag code (1 LOW, 2 NORMAL, 3 HIGH, else NULL) as a double column."""
    require_columns(df, ind, where="flag_code")
    return df.withColumn(name, flag_code_expr(ind))


def one_flag_per_subject(df: DataFrame, trt: str = "trta", param: str = "param", ind: str = "lbnrind",
                         subject: str = "usubjid", total: str = TOTAL_LABEL) -> DataFrame:
    """``subject, trt, param, ind``: one row per subject x arm (incl. pooled) x parameter."""
    require_columns(df, trt, param, ind, subject, where="one_flag_per_subject")
    reject_reserved([trt, param, ind, subject], LAB_OUTPUTS, where="one_flag_per_subject")
    base = df.select(F.col(subject).alias(subject), arm_text(trt, total).alias(trt),
                     F.col(param).cast("string").alias(param), F.col(ind).cast("string").alias(ind)
                     ).filter(F.col(subject).isNotNull())
    agg = base.groupingSets([[subject, trt, param], [subject, param]], subject, trt, param).agg(
        F.min(ind).alias(ind), F.grouping(trt).alias("_g"))
    return agg.select(subject, F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(trt)).alias(trt),
                      param, ind)


def flag_counts(first: DataFrame, trt: str = "trta", param: str = "param",
                ind: str = "lbnrind") -> DataFrame:
    """Subjects per (arm, parameter) [level 1] and per (arm, parameter, flag) [level 2]."""
    agg = first.groupingSets([[trt, param, ind], [trt, param]], trt, param, ind).agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.grouping(ind).alias("_gi"))
    return agg.select(trt, (F.lit(2) - F.col("_gi")).cast("int").alias("level"), param,
                      F.when(F.col("_gi") == 0, F.col(ind)).alias(ind), "n")


def rank_flags(counts: DataFrame, trt: str = "trta", param: str = "param", ind: str = "lbnrind",
               total: str = TOTAL_LABEL) -> DataFrame:
    """Add ``ord_par`` to all rows and ``ord_gra`` to flag rows, ranked from the pooled arm.

    ``ord_par``: parameters by pooled subject count (descending), then name
    (missing last). ``ord_gra``: within a parameter, the flags the pooled arm
    has, in text order (missing last), from 1; a flag only an arm has (its
    subjects' pooled pick was another flag) gets NULL. The counts are written
    once; only the pooled rows are numbered (spread over tasks) and their ranks
    are joined back onto the written counts.
    """
    counts = staged(counts, "flag-counts")
    is_flag = F.col("level") == 2
    pooled = (counts.filter(F.col(trt) == F.lit(total))
              .select("level", param, ind, F.when(is_flag, F.col(param)).alias("_up"),
                      F.when(is_flag, F.lit(0).cast("long")).otherwise(F.col("n")).alias("_by"),
                      F.when(is_flag, F.col(ind)).otherwise(F.col(param)).alias("_own_name")))
    numbered = running_total(pooled, ["level", "_up"], [F.col("_by").desc(), F.col("_own_name").asc_nulls_last()],
                             name="_ord", of=counts)
    params = numbered.filter(F.col("level") == 1).select(param, F.col("_ord").alias("ord_par"))
    flags = numbered.filter(is_flag).select(param, ind, F.col("_ord").alias("ord_gra"))
    out = join_null_safe(counts, flags, [param, ind], extra=F.col("level") == 2)
    return join_null_safe(out, params, [param])
