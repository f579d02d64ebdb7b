"""Distinct-subject incidence at nested levels, rank ordering, and percent cells.

``incidence`` counts distinct subjects for every prefix of the level columns
(any event / body system / term, ...) and for every arm plus the pooled arm,
in ONE pass: a subject's rows are gathered and numbered (``words``), grouping
sets over ``(arm?, level_1..level_k, word of 64 subjects)`` OR the subjects' bits,
and bit counts are summed. Words are packed before they are shuffled, so a row of
the exchange stands for up to 64 subjects; the pooled arm spreads over words.
Grouping flags (not NULL tests) tell a rolled-up level from a level whose value is
genuinely missing.

``rank_levels`` ranks level values by the pooled count (descending, then
name), from the aggregated table written once (``staged``): the facts are read
for the counts only, and ranks, arms and cells come from the written counts.
``join_null_safe`` is the join for keys where a missing value must match a
missing value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortab.functions.text import count_pct_cell
from cohortab.operators.population import TOTAL_LABEL, arm_text
from cohortab.operators.ranking import running_total
from cohortab.operators.words import BIT, WORD, subject_words
from cohortab.sources.staging import staged
from cohortab.sources.tables import reject_reserved, require_columns

# Columns the incidence operators add.
INCIDENCE_OUTPUTS = ("level", "n", "denom", "cell", "ord_1", "ord_2", "ord_3", "ord_4", "_subj", "pos",
                     WORD, BIT, "_bits", "_cells")


def ord_col(k: int) -> str:
    return f"ord_{k}"


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
                   extra: Column | None = None, broadcast_right: bool = False) -> DataFrame:
    """Equi-join where a missing key matches a missing key (``<=>``).

    Output: the left columns, then the right's non-key columns.
    """
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    if broadcast_right:
        renamed = F.broadcast(renamed)
    cond = None
    for c in keys:
        term = left[c].eqNullSafe(renamed[f"_r_{c}"])
        cond = term if cond is None else cond & term
    if extra is not None:
        cond = cond & extra
    joined = left.join(renamed, cond, how)
    return joined.select(*[left[c] for c in left.columns],
                         *[renamed[c] for c in right.columns if c not in keys])


def incidence(df: DataFrame, trt: str, levels: Sequence[str], subject: str = "usubjid",
              total: str = TOTAL_LABEL, with_total: bool = True) -> DataFrame:
    """Distinct subjects per arm (and pooled arm) at every nesting depth of ``levels``.

    Returns ``trt, level, *levels, n`` where ``level`` is the depth (0 = any row,
    1 = first level, ...) and deeper level columns are NULL on shallower rows.
    """
    levels = list(levels)
    require_columns(df, trt, subject, *levels, where="incidence")
    reject_reserved([trt, subject, *levels], INCIDENCE_OUTPUTS, where="incidence")
    base = df.select(F.col(subject).alias("_subj"), arm_text(trt, total).alias(trt),
                     *[F.col(c).cast("string").alias(c) for c in levels]
                     ).filter(F.col("_subj").isNotNull())
    arm_options = ([[trt], []] if with_total else [[trt]])
    sets = [a + levels[:k] + [WORD] for a in arm_options for k in range(len(levels) + 1)]
    words = subject_words(base, "_subj", [trt, *levels]).groupingSets(sets, trt, *levels, WORD).agg(
        F.bit_or(BIT).alias("_bits"),
        F.grouping(trt).alias("_g_arm"),
        *[F.grouping(c).alias(f"_g_{i}") for i, c in enumerate(levels)])
    depth = sum((F.lit(1) - F.col(f"_g_{i}")) for i in range(len(levels))) if levels else F.lit(0)
    return words.select(
        F.when(F.col("_g_arm") == 1, F.lit(total)).otherwise(F.col(trt)).alias(trt),
        depth.cast("int").alias("level"),
        *levels,
        "_bits").groupBy(trt, "level", *levels).agg(F.sum(F.bit_count("_bits")).cast("long").alias("n"))


def rank_levels(inc: DataFrame, trt: str, levels: Sequence[str], total: str = TOTAL_LABEL,
                by: Sequence[str] = ()) -> DataFrame:
    """Add ``ord_k`` (k = 1..depth) to every row at depth >= k, ranked from the pooled arm.

    Depth-1 values are ranked over all of them by pooled count (descending),
    then name (missing last); deeper values are ranked within their parent,
    which sorts the same as one running number. Only values the pooled arm
    has are ranked; other rows get NULL. Tables that differ in the ``by``
    columns are ranked each for itself.

    The counts are written once; all depths are numbered by one
    ``running_total`` over the pooled arm's rows (one row per value, spread
    over tasks) and joined back onto the written counts.
    """
    levels, by = list(levels), list(by)
    inc = staged(inc, "incidence")
    parents = [F.when(F.col("level") > j, F.col(c)).alias(f"_up{j}") for j, c in enumerate(levels[:-1], start=1)]
    own = F.lit(None).cast("string")
    for k, c in enumerate(levels, start=1):
        own = F.when(F.col("level") == k, F.col(c)).otherwise(own)
    pooled = (inc.filter((F.col(trt) == F.lit(total)) & (F.col("level") >= 1))
              .select(*by, "level", *levels, "n", *parents, own.alias("_own_name")))
    numbered = running_total(pooled, [*by, "level", *[f"_up{j}" for j in range(1, len(levels))]],
                             [F.col("n").desc(), F.col("_own_name").asc_nulls_last()], name="_ord", of=inc)
    out = inc
    for k in range(1, len(levels) + 1):
        ranks = numbered.filter(F.col("level") == k).select(*by, *levels[:k], F.col("_ord").alias(ord_col(k)))
        out = join_null_safe(out, ranks, [*by, *levels[:k]], how="left", extra=F.col("level") >= F.lit(k))
    return out


def rank_tables(ranked: DataFrame, trt: str, levels: Sequence[str], total: str = TOTAL_LABEL) -> DataFrame:
    """The pooled ranks as one table: ``level, *levels, ord`` (deeper level columns NULL)."""
    pooled = ranked.filter((F.col(trt) == F.lit(total)) & (F.col("level") >= 1))
    ord_expr = None
    for k in range(1, len(levels) + 1):
        ord_expr = F.when(F.col("level") == k, F.col(ord_col(k))) if ord_expr is None else \
            ord_expr.when(F.col("level") == k, F.col(ord_col(k)))
    return pooled.select("level", *levels, ord_expr.alias("ord"))


def with_percent(counts: DataFrame, denominators: DataFrame, trt: str, style: str = "strict",
                 n: str = "n", broadcast: bool = False) -> DataFrame:
    """Attach the arm denominator as ``denom`` (null-safe on arm) and the text cell ``n (pct)``.

    ``denominators`` is the ``(trt, N)`` table; Spark picks the join from its
    size unless the caller, knowing it, asks for a ``broadcast``.
    """
    joined = join_null_safe(counts, denominators.select(trt, F.col("N").alias("denom")), [trt],
                            how="left", broadcast_right=broadcast)
    return joined.withColumn("cell", count_pct_cell(F.col(n), F.col("denom"), style))
