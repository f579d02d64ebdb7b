"""Incidence under changing report controls, from one pass over the events.

``subject_bits`` writes, per arm, depth, level values and control values, the
exact set of subjects as 64-bit words (subjects are numbered where their rows
are gathered, see ``words``). Any setting of the controls, one value, a list or
all of them, is then an OR of words: ``incidence_of`` gives the same rows as
``incidence`` on the filtered events, without reading an event again. Words
without a subject are not stored, so a rare term costs one row per subject at
most and a frequent one a row per 64. Rows of one word are written side by side,
so that they collapse before ``incidence_of`` shuffles them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortab.fixed import ALL_CHOICE
from cohortab.operators.incidence import INCIDENCE_OUTPUTS
from cohortab.operators.population import TOTAL_LABEL, arm_text, choice_condition
from cohortab.operators.words import BIT, WORD, subject_words
from cohortab.sources.staging import staged
from cohortab.sources.tables import reject_reserved, require_columns

BITS_OUTPUTS = (*INCIDENCE_OUTPUTS, "word", "bits", "choice", "_id")


def subject_bits(df: DataFrame, trt: str, levels: Sequence[str], controls: Sequence[str],
                 subject: str = "usubjid", total: str = TOTAL_LABEL) -> DataFrame:
    """``trt, level, *levels, *controls, word, bits`` of the subjects of every depth and control setting.

    The events are read once and only the words are written.
    """
    levels, controls = list(levels), list(controls)
    require_columns(df, trt, subject, *levels, *controls, where="subject_bits")
    reject_reserved([trt, subject, *levels, *controls], BITS_OUTPUTS, where="subject_bits")
    rows = df.select(F.col(subject).alias("_subj"), arm_text(trt, total).alias(trt),
                     *[F.col(c).cast("string").alias(c) for c in levels], *controls).filter(F.col("_subj").isNotNull())
    coded = subject_words(rows, "_subj", [trt, *levels, *controls], clustered=True).withColumnsRenamed(
        {WORD: "word", BIT: "bits"})
    cells = coded.withColumn("_cell", F.explode(F.array(*[
        F.struct(arm.alias("arm"), F.lit(k).alias("level"),
                 *[(F.col(c) if i < k else F.lit(None).cast("string")).alias(f"_l{i}") for i, c in enumerate(levels)])
        for arm in (F.col(trt), F.lit(total)) for k in range(len(levels) + 1)])))
    named = cells.select(F.col("_cell.arm").alias(trt), F.col("_cell.level").alias("level"),
                         *[F.col(f"_cell._l{i}").alias(c) for i, c in enumerate(levels)], *controls, "word", "bits")
    return staged(named.groupBy(trt, "level", *levels, *controls, "word").agg(F.bit_or("bits").alias("bits")),
                  "subject-bits")


def _chosen(choice: dict | None, all_label: str) -> Column:
    cond = F.lit(True)
    for col, value in (choice or {}).items():
        one = choice_condition(col, value, all_label)
        cond = cond if one is None else cond & F.coalesce(one, F.lit(False))
    return cond


def incidence_of(bits: DataFrame, trt: str, levels: Sequence[str], choices: Sequence[dict | None],
                 all_label: str = ALL_CHOICE) -> DataFrame:
    """``choice, trt, level, *levels, n``: the distinct subjects under each setting of the controls (numbered from 0)."""
    levels = list(levels)
    for choice in choices:
        require_columns(bits, *(choice or {}), where="incidence_of")
    if not choices:
        return bits.select(F.lit(0).cast("long").alias("choice"), trt, "level", *levels,
                           F.lit(0).cast("long").alias("n")).filter(F.lit(False))
    keys = [trt, "level", *levels]
    words = bits.groupBy(*keys, "word").agg(*[F.bit_or(F.when(_chosen(c, all_label), F.col("bits"))).alias(f"_bits{i}")
                                              for i, c in enumerate(choices)])
    counts = words.groupBy(*keys).agg(*[F.sum(F.bit_count(f"_bits{i}")).cast("long").alias(f"_n{i}")
                                        for i in range(len(choices))])
    each = F.array(*[F.struct(F.lit(i).cast("long").alias("choice"), F.col(f"_n{i}").alias("n"))
                     for i in range(len(choices))])
    return counts.select(F.inline(each), *keys).filter(F.col("n") > 0).select("choice", *keys, "n")
