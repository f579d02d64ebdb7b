"""Subjects as bits of 64-bit words, for exact distinct counts.

``subject_words`` gathers a subject's distinct rows in one exchange keyed on the
subject (repeated rows collapse before it), numbers the subjects where they stand
and hands the rows out again with the subject's word and bit. Subjects of one word
stand in one task, so the aggregation that follows packs up to 64 of them into a row
before anything is shuffled again: distinct subjects are then a sum of bit counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD, BIT = "_subj_word", "_subj_bit"


def _per_subject(df: DataFrame, subject: str, cols: Sequence[str]) -> DataFrame:
    """One row per subject: its word, its bit and the set of its rows of ``cols``.

    A number is given to a subject in one place only and is used in the same task, so
    it need not be the same when a task runs again: words of two tasks never meet.
    """
    sets = df.groupBy(subject).agg(F.collect_set(F.struct(*cols)).alias("_cells"))
    numbered = sets.select(F.monotonically_increasing_id().alias("_id"), "_cells")
    return numbered.select(F.shiftright("_id", 6).alias(WORD),
                           F.expr("shiftleft(1L, CAST(_id % 64 AS INT))").alias(BIT), "_cells")


def subject_words(df: DataFrame, subject: str, cols: Sequence[str], clustered: bool = False) -> DataFrame:
    """The distinct rows ``(subject, *cols)`` as ``*cols, _subj_word, _subj_bit``.

    ``clustered`` rows are partitioned on the word, so that an aggregation with the word
    among its keys needs no exchange.
    """
    cells = _per_subject(df, subject, cols)
    if clustered:
        cells = cells.repartition(WORD)
    return cells.select(WORD, BIT, F.inline("_cells")).select(*cols, WORD, BIT)
