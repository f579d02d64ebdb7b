"""Adverse-event tables.

``ae_summary``: population subjects per arm from the subject table; distinct
subjects with any event, per body system and per term, for each arm and the
pooled arm; body systems and terms ranked by the pooled count; ``n (pct)``
cells; one column per arm; rows "Any" first, then each body system followed
by its indented terms.

``ae_term_table``: a second layout with denominators from the event table
itself, ``n (p.p%)`` cells filled with ``0 (0.0%)``, a row-total column, and a
header row per body system.

Plan shape (``ae_summary``): scan -> filter (pushed to Parquet) -> project
(subject, arm, body system, term) -> set of rows per subject -> shuffle on the
subject -> subjects numbered -> expand over 6 grouping sets -> bits of 64 subjects
a word -> shuffle of words -> bit counts -> shuffle of partial
counts -> written once. From the written counts: the arms, ranks of the pooled
rows (one row per body system / term) joined back, join of the arm denominators,
pivot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortab.fixed import (  # HTML_INDENT is re-exported for callers
    AE_LABEL_HEADING,
    ANY_EVENT_LABEL,
    HTML_INDENT,  # noqa: F401
    TERM_INDENT,
    ZERO_CELL,
    ZERO_CELL_PCT,
)
from cohortab.functions.text import count_pct_cell, indent_label, paste
from cohortab.operators.choices import incidence_of, subject_bits
from cohortab.operators.denominators import big_n, report_arms
from cohortab.operators.incidence import (
    incidence,
    join_null_safe,
    ord_col,
    rank_levels,
    with_percent,
)
from cohortab.operators.population import TOTAL_LABEL, apply_choices, arm_text, population
from cohortab.operators.reshape import pivot_positional, to_wide
from cohortab.sources.staging import staged
from cohortab.sources.tables import named_inputs, reject_reserved, require_columns


def denominators(adsl: DataFrame, adsl_trt: str, key: str, subject: str, flag: str | None,
                 flag_value: str, total: str, counted: DataFrame, max_arms: int | None = None,
                 arms: Sequence[str] | None = None):
    """Population big-N per arm: returns ``(denominator table, arm order)``.

    Without ``arms`` the columns are the arms of the subject table and those
    of the ``counted`` rows, one written row per arm (an arm found only there
    has no denominator), fetched in one job. With the caller's ``arms`` nothing
    is fetched.
    """
    bn = big_n(adsl, adsl_trt, subject, flag, flag_value, total, name=key)
    if arms is not None:
        return bn.filter(F.col(key).isin(list(arms))), list(arms)
    return report_arms(bn, counted.filter(F.col(key) != F.lit(total)).select(key).distinct(), key, total, max_arms)


def event_incidence(adae: DataFrame, trt: str = "trta", soc: str = "aebodsys", pt: str = "aedecod",
                    subject: str = "usubjid", flag: str | None = "saffl", flag_value: str = "Y",
                    where: dict | None = None, total: str = TOTAL_LABEL) -> DataFrame:
    """The counts behind ``ae_summary``, lazy: population, report controls, distinct subjects at every depth."""
    require_columns(adae, trt, soc, pt, subject, where="ae_summary events")
    events = population(adae, flag, flag_value) if flag else adae
    return incidence(apply_choices(events, where), trt, [soc, pt], subject, total)


def ae_counts(adae: DataFrame, adsl: DataFrame, trt: str = "trta", soc: str = "aebodsys",
              pt: str = "aedecod", subject: str = "usubjid", adsl_trt: str = "trt01a",
              flag: str | None = "saffl", flag_value: str = "Y", where: dict | None = None,
              total: str = TOTAL_LABEL, max_arms: int | None = None, arms: Sequence[str] | None = None):
    """The long form behind ``ae_summary``: one row per arm x level with ranks, N and cell.

    Returns ``(long_df, arms)``. The counts are computed and written while
    building; the events are not read again.
    """
    inc = staged(event_incidence(adae, trt, soc, pt, subject, flag, flag_value, where, total), "incidence")
    bign, arms = denominators(adsl, adsl_trt, trt, subject, flag, flag_value, total,
                              inc.filter(F.col("level") == 0), max_arms, arms)
    return with_percent(rank_levels(inc, trt, [soc, pt], total), bign, trt, style="strict"), arms


def ae_summary(adae: DataFrame, adsl: DataFrame, trt: str = "trta", soc: str = "aebodsys",
               pt: str = "aedecod", subject: str = "usubjid", adsl_trt: str = "trt01a",
               flag: str | None = "saffl", flag_value: str = "Y", where: dict | None = None,
               any_label: str = ANY_EVENT_LABEL, indent: str = TERM_INDENT,
               total: str = TOTAL_LABEL, arms: Sequence[str] | None = None,
               max_arms: int | None = None) -> DataFrame:
    """Adverse events by body system and term, wide by arm, with the row order as data.

    ``where`` holds report controls such as ``{"aerel": "NONE", "aesev": "All"}``;
    they cut the numerators only (denominators come from the subject table).
    Output columns: ``label, ord_soc, ord, ord_pt, <arm>..., <total>``.
    """
    cells, found_arms = ae_counts(adae, adsl, trt, soc, pt, subject, adsl_trt, flag, flag_value,
                                  where, total, max_arms, arms)
    return _summary_wide(cells, trt, soc, pt, found_arms, any_label, indent)


def _summary_wide(cells: DataFrame, trt: str, soc: str, pt: str, arms: Sequence[str], any_label: str,
                  indent: str, by: Sequence[str] = ()) -> DataFrame:
    level = F.col("level")
    label = (F.when(level == 0, F.lit(any_label))
              .when(F.col(pt).isNull(), F.col(soc))
              .otherwise(indent_label(pt, indent)))
    shaped = cells.select(
        *by, label.alias("label"),
        F.when(level == 0, F.lit(0)).otherwise(F.col(ord_col(1))).cast("long").alias("ord_soc"),
        level.cast("long").alias("ord"),
        F.col(ord_col(2)).alias("ord_pt"),
        F.col(trt), F.col("cell"))
    wide = to_wide(shaped, [*by, "label", "ord_soc", "ord", "ord_pt"], trt, "cell", arms, fill=ZERO_CELL)
    return wide.orderBy(*by, F.col("ord_soc").asc_nulls_last(), F.col("ord").asc(),
                        F.col("ord_pt").asc_nulls_last())


def ae_summary_choices(adae: DataFrame, adsl: DataFrame, choices: Sequence[dict | None], trt: str = "trta",
                       soc: str = "aebodsys", pt: str = "aedecod", subject: str = "usubjid",
                       adsl_trt: str = "trt01a", flag: str | None = "saffl", flag_value: str = "Y",
                       any_label: str = ANY_EVENT_LABEL, indent: str = TERM_INDENT, total: str = TOTAL_LABEL,
                       arms: Sequence[str] | None = None, max_arms: int | None = None) -> DataFrame:
    """``ae_summary(where=...)`` for several settings of the report controls, from one pass over the events.

    Output columns: ``choice`` (the place of the setting in ``choices``), then
    those of ``ae_summary``. Without ``arms`` the columns are the arms of the
    subjects and of all settings.
    """
    require_columns(adae, trt, soc, pt, subject, where="ae_summary events")
    events = population(adae, flag, flag_value) if flag else adae
    controls = sorted({c for choice in choices for c in (choice or {})})
    levels = [soc, pt]
    bits = subject_bits(events, trt, levels, controls, subject, total)
    inc = staged(incidence_of(bits, trt, levels, choices), "incidence")
    bign, arms = denominators(adsl, adsl_trt, trt, subject, flag, flag_value, total,
                              inc.filter(F.col("level") == 0), max_arms, arms)
    cells = with_percent(rank_levels(inc, trt, levels, total, by=["choice"]), bign, trt, style="strict")
    return _summary_wide(cells, trt, soc, pt, arms, any_label, indent, by=["choice"])


def display(df: DataFrame, heading: str = AE_LABEL_HEADING,
            order_cols: Sequence[str] = ("ord_soc", "ord", "ord_pt")) -> DataFrame:
    """Report view: drop the order columns and give the label column its heading."""
    return df.drop(*order_cols).withColumnRenamed("label", heading)


def term_table_display(df: DataFrame) -> DataFrame:
    """Report view of ``ae_term_table``: label, arm columns and Total only."""
    return df.drop("soc_key", "is_header", "term_key")


# ---------------------------------------------------------------------------
# Term table with the event table's own denominators


def term_counts(adae: DataFrame, trt: str | Column = "trta", soc: str | Column = "aebodsys",
                pt: str | Column = "aedecod", subject: str | Column = "usubjid", with_soc_level: bool = False,
                with_arm_level: bool = False) -> DataFrame:
    """Distinct subjects per (body system, term, arm): ``soc, pt, trt, level, n``.

    No population filter, no pooled arm. More grouping sets of the SAME
    aggregation (not more queries): ``with_soc_level`` adds (body system, arm)
    rows (``level`` 1, term NULL); ``with_arm_level`` adds per-arm rows
    (``level`` 0), which are the table's own denominators. Arguments are column
    names or expressions, like in all functions of the term table.
    """
    adae, (trt, soc, pt, subject) = named_inputs(adae, trt, soc, pt, subject, where="ae_term_table")
    reject_reserved([trt, soc, pt, subject], ("level", "n", "denom", "cell", "label", "soc_key", "is_header",
                                              "term_key", "_subj"), where="ae_term_table")
    base = adae.select(F.col(subject).alias("_subj"), arm_text(trt, None).alias(trt),
                       F.col(soc).cast("string").alias(soc), F.col(pt).cast("string").alias(pt)
                       ).filter(F.col("_subj").isNotNull())
    sets = [[soc, pt, trt]] + ([[soc, trt]] if with_soc_level else []) + ([[trt]] if with_arm_level else [])
    agg = base.groupingSets(sets, soc, pt, trt).agg(
        F.countDistinct("_subj").cast("long").alias("n"), F.grouping(soc).alias("_gs"),
        F.grouping(pt).alias("_gp"))
    level = F.lit(2) - F.col("_gs") - F.col("_gp")
    return agg.select(soc, pt, trt, level.cast("int").alias("level"), "n")


def _slot(i: int) -> str:
    return f"_arm{i}"


def _arm_outputs(arms: Sequence[str]) -> list:
    """Arm slot columns renamed to the arm names (last projection only, see ``pivot_positional``)."""
    return [F.col(_slot(i)).alias(str(a)) for i, a in enumerate(arms)]


def _term_wide(long: DataFrame, keys: Sequence[str], trt: str, arms: Sequence[str],
               fill: str = ZERO_CELL_PCT, total_col: str = TOTAL_LABEL) -> DataFrame:
    """Pivot ``(n, cell)`` per arm into slot columns ``_arm<i>``; the row total sums the counts."""
    packed = F.struct(F.col("n").alias("n"), F.col("cell").alias("cell"))
    piv, slots = pivot_positional(long, list(keys), trt, packed, list(arms))
    cells = [F.coalesce(F.col(s).getField("cell"), F.lit(fill)).alias(_slot(i)) for i, s in enumerate(slots)]
    row_n = sum((F.coalesce(F.col(s).getField("n"), F.lit(0)) for s in slots), F.lit(0))
    return piv.select(*keys, *cells, row_n.cast("long").cast("string").alias(total_col))


def row_total(adae: DataFrame, trt: str | Column = "trta", soc: str | Column = "aebodsys",
              pt: str | Column = "aedecod", subject: str | Column = "usubjid") -> DataFrame:
    """Per (body system, term): the sum of the per-arm distinct-subject counts.

    A subject counted in two arms counts twice, unlike the pooled arm. The sum
    is taken on the long counts (one aggregation), not parsed back from text.
    """
    adae, (trt, soc, pt, subject) = named_inputs(adae, trt, soc, pt, subject, where="row_total")
    return (term_counts(adae, trt, soc, pt, subject)
            .groupBy(soc, pt).agg(F.sum("n").cast("long").alias("total_n")))


HEADER_MODES = ("first_term", "distinct_subjects")


def _term_rows(adae, trt, soc, pt, subject, header, arms, max_arms, fill):
    """Wide rows ``soc, pt, level, <arm>..., Total`` (level 1 = body system) and the arm list."""
    if header not in HEADER_MODES:
        raise ValueError(f"unknown header mode {header!r}")
    # One pass over the events: term (and body-system) counts plus the per-arm
    # denominators are grouping sets of one aggregation, written once. The level-0
    # rows (one per arm) are the denominators and tell the report's arms.
    counts = staged(term_counts(adae, trt, soc, pt, subject, with_soc_level=header == "distinct_subjects",
                                with_arm_level=True), "term-counts")
    den = counts.filter(F.col("level") == 0).select(trt, F.col("n").alias("denom"))
    if arms is None:
        _, arms = report_arms(None, den, trt, None, max_arms)
    arms = list(arms)
    long = join_null_safe(counts.filter(F.col("level") > 0), den, [trt])
    long = long.withColumn("cell", count_pct_cell("n", "denom", "sprintf"))
    return _term_wide(long, [soc, pt, "level"], trt, arms, fill), arms


def _with_headers(wide: DataFrame, soc: str, pt: str, header: str) -> DataFrame:
    """Term rows plus one header row per body system, from one evaluation of ``wide``.

    ``first_term``: the header repeats the cells of the body system's first
    term (term order, missing last); a window marks that row and ``explode``
    emits it twice. ``distinct_subjects``: the level-1 rows are the headers.
    Adds ``is_header`` and returns term rows with ``level`` dropped.
    """
    if header == "distinct_subjects":
        return wide.withColumn("is_header", F.col("level") == 1).drop("level")
    first = F.row_number().over(Window.partitionBy(soc).orderBy(F.col(pt).asc_nulls_last())) == 1
    marked = wide.withColumn("_first", first)
    copies = F.when(F.col("_first"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    return marked.withColumn("is_header", F.explode(copies)).drop("level", "_first")


def soc_header(adae: DataFrame, trt: str | Column = "trta", soc: str | Column = "aebodsys",
               pt: str | Column = "aedecod", subject: str | Column = "usubjid", mode: str = "first_term", arms: Sequence[str] | None = None,
               fill: str = ZERO_CELL_PCT, max_arms: int | None = None) -> DataFrame:
    """One header row per body system, wide by arm, with a row total: ``soc, <arm>..., Total``.

    ``first_term``: the header repeats the cells of the body system's first
    term in term order (missing term last), as the source layout does.
    ``distinct_subjects``: the header counts the body system's own distinct
    subjects per arm (a subject with two terms counts once).
    """
    adae, (trt, soc, pt, subject) = named_inputs(adae, trt, soc, pt, subject, where="soc_header")
    wide, arms = _term_rows(adae, trt, soc, pt, subject, mode, arms, max_arms, fill)
    rows = _with_headers(wide, soc, pt, mode)
    return rows.filter("is_header").select(soc, *_arm_outputs(arms), TOTAL_LABEL)


def ae_term_table(adae: DataFrame, trt: str | Column = "trta", soc: str | Column = "aebodsys",
                  pt: str | Column = "aedecod", subject: str | Column = "usubjid", header: str = "first_term", indent: str = TERM_INDENT,
                  arms: Sequence[str] | None = None, fill: str = ZERO_CELL_PCT,
                  max_arms: int | None = None) -> DataFrame:
    """Body-system header rows, each followed by its indented terms; own denominators.

    Output columns: ``label, soc_key, is_header, term_key, <arm>..., Total``, ordered
    by body system, header first, then term (missing last). A missing term is
    labelled with the text ``NA``. ``Total`` sums the counts of the arm columns
    shown (all arms unless ``arms`` picks some). The roles are column names or
    expressions, e.g. ``soc=F.upper("aebodsys")``.
    """
    adae, (trt, soc, pt, subject) = named_inputs(adae, trt, soc, pt, subject, where="ae_term_table")
    wide, arms = _term_rows(adae, trt, soc, pt, subject, header, arms, max_arms, fill)
    rows = _with_headers(wide, soc, pt, header)
    hdr = F.col("is_header")
    out = rows.select(
        F.when(hdr, F.col(soc)).otherwise(paste(indent, F.col(pt))).alias("label"),
        F.col(soc).alias("soc_key"), hdr.alias("is_header"),
        F.when(~hdr, F.col(pt)).alias("term_key"),
        *_arm_outputs(arms), TOTAL_LABEL)
    return out.orderBy(F.col("soc_key").asc_nulls_last(), F.col("is_header").desc(),
                       F.col("term_key").asc_nulls_last())
