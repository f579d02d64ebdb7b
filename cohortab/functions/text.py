"""Cell text: percents, statistics and labels as JVM-side Column expressions.

Numbers are rounded on the binary value of the double, as the reports' own
rounding does:

* ``round`` style: of the two decimals around a value, the nearer one by the
  difference of doubles, the one with the even last digit when both are equally
  near (2.675 -> 2.67, 0.15 -> 0.1, 6.25 -> 6.2).
* ``sprintf`` style (one decimal always shown): the exact binary value decides,
  an exact tie goes to the even digit. The product with 20 is split into two
  exact doubles, so no decimal tie is invented or lost.
* Statistics print without trailing zeros (``12.50`` -> ``12.5``), and what is no
  number as ``NaN``, ``Inf`` or ``-Inf``.
* ``paste`` joins text and prints a missing value as ``NA``; plain
  ``F.concat`` gives NULL when any part is missing (the "strict" cell style).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortab.fixed import NA_TEXT, NAN_TEXT, NEGATIVE_INFINITY_TEXT, POSITIVE_INFINITY_TEXT, TERM_INDENT

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _idiv(a: Column, b: Column) -> Column:
    """Integer division of non-negative longs, exact (quotient is integral)."""
    return ((a - a % b) / b).cast("long")


def nearest_steps(x: ColumnOrName, scale: int) -> Column:
    """``round(x, d)`` with ``scale`` = 10**d, as a whole number of steps of 1/scale."""
    x = _col(x).cast("double")
    low = F.floor(x * F.lit(float(scale)))
    below = x - low / F.lit(float(scale))
    above = (low + 1) / F.lit(float(scale)) - x
    up = (above < below) | ((above == below) & (F.abs(low % 2) == 1))
    return low + up.cast("long")


def exact_tenths(x: ColumnOrName) -> Column:
    """Tenths of a non-negative ``x`` as ``%.1f`` prints them: exact binary value, ties to even."""
    x = _col(x).cast("double")
    low = F.floor(x * F.lit(10.0))
    wide = x * F.lit(134217729.0)  # 2**27 + 1: splits a double into two halves that multiply exactly
    head = wide - (wide - x)
    over = (head * F.lit(20.0) - (2 * low + 1).cast("double")) + (x - head) * F.lit(20.0)
    return low + ((over > 0) | ((over == 0) & (low % 2 == 1))).cast("long")


def percent_value(n: ColumnOrName, denom: ColumnOrName) -> Column:
    """``100 * n / denom`` as a double; NULL if denom is NULL or <= 0."""
    n, denom = _col(n).cast("long"), _col(denom).cast("long")
    return F.lit(100.0) * n / F.when(denom > 0, denom)


def percent_tenths(n: ColumnOrName, denom: ColumnOrName) -> Column:
    """``round(100*n/denom, 1)`` as integer tenths; NULL if denom is NULL or <= 0."""
    return nearest_steps(percent_value(n, denom), 10)


def tenths_text(tenths: ColumnOrName, keep_zero_decimal: bool = False) -> Column:
    """Tenths as text: ``667 -> '66.7'``; ``800 -> '80'`` (or ``'80.0'`` when keep_zero_decimal)."""
    t = _col(tenths)
    whole = _idiv(t, F.lit(10)).cast("string")
    digit = (t % 10).cast("string")
    if keep_zero_decimal:
        return F.concat(whole, F.lit("."), digit)
    return F.when(t % 10 == 0, whole).otherwise(F.concat(whole, F.lit("."), digit))


def percent_text(n: ColumnOrName, denom: ColumnOrName, keep_zero_decimal: bool = False) -> Column:
    """Rounded percent of n in denom as text; NULL when denom is missing.

    With ``keep_zero_decimal`` it is rounded as ``sprintf`` does, else as ``round`` does.
    """
    tenths = exact_tenths(percent_value(n, denom)) if keep_zero_decimal else percent_tenths(n, denom)
    return tenths_text(tenths, keep_zero_decimal)


def count_pct_cell(n: ColumnOrName, denom: ColumnOrName, style: str = "strict") -> Column:
    """A count cell with its percent, in the four styles the reports use.

    ``strict``  -> ``'4 (80)'``, NULL when the denominator is missing.
    ``paste``   -> ``'4 (80)'``, ``'4 (NA)'`` when the denominator is missing.
    ``percent`` -> ``'4 (80%)'`` (demography, denominator always present).
    ``sprintf`` -> ``'4 (80.0%)'`` (one decimal always shown).
    """
    n_txt = _col(n).cast("long").cast("string")
    if style == "strict":
        return F.concat(n_txt, F.lit(" ("), percent_text(n, denom), F.lit(")"))
    if style == "paste":
        pct = F.coalesce(percent_text(n, denom), F.lit(NA_TEXT))
        return F.concat(n_txt, F.lit(" ("), pct, F.lit(")"))
    if style == "percent":
        pct = F.coalesce(percent_text(n, denom), F.lit(NA_TEXT))
        return F.concat(n_txt, F.lit(" ("), pct, F.lit("%)"))
    if style == "sprintf":
        return F.concat(n_txt, F.lit(" ("), percent_text(n, denom, keep_zero_decimal=True), F.lit("%)"))
    raise ValueError(f"unknown cell style {style!r}")


def number_text(x: ColumnOrName, digits: int) -> Column:
    """A statistic as ``round(x, digits)``, printed without trailing zeros."""
    if digits < 1:
        raise ValueError("digits must be >= 1")
    value, scale = _col(x).cast("double"), 10 ** digits
    steps = nearest_steps(value, scale).try_cast("decimal(18,0)")
    # From 2**52 steps on a double has no digits to round away.
    fine = F.abs(value) * F.lit(float(scale)) < F.lit(float(1 << 52))
    rounded = F.when(fine, (steps / F.lit(scale)).cast(f"decimal(38,{digits})")).otherwise(
        value.try_cast(f"decimal(38,{digits})")).cast("string")
    stripped = F.regexp_replace(rounded, r"\.?0+$", "")
    text = F.when(stripped == "-0", F.lit("0")).otherwise(stripped)
    # Values a decimal cannot hold (|x| >= 1e36) print as plain doubles, those that are no numbers by name.
    endless = F.when(value > 0, F.lit(POSITIVE_INFINITY_TEXT)).otherwise(F.lit(NEGATIVE_INFINITY_TEXT))
    return (F.when(F.isnan(value), F.lit(NAN_TEXT)).when(F.abs(value) == F.lit(float("inf")), endless)
            .when(rounded.isNull() & value.isNotNull(), value.cast("string")).otherwise(text))


def paste(*parts: ColumnOrName | str) -> Column:
    """Join text pieces; a missing piece prints as ``NA`` (string literals are literal text)."""
    cols = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit(NA_TEXT)) for p in parts]
    return F.concat(*cols)


def indent_label(term: ColumnOrName, indent: str = TERM_INDENT) -> Column:
    """An indented term label; NULL term stays NULL."""
    return F.concat(F.lit(indent), _col(term).cast("string"))
