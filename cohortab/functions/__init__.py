"""Column-level helpers (all built-in Spark expressions, no Python UDFs)."""

from cohortab.functions.text import (
    count_pct_cell,
    indent_label,
    number_text,
    paste,
    percent_tenths,
    percent_text,
    tenths_text,
)

__all__ = [
    "count_pct_cell",
    "indent_label",
    "number_text",
    "paste",
    "percent_tenths",
    "percent_text",
    "tenths_text",
]
