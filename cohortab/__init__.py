"""cohortab: patient-study summary tables as Spark DataFrame operators.

Subject, adverse-event and lab tables in; denominators per arm with a pooled
Total, baseline summaries, distinct-subject incidence with rank ordering and
lab-flag incidence out. Every operator takes DataFrames plus column names and
returns a lazy DataFrame; Spark plans, shuffles and executes.
"""

__version__ = "0.1.0"

from cohortab.operators.denominators import big_n, self_big_n  # noqa: E402
from cohortab.operators.explore import histogram, preview  # noqa: E402
from cohortab.operators.incidence import incidence, rank_levels, with_percent  # noqa: E402
from cohortab.operators.labflags import flag_code, one_flag_per_subject  # noqa: E402
from cohortab.operators.population import (  # noqa: E402
    apply_choices,
    choice_filter,
    facet_values,
    population,
    with_total,
)
from cohortab.operators.reshape import complete_grid, to_long, to_wide  # noqa: E402
from cohortab.operators.summary import categorical_summary, numeric_stats, numeric_summary  # noqa: E402
from cohortab.plans.ae import ae_summary, ae_term_table, row_total, soc_header  # noqa: E402
from cohortab.plans.demo import demo_table  # noqa: E402
from cohortab.plans.lab import lab_table, lab_table_grid  # noqa: E402

__all__ = [
    "ae_summary", "ae_term_table", "apply_choices", "big_n", "categorical_summary", "choice_filter",
    "complete_grid", "demo_table", "facet_values", "flag_code", "histogram", "incidence", "lab_table",
    "lab_table_grid", "numeric_stats", "numeric_summary", "one_flag_per_subject", "population", "preview",
    "rank_levels", "row_total", "self_big_n", "soc_header", "to_long", "to_wide", "with_percent", "with_total",
]
