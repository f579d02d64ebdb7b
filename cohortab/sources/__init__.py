"""Input tables: Parquet readers, schema checks, and the study-role adapter."""

from cohortab.sources.study import adverse_events, lab_results, subjects
from cohortab.sources.tables import is_numeric, read_table, require_columns

__all__ = ["adverse_events", "is_numeric", "lab_results", "read_table", "require_columns", "subjects"]
