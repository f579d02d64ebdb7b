"""Plan-shape checks: the scale properties the operators are built for."""
import re
import sys

import pytest

import __spark_entry__ as ent
from cohortab.operators import ranking
from cohortab.plans import ae
from cohortab.sources import staging

SF = "/root/testdata/sf0.01"


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def _scans(plan):
    return re.findall(r"FileScan parquet .*?/(\w+)\.parquet\]", plan)


def test_distinct_count_shuffles_on_subject_so_pooled_arm_spreads(spark):
    plan = ent.q_incidence(spark, SF)._jdf.queryExecution().executedPlan().toString()
    keyed = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert any("_subj" in k and "spark_grouping_id" in k for k in keyed), keyed
    assert "Expand" in plan


OWN = sorted(n for n in ent.queries() if n != "pipeline" and not re.match(r"op\d+_", n))
# This query's sketches are made to miss the middle, so its values are read for the sketches,
# for the bands, and for whole groups.
MISSING = {"median_narrowed": 3}


@pytest.fixture
def written(monkeypatch):
    """The plans of all tables that a query writes while it is built."""
    plans = []
    real = staging.staged

    def recorded(df, label, codec="zstd"):
        if not getattr(df, "_staged_at", None):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, label, codec)

    for m in list(sys.modules.values()):
        if getattr(m, "staged", None) is real:
            monkeypatch.setattr(m, "staged", recorded)
    return plans


@pytest.mark.parametrize("name", OWN)
def test_queries_scan_each_input_once(spark, written, name):
    # Over everything a query runs. ``customer`` is the subject table, the arm lookup of
    # the event adapter and the source of the denominators, so it may appear more often.
    df = ent.queries()[name](spark, SF)
    scans = [t for plan in [*written, _final_plan(df)] for t in _scans(plan)]
    counts = {t: scans.count(t) for t in set(scans)}
    most = MISSING.get(name, 1)
    assert counts and all(c <= most for t, c in counts.items() if t != "customer"), counts
    assert counts.get("customer", 0) <= max(2, most), counts


@pytest.mark.parametrize("name", ["rank_levels", "ae_summary", "lab_table", "flag_incidence", "param_incidence",
                                  "categorical_summary", "demo_table", "ae_term_table", "numeric_split"])
def test_no_task_gets_all_rows(spark, written, name, monkeypatch):
    monkeypatch.setattr(ranking, "SMALL_BYTES", -1)  # as with tables of any size
    df = ent.queries()[name](spark, SF)
    for plan in [*written, df._jdf.queryExecution().executedPlan().toString()]:
        assert "SinglePartition" not in plan, plan
        # no window gathers the rows of an arm or of a variable
        assert not re.search(r"windowspecdefinition\((?:trta|trt01a|Variable)#", plan), plan


def test_report_filters_reach_the_parquet_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        plan = ae.event_incidence(ent._adae(spark, SF), where=ent.AE_CHOICES)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(o_orderstatus,F)" in plan and "EqualTo(o_orderpriority,1-URGENT)" in plan


def test_only_needed_columns_are_read(spark):
    plan = ae.event_incidence(ent._adae(spark, SF))._jdf.queryExecution().executedPlan().toString()
    line_schema = re.search(r"lineitem\.parquet\].*?ReadSchema: (struct<[^>]*>)", plan).group(1)
    assert line_schema == "struct<l_orderkey:bigint,l_partkey:bigint>"


def test_unused_lookups_are_removed(spark):
    plan = ent.q_big_n(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "nation.parquet" not in plan and "region.parquet" not in plan


def test_small_sides_end_up_broadcast(spark):
    plan = _final_plan(ent.q_ae_summary(spark, SF))
    assert "SortMergeJoin" not in plan
    assert "BroadcastHashJoin" in plan


@pytest.mark.parametrize("name", OWN)
def test_no_python_udf_in_any_plan(spark, name):
    plan = ent.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "PythonUDF" not in plan
