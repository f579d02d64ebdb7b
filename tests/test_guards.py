"""The caller's own limits, large level lists, changed schemas, reserved names."""
import pytest

from cohortab.plans.ae import ae_summary, ae_term_table
from cohortab.plans.demo import demo_table
from cohortab.sources.tables import read_table


def test_report_refuses_more_arms_than_allowed(spark, fx):
    adsl, adae, _ = fx
    with pytest.raises(ValueError, match="more than"):
        ae_summary(adae, adsl, max_arms=2)
    with pytest.raises(ValueError, match="more than"):
        ae_term_table(adae, max_arms=2)
    assert len(ae_summary(adae, adsl, max_arms=3).columns) == 8


def test_demo_table_of_a_variable_with_many_levels(spark):
    df = spark.range(120_000).selectExpr("if(id % 2 = 0, 'A', 'B') arm", "cast(id as string) v")
    out = demo_table(df, "arm", ["v"])
    assert out.columns[-3:] == ["A", "B", "Total"]
    got = out.agg({"stat_pos": "max", "*": "count"}).first()
    assert sorted(got) == [120_000, 120_000]


def test_a_rewritten_table_is_read_with_its_new_columns(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(path)
    assert read_table(spark, str(tmp_path), "t").columns == ["id"]
    spark.range(3).selectExpr("id", "id + 1 more").write.mode("overwrite").parquet(path)
    assert read_table(spark, str(tmp_path), "t").columns == ["id", "more"]


def test_argument_columns_named_like_outputs_are_rejected(spark):
    from cohortab.operators.incidence import incidence
    from cohortab.operators.summary import numeric_stats
    df = spark.createDataFrame([("s1", "A", "x", 1.0)], "usubjid string, level string, n string, Stat double")
    with pytest.raises(ValueError, match="output columns"):
        incidence(df, "level", ["n"])
    with pytest.raises(ValueError, match="output columns"):
        numeric_stats(df.withColumnRenamed("level", "Variable"), "Variable", ["Stat"])
