"""Running totals over range partitions, and the written tables behind them."""
import random

import pytest
from pyspark.sql import functions as F

from cohortab.operators import ranking
from cohortab.operators.ranking import running_total
from cohortab.operators.summary import categorical_summary
from cohortab.sources import staging


@pytest.fixture
def many_parts(spark, monkeypatch):
    """No coalescing, so that small tables end in several range partitions; no table counts as small."""
    monkeypatch.setattr(ranking, "SMALL_BYTES", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _model(rows):
    out, totals = {}, {}
    for g, k, w in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        totals[g] = totals.get(g, 0) + w
        out[g, k] = totals[g]
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_running_total_matches_model(spark, many_parts, hot):
    r = random.Random(3)
    groups = ["a"] * 30 + ["b", "c", None] if hot else ["a", "b", "c", None]
    rows = [(r.choice(groups), i, r.randint(0, 5)) for i in range(2_000)]
    df = spark.createDataFrame(rows, "g string, k int, w int")
    got = running_total(df, ["g"], [F.col("k").asc()], F.col("w"), name="t")
    assert got.columns == ["g", "k", "w", "t"]
    assert {(x.g, x.k): x.t for x in got.collect()} == _model(rows)
    ranks = running_total(df, [], [F.col("k").desc()])
    assert sorted((x.k, x.pos) for x in ranks.collect()) == [(i, 2_000 - i) for i in range(2_000)]


def test_rows_of_one_group_are_spread_over_tasks(spark, many_parts):
    out = running_total(spark.range(100_000).withColumn("g", F.lit(1)), ["g"], [F.col("id").asc()])
    assert out.agg(F.max("pos")).first()[0] == 100_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "hashpartitioning(_part" in plan


def test_small_written_tables_take_one_window(spark):
    rows = [("a", 1), ("a", 2), ("b", 1), (None, 5), (None, 6)]
    df = staging.staged(spark.createDataFrame(rows, "g string, k int"), "small")
    got = running_total(df, ["g"], [F.col("k").desc()], of=df)
    assert {(x.g, x.k): x.pos for x in got.collect()} == {("a", 2): 1, ("a", 1): 2, ("b", 1): 1, (None, 6): 1, (None, 5): 2}
    large = staging.staged(spark.range(300_000), "large")
    assert staging.stored_bytes(large) > ranking.SMALL_BYTES
    plan = running_total(large, [], [F.col("id").asc()], of=large)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_empty_table(spark):
    assert running_total(spark.range(0), [], [F.col("id").asc()]).collect() == []


def test_levels_of_a_variable_with_very_many(spark, many_parts):
    df = spark.range(30_000).selectExpr("'A' AS arm", "concat('v', id) AS v")
    out = {x.Stat: x.stat_pos for x in categorical_summary(df, "arm", ["v"]).where("arm = 'Total'").collect()}
    assert out == {s: i for i, s in enumerate(sorted(f"v{i}" for i in range(30_000)), 1)}


def test_staged_tables_are_written_once_and_discarded(spark, tmp_path):
    a = staging.staged(spark.range(5), "t")
    assert staging.staged(a, "t") is a and a.count() == 5
    files = spark._jvm.org.apache.hadoop.fs.Path(a._staged_at)
    fs = files.getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(files)
    staging.discard(a)
    assert not fs.exists(files)


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_dir(Session())
