"""Exact median with bounded memory: compared with a brute-force median."""
import random
import statistics

import pytest

from cohortab.operators.median import exact_median


def _brute(groups):
    return {k: statistics.median(v) for k, v in groups.items() if v}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_missed_bands_are_counted_again(spark, seed):
    rnd = random.Random(seed)
    data = []
    for g, size in (("a", 1001), ("b", 1000), ("c", 7), ("d", 400)):
        for _ in range(size):
            kind = rnd.random()
            v = rnd.choice([5.0, 7.0]) if kind < 0.3 else round(rnd.gauss(0, 100), 2)
            data.append((g, v))
    df = spark.createDataFrame(data, "g string, x double")
    groups = {}
    for g, v in data:
        groups.setdefault(g, []).append(v)
    got = {r.g: r.median for r in exact_median(df, ["g"], "x", k=8, slack=0.0).collect()}
    assert got == _brute(groups)


def test_heavy_duplicates_two_values(spark):
    data = [("a", 5.0)] * 600 + [("a", 7.0)] * 600
    df = spark.createDataFrame(data, "g string, x double")
    got = exact_median(df, ["g"], "x", k=8, slack=0.3).collect()
    assert got[0].median == 6.0


def test_all_equal_and_missing(spark):
    data = [("a", 3.0)] * 300 + [("a", None), ("b", None), ("c", float("nan")), ("c", 1.0)]
    df = spark.createDataFrame(data, "g string, x double")
    got = {r.g: r.median for r in exact_median(df, ["g"], "x", k=8, slack=0.3).collect()}
    assert got == {"a": 3.0, "c": 1.0}


def test_direct_path_default_limits(spark):
    data = [("a", float(i)) for i in range(1, 5)] + [("b", 9.0)]
    df = spark.createDataFrame(data, "g string, x double")
    got = {r.g: r.median for r in exact_median(df, ["g"], "x").collect()}
    assert got == {"a": 2.5, "b": 9.0}


def test_bands_of_a_large_group(spark):
    rnd = random.Random(7)
    vals = [round(rnd.lognormvariate(3, 1), 3) for _ in range(100_000)] + [42.0] * 20_000
    df = spark.createDataFrame([("g", v) for v in vals], "g string, x double").repartition(8)
    got = exact_median(df, ["g"], "x", k=200).collect()[0].median
    assert got == statistics.median(vals)


def test_a_band_holds_a_small_share_of_the_values(spark, monkeypatch):
    """The second pass writes one row per distinct value of the band, not per value of the group."""
    from cohortab.operators import median

    written = {}
    real = median.staged
    monkeypatch.setattr(median, "staged", lambda df, label: written.setdefault(label, real(df, label)))
    df = spark.range(200_000).selectExpr("id % 2 AS g", "double(id) AS x").repartition(8)
    got = {r.g: r.median for r in exact_median(df, ["g"], "x", k=2048).collect()}
    assert got == {0: 99_999.0, 1: 100_000.0}
    assert set(written) == {"sketches", "band-counts"}  # no group had to be counted again
    assert written["band-counts"].count() < 0.03 * 200_000


def test_infinities_many_groups_and_empty(spark):
    inf = float("inf")
    data = [("a", -inf), ("a", 1.0), ("a", inf), ("b", inf), (None, 2.0), (None, 4.0)]
    data += [(f"g{i}", float(i)) for i in range(300)]
    df = spark.createDataFrame(data, "g string, x double")
    got = {r.g: r.median for r in exact_median(df, ["g"], "x").collect()}
    assert got == {"a": 1.0, "b": inf, None: 3.0, **{f"g{i}": float(i) for i in range(300)}}
    assert exact_median(df.where("false"), ["g"], "x").collect() == []


@pytest.mark.parametrize("k", [64, 200])
def test_small_groups_come_from_the_sketch_alone(spark, monkeypatch, k):
    """Every size up to half a sketch, over several tasks, without a second pass."""
    from cohortab.operators import median

    rnd = random.Random(k)
    groups = {n: [round(rnd.gauss(0, 5), 1) for _ in range(n)] for n in range(1, k // 2 + 1)}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, x double").repartition(5)
    monkeypatch.setattr(median, "_band_counts", None)
    assert {r.g: r.median for r in exact_median(df, ["g"], "x", k=k).collect()} == _brute(groups)
