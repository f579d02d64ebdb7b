"""Histogram binning (Sturges classes, pretty breaks, right-closed bins) and preview."""
from cohortab.operators.explore import histogram, pretty_breaks, preview, sturges_classes
from conftest import rows

# A classic public sample: fuel economy (mpg) of 32 cars.
MPG = [21.0, 21.0, 22.8, 21.4, 18.7, 18.1, 14.3, 24.4, 22.8, 19.2, 17.8, 16.4, 17.3, 15.2, 10.4, 10.4,
       14.7, 32.4, 30.4, 33.9, 21.5, 15.5, 15.2, 13.3, 19.2, 27.3, 26.0, 30.4, 15.8, 19.7, 15.0, 21.4]


def test_pretty_breaks():
    assert pretty_breaks(0.0, 1.0, 5) == [0.0, 0.2, 0.4, 0.6000000000000001, 0.8, 1.0]
    assert pretty_breaks(1.0, 100.0, 5) == [0.0, 20.0, 40.0, 60.0, 80.0, 100.0]
    assert pretty_breaks(-0.5, 3.7, 5) == [-1.0, 0.0, 1.0, 2.0, 3.0, 4.0]
    assert pretty_breaks(10.4, 33.9, sturges_classes(32)) == [10.0, 15.0, 20.0, 25.0, 30.0, 35.0]


def test_histogram_counts(spark):
    df = spark.createDataFrame([(v,) for v in MPG], "mpg double")
    got = rows(histogram(df, "mpg"), "lower", "upper", "count")
    assert got == [(10.0, 15.0, 6), (15.0, 20.0, 12), (20.0, 25.0, 8), (25.0, 30.0, 2), (30.0, 35.0, 4)]


def test_histogram_right_closed_lowest_included_and_empty_bins(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 2.0, 2.0, 3.0, 3.0, 3.0]], "x double")
    assert rows(histogram(df, "x"), "count") == [(1,), (2,), (0,), (3,)]


def test_preview_is_ordered_top_rows(spark):
    df = spark.createDataFrame([(i,) for i in [5, 3, 9, 1, 7, 2, 8, 4]], "k long")
    assert rows(preview(df, "k", 6)) == [(1,), (2,), (3,), (4,), (5,), (7,)]


def test_histogram_uses_finite_values_only(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 3.0, 3.0, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert rows(histogram(df, "x"), "count") == [(1,), (2,), (0,), (3,)]
