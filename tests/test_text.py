"""Cell text rules: rounding on the binary value, statistic printing, NA handling."""
import math

from pyspark.sql import functions as F

from cohortab.functions.text import count_pct_cell, number_text, paste, percent_tenths, percent_text


def _nearest(x, digits):
    """The documented rule in plain Python: nearer of the two decimals around x, even last digit on equality."""
    scale = 10.0 ** digits
    low = math.floor(x * scale)
    below, above = x - low / scale, (low + 1) / scale - x
    return low + (above < below or (above == below and low % 2 == 1))


def test_percent_tenths_matches_the_rule(spark):
    pairs = [(n, d) for d in [*range(1, 61), 2000, 4000, 80] for n in range(0, min(d, 200) + 1)]
    df = spark.createDataFrame(pairs, "n long, d long")
    got = {(r.n, r.d): r.t for r in df.select("n", "d", percent_tenths("n", "d").alias("t")).collect()}
    for n, d in pairs:
        assert got[(n, d)] == _nearest(100.0 * n / d, 1), (n, d)


def test_sprintf_cells_print_the_exact_binary_value(spark):
    pairs = [(n, d) for d in [*range(1, 41), 80, 160, 2000, 4000, 8000] for n in range(0, min(d, 400) + 1)]
    df = spark.createDataFrame(pairs, "n long, d long")
    got = {(r.n, r.d): r.t for r in df.select("n", "d", percent_text("n", "d", True).alias("t")).collect()}
    for n, d in pairs:
        assert got[(n, d)] == "%.1f" % (100.0 * n / d), (n, d)


def test_ties_that_exist_only_in_decimal(spark):
    df = spark.createDataFrame([(n, 2000) for n in (1, 3, 7, 21)], "n long, d long")
    assert [r[0] for r in df.select(percent_text("n", "d", True)).collect()] == ["0.1", "0.1", "0.3", "1.1"]
    assert [r[0] for r in df.select(percent_text("n", "d")).collect()] == ["0", "0.1", "0.3", "1"]


def test_percent_ties_round_to_even(spark):
    df = spark.createDataFrame([(1, 16), (3, 16), (1, 80), (3, 80), (1, 3), (2, 3), (4, 5)], "n long, d long")
    out = [r[0] for r in df.select(percent_text("n", "d")).collect()]
    # 6.25 -> 6.2, 18.75 -> 18.8, 1.25 -> 1.2, 3.75 -> 3.8, 33.33 -> 33.3, 66.67 -> 66.7, 80 -> 80
    assert out == ["6.2", "18.8", "1.2", "3.8", "33.3", "66.7", "80"]


def test_percent_missing_or_zero_denominator_is_null(spark):
    df = spark.createDataFrame([(1, None), (1, 0)], "n long, d long")
    assert [r[0] for r in df.select(percent_text("n", "d")).collect()] == [None, None]


def test_cell_styles(spark):
    df = spark.createDataFrame([(4, 5), (1, 3), (0, 2), (2, None)], "n long, d long")
    got = df.select(*[count_pct_cell("n", "d", s).alias(s) for s in ("strict", "paste", "percent", "sprintf")]).collect()
    assert tuple(got[0]) == ("4 (80)", "4 (80)", "4 (80%)", "4 (80.0%)")
    assert tuple(got[1]) == ("1 (33.3)", "1 (33.3)", "1 (33.3%)", "1 (33.3%)")
    assert tuple(got[2]) == ("0 (0)", "0 (0)", "0 (0%)", "0 (0.0%)")
    assert got[3]["strict"] is None and got[3]["paste"] == "2 (NA)"


def test_number_text(spark):
    vals = [12.0, 12.3, 100.0, 0.0, 1.0e7, -0.5, 7.0710678, 2.675, -0.001, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    two = [r[0] for r in df.select(number_text("x", 2)).collect()]
    assert two == ["12", "12.3", "100", "0", "10000000", "-0.5", "7.07", "2.67", "0", None]
    three = [r[0] for r in df.select(number_text("x", 3)).collect()]
    assert three[6] == "7.071"


def test_paste_prints_missing_as_na(spark):
    df = spark.createDataFrame([("a", None)], "a string, b string")
    assert df.select(paste(F.col("a"), " (", F.col("b"), ")")).first()[0] == "a (NA)"


def test_number_text_values_beyond_decimal_range(spark):
    inf = float("inf")
    df = spark.createDataFrame([(inf,), (-inf,), (float("nan"),), (1e40,), (-1e40,), (None,)], "x double")
    assert [r[0] for r in df.select(number_text("x", 2)).collect()] == ["Inf", "-Inf", "NaN", "1.0E40", "-1.0E40", None]
