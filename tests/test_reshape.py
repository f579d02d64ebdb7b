"""to_wide fills absent combinations only; to_long unpivots mixed types as text; complete_grid."""
from cohortab.operators.reshape import complete_grid, to_long, to_wide
from conftest import rows


def test_to_wide_fills_absent_only(spark):
    df = spark.createDataFrame([("r1", "A", "x"), ("r1", "B", None), ("r2", "A", "y")],
                               "id string, arm string, v string")
    got = rows(to_wide(df, ["id"], "arm", "v", ["A", "B", "C"], fill="0").orderBy("id"))
    assert got == [("r1", "x", None, "0"), ("r2", "y", "0", "0")]


def test_to_wide_without_fill_keeps_missing(spark):
    df = spark.createDataFrame([("r1", "A", "x")], "id string, arm string, v string")
    assert rows(to_wide(df, ["id"], "arm", "v", ["A", "B"])) == [("r1", "x", None)]


def test_to_long_mixed_types_as_text(spark):
    df = spark.createDataFrame([(1, 2.5, "a", None)], "id int, x double, s string, t string")
    got = rows(to_long(df, ["id"], ["x", "s", "t"]).orderBy("Stat"))
    assert got == [(1, "s", "a"), (1, "t", None), (1, "x", "2.5")]


def test_complete_grid_adds_placeholders_from_anchor_rows(spark):
    df = spark.createDataFrame([("P", 0, "A", "h"), ("P", 2, "A", "two")], "p string, code long, arm string, cell string")
    got = rows(complete_grid(df, "code", [1, 2, 3], 0, ["cell"]).orderBy("code", "cell"))
    assert got == [("P", 0, "A", "h"), ("P", 1, "A", None), ("P", 2, "A", None), ("P", 2, "A", "two"),
                   ("P", 3, "A", None)]
