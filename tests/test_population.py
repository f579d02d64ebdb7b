"""population, with_total, big_n, self_big_n, choice_filter, facet_values."""
import pytest

from cohortab.operators.denominators import big_n, self_big_n
from cohortab.operators.population import apply_choices, choice_filter, default_choice, facet_values, population, with_total
from conftest import rows
from fixture_data import H, L, P


def test_population_drops_other_and_missing_flags(spark):
    df = spark.createDataFrame([("a", "Y"), ("b", "N"), ("c", None)], "id string, saffl string")
    assert rows(population(df), "id") == [("a",)]


def test_with_total_doubles_rows(spark, fx):
    adsl, _, _ = fx
    out = with_total(adsl.select("usubjid", "trt01a"), "trt01a")
    assert out.count() == 12
    assert sorted(r[0] for r in rows(out.filter("trt01a = 'Total'"), "usubjid")) == [f"S0{i}" for i in range(1, 7)]


def test_with_total_rejects_arm_named_like_pooled_arm(spark):
    df = spark.createDataFrame([("a", "Total")], "id string, arm string")
    with pytest.raises(Exception, match="collides"):
        with_total(df, "arm").collect()


def test_big_n(spark, fx):
    adsl, _, _ = fx
    got = dict(rows(big_n(adsl, "trt01a", name="trta")))
    assert got == {P: 2, H: 2, L: 1, "Total": 5}


def test_big_n_counts_subject_once_in_total_and_ignores_missing_ids(spark):
    df = spark.createDataFrame([("s1", "A", "Y"), ("s1", "B", "Y"), ("s2", "A", "Y"), (None, "A", "Y")],
                               "usubjid string, trt string, saffl string")
    assert dict(rows(big_n(df, "trt"))) == {"A": 2, "B": 1, "Total": 2}


def test_self_big_n_has_no_population_filter_and_no_total(spark, fx):
    _, adae, _ = fx
    assert dict(rows(self_big_n(adae, "trta"))) == {P: 1, H: 2, L: 2}


def test_choice_filter(spark, fx):
    _, adae, _ = fx
    assert choice_filter(adae, "aerel", "All").count() == 9
    assert choice_filter(adae, "aerel", "NONE").count() == 4
    assert choice_filter(adae, "aesev", ["MILD", "SEVERE"]).count() == 7
    assert apply_choices(adae, {"aerel": "NONE", "aesev": "MILD"}).count() == 4


def test_sex_all_choice_drops_other_and_missing(spark):
    df = spark.createDataFrame([("M",), ("F",), ("U",), (None,)], "sex string")
    assert choice_filter(df, "sex", ["M", "F"]).count() == 2


def test_facet_values_are_the_whole_sorted_list(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", None, "f", "c", "e", "d", "a"]], "p string")
    assert [r[0] for r in facet_values(df, "p").collect()] == list("abcdef")
    assert [r[0] for r in default_choice(df, "p").collect()] == list("abcde")
    assert [r[0] for r in default_choice(df, "p", 1).collect()] == ["a"]
