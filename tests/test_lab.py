"""Lab flag tables on the hand fixture and trap cases."""
from cohortab.operators.labflags import flag_code, flag_counts, one_flag_per_subject, rank_flags
from cohortab.plans.lab import lab_table, lab_table_grid
from conftest import rows
from fixture_data import H, L, P

ARMS = [P, H, L, "Total"]


def test_flag_code(spark, fx):
    _, _, adlb = fx
    got = rows(flag_code(adlb).select("lbnrind", "lbnrindn").distinct().orderBy("lbnrindn"))
    assert got == [(None, None), ("LOW", 1.0), ("NORMAL", 2.0), ("HIGH", 3.0)]


def test_one_flag_per_subject_text_order(spark, fx):
    _, _, adlb = fx
    got = {(r.usubjid, r.trta, r.param): r.lbnrind for r in one_flag_per_subject(adlb).collect()}
    assert got[("S01", P, "ALT")] == "HIGH"      # HIGH before NORMAL
    assert got[("S02", P, "ALT")] == "LOW"       # LOW before NORMAL
    assert got[("S04", H, "ALT")] is None        # only a missing flag
    assert got[("S05", "Total", "K")] == "HIGH"  # HIGH before LOW
    assert len(got) == 10


def test_empty_flag_wins_and_missing_loses(spark):
    df = spark.createDataFrame([("s1", "A", "P", ""), ("s1", "A", "P", "HIGH"), ("s2", "A", "P", None),
                                ("s2", "A", "P", "LOW")], "usubjid string, trta string, param string, lbnrind string")
    got = {(r.usubjid, r.trta): r.lbnrind for r in one_flag_per_subject(df).collect()}
    assert got[("s1", "A")] == "" and got[("s2", "A")] == "LOW"


def test_lab_table_fixture(spark, fx):
    adsl, _, adlb = fx
    got = rows(lab_table(adlb, adsl), "label", *ARMS)
    assert got == [
        ("ALT", "2 (100)", "2 (100)", "0", "4 (80)"),
        ("HIGH", "1 (50)", "0", "0", "1 (20)"),
        ("LOW", "1 (50)", "0", "0", "1 (20)"),
        ("NORMAL", "0", "1 (50)", "0", "1 (20)"),
        ("ALT", "0", "1 (50)", "0", "1 (20)"),
        ("K", "0", "0", "1 (100)", "1 (20)"),
        ("HIGH", "0", "0", "1 (100)", "1 (20)"),
    ]


def test_lab_table_drops_empty_label_rows(spark):
    adsl = spark.createDataFrame([("s1", "A", "Y")], "usubjid string, trt01a string, saffl string")
    adlb = spark.createDataFrame([("s1", "A", "P", "", "Y")],
                                 "usubjid string, trta string, param string, lbnrind string, saffl string")
    assert rows(lab_table(adlb, adsl), "label", "A") == [("P", "1 (100)")]


def test_lab_grid_fixture(spark, fx):
    adsl, _, adlb = fx
    got = rows(lab_table_grid(adlb, adsl), "label", "flag_code", *ARMS)
    assert got == [
        ("ALT", 0, "2 (100)", "2 (100)", "0", "4 (80)"),
        ("LOW", 1, "1 (50)", "0", "0", "1 (20)"),
        ("NORMAL", 2, "0", "1 (50)", "0", "1 (20)"),
        ("HIGH", 3, "1 (50)", "0", "0", "1 (20)"),
        ("K", 0, "0", "0", "1 (100)", "1 (20)"),
        ("LOW", 1, "0", "0", "0", "0"),
        ("NORMAL", 2, "0", "0", "0", "0"),
        ("HIGH", 3, "0", "0", "1 (100)", "1 (20)"),
    ]


def test_lab_grid_chosen_params(spark, fx):
    adsl, _, adlb = fx
    got = rows(lab_table_grid(adlb, adsl, params=["K"]), "label")
    assert got == [("K",), ("LOW",), ("NORMAL",), ("HIGH",)]


def test_flag_only_an_arm_has_gets_no_rank(spark):
    # s1 is in arms A and B: A picks HIGH, B picks LOW, pooled picks HIGH -> LOW absent from pooled
    df = spark.createDataFrame([("s1", "A", "P", "HIGH"), ("s1", "B", "P", "LOW")],
                               "usubjid string, trta string, param string, lbnrind string")
    ranked = rank_flags(flag_counts(one_flag_per_subject(df)))
    got = {(r.trta, r.lbnrind): r.ord_gra for r in ranked.filter("level = 2").collect()}
    assert got == {("A", "HIGH"): 1, ("B", "LOW"): None, ("Total", "HIGH"): 1}


def test_arm_without_denominator_prints_na_percent(spark):
    adsl = spark.createDataFrame([("s1", "A", "Y")], "usubjid string, trt01a string, saffl string")
    adlb = spark.createDataFrame([("s1", "A", "P", "LOW", "Y"), ("s2", "B", "P", "LOW", "Y")],
                                 "usubjid string, trta string, param string, lbnrind string, saffl string")
    got = rows(lab_table(adlb, adsl), "label", "A", "B", "Total")
    assert got == [("P", "1 (100)", "1 (NA)", "2 (200)"), ("LOW", "1 (100)", "1 (NA)", "2 (200)")]


def test_flag_without_pooled_rank_sorts_last_within_its_parameter(spark):
    # s1 is in arms A and B: A picks HIGH, B picks LOW; the pooled pick is HIGH, so LOW has no rank
    adsl = spark.createDataFrame([("s1", "A", "Y")], "usubjid string, trt01a string, saffl string")
    adlb = spark.createDataFrame([("s1", "A", "P", "HIGH", "Y"), ("s1", "B", "P", "LOW", "Y")],
                                 "usubjid string, trta string, param string, lbnrind string, saffl string")
    got = rows(lab_table(adlb, adsl, arms=["A", "B", "Total"]), "label", "ord", "ord_gra")
    assert got == [("P", 1, 0), ("HIGH", 2, 1), ("LOW", 2, None)]


def test_lab_table_headers_agree_with_param_incidence(spark):
    import __spark_entry__ as ent
    d = "/root/testdata/sf0.01"
    heads = ent.q_lab_table(spark, d).filter("ord = 1").select("param", "Total").collect()
    got = {r.param: int(r.Total.split(" ")[0]) for r in heads}
    want = {r.param: r.n for r in ent.q_param_incidence(spark, d).filter("trta = 'Total'").collect()}
    assert got == want and len(got) > 0
