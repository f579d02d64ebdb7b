"""Adverse-event tables on the hand fixture (FIXTURES.md section 3) and trap cases."""
from cohortab.operators.incidence import incidence, rank_levels, rank_tables
from cohortab.plans.ae import ae_summary, ae_term_table, display, row_total, soc_header
from conftest import rows
from fixture_data import H, L, P

ARMS = [P, H, L, "Total"]


def _table(df):
    return [tuple(r) for r in df.select("label", *ARMS).collect()]


def test_ae_summary_fixture(spark, fx):
    adsl, adae, _ = fx
    assert _table(ae_summary(adae, adsl)) == [
        ("Any TEAE", "1 (50)", "2 (100)", "1 (100)", "4 (80)"),
        ("SKIN", "0", "2 (100)", "1 (100)", "3 (60)"),
        ("  RASH", "0", "2 (100)", "1 (100)", "3 (60)"),
        ("  PRURITUS", "0", "1 (50)", "0", "1 (20)"),
        ("GI", "1 (50)", "1 (50)", "0", "2 (40)"),
        ("  NAUSEA", "1 (50)", "1 (50)", "0", "2 (40)"),
        ("  VOMITING", "1 (50)", "0", "0", "1 (20)"),
    ]


def test_ae_summary_filter_cuts_numerators_only(spark, fx):
    adsl, adae, _ = fx
    assert _table(ae_summary(adae, adsl, where={"aerel": "NONE", "aesev": "All"})) == [
        ("Any TEAE", "1 (50)", "1 (50)", "0", "2 (40)"),
        ("GI", "1 (50)", "0", "0", "1 (20)"),
        ("  NAUSEA", "1 (50)", "0", "0", "1 (20)"),
        ("  VOMITING", "1 (50)", "0", "0", "1 (20)"),
        ("SKIN", "0", "1 (50)", "0", "1 (20)"),
        ("  PRURITUS", "0", "1 (50)", "0", "1 (20)"),
    ]


def test_ae_summary_row_order_is_data(spark, fx):
    adsl, adae, _ = fx
    got = rows(ae_summary(adae, adsl), "ord_soc", "ord", "ord_pt")
    assert got == [(0, 0, None), (1, 1, None), (1, 2, 1), (1, 2, 2), (2, 1, None), (2, 2, 1), (2, 2, 2)]


def test_display_heading(spark, fx):
    adsl, adae, _ = fx
    out = display(ae_summary(adae, adsl))
    assert out.columns[0] == "System Organ Class/\nPreferred Term" and "ord" not in out.columns


def test_missing_term_gets_body_system_label_and_missing_body_system_matches(spark):
    adsl = spark.createDataFrame([("s1", "A", "Y"), ("s2", "A", "Y")], "usubjid string, trt01a string, saffl string")
    adae = spark.createDataFrame(
        [("s1", "A", "GI", None, "Y"), ("s2", "A", None, "X", "Y"), ("s2", "A", None, None, "Y")],
        "usubjid string, trta string, aebodsys string, aedecod string, saffl string")
    out = ae_summary(adae, adsl)
    got = rows(out, "label", "ord_soc", "ord", "ord_pt", "A", "Total")
    assert got == [
        ("Any TEAE", 0, 0, None, "2 (100)", "2 (100)"),
        ("GI", 1, 1, None, "1 (50)", "1 (50)"),
        ("GI", 1, 2, 1, "1 (50)", "1 (50)"),
        (None, 2, 1, None, "1 (50)", "1 (50)"),
        ("  X", 2, 2, 1, "1 (50)", "1 (50)"),
        (None, 2, 2, 2, "1 (50)", "1 (50)"),
    ]


def test_arm_without_denominator_gives_missing_cell(spark):
    adsl = spark.createDataFrame([("s1", "A", "Y")], "usubjid string, trt01a string, saffl string")
    adae = spark.createDataFrame([("s1", "A", "GI", "N", "Y"), ("s2", "B", "GI", "N", "Y")],
                                 "usubjid string, trta string, aebodsys string, aedecod string, saffl string")
    out = ae_summary(adae, adsl)
    assert out.columns[4:] == ["A", "B", "Total"]
    first = out.first()
    assert first["A"] == "1 (100)" and first["B"] is None and first["Total"] == "2 (200)"


def test_incidence_levels_and_pooled_arm(spark, fx):
    _, adae, _ = fx
    inc = incidence(adae.filter("saffl = 'Y'"), "trta", ["aebodsys", "aedecod"])
    got = {(r.trta, r.level, r.aebodsys, r.aedecod): r.n for r in inc.collect()}
    assert got[("Total", 0, None, None)] == 4
    assert got[("Total", 1, "SKIN", None)] == 3
    assert got[(H, 2, "SKIN", "RASH")] == 2
    assert got[(P, 1, "GI", None)] == 1


def test_rank_tables(spark, fx):
    _, adae, _ = fx
    levels = ["aebodsys", "aedecod"]
    inc = incidence(adae.filter("saffl = 'Y'"), "trta", levels)
    got = rows(rank_tables(rank_levels(inc, "trta", levels), "trta", levels).orderBy("level", "aebodsys", "ord"))
    assert got == [(1, "GI", None, 2), (1, "SKIN", None, 1), (2, "GI", "NAUSEA", 1), (2, "GI", "VOMITING", 2),
                   (2, "SKIN", "RASH", 1), (2, "SKIN", "PRURITUS", 2)]


TERM_ARMS = [P, H, L, "Total"]


def test_ae_term_table_fixture(spark, fx):
    _, adae, _ = fx
    got = [tuple(r) for r in ae_term_table(adae).select("label", *TERM_ARMS).collect()]
    assert got == [
        ("GI", "1 (100.0%)", "1 (50.0%)", "1 (50.0%)", "3"),
        ("  NAUSEA", "1 (100.0%)", "1 (50.0%)", "1 (50.0%)", "3"),
        ("  VOMITING", "1 (100.0%)", "0 (0.0%)", "0 (0.0%)", "1"),
        ("SKIN", "0 (0.0%)", "1 (50.0%)", "0 (0.0%)", "1"),
        ("  PRURITUS", "0 (0.0%)", "1 (50.0%)", "0 (0.0%)", "1"),
        ("  RASH", "0 (0.0%)", "2 (100.0%)", "1 (50.0%)", "3"),
    ]


def test_soc_header_modes(spark, fx):
    _, adae, _ = fx
    first = {r.aebodsys: (r[H], r.Total) for r in soc_header(adae, mode="first_term").collect()}
    distinct = {r.aebodsys: (r[H], r.Total) for r in soc_header(adae, mode="distinct_subjects").collect()}
    assert first["SKIN"] == ("1 (50.0%)", "1")
    assert distinct["SKIN"] == ("2 (100.0%)", "3")
    for soc in first:  # a body system's own count is never below its first term's
        assert int(distinct[soc][1]) >= int(first[soc][1])


def test_row_total_counts_subject_in_two_arms_twice(spark):
    adae = spark.createDataFrame([("s1", "A", "GI", "N"), ("s1", "B", "GI", "N")],
                                 "usubjid string, trta string, aebodsys string, aedecod string")
    assert rows(row_total(adae)) == [("GI", "N", 2)]


def test_missing_term_prints_na_in_term_table(spark):
    adae = spark.createDataFrame([("s1", "A", "GI", None)], "usubjid string, trta string, aebodsys string, aedecod string")
    labels = [r[0] for r in ae_term_table(adae).select("label").collect()]
    assert labels == ["GI", "  NA"]


def test_missing_arm_is_its_own_na_column(spark):
    adsl = spark.createDataFrame([("s1", "A", "Y"), ("s2", None, "Y")], "usubjid string, trt01a string, saffl string")
    adae = spark.createDataFrame([("s1", "A", "GI", "N", "Y"), ("s2", None, "GI", "N", "Y")],
                                 "usubjid string, trta string, aebodsys string, aedecod string, saffl string")
    out = ae_summary(adae, adsl)
    assert out.columns[-3:] == ["A", "NA", "Total"]
    assert tuple(out.first())[-3:] == ("1 (100)", "1 (100)", "2 (100)")
    term = ae_term_table(adae)
    assert term.columns[-3:] == ["A", "NA", "Total"]


def test_arms_in_byte_order_and_absent_requested_arm_is_filled(spark):
    adsl = spark.createDataFrame([("s1", "b", "Y"), ("s2", "B", "Y"), ("s3", "a", "Y")],
                                 "usubjid string, trt01a string, saffl string")
    adae = spark.createDataFrame([("s1", "b", "GI", "N", "Y")],
                                 "usubjid string, trta string, aebodsys string, aedecod string, saffl string")
    assert ae_summary(adae, adsl).columns[4:] == ["B", "a", "b", "Total"]
    out = ae_summary(adae, adsl, arms=["b", "X", "Total"])
    assert rows(out, "label", "b", "X", "Total")[0] == ("Any TEAE", "1 (100)", "0", "1 (33.3)")


def test_arms_differing_only_in_case_stay_apart_in_every_layout(spark):
    from cohortab.plans.lab import lab_table_grid
    adsl = spark.createDataFrame([("s1", "b", "Y"), ("s2", "B", "Y")], "usubjid string, trt01a string, saffl string")
    adae = spark.createDataFrame([("s1", "b", "GI", "N", "Y"), ("s2", "B", "GI", "M", "Y")],
                                 "usubjid string, trta string, aebodsys string, aedecod string, saffl string")
    term = ae_term_table(adae)
    assert term.columns[-3:] == ["B", "b", "Total"]
    # header = first term (M, arm B), then M, then N (arm b)
    assert [tuple(r)[-3:] for r in term.collect()] == [("1 (100.0%)", "0 (0.0%)", "1"),
                                                       ("1 (100.0%)", "0 (0.0%)", "1"),
                                                       ("0 (0.0%)", "1 (100.0%)", "1")]
    assert soc_header(adae, mode="distinct_subjects").columns == ["aebodsys", "B", "b", "Total"]
    adlb = spark.createDataFrame([("s1", "b", "P", "LOW", "Y")],
                                 "usubjid string, trta string, param string, lbnrind string, saffl string")
    grid = lab_table_grid(adlb, adsl)
    assert grid.columns[-3:] == ["B", "b", "Total"] and tuple(grid.first())[-3:] == ("0", "1 (100)", "1 (50)")


def test_term_table_total_equals_row_total_operator(spark):
    import __spark_entry__ as ent
    d = "/root/testdata/sf0.01"
    term = ent.q_ae_term_table(spark, d).filter("NOT is_header")
    got = {(r.soc_key, r.term_key): int(r.Total) for r in term.select("soc_key", "term_key", "Total").collect()}
    want = {(r.aebodsys, r.aedecod): r.total_n for r in ent.q_row_total(spark, d).collect()}
    assert got == want and len(got) > 0
