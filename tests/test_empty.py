"""Empty inputs give empty reports (with their columns), not errors."""
from cohortab.plans.ae import ae_summary, ae_term_table
from cohortab.plans.demo import demo_table
from cohortab.plans.lab import lab_table, lab_table_grid
from fixture_data import H, L, P


def test_empty_event_and_lab_tables(spark, fx):
    adsl, adae, adlb = fx
    none_ae, none_lb = adae.limit(0), adlb.limit(0)
    out = ae_summary(none_ae, adsl)
    assert out.count() == 0 and out.columns[4:] == [P, H, L, "Total"]
    assert lab_table(none_lb, adsl).count() == 0
    assert lab_table_grid(none_lb, adsl).count() == 0
    assert ae_term_table(none_ae).count() == 0


def test_empty_subject_table(spark, fx):
    adsl, _, _ = fx
    out = demo_table(adsl.limit(0), "trt01p", ["age", "sex"], "combined")
    assert out.count() == 0 and out.columns == ["Variable", "Stat", "var_pos", "stat_pos", "Total"]
