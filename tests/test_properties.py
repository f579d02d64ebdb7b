"""Invariants on random small studies, and incidence against a brute-force count."""
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from cohortab.operators.denominators import big_n
from cohortab.operators.incidence import incidence
from cohortab.plans.ae import ae_counts, soc_header

ARMS = ["A", "B", "C"]
SOCS = ["S1", "S2", None]
PTS = ["P1", "P2", "P3", None]

subjects_st = st.lists(st.tuples(st.integers(0, 15), st.sampled_from(ARMS), st.sampled_from(["Y", "N"])),
                       min_size=1, max_size=20, unique_by=lambda t: t[0])
events_st = st.lists(st.tuples(st.integers(0, 18), st.sampled_from(ARMS), st.sampled_from(SOCS),
                               st.sampled_from(PTS), st.sampled_from(["Y", "N"]), st.sampled_from(["R1", "R2"])),
                     min_size=1, max_size=40)
# Each example runs Spark jobs, so no shrinking phase (it would take minutes).
SETTINGS = settings(max_examples=12, deadline=None, derandomize=True,
                    phases=[Phase.explicit, Phase.reuse, Phase.generate],
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


def _frames(spark, subjects, events):
    adsl = spark.createDataFrame([(f"s{i}", a, f) for i, a, f in subjects], "usubjid string, trt01a string, saffl string")
    adae = spark.createDataFrame([(f"s{i}", a, s, p, f, r) for i, a, s, p, f, r in events],
                                 "usubjid string, trta string, aebodsys string, aedecod string, saffl string, aerel string")
    return adsl, adae


@SETTINGS
@given(events=events_st)
def test_incidence_equals_brute_force(spark, events):
    _, adae = _frames(spark, [(0, "A", "Y")], events)
    got = {(r.trta, r.level, r.aebodsys, r.aedecod): r.n
           for r in incidence(adae, "trta", ["aebodsys", "aedecod"]).collect()}
    want = {}
    for i, a, s, p, _, _ in events:
        for arm in (a, "Total"):
            for key in ((arm, 0, None, None), (arm, 1, s, None), (arm, 2, s, p)):
                want.setdefault(key, set()).add(i)
    assert got == {k: len(v) for k, v in want.items()}


@SETTINGS
@given(subjects=subjects_st, events=events_st)
def test_report_invariants(spark, subjects, events):
    adsl, adae = _frames(spark, subjects, events)
    cells, _ = ae_counts(adae, adsl, trt="trta")
    n = {(r.trta, r.level, r.aebodsys, r.aedecod): r.n for r in cells.collect()}
    for (arm, level, soc, pt), v in n.items():
        if arm != "Total":
            continue
        arms = [n.get((a, level, soc, pt), 0) for a in ARMS]
        assert max(arms) <= v <= sum(arms)  # pooled: at least the largest arm, at most the sum
        if level == 2:
            assert v <= n[("Total", 1, soc, None)] <= n[("Total", 0, None, None)]
    # A report filter cuts numerators only: every row keeps its arm's population denominator.
    bn = {r.trta: r.N for r in big_n(adsl, "trt01a", name="trta").collect()}
    filtered, _ = ae_counts(adae, adsl, trt="trta", where={"aerel": "R1"})
    for r in filtered.select("trta", "denom").distinct().collect():
        assert r.denom == bn.get(r.trta)
    # Denominators equal distinct population subjects.
    pop = {i for i, _, f in subjects if f == "Y"}
    assert bn.get("Total", 0) == len(pop)


@SETTINGS
@given(events=events_st)
def test_distinct_header_never_below_first_term_header(spark, events):
    _, adae = _frames(spark, [(0, "A", "Y")], events)
    first = {r.aebodsys: int(r.Total) for r in soc_header(adae, mode="first_term").collect()}
    own = {r.aebodsys: int(r.Total) for r in soc_header(adae, mode="distinct_subjects").collect()}
    assert first.keys() == own.keys()
    for k in first:
        assert own[k] >= first[k]


levels_st = st.lists(st.tuples(st.sampled_from(ARMS + [None]), st.sampled_from(["x", "y", "z", None])),
                     min_size=1, max_size=40)


@SETTINGS
@given(data=levels_st)
def test_categorical_percents_sum_to_100(spark, data):
    from cohortab.operators.summary import categorical_counts
    from cohortab.functions.text import percent_tenths
    df = spark.createDataFrame(data, "arm string, v string")
    got = categorical_counts(df, "arm", ["v"]).withColumn("t", percent_tenths("n", "denom")).collect()
    per_arm = {}
    for r in got:
        per_arm.setdefault(r.arm, []).append(r.t)
    for arm, ts in per_arm.items():
        assert abs(sum(ts) - 1000) <= 5 * len(ts), (arm, ts)  # each cell rounds by at most 0.05
    assert {r.arm: r.denom for r in got}["Total"] == len(data)


@SETTINGS
@given(subjects=subjects_st, events=events_st)
def test_counts_never_exceed_denominators_for_population_subjects(spark, subjects, events):
    arm_of = {i: a for i, a, f in subjects if f == "Y"}
    # keep events of population subjects, in their own arm
    evs = [(i, arm_of[i], s, p, "Y", r) for i, _, s, p, _, r in events if i in arm_of]
    if not evs:
        return
    adsl, adae = _frames(spark, subjects, evs)
    cells, _ = ae_counts(adae, adsl, trt="trta")
    for r in cells.collect():
        assert r.denom is not None and r.n <= r.denom


def test_hot_subject_and_hot_term_match_brute_force(spark):
    # One subject holds a third of all events and one term another third.
    rows_ = []
    for k in range(3000):
        if k % 3 == 0:
            rows_.append(("hot", "A", "S1", "P1"))
        elif k % 3 == 1:
            rows_.append((f"s{k}", "AB"[k % 2], "S2", "HOT"))
        else:
            rows_.append((f"s{k % 97}", "AB"[k % 2], f"S{k % 5}", f"P{k % 7}"))
    adae = spark.createDataFrame(rows_, "usubjid string, trta string, aebodsys string, aedecod string")
    got = {(r.trta, r.level, r.aebodsys, r.aedecod): r.n
           for r in incidence(adae, "trta", ["aebodsys", "aedecod"]).collect()}
    want = {}
    for i, a, s, p in rows_:
        for arm in (a, "Total"):
            for key in ((arm, 0, None, None), (arm, 1, s, None), (arm, 2, s, p)):
                want.setdefault(key, set()).add(i)
    assert got == {k: len(v) for k, v in want.items()}
