"""Whole reports against plain-Python models on random small studies (NULLs included)."""
import math

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from cohortab.plans.ae import ae_summary
from cohortab.plans.lab import lab_table, lab_table_grid

SETTINGS = settings(max_examples=10, deadline=None, derandomize=True,
                    phases=[Phase.explicit, Phase.reuse, Phase.generate],
                    suppress_health_check=[HealthCheck.function_scoped_fixture])
ARMS = ["A", "B", "b", None]


def _pct(n, d):
    if d is None or d <= 0:
        return None
    x = 100.0 * n / d
    whole = math.floor(x * 10)
    below, above = x - whole / 10, (whole + 1) / 10 - x
    whole += above < below or (above == below and whole % 2 == 1)
    return str(whole // 10) if whole % 10 == 0 else f"{whole // 10}.{whole % 10}"


def _key(v):
    return (v is None, (v or "").encode())


def _arm(a):
    return "NA" if a is None else a


def _big_n(adsl):
    pop = {(s, _arm(a)) for s, a, f in adsl if f == "Y" and s is not None}
    n = {}
    for s, a in pop:
        n.setdefault(a, set()).add(s)
    n = {a: len(v) for a, v in n.items()}
    n["Total"] = len({s for s, _ in pop})
    return n


def _columns(n, counted=()):
    """Arms of the subject table and of the counted rows; the pooled arm last."""
    return sorted({a for a in [*n, *counted] if a != "Total"}, key=_key) + ["Total"]


def _counted(rows):
    """Arms of the rows of the population that have a subject (arm second, flag last)."""
    return {_arm(r[1]) for r in rows if r[-1] == "Y" and r[0] is not None}


def model_ae(adsl, adae, indent="  "):
    bign = _big_n(adsl)
    ev = [(s, _arm(a), soc, pt) for s, a, soc, pt, f in adae if f == "Y" and s is not None]
    ev += [(s, "Total", soc, pt) for s, _, soc, pt in ev]
    cnt = {}
    for s, a, soc, pt in ev:
        for key in ((a, 0, None, None), (a, 1, soc, None), (a, 2, soc, pt)):
            cnt.setdefault(key, set()).add(s)
    cnt = {k: len(v) for k, v in cnt.items()}
    socs = sorted({k[2] for k in cnt if k[0] == "Total" and k[1] == 1},
                  key=lambda s: (-cnt[("Total", 1, s, None)], _key(s)))
    soc_rank = {s: i + 1 for i, s in enumerate(socs)}
    pt_rank = {}
    for s in socs:
        pts = sorted({k[3] for k in cnt if k[0] == "Total" and k[1] == 2 and k[2] == s},
                     key=lambda p: (-cnt[("Total", 2, s, p)], _key(p)))
        pt_rank.update({(s, p): i + 1 for i, p in enumerate(pts)})
    rows = {}
    for (a, level, soc, pt), n in cnt.items():
        if level == 0:
            rid = ("Any TEAE", 0, 0, None)
        elif level == 1:
            rid = (soc, soc_rank[soc], 1, None)
        else:
            rid = (soc if pt is None else indent + pt, soc_rank[soc], 2, pt_rank[(soc, pt)])
        pct = _pct(n, bign.get(a))
        rows.setdefault(rid, {})[a] = None if pct is None else f"{n} ({pct})"
    cols = _columns(bign, [k[0] for k in cnt])
    out = [rid + tuple(cells.get(c, "0") if c in cells else "0" for c in cols) for rid, cells in rows.items()]
    out.sort(key=lambda r: (r[1], r[2], (r[3] is None, r[3] or 0)))
    return out


def model_lab(adsl, adlb):
    bign = _big_n(adsl)
    rows_ = [(s, _arm(a), p, f) for s, a, p, f, fl in adlb if fl == "Y" and s is not None]
    first = {}
    for s, a, p, f in rows_:
        for arm in (a, "Total"):
            first.setdefault((s, arm, p), []).append(f)
    pick = {k: min((f for f in v if f is not None), default=None) for k, v in first.items()}
    cnt = {}
    for (s, a, p), f in pick.items():
        cnt[(a, 1, p, None)] = cnt.get((a, 1, p, None), 0) + 1
        cnt[(a, 2, p, f)] = cnt.get((a, 2, p, f), 0) + 1
    rank = {}
    for p in {k[2] for k in cnt}:
        flags = sorted({k[3] for k in cnt if k[0] == "Total" and k[1] == 2 and k[2] == p}, key=_key)
        rank.update({(p, f): i + 1 for i, f in enumerate(flags)})
    rows = {}
    for (a, level, p, f), n in cnt.items():
        label = f if level == 2 and f is not None else p
        if label is None or label == "":
            continue
        rid = (label, p, level, 0 if level == 1 else rank.get((p, f)))
        pct = _pct(n, bign.get(a))
        rows.setdefault(rid, {})[a] = f"{n} ({'NA' if pct is None else pct})"
    cols = _columns(bign, [k[0] for k in cnt])
    out = [rid + tuple(cells.get(c, "0") for c in cols) for rid, cells in rows.items()]
    out.sort(key=lambda r: (_key(r[1]), (r[3] is None, r[3] or 0)))
    return out


subjects_st = st.lists(st.tuples(st.integers(0, 12), st.sampled_from(ARMS), st.sampled_from(["Y", "N"])),
                       min_size=1, max_size=14, unique_by=lambda t: t[0])
ae_st = st.lists(st.tuples(st.one_of(st.integers(0, 14), st.none()), st.sampled_from(ARMS),
                           st.sampled_from(["S1", "S2", None]), st.sampled_from(["P1", "P2", "P3", None]),
                           st.sampled_from(["Y", "N", None])), min_size=1, max_size=30)
lab_st = st.lists(st.tuples(st.one_of(st.integers(0, 14), st.none()), st.sampled_from(ARMS),
                            st.sampled_from(["ALT", "K", None]),
                            st.sampled_from(["LOW", "NORMAL", "HIGH", "", None]), st.sampled_from(["Y", "N"])),
                  min_size=1, max_size=30)


def _sid(i):
    return None if i is None else f"s{i}"


@SETTINGS
@given(subjects=subjects_st, events=ae_st)
def test_ae_summary_equals_model(spark, subjects, events):
    adsl_rows = [(_sid(i), a, f) for i, a, f in subjects]
    adae_rows = [(_sid(i), a, s, p, f) for i, a, s, p, f in events]
    adsl = spark.createDataFrame(adsl_rows, "usubjid string, trt01a string, saffl string")
    adae = spark.createDataFrame(adae_rows, "usubjid string, trta string, aebodsys string, aedecod string, "
                                            "saffl string")
    want = model_ae(adsl_rows, adae_rows)
    got_df = ae_summary(adae, adsl)
    got = [tuple(r) for r in got_df.collect()]
    assert got_df.columns[4:] == _columns(_big_n(adsl_rows), _counted(adae_rows))
    assert got == want


@SETTINGS
@given(subjects=subjects_st, labs=lab_st)
def test_lab_table_equals_model(spark, subjects, labs):
    adsl_rows = [(_sid(i), a, f) for i, a, f in subjects]
    adlb_rows = [(_sid(i), a, p, f, fl) for i, a, p, f, fl in labs]
    adsl = spark.createDataFrame(adsl_rows, "usubjid string, trt01a string, saffl string")
    adlb = spark.createDataFrame(adlb_rows, "usubjid string, trta string, param string, lbnrind string, "
                                            "saffl string")
    want = model_lab(adsl_rows, adlb_rows)
    got = [tuple(r) for r in lab_table(adlb, adsl).collect()]
    assert got == want


def model_term_table(adae, indent="  "):
    ev = [(s, _arm(a), soc, pt) for s, a, soc, pt, _ in adae if s is not None]
    den = {}
    for s, a, _, _ in ev:
        den.setdefault(a, set()).add(s)
    den = {a: len(v) for a, v in den.items()}
    arms = sorted(den, key=_key)
    cnt = {}
    for s, a, soc, pt in ev:
        cnt.setdefault((soc, pt), {}).setdefault(a, set()).add(s)

    def cell(n, a):
        return f"{n} ({'%.1f' % (100.0 * n / den[a])}%)"

    rows = []
    for soc in sorted({k[0] for k in cnt}, key=_key):
        pts = sorted([k[1] for k in cnt if k[0] == soc], key=_key)
        body = []
        for pt in pts:
            sets = cnt[(soc, pt)]
            cells = tuple(cell(len(sets[a]), a) if a in sets else "0 (0.0%)" for a in arms)
            total = str(sum(len(v) for v in sets.values()))
            body.append((indent + ("NA" if pt is None else pt), soc, False, pt) + cells + (total,))
        head = (soc, soc, True, None) + body[0][4:]
        rows += [head] + body
    return rows, arms


def model_demo_combined(adsl):
    import statistics as stats

    def num(x, d):
        if x is None:
            return None
        scale = 10.0 ** d
        low = math.floor(x * scale)
        below, above = x - low / scale, (low + 1) / scale - x
        low += above < below or (above == below and low % 2 == 1)
        t = f"{low / scale:.{d}f}".rstrip("0").rstrip(".")
        return "0" if t in ("-0", "") else t

    data = [(_arm(a), age, sex) for a, age, sex in adsl]
    arms = sorted({a for a, _, _ in data}, key=_key) + ["Total"]
    groups = {a: [r for r in data if r[0] == a] for a in arms[:-1]}
    groups["Total"] = data
    out = []
    stat_rows = {"N": {}, "Mean (SD)": {}, "Median": {}, "Min": {}, "Max": {}}
    for a, rs in groups.items():
        xs = [r[1] for r in rs if r[1] is not None]
        stat_rows["N"][a] = str(len(xs))
        if xs:
            sd = stats.stdev(xs) if len(xs) > 1 else None
            stat_rows["Mean (SD)"][a] = f"{num(stats.fmean(xs), 2)} ({'NA' if sd is None else num(sd, 3)})"
            stat_rows["Median"][a] = num(stats.median(xs), 2)
            stat_rows["Min"][a] = num(min(xs), 2)
            stat_rows["Max"][a] = num(max(xs), 2)
        else:
            for k in ("Mean (SD)", "Median", "Min", "Max"):
                stat_rows[k][a] = "NA (NA)" if k == "Mean (SD)" else None
    for i, (k, cells) in enumerate(stat_rows.items(), start=1):
        out.append(("age", k, 1, i) + tuple(cells.get(a) for a in arms))
    levels = sorted({r[2] for r in data}, key=_key)
    for j, lv in enumerate(levels, start=1):
        cells = []
        for a in arms:
            rs = groups[a]
            n = sum(1 for r in rs if r[2] == lv)
            cells.append(f"{n} ({_pct(n, len(rs))}%)" if n else None)
        out.append(("sex", lv, 2, j) + tuple(cells))
    assert not any(isinstance(v, float) and math.isnan(v) for r in out for v in r)
    return out, arms


@SETTINGS
@given(events=ae_st)
def test_term_table_equals_model(spark, events):
    from cohortab.plans.ae import ae_term_table
    adae_rows = [(_sid(i), a, s, p, f) for i, a, s, p, f in events]
    if all(r[0] is None for r in adae_rows):
        return
    adae = spark.createDataFrame(adae_rows, "usubjid string, trta string, aebodsys string, aedecod string, "
                                            "saffl string")
    want, arms = model_term_table(adae_rows)
    got_df = ae_term_table(adae)
    assert got_df.columns[4:] == arms + ["Total"]
    assert [tuple(r) for r in got_df.collect()] == want


demo_st = st.lists(st.tuples(st.sampled_from(ARMS), st.one_of(st.integers(18, 90), st.none()),
                             st.sampled_from(["M", "F", None])), min_size=1, max_size=25)


@SETTINGS
@given(subjects=demo_st)
def test_demo_combined_equals_model(spark, subjects):
    from cohortab.plans.demo import demo_table
    rows_ = [(a, None if x is None else float(x), s) for a, x, s in subjects]
    df = spark.createDataFrame(rows_, "arm string, age double, sex string")
    want, arms = model_demo_combined(rows_)
    got_df = demo_table(df, "arm", ["age", "sex"], "combined")
    assert got_df.columns[4:] == arms
    assert [tuple(r) for r in got_df.collect()] == want


def model_lab_grid(adsl, adlb):
    bign = _big_n(adsl)
    rows_ = [(s, _arm(a), p, f) for s, a, p, f, fl in adlb if fl == "Y" and s is not None]
    first = {}
    for s, a, p, f in rows_:
        for arm in (a, "Total"):
            first.setdefault((s, arm, p), []).append(f)
    pick = {k: min((f for f in v if f is not None), default=None) for k, v in first.items()}
    cnt = {}
    for (s, a, p), f in pick.items():
        cnt[(a, 1, p, None)] = cnt.get((a, 1, p, None), 0) + 1
        cnt[(a, 2, p, f)] = cnt.get((a, 2, p, f), 0) + 1
    params = sorted({k[2] for k in cnt if k[0] == "Total" and k[1] == 1},
                    key=lambda p: (-cnt[("Total", 1, p, None)], _key(p)))
    ord_par = {p: i + 1 for i, p in enumerate(params)}
    cols = _columns(bign, [k[0] for k in cnt])

    def cell(a, key):
        if key not in cnt:
            return "0"
        pct = _pct(cnt[key], bign.get(a))
        return f"{cnt[key]} ({'NA' if pct is None else pct})"

    out = []
    for p in params:
        if p is None or p == "":
            continue
        out.append((p, p, ord_par[p], 0) + tuple(cell(a, (a, 1, p, None)) for a in cols))
        for code, text in ((1, "LOW"), (2, "NORMAL"), (3, "HIGH")):
            out.append((text, p, ord_par[p], code) + tuple(cell(a, (a, 2, p, text)) for a in cols))
    return out


@SETTINGS
@given(subjects=subjects_st, labs=lab_st)
def test_lab_grid_equals_model(spark, subjects, labs):
    adsl_rows = [(_sid(i), a, f) for i, a, f in subjects]
    adlb_rows = [(_sid(i), a, p, f, fl) for i, a, p, f, fl in labs]
    adsl = spark.createDataFrame(adsl_rows, "usubjid string, trt01a string, saffl string")
    adlb = spark.createDataFrame(adlb_rows, "usubjid string, trta string, param string, lbnrind string, "
                                            "saffl string")
    want = model_lab_grid(adsl_rows, adlb_rows)
    got = [tuple(r) for r in lab_table_grid(adlb, adsl).collect()]
    assert got == want
