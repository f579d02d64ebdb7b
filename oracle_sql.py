"""Plain-SQL statements of every registered query, for the DuckDB cross-check.

Each statement reads the raw test tables (pre-registered views) and rebuilds
the study roles with the same mapping as ``cohortab.sources.study``. Totals use
UNION ALL, nested levels use separate GROUP BYs, pivots use conditional
aggregates: an independent formulation of what the Spark operators do with
explode, grouping sets and pivot. ``sprintf`` cells use DuckDB's printf.
"""

from __future__ import annotations

# Arms of the test data (c_mktsegment), in report order; the pooled arm last.
# A missing arm is the arm 'NA'. Planned arms are never missing.
PLANNED = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
ARMS = PLANNED + ["NA"]
ARMS_T = ARMS + ["Total"]

SAFETY = "CASE WHEN c.c_custkey % 17 <> 0 THEN CASE WHEN c.c_acctbal >= 0 THEN 'Y' ELSE 'N' END END"
ACTUAL = "CASE WHEN c.c_custkey % 13 <> 0 THEN c.c_mktsegment END"

ADSL = f"""adsl AS (
  SELECT c.c_custkey AS usubjid, CASE WHEN c.c_custkey % 7 = 0 THEN 'BUILDING' ELSE c.c_mktsegment END AS trt01p, {ACTUAL} AS trt01a,
         c.c_mktsegment AS arm, c.c_acctbal AS age,
         CASE WHEN c.c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, r.r_name AS race,
         {SAFETY} AS saffl
  FROM customer c
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey)"""

ADAE = f"""adae AS (
  SELECT o.o_custkey AS usubjid, {ACTUAL} AS trta, p.p_type AS aebodsys, p.p_brand AS aedecod,
         o.o_orderpriority AS aesev, o.o_orderstatus AS aerel, l.l_returnflag AS aeser,
         {SAFETY} AS saffl
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN part p ON l.l_partkey = p.p_partkey)"""

ADLB = f"""adlb AS (
  SELECT e.user_id AS usubjid, {ACTUAL} AS trta, e.event_type AS param, e.value AS aval,
         CASE WHEN e.value < 5 THEN 'LOW' WHEN e.value > 100 THEN 'HIGH' ELSE 'NORMAL' END AS lbnrind,
         CAST(CAST(e.ts AS DATE) AS VARCHAR) AS visit,
         {SAFETY} AS saffl
  FROM events e JOIN customer c ON e.user_id = c.c_custkey)"""


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def nearest(x: str, scale: int) -> str:
    """round(x, d) as a whole number of steps of 1/scale: the nearer of the two decimals around x, even on equality."""
    low = f"floor(({x}) * {scale}.0::DOUBLE)"
    below = f"(({x}) - {low} / {scale}.0::DOUBLE)"
    above = f"(({low} + 1) / {scale}.0::DOUBLE - ({x}))"
    return (f"({low} + CASE WHEN {above} < {below} OR ({above} = {below} AND abs({low} % 2) = 1) THEN 1 ELSE 0 END)")


def percent(n: str, d: str) -> str:
    return f"(100.0::DOUBLE * ({n}) / CASE WHEN ({d}) > 0 THEN ({d}) END)"


def tenths(n: str, d: str) -> str:
    """round(100*n/d, 1) in integer tenths; NULL unless d > 0."""
    return f"CAST({nearest(percent(n, d), 10)} AS BIGINT)"


def tenths_text(t: str) -> str:
    whole = f"CAST(({t}) // 10 AS VARCHAR)"
    frac = f"CAST(({t}) % 10 AS VARCHAR)"
    return f"CASE WHEN ({t}) % 10 = 0 THEN {whole} ELSE {whole} || '.' || {frac} END"


def cell(n: str, d: str, style: str = "strict") -> str:
    t = tenths(n, d)
    n_txt = f"CAST({n} AS VARCHAR)"
    if style == "strict":
        return f"({n_txt} || ' (' || {tenths_text(t)} || ')')"
    if style == "paste":
        return f"({n_txt} || ' (' || coalesce({tenths_text(t)}, 'NA') || ')')"
    if style == "percent":
        return f"({n_txt} || ' (' || coalesce({tenths_text(t)}, 'NA') || '%)')"
    if style == "sprintf":
        return f"({n_txt} || ' (' || printf('%.1f', {percent(n, d)}) || '%)')"
    raise ValueError(style)


def num_text(x: str, d: int) -> str:
    """round(x, d) as text without trailing zeros."""
    steps = f"{nearest(f'CAST({x} AS DOUBLE)', 10 ** d)} / {10 ** d}.0::DOUBLE"
    s = f"regexp_replace(CAST(CAST({steps} AS DECIMAL(38,{d})) AS VARCHAR), '\\.?0+$', '')"
    return f"CASE WHEN {s} = '-0' THEN '0' ELSE {s} END"


def pivot(value: str, key: str, names, fill: str | None = None) -> str:
    """Conditional aggregates: one column per name; fill only absent combinations."""
    cols = []
    for a in names:
        lit = "'" + a.replace("'", "''") + "'"
        v = f"max(CASE WHEN {key} = {lit} THEN {value} END)"
        if fill is not None:
            v = f"CASE WHEN count(CASE WHEN {key} = {lit} THEN 1 END) = 0 THEN '{fill}' ELSE {v} END"
        cols.append(f"{v} AS {_q(a)}")
    return ",\n  ".join(cols)


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# --------------------------------------------------------------------------- basics

BIGN = """bign AS (
  SELECT coalesce(trt01a, 'NA') AS trta, count(DISTINCT usubjid) AS N FROM adsl
   WHERE saffl = 'Y' AND usubjid IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT 'Total', count(DISTINCT usubjid) FROM adsl WHERE saffl = 'Y' AND usubjid IS NOT NULL)"""

ADSL_COLS = "usubjid, trt01p, trt01a, arm, age, sex, race, saffl"
ADAE_COLS = "usubjid, trta, aebodsys, aedecod, aerel, aesev, aeser"


def _population() -> str:
    return with_ctes(ADSL) + f"SELECT {ADSL_COLS} FROM adsl WHERE saffl = 'Y'"


def _with_total() -> str:
    return with_ctes(ADSL) + """SELECT usubjid, coalesce(trt01a, 'NA') AS trt01a FROM adsl WHERE saffl = 'Y'
UNION ALL SELECT usubjid, 'Total' FROM adsl WHERE saffl = 'Y'"""


def _big_n() -> str:
    return with_ctes(ADSL, BIGN) + "SELECT trta, N FROM bign"


def _choice_filter() -> str:
    return with_ctes(ADAE) + f"""SELECT {ADAE_COLS} FROM adae
WHERE aerel = 'F' AND aesev IN ('1-URGENT', '2-HIGH')"""


def _facet(col: str, n: int | None = None) -> str:
    return with_ctes(ADLB) + f"""SELECT DISTINCT {col} AS value FROM adlb WHERE {col} IS NOT NULL
ORDER BY value{f' LIMIT {n}' if n else ''}"""


# --------------------------------------------------------------------------- demography

SPLIT = [("N", "CAST(n AS VARCHAR)"), ("Mean", num_text("mean", 2)), ("Median", num_text("median", 2)),
         ("SD", num_text("sd", 2)), ("Min", num_text("mn", 2)), ("Max", num_text("mx", 2))]
COMBINED = [("N", "CAST(n AS VARCHAR)"),
            ("Mean (SD)", f"(coalesce({num_text('mean', 2)}, 'NA') || ' (' || coalesce({num_text('sd', 3)}, 'NA') || ')')"),
            ("Median", num_text("median", 2)), ("Min", num_text("mn", 2)), ("Max", num_text("mx", 2))]


# The statistics of no value: the mean is no number, the ends are infinite.
EMPTY_TEXT = {"Mean": "NaN", "Min": "Inf", "Max": "-Inf"}


def _with_ends(stats):
    rows = [(name, f"CASE WHEN n = 0 THEN '{EMPTY_TEXT[name]}' ELSE {e} END" if name in EMPTY_TEXT else e)
            for name, e in stats]
    return [(name, f"CASE WHEN n = 0 THEN 'NaN (NA)' ELSE {e} END" if name == "Mean (SD)" else e) for name, e in rows]


def _num_ctes(trt: str, var: str, where: str = "") -> str:
    """CTE ``ns``: typed statistics per arm (incl. Total) of one numeric variable."""
    return f"""nd AS (
  SELECT coalesce(CAST({trt} AS VARCHAR), 'NA') AS arm,
         CASE WHEN isnan(CAST({var} AS DOUBLE)) THEN NULL ELSE CAST({var} AS DOUBLE) END AS x
  FROM adsl WHERE TRUE {where}),
nd2 AS (SELECT arm, x FROM nd UNION ALL SELECT 'Total', x FROM nd),
nst AS (SELECT arm, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx
        FROM nd2 GROUP BY arm),
nrk AS (SELECT arm, x, row_number() OVER (PARTITION BY arm ORDER BY x) AS r,
               count(*) OVER (PARTITION BY arm) AS c FROM nd2 WHERE x IS NOT NULL),
nmed AS (SELECT arm, sum(0.5 * x) * 2.0 / count(*) AS median FROM nrk
         WHERE r = (c + 1) // 2 OR r = c // 2 + 1 GROUP BY arm),
ns AS (SELECT nst.*, nmed.median FROM nst LEFT JOIN nmed ON nst.arm = nmed.arm)"""


def _num_rows(var: str, stats) -> str:
    parts = []
    for i, (name, expr) in enumerate(stats, start=1):
        parts.append(f"SELECT '{var}' AS Variable, '{name}' AS Stat, CAST({i} AS BIGINT) AS stat_pos, arm, "
                     f"{expr} AS Value FROM ns")
    return "\nUNION ALL ".join(parts)


def _cat_ctes(trt: str, variables, where: str = "") -> str:
    """CTE ``cs``: ``Variable, Stat, stat_pos, arm, Value`` for categorical variables."""
    unions = " UNION ALL ".join(f"SELECT arm, '{v}' AS Variable, CAST({v} AS VARCHAR) AS Stat FROM cd"
                                for v in variables)
    return f"""cd AS (SELECT coalesce(CAST({trt} AS VARCHAR), 'NA') AS arm, * FROM adsl WHERE TRUE {where}),
cl AS ({unions}),
cl2 AS (SELECT arm, Variable, Stat FROM cl UNION ALL SELECT 'Total', Variable, Stat FROM cl),
cc AS (SELECT arm, Variable, Stat, count(*) AS n FROM cl2 GROUP BY arm, Variable, Stat),
cc2 AS (SELECT *, sum(n) OVER (PARTITION BY arm, Variable) AS denom FROM cc),
clv AS (SELECT Variable, Stat, dense_rank() OVER (PARTITION BY Variable ORDER BY Stat ASC NULLS LAST) AS stat_pos
        FROM (SELECT DISTINCT Variable, Stat FROM cc) u),
cs AS (SELECT cc2.Variable, cc2.Stat, CAST(clv.stat_pos AS BIGINT) AS stat_pos, cc2.arm,
              {cell('cc2.n', 'cc2.denom', 'percent')} AS Value
       FROM cc2 LEFT JOIN clv ON cc2.Variable = clv.Variable AND cc2.Stat IS NOT DISTINCT FROM clv.Stat)"""


NO_AGE = "CASE WHEN trt01a <> 'MACHINERY' THEN age END"


def _numeric(style, age: str = "age", ends: bool = False) -> str:
    stats = SPLIT if style == "split" else COMBINED
    stats = _with_ends(stats) if ends else stats
    return with_ctes(ADSL, _num_ctes("trt01a", age)) + \
        f"SELECT Variable, Stat, stat_pos, arm AS trt01a, Value FROM ({_num_rows('age', stats)}) x"


def _categorical() -> str:
    return with_ctes(ADSL, _cat_ctes("trt01a", ["sex", "race"])) + \
        "SELECT Variable, Stat, stat_pos, arm AS trt01a, Value FROM cs"


def _demo(trt: str, style: str, where: str = "", arms=None) -> str:
    stats = SPLIT if style == "split" else COMBINED
    body = with_ctes(ADSL, _num_ctes(trt, "age", where), _cat_ctes(trt, ["sex", "race"], where))
    long = f"""SELECT Variable, Stat, stat_pos, arm, Value FROM ({_num_rows('age', stats)}) a
  UNION ALL SELECT Variable, Stat, stat_pos, arm, Value FROM cs"""
    return body + f"""SELECT Variable, Stat,
  CAST(CASE Variable WHEN 'age' THEN 1 WHEN 'sex' THEN 2 WHEN 'race' THEN 3 END AS BIGINT) AS var_pos,
  stat_pos,
  {pivot('Value', 'arm', arms or ARMS_T)}
FROM ({long}) l
GROUP BY Variable, Stat, stat_pos"""


# --------------------------------------------------------------------------- adverse events

def _ae_long(where: str = "") -> str:
    """CTEs ev .. cells for the adverse-event summary (optionally with extra event filters)."""
    return f"""ev AS (
  SELECT usubjid, coalesce(trta, 'NA') AS trta, aebodsys AS soc, aedecod AS pt FROM adae
   WHERE saffl = 'Y' AND usubjid IS NOT NULL {where}),
ev2 AS (SELECT usubjid, trta, soc, pt FROM ev UNION ALL SELECT usubjid, 'Total', soc, pt FROM ev),
inc AS (
  SELECT trta, 0 AS level, CAST(NULL AS VARCHAR) AS soc, CAST(NULL AS VARCHAR) AS pt,
         count(DISTINCT usubjid) AS n FROM ev2 GROUP BY trta
  UNION ALL SELECT trta, 1, soc, NULL, count(DISTINCT usubjid) FROM ev2 GROUP BY trta, soc
  UNION ALL SELECT trta, 2, soc, pt, count(DISTINCT usubjid) FROM ev2 GROUP BY trta, soc, pt),
socr AS (
  SELECT soc, row_number() OVER (ORDER BY n DESC, soc ASC NULLS LAST) AS ord_1
  FROM inc WHERE trta = 'Total' AND level = 1),
ptr AS (
  SELECT soc, pt, row_number() OVER (PARTITION BY soc ORDER BY n DESC, pt ASC NULLS LAST) AS ord_2
  FROM inc WHERE trta = 'Total' AND level = 2),
pct AS MATERIALIZED (
  SELECT i.trta, i.level, i.soc, i.pt, i.n, s.ord_1, p.ord_2, b.N AS denom, {percent('i.n', 'b.N')} AS pc
  FROM inc i
  LEFT JOIN socr s ON i.level >= 1 AND i.soc IS NOT DISTINCT FROM s.soc
  LEFT JOIN ptr p ON i.level >= 2 AND i.soc IS NOT DISTINCT FROM p.soc AND i.pt IS NOT DISTINCT FROM p.pt
  LEFT JOIN bign b ON i.trta IS NOT DISTINCT FROM b.trta),
steps AS MATERIALIZED (SELECT *, CAST({nearest('pc', 10)} AS BIGINT) AS t FROM pct),
cells AS (SELECT trta, level, soc, pt, n, ord_1, ord_2, denom, n || ' (' || {tenths_text('t')} || ')' AS cell FROM steps)"""


def _ae_summary(where: str = "", indent: str = "  ", bign: str = BIGN) -> str:
    return with_ctes(ADSL, ADAE, bign, _ae_long(where)) + f"""
SELECT label, ord_soc, ord, ord_pt,
  {pivot('cell', 'trta', ARMS_T, fill='0')}
FROM (
  SELECT trta, cell,
         CASE WHEN level = 0 THEN 'Any TEAE' WHEN pt IS NULL THEN soc ELSE '{indent}' || pt END AS label,
         CAST(CASE WHEN level = 0 THEN 0 ELSE ord_1 END AS BIGINT) AS ord_soc,
         CAST(level AS BIGINT) AS ord, CAST(ord_2 AS BIGINT) AS ord_pt
  FROM cells) x
GROUP BY label, ord_soc, ord, ord_pt"""


def _ae_summary_choices() -> str:
    settings = [AE_FILTER, "AND aerel IN ('F', 'O')", ""]
    return "\nUNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS choice, * FROM ({_ae_summary(w)}) s{i}"
                               for i, w in enumerate(settings))


AE_FILTER = "AND aerel = 'F' AND aesev = '1-URGENT'"


def _incidence() -> str:
    return with_ctes(ADSL, ADAE, BIGN, _ae_long()) + \
        "SELECT trta, CAST(level AS INTEGER) AS level, soc AS aebodsys, pt AS aedecod, n FROM inc"


def _rank_levels() -> str:
    return with_ctes(ADSL, ADAE, BIGN, _ae_long()) + """SELECT 1 AS level, soc AS aebodsys,
  CAST(NULL AS VARCHAR) AS aedecod, CAST(ord_1 AS BIGINT) AS ord FROM socr
UNION ALL SELECT 2, soc, pt, CAST(ord_2 AS BIGINT) FROM ptr"""


def _with_percent() -> str:
    return with_ctes(ADSL, ADAE, BIGN, _ae_long()) + """SELECT trta, CAST(level AS INTEGER) AS level,
  soc AS aebodsys, pt AS aedecod, n, CAST(ord_1 AS BIGINT) AS ord_1, CAST(ord_2 AS BIGINT) AS ord_2,
  denom, cell FROM cells"""


TERM_ROWS = "te AS (SELECT usubjid, {soc} AS aebodsys, {pt} AS aedecod, coalesce(trta, 'NA') AS trta FROM adae WHERE usubjid IS NOT NULL)"
TERM_TABLES = f"""
tc AS (SELECT aebodsys, aedecod, trta, count(DISTINCT usubjid) AS n FROM te GROUP BY aebodsys, aedecod, trta),
sn AS (SELECT trta, count(DISTINCT usubjid) AS N FROM te GROUP BY trta),
tl AS (SELECT tc.*, {cell('tc.n', 'sn.N', 'sprintf')} AS cell
       FROM tc LEFT JOIN sn ON tc.trta IS NOT DISTINCT FROM sn.trta),
tw AS (SELECT aebodsys, aedecod,
  {",  ".join(f"coalesce(max(CASE WHEN trta = '{a}' THEN cell END), '0 (0.0%)') AS {_q(a)}" for a in ARMS)},
  CAST(sum(CASE WHEN trta IN ({", ".join(f"'{a}'" for a in ARMS)}) THEN n ELSE 0 END) AS VARCHAR) AS "Total"
  FROM tl GROUP BY aebodsys, aedecod),
thf AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY aebodsys ORDER BY aedecod ASC NULLS LAST) AS rn FROM tw) z WHERE rn = 1)"""

TERM = TERM_ROWS.format(soc="aebodsys", pt="aedecod") + ",\n" + TERM_TABLES

ARM_COLS = ", ".join(_q(a) for a in ARMS) + ', "Total"'


def _self_big_n() -> str:
    return with_ctes(ADAE) + """SELECT coalesce(trta, 'NA') AS trta, count(DISTINCT usubjid) AS N FROM adae
WHERE usubjid IS NOT NULL GROUP BY ALL"""


def _row_total() -> str:
    return with_ctes(ADAE) + """SELECT aebodsys, aedecod, CAST(sum(n) AS BIGINT) AS total_n FROM (
  SELECT aebodsys, aedecod, trta, count(DISTINCT usubjid) AS n FROM adae
  WHERE usubjid IS NOT NULL GROUP BY aebodsys, aedecod, trta) t
GROUP BY aebodsys, aedecod"""


def _soc_header_first() -> str:
    return with_ctes(ADAE, TERM) + f"SELECT aebodsys, {ARM_COLS} FROM thf"


def _soc_header_distinct() -> str:
    return with_ctes(ADAE) + f"""SELECT aebodsys,
  {",  ".join(f"coalesce(max(CASE WHEN trta = '{a}' THEN cell END), '0 (0.0%)') AS {_q(a)}" for a in ARMS)},
  CAST(sum(CASE WHEN trta IN ({", ".join(f"'{a}'" for a in ARMS)}) THEN n ELSE 0 END) AS VARCHAR) AS "Total"
FROM (
  SELECT c.aebodsys, c.trta, c.n, {cell('c.n', 'sn.N', 'sprintf')} AS cell
  FROM (SELECT aebodsys, coalesce(trta, 'NA') AS trta, count(DISTINCT usubjid) AS n FROM adae WHERE usubjid IS NOT NULL
        GROUP BY ALL) c
  LEFT JOIN (SELECT coalesce(trta, 'NA') AS trta, count(DISTINCT usubjid) AS N FROM adae WHERE usubjid IS NOT NULL
             GROUP BY ALL) sn
    ON c.trta IS NOT DISTINCT FROM sn.trta) x
GROUP BY aebodsys"""


def _ae_term_table(soc: str = "aebodsys", pt: str = "aedecod") -> str:
    return with_ctes(ADAE, TERM_ROWS.format(soc=soc, pt=pt), TERM_TABLES) + f"""SELECT aebodsys AS label, aebodsys AS soc_key, TRUE AS is_header,
  CAST(NULL AS VARCHAR) AS term_key, {ARM_COLS} FROM thf
UNION ALL
SELECT '  ' || coalesce(aedecod, 'NA'), aebodsys, FALSE, aedecod, {ARM_COLS} FROM tw"""


# --------------------------------------------------------------------------- labs

def _lab_ctes(param_filter: str = "") -> str:
    return f"""lp AS (SELECT usubjid, coalesce(trta, 'NA') AS trta, param, lbnrind FROM adlb
       WHERE saffl = 'Y' AND usubjid IS NOT NULL {param_filter}),
lfirst AS (SELECT usubjid, trta, param, min(lbnrind) AS lbnrind FROM lp GROUP BY usubjid, trta, param
           UNION ALL SELECT usubjid, 'Total', param, min(lbnrind) FROM lp GROUP BY usubjid, param),
fc AS (SELECT trta, 1 AS level, param, CAST(NULL AS VARCHAR) AS lbnrind, count(*) AS n
       FROM lfirst GROUP BY trta, param
       UNION ALL SELECT trta, 2, param, lbnrind, count(*) FROM lfirst GROUP BY trta, param, lbnrind),
pr AS (SELECT param, row_number() OVER (ORDER BY n DESC, param ASC NULLS LAST) AS ord_par
       FROM fc WHERE trta = 'Total' AND level = 1),
fr AS (SELECT param, lbnrind, row_number() OVER (PARTITION BY param ORDER BY lbnrind ASC NULLS LAST) AS ord_gra
       FROM fc WHERE trta = 'Total' AND level = 2),
lc AS (SELECT fc.*, pr.ord_par, CASE WHEN fc.level = 1 THEN 0 ELSE fr.ord_gra END AS ord_gra,
              {cell('fc.n', 'b.N', 'paste')} AS cell
       FROM fc
       LEFT JOIN pr ON fc.param IS NOT DISTINCT FROM pr.param
       LEFT JOIN fr ON fc.level = 2 AND fc.param IS NOT DISTINCT FROM fr.param
                   AND fc.lbnrind IS NOT DISTINCT FROM fr.lbnrind
       LEFT JOIN bign b ON fc.trta IS NOT DISTINCT FROM b.trta)"""


FLAG_CODE_SQL = ("CASE WHEN lbnrind = 'LOW' THEN 1 WHEN lbnrind = 'NORMAL' THEN 2 "
                 "WHEN lbnrind = 'HIGH' THEN 3 END")


def _flag_code() -> str:
    return with_ctes(ADLB) + f"""SELECT usubjid, trta, param, lbnrind,
  CAST({FLAG_CODE_SQL} AS DOUBLE) AS lbnrindn FROM adlb"""


def _one_flag() -> str:
    return with_ctes(ADSL, BIGN, ADLB, _lab_ctes()) + "SELECT usubjid, trta, param, lbnrind FROM lfirst"


def _param_incidence() -> str:
    return with_ctes(ADSL, BIGN, ADLB, _lab_ctes()) + """SELECT fc.trta, fc.param, fc.n,
  CAST(pr.ord_par AS BIGINT) AS ord_par FROM fc JOIN pr ON fc.param = pr.param WHERE fc.level = 1"""


def _flag_incidence() -> str:
    return with_ctes(ADSL, BIGN, ADLB, _lab_ctes()) + """SELECT fc.trta, fc.param, fc.lbnrind, fc.n,
  CAST(fr.ord_gra AS BIGINT) AS ord_gra
FROM fc LEFT JOIN fr ON fc.param IS NOT DISTINCT FROM fr.param AND fc.lbnrind IS NOT DISTINCT FROM fr.lbnrind
WHERE fc.level = 2"""


def _lab_table(bign: str = BIGN) -> str:
    return with_ctes(ADSL, bign, ADLB, _lab_ctes()) + f"""SELECT label, param, ord, ord_gra,
  {pivot('cell', 'trta', ARMS_T, fill='0')}
FROM (SELECT CASE WHEN level = 2 AND lbnrind IS NOT NULL THEN lbnrind ELSE param END AS label, param,
             CAST(level AS BIGINT) AS ord, CAST(ord_gra AS BIGINT) AS ord_gra, trta, cell FROM lc) s
WHERE label IS NOT NULL AND label <> ''
GROUP BY label, param, ord, ord_gra"""


DEFAULT_PARAMS = """AND param IN (SELECT value FROM (SELECT DISTINCT param AS value FROM adlb
                                  WHERE param IS NOT NULL) v ORDER BY value LIMIT 3)"""


# Subjects without one segment; all events: that segment is an arm without a denominator.
BIGN_LESS = BIGN.replace("FROM adsl", "FROM (SELECT * FROM adsl WHERE arm <> 'MACHINERY')")


def _complete_grid() -> str:
    return with_ctes(ADSL, BIGN, ADLB, _lab_ctes()) + f"""SELECT h.trta, h.param, g.flag_code, f.n FROM
(SELECT trta, param FROM fc WHERE level = 1) h, (SELECT CAST(unnest([0, 1, 2, 3]) AS BIGINT) AS flag_code) g
LEFT JOIN (SELECT trta, param, CAST(CASE WHEN level = 1 THEN 0 ELSE {FLAG_CODE_SQL} END AS BIGINT) AS flag_code, n
           FROM fc) f ON f.trta = h.trta AND f.param = h.param AND f.flag_code = g.flag_code"""


def _percent_cells() -> str:
    return f"""SELECT n, d, {cell('n', 'd', 'strict')} AS strict, {cell('n', 'd', 'percent')} AS percent,
  {cell('n', 'd', 'sprintf')} AS sprintf, {num_text('n / 1000.0::DOUBLE', 2)} AS two,
  {num_text('n / 1000.0::DOUBLE - d', 2)} AS below
FROM (SELECT p_partkey AS n, (SELECT count(*) FROM part) AS d FROM part) x"""


def _median_narrowed() -> str:
    return with_ctes(ADLB) + """SELECT param, sum(0.5 * aval) * 2.0 / count(*) AS median FROM (
  SELECT param, aval, row_number() OVER (PARTITION BY param ORDER BY aval) AS r,
         count(*) OVER (PARTITION BY param) AS c FROM adlb WHERE aval IS NOT NULL) x
WHERE r = (c + 1) // 2 OR r = c // 2 + 1 GROUP BY param"""


def _lab_grid() -> str:
    arm_fill = ", ".join(f"coalesce(w.{_q(a)}, '0') AS {_q(a)}" for a in ARMS_T)
    arm_cols = ", ".join(_q(a) for a in ARMS_T)
    body = with_ctes(ADSL, BIGN, ADLB, _lab_ctes(DEFAULT_PARAMS)) + f""", coded AS (
  SELECT param, CAST(ord_par AS BIGINT) AS ord_par,
         CAST(CASE WHEN level = 1 THEN 0 ELSE {FLAG_CODE_SQL} END AS BIGINT) AS flag_code, trta, cell FROM lc),
wide AS (SELECT param, ord_par, flag_code, {pivot('cell', 'trta', ARMS_T, fill='0')}
         FROM coded WHERE flag_code IS NOT NULL GROUP BY param, ord_par, flag_code),
heads AS (SELECT * FROM wide WHERE flag_code = 0),
grid AS (SELECT param, ord_par, CAST(unnest([1, 2, 3]) AS BIGINT) AS flag_code FROM heads),
flags AS (SELECT g.param, g.ord_par, g.flag_code, {arm_fill}
          FROM grid g LEFT JOIN wide w ON g.param IS NOT DISTINCT FROM w.param
           AND g.ord_par IS NOT DISTINCT FROM w.ord_par AND g.flag_code = w.flag_code),
allrows AS (SELECT param, ord_par, flag_code, {arm_cols} FROM heads
            UNION ALL SELECT param, ord_par, flag_code, {arm_cols} FROM flags)
"""
    return body.replace("\n, coded", ",\ncoded") + f"""SELECT CASE flag_code WHEN 0 THEN param WHEN 1 THEN 'LOW' WHEN 2 THEN 'NORMAL'
  WHEN 3 THEN 'HIGH' END AS label, param, ord_par, flag_code, {arm_cols}
FROM allrows"""


# --------------------------------------------------------------------------- reshaping, exploration

def _to_long() -> str:
    return with_ctes(ADSL) + """SELECT usubjid, 'trt01a' AS Stat, CAST(trt01a AS VARCHAR) AS Value FROM adsl
UNION ALL SELECT usubjid, 'sex', CAST(sex AS VARCHAR) FROM adsl
UNION ALL SELECT usubjid, 'race', CAST(race AS VARCHAR) FROM adsl"""


def _to_wide_fill() -> str:
    return with_ctes(ADSL, BIGN, ADLB, _lab_ctes()) + f"""SELECT param, lbnrind,
  {pivot('CAST(n AS VARCHAR)', 'trta', ARMS_T, fill='0')}
FROM fc WHERE level = 2 GROUP BY param, lbnrind"""


def _histogram() -> str:
    """Sturges' class count; the smallest of 1, 2, 5, 10 times a power of ten whose weighted limit holds the aimed step."""
    return with_ctes(ADLB).rstrip("\n") + """,
hv AS (SELECT CAST(aval AS DOUBLE) AS x FROM adlb WHERE aval IS NOT NULL AND isfinite(aval)),
hs AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n, greatest(abs(min(x)), abs(max(x))) AS size FROM hv),
aim AS (SELECT *, CASE WHEN hi - lo <= size * ceil(log2(n) + 1) * 1e-15::DOUBLE
                       THEN 0.75::DOUBLE * CASE WHEN size = 0 THEN 1 ELSE size END
                       ELSE (hi - lo) / ceil(log2(n) + 1) END AS width FROM hs),
choice AS (SELECT aim.*, pow(10.0::DOUBLE, floor(log10(width))) * u AS step, u
           FROM aim, (VALUES (1, 3.5::DOUBLE / 2.5), (2, 10.5::DOUBLE / 3.75), (5, 17.5::DOUBLE / 2.5), (10, 1e9::DOUBLE)) c(u, cap)
           WHERE width / pow(10.0::DOUBLE, floor(log10(width))) <= cap),
best AS (SELECT * FROM choice ORDER BY u LIMIT 1),
ends AS (SELECT *, floor(lo / step + 1e-10::DOUBLE) AS f0, ceil(hi / step - 1e-10::DOUBLE) AS l FROM best),
hb AS (SELECT n, lo, hi, l, CASE WHEN f0 >= l THEN l - 1 ELSE f0 END AS f, step FROM ends),
grid AS (SELECT n, CAST(l - f AS BIGINT) AS k, least(f * step, lo) AS start,
                (greatest(l * step, hi) - least(f * step, lo)) / (l - f) AS step FROM hb),
bins AS (SELECT CAST(i + 1 AS BIGINT) AS bin, start + i * step AS lower, start + (i + 1) * step AS upper
         FROM (SELECT start, step, unnest(range(k)) AS i FROM grid) r),
cnt AS (SELECT CAST(greatest(1, least((SELECT k FROM grid),
                   ceil((x - (SELECT start FROM grid) - 1e-7::DOUBLE * (SELECT step FROM grid)) / (SELECT step FROM grid))))
                   AS BIGINT) AS bin,
               count(*) AS c FROM hv GROUP BY 1)
SELECT bins.bin, lower, upper, (lower + upper) / 2 AS mid, CAST(coalesce(c, 0) AS BIGINT) AS count,
       CAST(coalesce(c, 0) AS DOUBLE) / (CAST((SELECT n FROM grid) AS DOUBLE) * (SELECT step FROM grid)) AS density
FROM bins LEFT JOIN cnt ON bins.bin = cnt.bin"""


def _preview() -> str:
    return with_ctes(ADSL) + f"SELECT {ADSL_COLS} FROM adsl ORDER BY usubjid LIMIT 6"


def statements() -> dict[str, str]:
    return {
        "population": _population(),
        "with_total": _with_total(),
        "big_n": _big_n(),
        "choice_filter": _choice_filter(),
        "facet_values": _facet("param"),
        "facet_visits": _facet("visit"),
        "facet_default": _facet("param", 3),
        "numeric_split": _numeric("split"),
        "numeric_combined": _numeric("combined"),
        "numeric_empty_split": _numeric("split", NO_AGE, ends=True),
        "numeric_empty_combined": _numeric("combined", NO_AGE, ends=True),
        "categorical_summary": _categorical(),
        "demo_table": _demo("trt01a", "split"),
        "demo_table_combined": _demo("trt01p", "combined", "AND sex IN ('M', 'F')", PLANNED + ["Total"]),
        "incidence": _incidence(),
        "rank_levels": _rank_levels(),
        "with_percent": _with_percent(),
        "ae_summary": _ae_summary(),
        "ae_summary_filtered": _ae_summary(AE_FILTER, indent="&nbsp;&nbsp;&nbsp;"),
        "ae_summary_choices": _ae_summary_choices(),
        "ae_summary_extra_arm": _ae_summary(bign=BIGN_LESS),
        "lab_table_extra_arm": _lab_table(BIGN_LESS),
        "percent_cells": _percent_cells(),
        "median_narrowed": _median_narrowed(),
        "self_big_n": _self_big_n(),
        "row_total": _row_total(),
        "soc_header_first": _soc_header_first(),
        "soc_header_distinct": _soc_header_distinct(),
        "ae_term_table": _ae_term_table(),
        "ae_term_table_columns": _ae_term_table("lower(aebodsys)", "substr(aedecod, 1, 7)"),
        "flag_code": _flag_code(),
        "one_flag_per_subject": _one_flag(),
        "param_incidence": _param_incidence(),
        "flag_incidence": _flag_incidence(),
        "lab_table": _lab_table(),
        "complete_grid": _complete_grid(),
        "lab_table_grid": _lab_grid(),
        "to_long": _to_long(),
        "to_wide_fill": _to_wide_fill(),
        "histogram": _histogram(),
        "preview": _preview(),
    }
