"""Plain SQL (DuckDB) of the queries that SQL can express, over the raw tables."""

from __future__ import annotations

from cohortab.llm import centroids, embedding_dedup, language_id, quality_rules, spelling, url_model

_WORD = r"[^\x20\x09-\x0D]+"


def quality_rules_sql() -> str:
    q = quality_rules
    return f"""WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
one AS (SELECT rid, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM d),
win AS (SELECT rid, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM one WINDOW o AS (PARTITION BY rid ORDER BY i)),
tri AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS times FROM win WHERE c IS NOT NULL),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE times > 1)
        GROUP BY rid),
ln AS (SELECT rid, doc_id, host, t, l, lower(array_to_string(regexp_extract_all(l, '{_WORD}'), ' ')) AS h,
              len(regexp_extract_all(l, '{_WORD}')) AS w
       FROM (SELECT rid, doc_id, host, t, unnest(string_split(t, chr(10))) AS l FROM d)
       WHERE regexp_matches(l, '{_WORD}')),
dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM ln GROUP BY rid),
over_ AS (SELECT host, h, min(doc_id) AS first FROM ln GROUP BY host, h
          HAVING count(DISTINCT doc_id) + CAST(bool_or(doc_id IS NULL) AS INTEGER) > {q.LINE_LIMIT}),
gone AS (SELECT rid, sum(w) AS n FROM ln JOIN over_ o ON ln.host IS NOT DISTINCT FROM o.host AND ln.h = o.h
         WHERE ln.doc_id IS DISTINCT FROM o.first GROUP BY rid),
c AS (SELECT d.rid, d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(t) - length(translate(t, '{q.SYMBOLS}', '')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
             coalesce(rep.n, 0) AS n_repeat_words, len(ws) - coalesce(gone.n, 0) AS words_left
      FROM d LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid)),
b AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, CAST(words_left AS BIGINT) AS words_left,
       NOT base_failed AND 100 * words_left >= {q.MIN_LEFT_PERCENT} * n_words AS kept FROM b"""


def url_filter_sql() -> str:
    u = url_model
    ordered = sorted(u.RULES, key=lambda r: -len(r[1] + r[2]))

    def case(value):
        arms = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(v, h, p)}'"
                        for v, h, p in ordered)
        return f"CASE {arms} END"

    def mixed(cls):
        low = f"(1.0::DOUBLE / {u.ALPHABET})"
        for n, num in ((1, f"c1.{cls}"), (2, f"c2.{cls}"), (3, f"t.{cls}")):
            x = f"x{n}"
            low = f"CASE WHEN {x}.n_{cls} > 0 THEN ({num} + {x}.t_{cls} * {low}) / ({x}.n_{cls} + {x}.t_{cls}) ELSE {low} END"
        return low

    seen = "sum(ok) AS n_ok, sum(bad) AS n_bad, sum(CAST(ok > 0 AS BIGINT)) AS t_ok, sum(CAST(bad > 0 AS BIGINT)) AS t_bad"
    keep = u.SYMBOLS.replace("-", "\\-")
    return f"""WITH s AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
parts AS (SELECT DISTINCT url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM s),
hp AS (SELECT url, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM parts),
p AS (SELECT url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hp),
r AS (SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS given,
             regexp_replace(regexp_replace(lower(url), '[0-9]', '0', 'g'), '[^{keep}]', '~', 'g') AS f FROM p),
g AS (SELECT url, given, substr('^^' || f, i, 3) AS g FROM (SELECT *, unnest(range(1, length(f) + 1)) AS i FROM r)),
t AS (SELECT g, count(*) FILTER (given = 'allow') AS ok, count(*) FILTER (given = 'block') AS bad FROM g GROUP BY g),
c1 AS (SELECT g[3] AS c, sum(ok) AS ok, sum(bad) AS bad FROM t GROUP BY ALL),
c2 AS (SELECT g[2:3] AS bc, sum(ok) AS ok, sum(bad) AS bad FROM t GROUP BY ALL),
x1 AS (SELECT {seen} FROM c1),
x2 AS (SELECT bc[1] AS b, {seen} FROM c2 GROUP BY ALL),
x3 AS (SELECT g[1:2] AS ab, {seen} FROM t GROUP BY ALL),
m AS (SELECT t.g, ln({mixed('ok')}) - ln({mixed('bad')}) AS llr
      FROM t JOIN c1 ON c1.c = t.g[3] JOIN c2 ON c2.bc = t.g[2:3] JOIN x2 ON x2.b = t.g[2] JOIN x3 ON x3.ab = t.g[1:2], x1),
sc AS (SELECT url, sum(llr) / count(*) AS score FROM g JOIN m USING (g) GROUP BY url),
j AS (SELECT r.*, coalesce(sc.score, 0) AS score FROM r LEFT JOIN sc USING (url)),
st AS (SELECT avg(score) FILTER (given = 'allow') AS ma, stddev_pop(score) FILTER (given = 'allow') AS sa,
              avg(score) FILTER (given = 'block') AS mb, stddev_pop(score) FILTER (given = 'block') AS sb FROM j),
cut AS (SELECT CASE WHEN ma IS NULL OR mb IS NULL THEN 0
                    ELSE mb + CASE WHEN sa + sb > 0 THEN sb / (sa + sb) ELSE 0.5 END * (ma - mb) END AS cut FROM st)
SELECT s.page_id, j.host, j.path, j.rule,
       coalesce(j.given, CASE WHEN j.score >= (SELECT cut FROM cut) THEN 'allow' ELSE 'block' END) AS verdict
FROM s JOIN j USING (url)"""


def embedding_groups_sql() -> str:
    t = embedding_dedup.THRESHOLD
    return f"""WITH RECURSIVE e AS (
  SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS (SELECT a.rid AS a, b.rid AS b FROM ok a JOIN ok b ON a.rid <> b.rid AND len(a.v) = len(b.v)
         WHERE list_dot_product(a.v, b.v) >= {t} * sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a AS rid, min(vec_id) AS low FROM reach JOIN e ON e.rid = reach.b GROUP BY a),
n AS (SELECT a AS rid, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, low.low) AS component_id,
       coalesce(vec_id = least(vec_id, low.low), ok.rid IS NULL) AS kept
FROM e LEFT JOIN ok USING (rid, vec_id) LEFT JOIN low USING (rid) LEFT JOIN n USING (rid)"""


def _crc32(text: str) -> str:
    """crc32 of a text of ASCII and Latin-1 letters (UTF-8 bytes), by the usual table, which its rule builds."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        table.append(c)
    utf8 = ("flatten(list_transform(string_split(%s, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] "
            "ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END))") % text
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {utf8}), "
            f"lambda h, b: xor(h >> 8, CAST({table} AS BIGINT[])[(xor(h, b) & 255) + 1])), 4294967295)")


def language_id_sql() -> str:
    unit, scored = language_id.UNIT, "CAST(round((log10(t) - log10(n)) * {u}) AS BIGINT)".format(u=language_id.UNIT)
    worst = f"CAST(round((log10(max(t)) + 1) * {unit}) AS BIGINT)"
    return f"""WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, lang, text, regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+') AS ws,
         coalesce({_crc32("CAST(doc_id AS VARCHAR)")} % {language_id.FOLDS} = 0, false) AS held_out FROM documents),
train AS (SELECT rid, lang FROM d WHERE NOT held_out AND doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL),
langs AS MATERIALIZED (SELECT DISTINCT lang FROM train),
dw AS MATERIALIZED (SELECT rid, w, count(*) AS k FROM (SELECT rid, unnest(ws) AS w FROM d) GROUP BY ALL),
kw AS MATERIALIZED (SELECT w, lang, sum(k) AS n FROM dw JOIN train USING (rid) GROUP BY ALL),
kt AS MATERIALIZED (SELECT lang, sum(n) AS t FROM kw GROUP BY lang),
kd AS (SELECT DISTINCT w FROM kw),
known AS (SELECT kd.w, l.lang, CASE WHEN n IS NULL THEN (SELECT {worst} FROM kt) ELSE {scored} END AS s
          FROM kd CROSS JOIN langs l LEFT JOIN kw ON kw.w = kd.w AND kw.lang = l.lang LEFT JOIN kt ON kt.lang = l.lang),
sizes AS (SELECT unnest(range(1, {language_id.LONGEST} + 1)) AS size),
kg AS (SELECT w, size, substr(' ' || w || ' ', unnest(range(1, length(w) + 4 - size)), size) AS g FROM kd, sizes),
gc AS MATERIALIZED (SELECT size, g, lang, sum(n) AS n FROM kg JOIN kw USING (w) GROUP BY ALL),
gt AS MATERIALIZED (SELECT size, lang, sum(n) AS t FROM gc GROUP BY ALL),
gw AS (SELECT size, {worst} AS worst FROM gt GROUP BY size),
gd AS (SELECT DISTINCT size, g FROM gc),
gs AS (SELECT gd.size, gd.g, l.lang, CASE WHEN n IS NULL THEN worst ELSE {scored} END AS s
       FROM gd CROSS JOIN langs l JOIN gw USING (size) LEFT JOIN gc ON gc.size = gd.size AND gc.g = gd.g AND gc.lang = l.lang
       LEFT JOIN gt ON gt.size = gd.size AND gt.lang = l.lang),
new AS (SELECT DISTINCT w FROM dw ANTI JOIN kd USING (w)),
ng AS (SELECT w, size, substr(' ' || w || ' ', unnest(range(1, length(w) + 4 - size)), size) AS g FROM new, sizes),
hit AS MATERIALIZED (SELECT w, size, g FROM ng SEMI JOIN gd USING (size, g)),
long AS (SELECT w, max(size) AS size FROM hit GROUP BY w),
backed AS (SELECT w, lang, CAST(round(avg(s)) AS BIGINT) AS s FROM hit JOIN long USING (w, size) JOIN gs USING (size, g) GROUP BY w, lang),
ws AS (SELECT * FROM known UNION ALL SELECT * FROM backed),
sums AS (SELECT rid, lang, sum(k * s) AS total, sum(k) AS n FROM dw JOIN ws USING (w) GROUP BY rid, lang),
best AS (SELECT rid, arg_min(lang, ROW(total, lang)) AS lang, min(total) AS low FROM sums GROUP BY rid),
score AS (SELECT rid, 1.0 / sum(pow(10.0::DOUBLE, (low - total) / (n * {unit}.0::DOUBLE))) AS score FROM sums JOIN best USING (rid) GROUP BY rid),
usual AS (SELECT arg_min(l.lang, ROW(-coalesce(t, 0), l.lang)) AS lang, 1.0::DOUBLE / count(*) AS share FROM langs l LEFT JOIN kt USING (lang))
SELECT doc_id, held_out,
       CASE WHEN len(d.ws) = 0 OR usual.lang IS NULL THEN '{language_id.UNKNOWN}' ELSE coalesce(best.lang, usual.lang) END AS lang_pred,
       CASE WHEN len(d.ws) = 0 OR usual.lang IS NULL THEN 0.0::DOUBLE ELSE round(coalesce(score, share), {language_id.DIGITS}) END AS score
FROM d LEFT JOIN best USING (rid) LEFT JOIN score USING (rid), usual"""


def spelling_variants_sql() -> str:
    q = spelling
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH RECURSIVE r AS (
  SELECT doc, run, count(*) AS n FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(
      unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), '{upper}', '{upper.lower()}') AS run FROM documents)
  WHERE length(run) >= {q.MIN_LENGTH} GROUP BY ALL),
h AS MATERIALIZED (SELECT run, n, {_crc32("doc || ':' || run")} AS h FROM r),
w AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % {q.TYPO_MODULUS} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
    FROM h) WHERE length(word) >= {q.MIN_LENGTH} GROUP BY word HAVING sum(n) >= {q.MIN_COUNT}),
cut AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
                     FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
gone AS (SELECT DISTINCT c.word AS a, w.word AS b FROM cut c JOIN w ON c.rest = w.word),
near AS MATERIALIZED (SELECT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
                      UNION SELECT a, b FROM gone UNION SELECT b, a FROM gone),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, ROW(-w.n, b)) AS b, max(w.n) AS m FROM near JOIN w ON w.word = b GROUP BY a),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {q.LEAD} * w.n THEN b END AS form,
                          CASE WHEN m >= {q.LEAD} * w.n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
up(word, root) AS (SELECT word, word FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, up.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM f JOIN up ON up.word = f.word JOIN f AS e ON e.word = up.root AND e.form IS NULL"""


def centroid_clusters_sql() -> str:
    c = centroids
    dist = "(list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c))"  # whole numbers below 2^53
    parts = [f"""WITH x AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({c.SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) = {c.DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c
  FROM (SELECT sha256('{c.START}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM x ORDER BY h, v LIMIT {c.CLUSTERS}))"""]
    for r in range(c.ROUNDS + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT rid, min(ROW({dist}, k)) AS m FROM x, c{r} GROUP BY rid)""")
        if r < c.ROUNDS:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT o.k, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN (
  SELECT k, list(s ORDER BY j) AS c FROM (
    SELECT m[2] AS k, j, floor(sum(v[j]) / count(*)) AS s FROM a{r} JOIN x USING (rid), range(1, {c.DIM} + 1) t(j) GROUP BY ALL)
  GROUP BY k) n USING (k))""")
    last = c.ROUNDS
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(a.m[2] AS INTEGER) AS cluster, CAST(a.m[1] AS BIGINT) AS distance,
       CAST(sum(a.m[1]) OVER (PARTITION BY a.m[2]) AS BIGINT) AS cluster_inertia, CAST(sum(a.m[1]) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{last} a JOIN x USING (rid) JOIN c{last} ON k = a.m[2]"""
