"""Inputs at the edges of the operators: odd arguments, equal rows, clashing columns, very long texts."""
import json
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortab.llm import chat_tools, packing, quality_model
from cohortab.llm import sentencepiece_dropout as sp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after string"
RESULTS = "conv_id long, call_id string, turn long, content string"


# ------------------------------------------------------------- tool calls

def model_links(calls, results, tools):
    """The linking on plain dictionaries; rows as tuples in the operator's column order."""
    first = {}
    for c, i, turn, name, args, after in sorted(calls, key=lambda x: tuple((v is not None, v) for v in x[2:])):
        if c is not None and i is not None:
            first.setdefault((c, i), (turn, name, args, after))
    answer = {}
    for c, i, turn, text in sorted(results, key=lambda x: tuple((v is not None, v) for v in x[2:])):
        if c is not None and i is not None:
            answer.setdefault((c, i), (turn, text))

    def checked(name, ident, args):
        try:
            value = json.loads(args if args is not None else "{}", parse_constant=lambda n: 1 / 0)
            text = json.dumps({"arguments": value, "id": ident, "name": name}, sort_keys=True, separators=(",", ":"),
                              ensure_ascii=False, allow_nan=False)
        except (ValueError, ZeroDivisionError):
            return None, "not JSON"
        if any(0xD800 <= ord(ch) < 0xE000 for ch in text):
            return None, "not Unicode"
        return text, "" if name in tools else "unknown tool"

    def depth(c, i):
        seen, d = set(), 0
        while True:
            if i in seen:
                return None
            seen.add(i)
            up = first[c, i][3]
            if up is None or (c, up) not in first:
                return d
            i, d = up, d + 1

    rows = []
    for (c, i), (turn, name, args, after) in first.items():
        got = answer.get((c, i), (None, None))
        d = depth(c, i)
        status = ("dangling" if after is not None and (c, after) not in first else "cycle" if d is None
                  else "unanswered" if got[0] is None else "early" if got[0] <= turn else "ok")
        rows.append((c, i, name, turn, *got, d, *checked(name, i, args), status))
    for c, i, turn, name, args, _ in calls:
        if c is None or i is None:
            rows.append((c, i, name, turn, None, None, None, *checked(name, i, args), "unanswered"))
    for c, i, turn, text in results:
        if c is None or i is None or (c, i) not in first:
            rows.append((c, i, None, None, turn, text, None, None, "", "orphan"))
    out, per = [], defaultdict(list)
    for x in rows:
        per[x[0]].append(x)
    for group in per.values():
        group.sort(key=lambda x: (x[3] is None, *((x[k] is None, x[k]) for k in (6, 3, 1, 4, 5))))
        out += [(*x[:7], p, *x[7:]) for p, x in enumerate(group, 1)]
    return out


def random_calls(seed, n):
    r = random.Random(seed)
    texts = ["{}", None, '{"a": 1}', "{", "[1, 2]", "1e999", "NaN", '{"b": "\\ud800"}', "9" * 400, '{"k": ' + "7" * 400 + "}"]
    calls, results, seen = [], [], set()
    for k in range(n):
        c, i = r.choice([1, 2, 3, None, 9, 9, 9, 9]), r.choice([None, *(f"c{x}" for x in range(n // 3))])
        if (c, i) in seen and c is not None and i is not None:
            continue  # repeated ids are tested by hand: here ties would be free
        seen.add((c, i))
        calls.append((c, i, k, r.choice(["t", "u", None]), r.choice(texts), r.choice([None, None, f"c{r.randrange(n // 3)}"])))
        if r.random() < 0.7:
            results.append((c, i, k + r.choice([-1, 1, 5]), f"r{k}"))
    calls += [(5, "p", 1, "t", "{}", "q"), (5, "q", 2, "t", "{}", "p"), (5, "r", 3, "t", "{}", "p")]
    results += [(1, f"x{k}", 1000 + k, None) for k in range(4)] + [(None, None, 7, "lost")]
    return calls, results


@pytest.mark.parametrize("seed", [1, 2])
def test_tool_calls_against_brute_force(spark, seed):
    calls, results = random_calls(seed, 240)
    tools = {"t": {}}
    a, b = spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS)
    a, b = a.withColumn("depth", a["turn"]).withColumn("position", a["turn"]), b.withColumn("status", b["turn"])
    got = chat_tools.link_tool_calls(a, b, tools)
    assert got.columns == ["conv_id", "call_id", "name", "call_turn", "result_turn", "result", "depth", "position", "call_json",
                           "violations", "status"]
    got, want = Counter(map(tuple, got.collect())), Counter(model_links(calls, results, tools))
    assert got == want
    assert {x[-1] for x in want} == {"ok", "unanswered", "early", "orphan", "dangling", "cycle"}


def test_arguments_that_no_number_or_character_can_be(spark):
    schema = {"type": "object", "properties": {"n": {"type": "integer", "minimum": 3}}}
    args = ['{"n": ' + "9" * 400 + "}", '{"n": 1e999}', '{"n": "\\ud800"}', '{"\\ud800": 1}', '{"n": ' + "9" * 5000 + "}",
            '{"n": 4.0}', '{"n": 4.5}', "[" * 100_000, '{"n": "' + "x" * 3_000_000 + '"}']
    calls = spark.createDataFrame([(1, f"c{i}", i, "t", a, None) for i, a in enumerate(args)], CALLS)
    got = {x["call_id"]: x for x in chat_tools.link_tool_calls(calls, spark.createDataFrame([], RESULTS), {"t": schema}).collect()}
    assert [got[f"c{i}"]["violations"] for i in range(len(args))] == [
        "", "not JSON", "not Unicode", "not Unicode", "not JSON", "", "$.n: not integer", "not JSON", "$.n: not integer"]
    assert got["c0"]["call_json"].count("9") == 400


def test_roles_without_a_call(spark):
    turns = [(1, 0, "user", "hello there"), (1, 1, "tool", "42"), (1, 2, None, "?"), (1, 3, "critic", "no"), (1, 0, "user", "again")]
    conv = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    got = chat_tools.link_tool_calls(*chat_tools.calls_of_turns(conv), chat_tools.TOOLS).collect()
    assert sorted((x["status"], x["result"]) for x in got) == [("ok", "42"), ("orphan", "?"), ("orphan", "no")]


# ------------------------------------------------------------- merge-dropout

def test_every_character_decodes_to_itself(spark):
    odd = "a\U0010fffe▁b \U0010ffff\U0010fffd ▁▁ x￾"
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [odd, odd * 50, "".join(points[::97]), "".join(points[-40_000:])]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    assert all(x["lossless"] for x in sp.round_trip(df).collect())


# ------------------------------------------------------------- packing

def test_equal_rows_are_spread_over_the_groups(spark):
    rows = [(1, "same text", "en", "s", 0)] * 6_000 + [(i, f"text {i}", "en", f"s{i}", 0) for i in range(2, 6_002)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("grp", F.lit(1)).withColumn("copy", F.lit(1))
    got = packing.best_fit_packing(df, group_rows=500).collect()
    assert len(got) == 12_000
    groups = Counter(x["bin"].split("-")[0] for x in got if x["doc_id"] == 1)
    assert len(groups) == 24 and max(groups.values()) < 400
    same = [x["bin"] for x in got if x["doc_id"] == 1]
    assert len(set(same)) == 6_000  # one cluster: never two in a bin


# ------------------------------------------------------------- classifier

def test_extra_columns_with_the_names_of_inner_ones(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["good", "fine", "word"] if i % 2 else ["###", "$$$", "1!"]) for _ in range(30)), "en", "s", 0)
            for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    plain = spark.createDataFrame(rows, SCHEMA)
    extra = plain
    for c in ("y", "y2", "__id", "__doc", "__text", "t", "x", "id", "score", "quality"):
        extra = extra.withColumn(c, F.lit("q"))
    want = sorted(map(tuple, quality_model.quality_scores(plain, labels).collect()))
    assert sorted(map(tuple, quality_model.quality_scores(extra, labels).collect())) == want
    kept = quality_model.keep_good(extra, labels)
    assert kept.columns == extra.columns
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(i for i, _, _, p in want if p == 1)


def test_sections_score_like_the_whole():
    m = quality_model.AttentionModel(3)
    x = np.random.default_rng(1).normal(size=(50, quality_model.N_FEATURES)).astype(np.float32) / 20
    whole = m.score(x, np.zeros(50, dtype=np.int64), 1)[0]
    assert m.score_sections([x[:7], x[7:30], x[30:]]) == pytest.approx(whole, abs=1e-6)


def plain_score(m, x, bag, n):
    """The model written out for one passage at a time."""
    p, out = {k: np.asarray(v, dtype=np.float64) for k, v in m.p.items()}, []
    for i in range(n):
        hs = [np.tanh(row.astype(np.float64) @ p["E"] + p["e"]) for row in x[bag == i]]
        gates = [np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"]))) @ p["w"] for h in hs]
        weight = np.exp(gates) / np.exp(gates).sum()
        z = sum(a * h for a, h in zip(weight, hs))
        out.append(1 / (1 + np.exp(-(z @ p["c"] + p["d"] + m.shift))))
    return np.array(out)


def test_forward_and_gradient_against_finite_differences():
    r = np.random.default_rng(5)
    x = r.normal(size=(9, quality_model.N_FEATURES)).astype(np.float32) / 10
    bag, label = np.array([0, 0, 1, 2, 2, 2, 3, 3, 3]), np.array([1, 0, 1, 0], dtype=np.float32)
    m = quality_model.AttentionModel(1)
    assert m.score(x, bag, 4) == pytest.approx(plain_score(m, x, bag, 4), abs=1e-5)

    def loss():
        q = plain_score(m, x, bag, 4)
        return -np.mean(label * np.log(q) + (1 - label) * np.log(1 - q))

    # one step of the fit moves every parameter against the sign of its slope
    after = quality_model.AttentionModel(1).fit(x, bag, label, epochs=1, batch=4)
    for name, index in (("c", (3,)), ("w", (2,)), ("V", (4, 1)), ("U", (6, 3)), ("e", (5,)), ("E", (10, 2)), ("d", ())):
        old = m.p[name][index]
        slope = []
        for d in (1e-3, -1e-3):
            m.p[name] = m.p[name].astype(np.float64)
            m.p[name][index] = old + d
            slope.append(loss())
            m.p[name][index] = old
        slope = (slope[0] - slope[1]) / 2e-3
        if abs(slope) > 1e-5:
            assert np.sign(after.p[name][index] - old) == -np.sign(slope), name


def test_a_very_long_text_takes_bounded_memory():
    import pyarrow as pa

    m = quality_model.AttentionModel(1)
    column = pa.array(["short", "word and more " * 4_000_000, "end"])  # 56 MB
    tracemalloc.start()
    got = quality_model._scores(m, column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 3 and ((got > 0) & (got < 1)).all() and peak < 500e6
    assert got[0] == quality_model._scores(m, pa.array(["short"]))[0] and got[2] == quality_model._scores(m, pa.array(["end"]))[0]
