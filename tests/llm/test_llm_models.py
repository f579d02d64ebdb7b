"""Classifier, merge-dropout encoding, embeddings, tool calls and the pipeline."""
import hashlib
import json
import os
import random

import numpy as np
import pytest

from cohortab.llm import chat_tools, embedding_dedup, quality_model, quality_rules
from cohortab.llm import sentencepiece_dropout as sp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# ------------------------------------------------------------- classifier

@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        prose = " ".join("".join(r.choice("abcdefghi") for _ in range(r.randint(2, 7))) for _ in range(r.randint(20, 300)))
        junk = " ".join(w + r.choice(["***", "$$$"]) for w in prose.split()[:40])
        rows.append((i, prose if good else prose + " " + junk, "en", "s", 1))
        labels.append((i, int(good), 0))
    rows += [(9_001, None, "en", "s", 0), (9_002, "", "en", "s", 0), (None, "abc def", "en", "s", 0), rows[0]]
    return (spark.createDataFrame(rows, SCHEMA),
            spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int"))


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    got = quality_model.quality_scores(docs.withColumn("score", docs["n_chars"]), labels).collect()
    assert len(got) == 404
    out = {r["doc_id"]: r for r in got}
    fold = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert len(fold) > 40
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in fold]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert out[9_001]["score"] == out[9_002]["score"] and not out[None]["held_out"]


def test_fold_is_crc32(spark):
    import zlib

    from pyspark.sql import functions as F

    got = spark.range(200).select("id", quality_model.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


def test_held_out_labels_do_not_matter(spark, labelled):
    from pyspark.sql import functions as F

    docs, labels = labelled
    flipped = labels.withColumn("quality", F.when(quality_model.held_out(F.col("doc_id")), 1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    a, b = (quality_model.quality_scores(docs, x).orderBy("doc_id").collect() for x in (labels, flipped))
    # only the class shares could differ, and they too come from the training fold
    assert a == b


def test_without_labels_of_both_kinds(spark, labelled):
    docs, _ = labelled
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {r["score"] for r in quality_model.quality_scores(docs, one).collect()} == {0.5}
    empty = spark.createDataFrame([], SCHEMA)
    assert quality_model.quality_scores(empty, one).collect() == []


def test_gradient_of_the_attention_model():
    r = np.random.default_rng(0)
    x = r.normal(size=(7, quality_model.N_FEATURES)).astype(np.float32) / 20
    bag, label = np.array([0, 0, 0, 1, 2, 2, 2]), np.array([1, 0, 1], dtype=np.float32)
    loss = []
    for epochs in (1, 40):
        m = quality_model.AttentionModel().fit(x, bag, label, epochs=epochs)
        p = m.score(x, bag, 3)
        loss.append(-np.mean(np.log(np.where(label == 1, p, 1 - p))))
    assert loss[1] < loss[0] / 5


# ------------------------------------------------------------- SentencePiece

TEXTS = ["", " ", "  two  spaces ", "tab\tline\nend", "漢字かな交じり文", "😀 ▁ marked ▁▁x", "a" * 700, "Ünïcode wörds hé",
         "the quick brown fox jumps over the lazy dog " * 30, "x" * 60 + " " * 40 + "y", "\x00\x01 control"]
needs_model = pytest.mark.skipif(not os.path.exists(sp.MODEL), reason="no model file")


@needs_model
def test_without_dropout_it_is_the_library():
    import sentencepiece

    lib, voc = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL), sp.load_vocabulary()
    got = sp.encode_batch(voc, TEXTS, list(range(len(TEXTS))), 0.0, 1, 4)
    for t, g in zip(TEXTS, got):
        if sp.SPACE not in t and "\x00" not in t:
            assert g.tolist() == lib.encode(t)


@needs_model
def test_dropout_decodes_losslessly_and_varies(monkeypatch):
    voc = sp.load_vocabulary()
    for rate in (0.1, 0.5, 1.0):
        a = sp.encode_batch(voc, TEXTS, list(range(len(TEXTS))), rate, 1, 4)
        assert [sp.decode_tokens(voc, x.astype("<u2").tobytes()) for x in a] == TEXTS
        again = sp.encode_batch(voc, TEXTS[::-1], list(range(len(TEXTS)))[::-1], rate, 1, 4)[::-1]
        assert all((x == y).all() for x, y in zip(a, again))
    other = sp.encode_batch(voc, TEXTS, list(range(len(TEXTS))), 0.5, 2, 4)
    mine = sp.encode_batch(voc, TEXTS, list(range(len(TEXTS))), 0.5, 1, 4)
    assert any(x.tolist() != y.tolist() for x, y in zip(mine, other))
    monkeypatch.setattr(sp, "LONG_WORD", 0)                        # the heap makes the same choices
    heap = sp.encode_batch(voc, TEXTS, list(range(len(TEXTS))), 0.5, 1, 4)
    assert [x.tolist() for x in heap] == [x.tolist() for x in mine]


def plain_agenda(voc, word, key, rate):
    """The agenda by definition: rescan all pairs, best rank first, leftmost on ties."""
    sym = [(int(voc.char_ids[ord(c)]), i, i + 1) for i, c in enumerate(word)]
    while True:
        best = None
        for k in range(len(sym) - 1):
            rank, merged = voc.rank(np.array([sym[k][0]]), np.array([sym[k + 1][0]]))
            at = [np.array([x], dtype=np.int64) for x in (sym[k][1], sym[k + 1][1], sym[k + 1][2])]
            if rank[0] != sp._NEVER and not sp._skipped(np.array([key], dtype=np.uint64), *at, rate)[0]:
                if best is None or rank[0] < best[0]:
                    best = (rank[0], k, int(merged[0]))
        if best is None:
            return [s[0] for s in sym]
        _, k, m = best
        sym[k:k + 2] = [(m, sym[k][1], sym[k + 1][2])]


@needs_model
def test_agenda_against_its_definition():
    voc, r = sp.load_vocabulary(), random.Random(3)
    words = [sp.SPACE + "".join(r.choice("theraionsdlg") for _ in range(r.randint(1, 14))) for _ in range(60)]
    keys = np.array([r.getrandbits(64) for _ in words], dtype=np.uint64)
    for rate in (0.0, 0.2, 0.6):
        flat, count = sp.encode_words(voc, words, keys, rate)
        ends = np.cumsum(count)
        got = [flat[e - n:e].tolist() for e, n in zip(ends.tolist(), count.tolist())]
        assert got == [plain_agenda(voc, w, int(k), rate) for w, k in zip(words, keys)]


@needs_model
def test_every_occurrence_draws_for_itself():
    """A frequent word with one candidate merge is split at the rate; words vary without a cap; a record stays alike."""
    voc = sp.load_vocabulary()
    one = [a for a in "abcdefghijklmnopqrstuvwxyz" if sp.SPACE + a in voc.pieces]
    texts = [" ".join(one * 10)] * 40
    whole = np.array([len(x) for x in sp.encode_batch(voc, texts, list(range(40)), 0.0, 5)])
    got = sp.encode_batch(voc, texts, list(range(40)), 0.1, 5)
    split = (np.array([len(x) for x in got]) - whole).sum() / (40 * len(one) * 10)
    assert 0.08 < split < 0.12
    for a in one:                                                 # each such word, not only their mean
        n = len(sp.encode_batch(voc, [" ".join([a] * 8000)], [1], 0.1, 5)[0]) / 8000 - 1
        assert 0.08 < n < 0.12
    many = sp.encode_batch(voc, ["international"] * 400, list(range(400)), 0.3, 5)
    assert len({tuple(x.tolist()) for x in many}) > 8
    long_ = sp.encode_batch(voc, ["x" * 200 + " the"] * 2, [3, 3], 0.3, 5, 1)
    assert long_[0].tolist() == long_[1].tolist()


@needs_model
def test_round_trip_query(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS) if "\x00" not in t] + [(None, "null id"), (77, None), (0, TEXTS[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 tokens", "2 n_tokens", "3 decoded")
    got = sp.round_trip(df).collect()
    assert len(got) == len(rows) and all(r["lossless"] for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (0, 77)} == {0}
    assert sp.round_trip(df.limit(0)).collect() == []


# ------------------------------------------------------------- embeddings

def brute_links(vectors, threshold=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    n = len(vectors)
    linked = np.zeros((n, n), dtype=bool)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], dtype=float), np.array(vectors[j], dtype=float)
                linked[i, j] = linked[j, i] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold
    return linked


@pytest.mark.parametrize("dim", [3, 40])
def test_embedding_groups_against_brute_force(spark, dim):
    r = np.random.default_rng(dim)
    centers = r.normal(size=(12, dim))
    vectors = [list(map(float, np.float32(centers[i % 12] + r.normal(size=dim) * (0.03 if i % 3 else 0.3)))) for i in range(90)]
    vectors += [vectors[0]] * 5 + [[2 * x for x in vectors[1]], [0.0] * dim, None, [], [float("nan")] * dim,
                                   [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0, 2.0]]
    ids = list(range(100, 100 + len(vectors)))
    r.shuffle(ids)
    df = spark.createDataFrame(list(zip([int(i) for i in ids], vectors)), "vec_id long, embedding array<float>")
    df = df.selectExpr("*", "1 label", "2 cls", "3 v", "4 id")
    for chunk in (4_096, 7):
        got = {x["vec_id"]: x for x in embedding_dedup.embedding_groups(df, chunk=chunk).collect()}
        linked = brute_links(vectors)
        comp = {i: {i} for i in ids}
        for a, b in zip(*np.nonzero(linked)):
            if comp[ids[a]] is not comp[ids[b]]:
                both = comp[ids[a]] | comp[ids[b]]
                for x in both:
                    comp[x] = both
        for k, i in enumerate(ids):
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (
                linked[k].sum(), min(comp[i]), min(comp[i]) == i)
        assert linked.sum() > 100


def test_embedding_edge_tables(spark):
    t = "vec_id long, embedding array<float>"
    assert embedding_dedup.embedding_groups(spark.createDataFrame([], t)).collect() == []
    got = embedding_dedup.embedding_groups(spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0])], t))
    assert sorted((x["vec_id"] or 0, x["n_links"], x["component_id"], x["kept"]) for x in got.collect()) == [
        (0, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True)]


# ------------------------------------------------------------- tool calls

def test_tool_calls(spark):
    tools = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 0}},
                   "additionalProperties": False}}
    calls = spark.createDataFrame([
        ("c", "b", 3, "f", '{"x": 2.0}', "a"), ("c", "a", 1, "f", '{"x":1}', None), ("c", "z", 5, "f", '{"x":-1,"y":0}', "b"),
        ("c", "dup", 7, "f", "{}", None), ("c", "dup", 6, "g", None, None), ("c", "p", 8, "f", "{bad", "q"),
        ("c", "q", 9, "f", '{"x":NaN}', "p"), ("c", "w", 10, "f", '{"x":true}', "nowhere"), ("d", "a", 1, "f", '{"x":1}', "a"),
        (None, "a", 1, "f", '{"x":3}', None), ("c", None, 2, "f", '{"x":4}', None)],
        "conv_id string, call_id string, turn long, name string, arguments string, after string")
    results = spark.createDataFrame([
        ("c", "a", 2, "r1"), ("c", "a", 12, "late"), ("c", "b", 3, "same turn"), ("c", "lost", 4, "x"), ("c", "dup", 9, None),
        (None, "a", 1, "n"), ("c", "w", 11, "")], "conv_id string, call_id string, turn long, content string")
    got = chat_tools.link_tool_calls(calls, results, tools).collect()
    at = {(r["conv_id"], r["call_id"], r["status"]): r for r in got}
    assert len(got) == 12
    ok = at["c", "a", "ok"]
    assert (ok["depth"], ok["result"], ok["call_json"]) == (0, "r1", '{"arguments":{"x":1},"id":"a","name":"f"}')
    assert at["c", "b", "early"]["depth"] == 1 and at["c", "b", "early"]["violations"] == ""
    assert at["c", "b", "early"]["call_json"] == '{"arguments":{"x":2},"id":"b","name":"f"}'
    assert (at["c", "z", "unanswered"]["depth"], at["c", "z", "unanswered"]["violations"]) == (2, "$.x: range; $.y: unknown")
    assert at["c", "dup", "ok"]["name"] == "g" and at["c", "dup", "ok"]["violations"] == "unknown tool"
    assert at["c", "p", "cycle"]["violations"] == "not JSON" and at["c", "q", "cycle"]["call_json"] is None
    assert at["c", "w", "dangling"]["violations"] == "$.x: not integer"
    assert ("d", "a", "cycle") in at and (None, "a", "unanswered") in at and ("c", None, "unanswered") in at
    assert at["c", "lost", "orphan"]["result"] == "x" and (None, "a", "orphan") in at
    none = chat_tools.link_tool_calls(calls.limit(0), results.limit(0), tools)
    assert none.collect() == []


def test_depth_of_a_long_chain(spark):
    n = 300
    calls = spark.range(n).selectExpr("'c' conv_id", "cast(id as string) call_id",
                                      "case when id > 0 then cast(id - 1 as string) end after")
    assert {int(r["call_id"]): r["depth"] for r in chat_tools.call_depths(calls, "conv_id").collect()} == {i: i for i in range(n)}


def test_calls_of_plain_conversations(spark):
    conv = spark.createDataFrame([(1, 0, "system", "be kind"), (1, 1, "user", "a b"), (1, 2, "assistant", "x"), (1, 3, "user", ""),
                                  (1, 4, "assistant", None), (2, 0, "user", None)], "conv_id long, turn int, role string, text string")
    got = {(r["conv_id"], r["call_id"]): r for r in
           chat_tools.link_tool_calls(*chat_tools.calls_of_turns(conv), chat_tools.TOOLS).collect()}
    assert len(got) == 4
    assert got[1, "call-1"]["status"] == "ok" and got[1, "call-1"]["depth"] == 1 and got[1, "call-3"]["depth"] == 2
    assert json.loads(got[1, "call-1"]["call_json"])["arguments"] == {"query": "a b", "words": 2, "turn": 1}
    assert got[1, "call-3"]["violations"] == "$.query: length; $.words: range"


# ------------------------------------------------------------- the pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    from cohortab.llm.common import stage
    from test_llm_text import brute_components, brute_fp, brute_quality, brute_repeats

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test tables not present")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "quality_classifier", "simhash_near_dedup", "suffix_array_dedup",
                                         "best_fit_packing"]
    for name, f in cp.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
        columns, given = docs.columns, docs
        docs = stage(f(spark, docs, sf), name)
        if name == "best_fit_packing":
            assert sum(r["size"] for r in docs.collect()) == sum(len(t[1].encode()) + 1 for t in before)
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r for r in docs.collect()}
        if name == "quality_rules":
            assert set(after) == {w[0] for w in brute_quality(before, quality_rules.LINE_LIMIT, quality_rules.MIN_LEFT_PERCENT)
                                  if w[8]}
        elif name == "simhash_near_dedup":
            fps = [brute_fp(t[1]) for t in before]
            links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
            assert set(after) == set(brute_components([t[0] for t in before], links))
        elif name == "suffix_array_dedup":
            want = {w[0]: w for w in brute_repeats(before)}
            assert set(after) == set(want)
            for i, r in after.items():
                text = r["text"].encode()
                assert len(text) <= want[i][1] - want[i][2]
                if len(text) == want[i][1] - want[i][2]:  # no character was cut through
                    assert hashlib.sha256(text).hexdigest() == want[i][4]
            assert sum(w[2] for w in want.values()) > 0
        else:
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            good = {r["doc_id"] for r in quality_model.quality_scores(given, labels).collect() if r["predicted"]}
            assert set(after) == good and 0 < len(good)
            assert all(after[t[0]]["text"] == t[1] for t in before if t[0] in good)
    assert cp.run(spark, sf).count() == docs.count()
