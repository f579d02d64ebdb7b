"""Tool-call linking for chat data.

Calls and results meet in a hash join on conversation and call id; calls are
put in topological order of what they build on; their arguments are validated
against the tools' schemas; each call is written as canonical JSON (sorted
keys, no white space, shortest numbers).
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortab.llm.common import stage
from cohortab.operators.ranking import running_total

MAX_ROUNDS = 64  # pointers double every round: depths to 2 ** 63

_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value) -> str:
    """JSON with sorted keys, no white space and plain UTF-8; a whole float is written as an integer."""

    def plain(v):
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 1 << 53 else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _is(value, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "number":
        return number
    if kind == "integer":
        return number and (isinstance(value, int) or value.is_integer())
    return isinstance(value, _TYPES.get(kind, object))


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """Where ``value`` breaks the schema: type, enum, required, properties, additionalProperties, items, bounds."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {'/'.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    elif isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: length")
    elif _is(value, "number"):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{at}: range")
    return out


def _no_constant(name):
    raise ValueError(name)


def _checked(tools: dict[str, dict]):
    """Per row: the canonical call, and what is wrong with its arguments."""

    def run(it):
        for b in it:
            call, wrong = [], []
            for name, ident, arguments in zip(b["name"].to_pylist(), b["call_id"].to_pylist(), b["arguments"].to_pylist()):
                try:
                    value = json.loads(arguments if arguments is not None else "{}", parse_constant=_no_constant)
                    text = canonical({"arguments": value, "id": ident, "name": name})
                    text.encode()
                    why = "; ".join(violations(value, tools[name])) if name in tools else "unknown tool"
                except UnicodeEncodeError:  # an escape such as \ud800 alone is no character
                    text, why = None, "not Unicode"
                except (ValueError, RecursionError):
                    text, why = None, "not JSON"
                call.append(text)
                wrong.append(why)
            cols = [b[c] for c in b.schema.names if c != "arguments"]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(call, pa.string()), pa.array(wrong, pa.string())],
                names=[*(c for c in b.schema.names if c != "arguments"), "call_json", "violations"])

    return run


def call_depths(calls: DataFrame, conv_col: str) -> DataFrame:
    """(conversation, call_id, depth): how many calls a call builds on, one after the other; null on a cycle.

    Pointers to the call built on are doubled every round, so a chain of n
    calls takes about log2(n) joins, and no conversation is gathered in one task.
    """
    cur = stage(calls.select(conv_col, "call_id", F.col("after").alias("to"),
                             F.when(F.col("after").isNull(), 0).otherwise(1).cast("long").alias("depth")), "depths")
    n = cur.count()
    for _ in range(MAX_ROUNDS):
        left = cur.where("`to` IS NOT NULL").agg(F.count("*").alias("n"), F.max("depth").alias("far")).first()
        if left["n"] == 0:
            break
        if left["far"] > n:  # longer than any path without a cycle
            break
        up = cur.select(conv_col, F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"))
        cur = stage(cur.join(up, [conv_col, "to"], "left").select(
            conv_col, "call_id", F.col("next").alias("to"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "depths")
    return cur.select(conv_col, "call_id", F.when(F.col("to").isNull(), F.col("depth")).alias("depth"))


def link_tool_calls(calls: DataFrame, results: DataFrame, tools: dict[str, dict], conv_col: str = "conv_id") -> DataFrame:
    """One row per call, and one per result without a call.

    ``calls``: conversation, call_id, turn, name, arguments (JSON text), after
    (the call id whose result it builds on, or null). ``results``:
    conversation, call_id, turn, content. Returns conversation, call_id, name,
    call_turn, result_turn, result (text), depth, position, call_json (canonical;
    null where the arguments are not JSON), violations (empty: valid), status.

    depth is the topological level; position numbers the rows of a conversation
    from 1 by (depth, call_turn, call_id), those without a depth and then
    results without a call last, so every call follows the one it builds on.
    status: ok, unanswered, early (a result before its call), orphan (a result
    without call), dangling (builds on a call that does not exist), cycle.

    Defined results: a null call id or conversation links with nothing: such a
    call is unanswered, such a result an orphan, and rows without a conversation
    are numbered as one; null arguments are ``{}``; arguments that are no JSON,
    or hold an escape that is no character, have no call_json and say so in
    violations; integers are exact at any size up to Python's 4,300 digits
    (beyond: not JSON); of repeated calls or results with one id the first by
    turn stands; empty tables give empty ones; further columns are not read.
    """
    def first(df, *cols):
        named = df.where(F.col(conv_col).isNotNull() & F.col("call_id").isNotNull())
        pick = F.min(F.struct("turn", *cols)).alias("p")
        return named.groupBy(conv_col, "call_id").agg(pick).select(conv_col, "call_id", "p.*")

    loose = calls.where(F.col(conv_col).isNull() | F.col("call_id").isNull()).select(
        conv_col, "call_id", "turn", "name", "arguments", "after")
    one = first(calls, "name", "arguments", "after")
    every = stage(one.unionByName(loose), "calls")
    ids = every.select(F.col(conv_col).alias("kc"), F.col("call_id").alias("ki")).where("ki IS NOT NULL")
    known = every.join(ids, (F.col(conv_col) == F.col("kc")) & (F.col("after") == F.col("ki")), "left")
    known = stage(known.withColumn("dangling", F.col("after").isNotNull() & F.col("ki").isNull()).drop("kc", "ki"), "calls")
    depth = call_depths(known.where("call_id IS NOT NULL").where(F.col(conv_col).isNotNull())
                        .withColumn("after", F.when(~F.col("dangling"), F.col("after"))), conv_col)
    answers = first(results, "content").select(conv_col, "call_id", F.col("turn").alias("result_turn"),
                                               F.col("content").alias("result"))
    linked = known.join(answers, [conv_col, "call_id"], "left").join(depth, [conv_col, "call_id"], "left")
    cols = [conv_col, "call_id", "name", "turn", "result_turn", "result", "depth", "dangling", "arguments"]
    types = {f.name: f.dataType.simpleString() for f in linked.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in cols[:-1]) + ", call_json string, violations string"
    checked = linked.select(*cols).mapInArrow(_checked(tools), schema)
    status = (F.when(F.col("call_id").isNull() | F.col(conv_col).isNull(), "unanswered")
              .when(F.col("dangling"), "dangling").when(F.col("depth").isNull(), "cycle")
              .when(F.col("result_turn").isNull(), "unanswered")
              .when(F.col("result_turn") <= F.col("turn"), "early").otherwise("ok"))
    calls_out = checked.select(conv_col, "call_id", "name", F.col("turn").alias("call_turn"), "result_turn", "result",
                               "depth", "call_json", "violations", status.alias("status"))
    none = [F.lit(None).cast(types[c]).alias(n) for c, n in (("name", "name"), ("turn", "call_turn"))]
    lone = results.join(every.select(conv_col, "call_id"), [conv_col, "call_id"], "leftanti")
    orphans = lone.select(conv_col, "call_id", *none, F.col("turn").alias("result_turn"), F.col("content").alias("result"),
                          F.lit(None).cast("long").alias("depth"), F.lit(None).cast("string").alias("call_json"),
                          F.lit("").alias("violations"), F.lit("orphan").alias("status"))
    rows = stage(calls_out.unionByName(orphans).withColumn("__row", F.monotonically_increasing_id()), "linked")
    order = ["depth", "call_turn", "call_id", "result_turn", "__row"]
    narrow = rows.select(conv_col, *order, F.col("call_turn").isNull().alias("__late"))  # texts stay where they are
    numbered = running_total(narrow, [conv_col], [F.col("__late").asc(), *[F.col(c).asc_nulls_last() for c in order]],
                             name="position").select("__row", "position")
    return rows.join(numbered, "__row").select(
        conv_col, "call_id", "name", "call_turn", "result_turn", "result", "depth", "position", "call_json", "violations", "status")


# ------------------------------------------------------------- calls in plain conversations

TOOLS = {
    "answer": {"type": "object", "required": ["query", "words"], "additionalProperties": False,
               "properties": {"query": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 1},
                              "turn": {"type": "integer", "minimum": 0}}},
    "configure": {"type": "object", "required": ["prompt"], "additionalProperties": False,
                  "properties": {"prompt": {"type": "string", "maxLength": 400}, "turn": {"type": "integer", "minimum": 0}}},
}


def calls_of_turns(conv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that plain conversations contain.

    Every user turn is a call of ``answer`` and every system turn one of
    ``configure``, named by its turn; an assistant or tool turn is the result of
    the turn before it. A user turn after the first builds on the call two turns
    before it, or on the one before where that is a system turn. A turn with
    another role or none is a result that names no call; of a repeated turn
    ``link_tool_calls`` keeps the first.
    """
    t = conv.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    name = F.when(F.col("role") == "user", "answer").when(F.col("role") == "system", "configure")
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    user = F.to_json(F.struct(words.cast("long").alias("words"), F.coalesce("text", F.lit("")).alias("query"), "turn"))
    system = F.to_json(F.struct("turn", F.coalesce("text", F.lit("")).alias("prompt")))
    ident = F.concat(F.lit("call-"), F.col("turn").cast("string"))
    calls = (t.where("role IN ('user', 'system')")
             .select("conv_id", "turn", ident.alias("call_id"), name.alias("name"),
                     F.when(F.col("role") == "user", user).otherwise(system).alias("arguments")))
    first = calls.groupBy("conv_id", "turn").agg(F.min("name").alias("n"))
    before = first.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("n").alias("one"))
    two = first.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("n").alias("two"))
    after = F.when(F.col("one") == "configure", F.concat(F.lit("call-"), (F.col("turn") - 1).cast("string"))).when(
        F.col("two").isNotNull(), F.concat(F.lit("call-"), (F.col("turn") - 2).cast("string")))
    calls = (calls.join(before, ["conv_id", "turn"], "left").join(two, ["conv_id", "turn"], "left")
             .withColumn("after", after).drop("one", "two"))
    of = F.when(F.col("role").isin("assistant", "tool"), F.concat(F.lit("call-"), (F.col("turn") - 1).cast("string")))
    results = t.where("coalesce(role, '') NOT IN ('user', 'system')").select(
        "conv_id", "turn", of.alias("call_id"), F.col("text").alias("content"))
    return calls, results
