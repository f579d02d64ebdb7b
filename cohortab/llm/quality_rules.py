"""Quality rules: counts per document, and line frequency across the documents of a host.

All in DataFrame expressions. One pass over the texts writes a narrow staged
table (counts and one hash per line); the cross-document part works on that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortab.llm.common import stage, text_or_empty

SYMBOLS = "#*$%&|<>"  # fixed value of the contract
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
LINE_LIMIT = 10         # a line in more documents of a host than this is boilerplate, however large the host
MIN_LEFT_PERCENT = 70   # fewer words left than this: the document is depleted

_WS_RE = "[\\\\x20\\\\x09-\\\\x0D]+"
_WS_SQL = "' \\t\\n\\u000b\\u000c\\r'"
_POS_BITS = 24          # a window's place and 40 bits of its hash share a long, where that decides
_POS = (1 << _POS_BITS) - 1


def _let(value: str, name: str, body: str) -> str:
    """SQL text binding ``value`` once as a lambda variable."""
    return f"transform(array({value}), {name} -> {body})[0]"


def words_sql(text: str) -> str:
    """Array of the words of a text (no empty entries)."""
    trimmed = f"trim(BOTH {_WS_SQL} FROM {text})"
    return _let(trimmed, "tt", f"IF(tt = '', array(), split(tt, '{_WS_RE}'))")


def repeat_words_sql(words: str) -> str:
    """Words covered by 3-word windows whose three words occur twice or more.

    Windows are hashed and sorted by (hash, place), so equal ones stand side by
    side. Sorting longs of 40 hash bits and 24 place bits is faster, and does
    unless two different hashes share those bits or a place needs more.
    """
    covered = ("aggregate(transform(pp, (x, i) -> IF(get(pp, i + 1) IS NULL, 3L, least(3L, get(pp, i + 1) - x))), "
               "0L, (a, x) -> a + x)")
    same = "get(hh, CAST(x & {m} AS INT)) = get(hh, CAST(get(ss, j {d} 1) & {m} AS INT))"
    short = (f"filter(transform(ss, (x, j) -> IF(({same.format(m=_POS, d='-')}) IS TRUE OR "
             f"({same.format(m=_POS, d='+')}) IS TRUE, x & {_POS}L, -1L)), v -> v >= 0)")
    mixed = (f"exists(transform(ss, (x, j) -> shiftright(x, {_POS_BITS}) = shiftright(get(ss, j + 1), {_POS_BITS}) "
             f"AND get(hh, CAST(x & {_POS} AS INT)) <> get(hh, CAST(get(ss, j + 1) & {_POS} AS INT))), v -> v)")
    full = _let("sort_array(transform(hh, (h, i) -> named_struct('h', h, 'i', CAST(i AS BIGINT))))", "tt",
                "filter(transform(tt, (x, j) -> IF((x.h = get(tt, j - 1).h) IS TRUE OR (x.h = get(tt, j + 1).h) IS TRUE, "
                "x.i, -1L)), v -> v >= 0)")
    packed = f"sort_array(transform(hh, (h, i) -> (h & {~_POS}L) | CAST(i AS BIGINT)))"
    hashes = "transform(sequence(0, size(ww) - 3), i -> xxhash64(get(ww, i), get(ww, i + 1), get(ww, i + 2)))"
    places = f"IF(size(hh) > {_POS}, {full}, {_let(packed, 'ss', f'IF({mixed}, {full}, {short})')})"
    inner = _let(hashes, "hh", _let(f"sort_array({places})", "pp", covered))
    return _let(words, "ww", f"IF(size(ww) < 3, 0L, {inner})")


def document_counts(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One narrow row per document: id, host, digest of the text, counts, and (hash, words) per line with a word."""
    t = docs.select(F.col(id_col).alias("id"),
                    F.coalesce(F.concat(F.lit("h"), F.col(host_col).cast("string")), F.lit("n")).alias("host"),
                    text_or_empty(F.col(text_col)).alias("t"))
    line = f"trim(BOTH {_WS_SQL} FROM l)"
    with_word = f"filter(split(t, '\\n'), l -> {line} <> '')"
    lines = (f"transform({with_word}, l -> named_struct("
             f"'h', xxhash64(lower(regexp_replace({line}, '{_WS_RE}', ' '))), "
             f"'w', size(split({line}, '{_WS_RE}'))))")
    counts = _let(words_sql("t"), "w", f"named_struct('n', size(w), 'r', {repeat_words_sql('w')})")
    return (t.select(
        "id", "host", F.xxhash64("t").alias("digest"), F.expr(counts).alias("c"),
        F.expr(f"CAST(char_length(translate(t, {_WS_SQL}, '')) AS BIGINT)").alias("word_chars"),
        F.expr(f"CAST(char_length(t) - char_length(translate(t, '{SYMBOLS}', '')) AS BIGINT)").alias("n_symbols"),
        F.expr(_let(with_word, "k", "CAST(size(k) - size(array_distinct(k)) AS BIGINT)")).alias("n_dup_lines"),
        F.expr(lines).alias("lines"))
        .select("id", "host", "digest", F.col("c.n").cast("long").alias("n_words"), "word_chars", "n_symbols",
                "n_dup_lines", F.col("c.r").cast("long").alias("n_repeat_words"), "lines"))


def frequent_lines(counts: DataFrame, limit: int = LINE_LIMIT) -> DataFrame:
    """(host, h, first): lines in more than ``limit`` different documents (ids) of a host.

    ``first`` is the smallest id having the line; rows without an id count as one document.
    """
    own = counts.select("id", "host", F.explode(F.array_distinct(F.transform("lines", lambda l: l["h"]))).alias("h"))
    return (own.groupBy("host", "h", "id").agg(F.lit(1))
            .groupBy("host", "h").agg(F.count("*").alias("n"), F.min("id").alias("first"))
            .where(F.col("n") > limit).select("host", "h", "first"))


def base_failed() -> Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  limit: int = LINE_LIMIT, min_left_percent: int = MIN_LEFT_PERCENT) -> DataFrame:
    """Counts and verdict per row of ``docs``.

    Returns the id column, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, words_left, kept, and the keys ``digest``
    (xxhash64 of the text) and ``gone`` (hashes of its removed lines).

    A normalised line (lower case, white space collapsed) found in more than
    ``limit`` different documents (ids) of its host is removed from every one
    but that with the smallest id, so its content is not lost: of a large group
    of copies the first stays. A document is rejected when it fails a base rule
    or keeps less than ``min_left_percent`` of its words. The limit is a number,
    so a line's fate does not turn on how many other documents the host has.

    Defined results: a null text is an empty one (n_words 0, base rule fails);
    a null host is a host of its own; rows with a null id count as one document
    of their host, are judged like others, and never own a line while another
    row has it; repeated rows are one document and get equal results; an empty
    table gives an empty one; other columns are not read.
    """
    counts = stage(document_counts(docs, id_col, text_col, host_col), "quality")
    key = ["id", "host", "digest"]
    over = frequent_lines(counts, limit)
    gone = (counts.select(*key, F.explode("lines").alias("l")).select(*key, F.col("l.h").alias("h"))
            .join(over, ["host", "h"]).where(~F.col("id").eqNullSafe(F.col("first")))
            .groupBy(*key).agg(F.collect_set("h").alias("gone")))
    g = gone.select(F.col("id").alias("gid"), F.col("host").alias("ghost"), F.col("digest").alias("gdigest"), "gone")
    joined = counts.join(g, counts["id"].eqNullSafe(g["gid"]) & (counts["host"] == g["ghost"])
                         & (counts["digest"] == g["gdigest"]), "left")
    left = F.expr("IF(gone IS NULL, n_words, aggregate(lines, 0L, (a, l) -> a + IF(array_contains(gone, l.h), 0, l.w)))")
    return (joined.withColumn("words_left", left).withColumn("base_failed", base_failed())
            .select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "words_left",
                    (~F.col("base_failed") & (100 * F.col("words_left") >= min_left_percent * F.col("n_words")))
                    .alias("kept"), "host", "digest", "gone"))


def apply_quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        host_col: str = "source", **kw) -> DataFrame:
    """The documents that pass, without their removed lines (``n_chars`` follows the text where present).

    Same rows and columns as ``docs`` otherwise; rows are matched on id, host
    and text, so repeated rows stay or go together. Null texts and the other
    cases are judged as in ``quality_rules``; columns of any other name pass.
    """
    v = quality_rules(docs, id_col, text_col, host_col, **kw).where("kept")
    v = v.select(F.col(id_col).alias("__id"), F.col("host").alias("__host"), F.col("digest").alias("__digest"),
                 F.col("gone").alias("__gone")).dropDuplicates(["__id", "__host", "__digest"])
    host = F.coalesce(F.concat(F.lit("h"), docs[host_col].cast("string")), F.lit("n"))
    rows = docs.join(v, docs[id_col].eqNullSafe(v["__id"]) & (host == v["__host"])
                     & (F.xxhash64(text_or_empty(docs[text_col])) == v["__digest"]))
    line = f"trim(BOTH {_WS_SQL} FROM l)"
    stay = (f"array_join(filter(split(`{text_col}`, '\\n'), l -> NOT array_contains(__gone, "
            f"xxhash64(lower(regexp_replace({line}, '{_WS_RE}', ' '))))), '\\n')")
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.expr(stay))
    cols = [text.alias(c) if c == text_col
            else F.when(F.col("__gone").isNull(), docs[c]).otherwise(F.char_length(text)).cast(docs.schema[c].dataType)
            .alias(c) if c == "n_chars" else docs[c] for c in docs.columns]
    return rows.select(*cols)
