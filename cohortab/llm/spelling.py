"""Spelling variants: words one edit apart, found by asymmetric q-chunks.

Of two words one gives two disjoint chunks, each half of it, and the other its
positional grams of that length. One edit touches at most one of the chunks,
so the other stands in the second word at most one place further; the sign of
the shift follows from the lengths: none where they are equal, none before the
inserted code point and one after it. Words that agree in a chunk differ by the
same edit in what is left of them, so the rule is applied to that again until
few code points are open. A key then fixes almost the whole word, few words can
share one, and joined candidates are verified on the open part.
"""

from __future__ import annotations

import zlib
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortab.llm.common import discard, stage

MIN_LENGTH = 5
MIN_COUNT = 3
LEAD = 2           # a form occurs at least this many times as often
TYPO_MODULUS = 97  # fixed values of the contract
OPEN = 3           # a word is cut until at most this many code points are open ...
LEVELS = 4         # ... or so often; what is left of longer words is an eighth of them or less
_FLUSH = 200_000   # different words that a task counts before it hands them on
_PIECE = 1 << 22   # characters of a text taken at a time
_MARK = "|"        # stands where a chunk was taken out

# Latin-1 bytes: letters stay (A-Z in lower case), all others become a space
_LETTERS = bytes((b + 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0 else 32
                 for b in range(256))


def _runs(text: str):
    """Counts of the maximal runs of letters, A-Z in lower case, as Latin-1 bytes, a piece of the text at a time."""
    rest = b""
    for at in range(0, len(text), _PIECE):
        flat = rest + text[at:at + _PIECE].encode("latin-1", "replace").translate(_LETTERS)
        cut = len(flat)
        if at + _PIECE < len(text):
            cut = flat.rfind(b" ") + 1
        yield Counter(flat[:cut].split())
        rest = flat[cut:]
    if rest:
        yield Counter(rest.split())


def mistyped(doc: str, run: str) -> str:
    """The run, or where the hash of document and run asks for it, the run without one code point."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % TYPO_MODULUS:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def word_counts(docs: DataFrame, id_col: str, text_col: str, min_length: int = MIN_LENGTH) -> DataFrame:
    """word, n: the words of at least ``min_length`` code points over all documents."""
    def count(it):
        seen: Counter = Counter()
        for b in it:
            for doc, text in zip(b["id"], b["t"]):
                first = zlib.crc32(f"{doc}:".encode())
                for runs in _runs(text):
                    for run, n in runs.items():
                        if len(run) < min_length:
                            continue
                        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), first)
                        if h % TYPO_MODULUS == 0:
                            k = h % len(run)
                            run = run[:k] + run[k + 1:]
                            if len(run) < min_length:
                                continue
                        seen[run] += n
                if len(seen) > _FLUSH:
                    yield handed(seen)
                    seen = Counter()
        yield handed(seen)

    def handed(seen):
        return pd.DataFrame({"word": [w.decode("latin-1") for w in seen], "n": list(seen.values())},
                            columns=["word", "n"]).astype({"word": object, "n": "int64"})

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("t")).where("t <> ''")
    return texts.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def keys(word: str, longer: int):
    """(key, open part) of a word: as the chunk side (``longer`` 0), or as the side with one code point more (1).

    Two words one edit apart share a key in which their open parts are one
    edit apart, and words with such a key are one edit apart.
    """
    cut, left_open = [(f"{len(word) - longer}", word)], len(word) - longer
    for _ in range(LEVELS):
        if left_open <= OPEN:
            break
        deeper = []
        for key, left in cut:
            q = (len(left) - longer) // 2
            deeper.append((f"{key}0{left[:q]}", left[q:]))
            deeper.append((f"{key}1{left[q + longer:2 * q + longer]}", left[:q + longer] + _MARK + left[2 * q + longer:]))
        cut, left_open = deeper, left_open - left_open // 2
    return cut


def _keyed(words: DataFrame, longer: int) -> DataFrame:
    """key, open, wid: the keys of every word in one of the two roles."""
    def cut(it):
        for b in it:
            for at in range(0, len(b), 1000):
                part = b.iloc[at:at + 1000]
                rows = [(k, o, w) for w, word in zip(part["wid"], part["word"]) for k, o in keys(word, longer)]
                yield pd.DataFrame(rows, columns=["key", "open", "wid"])

    return words.select("wid", "word").mapInPandas(cut, "key string, open string, wid long")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: the wids of words exactly one inserted, deleted or replaced code point apart, each pair once."""
    chunks = _keyed(words, 0)
    x = chunks.select("key", F.col("open").alias("x"), F.col("wid").alias("a"))
    grams = (chunks.withColumn("same", F.lit(True))
             .unionByName(_keyed(words, 1).withColumn("same", F.lit(False)))
             .select("key", F.col("open").alias("y"), F.col("wid").alias("b"), "same"))
    near = x.join(grams, "key").where("(NOT same OR a < b) AND levenshtein(x, y, 1) = 1")
    return near.select("a", "b").distinct()


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, lead: int = LEAD) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    Words are the maximal runs of Latin letters (A-Z in lower case) of all
    texts; where 97 divides the crc32 of "<id>:<run>", one code point of the run
    is deleted. Kept are words of at least ``min_length`` code points and
    ``min_count`` occurrences. Words exactly one edit apart are near. A word's
    form is its most frequent near word (ties: the first in code-point order) if
    it occurs at least ``lead`` times as often; its root is the end of the chain of forms.

    Defined results: a null or empty text has no words; a null id hashes as an
    empty one; repeated rows count again; texts and words of any length are
    taken whole; a table without words gives an empty one; other columns are
    not read.
    """
    counts = word_counts(docs, id_col, text_col, min_length).where(F.col("n") >= min_count)
    words = stage(counts.withColumn("wid", F.monotonically_increasing_id()), "words")
    pairs = stage(near_pairs(words), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("wid").alias("b"), F.struct((-F.col("n")).alias("m"), "word", "wid").alias("o"))
    best = both.join(other, "b").groupBy(F.col("a").alias("wid")).agg(F.count("*").alias("n_near"), F.min("o").alias("o"))
    named = words.join(best, "wid", "left").withColumn("leads", -F.col("o.m") >= lead * F.col("n"))
    named = stage(named.select("wid", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                               F.expr("IF(leads, o.word, NULL)").alias("form"),
                               F.expr("IF(leads, o.wid, NULL)").alias("form_wid"),
                               F.expr("IF(leads, -o.m, NULL)").alias("form_n")), "forms")
    discard(pairs)
    discard(words)
    # every step up multiplies n by ``lead``: chains are short, and each round doubles what a row has followed
    up = stage(named.where("form_wid IS NOT NULL").select("wid", F.col("form_wid").alias("top"), F.col("form").alias("root")), "up")
    while True:
        above = up.select(F.col("wid").alias("top"), F.col("top").alias("top2"), F.col("root").alias("root2"))
        step = up.join(above, "top", "left")
        if step.where("top2 IS NOT NULL").isEmpty():
            break
        following = stage(step.select("wid", F.coalesce("top2", "top").alias("top"),
                                      F.coalesce("root2", "root").alias("root")), "up")
        discard(up)
        up = following
    return (named.join(up.select("wid", "root"), "wid", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.col("n_near").cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n")))
