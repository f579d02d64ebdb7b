"""Language identification by word-first backoff.

A word that the training texts have is scored by its relative frequency in each
language; a word they do not have is scored by its character n-grams, the
longest length of which the training words have any, then the next shorter one.
A text's language is the one with the best sum over its words.

Scores are negative logarithms in whole millionths, so sums are exact and do
not depend on the order in which tasks add them. The word table grows with the
corpus and stays distributed: only words with a share of at least 1 /
``MAX_FREQUENT`` of all words (so at most that many) are sent to the tasks. The
others are looked up by a join on the word, once per slice of documents.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortab.llm.common import discard, stage

LONGEST = 5              # characters of the longest n-gram; a word is padded by a blank on either side
MAX_FREQUENT = 1 << 18
UNIT = 1_000_000         # scores are whole millionths of a decimal logarithm
FOLDS = 5                # fixed value of the contract: every fifth crc32 is held out
UNKNOWN = "und"
DIGITS = 9               # decimals of a score
_FLUSH = 1_000_000       # different words that a task holds before it hands them on
_SLICE_DOCS = 16_384     # documents of a slice, at most ...
_SLICE_WORDS = 500_000   # ... or until it has so many different rare words
_TOKENS = 1 << 20        # words looked up at a time
_PIECE = 1 << 22         # characters of a text taken at a time
_WORD = re.compile(r"[^\W\d_]+")


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == 0, F.lit(False))


def words_of(text: str | None):
    """The words (runs of letters, in lower case), a list for each piece of the text."""
    text, rest = text or "", ""
    for at in range(0, len(text), _PIECE):
        piece = rest + text[at:at + _PIECE]
        end = len(piece)
        if at + _PIECE < len(text):
            while end and piece[end - 1].isalpha():
                end -= 1
        yield _letters(_WORD.findall(piece[:end].lower()))
        rest = piece[end:]
    if rest:
        yield _letters(_WORD.findall(rest.lower()))


def _letters(runs: list[str]) -> list[str]:
    """Runs as they are, cut at numerals such as superscripts, which are no letters."""
    if "".join(runs).isalpha():
        return runs
    return [w for r in runs for w in ("".join(c if c.isalpha() else " " for c in r)).split()]


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


def _summed(counts: DataFrame, key: str, n_langs: int) -> DataFrame:
    """key, total, c: occurrences over all rows and per language (index -1: not to be learned from)."""
    per = [F.sum(F.when(F.col("li") == i, F.col("n")).otherwise(F.lit(0).cast("long"))) for i in range(n_langs)]
    return counts.groupBy(key).agg(F.sum("n").alias("total"), F.array(*per).alias("c"))


def word_table(texts: DataFrame, n_langs: int) -> DataFrame:
    """word, total, c of every word of the texts (t, li)."""
    def count(it):
        seen: dict[int, Counter] = {}
        for b in it:
            for t, li in zip(b["t"], b["li"]):
                own = seen.setdefault(li, Counter())
                for words in words_of(t):
                    own.update(words)  # a list: counted without a Python loop
                if sum(map(len, seen.values())) > _FLUSH:
                    yield from handed(seen)
                    seen = {}
        yield from handed(seen)

    def handed(seen):
        for li, words in seen.items():
            yield pd.DataFrame({"word": list(words), "li": np.int32(li), "n": np.fromiter(words.values(), np.int64, len(words))})

    return _summed(texts.select("t", "li").mapInPandas(count, "word string, li int, n long"), "word", n_langs)


class _Numbered(dict):
    """Numbers for keys, in the order of their first use."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n

    def of(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))


def gram_table(known: DataFrame, n: int, n_langs: int) -> DataFrame:
    """gram, total, c of the n-grams of the known words, each word counted as often as it occurs."""
    def count(it):
        for b in it:
            cut = [grams(w, n) for w in b["word"]]
            names = _Numbered()
            at = names.of([g for c in cut for g in c])
            word = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
            c = np.stack(b["c"].to_numpy()) if len(b) else np.zeros((0, n_langs), np.int64)
            per = np.stack([np.bincount(at, c[word, i], len(names)) for i in range(n_langs)], axis=1).astype(np.int64)
            row, li = np.nonzero(per)
            yield pd.DataFrame({"gram": np.array(list(names), dtype=object)[row], "li": li.astype(np.int32), "n": per[row, li]})

    return _summed(known.select("word", "c").mapInPandas(count, "gram string, li int, n long"), "gram", n_langs)


def scores(counts: Column, totals: list[int]) -> Column:
    """Per language -log10 of the relative frequency; unseen there: a tenth of one occurrence in the largest language."""
    worst = round((np.log10(max(totals)) + 1) * UNIT)
    per = [F.when(counts[i] > 0, F.round((F.lit(float(np.log10(t))) - F.log10(counts[i])) * UNIT)).otherwise(worst)
           .cast("int") if t else F.lit(worst) for i, t in enumerate(totals)]
    return F.array(*per)


def _totals(table: DataFrame, n_langs: int) -> list[int]:
    row = table.agg(*[F.sum(F.col("c")[i]).alias(f"n{i}") for i in range(n_langs)]).first()
    return [v or 0 for v in row]


def _backed_off(pending: DataFrame, known: DataFrame, n_langs: int):
    """Tables of (word, total, s) for the unseen words, one per n-gram length that scored any."""
    for n in range(LONGEST, 0, -1):
        model = stage(gram_table(known, n, n_langs), f"grams{n}")
        totals = _totals(model, n_langs)

        def cut(it, n=n):
            for b in it:
                for at in range(0, len(b), 4096):
                    rows = [(w, t, g) for w, t in zip(b["word"][at:at + 4096], b["total"][at:at + 4096]) for g in grams(w, n)]
                    yield pd.DataFrame(rows, columns=["word", "total", "gram"])

        parts = pending.mapInPandas(cut, "word string, total long, gram string")
        one = model.select("gram", scores(F.col("c"), totals).alias("g"))
        mean = F.array(*[F.round(F.avg(F.col("g")[i])).cast("int") for i in range(n_langs)])
        yield (found := stage(parts.join(one, "gram").groupBy("word", "total").agg(mean.alias("s")), "scored"))
        left = stage(pending.join(found.select("word"), "word", "left_anti"), "pending")
        discard(model)
        discard(pending)
        pending = left
        if pending.isEmpty():
            break
    discard(pending)


def word_scores(table: DataFrame, n_langs: int, totals: list[int]) -> DataFrame:
    """word, total, s: the scores of every word; words without any known n-gram are absent."""
    known = table.where(F.exists("c", lambda x: x > 0))
    parts = [known.select("word", "total", scores(F.col("c"), totals).alias("s"))]
    pending = stage(table.where(~F.exists("c", lambda x: x > 0)).select("word", "total"), "pending")
    if not pending.isEmpty():
        parts += list(_backed_off(pending, known, n_langs))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = stage(out, "word-scores")
    for p in parts[1:]:
        discard(p)
    return out


def _sliced(texts: DataFrame, frequent: dict, n_langs: int) -> DataFrame:
    """Slices of documents: a row per document, and one with the slice's rare words, which documents name by place.

    ``base`` sums the scores of the frequent words and ``n`` counts them;
    ``place`` has an entry for every occurrence of a rare word.
    """
    kind = texts.schema["id"].dataType.simpleString()
    send = texts.sparkSession.sparkContext.broadcast(frequent)
    columns = ["slice", "id", "letters", "n", "base", "place", "words"]

    def looked_up(number, size, matrix, lists):
        """Per text: number of words, of frequent ones, their summed scores, places of the rare ones."""
        found = number.of([w for words in lists for w in words])
        doc = np.repeat(np.arange(len(lists)), [len(words) for words in lists])
        often = found < size
        base = np.stack([np.bincount(doc[often], matrix[found[often], i], len(lists)) for i in range(n_langs)], axis=1)
        order = np.lexsort((found[~often], doc[~often]))
        ends = np.cumsum(np.bincount(doc[~often], minlength=len(lists)))
        places = np.split((found[~often] - size)[order].astype(np.int32), ends[:-1])
        return (np.bincount(doc, minlength=len(lists)), np.bincount(doc[often], minlength=len(lists)),
                base.astype(np.int64), places)

    def deal(it):
        words, matrix = send.value["words"], send.value["scores"]
        size = len(words)
        number = _Numbered(zip(words, range(size)))
        slice_id, held = TaskContext.get().partitionId() << 32, 0

        def rows_of(ids, lists, of):
            n_all, n, base, places = looked_up(number, size, matrix, lists)
            if len(set(of)) < len(of):  # texts that came in several pieces
                parts = pd.DataFrame({"of": of, "a": n_all, "n": n}).groupby("of").sum()
                whole = [[np.concatenate([p for p, o in zip(places, of) if o == k]), base[np.array(of) == k].sum(0)]
                         for k in parts.index]
                n_all, n = parts["a"].to_numpy(), parts["n"].to_numpy()
                places, base = [w[0] for w in whole], [w[1] for w in whole]
            return pd.DataFrame({"slice": slice_id, "id": ids, "letters": n_all > 0, "n": n, "base": list(base),
                                 "place": places, "words": pd.Series([None] * len(ids), dtype=object)}, columns=columns)

        def dictionary():
            rare = list(number)[size:]
            for w in rare:
                del number[w]
            return pd.DataFrame([(slice_id, None, None, None, None, None, rare)], columns=columns)

        for b in it:
            ids, lists, of, tokens = [], [], [], 0
            for i, t in zip(b["id"], b["t"]):
                for words in words_of(t):
                    lists.append(words)
                    of.append(len(ids))
                    tokens += len(words)
                if not of or of[-1] < len(ids):
                    lists.append([])
                    of.append(len(ids))
                ids.append(i)
                held += 1
                full = held >= _SLICE_DOCS or len(number) - size >= _SLICE_WORDS
                if tokens >= _TOKENS or full:
                    yield rows_of(ids, lists, of)
                    ids, lists, of, tokens = [], [], [], 0
                    if full:
                        yield dictionary()
                        slice_id, held = slice_id + 1, 0
            if ids:
                yield rows_of(ids, lists, of)
        if held:
            yield dictionary()

    return texts.select("id", "t").mapInPandas(
        deal, f"slice long, id {kind}, letters boolean, n long, base array<long>, place array<int>, words array<string>")


def _judge(langs: list[str], totals: list[int]):
    usual = max(range(len(langs)), key=lambda i: (totals[i], -i))

    def judge(key, docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        size = int(found["pos"].max()) + 1 if len(found) else 0
        matrix, known = np.zeros((size + 1, len(langs)), np.int64), np.zeros(size + 1, np.int64)
        if len(found):
            matrix[found["pos"]] = np.stack(found["s"].to_numpy())
            known[found["pos"]] = 1
        preds, out = [], []
        for letters, n, base, place in zip(docs["letters"], docs["n"], docs["base"], docs["place"]):
            at = np.minimum(place, size)  # words without a score end at the last, empty row
            n, total = n + int(known[at].sum()), base + matrix[at].sum(0)
            if not letters:
                preds.append(UNKNOWN)
                out.append(0.0)
            elif not n:
                preds.append(langs[usual])
                out.append(1.0 / len(langs))
            else:
                best = int(total.argmin())  # the first of equal ones
                preds.append(langs[best])
                out.append(float(1.0 / (10.0 ** ((total[best] - total) / (n * float(UNIT)))).sum()))
        return pd.DataFrame({"id": docs["id"], "lang_pred": preds, "score": out})

    return judge


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, held_out, lang_pred, score.

    Learned from the rows with a language whose crc32 of the id as text is not
    divisible by 5; every row is predicted, from its text alone. ``score`` is
    the share of the predicted language when each language weighs 10 to the
    mean word score. Equal scores go to the language first in code-point order.

    Defined results: a null text, or one without a letter, is ``und`` with score
    0; so is every text if there is nothing to learn from; letters of which no
    n-gram is known give the language with the most training words and an equal
    share; rows with a null id are predicted but never learned from, and not
    held out; repeated rows count again and get equal results; an empty table
    gives an empty one; other columns are not read. Memory per task grows with
    the number of different languages, which the driver holds.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    learn = F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.withColumn("lang", F.when(learn & F.col("t").isNotNull(), F.col("lang")))
    langs = sorted(r[0] for r in rows.where("lang IS NOT NULL").select("lang").distinct().collect())  # the labels
    number = F.create_map(*[F.lit(x) for i, v in enumerate(langs) for x in (v, i)])[F.col("lang")] if langs else F.lit(-1)
    texts = rows.withColumn("li", F.coalesce(number, F.lit(-1)))
    totals, table = [], None
    if langs:
        table = stage(word_table(texts, len(langs)), "words")
        totals = _totals(table, len(langs))
    if not any(totals):
        return docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"),
                           F.lit(0.0).alias("score"))
    scored = word_scores(table, len(langs), totals)
    every = table.agg(F.sum("total")).first()[0]
    discard(table)
    top = scored.where(F.col("total") * MAX_FREQUENT >= every).select("word", "s").collect()  # at most MAX_FREQUENT
    frequent = {"words": [r["word"] for r in top],
                "scores": np.array([r["s"] for r in top], dtype=np.int64).reshape(-1, len(langs))}
    slices = stage(_sliced(texts, frequent, len(langs)), "slices")
    rare = slices.where("words IS NOT NULL").select(F.col("slice").alias("of"), F.posexplode("words").alias("pos", "word"))
    found = rare.join(scored.select("word", "s"), "word").select("of", "pos", "s")
    docs_of = slices.where("words IS NULL").select("slice", "id", "letters", "n", "base", "place")
    judged = docs_of.groupBy("slice").cogroup(found.groupBy("of")).applyInPandas(
        _judge(langs, totals), f"id {id_type}, lang_pred string, score double")
    return judged.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred",
                         F.round("score", DIGITS).alias("score"))
