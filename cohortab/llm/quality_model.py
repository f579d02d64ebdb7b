"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded by a small network
over the frequencies of its characters and character pairs and over how often
it repeats words; a gated attention layer learns, from document labels alone, how much each passage counts; the
weighted passage representation gives the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortab.llm.common import text_or_empty

PASSAGE = 512             # bytes of a passage
HIDDEN, GATE = 24, 12
SAMPLE_PER_CLASS = 1_500  # documented bound of the training sample, by the order of a hash of the id
SAMPLE_PASSAGES = 64      # of a training document, evenly spread; scoring takes every passage
EPOCHS, RATE, SEED = 30, 0.01, 7
THRESHOLD = 0.3           # fixed value of the contract
_SLICE = 1 << 22
_SECTION = 1 << 20        # bytes of a text encoded at a time; pairs and words do not reach across sections


def _char_classes() -> np.ndarray:
    """Class of each byte: letters by kind, digits, white space, and each ASCII mark on its own."""
    table = np.zeros(256, dtype=np.int64)
    for lo, hi, c in ((97, 122, 1), (65, 90, 2), (48, 57, 3), (128, 255, 4)):
        table[lo:hi + 1] = c
    for c, b in enumerate(b" \n", start=5):
        table[b] = c
    for b in (9, 11, 12, 13):
        table[b] = 6
    marks = [b for b in range(33, 127) if table[b] == 0]
    table[marks] = 7 + np.arange(len(marks)) % 17
    return table


CLASSES = _char_classes()
N_CLASSES = 24
N_FEATURES = N_CLASSES * N_CLASSES + N_CLASSES + 3


def passage_features(data: bytes) -> np.ndarray:
    """One row per passage of ``data``: square roots of class and class-pair frequencies, the length, the share
    of words that equal the word before, and the share of repeated words."""
    n = max(1, -(-len(data) // PASSAGE))
    c = CLASSES[np.frombuffer(data, dtype=np.uint8)]
    which = np.arange(len(c)) // PASSAGE
    out = np.zeros((n, N_FEATURES), dtype=np.float32)
    size = np.maximum(np.bincount(which, minlength=n), 1)[:, None]
    one = np.bincount(which * N_CLASSES + c, minlength=n * N_CLASSES).reshape(n, -1)
    out[:, :N_CLASSES] = np.sqrt(one / size)
    if len(c) > 1:
        pair = np.bincount((which[1:] * N_CLASSES + c[:-1]) * N_CLASSES + c[1:], minlength=n * N_CLASSES ** 2)
        out[:, N_CLASSES:-3] = np.sqrt(pair.reshape(n, -1) / size)
    out[:, -1] = np.minimum(size[:, 0], PASSAGE) / PASSAGE if len(c) else 0
    words = data.split()
    if words:
        space = (c == CLASSES[32]) | (c == CLASSES[10])
        start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        at = start // PASSAGE
        name = np.unique(np.fromiter(map(hash, words), np.int64, len(words)), return_inverse=True)[1]
        per = np.maximum(np.bincount(at, minlength=n), 1)
        again = np.concatenate([[False], name[1:] == name[:-1]])
        out[:, -3] = np.bincount(at, again, n) / per
        different = np.bincount(np.unique(at * len(words) + name) // len(words), minlength=n)
        out[:, -2] = 1 - different / per
    return out


class AttentionModel:
    """tanh encoder, gated attention over the passages of a bag, logistic output; trained with Adam."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        shapes = {"E": (N_FEATURES, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,),
                  "c": (HIDDEN,), "d": ()}
        self.p = {k: (r.normal(0, 1 / np.sqrt(s[0]), s) if len(s) and k != "e" else np.zeros(s)).astype(np.float32)
                  for k, s in shapes.items()}
        self.shift = np.float32(0)

    def _forward(self, x, bag, n):
        p = self.p
        h = np.tanh(x @ p["E"] + p["e"])
        v = np.tanh(h @ p["V"])
        u = 1 / (1 + np.exp(-(h @ p["U"])))
        a = np.exp(np.clip((v * u) @ p["w"], -30, 30))
        a = a / np.bincount(bag, a, n)[bag]
        z = np.zeros((n, HIDDEN), dtype=np.float32)
        np.add.at(z, bag, a[:, None].astype(np.float32) * h)
        return h, v, u, a, z, z @ p["c"] + p["d"]

    def score_sections(self, sections) -> float:
        """The score of one bag that comes in parts: attention weights and weighted sums are added up."""
        weight, total = 0.0, np.zeros(HIDDEN)
        for x in sections:
            one = np.zeros(len(x), dtype=np.int64)
            h, v, u, _, _, _ = self._forward(x, one, 1)
            a = np.exp(np.clip((v * u) @ self.p["w"], -30, 30)).astype(np.float64)
            weight += a.sum()
            total += a @ h
        logit = total / weight @ self.p["c"] + self.p["d"] + self.shift
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

    def score(self, x: np.ndarray, bag: np.ndarray, n: int) -> np.ndarray:
        logit = self._forward(x, bag, n)[-1].astype(np.float64) + self.shift
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def fit(self, x, bag, label, epochs: int = EPOCHS, rate: float = RATE, batch: int = 128, seed: int = SEED):
        """``bag`` must be sorted; labels are 0 or 1 per bag."""
        p, r = self.p, np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in p.items()}
        s = {k: np.zeros_like(v) for k, v in p.items()}
        n, step = len(label), 0
        edge = np.searchsorted(bag, np.arange(n + 1))
        for epoch in range(epochs):
            order = r.permutation(n)
            for at in range(0, n, batch):
                mine = order[at:at + batch]
                take = np.concatenate([np.arange(edge[i], edge[i + 1]) for i in mine])
                b = np.repeat(np.arange(len(mine)), edge[mine + 1] - edge[mine])
                xs = x[take]
                h, v, u, a, z, logit = self._forward(xs, b, len(mine))
                err = ((1 / (1 + np.exp(-logit))) - label[mine]).astype(np.float32) / len(mine)
                a = a.astype(np.float32)
                dz = err[:, None] * p["c"]
                da = (dz[b] * h).sum(1)
                ds = a * (da - np.bincount(b, a * da, len(mine))[b]).astype(np.float32)
                dv, du = ds[:, None] * p["w"] * u * (1 - v * v), ds[:, None] * p["w"] * v * u * (1 - u)
                dh = a[:, None] * dz[b] + dv @ p["V"].T + du @ p["U"].T
                dh *= 1 - h * h
                g = {"E": xs.T @ dh, "e": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ ds, "c": z.T @ err,
                     "d": err.sum()}
                step += 1
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    p[k] = (p[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9 ** step))
                            / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-7)).astype(np.float32)
        return self


def held_out(id_col):
    """The contract's fold: crc32 of the id as text, divisible by 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sections(data: bytes):
    for at in range(0, max(len(data), 1), _SECTION):
        yield passage_features(data[at:at + _SECTION])


def _bags(texts: list[bytes]):
    x = [passage_features(t) for t in texts]
    return np.concatenate(x), np.repeat(np.arange(len(x)), [len(f) for f in x])


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int):
    """(text, label) of at most ``per_class`` labelled documents of each class outside the held-out fold."""
    fold = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    one = fold.groupBy(id_col).agg(F.min(label_col).alias("y"), F.max(label_col).alias("y2")).where("y = y2")
    picked = [one.where(F.col("y") == c).orderBy(F.xxhash64(id_col), id_col).limit(per_class) for c in (0, 1)]
    ids = picked[0].unionByName(picked[1]).select(F.col(id_col).alias("__id"), "y")  # at most 2 x per_class rows
    texts = docs.select(F.col(id_col).alias("__doc"), text_or_empty(F.col(text_col)).alias("__text"))
    first = texts.join(F.broadcast(ids), F.col("__doc") == F.col("__id")).groupBy("__id", "y").agg(F.min("__text").alias("t"))
    share = {r["y"]: r["count"] for r in one.groupBy("y").count().collect()}  # two rows
    return first.orderBy("__id"), share


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS, passages: int = SAMPLE_PASSAGES):
    """A fitted model, or None where the training fold lacks one of the two labels.

    Passages are encoded on the executors; at most 2 x per_class x passages
    feature rows (half-precision) reach the driver, where the network is fitted.
    Both classes weigh alike in training; the logit is then shifted to their
    share among the labels.
    """
    rows, share = training_rows(docs, labels, id_col, text_col, label_col, per_class)
    if len(share) < 2:
        return None

    def encode(it):
        for b in it:
            for i, y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = t.encode("utf-8", "surrogatepass")
                n = max(1, -(-len(data) // PASSAGE))
                take = np.linspace(0, n - 1, passages).astype(int) if n > passages else np.arange(n)
                x, at = [], 0
                for part in _sections(data):  # no more than one section's features are held
                    x.append(part[take[(take >= at) & (take < at + len(part))] - at])
                    at += len(part)
                x = np.concatenate(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i]), pa.array([y], pa.int32()), pa.array([x.astype(np.float16).tobytes()], pa.binary())],
                    names=["id", "y", "x"])

    got = (rows.select(F.col("__id").cast("long").alias("id"), F.col("y").cast("int").alias("y"), "t")
           .mapInArrow(encode, "id long, y int, x binary").collect())
    got.sort(key=lambda r: r["id"])
    label = np.array([r["y"] for r in got], dtype=np.float32)
    if len(set(label.tolist())) < 2:
        return None
    bags = [np.frombuffer(r["x"], dtype=np.float16).reshape(-1, N_FEATURES) for r in got]
    model = AttentionModel().fit(np.concatenate(bags).astype(np.float32),
                                 np.repeat(np.arange(len(bags)), [len(b) for b in bags]), label)
    odds = lambda a, b: np.log(a / b)
    model.shift = np.float32(odds(share[1], share[0]) - odds(label.sum(), (1 - label).sum()))
    return model


def _scores(model: AttentionModel | None, texts) -> np.ndarray:
    """Scores of the texts of an Arrow column, some MB at a time; longer texts by sections."""
    out, at = np.full(len(texts), 0.5), 0
    while model is not None and at < len(texts):
        held, size, first = [], 0, at
        while at < len(texts) and size < _SLICE:
            data = (texts[at].as_py() or "").encode("utf-8", "surrogatepass")
            if len(data) > _SECTION and held:
                break
            at += 1
            if len(data) > _SECTION:
                out[first] = model.score_sections(_sections(data))
                break
            held.append(data)
            size += len(data)
        if not held:
            continue
        x, bag = _bags(held)
        out[first:first + len(held)] = model.score(x, bag, len(held))
    return out


def score(docs: DataFrame, model: AttentionModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and score of the whole text."""

    def run(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(model, b.column(1)))], names=[id_col, "score"])

    src = docs.select(F.col(id_col), F.col(text_col))
    return src.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", threshold: float = THRESHOLD, **kw) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns.

    Null and empty texts, null ids, repeated rows and empty tables as in ``quality_scores``.
    """
    model = train(docs, labels, id_col, text_col, label_col, **kw)
    at = docs.columns.index(text_col)

    def run(it):
        for b in it:
            yield b.filter(pa.array(_scores(model, b.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", threshold: float = THRESHOLD, **kw) -> DataFrame:
    """Per row of ``docs``: id, held_out, score (higher: label 1 likelier), predicted.

    Defined results: null and empty texts are one empty passage and get the
    model's score for it; a null id is not held out and never trains; ids with
    contradicting labels do not train; without labels of both kinds every score
    is 0.5; repeated rows get equal scores; an empty table gives an empty one;
    other columns are not read.
    """
    model = train(docs, labels, id_col, text_col, label_col, **kw)
    s = score(docs, model, id_col, text_col)
    return s.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted"))
