"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

The vocabulary is that of a public model file (its path is a parameter).
Encoding follows the merge agenda: of all neighbouring symbols whose
concatenation is a piece, the best-scored pair merges next, the leftmost on
ties. Under dropout each candidate merge is skipped where a hash keyed by the
seed, the record's key, the word's position and the pair's place falls below the
rate: every occurrence of a word decides for itself, and always alike for the
same seed and record.

No piece continues after a space, so merges never cross from one word to the
next, and occurrences of words of equal length are encoded side by side in
arrays. What may merge into what depends on the word alone and is looked up once
per different word; an occurrence that skips no candidate of the agenda without
dropout has that agenda's result.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RATE = 0.1
SEED = 17
LONG_WORD = 48      # symbols from which a word is encoded on its own, by a heap
SLICE = 1_000       # rows whose words are encoded together,
SLICE_CHARS = 4 << 20   # ... and characters (a longer text is on its own)
SIDE = 1 << 15      # occurrences encoded side by side
TABLE = 1 << 22     # spans of different words that are looked up at a time
SPACE = "▁"
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_ESCAPED = "\udc81"       # stands for a U+2581 of the text itself; no text holds a lone surrogate
_NEVER = np.int32(2 ** 31 - 1)


class Vocabulary:
    """Pieces, byte pieces and the merge table of a BPE model."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], plain: list[bool]):
        self.pieces, self.n = pieces, len(pieces)
        self.byte_ids = np.array([byte_ids[b] for b in range(256)], dtype=np.int64)
        ids = {p: i for i, p in enumerate(pieces) if plain[i]}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("a piece continues after a space: words cannot be encoded on their own")
        self.char_ids = np.arange(0x110000, dtype=np.int64) + self.n      # an unknown character stands for itself
        for p, i in ids.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        # merges in the order of the agenda: by score, pairs of equal score share a rank
        levels = {s: r for r, s in enumerate(sorted({scores[i] for i in ids.values()}, reverse=True))}
        # two symbols merge where their span is a piece: a trie of the pieces, spelled in ids of characters
        # (characters that are no pieces never merge)
        edge: dict[tuple[int, int], int] = {}
        pieces_at: dict[int, tuple[int, int]] = {}
        for p, i in ids.items():
            if len(p) > 1 and all(c in ids for c in p):
                node = 0
                for c in p:
                    node = edge.setdefault((node, ids[c]), len(edge) + 1)
                pieces_at[node] = levels[scores[i]], i
        key = self.pair(*np.array(list(edge) or np.zeros((0, 2)), dtype=np.int64).T)
        order = np.argsort(key)
        self.edges = np.concatenate([key[order], [np.iinfo(np.int64).max]])
        self.edge_to = np.concatenate([np.fromiter(edge.values(), np.int64, len(edge))[order], [0]])
        self.node_rank = np.full(len(edge) + 1, _NEVER, dtype=np.int32)
        self.node_id = np.zeros(len(edge) + 1, dtype=np.int32)
        for node, (r, i) in pieces_at.items():
            self.node_rank[node], self.node_id[node] = r, i
        merges = [(ids[p[:k]], ids[p[k:]], levels[scores[i]], i) for p, i in ids.items()
                  for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        table = np.array(merges, dtype=np.int64).reshape(-1, 4)
        key = self.pair(table[:, 0], table[:, 1])
        order = np.argsort(key)
        self.keys = np.concatenate([key[order], [np.iinfo(np.int64).max]])
        self.ranks = np.concatenate([table[order, 2], [0]]).astype(np.int32)
        self.merged = np.concatenate([table[order, 3], [0]])
        self.raw = [p.replace(SPACE, " ").encode() for p in pieces]
        for b, i in byte_ids.items():
            self.raw[i] = bytes([b])

    def pair(self, a, b):
        return a * np.int64(self.n + 0x110000) + b

    def rank(self, a: np.ndarray, b: np.ndarray):
        """(rank, merged id) of pairs; the rank is _NEVER where they do not merge."""
        key = self.pair(a, b)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER), self.merged[at]


@lru_cache(maxsize=4)
def load_vocabulary(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = range(m.get_piece_size())
    pieces = [m.id_to_piece(i) for i in n]
    byte_ids = {int(pieces[i][1:-1], 16): i for i in n if m.is_byte(i)}
    plain = [not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) for i in n]
    return Vocabulary(pieces, [m.get_score(i) for i in n], byte_ids, plain)


def _skipped(key, start, mid, end, rate: float):
    """Keyed decision on the merge of [start, mid) with [mid, end)."""
    h = key ^ ((start.astype(np.uint64) << np.uint64(42)) | (mid.astype(np.uint64) << np.uint64(21)) | end.astype(np.uint64))
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(33)
    return (h >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 < rate


def encode_long(voc: Vocabulary, symbols: np.ndarray, key: int, rate: float) -> list[int]:
    """The agenda of one word as a heap over linked symbols."""
    ids, n = symbols.tolist(), len(symbols)
    start, end = list(range(n)), list(range(1, n + 1))
    prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
    keys = np.array([key], dtype=np.uint64)

    def candidates(left):
        left = np.array(left, dtype=np.int64)
        right = np.array([nxt[i] for i in left.tolist()], dtype=np.int64)
        rank, merged = voc.rank(np.array([ids[i] for i in left.tolist()]), np.array([ids[i] for i in right.tolist()]))
        ok = rank != _NEVER
        if rate > 0 and ok.any():
            at = [np.array([x[i] for i in y.tolist()], dtype=np.int64) for x, y in ((start, left), (start, right), (end, right))]
            ok &= ~_skipped(keys, *at, rate)
        return [(int(r), int(a), int(b), start[a], end[b], int(m)) for r, a, b, m in
                zip(rank[ok], left[ok], right[ok], merged[ok])]

    heap = candidates(range(n - 1)) if n > 1 else []
    heapq.heapify(heap)
    while heap:
        _, a, b, s, e, m = heapq.heappop(heap)
        if ids[a] < 0 or ids[b] < 0 or nxt[a] != b or start[a] != s or end[b] != e:
            continue
        ids[a], end[a], nxt[a] = m, e, nxt[b]
        ids[b] = -1
        if nxt[a] >= 0:
            prev[nxt[a]] = a
        for c in candidates([i for i in ((prev[a],) if prev[a] >= 0 else ()) + ((a,) if nxt[a] >= 0 else ())]):
            heapq.heappush(heap, c)
    return [i for i in ids if i >= 0]


def _tables(voc: Vocabulary, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank, id) of every span of words of equal length, flat by (word, start, end); the rank is _NEVER where none."""
    n, width = symbols.shape
    side = width + 1
    ranks = np.full(n * side * side, _NEVER, dtype=np.int32)
    ids = np.zeros(n * side * side, dtype=np.int32)
    ids.reshape(n, side, side)[:, np.arange(width), np.arange(1, side)] = symbols
    flat = symbols.ravel()
    at = np.arange(len(flat))                                             # of the last character of the span
    end = np.tile(np.arange(1, side), n)
    place = np.repeat(np.arange(n) * (side * side), width) + (end - 1) * side + end
    node = np.zeros(len(flat), dtype=np.int64)
    while len(at):
        key = voc.pair(node, flat[at])
        to = np.searchsorted(voc.edges, key)
        ok = voc.edges[to] == key
        at, end, place, node = at[ok], end[ok], place[ok], voc.edge_to[to[ok]]
        piece = voc.node_rank[node] != _NEVER
        ranks[place[piece]], ids[place[piece]] = voc.node_rank[node[piece]], voc.node_id[node[piece]]
        more = end < width
        at, end, place, node = at[more] + 1, end[more] + 1, place[more] + 1, node[more]
    return ranks, ids


def _agendas(ranks: np.ndarray, word: np.ndarray, width: int, key: np.ndarray | None, rate: float, seen: list | None = None):
    """The agendas of occurrences side by side: (ends of symbols left-aligned, number of symbols left).

    ``seen`` collects the candidates met: (occurrence, start, mid, end).
    """
    n, side = len(word), width + 1
    left = np.full(n, width)
    at = np.tile(np.arange(side, dtype=np.int64), (n, 1))                 # symbol starts; at[:, left] is the end
    out = at.copy()
    if width < 2 or not n:
        return out, left
    base = word * (side * side)
    rank = ranks[base[:, None] + np.arange(width - 1) * (side + 1) + 2]
    if seen is not None:
        i, j = np.nonzero(rank != _NEVER)
        seen.append((i, j, j + 1, j + 2))
    if rate > 0:
        rank = np.where(_skipped(key[:, None], at[:, :-2], at[:, 1:-1], at[:, 2:], rate), _NEVER, rank)
    rows, col = np.arange(n), np.arange(side)
    while True:
        j = rank.argmin(axis=1)
        go = rank[np.arange(len(rows)), j] != _NEVER
        if not go.all():
            done = ~go
            out[rows[done], :at.shape[1]] = at[done]
            rows, base, at, rank, j = rows[go], base[go], at[go], rank[go], j[go]
            key = key if key is None else key[go]
        if not len(rows):
            return out, left
        left[rows] -= 1
        k = at.shape[1] - 1
        if k == 2:
            out[rows, 1] = width
            return out, left
        # close the gap at j + 1
        at = np.where(col[:k] > j[:, None], at[:, 1:], at[:, :-1])
        rank = np.where(col[: k - 2] > j[:, None], rank[:, 1:], rank[:, :-1])
        for place in (j - 1, j):
            ok = np.flatnonzero((place >= 0) & (place < k - 2))
            p = place[ok]
            a, m, e = at[ok, p], at[ok, p + 1], at[ok, p + 2]
            new = ranks[base[ok] + a * side + e]
            if seen is not None:
                can = new != _NEVER
                seen.append((rows[ok[can]], a[can], m[can], e[can]))
            if rate > 0:
                new = np.where(_skipped(key[ok], a, m, e, rate), _NEVER, new)
            rank[ok, p] = new


def _any_skipped(seen: list, n_words: int, word: np.ndarray, key: np.ndarray, rate: float) -> np.ndarray:
    """Whether an occurrence skips a candidate that its word's agenda without dropout meets."""
    owner, *place = (np.concatenate(x) for x in zip(*seen))
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    count = np.bincount(owner, minlength=n_words)
    col = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    wide = np.zeros((3, n_words, int(count.max(initial=0))), dtype=np.int64)
    for w, x in zip(wide, place):
        w[owner, col] = x[order]
    hit = np.zeros(len(word), dtype=bool)
    for c in range(wide.shape[2]):
        at = np.flatnonzero(~hit & (count[word] > c))
        hit[at] = _skipped(key[at], *(w[word[at], c] for w in wide), rate)
    return hit


def _encode_equal(voc: Vocabulary, symbols: np.ndarray, word: np.ndarray, key: np.ndarray, rate: float):
    """Occurrences (``word`` is a row of ``symbols``) of words of equal length: (ids end to end, number of each)."""
    n, width = symbols.shape
    side = width + 1
    ranks, ids = _tables(voc, symbols)
    seen: list | None = [] if rate > 0 and width > 1 else None
    at, left = (x[word] for x in _agendas(ranks, np.arange(n), width, None, 0.0, seen))
    if seen is not None:
        own = np.flatnonzero(_any_skipped(seen, n, word, key, rate))
        at[own], left[own] = _agendas(ranks, word[own], width, key[own], rate)
    live = np.arange(width) < left[:, None]
    return ids[((word * (side * side))[:, None] + at[:, :-1] * side + at[:, 1:])[live]].astype(np.int64), left


def encode_occurrences(voc: Vocabulary, names: list[str], which: np.ndarray, keys: np.ndarray, rate: float,
                       side: int = SIDE) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of each occurrence, of the word ``names[which]``: (all ids end to end, number per occurrence)."""
    size = np.fromiter(map(len, names), np.int64, len(names))
    points = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    symbols = voc.char_ids[points]
    first = np.cumsum(size) - size
    width_of = size[which]
    order = np.lexsort((which, width_of))
    widths = np.unique(width_of)
    edges = np.searchsorted(width_of[order], np.concatenate([widths, [np.iinfo(np.int64).max]]))
    count = np.zeros(len(which), dtype=np.int64)
    parts = []
    for width, lo, hi in zip(widths.tolist(), edges.tolist(), edges[1:].tolist()):
        occ = order[lo:hi]
        if width > LONG_WORD:
            got = [encode_long(voc, symbols[first[w]:first[w] + width], int(k), rate)
                   for w, k in zip(which[occ].tolist(), keys[occ].tolist())]
            count[occ] = [len(x) for x in got]
            parts.append((occ, np.array([i for x in got for i in x], dtype=np.int64)))
            continue
        word = which[occ]
        number = np.cumsum(np.concatenate([[0], word[1:] != word[:-1]]))   # of the different words, from 0
        most, p = max(1, TABLE // (width + 1) ** 2), 0
        while p < len(occ):
            q = min(p + side, int(np.searchsorted(number, number[p] + most)))
            w, local = np.unique(word[p:q], return_inverse=True)
            flat, left = _encode_equal(voc, symbols[first[w][:, None] + np.arange(width)], local, keys[occ[p:q]], rate)
            count[occ[p:q]] = left
            parts.append((occ[p:q], flat))
            p = q
    begin = np.cumsum(count) - count
    flat = np.zeros(int(count.sum()), dtype=np.int64)
    for occ, x in parts:
        n = count[occ]
        flat[np.repeat(begin[occ] - (np.cumsum(n) - n), n) + np.arange(len(x))] = x
    unknown = np.flatnonzero(flat >= voc.n)
    if len(unknown):                      # unknown characters fall back to their bytes
        grown = np.ones(len(flat), dtype=np.int64)
        raw = [(SPACE if c == ord(_ESCAPED) else chr(c)).encode() for c in (flat[unknown] - voc.n).tolist()]
        grown[unknown] = [len(b) for b in raw]
        begin = np.cumsum(grown) - grown
        owner = np.repeat(np.arange(len(which)), count)
        flat = np.repeat(flat, grown)
        for at, b in zip(begin[unknown].tolist(), raw):
            flat[at:at + len(b)] = voc.byte_ids[list(b)]
        count = np.bincount(owner, grown, len(which)).astype(np.int64)
    return flat, count


def encode_words(voc: Vocabulary, words: list[str], keys: np.ndarray, rate: float):
    """Token ids of each word under its key: (all ids end to end, number per word)."""
    return encode_occurrences(voc, words, np.arange(len(words)), keys, rate)


def words_of(text: str) -> list[str]:
    """Runs of spaces with the characters after them, behind one added space; an escaped mark stays a character."""
    if not text:
        return []
    return _WORD.findall(SPACE + text.replace(SPACE, _ESCAPED).replace(" ", SPACE))


def encode_batch(voc: Vocabulary, texts: list[str], records: list, rate: float, seed: int,
                 side: int = SIDE) -> list[np.ndarray]:
    """Token ids of each text; ``side`` occurrences are encoded at a time, which changes no result."""
    known: dict[str, int] = {}
    per_doc, keys = [], []
    for text, record in zip(texts, records):
        words = words_of(text)
        per_doc.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        base = np.uint64(xxhash.xxh64_intdigest(f"{seed}/{record}"))
        h = (base + np.arange(len(words), dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        keys.append((h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93))
    if not known:
        return [np.zeros(0, dtype=np.int64) for _ in texts]
    flat, count = encode_occurrences(voc, list(known), np.concatenate(per_doc), np.concatenate(keys), rate, side)
    ends = np.concatenate([[0], np.cumsum(count)])[np.cumsum([len(d) for d in per_doc])]
    return np.split(flat, ends[:-1])


def _slices(sizes: list[int]):
    """(first row, number of rows) of slices of at most SLICE rows and SLICE_CHARS characters."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if i > first and (i - first == SLICE or held + n > SLICE_CHARS):
            yield first, i - first
            first, held = i, 0
        held += n
    if sizes:
        yield first, len(sizes) - first


def _kind(voc: Vocabulary) -> str:
    return "<u2" if voc.n <= 1 << 16 else "<u4"


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, rate: float = RATE,
           seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, tokens (ids as little-endian unsigned integers of 2 bytes, 4 for large vocabularies), n_tokens, ``carry``.

    Defined results: a null or empty text has no tokens; a null id is a record
    key like any other; repeated rows get equal tokens; an empty table gives an
    empty one; other columns are not read.
    """
    voc = load_vocabulary(model)

    def run(it):
        for whole in it:
            for at, n in _slices([len(t.as_py() or "") for t in whole.column(1)]):
                b = whole.slice(at, n)
                got = encode_batch(voc, [t or "" for t in b.column(1).to_pylist()], b.column(0).to_pylist(), rate, seed)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([x.astype(_kind(voc)).tobytes() for x in got], pa.binary()),
                     pa.array([len(x) for x in got], pa.int64()), *(b.column(2 + i) for i in range(len(carry)))],
                    names=[id_col, "tokens", "n_tokens", *carry])

    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"`{id_col}` {fields[id_col]}", "tokens binary", "n_tokens long",
                        *(f"`{c}` {fields[c]}" for c in carry)])
    return docs.select(id_col, text_col, *carry).mapInArrow(run, schema)


def decode_tokens(voc: Vocabulary, tokens: bytes) -> str:
    raw = voc.raw
    data = b"".join([raw[i] for i in np.frombuffer(tokens, dtype=_kind(voc)).tolist()])
    return data[1:].decode("utf-8", "replace")


def decode(rows: DataFrame, tokens_col: str = "tokens", model: str = MODEL, out: str = "decoded") -> DataFrame:
    """``rows`` with the text of the tokens instead of them; no tokens or null give an empty text."""
    voc, at = load_vocabulary(model), rows.columns.index(tokens_col)
    names = [*(c for c in rows.columns if c != tokens_col), out]

    def run(it):
        for b in it:
            text = [decode_tokens(voc, t or b"") for t in b.column(at).to_pylist()]
            cols = [c for i, c in enumerate(b.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(text, pa.string())], names=names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != tokens_col]
    return rows.mapInArrow(run, ", ".join([*fields, f"`{out}` string"]))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Per row: id, n_tokens, tokens_sha256, lossless (the decoded tokens are the text; null counts as empty)."""
    src = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    src = src.withColumn("__h", F.xxhash64("__t"))
    enc = encode(src, id_col, "__t", carry=("__h",), **kw).withColumn("tokens_sha256", F.sha2("tokens", 256))
    return (decode(enc).select(id_col, "n_tokens", "tokens_sha256",
                               (F.xxhash64("decoded") == F.col("__h")).alias("lossless")))
