"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank (neighbours in that order differ in few
bits) and range-partitioned. Each partition is one subtree of the index: its
leaves are fingerprints, every upper node factors out the bits that all of its
children share, as (mask, pattern). A search walks down from the top, adds the
differing bits of each node's own part of the mask, and drops a whole group as
soon as the accumulated differences exceed the limit. The partitions' root
nodes form the top of the index: it routes each fingerprint only to the
partitions whose shared bits are within the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortab.llm.common import connected_components, stage

SHINGLE_WORDS = 3
MAX_BITS = 2
FAN = 8
ROWS_PER_PARTITION = 32_768
MAX_PARTITIONS = 65_536  # bounds the broadcast roots to 24 bytes x this
_PIECE = 1 << 18
_LANES = np.uint64(0x0101010101010101)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ------------------------------------------------------------- fingerprints

def shingle_hashes(text: str | None, k: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the k-word shingles, in arrays of bounded length."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    flat = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > k:
        starts, ends = starts[: len(words) - k + 1], ends[k - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), _PIECE):
        s, e = starts[i:i + _PIECE].tolist(), ends[i:i + _PIECE].tolist()
        yield np.fromiter((digest(flat[a:b], 42) for a, b in zip(s, e)), dtype=np.uint64, count=len(s))


def majority(pieces) -> int:
    """The 64-bit word whose bits are set in over half of the hashes (none: 0)."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in pieces:
        n += len(h)
        cuts = np.arange(0, len(h), 255)  # a byte lane counts up to 255
        for bit in range(8):
            lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANES, cuts)
            ones[bit::8] += lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > n))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = SHINGLE_WORDS, carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, fp long, ``carry`` as strings) per row; a null text has no words and fingerprint zero."""
    carry = carry or {}
    names = list(carry)

    def run(batches):
        for b in batches:
            fps = np.fromiter((majority(shingle_hashes(t.as_py(), shingle_words)) for t in b.column(1)),
                              dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]],
                                             names=["id", "fp", *names])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"),
                      *[c.cast("string").alias(n) for n, c in carry.items()])
    return src.mapInArrow(run, ", ".join(["id long", "fp long", *(f"{n} string" for n in names)]))


# ------------------------------------------------------------- the index

def gray_rank(col):
    """Position of a fingerprint in the reflected Gray order, as a sortable signed long."""
    for shift in (1, 2, 4, 8, 16, 32):
        col = col.bitwiseXOR(F.shiftrightunsigned(col, shift))
    return col.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


class GrayTree:
    """Hierarchy over nodes given as (mask, pattern) in Gray order; leaves may be whole fingerprints."""

    def __init__(self, mask: np.ndarray, pattern: np.ndarray, fan: int = FAN):
        self.fan, self.levels = fan, [(mask, pattern & mask)]
        while len(self.levels[-1][0]) > fan:
            mask, pattern = self.levels[-1]
            cuts = np.arange(0, len(mask), fan)
            ones = np.bitwise_and.reduceat(pattern, cuts)
            zeros = np.bitwise_and.reduceat(~pattern, cuts)
            shared = np.bitwise_and.reduceat(mask, cuts) & (ones | zeros)
            self.levels.append((shared, ones & shared))
        # a node keeps only the bits that its parent has not compared yet
        for i in range(len(self.levels) - 1):
            parent = np.repeat(self.levels[i + 1][0], fan)[: len(self.levels[i][0])]
            mask, pattern = self.levels[i]
            self.levels[i] = (mask & ~parent, pattern & ~parent)

    @classmethod
    def of(cls, fps: np.ndarray, fan: int = FAN) -> "GrayTree":
        return cls(np.full(len(fps), _FULL), fps, fan)

    def search(self, queries: np.ndarray, limit: int, piece: int = 4096):
        """Yields (query index, leaf index) arrays of all pairs within the limit."""
        for at in range(0, len(queries), piece):
            q = queries[at:at + piece]
            mask, pattern = self.levels[-1]
            qi = np.repeat(np.arange(len(q)), len(mask))
            node = np.tile(np.arange(len(mask)), len(q))
            dist = np.zeros(len(qi), dtype=np.uint8)
            for level in range(len(self.levels) - 1, -1, -1):
                mask, pattern = self.levels[level]
                dist = dist + np.bitwise_count((q[qi] & mask[node]) ^ pattern[node])
                keep = dist <= limit
                qi, node, dist = qi[keep], node[keep], dist[keep]
                if level:
                    below = len(self.levels[level - 1][0])
                    child = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                    real = child < below
                    qi, dist = np.repeat(qi, self.fan)[real], np.repeat(dist, self.fan)[real]
                    node = child[real]
            yield qi + at, node


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (root, member) with the same components as the edges a-b; ids are array positions."""
    n = int(max(a.max(), b.max())) + 1 if len(a) else 0
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if np.array_equal(label, before):
            break
    member = np.flatnonzero(label != np.arange(n))
    return label[member], member


def _groups(n: int) -> int:
    return int(max(1, min(MAX_PARTITIONS, -(-n // ROWS_PER_PARTITION))))


def similar_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) joining distinct fingerprints at most ``max_bits`` apart.

    ``fps``: one column ``fp`` of distinct longs. The pairs found in one index
    partition are returned as star edges with the same components, so the
    output is linear in the input even in a dense group.
    """
    n = fps.count()
    parts = _groups(n)
    ranked = fps.select("fp", gray_rank(F.col("fp")).alias("rank"))
    index = stage(ranked.repartitionByRange(parts, "rank").sortWithinPartitions("rank")
                  .select("fp", "rank", F.spark_partition_id().alias("part")), "gray-index")
    ones, anyone = F.bit_and("fp"), F.bit_or("fp")
    roots = index.groupBy("part").agg(ones.alias("ones"), anyone.alias("any")).orderBy("part").collect()  # <= parts rows
    part_ids = np.array([r["part"] for r in roots], dtype=np.int64)
    all_one = np.array([r["ones"] for r in roots], dtype=np.int64).view(np.uint64)
    any_one = np.array([r["any"] for r in roots], dtype=np.int64).view(np.uint64)
    top_mask = ~(all_one ^ any_one)

    def route(batches):
        top = GrayTree(top_mask, all_one & top_mask)
        for b in batches:
            q = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            own = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            found = [(qi, part_ids[node]) for qi, node in top.search(q.view(np.uint64), max_bits)]
            qi, to = (np.concatenate(x) for x in zip(*found))
            later = to >= own[qi]  # each pair of partitions meets once
            qi, to = qi[later], to[later]
            # neighbours in Gray order go to the same few partitions: one packed row for each
            order = np.argsort(to, kind="stable")
            names, first = np.unique(to[order], return_index=True)
            packed = [x.tobytes() for x in np.split(q[qi[order]], first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(packed, pa.binary())], names=["part", "fps"])

    routed = index.select("fp", F.col("part").cast("long")).mapInArrow(route, "part long, fps binary")

    def probe(leaves: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        leaf = leaves.sort_values("rank")["fp"].to_numpy(np.int64) if len(leaves) else np.zeros(0, np.int64)
        q = np.frombuffer(b"".join(queries["fps"]), dtype=np.int64)
        out = []
        if len(leaf) and len(q):
            names = np.unique(np.concatenate([leaf, q]))
            leaf_at, q_at = np.searchsorted(names, leaf), np.searchsorted(names, q)
            held: tuple = (np.zeros(0, np.int64), np.zeros(0, np.int64))
            for qi, node in GrayTree.of(leaf.view(np.uint64)).search(q.view(np.uint64), max_bits):
                a, b = q_at[qi], leaf_at[node]
                other = a != b
                held = forest(np.concatenate([held[0], a[other]]), np.concatenate([held[1], b[other]]))
            out.append(pd.DataFrame({"a": names[held[0]], "b": names[held[1]]}))
        return pd.concat(out) if out else pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})

    leaves = index.select("fp", "rank", F.col("part").cast("long").alias("part"))
    return (leaves.repartition(parts, "part").groupBy("part")
            .cogroup(routed.repartition(parts, "part").groupBy("part")).applyInPandas(probe, "a long, b long"))


def _with_component(nodes: DataFrame, max_bits: int) -> DataFrame:
    """``nodes`` (one row per fingerprint ``fp``) with the component of each."""
    comp = connected_components(similar_fingerprints(nodes.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    return nodes.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """Per row: id, fingerprint (16 lowercase hex digits), component_id.

    component_id is the smallest id among all rows whose fingerprints are
    connected by links of at most ``max_bits`` differing bits. Equal
    fingerprints are one node of the index, so a large group of copies costs
    one node. Null and empty texts (and texts without a word) have fingerprint
    zero and are linked like any other. Rows with a null id get the smallest
    non-null id of their component (null if there is none). Repeated rows stay.
    Only the id and text columns are read; an empty table gives an empty one.
    """
    fp = stage(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    nodes = stage(fp.groupBy("fp").agg(F.min("id").alias("low")), "fp-nodes")
    named = _with_component(nodes, max_bits)
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    lookup = named.select("fp", "component").join(lowest, "component").select("fp", "component_id")
    return (fp.join(lookup, "fp")
            .select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    "component_id"))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` per SimHash component: the one with the smallest id, then the smallest text digest.

    A row is known by its id and text, so only rows of one component replace
    each other: different texts with a null or a repeated id stay apart. A null
    id comes after all others; of rows equal in id and text one stays, the
    first by its columns as JSON.
    """
    digest = F.coalesce(F.sha2(docs[text_col], 256), F.lit(""))
    rows = (fingerprints(docs, id_col, text_col, shingle_words, {"digest": digest})
            .groupBy("fp", "id", "digest").agg(F.count("*").alias("n")))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest", "n"))
    nodes = stage(rows.groupBy("fp").agg(first.alias("first")), "fp-nodes")
    kept = stage(_with_component(nodes, max_bits).groupBy("component").agg(F.min("first").alias("first"))
                 .select(F.col("first.id").alias("__id"), F.col("first.digest").alias("__digest"),
                         (F.col("first.n") > 1).alias("__many")), "kept-rows")

    def matching(many: bool) -> DataFrame:
        k = kept.where(F.col("__many") == many)
        return docs.join(k, docs[id_col].cast("long").eqNullSafe(k["__id"]) & (digest == k["__digest"]))

    row = F.struct(*[docs[c] for c in docs.columns])
    first = matching(True).groupBy("__id", "__digest").agg(F.min_by(row, F.to_json(row)).alias("r")).select("r.*")
    return matching(False).select(*[docs[c] for c in docs.columns]).unionByName(first.select(*docs.columns))
