"""Centroid clustering with an incrementally updated distance matrix, in exact integers.

Every vector keeps its dot products with all centroids. A round adds to them
only what the centroids' non-zero component changes contribute; the nearest
centroid is the smallest of |c|^2 - 2 x.c (|x|^2 is the same for all). The
state (vector, dot products, cluster, distance) is a written table per round, so
a lost executor costs at most one round; the table before it is then dropped.
The driver holds the centroids only.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortab.llm.common import discard, stage

DIM = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
START = "3"
_NARROW = 1 << 26   # components up to this: every dot product and distance fits in a long
_ROWS = 4096        # vectors compared at a time


def usable(vec: Column, dim: int) -> Column:
    """True for an array of ``dim`` components, none null or non-finite."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vec) == dim) & fine, F.lit(False))


def scaled(x: float, scale: int) -> int:
    """floor(scale * x) of a double, exact for a power of two as scale."""
    return math.floor(x * scale) if abs(x) < 2.0 ** 52 else int(x) * scale


class _Numbers:
    """How integers are stored: longs, or decimal text where a product could leave a long."""

    def __init__(self, wide: bool):
        self.wide = wide
        self.kind = "string" if wide else "long"
        self.dtype = object if wide else np.int64
        self.arrow = pa.string() if wide else pa.int64()

    def matrix(self, column: pa.Array, width: int) -> np.ndarray:
        flat = column.flatten()
        if not self.wide:
            return flat.to_numpy(zero_copy_only=False).reshape(-1, width)
        return np.array([int(s) for s in flat.to_pylist()], dtype=object).reshape(-1, width)

    def values(self, a: np.ndarray) -> pa.Array:
        return pa.array([str(v) for v in a.tolist()], pa.string()) if self.wide else pa.array(a)

    def lists(self, a: np.ndarray) -> pa.Array:
        ends = np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), self.values(a.reshape(-1)))


def _batches(it):
    """Record batches of at most ``_ROWS`` rows."""
    for b in it:
        for at in range(0, b.num_rows, _ROWS):
            yield b.slice(at, _ROWS)


def _scaled_vectors(vectors: DataFrame, n: _Numbers, dim: int, k: int, scale: int) -> DataFrame:
    """id, x (integers), and dot products of zero: the state against centroids at the origin."""
    def turn(it):
        for b in _batches(it):
            v = b.column(1).flatten().to_numpy(zero_copy_only=False)
            x = (np.array([scaled(f, scale) for f in v.tolist()], dtype=object) if n.wide
                 else np.floor(v * scale).astype(np.int64)).reshape(-1, dim)
            zero = np.zeros((len(x), k), dtype=n.dtype)
            yield pa.RecordBatch.from_arrays([b.column(0), n.lists(x), n.lists(zero)], ["id", "x", "dots"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(turn, f"id {kind}, x array<{n.kind}>, dots array<{n.kind}>")


def update_dots(x: np.ndarray, dots: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Dot products after the centroids moved by ``change``: only its non-zero components are touched."""
    dots = dots.copy()
    for k, row in enumerate(change):
        moved = np.flatnonzero(row)
        if len(moved):
            dots[:, k] += x[:, moved] @ row[moved]
    return dots


def _assigned(state: DataFrame, n: _Numbers, cents: np.ndarray, change: np.ndarray) -> DataFrame:
    """The state after one update of the dot products: id, x, dots, cluster, distance."""
    length = (cents * cents).sum(1)
    k, dim = cents.shape

    def step(it):
        for b in _batches(it):
            x, old = n.matrix(b.column(1), dim), n.matrix(b.column(2), k)
            dots = update_dots(x, old, change)
            gap = length[None, :] - 2 * dots
            best = gap.argmin(1)  # the first of equal ones: the smaller number
            dist = (x * x).sum(1) + gap[np.arange(len(x)), best]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), n.lists(dots), pa.array(best.astype(np.int32)), n.values(dist)],
                ["id", "x", "dots", "cluster", "distance"])

    kind = state.schema["id"].dataType.simpleString()
    return state.select("id", "x", "dots").mapInArrow(
        step, f"id {kind}, x array<{n.kind}>, dots array<{n.kind}>, cluster int, distance {n.kind}")


def _moved(state: DataFrame, n: _Numbers, cents: np.ndarray) -> np.ndarray:
    """Centroids at floor(sum / count) of their vectors; those without vectors stay."""
    k, dim = cents.shape

    def sums(it):
        total, count = np.zeros((k, dim), dtype=object), np.zeros(k, dtype=np.int64)
        for b in _batches(it):
            own, x = b.column(0).to_numpy(zero_copy_only=False), n.matrix(b.column(1), dim)
            for c in np.unique(own):
                part = x[own == c]
                total[c] += part.sum(0).astype(object)
                count[c] += len(part)
        table = np.concatenate([total, count.astype(object)[:, None]], axis=1)  # the count is component dim
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(k, dtype=np.int32), dim + 1)),
             pa.array(np.tile(np.arange(dim + 1, dtype=np.int32), k)),
             pa.array([str(v) for v in table.reshape(-1).tolist()], pa.string())], ["c", "j", "s"])

    parts = state.select("cluster", "x").mapInArrow(sums, "c int, j int, s string")
    if n.wide:
        def merged(df):
            return df.head(1).assign(s=str(sum(int(s) for s in df["s"])))

        rows = parts.groupBy("c", "j").applyInPandas(merged, "c int, j int, s string").collect()
    else:
        rows = parts.groupBy("c", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")).collect()
    total = np.zeros((k, dim + 1), dtype=object)
    for c, j, s in rows:  # clusters x (components + 1)
        total[c, j] = int(s)
    out = cents.copy()
    for c in range(k):
        if total[c, dim]:
            out[c] = [int(s) // int(total[c, dim]) for s in total[c, :dim]]
    return out


def _by_cluster(values: list, kind: str) -> Column:
    pairs = [x for c, v in enumerate(values) for x in (F.lit(c), F.lit(v).cast(kind))]
    return F.create_map(*pairs)[F.col("cluster")]


def centroid_clusters(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM,
                      clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE,
                      start: str = START) -> DataFrame:
    """Per kept row: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of ``dim`` components without a null or non-finite one;
    each component x becomes the integer floor(scale * x). Centroids start as
    the ``clusters`` kept vectors with the smallest sha256 of "<start>:<id>".
    Each round assigns every vector to the nearest centroid (ties: the smaller
    number) and moves every non-empty one to floor(sum / count); then vectors
    are assigned once more. A round that moves nothing ends the rounds: all
    later ones would repeat it.

    Defined results: vectors that are null, of another length, or with null or
    non-finite components are left out; a null id hashes as an empty one; equal
    hashes (repeated ids) start in the order of their vectors; repeated rows
    stay and count; with fewer vectors than ``clusters`` there are as many
    centroids as vectors; an empty table gives an empty one; other columns are
    not read. Components beyond 65,536 are computed in unbounded integers, and
    a distance or sum that no long can hold is null.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    vectors = (df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
               .where(usable(F.col("v"), dim)))
    largest = vectors.agg(F.max(F.array_max(F.transform("v", F.abs))).alias("m")).first()["m"]
    if largest is None:
        return df.sparkSession.createDataFrame(
            [], f"{id_col} {id_type}, cluster int, distance long, cluster_inertia long, inertia long, "
                "centroid_sha256 string")
    n = _Numbers(largest * scale > _NARROW)
    key = F.sha2(F.concat(F.lit(f"{start}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = vectors.select(key.alias("h"), "v").orderBy("h", "v").limit(clusters).orderBy("h", "v").collect()
    cents = np.array([[scaled(x, scale) for x in r["v"]] for r in first], dtype=n.dtype)
    state = stage(_scaled_vectors(vectors, n, dim, len(cents), scale), "vectors")
    change = cents
    for done in range(rounds + 1):
        after = stage(_assigned(state, n, cents, change), "clusters")
        discard(state)
        state = after
        if done == rounds:
            break
        moved = _moved(state, n, cents)
        change = moved - cents
        if not change.any():
            break
        cents = moved
    kind = "decimal(38,0)"
    sums = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(  # one row per centroid
        F.when(F.count_if(F.expr(f"try_cast(distance AS {kind})").isNull()) == 0,
               F.try_sum(F.expr(f"try_cast(distance AS {kind})"))).alias("s")).collect()}
    per = [sums.get(c, 0) for c in range(len(cents))]
    per = [None if s is None else int(s) for s in per]
    every = None if None in per else sum(per)

    def long_or_null(v):
        return v if v is not None and v < 1 << 63 else None

    names = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in cents]
    return state.select(F.col("id").alias(id_col), "cluster", F.expr("try_cast(distance AS BIGINT)").alias("distance"),
                        _by_cluster([long_or_null(v) for v in per], "long").alias("cluster_inertia"),
                        F.lit(long_or_null(every)).cast("long").alias("inertia"),
                        _by_cluster(names, "string").alias("centroid_sha256"))
