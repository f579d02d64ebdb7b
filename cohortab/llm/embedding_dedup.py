"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= t are at most sqrt(2 - 2t) apart. Rotated by a
fixed random orthogonal matrix and split into blocks, a pair within the whole
squared distance is within the budget of at least one block when the budgets,
proportional to the blocks' shares of the variance, add up to it. Each block is
a range join on a grid over its first coordinates: a vector meets those of its
own and of the neighbouring cells. Pairs that pass a block's budget are
verified by the exact cosine of the original vectors.

A pair is counted in the first block whose budget it meets and nowhere else, so
link counts add up and pairs never leave the task that found them: it returns a
count per vector and a spanning forest of its links.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortab.llm.common import connected_components, stage

THRESHOLD = 0.95
BLOCK = 16         # coordinates of a block
GRID = 3           # of them, those that the cells are laid over
CHUNK = 16_384     # vectors of a cell that one task compares with as many of its neighbours
SEED = 11
_SLACK = 1e-6      # rotated distances are only a filter


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _unit(v) -> np.ndarray:
    """Rows of unit length in double precision (scaled first, so that no square overflows or vanishes)."""
    v = np.stack(v.to_numpy()).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _blocks(dim: int) -> list[slice]:
    n = max(1, dim // BLOCK)
    edges = np.linspace(0, dim, n + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def budgets(variance: np.ndarray, radius2: float) -> list[float]:
    """Of each block, its share of the squared distance, in proportion to its variance (none below 1 % of an equal one)."""
    share = np.array([variance[b].sum() for b in _blocks(len(variance))])
    share = np.maximum(share, 0.01 * max(share.mean(), 1e-12))
    return list(radius2 * share / share.sum())


def _vector_classes(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their class, classes): equal vectors are one class; vectors that link with nothing have none."""
    v = F.col("v")
    fine = (v.isNotNull() & (F.size(v) > 0)
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(v, lambda x: x != 0))
    kind = df.schema[vec_col].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("v"))
    plain = F.transform("v", lambda x: x + F.lit(0).cast(kind))  # -0.0 becomes 0.0
    rows = rows.withColumn("v", F.when(F.coalesce(fine, F.lit(False)), plain))
    classes = (rows.where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"), F.min("id").alias("low"))
               .withColumn("cls", F.monotonically_increasing_id()))
    return rows, stage(classes, "vector-classes")


def _spread(classes: DataFrame, dim: int):
    """Variance of each rotated coordinate over all classes (sums of a fixed size per task)."""
    turn = rotation(dim)

    def sums(it):
        total = np.zeros((3, dim))
        for b in it:
            x = _unit(b["v"]) @ turn
            total += [np.full(dim, len(x)), x.sum(0), (x * x).sum(0)]
        yield pd.DataFrame({"k": np.repeat([0, 1, 2], dim), "i": np.tile(np.arange(dim), 3), "s": total.ravel()})

    got = classes.select("v").mapInPandas(sums, "k int, i int, s double").groupBy("k", "i").agg(F.sum("s")).collect()
    t = np.zeros((3, dim))
    for k, i, s in got:  # 3 x dim rows
        t[k, i] = s
    n = np.maximum(t[0], 1)
    return np.maximum(t[2] / n - (t[1] / n) ** 2, 0)


def _dealt(classes: DataFrame, dim: int, budget: list[float]) -> DataFrame:
    """One row for each class, block and cell that it meets: home is true in its own cell."""
    turn, blocks = rotation(dim), _blocks(dim)
    grids = [min(GRID, b.stop - b.start) for b in blocks]
    # of two neighbouring cells, vectors of the later one travel to the earlier one
    steps = {g: np.array([s for s in np.ndindex(*(3,) * g) if s > (1,) * g]) - 1 for g in set(grids)}

    def deal(it):
        for b in it:
            ids = b["cls"].to_numpy()
            x = _unit(b["v"]) @ turn
            for k, (block, g) in enumerate(zip(blocks, grids)):
                cell = np.floor(x[:, block][:, :g] / np.sqrt(budget[k] + _SLACK)).astype(np.int64)
                for step in (np.zeros(g, dtype=np.int64), *steps[g]):
                    names = ["_".join(map(str, c)) for c in (cell - step).tolist()]
                    yield pd.DataFrame({"block": k, "cell": names, "home": not step.any(), "cls": ids})

    return classes.select("cls", "v").mapInPandas(deal, "block int, cell string, home boolean, cls long")


def _pairs(dim: int, budget: list[float], threshold: float):
    turn, blocks = rotation(dim), _blocks(dim)

    def find(df: pd.DataFrame) -> pd.DataFrame:
        k = int(df["block"].iloc[0])
        left, right = df[df["side"] == 0], df[df["side"] == 1]
        out = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})
        if not len(left) or not len(right):
            return out
        ua, ub = _unit(left["v"]), _unit(right["v"])
        ra, rb = ua @ turn, ub @ turn
        ia, ib = left["cls"].to_numpy(), right["cls"].to_numpy()
        wa, wb = left["w"].to_numpy(), right["w"].to_numpy()
        home = right["home"].to_numpy()
        n_a, n_b = np.zeros(len(ia), dtype=np.int64), np.zeros(len(ib), dtype=np.int64)
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        names = np.unique(np.concatenate([ia, ib]))
        at_a, at_b = np.searchsorted(names, ia), np.searchsorted(names, ib)

        def near(i, j, block, limit):
            d = ra[i][:, block] - rb[j][:, block]
            return (d * d).sum(1) <= limit + _SLACK

        for s in range(0, len(ia), 512):
            part = slice(s, s + 512)
            x, y = ra[part, blocks[k]], rb[:, blocks[k]]
            d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
            i, j = np.nonzero(d <= budget[k] + _SLACK)
            i += s
            # home pairs meet twice (once each way); the later class stays on the right
            keep = (ia[i] < ib[j]) | ~home[j]
            i, j = i[keep], j[keep]
            for e in range(0, len(i), 1 << 16):
                p, q = i[e:e + (1 << 16)], j[e:e + (1 << 16)]
                first = np.ones(len(p), dtype=bool)
                for earlier in range(k):
                    first &= ~near(p, q, blocks[earlier], budget[earlier])
                p, q = p[first], q[first]
                hit = np.einsum("ij,ij->i", ua[p], ub[q]) >= threshold
                p, q = p[hit], q[hit]
                n_a += np.bincount(p, wb[q], len(ia)).astype(np.int64)
                n_b += np.bincount(q, wa[p], len(ib)).astype(np.int64)
                held = _forest(np.concatenate([held[0], at_a[p]]), np.concatenate([held[1], at_b[q]]))
        counts = pd.concat([pd.DataFrame({"a": ia, "n": n_a}), pd.DataFrame({"a": ib, "n": n_b})])
        counts = counts[counts["n"] > 0].groupby("a", as_index=False)["n"].sum()
        counts["b"] = counts["a"]
        edges = pd.DataFrame({"a": names[held[0]], "b": names[held[1]], "n": np.zeros(len(held[0]), dtype=np.int64)})
        return pd.concat([counts[["a", "b", "n"]], edges])

    return find


def _forest(a: np.ndarray, b: np.ndarray):
    from cohortab.llm.simhash import forest

    return list(forest(a, b))


def embedding_groups(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                     threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """Per row: id, n_links, component_id, kept.

    n_links counts the other rows linked directly (cosine >= ``threshold``);
    component_id is the smallest id reachable over links, the row's own
    included; kept is true where both are equal. Equal vectors are one class:
    their rows count as links of each other and are compared once.

    Defined results: a null or empty vector, a zero one, or one with null or
    non-finite components links with nothing and stays; vectors of different
    lengths never link; null ids get the smallest non-null id of their
    component (null if there is none) and are not kept then; repeated rows stay
    and link; an empty table gives an empty one; other columns are not read.
    """
    rows, classes = _vector_classes(df, id_col, vec_col)
    dims = [r[0] for r in classes.select(F.size("v").alias("d")).distinct().collect()]
    found = None
    for dim in sorted(dims):
        mine = classes.where(F.size("v") == dim)
        budget = budgets(_spread(mine, dim), 2 - 2 * threshold)
        cells = stage(_dealt(mine, dim, budget), "cells")
        # a crowded cell is cut into chunks; every home chunk meets every chunk of what came to the cell
        size = cells.groupBy("block", "cell").agg(F.count("*").alias("all"), F.count_if("home").alias("own"))
        size = size.where("own > 0 AND all > 1").select(
            "block", "cell", F.ceil(F.col("own") / chunk).alias("rows"), F.ceil(F.col("all") / chunk).alias("cols"))
        c = cells.join(size, ["block", "cell"])
        salt = F.xxhash64("cls")
        left = (c.where("home").withColumn("r", F.pmod(salt, F.col("rows")))
                .withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1))).withColumn("side", F.lit(0)))
        right = (c.withColumn("c", F.pmod(salt, F.col("cols")))
                 .withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("side", F.lit(1)))
        vectors = mine.select("cls", "v", F.col("n").alias("w"))
        both = left.unionByName(right).join(vectors, "cls")
        got = (both.groupBy("block", "cell", "r", "c")
               .applyInPandas(_pairs(dim, budget, threshold), "a long, b long, n long"))
        found = got if found is None else found.unionByName(got)
    if found is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
                           F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = stage(found, "links")
    links = found.where("a = b").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("links"))
    comp = connected_components(found.where("a <> b").select("a", "b")).withColumnRenamed("node", "cls")
    named = (classes.join(comp, "cls", "left").join(links, "cls", "left")
             .select("v", "low", F.coalesce("component", "cls").alias("component"),
                     (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    named = stage(named, "named")
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    lookup = named.join(lowest, "component").select("v", "n_links", "component_id")
    component = F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return (rows.join(lookup, "v", "left")
            .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    component.alias("component_id"),
                    F.coalesce(F.col("id") == component, F.col("v").isNull()).alias("kept")))
