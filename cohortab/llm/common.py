"""Helpers shared by the operators: staged tables, connected components, word rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortab.sources.staging import discard, staged as stage  # noqa: F401  (the operators take them from here)

# The word rule of every text operator: runs of anything but ASCII white space.
ASCII_SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = re.compile(r"[^\x20\x09-\x0D]+")


def text_or_empty(col):
    return F.coalesce(col, F.lit(""))


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    ``edges``: columns a, b (long, not null). Returns node, component (smallest
    node reachable) for every node that has an edge to another node. Only
    grouped minima and joins are used, so a hub is never collected into one
    task; each round is a staged table. Rounds grow with the logarithm of the
    component size.
    """
    spark = edges.sparkSession
    cur = stage(edges.where("a <> b")
                .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        sig = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sig[0] == 0 or sig == last:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        last = sig
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .unionByName(low2.select("u", F.col("m").alias("v"))).distinct())
        cur = stage(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
