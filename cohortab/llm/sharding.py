"""Rendezvous sharding: weighted shards bid for each record key, the best bid wins.

A shard's bid depends only on the key and the shard, so adding a shard moves
just the records it wins, and a heavier shard wins in proportion to its weight.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortab.llm.common import stage, text_or_empty

SHARDS = 16
SLICE_ROWS = 250_000  # expected rows numbered in one task
_TWO53 = float(1 << 53)


def bid(key: Column, shard: int, weight: float) -> Column:
    """-weight / ln(u) for a u in (0, 1) hashed from key and shard: the largest bid wins (weighted rendezvous)."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(int(shard))), 11).cast("double") + 0.5) / _TWO53
    return -F.lit(float(weight)) / F.log(u)


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The winning shard; equal bids go to the smaller shard number."""
    bids = [F.struct(bid(key, i, w).alias("b"), F.lit(-i).alias("s")) for i, w in enumerate(weights) if w > 0]
    if not bids:
        raise ValueError("no shard has a positive weight")
    best = reduce(F.greatest, [F.array(b) for b in bids]) if len(bids) > 1 else F.array(bids[0])
    return (-best[0]["s"]).cast("int")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    weights: Sequence[float] = (1.0,) * SHARDS, grown: Sequence[float] | None = None,
                    slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Per row: id, size, text_crc32, law ('key'), shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 1, ``grown_shard`` the shard under
    ``grown`` (by default one more shard of the mean weight). ``slot`` numbers a
    shard's rows from 0 without gaps: rows are counted per shard and hash slice,
    the slices' offsets are running sums over those few counts, and each slice
    is numbered on its own, so no task handles a whole shard.

    Defined results: a null text has size 1 and the CRC of an empty one; a null
    id is a key like any other; repeated ids share a shard and have different
    slots (ordered by size, CRC); an empty table gives an empty one; other
    columns are not read.
    """
    weights = list(weights)
    grown = list(grown) if grown is not None else [*weights, sum(weights) / len(weights)]
    t = text_or_empty(F.col(text_col))
    key = F.coalesce(F.col("id").cast("string"), F.lit("\x00null"))
    rows = (docs.select(F.col(id_col).alias("id"), (F.octet_length(t) + 1).cast("long").alias("size"),
                        F.crc32(t.cast("binary")).alias("text_crc32"))
            .withColumn("shard", rendezvous_shard(key, weights))
            .withColumn("grown_shard", rendezvous_shard(key, grown)))
    rows = stage(rows, "sharded")
    slices = max(1, -(-rows.count() // (slice_rows * len(weights))))
    # the slice also takes size and CRC in, so that a repeated id does not fill one slice
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("id", "size", "text_crc32"), F.lit(slices)))
    counts = rows.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "slice").orderBy("id", "size", "text_crc32")
    numbered = rows.withColumn("at", F.row_number().over(within) - 1)
    return (numbered.join(offsets, ["shard", "slice"])
            .select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("offset") + F.col("at")).cast("long").alias("slot"), "grown_shard"))
