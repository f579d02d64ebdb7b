"""Conflict-constrained best-fit packing of documents into fixed-size bins.

Within a group, pieces are placed largest first. Open bins are kept ordered by
residual space; from the tightest bin that fits, the search goes on to the
successor until a bin is compatible: no document of the same source and none
of the same duplicate cluster may share a bin. Each bin carries two bitmaps,
of its sources and of its clusters.

Groups are drawn by a hash of the id, of bounded expected size and as many as
the table needs; they are independent, so documents of one source or cluster
spread over all of them.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortab.llm.common import SPACE_CLASS, stage, text_or_empty

CAPACITY = 32_768        # bytes of a bin, about 8,000 tokens
GROUP_ROWS = 4_096       # expected pieces of a group


def best_fit(sizes, sources, clusters, capacity: int) -> list[int]:
    """Bin of each piece (in the given order); a source or cluster of -1 conflicts with none."""
    open_: list[tuple[int, int]] = []        # (residual, bin), ordered
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        s = 1 << source if source >= 0 else 0
        c = 1 << cluster if cluster >= 0 else 0
        at = bisect_left(open_, (size, -1))
        while at < len(open_) and (source_bits[open_[at][1]] & s or cluster_bits[open_[at][1]] & c):
            at += 1
        if at < len(open_):
            residual, b = open_.pop(at)
        else:
            residual, b = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        source_bits[b] |= s
        cluster_bits[b] |= c
        if residual > size:
            insort(open_, (residual - size, b))
        out.append(b)
    return out


def _pack_group(capacity: int):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["size", "id", "cluster", "piece"], ascending=[False, True, True, True],
                            na_position="last", kind="stable")
        sources = pd.factorize(df["source"])[0]                       # a null source is -1
        clusters, names = pd.factorize(df["cluster"])
        often = pd.Series(clusters).value_counts().reindex(range(len(names)), fill_value=0).to_numpy() > 1
        renumbered = (often.cumsum() - 1)[clusters]
        clusters = [int(n) if c >= 0 and often[c] else -1 for c, n in zip(clusters, renumbered)]
        df["bin"] = best_fit(df["size"].tolist(), sources.tolist(), clusters, capacity)
        return df[["id", "piece", "begin", "size", "source", "cluster", "grp", "bin"]]

    return run


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                     capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: id, piece, begin (byte), size, source, cluster, bin (string), fill (bytes in the bin).

    A document takes its UTF-8 bytes plus one separator. One longer than a bin
    is cut into full pieces and a rest; a full piece is a bin of its own. The
    duplicate cluster is the digest of the text in lower case with white space
    collapsed.

    Defined results: null and empty texts take one byte (the separator) and
    belong to no cluster; a null source conflicts with none; null ids are
    placed like others; repeated rows are one cluster and so go to different
    bins; an empty table gives an empty one; other columns are not read.
    """
    t = text_or_empty(F.col(text_col))
    folded = F.trim(F.regexp_replace(F.lower(t), SPACE_CLASS + "+", " "))
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"),
                      (F.octet_length(t) + 1).cast("long").alias("total"),
                      F.when(folded != "", F.sha2(folded, 256)).alias("cluster"))
    pieces = src.select(
        "id", "source", "cluster",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / capacity))).alias("piece"), "total")
    pieces = stage(pieces.withColumn("begin", F.col("piece") * capacity)
                   .withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("begin")))
                   .drop("total"), "pieces")
    groups = max(1, -(-pieces.count() // group_rows))
    # equal rows are numbered, so that they too are spread over all groups
    equal = ["id", "source", "cluster", "piece", "begin", "size"]
    pieces = (pieces.groupBy(*equal).agg(F.count("*").alias("times"))
              .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))))
    key = F.pmod(F.xxhash64("id", "cluster", "source", "piece", "copy"), F.lit(groups))
    pieces = pieces.withColumn("grp", key).drop("times", "copy")
    placed = (pieces.repartition(min(groups, 1 << 16), "grp").groupBy("grp")
              .applyInPandas(_pack_group(capacity), "id long, piece long, begin long, size long, source string, "
                                                    "cluster string, grp long, bin long"))
    placed = stage(placed, "packed")
    fill = placed.groupBy("grp", "bin").agg(F.sum("size").alias("fill"))
    return (placed.join(fill, ["grp", "bin"])
            .select(F.col("id").alias(id_col), "piece", "begin", "size", "source", "cluster",
                    F.concat_ws("-", "grp", "bin").alias("bin"), "fill"))
