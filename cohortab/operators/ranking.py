"""Ranks and running totals over any number of rows, without one task that holds them all.

Rows are range-partitioned on (group, order), sorted and written once; each
partition numbers its own rows, the partitions' sums are added up on the driver
(one number per partition), and a group starts where its first row stands. No
window runs over more rows than one partition holds, so neither a single
ungrouped ranking nor a group with most of the rows ends in one task. Rows of a
written table of at most ``SMALL_BYTES`` are numbered by a plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortab.sources.staging import staged, stored_bytes

SMALL_BYTES = 256 << 10  # of Parquet, some 50,000 rows


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[Column], weight: Column | None = None,
                  name: str = "pos", of: DataFrame | None = None) -> DataFrame:
    """``df`` plus ``name``: the sum of ``weight`` (default 1) over the group's rows up to this one.

    Rows of a group are taken in ``order``; equal ones share no defined order,
    so (group, order) should name a row. Missing group values form a group.
    ``of`` may name the staged table whose rows ``df`` holds; its size tells
    whether one window can do.
    """
    group = list(group)
    if of is not None and stored_bytes(of) <= SMALL_BYTES:
        each = (F.lit(1) if weight is None else weight).cast("long")
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(each).over(w))
    by = [F.col(g).asc_nulls_first() for g in group] + list(order)
    rows = df.withColumn("_w", (F.lit(1) if weight is None else weight).cast("long"))
    rows = staged(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()),
                  "ordered")
    own = F.sum("_w").over(Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn(name, own)
    if len(rows.inputFiles()) > 1:  # else one partition holds all rows, and its own sums are the running ones
        sums = sorted(rows.groupBy("_part").agg(F.sum("_w").alias("s")).collect())  # one row per partition
        offsets = list(zip([part for part, _ in sums], accumulate((s for _, s in sums[:-1]), initial=0)))
        before = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part int, _before long"))
        out = out.join(before, "_part").withColumn(name, F.col("_before") + F.col(name))
    if group:
        starts = (out.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group])
                  .agg(F.min(F.col(name) - F.col("_w")).alias("_start")))
        cond = None
        for g in group:
            term = F.col(g).eqNullSafe(F.col(f"_g_{g}"))
            cond = term if cond is None else cond & term
        out = out.join(starts, cond).withColumn(name, F.col(name) - F.col("_start"))
    return out.select(*df.columns, name)
