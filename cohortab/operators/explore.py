"""Exploration helpers: histogram bin counts and a deterministic preview.

``histogram`` reproduces the default binning of a classic statistics
histogram: the number of classes by Sturges' rule ``ceil(log2(n) + 1)``,
"pretty" break points (steps of 1, 2 or 5 times a power of ten) covering the
data range, right-closed bins with the lowest break included, and a tiny fuzz
(1e-7 of the bin width) so values sitting on a break fall the same way despite
rounding. Only three numbers (min, max, count) reach the driver; the bin index
is an arithmetic column and the counting is one aggregation.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortab.fixed import PREVIEW_ROWS
from cohortab.sources.tables import require_columns

# Fixed values of the documented rule: a step is 1, 2, 5 or 10 times a power of ten, and the larger of
# two neighbouring ones is preferred by the weight between them.
STEP_CHOICES = ((1, 2, 1.5), (2, 5, 2.75), (5, 10, 1.5))
DEGENERATE_SHARE = 0.75  # of the largest magnitude: the aimed step where all values are (nearly) equal
GRID_FUZZ = 1e-10        # of a step, when the range ends are rounded outward
BREAK_FUZZ = 1e-7        # of a step, when values are dealt to bins


def sturges_classes(n: int) -> int:
    return int(math.ceil(math.log2(n) + 1)) if n > 0 else 1


def round_step(width: float) -> float:
    """The round step for an aimed width."""
    power = 10.0 ** math.floor(math.log10(width))
    ratio = width / power
    for small, large, weight in STEP_CHOICES:
        if ratio <= (large + weight * small) / (1 + weight):
            return small * power
    return 10 * power


def pretty_grid(lo: float, hi: float, n: int) -> tuple[float, float, int]:
    """Round, equally spaced breaks covering [lo, hi] with about n intervals: (start, step, count).

    Break i is ``start + i*step`` for i in 0..count.
    """
    size = max(abs(lo), abs(hi))
    if hi - lo <= size * max(1, n) * 1e-15:
        width = DEGENERATE_SHARE * (size or 1.0)
    else:
        width = (hi - lo) / max(1, n)
    step = round_step(width)
    first, last = math.floor(lo / step + GRID_FUZZ), math.ceil(hi / step - GRID_FUZZ)
    if first >= last:  # one value on a break: it closes the bin below it
        first = last - 1
    start, stop = min(first * step, lo), max(last * step, hi)
    return start, (stop - start) / (last - first), last - first


def pretty_breaks(lo: float, hi: float, n: int) -> list[float]:
    start, step, k = pretty_grid(lo, hi, n)
    return [start + i * step for i in range(k + 1)]


def histogram(df: DataFrame, col: str) -> DataFrame:
    """``bin, lower, upper, mid, count, density``: one row per bin (empty bins included).

    ``density`` is ``count / (n * bin width)`` (the bars integrate to 1).
    """
    require_columns(df, col, where="histogram")
    x = F.col(col).cast("double")
    finite = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs(F.col("x")) != F.lit(float("inf")))
    vals = df.select(x.alias("x")).filter(finite)
    st = vals.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n")).collect()[0]
    spark = df.sparkSession
    if not st["n"]:
        return spark.createDataFrame(
            [], "bin long, lower double, upper double, mid double, count long, density double")
    start, width, k = pretty_grid(st["lo"], st["hi"], sturges_classes(st["n"]))
    breaks = [start + i * width for i in range(k + 1)]
    fuzz = BREAK_FUZZ * width
    idx = F.ceil((F.col("x") - F.lit(start) - F.lit(fuzz)) / F.lit(width))
    binned = vals.select(F.greatest(F.lit(1), F.least(F.lit(k), idx)).cast("long").alias("bin"))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).cast("long").alias("count"))
    edges = spark.createDataFrame(
        [(i + 1, breaks[i], breaks[i + 1], (breaks[i] + breaks[i + 1]) / 2) for i in range(k)],
        "bin long, lower double, upper double, mid double")
    # Both sides have at most k rows (k = number of bins, about log2(n)): broadcast the counts.
    count = F.coalesce("count", F.lit(0)).cast("long")
    return (edges.join(F.broadcast(counts), "bin", "left")
                 .select("bin", "lower", "upper", "mid", count.alias("count"),
                         (count / F.lit(float(st["n"]) * width)).alias("density"))
                 .orderBy("bin"))


def preview(df: DataFrame, order_by, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first ``n`` rows in a stated order (top-k per partition, then merged)."""
    cols = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in cols]).limit(n)
