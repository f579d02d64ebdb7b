"""Exact median per group in two passes over the data, without a whole group in one task.

Spark's exact percentile keeps a map of every distinct value of a group; for a
pooled group over a continuous column at scale that map is the whole column in
one task. Here:

1. One aggregation gives each group's count and a mergeable rank sketch (KLL).
   The sketch's quantiles a few rank errors below and above the middle bound a
   band that holds the middle value(s).
2. A second pass counts the values of the band by value, and those below it: a
   row per distinct value, about 0.1 % of a large group. The counts are written
   and summed up in value order by ``running_total`` (range partitions), and the
   value at which the running count reaches the middle rank is the median.

A sketch keeps every value of a group of at most half its size, so the middle
values of such a group are read off exactly, and without larger groups there is
no second pass.

The counts tell whether a band really held the middle. A group whose sketch
missed it (beyond the sketch's error bound) is counted again over its whole
range, so the result is exact in any case. Groups stay in tables: nothing per
group reaches the driver. NaN counts as missing, like NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortab.operators.ranking import running_total
from cohortab.sources.staging import staged

SKETCH_K = 32_768  # size of a sketch: at most some 800 KB, rank error 0.02 %
SLACK = 3.0        # rank errors on either side of the middle
_HALF, _OVER = 0.5, 0.5 + 1e-6  # the ranks of the two middle values in a sketch that keeps all values


def rank_error(k: int) -> float:
    """The published single-sided rank error (99 % confidence) of a KLL sketch of size ``k``."""
    return 2.296 / k ** 0.9021


def number(x) -> Column:
    """A value as a double, NaN as missing."""
    v = (F.col(x) if isinstance(x, str) else x).cast("double")
    return F.when(~F.isnan(v), v)


def rank_sketch(x, k: int = SKETCH_K) -> Column:
    """The aggregate that ``median_from_sketches`` starts from."""
    return F.kll_sketch_agg_double(x, F.lit(k))


def _same(keys: Sequence[str], other: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{other}{k}"))
    return cond


def _renamed(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"{prefix}{k}") for k in keys], *[c for c in df.columns if c not in keys])


def _band_counts(values: DataFrame, bands: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, v, m``: how often each value of the group's band occurs; v NULL counts the values below it."""
    joined = values.join(_renamed(bands.select(*keys, "lo", "hi"), keys, "_b_"), _same(keys, "_b_")).filter(F.col("_x") <= F.col("hi"))
    inside = F.when(F.col("_x") >= F.col("lo"), F.col("_x"))
    return joined.select(*keys, inside.alias("v")).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("m"))


def _middle() -> tuple[Column, Column]:
    """The ranks of the two middle values (equal for an odd count)."""
    n = F.col("n")
    return (n + 1 - (n + 1) % 2) / 2, (n - n % 2) / 2 + 1


def _missed(bands: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups whose middle ranks are not all inside the band."""
    got = counts.groupBy(*keys).agg(F.sum(F.when(F.col("v").isNull(), F.col("m")).otherwise(0)).alias("under"),
                                    F.sum("m").alias("upto"))
    low, high = _middle()
    return (bands.join(_renamed(got, keys, "_c_"), _same(keys, "_c_"), "left")
            .filter(F.coalesce((F.col("under") >= low) | (F.col("upto") < high), F.lit(True))).select(*keys, "n", "lo", "hi"))


def _mean_of_ends(rows: DataFrame, keys: Sequence[str], low: Column, high: Column) -> DataFrame:
    """``keys, median``: the mean of the two middle values (themselves where they are equal)."""
    ends = rows.select(*keys, low.alias("_low"), high.alias("_high"))
    mean = F.col("_low") * F.lit(0.5) + F.col("_high") * F.lit(0.5)
    return ends.select(*keys, F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(mean).alias("median"))


def median_from_sketches(sketches: DataFrame, values: DataFrame, keys: Sequence[str], k: int = SKETCH_K,
                         slack: float = SLACK) -> DataFrame:
    """``(keys..., median)`` from ``sketches (keys, n, sketch)`` of the values and ``values (keys, _x)``, NaN-free.

    ``sketches`` should be a written table: it is read a few times. Groups
    without a value (n 0) are absent.
    """
    keys = list(keys)

    def quantile(rank: float) -> Column:
        return F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, max(0.0, rank))))

    filled = sketches.filter(F.col("n") > 0)
    complete = _mean_of_ends(filled.filter(2 * F.col("n") <= k), keys, quantile(_HALF), quantile(_OVER))
    off = slack * rank_error(k)
    bands = filled.filter(2 * F.col("n") > k).select(*keys, "n", quantile(0.5 - off).alias("lo"), quantile(0.5 + off).alias("hi"))
    if bands.isEmpty():
        return complete
    values = values.filter(F.col("_x").isNotNull())
    counts = staged(_band_counts(values, bands, keys), "band-counts")
    missed, source = _missed(bands, counts, keys), counts
    if not missed.isEmpty():
        missed = staged(missed, "missed-bands")
        whole = missed.withColumn("lo", F.lit(float("-inf"))).withColumn("hi", F.lit(float("inf")))
        again = staged(_band_counts(values, whole, keys), "whole-counts")
        hit = counts.join(_renamed(missed.select(*keys), keys, "_m_"), _same(keys, "_m_"), "left_anti")
        counts, source = hit.unionByName(again), None
    # the values below the band come first in the running count
    summed = running_total(counts, keys, [F.col("v").asc_nulls_first()], F.col("m"), name="upto", of=source)
    summed = summed.filter(F.col("v").isNotNull())
    n = bands.select(*keys, "n")
    joined = summed.join(_renamed(n, keys, "_n_"), _same(keys, "_n_"))
    low, high = _middle()
    ends = joined.groupBy(*keys).agg(F.min(F.when(F.col("upto") >= low, F.col("v"))).alias("_low"),
                                     F.min(F.when(F.col("upto") >= high, F.col("v"))).alias("_high"))
    return complete.unionByName(_mean_of_ends(ends, keys, F.col("_low"), F.col("_high")))


def exact_median(df: DataFrame, keys: Sequence[str], x: str, k: int = SKETCH_K, slack: float = SLACK) -> DataFrame:
    """``(keys..., median)``: exact median of ``x`` per group; groups with no value are absent.

    ``k`` sizes the sketches and ``slack`` the bands; the result does not depend
    on them.
    """
    keys = list(keys)
    values = df.select(*keys, number(x).alias("_x")).filter(F.col("_x").isNotNull())
    sketches = values.groupBy(*keys).agg(F.count("_x").alias("n"), rank_sketch("_x", k).alias("sketch"))
    return median_from_sketches(staged(sketches, "sketches"), values, keys, k, slack)
