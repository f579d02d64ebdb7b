"""Study tables built from the generic star-schema test tables.

The operators work on three analysis tables: subjects (one row per subject),
adverse events (one row per event) and lab results (one row per result). The
test data ships a TPC-H-like star schema instead, so this module derives the
three roles from it with plain joins. Only the columns the operators use are
produced; Catalyst prunes the rest at the Parquet scan.

Role mapping (fixed, documented in the README):

subjects  <- customer + nation + region
    usubjid = c_custkey, arm = c_mktsegment, trt01a = arm (missing for every 13th
    customer), trt01p = arm ('BUILDING' for every 7th), age = c_acctbal,
    sex = 'F' for even c_custkey else 'M', race = r_name,
    saffl = 'Y' when c_acctbal >= 0 else 'N' (missing for every 17th customer)
events    <- lineitem + orders + customer + part
    usubjid = o_custkey, trta = trt01a, aebodsys = p_type, aedecod = p_brand,
    aesev = o_orderpriority, aerel = o_orderstatus, aeser = l_returnflag, saffl as above
labs      <- events + customer
    usubjid = user_id, trta = trt01a, param = event_type, aval = value,
    lbnrind = 'LOW' when value < 5, 'HIGH' when value > 100, else 'NORMAL',
    visit = calendar day of ts, saffl as above

Joins are equi-joins on keys; no broadcast hints here: customer, part and
orders grow with the scale factor, so Spark picks the strategy from sizes
(and AQE re-plans with runtime sizes, splitting skewed join partitions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortab.sources.tables import read_table

# Fixed values of the mapping (thresholds and labels).
LAB_LOW_BELOW = 5.0
LAB_HIGH_ABOVE = 100.0
FLAG_LOW, FLAG_NORMAL, FLAG_HIGH = "LOW", "NORMAL", "HIGH"


def _safety_flag(balance: F.Column) -> F.Column:
    """Missing for every 17th customer."""
    return F.when(F.col("c_custkey") % 17 != 0, F.when(balance >= 0, F.lit("Y")).otherwise(F.lit("N")))


def _actual_arm() -> F.Column:
    """The treated arm: the market segment, missing for every 13th customer."""
    return F.when(F.col("c_custkey") % 13 != 0, F.col("c_mktsegment"))


def _planned_arm() -> F.Column:
    """The planned arm: every 7th customer was planned for BUILDING."""
    return F.when(F.col("c_custkey") % 7 == 0, F.lit("BUILDING")).otherwise(F.col("c_mktsegment"))


def subjects(spark: SparkSession, base_dir: str) -> DataFrame:
    cust = read_table(spark, base_dir, "customer")
    # One row per key on the lookup side: keeps one row per subject, and lets the
    # optimizer drop the lookups entirely when no column of them is used.
    nation = read_table(spark, base_dir, "nation").select("n_nationkey", "n_regionkey") \
        .dropDuplicates(["n_nationkey"])
    region = read_table(spark, base_dir, "region").select("r_regionkey", "r_name") \
        .dropDuplicates(["r_regionkey"])
    joined = (cust.join(nation, cust.c_nationkey == nation.n_nationkey, "left")
                  .join(region, F.col("n_regionkey") == region.r_regionkey, "left"))
    return joined.select(
        F.col("c_custkey").alias("usubjid"),
        _planned_arm().alias("trt01p"),
        _actual_arm().alias("trt01a"),
        F.col("c_mktsegment").alias("arm"),
        F.col("c_acctbal").alias("age"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("sex"),
        F.col("r_name").alias("race"),
        _safety_flag(F.col("c_acctbal")).alias("saffl"),
    )


def adverse_events(spark: SparkSession, base_dir: str) -> DataFrame:
    line = read_table(spark, base_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    orders = read_table(spark, base_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    cust = read_table(spark, base_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    part = read_table(spark, base_dir, "part").select("p_partkey", "p_type", "p_brand")
    # Each side is widened before the lines meet the orders: subjects are looked up per order,
    # not per line, and a subject's lines of one order leave the last join side by side.
    treated = orders.join(cust, F.col("o_custkey") == cust.c_custkey)
    joined = (line.join(part, line.l_partkey == part.p_partkey)
                  .join(treated, F.col("l_orderkey") == treated.o_orderkey))
    return joined.select(
        F.col("o_custkey").alias("usubjid"),
        _actual_arm().alias("trta"),
        F.col("p_type").alias("aebodsys"),
        F.col("p_brand").alias("aedecod"),
        F.col("o_orderpriority").alias("aesev"),
        F.col("o_orderstatus").alias("aerel"),
        F.col("l_returnflag").alias("aeser"),
        _safety_flag(F.col("c_acctbal")).alias("saffl"),
    )


def lab_results(spark: SparkSession, base_dir: str) -> DataFrame:
    ev = read_table(spark, base_dir, "events").select("user_id", "event_type", "value", "ts")
    cust = read_table(spark, base_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    joined = ev.join(cust, ev.user_id == cust.c_custkey)
    value = F.col("value")
    return joined.select(
        F.col("user_id").alias("usubjid"),
        _actual_arm().alias("trta"),
        F.col("event_type").alias("param"),
        value.alias("aval"),
        F.when(value < LAB_LOW_BELOW, F.lit(FLAG_LOW))
         .when(value > LAB_HIGH_ABOVE, F.lit(FLAG_HIGH))
         .otherwise(F.lit(FLAG_NORMAL)).alias("lbnrind"),
        F.to_date(F.col("ts")).cast("string").alias("visit"),
        _safety_flag(F.col("c_acctbal")).alias("saffl"),
    )
