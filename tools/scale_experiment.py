"""Scaling experiment: the adverse-event pipeline on the test events replicated k times.

Each replica gets its own subject ids (so distinct subjects grow k-fold, not
just event rows), then ``ae_summary`` runs into the ``noop`` sink. Time and
shuffle bytes written (from Spark's event log in a fresh scratch folder) are
printed per k. Used for the numbers in PLANS.md.

    python tools/scale_experiment.py [sf_dir] [k ...]
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def _shuffle_bytes(evdir: str) -> dict:
    import zstandard

    stage_group, written = {}, {}
    for f in glob.glob(os.path.join(evdir, "*", "events_*")):
        with open(f, "rb") as fh:
            reader = zstandard.ZstdDecompressor().stream_reader(fh) if f.endswith(".zstd") else fh
            for line in io.TextIOWrapper(reader, encoding="utf-8"):
                e = json.loads(line)
                if e["Event"] == "SparkListenerJobStart":
                    group = e.get("Properties", {}).get("spark.jobGroup.id")
                    for s in e["Stage IDs"]:
                        stage_group[s] = group
                elif e["Event"] == "SparkListenerTaskEnd":
                    m = (e.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}
                    g = stage_group.get(e["Stage ID"])
                    written[g] = written.get(g, 0) + m.get("Shuffle Bytes Written", 0)
    return written


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and "/" in argv[1] else "/root/testdata/sf0.1"
    ks = [int(a) for a in argv[1:] if a.isdigit()] or [1, 4, 16]
    evdir = tempfile.mkdtemp(prefix="cohortab-evlog-")
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = (SparkSession.builder.master("local[8]").appName("cohortab-scale")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", evdir)
             .config("spark.sql.shuffle.partitions", "16").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from cohortab.plans.ae import ae_summary
    from cohortab.sources import study

    adsl0, adae0 = study.subjects(spark, sf_dir), study.adverse_events(spark, sf_dir)
    results = {}
    for k in ks:
        rep = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        adae = adae0.withColumn("_r", rep).withColumn("usubjid", F.col("usubjid") * k + F.col("_r")).drop("_r")
        adsl = adsl0.withColumn("_r", rep).withColumn("usubjid", F.col("usubjid") * k + F.col("_r")).drop("_r")
        spark.sparkContext.setJobGroup(f"warmup{k}", "warm-up")
        ae_summary(adae, adsl).write.format("noop").mode("overwrite").save()
        group = f"k{k}"
        spark.sparkContext.setJobGroup(group, group)
        t0 = time.perf_counter()
        ae_summary(adae, adsl).write.format("noop").mode("overwrite").save()
        results[group] = time.perf_counter() - t0
    spark.stop()
    written = _shuffle_bytes(evdir)
    for group, secs in results.items():
        print(f"{group:>4s}: {secs:6.2f} s, shuffle written {written.get(group, 0) / 1e6:8.1f} MB")


if __name__ == "__main__":
    main(sys.argv)
