"""Headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from seqspark.plans import catalog

QUERIES = [
    "sticky_dna", "egz", "g4_triplex", "rlfs_zones", "imotif_candidates", "disease_runs", "poly_at_tracts",
    "global_curvature", "zdna", "cruciform_candidates", "class_counts", "hotspot_windows", "hybrids", "cooccurrence",
    "sequence_summary", "gc_category",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    bases = catalog.sequences(spark, sf_dir).agg({"length": "sum"}).first()[0]
    registered, times = catalog.queries(), {}
    for name in QUERIES:
        begin = time.time()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - begin, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": total, "unit": "sec", "queries": times,
        "sf": sf_dir.rsplit("sf", 1)[-1], "bases": bases,
        "zdna_bases_per_sec": round(bases / times["zdna"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
