"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
WARM_UP = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = ["roundtrip_documents", "roundtrip_pages", "roundtrip_conversations", "archive_roundtrip_by_lang", "block_layout", "part_name_crc", "stream_crc_by_brand", "corruption_report", "false_marker_recovery", "multi_stream_decode", "marker_counts", "stream_checks", "file_roundtrip", "encoder_statistics"]


def started(batches):
    """Starts a Python worker on every core."""
    import quern.functions.columns  # noqa: F401

    time.sleep(0.1)
    yield from batches


def main() -> None:
    import bz2

    from pyspark.sql import SparkSession

    from quern.queries import QUERIES

    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.files.maxPartitionBytes", "2m").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(0, 64, 1, 64).mapInArrow(started, "id long").collect()
    took = {}
    for name in HEADLINES:  # each once on small tables, so that no query pays for loading code
        QUERIES[name](spark, WARM_UP).write.format("noop").mode("overwrite").save()
    for name in HEADLINES:
        began = time.time()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    # The point of comparison: the serial codec, both ways, level 9, on the same documents.
    texts = [bytes(r[0]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").selectExpr("encode(text, 'utf-8')").where("text is not null").collect()]
    began = time.time()
    size = sum(len(bz2.decompress(bz2.compress(t))) for t in texts)
    serial = time.time() - began
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rpartition("sf")[2], "serial_roundtrip_sec": round(serial, 3), "roundtrip_mb_per_sec": round(size / 1e6 / took["roundtrip_documents"], 2), "serial_mb_per_sec": round(size / 1e6 / serial, 2)}))


if __name__ == "__main__":
    main()
