import zlib

import numpy as np

from quern.llm import sharding as H


def check(df, shards=8):
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in df.collect()), key=str)
    rows = H.hilbert_shards(df, shards).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=str) == want
    by = {}
    for r in rows:
        assert r["law"] == "rows" and 0 <= r["shard"] < shards and r["grown_shard"] is None
        by.setdefault(r["shard"], []).append(r)
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for own in by.values():
        own.sort(key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
    order = [r["hilbert"] for s in sorted(by) for r in by[s]]
    assert order == sorted(order)


def test_documents(docs):
    check(docs)
    check(docs, 7)


def test_odd_rows(odd, no_rows):
    check(odd)
    assert H.hilbert_shards(no_rows).count() == 0


def test_curve():
    """It meets every cell once, and its steps go to a neighbour."""
    for bits, dims in ((5, 3), (2, 2), (3, 4), (1, 3)):
        index = H.curve(bits, dims)
        cells = np.argsort(index)
        assert sorted(index.tolist()) == list(range(1 << bits * dims))
        at = np.stack([cells >> bits * d & (1 << bits) - 1 for d in range(dims)])
        assert (np.abs(np.diff(at, axis=1)).sum(0) == 1).all()


def test_files_prune(spark, docs, tmp_path):
    path = str(tmp_path / "out")
    H.write_shards(docs, path)
    back = spark.read.parquet(path)
    assert sorted(r["doc_id"] for r in back.collect()) == sorted(r["doc_id"] for r in docs.collect())
    langs = [r[0] for r in back.groupBy("shard").agg({"lang": "collect_set"}).select("collect_set(lang)").collect()]
    assert sum(len(x) for x in langs) < 8 * 4


def test_files_keep_every_row(spark, odd, tmp_path):
    """Nulls, repeated ids and columns named like the shards."""
    from pyspark.sql import functions as F

    path = str(tmp_path / "out")
    df = odd.withColumn("shard", F.lit("mine")).withColumn("slot", F.lit(3))
    H.write_shards(df, path)
    back = spark.read.parquet(path).select(*[c if c != "shard" else F.col("_shard").alias("shard") for c in df.columns])
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(back) == rows(df)
