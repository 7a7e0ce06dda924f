import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from quern.llm import queries


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns, name
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]
    assert counts[0] > counts[1] == counts[2] > counts[3] > counts[4] > 0


def test_run(spark, sf):
    assert P.run(spark, sf).count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    c.sql(f"create view documents as from '{sf}/documents.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), c.sql(queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    key = lambda d: d[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert key(got).equals(key(want))


def test_one_query_for_each_operator():
    names = [k for k in entry.queries() if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 11)) and "pipeline" in entry.queries()
