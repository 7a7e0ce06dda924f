import re
from collections import Counter

import duckdb
import numpy as np

from quern.llm import quality_rules as Q


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {p for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_counts(spark, docs, odd):
    for df in (docs, odd):
        want = sorted(((r["doc_id"], *brute(r["text"])) for r in df.collect()), key=str)
        assert sorted((tuple(r)[:7] for r in Q.quality_rules(df).collect()), key=str) == want


def test_sql(spark, docs, odd):
    for df in (docs, odd):
        documents = df.select("doc_id", "text", "lang", "source").toPandas()  # noqa: F841
        want = duckdb.sql(Q.ORACLE).df()
        got = Q.quality_rules(df).toPandas()[list(want.columns)]
        key = lambda d: sorted(map(str, d.astype(object).where(d.notna(), None).replace({np.nan: None}).itertuples(index=False)))
        assert [x.replace(".0,", ",") for x in key(got)] == [x.replace(".0,", ",") for x in key(want)]


def test_empty(no_rows):
    assert Q.quality_rules(no_rows).count() == 0
    assert Q.filtered(no_rows).columns == no_rows.columns


def test_no_python_in_the_plan(spark, docs, capsys):
    Q.quality_rules(docs).explain()
    Q.measures(docs).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_junk_goes_and_the_rest_stays(spark):
    from tests.llm.conftest import sentences

    good = [(i, sentences(i, 150), "en", "a" if i % 3 else "b") for i in range(300)]
    junk = [(1000 + i, sentences(i, 100).replace(" ", " *** "), "en", "a") for i in range(30)] + [(2000 + i, sentences(i, 100).upper(), "en", "b") for i in range(30)]
    got = dict(Q.quality_rules(spark.createDataFrame(good + junk, "doc_id long, text string, lang string, source string")).select("doc_id", "kept").collect())
    assert all(got[i] for i in range(300)) and not any(got[r[0]] for r in junk)


def test_buckets():
    for v in (0, 1, 63, 64, 65, 127, 128, 1000, 123456789):
        sh = max(v.bit_length() - 6, 0)
        assert v >> sh << sh == duckdb.sql(f"SELECT {v}::BIGINT >> greatest(length(bin({v}::BIGINT)) - 6, 0) << greatest(length(bin({v}::BIGINT)) - 6, 0)").fetchall()[0][0]
        assert v - (v >> sh << sh) <= v / 32


def test_filter(spark, odd):
    assert Q.filtered(odd).count() == 0  # the long text repeats itself, the others are short


def test_thresholds_follow_the_corpus(spark):
    """The same documents are outliers among prose and usual in a source full of symbols."""
    from tests.llm.conftest import sentences

    schema = "doc_id long, text string, lang string, source string"
    prose = [(i, sentences(i, 60 + i % 200), "en", "prose") for i in range(300)]
    code = [(1000 + i, sentences(i, 60 + i % 200).replace(" ", " & ", 20 + i % 40), "en", "code") for i in range(300)]
    asked = [(2000 + i, sentences(i, 150).replace(" ", " & ", 45), "en", "prose" if i % 2 else "code") for i in range(8)]
    m = Q.frozen(Q.measures(spark.createDataFrame(prose + code + asked, schema)))
    fences = {r["source_key"]: r.asDict() for r in Q.thresholds(Q.sketches(m)).collect()}
    for k in ("symbol_rate", "word_length", "repeat_odds"):
        assert fences["prose"][f"high_{k}"] != fences["code"][f"high_{k}"]
    got = dict(Q.quality_rules(spark.createDataFrame(prose + code + asked, schema)).select("doc_id", "kept").collect())
    assert all(got[i] for i, *_ in prose + code) and [got[i] for i, *_ in asked] == [True, False] * 4
    # With the two sources' texts exchanged the verdicts are exchanged.
    turned = [(i, t, l, {"prose": "code", "code": "prose"}[s] if i < 2000 else s) for i, t, l, s in prose + code + asked]
    got = dict(Q.quality_rules(spark.createDataFrame(turned, schema)).select("doc_id", "kept").collect())
    assert [got[i] for i, *_ in asked] == [False, True] * 4


def test_ways_agree_beyond_the_broadcast(spark, docs, monkeypatch):
    want = sorted(map(tuple, Q.quality_rules(docs).collect()))
    monkeypatch.setattr(Q, "BROADCAST", 0)
    assert sorted(map(tuple, Q.quality_rules(docs).collect())) == want


def test_filter_judges_each_row(spark):
    from tests.llm.conftest import sentences

    good = sentences(1, 150)
    df = spark.createDataFrame([(1, good, "en", "a", 9), (1, "short", "en", "a", 8), (None, good, None, None, 7), (2, None, "en", "a", 6)], "doc_id long, text string, lang string, source string, row int")
    assert Q.filtered(df).columns == df.columns
    assert sorted(r["row"] for r in Q.filtered(df).collect()) == [7, 9]
