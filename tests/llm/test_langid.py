import zlib

import numpy as np
from pyspark.sql import functions as F

from quern.llm import langid as G


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = G.identify(docs).join(docs, "doc_id").where("held_out").collect()
    assert len(got) > 250 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.99 * len(got)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and 0 <= r["score"] <= 1 for r in got)


def test_bundles_against_brute_force():
    """Each trigram's vector is bound letter by letter, and every occurrence is added."""
    text = "Ab  ba-aba, Ça"
    letters = " ab ba aba ça "
    want = sum(np.roll(G._letter_vector(ord(a)), 2) * np.roll(G._letter_vector(ord(b)), 1) * G._letter_vector(ord(c)) for a, b, c in zip(letters, letters[1:], letters[2:]))
    got = G.Space().bundles([G.trigrams(""), G.trigrams(text), G.trigrams("x")])
    assert np.allclose(got[1], want) and not got[0].any()


def test_more_trigrams_than_are_kept(monkeypatch):
    monkeypatch.setattr(G, "REMEMBERED", 3)
    a = G.trigrams("the quick brown fox jumps over the lazy dog")
    first = G.Space()
    monkeypatch.setattr(G, "REMEMBERED", 20_000)
    assert np.allclose(first.bundles([a]), G.Space().bundles([a]))


def test_predictions_learn_from_their_fold_only(spark):
    ids = [i for i in range(60)]
    rows = [(i, "aaa bbb aab" if i % 2 else "xyz zyx yxz", "one" if i % 2 else "two") for i in ids]
    wrong = [(i, t, "wrong" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows]
    got = G.identify(spark.createDataFrame(wrong, "doc_id long, text string, lang string")).collect()
    assert all(r["lang_pred"] == ("one" if r["doc_id"] % 2 else "two") for r in got)


def test_odd_rows(spark, odd, no_rows):
    got = G.identify(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (2, 3, 4))
    assert G.identify(no_rows).count() == 0
    untaught = G.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in untaught.collect()} == {"und"}
