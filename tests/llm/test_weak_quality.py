import math
import random
import zlib
from collections import Counter
import numpy as np

from quern.llm import weak_quality as Q
from tests.llm.conftest import sentences


def test_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = Q.weak_quality(docs).join(labels, "doc_id").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 and r["kept"] == (r["score"] >= 0.5) for r in got)


def test_em_finds_accuracies():
    """Votes drawn from known accuracies; EM beats the majority of a good and two poor labellers."""
    r = np.random.default_rng(1)
    truth = r.random(20_000) < 0.7
    votes = np.stack([np.where(r.random(len(truth)) < a, truth, ~truth) * 2 - 1 for a in (0.95, 0.9, 0.6, 0.6, 0.58)], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post = Q.fit_labellers([(tuple(map(int, p)), int(c)) for p, c in zip(patterns, counts)])
    em = np.array([post[tuple(map(int, v))] >= 0.5 for v in votes])
    majority = votes.sum(1) > 0
    assert (em == truth).mean() > (majority == truth).mean() and (em == truth).mean() > 0.93
    assert Q.fit_labellers([]) == {}


def test_junk_and_prose(spark):
    good = [(i, sentences(i, 200)) for i in range(300)]
    junk = [(1000 + i, sentences(i, 150).replace(" ", " ### ")) for i in range(40)] + [(2000 + i, f"spam{i} " * 200) for i in range(20)]
    got = {r["doc_id"]: r["kept"] for r in Q.weak_quality(spark.createDataFrame(good + junk, "doc_id long, text string")).collect()}
    assert all(got[i] for i, _ in good) and sum(got[i] for i, _ in junk) <= 2


def test_odd_rows(odd, no_rows):
    got = Q.weak_quality(odd)
    assert got.count() == odd.count() and got.where("score is null or kept is null").count() == 0
    assert Q.weak_quality(no_rows).count() == 0


def test_votes():
    votes = dict(zip(Q.LABELLERS, Q.examine(sentences(1, 200))[0]))
    assert min(votes.values()) >= 0
    assert Q.examine(None)[0] == Q.examine(" \n")[0] == (-1, *[0] * 11)
    assert dict(zip(Q.LABELLERS, Q.examine("spam " * 100)[0]))["stutter"] == -1


def test_em_against_plain_rows():
    """The same EM, a row at a time without counted patterns."""
    r = random.Random(5)
    rows = [tuple(r.choice((-1, 0, 1, 1)) for _ in range(4)) for _ in range(80)]
    p = [min(0.98, max(0.02, 0.5 + sum(v) / 8)) for v in rows]
    for _ in range(100):
        odds = []
        for side in (0, 1):
            w = [q if side else 1 - q for q in p]
            share = [{x: 1.0 + sum(a for a, v in zip(w, rows) if v[k] == x) for x in (-1, 0, 1)} for k in range(4)]
            odds.append([math.log((sum(w) + 1) / (len(rows) + 2)) + sum(math.log(share[k][v[k]] / sum(share[k].values())) for k in range(4)) for v in rows])
        p = [1 / (1 + math.exp(a - b)) for a, b in zip(*odds)]
    got = Q.fit_labellers(list(Counter(rows).items()))
    assert all(abs(got[v] - q) < 1e-6 for v, q in zip(rows, p))


def test_features_against_plain_words():
    """Each word's share, and each shape's, counted one by one."""
    for t in (sentences(3, 150), "Spam spam SPAM 12 a-b!", "x"):
        words, want = t.split(), {}
        crc = lambda x: zlib.crc32(x.encode()) % Q.BINS
        for w in set(words):
            n = words.count(w)
            for b, x in ((crc(w.lower()), 0.5 * math.sqrt(n / len(words))), (crc("\0" + Q._shape(w)), 4 * n / len(words))):
                want[b] = want.get(b, 0) + x
        again = sum(a == b for a, b in zip(words, words[1:])) / len(words)
        for b, x in ((crc("\1again"), 4 * again), (crc(f"\1length{len(words).bit_length()}"), 1.0)):
            want[b] = want.get(b, 0) + x
        _, bins, values = Q.examine(t)
        got = np.bincount(bins, values, Q.BINS)
        assert {int(b) for b in np.flatnonzero(got)} == {b for b, x in want.items() if x} and all(abs(got[b] - x) < 1e-9 for b, x in want.items())


def test_codes():
    for v in ((-1,) * 12, (1,) * 12, (0, 1, -1) * 4):
        assert Q.votes_of(Q.code_of(v)) == v and 0 <= Q.code_of(v) < 3**12
