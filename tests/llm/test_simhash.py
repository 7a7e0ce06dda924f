import random
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from quern.llm import simhash
from quern.llm.components import components
from tests.llm.conftest import sentences


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(nodes), 2):
        if linked(a, b):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {n: root(n) for n in nodes}


def check(spark, df):
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in df.select("doc_id", "text").collect()]
    group = brute_components({f for _, f in rows}, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, f in rows:
        if i is not None:
            least[group[f]] = min(least.get(group[f], i), i)
    want = sorted(((i, f"{f:016x}", least.get(group[f])) for i, f in rows), key=str)
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == want
    return got


def test_documents(spark, docs):
    assert sum(i != c for i, _, c in check(spark, docs)) > 3


def test_odd_rows(spark, odd, no_rows):
    check(spark, odd)
    assert simhash.near_duplicates(no_rows).count() == 0
    assert simhash.near_duplicates(no_rows).columns == ["doc_id", "fingerprint", "component_id"]


def test_near_copies(spark):
    base = sentences(1, 900).split(" ")
    rows = []
    for k in range(60):
        r, w = random.Random(k), list(base)
        for _ in range(k % 4):
            w[r.randrange(len(w))] = f"w{k}"
        rows.append((k, " ".join(w)))
    got = check(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert len({c for _, _, c in got}) < 40


def test_links_connect_what_is_near(spark):
    """Chains, and a ball dense enough that it goes by shared points."""
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(200)}
    x = r.getrandbits(64)
    for _ in range(30):
        x ^= 1 << r.randrange(64) | 1 << r.randrange(64)
        fps.add(x)
    centre = r.getrandbits(64)
    for a, b in combinations(range(20), 2):
        fps.add(centre ^ 1 << a ^ 1 << b)
    fps.add(centre ^ 1 << 40 ^ 1 << 41 ^ 1 << 0)
    assert len(fps) > 3 * simhash.PAIRED
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    edges = [(r["u"], r["v"]) for r in simhash.links(df).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in edges)
    want = brute_components({simhash._signed(f) for f in fps}, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    got = {n: n for n in want} | {r["node"]: r["component"] for r in components(simhash.links(df)).collect()}
    assert got == want


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(500), r.randrange(500)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1400)] + [(5000, i) for i in range(5001, 5300)]
    near = {frozenset(e) for e in edges}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    want = brute_components(nodes, lambda a, b: frozenset((a, b)) in near)
    df = spark.createDataFrame(edges, "u long, v long").repartition(7)
    assert {x["node"]: x["component"] for x in components(df).collect()} == want
    assert components(df.where("false")).count() == 0
    assert components(df.select(F.lit(3).alias("u"), F.lit(3).alias("v"))).count() == 0


def test_one_of_each(spark, odd):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids == sorted([None, None, 1, 2, 6, 7], key=str)  # 3 and 4 have no words, as 2; 5 is as 1


def test_one_of_each_with_repeated_ids(spark):
    """Unlike texts with one id both stay, copies go."""
    a, b = "one text of a few words that stays as it is", "something else entirely, which has the same number"
    rows = [(1, a), (1, b), (1, a), (2, b), (3, a), (4, "a third text, all alone here"), (None, a)]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([rows[0], rows[1], rows[5], rows[6]], key=str)
