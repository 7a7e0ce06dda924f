import random

from quern.llm import line_dedup as L
from tests.llm.conftest import sentences
from tests.llm.test_simhash import brute_components


def brute(rows):
    lines = {}
    for i, t in rows:
        if i is not None and t:
            for k, x in enumerate(t.split("\n")):
                if n := L.normal(x):
                    lines.setdefault(n, []).append((i, k))
    sets = {n: L.shingles(n) for n in lines}

    def linked(a, b):
        x, y = sets[a], sets[b]
        return len(x & y) >= 0.8 * len(x | y)

    group = brute_components(lines, linked)
    first = {}
    for n, at in lines.items():
        first[group[n]] = min(first.get(group[n], min(at)), min(at))
    gone = {p for n, at in lines.items() for p in at} - set(first.values())
    return [(i, t if not t or i is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in rows]


def near_lines(seed, n):
    r, out = random.Random(seed), []
    for k in range(n):
        lines = [sentences(r.randrange(40), 30).replace("\n", " ") for _ in range(4)]
        if k % 3:
            w = lines[1].split(" ")
            w[r.randrange(len(w))] = "changed"
            lines[1] = " ".join(w)
        out.append((k, "\n".join(lines)))
    return out


def test_against_brute_force(spark):
    rows = near_lines(1, 80) + [(200 + k, sentences(500 + k, 120)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted((r["doc_id"], r["text"]) for r in L.dedup_lines(df).collect())
    assert got == sorted(brute(rows))


def test_documents_recall(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r["text"].split("\n") for r in L.dedup_lines(docs).collect()}
    want = {i: t.split("\n") for i, t in brute(rows)}
    left = sum(len(x) for x in want.values())
    assert abs(sum(len(x) for x in got.values()) - left) <= 0.002 * left


def test_odd_rows(spark, odd, no_rows):
    out = L.dedup_lines(odd.drop("h"))
    assert out.columns == [c for c in odd.columns if c != "h"] + ["n_lines", "n_removed"]
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    # A repeated row shares the fate of the first: both of id 5 lose the line that id 1 keeps.
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    assert L.dedup_lines(no_rows).count() == 0
    assert L.dedup_lines(odd).columns[: len(odd.columns)] == odd.columns


def test_recall_of_the_bands():
    r = random.Random(3)
    found = total = 0
    for k in range(400):
        a = sentences(k, 25).replace("\n", " ")
        w = a.split(" ")
        for _ in range(1 + k % 2):
            w[r.randrange(len(w))] = "other"
        b = " ".join(w)
        if L.alike(L.normal(a), L.normal(b)) and a != b:
            total += 1
            x, y = L.band_keys([L.normal(a), L.normal(b)])
            found += bool((x == y).any())
    assert total > 200 and found >= 0.99 * total


def test_unlike_lines_seldom_meet():
    keys = L.band_keys([L.normal(x) for k in range(300) for x in sentences(k, 100).split("\n") if L.normal(x)] + ["a", "b", "ab", "the", "it is"])
    lines = len(keys)
    same = lines * L.BANDS - len({int(x) for x in keys.ravel()})
    assert same < 0.01 * lines


def test_a_common_line(spark):
    common = "this line stands in every single document of the table, and so it is hot"
    df = spark.range(3000).selectExpr("id as doc_id", f"concat('{common}', if(id % 2 = 0, '', '!'), '\\n', 'own line of the document that nobody else has ', md5(cast(id as string)), md5(cast(id + 7 as string))) as text")
    out = L.dedup_lines(df.repartition(9))
    assert out.where("n_removed = 1").count() == 2999 and out.where("n_removed = 0").select("doc_id").first()[0] == 0


def family(seed, n):
    """Lines with a long part in common; every third one is near the line before it."""
    r, out = random.Random(seed), []
    start = "this program is free software and comes with no warranty of any kind, as of the licence: "[:80]
    for k in range(n):
        if k % 3 == 2:
            at = r.randrange(82, len(out[-1]))
            out.append(out[-1][:at] + "#" + out[-1][at + 1 :])
        else:
            out.append(start + "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=30)))
    return out


def test_a_family_of_lines(spark):
    """Many unlike lines meet in the bands, each in another task than the one like it."""
    lines = family(1, 300)
    rows = list(enumerate(lines))
    want = sorted(i for i, t in brute(rows) if t)
    assert 200 <= len(want) < 230
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(100, "doc_id")
    assert sorted(r["doc_id"] for r in L.dedup_lines(df).where("text <> ''").collect()) == want


def test_links_of_a_group():
    for lines in (family(2, 200), [L.normal(t) for _, t in near_lines(5, 60)], ["a" * k for k in range(1, 40)]):
        lines = sorted(set(lines))
        pairs = L.group_links(lines)
        assert all(L.alike(lines[i], lines[j]) for i, j in pairs)
        group = brute_components(range(len(lines)), lambda i, j: L.alike(lines[i], lines[j]))
        got = brute_components(range(len(lines)), lambda i, j: (i, j) in pairs or (j, i) in pairs)
        assert got == group


def test_each_two_lines_share_a_unit(monkeypatch):
    import numpy as np

    monkeypatch.setattr(L, "RUN", 4)
    for n in (3, 8, 15):
        units = list(L._units(np.arange(n)))
        assert len({u for u, _ in units}) == len(units) and max(len(m) for _, m in units) <= 8
        assert {(i, j) for _, m in units for i in m.tolist() for j in m.tolist()} == {(i, j) for i in range(n) for j in range(n)}


def chains(n):
    """Lines a ~ b ~ c with a and c unlike; in every band where b meets c, a meets b."""
    r, out, k = random.Random(4), [], 0
    while len(out) < n:
        k += 1
        a = "".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=110))
        i, j = r.sample(range(9, 100), 2)
        b = a[:i] + "#" + a[i + 1 :]
        c = b[:j] + "%" + b[j + 1 :]
        x, y, z = L.band_keys([a, b, c])
        if L.alike(a, b) and L.alike(b, c) and not L.alike(a, c) and (y == z).any() and (x == y)[y == z].all():
            out.append((a, b, c))
    return out


def test_a_line_does_not_stand_for_another(spark):
    """The first two lines of each chain are in one task, the third in another; then all in one."""
    rows = [(3 * k + m, x) for k, chain in enumerate(chains(20)) for m, x in enumerate(chain)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    apart = df.where("doc_id % 3 < 2").coalesce(1).unionAll(df.where("doc_id % 3 = 2").coalesce(1))
    for docs in (apart, df.coalesce(1)):
        left = L.dedup_lines(docs).where("text <> ''").collect()
        assert sorted(r["doc_id"] for r in left) == [3 * k for k in range(20)]


def test_texts_that_share_an_id(spark):
    """Each loses its own lines only, and no line goes everywhere."""
    a, b, c = (sentences(k, 12).replace("\n", " ") for k in (71, 72, 73))
    rows = [(0, a), (1, f"{a}\n{b}"), (1, f"{c}\nx {c}"), (1, f"{c}\nx {c}"), (2, c)]
    out = sorted((r["doc_id"], r["text"]) for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    left = "\n".join(t for _, t in out).split("\n")
    assert left.count(a) == 1 and left.count(b) == 1 and (0, a) in out and (1, b) in out and (2, "") in out
    assert len([t for i, t in out if i == 1 and c in t]) == 2  # a repeated row shares the fate of the first


def test_partitions_do_not_matter(spark):
    """300 near copies of one line: the same lines stay however rows are dealt out, and as many as by brute force."""
    r = random.Random(8)
    base = sentences(5, 40).replace("\n", " ").split(" ")
    rows = []
    for k in range(300):
        w = list(base)
        for at in r.sample(range(len(w)), 2):
            w[at] = f"w{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {n: sorted(x["doc_id"] for x in L.dedup_lines(df.repartition(n, "doc_id")).where("text <> ''").collect()) for n in (1, 4, 60, 211)}
    assert len(set(map(tuple, left.values()))) == 1
    want = sum(1 for _, t in brute(rows) if t)
    assert 300 - len(left[1]) >= 0.98 * (300 - want)


def test_no_task_takes_two_python_workers(spark, docs, monkeypatch):
    """What the union-find, itself a Python node, gets is written: workers that a second node needs outlive it."""
    plans = []

    def components(edges):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return real(edges)

    real = L.components
    monkeypatch.setattr(L, "components", components)
    assert L.dedup_lines(docs).count() == docs.count()
    assert len(plans) == 1 and "Arrow" not in plans[0]
