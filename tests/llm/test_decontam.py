import pytest

from quern.llm import decontam as D
from tests.llm.conftest import sentences

ITEM = "Anna bought 12 apples for 3 dollars and then gave 4 of them to Bob while walking home with 12 kg of rice."
CHANGED = "So: Yesterday Carl bought 99 apples for 7 euros and then gave 5 of them to Dave while walking home with 99 kg of rice."
CROSSED = "So: Yesterday Carl bought 99 apples for 7 euros and then gave 5 of them to Dave while walking home with 42 kg of rice."


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="module")
def cases(spark):
    long = sentences(4, 60)
    items = [(1, ITEM), (2, long), (3, "too short"), (4, None), (None, "an item without an id is not used at all here"), (5, "five words make one window")]
    docs = [
        (1, "before it. " + ITEM + " after it"), (2, CHANGED), (3, sentences(9, 400)), (4, sentences(8, 50) + "\n" + long + "\n" + sentences(7, 50)),
        (5, long.upper()), (6, " ".join(long.split()[:25])), (7, None), (8, ""), (9, "they say five words make one window."), (10, ITEM + "\n" + long), (11, "an item without an id is not used at all here"),
    ]
    return spark.createDataFrame(docs, "doc_id long, text string"), bench(spark, items)


WANT = {(1, 1, False), (2, 1, True), (4, 2, False), (5, 2, False), (9, 5, False), (10, 1, False), (10, 2, False)}


@pytest.mark.parametrize("limit", [D.LIMIT, 0])
def test_cases(cases, monkeypatch, limit):
    """Both ways, with the items sent to the tasks and with a join."""
    monkeypatch.setattr(D, "LIMIT", limit)
    docs, items = cases
    got = {(r["doc_id"], r["item_id"], r["reparameterised"]) for r in D.matches(docs, items).collect()}
    assert got == WANT
    assert {r["doc_id"] for r in D.decontaminated(docs, items).collect()} == {3, 6, 7, 8, 11}


def test_ways_agree_on_documents(spark, docs, monkeypatch):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    small = sorted(map(tuple, D.matches(docs, items).collect()))
    monkeypatch.setattr(D, "LIMIT", 0)
    assert sorted(map(tuple, D.matches(docs, items).collect())) == small and small


def test_against_brute_force(spark, docs):
    """Verbatim passages: an item whose words all stand in a document in a row."""
    import re

    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()
    words = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    texts = [(r["doc_id"], words(r["text"])) for r in docs.collect()]
    want = {(i, b["item_id"]) for i, t in texts for b in items if words(b["text"]) in t}
    got = {(r["doc_id"], r["item_id"]) for r in D.matches(docs, spark.createDataFrame(items)).collect()}
    assert want and want <= got


def test_slots_must_correspond():
    known = D.Benchmark([(1, ITEM)])
    changed, crossed = known.find(CHANGED), known.find(CROSSED)
    assert changed[0][3] and crossed[0][1] < changed[0][1]
    swapped = "Anna gave Bob 12 of 12 and 3 of 3 for 4 of 4 to 5"
    assert D.Benchmark([(1, swapped)]).find("Zed gave Yan 1 of 2 and 3 of 4 for 5 of 6 to 7") == []


def test_names_units_and_numbers():
    kinds = lambda t: D.templates()(t)[1].tolist()
    assert kinds("We met Anna. She paid 3,50 euros; BIG words") == [False, False, True, False, False, True, True, False, False]


def test_odd_rows(spark, odd, no_rows):
    items = bench(spark, [(1, "one two three four five six seven eight"), (2, "word word word word")])
    got = sorted((r["doc_id"], r["item_id"]) for r in D.matches(odd, items).collect())
    assert got == [(1, 1), (5, 1), (5, 1), (6, 2)]
    kept = D.decontaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == 6
    assert D.matches(no_rows, items).count() == 0 and D.matches(odd, items.where("false")).count() == 0
    assert D.decontaminated(odd, items.where("false")).count() == odd.count()


APPLES = "Tom has 5 apples. Sue has 7 apples. How many apples do they have?"


def both_ways(spark, monkeypatch, docs, items):
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), bench(spark, items)
    small = sorted(map(tuple, D.matches(docs, items).collect()))
    monkeypatch.setattr(D, "LIMIT", 0)
    assert sorted(map(tuple, D.matches(docs, items).collect())) == small
    return {(d, i, changed) for d, i, _, _, changed in small}


def test_names_that_open_sentences(spark, monkeypatch):
    docs = [
        (1, "Carl has 6 apples. Jane has 9 apples. How many apples do they have?"), (2, "Yesterday Carl has 6 apples, and there Jane has 9 pears."),
        (3, "It is said that Carl has 6 apples. Jane has 9 apples, how many apples do they have?"), (4, APPLES), (5, "Carl has 6 apples. Carl has 9 pears. Why would they want more of these?"),
    ]
    assert both_ways(spark, monkeypatch, docs, [(1, APPLES)]) == {(1, 1, True), (3, 1, True), (4, 1, False)}


def test_openers_must_correspond():
    item = "Tom has a red boat here. Sue has a red car there. Tom sees the other one go by. Sue does not see it at all."
    known = D.Benchmark([(1, item)])
    renamed = known.find(item.replace("Tom", "Carl").replace("Sue", "Jane"))
    crossed = known.find("Carl has a red boat here. Jane has a red car there. Jane sees the other one go by. Carl does not see it at all.")
    assert renamed[0][2:] == (1.0, True) and (not crossed or crossed[0][2] < 1)


SLOTS = ["What is 12 + 7 * 3 - 48 / 6 + 19 * 2 - 5?", "Sort 14, 3, 27, 8, 91, 45, 6, 70 in order.", "Match Paris, Rome, Madrid, Berlin to France, Italy, Spain, Germany.", "Solve 5 + 7", "Name Bob"]


def test_copies_of_items_that_are_mostly_slots(spark, monkeypatch):
    items = list(enumerate(SLOTS))
    docs = [(k, "Some text comes before. " + x + "\nAnd more of it after.") for k, x in items] + [(10 + k, "and again " + x.lower()) for k, x in items]
    docs += [(20, "What is 13 + 8 * 4 - 49 / 7 + 20 * 3 - 6?"), (21, "Sort 1, 2, 3, 4, 5, 6, 7, 8 in order."), (22, "Solve 5 + 8, name Ann")]
    want = {(at + k, k, False) for k, _ in items for at in (0, 10)}
    assert both_ways(spark, monkeypatch, docs, items) == want


def test_part_of_an_item_that_is_mostly_slots():
    item = "Add 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12 and tell the sum of them all."
    known = D.Benchmark([(1, item)])
    assert known.find(item)[0][2:] == (1.0, False)
    assert known.find("Add 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12 and tell me.")[0][2] >= 0.5


def test_ways_agree_on_null_and_repeated_ids(spark, monkeypatch):
    rows = [(1, APPLES), (1, APPLES), (1, "a clean text with the same id as others"), (None, APPLES), (None, "a clean text"), (2, None)]
    df, items = spark.createDataFrame(rows, "doc_id long, text string"), bench(spark, [(1, APPLES)])
    seen = []
    for limit in (D.LIMIT, 0):
        monkeypatch.setattr(D, "LIMIT", limit)
        seen.append([sorted(map(tuple, x.collect()), key=str) for x in (D.matches(df, items), D.decontaminated(df, items))])
    assert seen[0] == seen[1] and len(seen[0][0]) == 3
    assert seen[0][1] == sorted([rows[2], rows[4], rows[5]], key=str)


def plain_match(item, text):
    """The rule word by word at every shift, without hashes or windows in arrays: (windows, share, changed) or None."""
    import re
    from collections import Counter

    def read(t):
        out, begins = [], True
        for w in re.findall(r"\d+(?:[.,]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[%€$£¥°]|[.!?:;\n\"«»“”(]", t):
            if w in '.!?:;\n"«»“”(':
                begins = True
                continue
            kind = "number" if w[0].isdigit() else "unit" if w.lower() in D.UNITS.split() else "name" if len(w) > 1 and w[0].isupper() and w[1:].islower() else None
            out.append((w.lower(), kind, kind == "name" and begins))
            begins = False
        return out

    a, b = read(item), read(text)
    size = min(8, len(a))
    most, good, changed = size // 2, set(), False
    for shift in range(-len(a) + size, len(b) - size + 1):
        pair = {k: (a[k], b[k + shift]) for k in range(len(a)) if 0 <= k + shift < len(b)}
        plain = {k for k, (x, y) in pair.items() if x[0] == y[0] and (not x[1] or x[2]) and (not y[1] or y[2])}
        filled = {k for k, (x, y) in pair.items() if k not in plain and x[1] and x[1] == y[1]}
        whole = [range(p, p + size) for p in range(len(a) - size + 1) if p in pair and p + size - 1 in pair]
        copied = {w[0] for w in whole if all(pair[k][0][0] == pair[k][1][0] for k in w)}
        fits = [w for w in whole if size >= 4 and all(k in plain or k in filled for k in w) and sum(k in filled for k in w) <= most]
        votes = Counter((pair[k][0][0], pair[k][1][0]) for w in fits for k in w if k in filled)
        there, back = {}, {}
        for (x, y), _ in sorted(votes.items(), key=lambda v: (-v[1], v[0])):
            if x not in there and y not in back:
                there[x], back[y] = y, x
        fits = {w[0] for w in fits if all(there[pair[k][0][0]] == pair[k][1][0] if pair[k][0][0] in there else False for k in w if k in filled)}
        good |= fits | copied
        changed |= bool(fits - copied)
    usable = {p for p in range(len(a) - size + 1) if sum(bool(x[1]) and not x[2] for x in a[p : p + size]) <= most}
    share = max(len(good) / max(1, len(a) - size + 1), len(good & usable) / len(usable) if usable else 0)
    return (len(good), share, changed) if good and (share >= 0.5 or len(good) >= 24) else None


def test_templates_against_plain_words():
    """Both ways: what is found is what the rule says, for copies, changed fillers, crossed fillers and unlike texts."""
    import random

    r = random.Random(6)
    names, units = ["Anna", "Bob", "Carl", "Dora", "Emil"], ["kg", "km", "hours", "euros"]

    def question():
        words = sentences(r.randrange(10**6), 6, 30).replace("\n", " ").replace(".", "").split()
        for _ in range(r.randrange(2, 9)):
            words.insert(r.randrange(len(words) + 1), r.choice([str(r.randrange(40)), r.choice(names), r.choice(units), f"so. {r.choice(names)}"]))
        return " ".join(words)

    def varied(t):
        swap = {x: y for group in (names, units) for x, y in zip(group, r.sample(group, len(group)))}
        return " ".join((swap.get(w) or (str(int(w) + 3) if w.isdigit() else w)) if r.random() < 0.95 else "other" for w in t.split(" "))

    found = 0
    for _ in range(300):
        item = question()
        text = " ".join(r.sample([question(), varied(item), r.choice([item, varied(item), question()])], 3))
        got = D.Benchmark([(1, item)]).find(text)
        want = plain_match(item, text)
        assert [tuple(x[1:]) for x in got] == ([want] if want else []), (item, text)
        found += bool(want)
    assert 60 < found < 300
