import random
import zlib

from quern.llm import toxicity as X
from tests.llm.conftest import sentences


def corpus(n=1200):
    """Some texts have invented insults, some words of an over-used stem."""
    r, docs, labels = random.Random(1), [], []
    for i in range(n):
        words, toxic = sentences(i, 120).split(" "), 0
        if i % 6 == 0:
            toxic = 1
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["zorgle", "blaxen", "frintox"]) if i % 12 else "krumpf" + r.choice("abcdefgh") * 2)
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    got = X.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert sum(r["predicted"] for r in held) >= 0.85 * sum(truth[r["doc_id"]] for r in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = X.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.93 * len(got)


def test_labels_of_the_fold_are_not_used(spark):
    docs, labels = corpus(300)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (sorted(map(tuple, X.toxicity(df, spark.createDataFrame(x, "doc_id long, toxic int")).collect())) for x in (labels, turned))
    assert a == b


def test_grammar():
    lexer, machine = X.Lexer(), X.Machine()
    read = lambda t: {X.OUTPUTS[k]: n for k, n in enumerate(X.outputs(t, lexer, machine)[:-1]) if n}
    assert read("you are an idiot") == {("insult", True, False, False): 1}
    assert read("you are not an idiot") == {("insult", True, True, False): 1}
    assert read("she said you are an idiot") == {("insult", True, False, True): 1}
    assert read("an idiot. a moron; stupid loser") == {("insult", False, False, False): 4}
    assert read("I will kill you") == {("threat", True, False, False): 1}
    assert read("kill time") == {} and read("idiotic") == {} and read(None) == {} and read("") == {}
    score = lambda t: float(X._inputs(X.outputs(t, lexer, machine)[None]) @ X.PRIOR)
    assert score("you idiot") > score("she said you idiot") > score("you are not an idiot") > score("good day") == 0


def test_odd_rows(spark, odd, no_rows):
    labels = spark.createDataFrame([(1, 0), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    got = X.toxicity(odd, labels)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert got.count() == odd.count() and got.where("score is null or predicted <> 0").count() == 0
    assert X.toxicity(no_rows, labels).count() == 0
    assert X.toxicity(odd, labels.where("false")).where("predicted <> 0").count() == 0


def test_composition_against_the_parts_one_by_one():
    """Path sums of a random clause: each part reads what the one before it wrote."""
    r, machine = random.Random(2), X.Machine()
    parts = [p() for p in X.PARTS]
    for _ in range(500):
        classes = [r.choice((X.I, X.T, X.S, X.G, X.N, X.R, X.O, X.O)) for _ in range(r.randrange(12))]
        tape, sums, ends = classes, {}, []
        for p in parts:
            state, written = p.start, []
            for x in tape:
                state, out, weights = p.arcs[state, x]
                written.append(out)
                for w in weights:
                    sums[w] = sums.get(w, 0) + 1
            tape, ends = written, [*ends, *state]
        _, reported, target = ends
        kinds = [k for k in X.KINDS if any(w[0] == k for w in sums) and (target or k != "threat")]
        want = {(kinds[0], target, n, reported): c for (k, n), c in sums.items() if k == kinds[0]} if kinds else {}
        assert {X.OUTPUTS[k]: n for k, n in machine.read(classes)} == want


def test_each_word_has_its_own_weight():
    lexer, machine = X.Lexer(), X.Machine()
    got = {X.OUTPUTS[k]: n for k, n in enumerate(X.outputs("you idiot, not a moron", lexer, machine)[:-1]) if n}
    assert got == {("insult", True, False, False): 1, ("insult", True, True, False): 1}


def test_recall_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = X.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r["predicted"] for r in got if r["toxic"]]
    assert len(toxic) > 50 and sum(toxic) >= 0.88 * len(toxic)
    clean = [r["predicted"] for r in got if not r["toxic"]]
    assert sum(clean) <= 0.01 * len(clean)
    print(sum(toxic), len(toxic), sum(clean), len(clean))
