import itertools

import pytest

from quern.llm import chat as C


def brute(roles):
    best = None

    def go(k, state, cost):
        nonlocal best
        if best is not None and cost >= best:
            return
        if k == len(roles):
            total = cost + C.INSERT * len(C.ENDING[state])
            best = total if best is None else min(best, total)
            return
        for o in (C.SYSTEM, C.USER, C.ASSISTANT):
            if (state, roles[k], o) in C.OPTIONS:
                go(k + 1, o, cost + C.OPTIONS[state, roles[k], o][0])

    go(0, C.START, 0)
    return best


def cost(roles, out):
    total, state = 0, C.START
    for r, o in zip(roles, out):
        total, state = total + C.OPTIONS[state, r, o][0], o
    return total + C.INSERT * len(C.ENDING[state])


@pytest.mark.parametrize("n", range(6))
def test_cheapest(n):
    for roles in itertools.product(range(4), repeat=n):
        assert cost(roles, C.solve(list(roles))) == brute(list(roles))


def legal(text):
    roles = [x.split("|>")[0] for x in text.replace("<|end|>\n", "").split("<|")[1:]]
    if roles[:1] == ["system"]:
        roles = roles[1:]
    return roles == ["user", "assistant"] * (len(roles) // 2) and roles and text.count("<|end|>\n") == text.count("<|") - text.count("<|end|>")


def run(spark, rows, partitions=None):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        if partitions:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
        return C.format_chats(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def joined(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        out[r["conv_id"]] = out.get(r["conv_id"], "") + r["rendered"]
    return out


def test_repairs(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"),
        (2, 0, "assistant", "a"),
        (3, 0, "user", "u1"), (3, 1, "user", "u2"), (3, 2, "Bot ", "a"),
        (4, 0, "user", "u"), (4, 1, None, "x"),
        (5, 1, "user", None), (5, 1, "user", None),
        (6, 0, "system", "only <|user|> here"),
    ]
    got = joined(run(spark, rows))
    assert got[1] == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|assistant|>\na<|end|>\n"
    assert got[2] == "<|user|>\n<|end|>\n<|assistant|>\na<|end|>\n" or got[2] == "<|user|>\na<|end|>\n<|assistant|>\n<|end|>\n"
    assert got[3] == "<|user|>\nu1\nu2<|end|>\n<|assistant|>\na<|end|>\n"
    assert got[4] == "<|user|>\nu<|end|>\n<|assistant|>\nx<|end|>\n"
    assert all(legal(t) for t in got.values())
    assert "only < |user|> here" in got[6]


def test_conversations_over_many_partitions(spark):
    """One conversation has most rows; its repair costs what it costs when solved at once."""
    names = ["user", "user", "assistant", "system", None, "assistant", "human"]
    rows = [(1, k, names[k * k % 7], f"t{k}") for k in range(900)] + [(c, k, names[(c + k) % 7], "x") for c in range(2, 40) for k in range(c % 6)]
    got = run(spark, rows, 13)
    assert len(got) == len(rows) and all(legal(t) for t in joined(got).values())
    by = {}
    for r in sorted(got, key=lambda r: (r["conv_id"], r["place"])):
        by.setdefault(r["conv_id"], []).append(r)
    for own in by.values():
        assert [r["place"] for r in own] == list(range(len(own)))
        roles = [C.role_code(r["role_in"]) for r in own]
        out = [1 + C.ROLES.index(r["role_out"]) for r in own]
        assert cost(roles, out) == cost(roles, C.solve(roles))


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    out = C.format_chats(df)
    assert out.count() == df.count()
    whole = {r["conv_id"]: r["text"] for r in C.conversations(out).collect()}
    assert whole == joined(out.collect()) and all(map(legal, whole.values()))


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, place string, c int"
    rows = [(None, None, None, None, "p", 1), (None, 1, "user", "", "p", 1), (1, None, "user", "x" * 100_000, None, None), (1, None, "user", "x" * 100_000, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = C.format_chats(df).collect()
    assert len(got) == 4 and all(map(legal, joined(got).values()))
    assert C.format_chats(df.where("false")).count() == 0
