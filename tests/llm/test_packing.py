import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import packing as K
from quern.llm.queries import tokenizer_file


def brute_cost(cuts, penalties, length):
    best = {0: 0}
    for c, p in zip(cuts, penalties):
        best[c] = min(best[b] + length - (c - b) + p for b in best if c - length <= b < c)
    return best[cuts[-1]]


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_cheapest(seed):
    r = random.Random(seed)
    length = r.choice([5, 10, 40])
    cuts = np.cumsum([r.randint(1, length) for _ in range(r.randint(1, 60))])
    penalties = np.array([r.choice([0, 0, 3, 20]) for _ in cuts])
    out = K.plan(cuts, penalties, length)
    cost, at = 0, 0
    for c in out:
        assert 0 < c - at <= length
        cost, at = cost + length - (c - at) + int(penalties[list(cuts).index(c)]), c
    assert at == cuts[-1] and cost == brute_cost(cuts.tolist(), penalties.tolist(), length)


def check(rows, texts, tok, length=2048):
    """Every id lies in exactly one piece, and sequences have no gap."""
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in texts.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
    return len(seq) * length - sum(r["length"] for r in rows)


def test_documents(spark, docs):
    rows = K.pack(docs, tokenizer_file()).collect()
    tok = K.encoder(tokenizer_file()).tok
    padding = check(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, tok)
    assert padding < 0.03 * sum(r["length"] for r in rows) + 2048


def test_odd_rows(spark, odd, no_rows):
    named = odd.where("doc_id is not null and doc_id <> 5")
    for length in (2048, 7):
        rows = K.pack(named, tokenizer_file(), length).collect()
        check(rows, {r["doc_id"]: r["text"] for r in named.collect()}, K.encoder(tokenizer_file()).tok, length)
    rows = K.pack(odd, tokenizer_file(), with_ids=True).collect()
    assert sum(r["doc_id"] is None and r["start"] == 0 for r in rows) == 2 and sum(r["doc_id"] == 5 for r in rows) == 2
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    assert K.pack(no_rows, tokenizer_file()).count() == 0


TEXTS = ["a  b", "a \n b", "\n", "a\n", "  ", "a\n\n b", "x\tb c", " a", "a ", "<|endoftext|> z", "it's 5\n'll", None, "", "a. b, c.. d., ñ. ñ, 5. .", "　x y", "a\x00b c", "x\x85y z", "漢字. 漢字, \U0001f600 é.", "don't. I'll, we've."]


def test_segments_give_the_tokenizers_ids(docs):
    e = K.Encoder(tokenizer_file())
    texts = TEXTS + [r["text"] for r in docs.collect()]
    for _ in range(2):
        for t, (ids, ends) in zip(texts, e.many(pa.array(texts))):
            assert ids.tolist() == e.tok.encode(t or "", add_special_tokens=False).ids
            assert all(0 < x <= len(ids) for x in ends)


def test_forgetting(monkeypatch, docs):
    monkeypatch.setattr(K, "REMEMBERED", 50)
    monkeypatch.setattr(K, "PIECE", 3000)
    e = K.Encoder(tokenizer_file())
    texts = [r["text"] for r in docs.limit(60).collect()]
    for t, (ids, _) in zip(texts, e.many(pa.array(texts))):
        assert ids.tolist() == e.tok.encode(t, add_special_tokens=False).ids


def test_stretches_are_joined(monkeypatch):
    """Planned in short stretches, the stream is packed almost as well as at once."""
    r = random.Random(1)
    docs = [(i, np.arange(n := r.randint(1, 300), dtype=np.uint32), np.array(sorted({r.randint(1, n) for _ in range(n // 20)}), np.int64)) for i in range(800)]
    windows = []
    for stretch in (20, 10_000):
        monkeypatch.setattr(K, "STRETCH", stretch)
        p = K.Packer(256)
        out = [x for d in docs for x in p.add(*d)] + list(p.finish())
        assert [(i, int(a)) for i, s, ids, *_ in out for a in ids] == [(i, int(a)) for i, ids, _ in docs for a in ids]
        windows.append(p.window)
    assert windows[0] <= windows[1] * 1.02 + 1


def test_little_padding_in_many_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for n in (16, 211):
        rows = K.pack(docs.repartition(n), tokenizer_file()).collect()
        tokens, windows = sum(r["length"] for r in rows), len({r["sequence_id"] for r in rows})
        assert 2048 * windows - tokens < 0.03 * tokens


def test_punctuation_follows_from_the_word():
    """Only words and runs of punctuation are encoded, not each of their combinations."""
    e, asked = K.Encoder(tokenizer_file()), []

    class Tokenizer:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return tok.encode_batch_fast(texts, **options)

    words, tails = ["Uno", "dos", "don't", "x'll", "µé", "a1b", "漢字", "5", "q'"], ["###", ".", "'", "''", "...", "?!", ",###", "-", "$$$", "'s", "'ll.", ".5", "…"]
    text = " ".join(w + t for w in words for t in tails)
    tok, e.tok = e.tok, Tokenizer()
    ids, _ = next(e.many(pa.array([text])))
    assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids
    assert not {" dos" + t for t in tails[:9]} & set(asked) and "###" in asked
