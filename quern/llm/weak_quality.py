"""A quality classifier learned without labels.

Overlapping heuristic labellers vote good, bad or nothing on each text. Expectation
maximisation over the counted vote patterns estimates how accurate each labeller is and
gives each pattern a posterior. A linear scorer over hashed word features is then trained on
the posteriors, so it also judges texts on which the labellers are silent or split.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import frozen, remembered

BINS = 1 << 14
#: Rows used to train the scorer at most, those with the smallest hashes of their text.
SAMPLE = 6000
EPOCHS, STEP = 6, 0.2
#: Distinct words whose features a worker remembers.
REMEMBERED = 500_000

_SYMBOLS = "#*$%&|<>{}[]\\^~=_@"
LABELLERS = ("length", "symbols", "marked", "letters", "word_length", "stutter", "variety", "commonest", "sentences", "capitals", "shouting", "digits")

_WORD, _SHAPE, _MARKED, _CAPITAL, _DIGIT = range(5)


class Words:
    """What a worker remembers of words: bins of word and shape, and traits."""

    def __init__(self):
        self.forget()

    def forget(self):
        self.known: dict[str, int] = {}
        self.traits = np.empty((1 << 12, 5), np.int32)

    def _add(self, w: str) -> None:
        k = len(self.known)
        if k == len(self.traits):
            self.traits = np.concatenate((self.traits, np.empty_like(self.traits)))
        self.known[w] = k
        marked = any(c in _SYMBOLS for c in w)
        self.traits[k] = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % BINS, zlib.crc32(b"\0" + _shape(w).encode("utf-8", "surrogatepass")) % BINS, marked, w.isupper() and len(w) > 1, w[0].isdigit()

    def __call__(self, words: list[str]) -> np.ndarray:
        """Numbers of the words; equal words have equal numbers."""
        if len(self.known) > REMEMBERED:
            self.forget()
        at = list(map(self.known.get, words))
        if None in at:
            for w in dict.fromkeys(words):
                if w not in self.known:
                    self._add(w)
            at = list(map(self.known.__getitem__, words))
        return np.array(at, np.int64)


def _memory() -> Words:
    return remembered("words", Words)


def _shape(w: str) -> str:
    out = []
    for c in w:
        k = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)[:12]


def _vote(good: bool, bad: bool) -> int:
    return 1 if good else -1 if bad else 0


def examine(text: str | None, votes_only: bool = False) -> tuple[tuple[int, ...], np.ndarray | None, np.ndarray | None]:
    """The votes on a whole text, one of 1 (good), -1 (bad) and 0 for each of ``LABELLERS``,
    and its features: bins and values, a bin may occur more than once."""
    t = text or ""
    words = t.split()
    n = len(words)
    own = zlib.crc32(b"\1length%d" % n.bit_length()) % BINS
    if not n:
        return (-1, *[0] * (len(LABELLERS) - 1)), np.array([own]), np.ones(1)
    memory = _memory()
    at = memory(words)
    again = float((at[1:] == at[:-1]).sum()) / n
    distinct, counts = np.unique(at, return_counts=True)
    traits = memory.traits[distinct]
    marked, upper, digits = (float(counts @ traits[:, k]) / n for k in (_MARKED, _CAPITAL, _DIGIT))
    chars = len(t) - t.count(" ") - t.count("\n")
    symbols = sum(map(t.count, _SYMBOLS))
    exclaimed, stops = t.count("!"), t.count(".") + t.count("?") + t.count("\u3002")
    others = symbols + exclaimed + sum(map(t.count, "0123456789-+/"))
    common = int(counts.max()) / n
    votes = (
        _vote(n >= 60, n < 25),
        _vote(symbols < 0.02 * n, symbols > 0.15 * n),
        _vote(marked < 0.02, marked > 0.1),
        _vote(others < 0.03 * chars, others > 0.07 * chars),
        _vote(3 <= chars / n <= 9, chars / n < 2.2 or chars / n > 13),
        _vote(again < 0.02, again > 0.1),
        _vote(len(distinct) > 0.25 * n**0.9, len(distinct) < 0.1 * n**0.9),
        _vote(common < 0.12, common > 0.3 and n >= 10),
        _vote(0.02 * n <= stops + exclaimed <= 0.3 * n, stops + exclaimed < 0.004 * n or stops + exclaimed > 0.6 * n),
        _vote(upper < 0.1, upper > 0.4),
        _vote(exclaimed < 0.05 * n, exclaimed > 0.3 * n),
        _vote(digits < 0.05, digits > 0.25),
    )
    if votes_only:
        return votes, None, None
    bins = np.concatenate((traits[:, _WORD], traits[:, _SHAPE], [zlib.crc32(b"\1again") % BINS, own]))
    return votes, bins, np.concatenate((np.sqrt(counts / n) * 0.5, counts / n * 4, [4 * again, 1.0]))


def fit_labellers(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> dict[tuple[int, ...], float]:
    """Posterior of "good" for each vote pattern, by EM over the counts of the patterns.

    Each labeller has, for good and for bad texts, its own probabilities of the three
    votes; add-one smoothing keeps them above 0. It begins from the majority of the votes.
    """
    patterns = sorted(patterns)
    if not patterns:
        return {}
    v = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    one_hot = np.stack([v == k for k in (-1, 0, 1)], 2).astype(float)  # pattern, labeller, vote
    good = np.clip(0.5 + v.sum(1) / (2 * v.shape[1]), 0.02, 0.98)
    for _ in range(rounds):
        ll = []
        for w in (n * (1 - good), n * good):
            p = np.einsum("p,plk->lk", w, one_hot) + 1.0
            p /= p.sum(1, keepdims=True)
            ll.append(math.log((w.sum() + 1) / (n.sum() + 2)) + np.einsum("plk,lk->p", one_hot, np.log(p)))
        new = 1 / (1 + np.exp(np.clip(ll[0] - ll[1], -60, 60)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return {tuple(map(int, p)): float(g) for (p, _), g in zip(patterns, good)}


def code_of(votes) -> int:
    """A vote pattern as a number: one digit to the base 3 for each labeller."""
    out = 0
    for v in votes:
        out = 3 * out + v + 1
    return out


def votes_of(code: int) -> tuple[int, ...]:
    return tuple(code // 3**k % 3 - 1 for k in reversed(range(len(LABELLERS))))


def _train(batches):
    """One task over the bounded sample: adaptive gradient steps on the soft labels."""
    rows = sorted(((t or "", y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), key=lambda r: zlib.crc32(r[0].encode("utf-8", "surrogatepass")))
    made = []
    for t, y in rows:
        _, bins, x = examine(t)
        bins, at = np.unique(bins, return_inverse=True)
        made.append((bins, np.bincount(at, x, len(bins)), y))
    w, g2, bias = np.zeros(BINS), np.full(BINS, 1e-6), 0.0
    for _ in range(EPOCHS):
        for bins, x, y in made:
            z = bias + float(w[bins] @ x)
            d = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y
            g = d * x + 1e-5 * w[bins]
            g2[bins] += g * g
            w[bins] -= STEP * g / np.sqrt(g2[bins])
            bias -= 0.02 * d
    yield pa.RecordBatch.from_arrays([pa.array([[bias, *w.tolist()]], pa.list_(pa.float64()))], ["w"])


def _voted(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([code_of(examine(t, True)[0]) for t in b.column(1).to_pylist()], pa.int32()), b.column(2)], ["doc_id", "code", "key"])


def weak_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, votes, weak_posterior, score, kept``, a row for each row of ``df``.

    ``score`` in 0 to 1 is the scorer's, ``kept`` is score >= 0.5. Null, empty and blank
    texts have no words: the length labeller finds them bad. Repeated rows count and come
    out as often as they occur; null ids stay null; other columns are not read. An
    empty table gives an empty table. To the driver come one row for each vote pattern (3^12 at most)
    and one weight for each bin; one task trains, on ``SAMPLE`` rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    key = F.xxhash64("t")
    voted = frozen(rows.select("doc_id", "t", key.alias("key")).mapInArrow(_voted, "doc_id long, code int, key long"))
    counted = [(votes_of(r["code"]), r["n"]) for r in voted.groupBy("code").agg(F.count("*").alias("n")).collect()]
    # By code, so what goes with each task has a fixed size (4 MB).
    posterior = np.full(3 ** len(LABELLERS), 0.5)
    for votes, p in fit_labellers(counted).items():
        posterior[code_of(votes)] = p
    # The sample: the texts with the smallest hashes, each once.
    heads = voted.groupBy("key").agg(F.first("code").alias("code")).orderBy("key").limit(SAMPLE).collect()
    spark = df.sparkSession
    chosen = spark.createDataFrame([(r["key"], float(posterior[r["code"]])) for r in heads], "key long, y double")
    texts = rows.select("t", key.alias("key")).join(F.broadcast(chosen), "key").select("key", "t", "y").dropDuplicates(["key"]).select("t", "y")
    got = texts.coalesce(1).mapInArrow(_train, "w array<double>").collect()
    weights = np.array(got[0]["w"]) if got else np.zeros(BINS + 1)

    def score(batches):
        w, bias = weights[1:], weights[0]
        for b in batches:
            v, z = [], []
            for t in b.column(1).to_pylist():
                votes, bins, x = examine(t)
                v.append(votes)
                z.append(bias + float(w[bins] @ x))
            s = 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(x) for x in v], pa.list_(pa.int32())), pa.array(posterior[[code_of(x) for x in v]], pa.float64()), pa.array(s, pa.float64()), pa.array(s >= 0.5)], ["doc_id", "votes", "weak_posterior", "score", "kept"])

    return rows.mapInArrow(score, "doc_id long, votes array<int>, weak_posterior double, score double, kept boolean")
