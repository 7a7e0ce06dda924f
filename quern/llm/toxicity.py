"""Toxicity by a weighted finite-state grammar over clauses.

Small weighted transducers read a clause word by word. Negation writes to each word whether it is in the
reach of a negation; reported speech and target pass words on and remember what they saw; insult, threat and suspect (words of a
stem that is over-used in toxic texts) give arcs over their words a weight. Composed, one's output the
next one's input, they are one machine. A path's weight is the sum of its arcs' and its final state's label completes it: "one insult,
aimed at someone, not negated, not reported". A text's score is a logistic function of its clauses'
weights, so a denied or quoted insult counts less than a plain one, word by word.

The weights of outputs, insults missing from the word list, and stems are learned from
labelled texts.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import crc_of_id

# Word lists of the lexer.
INSULTS = "idiot idiots moron morons stupid loser losers worthless pathetic disgusting scum trash clown imbecile dumb idiota imbécil estúpido basura idiote imbécile débile ordure dummkopf abschaum"
THREATS = "kill hurt destroy murder strangle stab töten umbringen tuer matar"
TARGETS = "you your yours he him his she her they them their du dich dein ihr euch tu toi ton vous tú te vosotros usted él ella sie er il elle"
NEGATIONS = "not no never isn't aren't don't won't nicht kein keine nie pas jamais ne nunca"
REPORTS = "said says say called calls wrote writes quoted claimed sagte sagt schrieb dit disait écrit dijo dice escribió"

#: Labelled rows used for learning at most, those with the smallest hashes of their id.
SAMPLE = 8000
#: A learned insult or stem must be in so many toxic texts that no other explains, and be this precise.
GAIN, PRECISION = 4, 0.9
#: Further stems must be in this share of the toxic texts.
FREQUENT = 0.02
#: A negation reaches over so many words.
SCOPE = 3

_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")

I, T, S, G, N, R, O = range(7)  # lexer classes: insult, threat, suspect, target, negation, report, other
KINDS = ("threat", "insult", "suspect")
#: kind, aimed at someone, negated, reported
OUTPUTS = [(k, *f) for k in KINDS for f in product((False, True), repeat=3)]
_OUTPUT = {o: i for i, o in enumerate(OUTPUTS)}
#: What the outputs, the suspects' share of the words, and having several suspects count before anything is learned.
PRIOR = np.array([({"threat": 3.0, "insult": 3.0, "suspect": 0.2}[k] + 0.4 * t) * (0.2 if n else 1) * (0.4 if r else 1) for k, t, n, r in OUTPUTS] + [0.5, 1.0])
#: A stem is this long, and over-used in a text where it makes up so many words and such a share.
STEM, OFTEN, SHARE = (4, 10), 2, 0.008
#: Words whose class a worker remembers.
REMEMBERED = 500_000


class Lexer:
    """Classes of words: those of the lists, learned insults, and words of learned stems."""

    def __init__(self, insults=(), stems=()):
        self.fixed = dict.fromkeys(insults, I)
        for c, words in ((R, REPORTS), (N, NEGATIONS), (G, TARGETS), (T, THREATS), (I, INSULTS)):
            self.fixed |= dict.fromkeys(words.split(), c)
        self.stems, self.sizes, self.known = frozenset(stems), sorted({len(x) for x in stems}), {}

    def __call__(self, word: str) -> int:
        if (c := self.known.get(word)) is None:
            c = self.fixed.get(word, S if any(word[:k] in self.stems for k in self.sizes) else O)
            if len(self.known) < REMEMBERED:
                self.known[word] = c
        return c


class Transducer:
    """``arcs``: (state, symbol) to (next state, symbol written, weights), for each state and symbol that can be met.

    States are tuples, so those of a composition are put together. Weights are names that are counted along a path.
    """

    def __init__(self, start: tuple, arcs: dict[tuple, tuple]):
        self.start, self.arcs = start, arcs

    def then(self, other: "Transducer") -> "Transducer":
        """The composition: what this one writes the other reads. Only states that can be reached are made."""
        by_state: dict[tuple, list] = {}
        for (state, symbol), arc in self.arcs.items():
            by_state.setdefault(state, []).append((symbol, arc))
        n, start = len(self.start), self.start + other.start
        arcs, left, seen = {}, [start], {start}
        while left:
            state = left.pop()
            for symbol, (here, written, weights) in by_state[state[:n]]:
                there, out, more = other.arcs[state[n:], written]
                arcs[state, symbol] = here + there, out, weights + more
                if here + there not in seen:
                    seen.add(here + there)
                    left.append(here + there)
        return Transducer(start, arcs)


_CLASSES = range(7)
_WORDS = list(product(_CLASSES, (False, True)))  # a class, and whether the word is negated


def negation() -> Transducer:
    """Reads classes, writes them with whether a negation reaches the word; the state is what is left of its reach."""
    return Transducer((0,), {((s,), c): ((SCOPE if c == N else max(0, s - 1),), (c, s > 0), ()) for s in range(SCOPE + 1) for c in _CLASSES})


def remembers(cls: int) -> Transducer:
    """Passes words on; the state tells whether the class was met."""
    return Transducer((False,), {((s,), w): ((s or w[0] == cls,), w, ()) for s in (False, True) for w in _WORDS})


def weighs(kind: str, cls: int) -> Transducer:
    """Passes words on; arcs over the class weigh one of the kind, negated or not."""
    return Transducer((), {((), w): ((), w, ((kind, w[1]),) * (w[0] == cls)) for w in _WORDS})


#: The grammar's parts in the order of their composition. States: reach of a negation, reported, target met.
PARTS = (negation, lambda: remembers(R), lambda: remembers(G), *(lambda k=k, c=c: weighs(k, c) for k, c in zip(KINDS, (T, I, S))))


class Machine:
    """The composition of ``PARTS``, with numbered states and weights."""

    WEIGHTS = [(k, negated) for k in KINDS for negated in (False, True)]

    def __init__(self):
        whole = reduce(Transducer.then, [p() for p in PARTS])
        self.states = [whole.start, *sorted({s for s, _ in whole.arcs} - {whole.start})]
        number = {s: k for k, s in enumerate(self.states)}
        self.table = [[(number[n], self.WEIGHTS.index(w[0]) if w else -1) for n, _, w in (whole.arcs[s, c] for c in _CLASSES)] for s in self.states]

    def read(self, classes: list[int]) -> list[tuple[int, int]]:
        """Indices of the clause's outputs and their weights.

        They are those of the gravest kind met. A threat needs a target; without one its word is as any other.
        """
        s, table, found = 0, self.table, [0] * len(self.WEIGHTS)
        for c in classes:
            s, w = table[s][c]
            if w >= 0:
                found[w] += 1
        _, reported, target = self.states[s]
        for k, kind in enumerate(KINDS):
            if any(found[2 * k : 2 * k + 2]) and (target or kind != "threat"):
                return [(_OUTPUT[kind, target, negated, reported], n) for negated, n in zip((False, True), found[2 * k : 2 * k + 2]) if n]
        return []


def outputs(text: str | None, lexer: Lexer, machine: Machine) -> np.ndarray:
    """The weight of each output in the whole text, and at last its number of words."""
    out = np.zeros(len(OUTPUTS) + 1)
    low = (text or "").lower()
    words = _WORD.findall(low)
    out[-1] = len(words)
    key = [w for w in set(words) if lexer(w) <= S]
    if key:
        for clause in _CLAUSE.split(low):
            if any(w in clause for w in key):
                for k, n in machine.read([lexer(w) for w in _WORD.findall(clause)]):
                    out[k] += n
    return out


def _inputs(out: np.ndarray) -> np.ndarray:
    """Of rows of ``outputs``, what the weights are multiplied by."""
    suspects = out[:, [k for k, o in enumerate(OUTPUTS) if o[0] == "suspect"]].sum(1)
    return np.c_[np.minimum(out[:, :-1], 3), np.minimum(100 * suspects / np.maximum(out[:, -1], 1), 4), suspects >= OFTEN]


def _cover(found: dict[str, tuple[set[int], int]], left: set[int]) -> list[str]:
    """Patterns that explain toxic texts which no other chosen one explains, best first.

    ``found``: for each pattern the toxic texts that have it, and the number of clean ones.
    """
    sure = {w: ks for w, (ks, clean) in found.items() if len(ks) >= GAIN and len(ks) >= PRECISION * (len(ks) + clean)}
    chosen = []
    while sure and left:
        best = min(sure, key=lambda w: (-len(sure[w] & left), len(w), w))
        if len(sure[best] & left) < GAIN:
            break
        left -= sure.pop(best)
        chosen.append(best)
    return chosen


def _stems(words: list[str]) -> set[str]:
    """Stems over-used in a text."""
    n: dict[str, int] = {}
    for w in words:
        for k in range(STEM[0], min(STEM[1], len(w)) + 1):
            n[w[:k]] = n.get(w[:k], 0) + 1
    least = max(OFTEN, SHARE * len(words))
    return {p for p, c in n.items() if c >= least}


def _patterns(docs: list[tuple[set, int]]) -> dict[str, tuple[set[int], int]]:
    toxic, clean = {}, {}
    for k, (found, label) in enumerate(docs):
        if label:
            for w in found:
                toxic.setdefault(w, set()).add(k)
    for found, label in docs:
        if not label:
            for w in found:
                if w in toxic:
                    clean[w] = clean.get(w, 0) + 1
    return {w: (ks, clean.get(w, 0)) for w, ks in toxic.items()}


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards the prior weights."""
    x = np.c_[np.ones(len(x)), x]
    prior = np.r_[-3.0, PRIOR]
    pull = np.diag([0.01, *[1.0] * len(PRIOR)])
    w = prior.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pull @ (w - prior)
        w = w - np.clip(np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pull, g), -2, 2)
    return w


def _learn(batches):
    """One task over the bounded sample."""
    rows = sorted((t or "", y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    words = [_WORD.findall(t.lower()) for t, _ in rows]
    known = set(INSULTS.split())
    left = {k for k, (_, y) in enumerate(rows) if y and not known & set(words[k])}
    # Stems first: they are fewer and explain more than the single words they are in.
    found = _patterns([(_stems(w), y) for w, (_, y) in zip(words, rows)])
    stems = _cover(found, left)
    # Then those that are as precise and frequent, though other stems explain the same texts.
    least = max(GAIN, FREQUENT * sum(y for _, y in rows))
    for p, (ks, clean) in sorted(found.items(), key=lambda x: (-len(x[1][0]), len(x[0]), x[0])):
        if len(ks) >= least and len(ks) >= PRECISION * (len(ks) + clean) and not any(p.startswith(x) or x.startswith(p) for x in stems):
            stems.append(p)
    insults = _cover(_patterns([(set(w), y) for w, (_, y) in zip(words, rows)]), left)
    del words
    lexer, machine = Lexer(insults, stems), Machine()
    x = _inputs(np.array([outputs(t, lexer, machine) for t, _ in rows]).reshape(-1, len(OUTPUTS) + 1))
    w = _fit(x, np.array([y for _, y in rows], float))
    yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(k)) for x, k in ((insults, pa.string()), (stems, pa.string()), (w.tolist(), pa.float64()))], ["insults", "stems", "weights"])


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held: int = 0) -> tuple[list[str], list[str], list[float]]:
    """Insults, stems and weights from at most ``SAMPLE`` labelled rows outside the held-out fold."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & (crc_of_id("doc_id") % folds != held))
    ids = ids.select(F.col("doc_id").cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label"))
    # A label given more than once counts as its largest.
    ids = ids.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    rows = df.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).cast("string").alias("t"))
    rows = rows.join(F.broadcast(ids), F.col("_doc") == F.col("_id")).select("t", "_label")
    rows = rows.orderBy(F.xxhash64("t"), "t").limit(2 * SAMPLE)  # an id may repeat
    got = rows.coalesce(1).mapInArrow(_learn, "insults array<string>, stems array<string>, weights array<double>").collect()
    return (list(got[0]["insults"]), list(got[0]["stems"]), list(got[0]["weights"])) if got else ([], [], [-3.0, *PRIOR.tolist()])


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted, weight``, a row for each row of ``df``.

    Nothing but the text enters a score. ``weight`` is that of all outputs
    together. Null and empty texts have no clause and score as such a text. Labels with a null id or label are not used; without
    any, the prior weights hold. Repeated rows come out repeated, null ids stay null and
    count as the empty text in the fold; further columns, whatever their names, are not
    read. An empty table gives an empty table.
    """
    insults, stems, weights = learn(df, labels, id_col, text_col, label_col, folds, held)
    bias, w = weights[0], np.array(weights[1:])

    def work(batches):
        lexer, machine = Lexer(insults, stems), Machine()
        for b in batches:
            got = np.array([outputs(t, lexer, machine) for t in b.column(2).to_pylist()]).reshape(-1, len(OUTPUTS) + 1)
            z = bias + _inputs(got) @ w
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), pa.array(got[:, :-1].sum(1), pa.float64())], ["doc_id", "held_out", "score", "predicted", "weight"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), (crc_of_id(id_col) % folds == held).alias("held_out"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int, weight double")
