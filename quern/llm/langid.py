"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds its letters:
each is permuted (rotated) by its place and the three are multiplied. A text's vector is
the bundle, that is the sum, of its trigrams' vectors, and a language's prototype
the bundle of all its training texts. A text gets the language whose prototype has the
largest cosine with its own vector.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import crc_of_id, remembered

DIM, EDGE = 512, 32
#: Trigram vectors a worker remembers: 2 kB each.
REMEMBERED = 20_000
#: Texts bundled by one product of matrices.
BLOCK = 48
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(8192)
def _letter_vector(code: int) -> np.ndarray:
    return np.random.default_rng(code).integers(0, 2, DIM).astype(np.float32) * 2 - 1


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of lower-cased letters, and their counts.

    What is no letter counts as one edge between words. A text without letters has none.
    """
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[c]
    if not is_letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.concatenate(([EDGE], np.where(is_letter, c, EDGE), [EDGE])).astype(np.int64)
    c = c[np.concatenate(([True], (c[1:] != EDGE) | (c[:-1] != EDGE)))]
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:], return_counts=True)


class Space:
    """Vectors of trigrams; the first ``REMEMBERED`` that a worker meets are kept."""

    def __init__(self):
        self.rows: dict[int, int] = {}
        self.table = np.empty((1024, DIM), np.float32)

    @staticmethod
    def _bound(keys) -> np.ndarray:
        out = np.empty((len(keys), DIM), np.float32)
        mask = (1 << 21) - 1
        for i, k in enumerate(keys):
            out[i] = np.roll(_letter_vector(k >> 42), 2) * np.roll(_letter_vector(k >> 21 & mask), 1) * _letter_vector(k & mask)
        return out

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        """A row for each key."""
        names = keys.tolist()
        at = list(map(self.rows.get, names))
        if None not in at:
            return self.table[at]
        new = [k for k, a in zip(names, at) if a is None]
        made, n = self._bound(new), len(self.rows)
        room = min(len(new), REMEMBERED - n)
        while n + room > len(self.table):
            self.table = np.concatenate((self.table, np.empty_like(self.table)))
        self.table[n : n + room] = made[:room]
        self.rows.update(zip(new[:room], range(n, n + room)))
        out = np.empty((len(names), DIM), np.float32)
        held = np.array([a is not None for a in at])
        out[held], out[~held] = self.table[[a for a in at if a is not None]], made
        return out

    def bundles(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The bundle of each (trigrams, counts), as one product of matrices for each block."""
        out = np.zeros((len(texts), DIM), np.float32)
        if not any(len(k) for k, _ in texts):
            return out
        keys, inverse = np.unique(np.concatenate([k for k, _ in texts]), return_inverse=True)
        owner = np.repeat(np.arange(len(texts)), [len(k) for k, _ in texts])
        counts = np.concatenate([c for _, c in texts])
        for lo in range(0, len(keys), 8192):
            part = keys[lo : lo + 8192]
            here = (inverse >= lo) & (inverse < lo + len(part)) if len(keys) > 8192 else slice(None)
            matrix = np.zeros((len(texts), len(part)), np.float32)
            matrix[owner[here], inverse[here] - lo] = counts[here]
            out += matrix @ self.vectors(part)
        return out


def space() -> Space:
    return remembered("space", Space)


def _bundles(batches):
    """Of the rows of a task: one bundle for each language, as (lang, place, value)."""
    grams: dict[str, dict[int, int]] = {}
    sums: dict[str, np.ndarray] = {}

    def flush(lang):
        g = grams.pop(lang)
        sums[lang] = sums.get(lang, 0) + space().bundles([(np.fromiter(g, np.int64, len(g)), np.fromiter(g.values(), np.int64, len(g)))])[0].astype(np.float64)

    for b in batches:
        by: dict[str, list] = {}
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            by.setdefault(lang, []).append(trigrams(text))
        for lang, found in by.items():
            keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([c for _, c in found]), len(keys)) if len(keys) else []
            g = grams.setdefault(lang, {})
            for k, c in zip(keys.tolist(), counts):
                g[k] = g.get(k, 0) + int(c)
            if len(g) > 100_000:
                flush(lang)
    for lang in list(grams):
        flush(lang)
    for lang, v in sums.items():
        if np.any(v):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(range(DIM), pa.int32()), pa.array(v.tolist(), pa.float64())], ["lang", "place", "value"])


def prototypes(train: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """A unit vector for each non-null language. Tasks bundle their own rows, so a hot
    language costs ``DIM`` rows for each task; ``DIM`` values for each language come to the driver."""
    rows = train.where(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    rows = rows.mapInArrow(_bundles, "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for r in rows.collect():
        out.setdefault(r["lang"], np.zeros(DIM))[r["place"]] = r["value"]
    return {k: v / n for k, v in sorted(out.items()) if (n := np.linalg.norm(v))}


def _predict(learned: dict[str, np.ndarray]):
    names, matrix = [*learned, UNKNOWN], np.array([v for v in learned.values()], np.float32).reshape(-1, DIM)

    def work(batches):
        for b in batches:
            texts, got = b.column(2).to_pylist(), []
            for lo in range(0, len(texts), BLOCK):
                found = [trigrams(t) for t in texts[lo : lo + BLOCK]]
                v = space().bundles(found)
                cos = v @ matrix.T / np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]
                for (keys, _), c in zip(found, cos):
                    best = int(c.argmax()) if len(keys) and len(matrix) else len(matrix)
                    got.append((best, min(1.0, max(0.0, float(c[best]))) if best < len(matrix) else 0.0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([names[i] for i, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return work


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, a row for each row of ``df``.

    Prototypes are learned from the rows whose crc32(id) mod ``folds`` is not ``held`` and
    whose language is not null. ``score`` is the cosine, 0 at least. Null texts and
    texts without a letter get ``und`` and 0, as does all if nothing could be learned.
    Equal cosines go to the first language by name. Null ids count as the empty text
    in the fold. Further columns are not read. An empty table gives an empty table.
    """
    out = crc_of_id(id_col) % folds == held
    learned = prototypes(df.where(~out), text_col, lang_col)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predict(learned), "doc_id long, held_out boolean, lang_pred string, score double")
