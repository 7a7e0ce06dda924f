"""Order-preserving packing of documents into sequences of a fixed length.

The documents of a partition, in their order, form one stream of tokens. A dynamic
program chooses the cuts: at the end of a document for free, at the end of a sentence or
line for a small penalty, inside a sentence for a large one. The cost of a window is the
padding it needs plus the penalty of its cut. With P(c) the penalty of cut c and L the
length of a window,

    best(c) = P(c) + L - c + min over cuts b in [c - L, c) of (best(b) + b)

so the transitions are a sliding-window minimum, which a monotone queue gives in
constant amortised time. The stream is planned in stretches of some hundred windows, whose
last ones are planned again together with what follows, so memory is bounded.
"""

from __future__ import annotations

import os
import string
import zlib
from collections import deque
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import remembered, tidied

LENGTH, END_ID = 2048, 1
#: Penalties, in tokens of padding.
SENTENCE, INSIDE = 8, 96
#: A sentence longer than twice this may be cut at its multiples.
STRIDE = 64
#: Windows planned at once, and how many of the last are planned again.
STRETCH, AGAIN = 512, 8
#: Segments whose ids a worker remembers.
REMEMBERED = 500_000

#: Bytes of input, by the optimizer's estimate, that a task gets at least: each task ends with an unfilled window.
PART = 2 << 20

#: Texts with other white space than single spaces and single line breaks, or with the mark put between segments.
_ODD = "[\\x00\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|  |\\n\\n| \\n|\\n "
_ENDS = (".", "!", "?", "…", "。")
#: Neither letters nor digits nor white space: in the tokenizer's pattern a run of them, whatever they are, is one piece.
TAILS = string.punctuation
#: How a byte-level vocabulary writes bytes: printable ones as themselves, the others as further characters in order.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_VISIBLE = {b: b for b in _PRINTED} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
#: Bytes of text encoded at once.
PIECE = 2_000_000


class Encoder:
    """Ids of texts, as the tokenizer gives them, by way of a memory of segments.

    The tokenizer's pattern always starts a new piece before a space that follows a
    non-space, and before and after a lone line break, so such a text may be encoded
    segment by segment. Of the segments of many texts only the distinct ones are looked up, and only
    unknown ones are encoded. Texts with any other white space are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their names in a text are ordinary text
        self.model = self.tok.model
        self.known: dict[str, int] = {}
        # For each segment its ids' place in ``ids``, their number, and whether a sentence ends there.
        self.first, self.size, self.ends = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, bool)
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    def _put(self, segments: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        k, n = len(self.known), len(segments)
        while k + n > len(self.first):
            self.first, self.size, self.ends = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.size, self.ends))
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids) + len(ids), np.uint32)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.known.update(zip(segments, range(k, k + n)))
        self.first[k : k + n], self.size[k : k + n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.ends[k : k + n] = [p.endswith(_ENDS) or p == "\n" for p in segments]
        self.used += len(ids)

    def _of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered segments, one after the other, and the end of each."""
        n = self.size[at]
        upto = np.cumsum(n, dtype=np.int64)
        return self.ids[np.repeat(self.first[at] - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)], upto

    def _learn(self, new: list[str]) -> None:
        # After a letter, punctuation up to the end is a piece: such a segment follows from what is before it.
        bare = [(p, b) for p in new if p[-1:] in TAILS and len(b := p.rstrip(TAILS)) > 1 and b[-1] < "ɐ" and b[-1].isalpha()]
        tailed = [p for p, _ in bare]
        base = {x for p, b in bare for x in (b, p[len(b) :])}
        whole = [p for p in dict.fromkeys([*base, *set(new).difference(tailed)]) if p not in self.known]
        # A word of Latin letters, with or without a space before it, is one piece, which the model takes as it is.
        found = [[t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(_VISIBLE))] if p.lstrip(" ").isalpha() and p[1:].isalpha() and max(p) < "ɐ" else None for p in whole]
        other = [k for k, x in enumerate(found) if x is None]
        for k, e in zip(other, self.tok.encode_batch_fast([whole[k] for k in other], add_special_tokens=False)):
            found[k] = e.ids
        self._put(whole, np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))
        if tailed:
            ids, ends = self._of(np.array([self.known[x] for p, b in bare for x in (b, p[len(b) :])], np.int64))
            self._put(tailed, ids, np.diff(ends[1::2], prepend=0))

    def _forget(self) -> None:
        for p in list(islice(reversed(self.known), len(self.known) - REMEMBERED)):
            del self.known[p]
        self.used = int(self.first[REMEMBERED])

    def _numbers(self, segments: list[str]) -> list[int]:
        at = list(map(self.known.get, segments))
        if None in at:
            missing = [k for k, a in enumerate(at) if a is None]
            new = [segments[k] for k in missing]
            self._learn(new)
            for k, a in zip(missing, map(self.known.__getitem__, new)):
                at[k] = a
        return at

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        e = self.tok.encode(text, add_special_tokens=False)
        ends = [i + 1 for i, t in enumerate(e.tokens) if t[-1:] in _ENDS or t[-1:] == "Ċ"]
        return np.array(e.ids, np.uint32), np.array(ends, np.int64)

    def many(self, texts: pa.Array):
        """For each text, null counting as empty, its ids and the offsets after which a sentence or line ends."""
        texts = texts.cast(pa.large_string()).fill_null("")
        sizes, lo = pc.binary_length(texts).to_numpy(zero_copy_only=False), 0
        while lo < len(texts):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo : lo + 100_000]), PIECE)))
            yield from self._piece(texts[lo:hi])
            lo = hi

    def _piece(self, texts: pa.Array):
        odd = pc.match_substring_regex(texts, _ODD).to_pylist()
        usual = texts.filter(pa.array([not x for x in odd]))
        marked = pc.replace_substring(pc.replace_substring(usual, " ", "\x00 "), "\n", "\x00\n\x00")
        lists = pc.split_pattern(marked, "\x00")
        coded = lists.flatten().dictionary_encode()
        numbers = np.array(self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64)
        at = numbers[coded.indices.to_numpy(zero_copy_only=False)]
        ids, upto = self._of(at)
        ends = self.ends[at]
        segments = np.cumsum([0, *pc.list_value_length(lists).to_pylist()])
        bounds = np.concatenate(([0], upto))[segments].tolist()
        segments, k = segments.tolist(), 0
        for text, whole in zip(texts, odd):
            if whole:
                yield self._whole(text.as_py())
                continue
            a, z, begin = segments[k], segments[k + 1], bounds[k]
            yield ids[begin : bounds[k + 1]], upto[a:z][ends[a:z]] - begin
            k += 1
        if len(self.known) > REMEMBERED:
            self._forget()


def encoder(path: str) -> Encoder:
    return remembered(f"encoder {path}", lambda: Encoder(path))


def plan(cuts: np.ndarray, penalties: np.ndarray, length: int = LENGTH) -> list[int]:
    """The cheapest cuts of a stream: offsets out of ``cuts``, the last one always.

    ``cuts`` ascend strictly from above 0, no two neighbours (0 included) further apart
    than ``length``. Ties go to the longer window.
    """
    at, cost = [0, *cuts.tolist()], [0, *penalties.tolist()]
    value, back = [0] * len(at), [0] * len(at)  # value: best(b) + b
    queue = deque([0])
    for k in range(1, len(at)):
        c = at[k]
        low = c - length
        while at[queue[0]] < low:
            queue.popleft()
        b = queue[0]
        back[k] = b
        value[k] = v = value[b] + cost[k] + length  # best(c) + c
        while queue and value[queue[-1]] > v:
            queue.pop()
        queue.append(k)
    out, k = [], len(at) - 1
    while k:
        out.append(at[k])
        k = back[k]
    return out[::-1]


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The different values of two ascending arrays, ascending."""
    x = np.concatenate((a, b))
    x.sort(kind="stable")  # merges the two runs
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _candidates(ends: np.ndarray, sentences: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """All places for a cut, with penalties; long gaps get some inside."""
    cuts = _merged(ends, sentences)
    before = np.concatenate(([0], cuts[:-1]))
    step = min(STRIDE, max(1, length // 2))
    extra = [np.arange(a + step, b, step) for a, b in zip(before[cuts - before > 2 * step].tolist(), cuts[cuts - before > 2 * step].tolist())]
    every = _merged(cuts, np.concatenate(extra)) if extra else cuts
    penalties = np.full(len(every), INSIDE)
    penalties[np.searchsorted(every, cuts)] = SENTENCE
    penalties[np.searchsorted(every, ends)] = 0
    return every, penalties


class Packer:
    """Takes documents in order, gives pieces: (doc_id, start, ids, doc_tokens, window, offset)."""

    def __init__(self, length: int = LENGTH):
        self.length, self.docs, self.tokens, self.window = length, [], 0, 0

    def add(self, doc_id, ids: np.ndarray, sentences: np.ndarray):
        self.docs.append((doc_id, ids, sentences, 0))
        self.tokens += len(ids)
        if self.tokens >= STRETCH * self.length:
            yield from self._emit(False)

    def finish(self):
        if self.docs:
            yield from self._emit(True)

    def _emit(self, last: bool):
        # docs: (id, ids, sentence offsets in the whole document, first id not yet emitted)
        lengths = np.array([len(d[1]) - d[3] for d in self.docs], np.int64)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        sentences = np.concatenate([d[2][d[2] > d[3]] - d[3] + b for d, b in zip(self.docs, begins.tolist())])
        cuts = plan(*_candidates(ends, sentences.astype(np.int64), self.length), self.length)
        if not last:
            cuts = cuts[:-AGAIN]
        k, left = 0, 0
        for cut in cuts:
            offset = 0
            while left < cut:
                doc_id, ids, sent, done = self.docs[k]
                n = min(cut - left, len(ids) - done)
                yield doc_id, done, ids[done : done + n], len(ids), self.window, offset
                offset, left, done = offset + n, left + n, done + n
                self.docs[k] = (doc_id, ids, sent, done)
                k += done == len(ids)
            self.window += 1
        self.docs = self.docs[k:]
        self.tokens = sum(len(d[1]) - d[3] for d in self.docs)


def _packed(path: str, length: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def work(batches):
        encode, packer = encoder(path).many, Packer(length)
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        end, rows = np.array([END_ID], np.uint32), []

        def batch():
            cols = [pa.array(c, pa.int64()) for c in zip(*(r[:7] for r in rows))]
            if with_ids:
                cols.append(pa.array([r[7] for r in rows], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(cols, names)

        def take(pieces):
            for doc_id, start, ids, total, window, offset in pieces:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, base + window, offset, *([ids.astype(np.int64)] * with_ids)))

        for b in batches:
            for doc_id, (ids, sentences) in zip(b.column(0).to_pylist(), encode(b.column(1))):
                take(packer.add(doc_id, np.concatenate((ids, end)), sentences))
                if len(rows) >= 8192:
                    yield batch()
                    rows.clear()
        take(packer.finish())
        if rows:
            yield batch()

    return work


def pack(df: DataFrame, tokenizer_path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, a row for each piece.

    Documents keep the order in which each of ``df``'s partitions holds them; there is no order across partitions. Partitions
    so small that their unfilled last windows would count are read several by one task, in turn, without a
    shuffle. ``sequence_id`` is the partition's number times 2^32 plus a
    counter. ``with_ids`` adds the piece's ids. Null and empty texts are the
    single end id; null ids stay null; a repeated row is packed again; other columns are not
    read. An empty table gives an empty table. ``tokenizer_path`` must exist on the executors.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    rows = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.coalesce(min(max(1, size // PART), 1 << 30)).mapInArrow(tidied(_packed(tokenizer_path, length, with_ids)), schema)
