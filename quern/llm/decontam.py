"""Benchmark decontamination by templates.

A token becomes a typed placeholder if it is a number, a unit or a name, else its
lower-cased self. Windows of such template tokens are hashed and joined, so a question whose
numbers, names or units were exchanged still meets its benchmark item. A capitalised word that
opens a sentence may be a name or not, so its windows are hashed in both readings. Then the
item is laid along the document at each place where a window met, and the slots
are checked: each filler of the item must correspond to one
filler of the document and back. A document is contaminated by an item if half of the item's
windows, or a long run of them, match consistently.

Up to ``LIMIT`` characters of benchmark text the items are sent to the tasks and no
document leaves its task. A larger benchmark is joined as a table of windows, after a filter of fixed size
has left out the documents' windows that no item has.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import frozen, remembered, tidied, unused

#: Tokens in a window; an item with fewer has one window of all, with under ``LEAST`` its very words only.
WINDOW, LEAST = 8, 4
#: A window needs so many tokens, out of ``WINDOW``, that are no placeholders, unless its very words are met.
LITERAL = 4
#: Share of an item's windows, or number of windows, that must match.
SHARE, RUN = 0.5, 24
LIMIT = 2_000_000
#: Bits of the filter through which windows of documents pass before a larger benchmark is joined.
FILTER_BITS = 1 << 26
#: Distinct chunks between spaces that a worker remembers, and bytes of text looked at once.
REMEMBERED, PIECE = 300_000, 2_000_000

# Units of measure and currencies.
UNITS = "% € $ £ ¥ ° mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl l ms s sec min h hr hrs hour hours day days week weeks month months year years km/h mph kmh eur usd gbp dollar dollars cent cents euro euros pound pounds metre metres meter meters kilometre kilometres kilometer kilometers mile miles gram grams kilogram kilograms litre litres liter liters stunde stunden tag tage woche wochen jahr jahre heure heures jour jours semaine semaines an ans hora horas día días semana semanas año años"

WORD, NUMBER, UNIT, TITLE, STOP = range(5)
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[%€$£¥°]|[.!?:;\n\"«»“”(]")
_UNITS = frozenset(UNITS.split())
_STOPS = frozenset('.!?:;\n"«»“”(')
_MARKS = frozenset(".,!?:;")


def _titled(w: str) -> bool:
    return len(w) > 1 and w[0].isupper() and w[1:].islower()


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 0)


#: Hash of a placeholder, by kind.
_PLACE = np.array([0, _hash("\0number"), _hash("\0unit"), _hash("\0name"), 0], np.uint64)
_MULTIPLIERS = np.array([_hash(f"\0{k}") | 1 for k in range(WINDOW)], np.uint64)


class Templates:
    """Template hashes of texts. A worker remembers the tokens of what stands between spaces."""

    def __init__(self):
        self.benchmark: tuple | None = None
        self.forget()

    def forget(self):
        self.known: dict[str, int] = {}
        #: For each chunk its first token and how many; for each token kind and hash.
        self.first, self.count, self.kinds, self.hashes = [0], [0], [], []
        self.arrays = None

    def _add(self, chunks: list[str]) -> None:
        known, first, count, kinds, hashes = self.known, self.first, self.count, self.kinds, self.hashes
        digest = xxhash.xxh64_intdigest
        for chunk in chunks:
            known[chunk] = len(first)
            first.append(len(kinds))
            # Most chunks are a word, or a word and one mark.
            mark = chunk[-1:] if chunk[-1:] in _MARKS else ""
            word = chunk[:-1] if mark else chunk
            if word.isalpha():
                low = word.lower()
                kinds.append(UNIT if low in _UNITS else WORD if low == word or not _titled(word) else TITLE)
                hashes.append(digest(low.encode("utf-8", "surrogatepass")))
                if mark in _STOPS:
                    kinds.append(STOP)
                    hashes.append(0)
                count.append(1 + (mark in _STOPS))
                continue
            tokens = _TOKEN.findall(chunk)
            count.append(len(tokens))
            for w in tokens:
                low = w.lower()
                kinds.append(NUMBER if w[0].isdigit() else STOP if w in _STOPS else UNIT if low in _UNITS else TITLE if _titled(w) else WORD)
                hashes.append(_hash(low))

    def _tables(self) -> list[np.ndarray]:
        """The lists as arrays; only what is new since the last time is converted."""
        lists = ((self.first, np.int64), (self.count, np.int64), (self.kinds, np.int8), (self.hashes, np.uint64))
        if self.arrays is None:
            self.arrays = [np.empty(1024, k) for _, k in lists]
            self.filled = [0] * 4
        for i, (x, kind) in enumerate(lists):
            if len(x) > len(self.arrays[i]):
                self.arrays[i] = np.concatenate((self.arrays[i][: self.filled[i]], np.empty(2 * len(x) - self.filled[i], kind)))
            self.arrays[i][self.filled[i] : len(x)] = x[self.filled[i] :]
            self.filled[i] = len(x)
        return self.arrays

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.forget()
        at = list(map(self.known.get, chunks))
        if None in at:
            missing = [k for k, a in enumerate(at) if a is None]
            new = [chunks[k] for k in missing]
            self._add(new)
            for k, a in zip(missing, map(self.known.__getitem__, new)):
                at[k] = a
        return np.array(at, np.int64)

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, placeholder (0: none), and whether it is an opener, of each token but the marks, of all
        texts one after the other; and where each text's tokens begin, with the end of the last.

        A name is a capitalised word; a word in capitals throughout is none. One that begins a text, a line,
        a sentence or a quotation is an opener: a name or a plain word. Only distinct chunks are looked up.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        coded = lists.flatten().dictionary_encode()
        at = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        first, count, kinds, hashes = self._tables()
        n = count[at]
        ends = np.cumsum(n)
        token = np.repeat(first[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        bounds = np.concatenate(([0], ends))[np.cumsum([0, *pc.list_value_length(lists).to_pylist()])]
        kind = kinds[token]
        begins = np.empty(len(kind) + 1, bool)
        begins[1:] = kind == STOP
        begins[bounds] = True
        real = kind != STOP
        return hashes[token][real], _PLACE[kind][real], ((kind == TITLE) & begins[:-1])[real], np.concatenate(([0], np.cumsum(real)))[bounds]

    def one(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.many(pa.array([text], pa.string()))[:3]

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Template hash, and whether it is a slot, of each token, with openers as plain words."""
        exact, place, opener = self.one(text)
        slot = (place != 0) & ~opener
        return np.where(slot, place, exact), slot

    @staticmethod
    def tokens(text: str | None) -> list[str]:
        return [w for w in _TOKEN.findall(text or "") if w not in _STOPS]

    @staticmethod
    def windows(exact: np.ndarray, place: np.ndarray, opener: np.ndarray, size: int):
        """(hashes, places) of the windows of ``size`` tokens, reading by reading.

        Each set of a window's openers is read as names once, as long as the window has enough plain
        words. Windows with slots are also read by their very words, so a copy is met whatever its slots.
        """
        n = len(exact) - size + 1
        if n < 1:
            return

        def hashed(h):
            out = np.full(n, size, np.uint64)
            for k in range(size):
                out += h[k : k + n] * _MULTIPLIERS[k]
            return out

        with np.errstate(over="ignore"):
            if size < LEAST:
                yield hashed(exact), np.arange(n)
                return
            slot = (place != 0) & ~opener
            plain, slots, limit = hashed(np.where(slot, place, exact)), _within(slot, size), _most(size)
            at = np.flatnonzero(slots <= limit)
            yield plain[at], at
            at = np.flatnonzero(slots > 0)
            if len(at):
                yield hashed(exact)[at], at
            at = np.flatnonzero((_within(opener, size) > 0) & (slots < limit))
            code = np.zeros(len(at), np.uint8)
            for k in range(size):
                code |= opener[at + k].astype(np.uint8) << np.uint8(k)
            order = np.argsort(code, kind="stable")
            at, code = at[order], code[order]
            cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(at)]
            for a, z in zip(cuts, cuts[1:]):
                openers = [k for k in range(size) if a < z and code[a] >> k & 1]
                for m in range(1, min(limit, len(openers)) + 1):
                    rows = at[a:z][slots[at[a:z]] + m <= limit]
                    for names in combinations(openers, m) if len(rows) else ():
                        out = plain[rows]
                        for k in names:
                            out += (place[rows + k] - exact[rows + k]) * _MULTIPLIERS[k]
                        yield out, rows


def _within(flags: np.ndarray, size: int) -> np.ndarray:
    """How many of the flags are set in each window."""
    filled = np.concatenate(([0], np.cumsum(flags)))
    return filled[size:] - filled[:-size]


def _most(size: int) -> int:
    """Placeholders that a window may have."""
    return size * (WINDOW - LITERAL) // WINDOW


def templates() -> Templates:
    return remembered("templates", Templates)


def known_benchmark(items: list[tuple[int, str | None]]) -> Benchmark:
    """The windows of the items, made once in a worker."""
    memory, key = templates(), xxhash.xxh3_128_hexdigest(repr(items).encode("utf-8", "surrogatepass"))
    if memory.benchmark is None or memory.benchmark[0] != key:
        memory.benchmark = key, Benchmark(items)
    return memory.benchmark[1]


def _size(n_tokens: int) -> int:
    return min(WINDOW, n_tokens)


class Benchmark:
    """Windows of all items: sorted hashes, and the item and position of each."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.items, self.sizes = {}, set()
        found = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
        for item, text in items:
            own = templates().one(text)
            size = _size(len(own[0]))
            if not size:
                continue
            self.items[item] = (own, Templates.tokens(text), size)
            self.sizes.add(size)
            found += [(w, np.full(len(w), item, np.int64), at) for w, at in Templates.windows(*own, size)]
        hashes, owner, place = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner, self.place = hashes[order], owner[order], place[order]
        self.sorted = np.unique(hashes)
        self.may = np.zeros(1 << 20, bool)
        self.may[(self.sorted & np.uint64(len(self.may) - 1)).astype(np.int64)] = True

    def _met(self, w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        may = self.may[(w & np.uint64(len(self.may) - 1)).astype(np.int64)]
        w, at = w[may], at[may]
        if not len(w):
            return w, at
        met = self.sorted[np.minimum(np.searchsorted(self.sorted, w), len(self.sorted) - 1)] == w
        return w[met], at[met]

    def suspects(self, texts: pa.Array) -> list[int]:
        """Numbers of the texts that have any of the windows."""
        *own, bounds = templates().many(texts)
        found = set()
        for size in self.sizes:
            for reading in Templates.windows(*own, size):
                at = self._met(*reading)[1]
                text = np.searchsorted(bounds, at, "right") - 1
                found.update(text[at + size <= bounds[text + 1]].tolist())
        return sorted(found)

    def contaminated(self, texts: pa.Array):
        """(number of the text, what ``find`` tells of it) for each text of which it tells something."""
        sizes, lo = pc.binary_length(texts.cast(pa.large_string()).fill_null("")).to_numpy(zero_copy_only=False), 0
        while len(self.sorted) and lo < len(texts):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo : lo + 100_000]), PIECE)))
            part = texts[lo:hi]
            for k in self.suspects(part):
                if found := self.find(part[k].as_py()):
                    yield lo + k, found
            lo = hi

    def find(self, text: str | None) -> list[tuple[int, int, float, bool]]:
        """(item, windows, share, reparameterised) for each item that contaminates the text."""
        if not len(self.sorted):
            return []
        own, shifts = templates().one(text), defaultdict(set)
        for size in self.sizes:
            for reading in Templates.windows(*own, size):
                w, at = self._met(*reading)
                lo, hi = np.searchsorted(self.hashes, w), np.searchsorted(self.hashes, w, "right")
                for p, a, z in zip(at.tolist(), lo.tolist(), hi.tolist()):
                    for item, q in zip(self.owner[a:z].tolist(), self.place[a:z].tolist()):
                        if self.items[item][2] == size:
                            shifts[item].add(p - q)
        tokens = Templates.tokens(text) if shifts else []
        return [(item, *found) for item, at in sorted(shifts.items()) if (found := judged(*self.items[item], own, tokens, sorted(at)))]


def judged(item: tuple, item_tokens: list[str], size: int, text: tuple, tokens: list[str], shifts: list[int]) -> tuple[int, float, bool] | None:
    """Windows, share of the item's windows and whether fillers differ, or None if too little matches.

    The item is laid along the text at each shift. Equal plain words match, and placeholders of a kind. Fillers
    must correspond one to one along a shift; windows that contradict the more frequent
    correspondence do not count. Windows of the very same words count whatever their slots. The share is that of
    all windows, or of those with enough plain words, whichever is larger.
    """
    exact, place, opener = item
    n = len(exact)
    good, changed = np.zeros(n - size + 1, bool), False
    for shift in shifts:
        lo, hi = max(0, -shift), min(n, len(text[0]) - shift)
        if hi - lo < size:
            continue
        there_exact, there_place, there_opener = (x[lo + shift : hi + shift] for x in text)
        same = exact[lo:hi] == there_exact
        plain = same & ((place[lo:hi] == 0) | opener[lo:hi]) & ((there_place == 0) | there_opener)
        filled = ~plain & (place[lo:hi] != 0) & (place[lo:hi] == there_place)
        copied = _within(~same, size) == 0
        fits = (_within(~plain & ~filled, size) == 0) & (_within(filled, size) <= _most(size)) & (size >= LEAST)
        reach = np.convolve(fits, np.ones(size, np.int64))
        votes, pairs = Counter(), {}
        for k in np.flatnonzero(filled & (reach > 0)).tolist():
            pairs[k] = item_tokens[lo + k].lower(), tokens[lo + shift + k].lower()
            votes[pairs[k]] += int(reach[k])
        there, back = {}, {}
        for (a, b), _ in sorted(votes.items(), key=lambda x: (-x[1], x[0])):
            if a not in there and b not in back:
                there[a], back[b] = b, a
        against = np.zeros(hi - lo, bool)
        against[[k for k, (a, b) in pairs.items() if there.get(a) != b]] = True
        fits &= _within(against, size) == 0
        good[lo : hi - size + 1] |= fits | copied
        changed |= bool((fits & ~copied).any())
    usable = _within((place != 0) & ~opener, size) <= _most(size)
    share = max(good.mean(), good[usable].mean() if usable.any() else 0.0)
    if good.any() and (share >= SHARE or good.sum() >= RUN):
        return int(good.sum()), float(share), changed
    return None


def _small(bench: DataFrame, text_col: str) -> bool:
    n = bench.agg(F.sum(F.length(F.col(text_col).cast("string")) + 64)).first()[0]
    return (n or 0) <= LIMIT


def _items(bench: DataFrame, item_col: str, text_col: str) -> list[tuple[int, str]]:
    rows = bench.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).collect()
    return sorted((r[0], r[1] or "") for r in rows)


SCHEMA = "doc_id long, item_id long, n_windows long, share double, reparameterised boolean"


def matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, n_windows, share, reparameterised``: a row for each contaminated
    document and item, none for a clean document.

    ``n_windows`` and ``share`` count the item's windows found, ``reparameterised`` says
    that fillers differ. Null and empty texts match nothing; items with a null id are not
    used; each row is judged by itself, so a repeated document comes out repeated; an item id given twice keeps its last text in order. Other columns are
    not read. Empty tables give an empty table.
    """
    if not _small(bench, bench_text_col):
        return joined_matches(docs, bench, id_col, text_col, item_col, bench_text_col)
    items = list(dict(_items(bench, item_col, bench_text_col)).items())

    def work(batches):
        known = known_benchmark(items)
        for b in batches:
            rows = [(b.column(0)[k].as_py(), *m) for k, found in known.contaminated(b.column(1)) for m in found]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], ["doc_id", "item_id", "n_windows", "share", "reparameterised"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidied(work), SCHEMA)


def _window_rows(sizes: tuple[int, ...] | None, bitmap=None):
    """(id, key, size) for each different window in each reading; sizes None: the item's own. With a bitmap
    (a broadcast) only windows that pass it."""

    def work(batches):
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = templates().one(t)
                for size in sizes or (_size(len(own[0])),):
                    w = np.unique(np.concatenate([np.empty(0, np.uint64), *(w for w, _ in Templates.windows(*own, size) if size)]))
                    if bitmap is not None:
                        at = w & np.uint64(FILTER_BITS - 1)
                        w = w[(bitmap.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)) > 0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), i, np.int64)), pa.array(w.view(np.int64)), pa.array(np.full(len(w), size, np.int32))], ["id", "key", "size"])

    return work


def joined_matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text") -> DataFrame:
    """The same as ``matches`` for a benchmark of any size: an equi-join of window tables."""
    rows = frozen(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).withColumn("row", F.monotonically_increasing_id()))
    found = _joined(rows.select("row", "t"), bench, item_col, bench_text_col)
    return found.join(rows.select("row", "doc_id"), "row").select("doc_id", "item_id", "n_windows", "share", "reparameterised")


def _joined(rows: DataFrame, bench: DataFrame, item_col: str, bench_text_col: str) -> DataFrame:
    """The matches of ``rows`` (a key of its own for each row, and the text), by ``row``."""
    schema = "id long, key long, size int"
    named = bench.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(bench_text_col).cast("string").alias("t"))
    items = frozen(named.groupBy("item_id").agg(F.max(F.coalesce("t", F.lit(""))).alias("own")))
    b = frozen(items.mapInArrow(_window_rows(None), schema).toDF("item_id", "key", "size").distinct())
    sizes = tuple(sorted(r[0] for r in b.select("size").distinct().collect()))
    # Of the documents' windows only those that an item may have are exchanged.
    at = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = b.select(F.shiftright(at, 6).alias("w"), at.bitwiseAND(F.lit(63)).cast("int").alias("b")).groupBy("w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("bits")).toPandas()
    bitmap = np.zeros(FILTER_BITS // 64, np.uint64)
    bitmap[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    d = rows.mapInArrow(_window_rows(sizes or (WINDOW,), rows.sparkSession.sparkContext.broadcast(bitmap)), schema).toDF("row", "key", "size")
    pairs = d.join(b, ["key", "size"]).select("row", "item_id").distinct()

    def check(batches):
        for batch in batches:
            found = []
            for row, t, item, own in zip(*(batch.column(k).to_pylist() for k in range(4))):
                found += [(row, *x) for x in Benchmark([(item, own)]).find(t)]
            cols = list(zip(*found)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], ["row", "item_id", "n_windows", "share", "reparameterised"])

    return pairs.join(rows, "row").join(items, "item_id").select("row", "t", "item_id", "own").mapInArrow(tidied(check), SCHEMA.replace("doc_id", "row"))


def decontaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, all columns as they were.

    Every row is judged by itself, where it is with a small benchmark, otherwise by a key of its own.
    """
    if not _small(bench, "text"):
        name = unused("_row", docs.columns)
        rows = frozen(docs.withColumn(name, F.monotonically_increasing_id()))
        bad = _joined(rows.select(F.col(name).alias("row"), F.col("text").cast("string").alias("t")), bench, "item_id", "text")
        return rows.join(bad.select(F.col("row").alias(name)).distinct(), name, "left_anti").select(*docs.columns)
    items = list(dict(_items(bench, "item_id", "text")).items())
    at = docs.columns.index("text")

    def work(batches):
        known = known_benchmark(items)
        for b in batches:
            clean = np.ones(b.num_rows, bool)
            clean[[k for k, _ in known.contaminated(b.column(at).cast(pa.string()))]] = False
            yield b.filter(pa.array(clean))

    return docs.mapInArrow(tidied(work), docs.schema)
