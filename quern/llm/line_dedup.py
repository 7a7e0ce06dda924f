"""Fuzzy line deduplication with MinHash.

A line is compared by its set of ``SHINGLE``-character shingles, after lower-casing and
collapsing white space. Each line gets ``BANDS`` x ``ROWS`` minima (one hash
of each shingle, dealt over bins). Lines that agree on all minima of a band are
candidates, their exact Jaccard similarity is computed, pairs of ``SIMILAR`` or more are
edges, and a distributed union-find makes components, of which the first line stays.

With nine bands of four, a pair at similarity 0.8 is a candidate with probability 0.99, one
at 0.9 with more than 0.9999.

The band table is exchanged as packed arrays, one for each task and target, sorted and
searched with numpy. Every different line of a task is in it: being alike isn't transitive, so no
line stands for another. A very common line reaches the exchange once for each task.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import frozen, stored, tidied, unused
from quern.llm.components import components

SHINGLE, BANDS, ROWS, SIMILAR = 8, 9, 4, 0.8
#: Characters hashed at once, characters whose lines a task passes on at once, and rows split at once.
PIECE, FLUSH, ROWS_AT_ONCE = 500_000, 4_000_000, 256
#: A reference counts as so many characters, so a partition of copies is passed on in parts as well.
REFERRED = 8
#: Similarities this near to ``SIMILAR`` are computed without hashing.
CLOSE = 0.01
#: A band group of up to so many different lines gives all its pairs. A larger one is compared as a
#: whole, in units of two runs of up to ``RUN`` lines, so that each two of its lines share a unit.
PAIRED, RUN = 16, 2048
#: Bits of the filter through which lines pass before their texts are exchanged.
FILTER_BITS = 1 << 25

_M = np.uint64(0x9E3779B97F4A7C15)
_F = np.uint32(0x9E3779B1)


#: White space other than a space or \n.
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def line_hash(line: str) -> int:
    """Signed 64-bit hash of a normal line."""
    h = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def alike(a: str, b: str) -> bool:
    """Whether the exact Jaccard similarity of two normal lines reaches ``SIMILAR``."""
    x, y = shingles(a), shingles(b)
    if min(len(x), len(y)) < SIMILAR * max(len(x), len(y)):
        return False
    common = len(x & y)
    return common >= SIMILAR * (len(x) + len(y) - common)


def all_alike(xs: list[str], ys: list[str]) -> list[bool]:
    """``alike`` for many pairs.

    All sets are made and intersected at once, of 32-bit hashes of the shingles. Hashes
    that agree by chance change a similarity by a few thousandths at most, so pairs that
    come within ``CLOSE`` of the bound are compared by the shingles themselves.
    """
    out: list[bool] = []
    for lo in range(0, len(xs), ROWS_AT_ONCE):
        x, y = xs[lo : lo + ROWS_AT_ONCE], ys[lo : lo + ROWS_AT_ONCE]
        sides = [_sets(x), _sets(y)]
        sizes = [np.bincount((s >> np.uint64(32)).astype(np.int64), minlength=len(x)) for s in sides]
        both = np.sort(np.concatenate(sides))
        common = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(x))
        similar = common / (sizes[0] + sizes[1] - common)
        out += [s >= SIMILAR if abs(s - SIMILAR) > CLOSE else alike(a, b) for s, a, b in zip(similar.tolist(), x, y)]
    return out


def _sets(lines: list[str]) -> np.ndarray:
    """Number of the line and hash of the shingle, for each line's different shingles, ascending."""
    h, owner, last = _windows(lines)
    inside = np.ones(len(h), bool)
    for k in range(1, SHINGLE):
        inside[last - k] = False
    keys = np.sort((owner.astype(np.uint64) << np.uint64(32) | h)[inside])
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))]


def _windows(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """32-bit hashes of all windows of ``SHINGLE`` characters over the lines put together, the
    line each begins in, and the ends of all lines but the last, before which windows reach into the next."""
    padded = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines]
    h = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    reach, factor = 1, _F
    with np.errstate(over="ignore"):
        while reach < SHINGLE:  # hashes of 1, 2, 4, then 8 characters
            h = h[:-reach] + factor * h[reach:]
            factor, reach = factor * factor, 2 * reach
        return _stir(h), np.repeat(np.arange(len(padded)), sizes)[: len(h)], np.cumsum(sizes)[:-1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _stir(h: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit values, in place."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(factor)
    h ^= h >> np.uint32(16)
    return h


def band_keys(lines: list[str]) -> np.ndarray:
    """A row of ``BANDS`` 64-bit keys for each normal, non-empty line."""
    if not lines:
        return np.empty((0, BANDS), np.uint64)
    h, owner, last = _windows(lines)
    bins = BANDS * ROWS
    with np.errstate(over="ignore"):
        # Windows that reach into the next line go to a bin of no line.
        slot = owner * bins
        slot += (h >> np.uint32(16)) * np.uint32(bins) >> np.uint32(16)
        for k in range(1, SHINGLE):
            slot[last - k] = len(lines) * bins
        value = _stir(h * _F)
        least = np.full(len(lines) * bins + 1, 0xFFFFFFFF, np.uint32)
        np.minimum.at(least, slot, value)
        least = least[:-1].reshape(-1, bins).astype(np.uint64)
        # Bins that no shingle fell into borrow from others, in an order of their own.
        empty = least == 0xFFFFFFFF
        filled, tries = least.copy(), np.random.default_rng(3)
        for _ in range(24):
            rows = np.flatnonzero(empty.any(1))
            if not len(rows):
                break
            step, part = tries.permutation(bins), least[rows]
            take = empty[rows] & (part[:, step] != 0xFFFFFFFF)
            filled[rows] = np.where(take, _mix(part[:, step] + np.arange(1, bins + 1, dtype=np.uint64) * _M), filled[rows])
            empty[rows] &= ~take
        # A line of one or few shingles may still have gaps: its smallest value serves.
        filled = np.where(empty, _mix(least.min(axis=1, keepdims=True) + np.arange(bins + 1, 2 * bins + 1, dtype=np.uint64) * _M), filled)
        keys = np.zeros((len(lines), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _M
        for r in range(ROWS):
            keys = _mix(keys * _M + filled[:, r::ROWS])
    return keys


def _lines(text: str | None):
    """Line number and normal line of every line that is not blank."""
    if not text:
        return []
    if "  " in text or _ODD.search(text):
        return [(k, n) for k, x in enumerate(text.split("\n")) if (n := normal(x))]
    return [(k, n) for k, x in enumerate(text.lower().split("\n")) if (n := x.strip(" "))]


def _slices(batches):
    """The batches in slices of few rows, so that what is made of them stays small."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS_AT_ONCE):
            yield b.slice(at, ROWS_AT_ONCE)


def _groups(keys: np.ndarray):
    """Ends of the runs of equal values in a sorted array."""
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))


def _band_tables(parts: int):
    """Packed tables (part, keys, hashes) of the bands, with every different line of a task, and references.

    A reference tells, for each document and different line of it, the line's hash ``h``, the document and a hash of its whole
    text ``own`` (texts may share an id), the first line number, and further ones (``rest``).
    """

    def work(batches):
        texts: dict[int, str] = {}
        refs: tuple[list, ...] = ([], [], [], [], [])
        size = 0

        def flush():
            hashes, lines, tables = np.fromiter(texts, np.int64, len(texts)), list(texts.values()), []
            at = total = 0
            for k, line in enumerate(lines):
                total += len(line)
                if total >= PIECE or k == len(lines) - 1:
                    tables.append(band_keys(lines[at : k + 1]))
                    at, total = k + 1, 0
            keys = np.concatenate(tables).ravel()
            owner = np.repeat(np.arange(len(lines)), BANDS)
            hs = hashes[owner]
            target = (keys % np.uint64(parts)).astype(np.int64)
            order = np.argsort(target, kind="stable")
            target, keys, hs = target[order], keys[order], hs[order]
            begins, ends = _groups(target)
            n = len(begins)
            yield pa.RecordBatch.from_arrays(
                [pa.array(target[begins], pa.int32()), pa.array([keys[a:z].tobytes() for a, z in zip(begins, ends)], pa.binary()), pa.array([hs[a:z].tobytes() for a, z in zip(begins, ends)], pa.binary()), *(pa.array([x] + [[]] * (n - 1), pa.list_(k)) for x, k in zip(refs, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()))))],
                ["part", "keys", "hashes", "h", "doc_id", "own", "line", "rest"],
            )
            texts.clear()
            for x in refs:
                x.clear()

        for b in _slices(batches):
            for doc_id, text, own in zip(*(b.column(k).to_pylist() for k in range(3))):
                at: dict[int, int] = {}
                for k, n in _lines(text):
                    h = line_hash(n)
                    if h in at:
                        refs[4][at[h]] = [*(refs[4][at[h]] or ()), k]
                        continue
                    at[h] = len(refs[0])
                    for x, value in zip(refs, (h, doc_id, own, k, None)):
                        x.append(value)
                    size += REFERRED
                    if h not in texts:
                        texts[h] = n
                        size += len(n)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if texts:
            yield from flush()

    return work


PAIR, REFERENCE, MEMBER = range(3)


def _rows(kind: int, u, v, own=None, line=None, rest=None) -> pa.RecordBatch:
    n = len(u)
    others = [pa.nulls(n, k) if x is None else x for x, k in ((own, pa.int64()), (line, pa.int32()), (rest, pa.list_(pa.int32())))]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), u, v, *others], ["kind", "u", "v", "own", "line", "rest"])


def _reduced(batches):
    """Of a task's parts: references as they came, pairs of line hashes that share a key,
    and for keys of many lines the units with their lines."""
    held: dict[int, list] = {}
    for b in batches:
        for part, keys, hashes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            held.setdefault(part, []).append((keys, hashes))
        yield _rows(REFERENCE, *(b.column(k).flatten() for k in range(3, 8)))
    for part in sorted(held):
        rows = held.pop(part)
        keys = np.frombuffer(b"".join(k for k, _ in rows), np.uint64)
        hashes = np.frombuffer(b"".join(h for _, h in rows), np.int64)
        order = np.lexsort((hashes, keys))
        keys, hashes = keys[order], hashes[order]
        fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (hashes[1:] != hashes[:-1])))
        keys, hashes = keys[fresh], hashes[fresh]
        begins, ends = _groups(keys)
        sizes = ends - begins
        u, v = [hashes[begins[sizes == 2]]], [hashes[begins[sizes == 2] + 1]]
        for a, z in zip(begins[sizes > 2].tolist(), ends[sizes > 2].tolist()):
            g = hashes[a:z]
            if len(g) <= PAIRED:
                i, j = np.triu_indices(len(g), 1)
                u.append(g[i])
                v.append(g[j])
            else:
                for unit, members in _units(g):
                    for at in range(0, len(members), 65536):
                        yield _rows(MEMBER, *(pa.array(x[at : at + 65536], pa.int64()) for x in (np.full(len(members), unit), members)))
        u, v = np.concatenate(u), np.concatenate(v)
        pairs = np.unique(np.stack((np.minimum(u, v), np.maximum(u, v))), axis=1)
        for at in range(0, pairs.shape[1], 65536):
            yield _rows(PAIR, *(pa.array(x[at : at + 65536], pa.int64()) for x in pairs))


def _units(g: np.ndarray):
    """(unit, lines) for a group's ascending hashes: each two runs are a unit. Units are named
    after the lines of the group, so bands with the same group have the same units."""
    runs = [g[at : at + RUN] for at in range(0, len(g), RUN)]
    with np.errstate(over="ignore"):
        name = _mix(_mix(g.view(np.uint64) * _M).sum(keepdims=True))
        if len(runs) == 1:
            yield name.view(np.int64)[0], g
        for i, j in combinations(range(len(runs)), 2):
            yield _mix(name + np.uint64(i * len(runs) + j + 1) * _M).view(np.int64)[0], np.concatenate((runs[i], runs[j]))


def group_links(lines: list[str]) -> list[tuple[int, int]]:
    """Pairs (by number) of alike lines that connect every two that chains of alike lines connect.

    Each two lines are compared or connected already, or are too unlike by an exact filter: of two
    alike sets the rarest shingles, as many as one may lack of the other and one more, have one in common.
    """
    n, out = len(lines), []
    root = np.arange(n)

    def join(i: int, j: int):
        if root[i] != root[j]:
            root[root == root[j]] = root[i]
            out.append((i, j))

    # Near copies are soon one component: each with the first, and neighbours in the alphabet.
    order = sorted(range(n), key=lines.__getitem__)
    ask = [(0, k) for k in range(1, n)] + list(zip(order, order[1:]))
    for pair, ok in zip(ask, all_alike([lines[i] for i, _ in ask], [lines[j] for _, j in ask])):
        if ok:
            join(*pair)
    main = np.bincount(root).argmax()
    rest = root != main
    if not rest.any():
        return out
    keys = _sets(lines)
    owner = (keys >> np.uint64(32)).astype(np.int64)
    _, token, spread = np.unique(keys & np.uint64(0xFFFFFFFF), return_inverse=True, return_counts=True)
    del keys
    size = np.bincount(owner, minlength=n)
    begin = np.cumsum(size) - size
    token = token[np.lexsort((token, spread[token], owner))]  # of each line the rarest first
    head = size - np.ceil((SIMILAR - CLOSE) * size).astype(np.int64) + 1
    of_head = np.arange(len(token)) - begin[owner] < head[owner]
    by = np.argsort(token[of_head], kind="stable")
    has = owner[of_head][by]
    at = np.searchsorted(token[of_head][by], np.arange(len(spread) + 1))
    mine, later = np.zeros(len(spread), np.int32), np.ones(n, bool)
    for a in np.flatnonzero(rest).tolist():
        later[a] = False
        meets = np.zeros(n, bool)
        own = token[begin[a] : begin[a] + size[a]]
        for t in own[: head[a]].tolist():
            meets[has[at[t] : at[t + 1]]] = True
        meets &= later & (root != root[a]) & (np.minimum(size, size[a]) >= (SIMILAR - CLOSE) * np.maximum(size, size[a]))
        others = np.flatnonzero(meets)
        for lo in range(0, len(others), ROWS_AT_ONCE):
            part = others[lo : lo + ROWS_AT_ONCE]
            k = size[part]
            starts = np.cumsum(k) - k
            mine[own] = 1
            common = np.add.reduceat(mine[token[np.repeat(begin[part] - starts, k) + np.arange(k.sum())]], starts)
            mine[own] = 0
            for b, s in zip(part.tolist(), (common / (size[a] + k - common)).tolist()):
                if s >= SIMILAR - CLOSE and root[a] != root[b] and (s > SIMILAR + CLOSE or alike(lines[a], lines[b])):
                    join(a, b)
    return out


def _linked(unit: pa.Table) -> pa.Table:
    h = unit.column("h").to_pylist()
    links = group_links(unit.column("line").to_pylist())
    return pa.table({"u": pa.array([h[i] for i, _ in links], pa.int64()), "v": pa.array([h[j] for _, j in links], pa.int64())})


def _wanted(bitmap: np.ndarray):
    """Texts of the lines whose hash passes the filter, each once in a task."""
    bits = np.uint64(FILTER_BITS - 1)

    def work(batches):
        seen: set[int] = set()
        for b in _slices(batches):
            found = [(line_hash(n), n) for text in b.column(0).to_pylist() for _, n in _lines(text)]
            h = np.array([x for x, _ in found], np.int64)
            at = h.view(np.uint64) & bits
            ok = bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)
            out = []
            for k in np.flatnonzero(ok).tolist():
                if found[k][0] not in seen:
                    seen.add(found[k][0])
                    out.append(found[k])
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([n for _, n in out], pa.string())], ["h", "line"])

    return work


def _verified(batches):
    for b in batches:
        ok = all_alike(b.column(2).to_pylist(), b.column(3).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))


def edges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``u, v``: hashes of different normal lines whose similarity was found to reach ``SIMILAR``;
    and the references ``h, doc_id, own, line, rest``."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    tables = rows.select("doc_id", "t", _own("t")).mapInArrow(tidied(_band_tables(parts)), "part int, keys binary, hashes binary, h array<long>, doc_id array<long>, own array<long>, line array<int>, rest array<array<int>>")
    # One exchange, and one table written by columns, serve all three.
    found = stored(tables.repartition(parts, "part").mapInArrow(tidied(_reduced), "kind int, u long, v long, own long, line int, rest array<int>"), "lines")
    pairs = frozen(found.where(f"kind = {PAIR}").select("u", "v").distinct())
    members = found.where(f"kind = {MEMBER}").select(F.col("u").alias("unit"), F.col("v").alias("h")).distinct()
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("h")).unionAll(members.select("h"))
    at = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = nodes.select(F.shiftright(at, 6).alias("w"), at.bitwiseAND(F.lit(63)).cast("int").alias("b")).groupBy("w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("bits")).toPandas()
    bitmap = np.zeros(FILTER_BITS // 64, np.uint64)
    bitmap[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    lines = rows.select("t").mapInArrow(tidied(_wanted(bitmap)), "h long, line string").join(nodes.distinct(), "h", "left_semi").dropDuplicates(["h"])
    lines = frozen(lines)
    both = pairs.join(lines.select(F.col("h").alias("u"), F.col("line").alias("x")), "u").join(lines.select(F.col("h").alias("v"), F.col("line").alias("y")), "v")
    grouped = members.join(lines, "h").groupBy("unit").applyInArrow(_linked, "u long, v long")
    # Written, as a task with two Python nodes takes two workers; they outlive it, take later tasks in turn, and each would remember the same.
    sure = frozen(both.select("u", "v", "x", "y").mapInArrow(tidied(_verified), "u long, v long").unionAll(grouped))
    return sure, found.where(f"kind = {REFERENCE}").select(F.col("u").alias("h"), F.col("v").alias("doc_id"), "own", "line", "rest")


def _own(text_col: str):
    """Tells texts apart that share an id."""
    return F.xxhash64(F.col(text_col).cast("string"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, own, lines, keeper_doc, keeper_line``: lines of a document that go, and the line that stays for them.

    ``own`` is the hash of the document's whole text. Of a component's lines the one with the smallest (id, hash of the text, line number) stays. ``keeper_line`` is
    null where exact copies alone are meant and the line that stays is in another document.
    """
    named = docs.where(F.col(id_col).isNotNull())
    found, refs = edges(named, id_col, text_col)
    linked = components(found)
    # The first document of each line, by a plain partial minimum, as a line may be in most documents.
    first = refs.groupBy("h").agg(F.min(F.struct("doc_id", "own")).alias("first"), F.count("*").alias("n"))
    member = first.join(linked, first["h"] == linked["node"], "left").where("n > 1 OR component IS NOT NULL").select("h", "first", F.coalesce("component", "h").alias("component"), (F.col("component").isNotNull()).alias("several"))
    member = frozen(member)
    # Which line of that document matters only where a component has several different lines.
    several = member.where("several")
    placed = refs.join(several.select("h", "first", "component"), "h").where("doc_id = first.doc_id AND own = first.own").groupBy("component").agg(F.min(F.struct("doc_id", "own", "line", "h")).alias("at"))
    keeper = several.join(placed, "component").select("h", F.col("at.doc_id").alias("keeper_doc"), F.col("at.own").alias("keeper_own"), F.col("at.h").alias("keeper_h"), F.col("at.line").alias("keeper_line"))
    keeper = keeper.unionAll(member.where("NOT several").select("h", F.col("first.doc_id").alias("keeper_doc"), F.col("first.own").alias("keeper_own"), F.col("h").alias("keeper_h"), F.lit(None).cast("int").alias("keeper_line")))
    found = refs.join(keeper.hint("shuffle_hash"), "h", "left").withColumn("stays", F.expr("keeper_h IS NULL OR h = keeper_h AND doc_id = keeper_doc AND own = keeper_own"))
    gone = F.concat(F.when(F.col("stays"), F.array().cast("array<int>")).otherwise(F.array("line")), F.coalesce("rest", F.array().cast("array<int>")))
    return found.select("doc_id", "own", gone.alias("lines"), F.coalesce("keeper_doc", "doc_id").alias("keeper_doc"), F.coalesce("keeper_line", F.when(F.col("keeper_doc").isNull() | F.col("stays"), F.col("line"))).alias("keeper_line")).where("size(lines) > 0")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed lines taken out of the text, all other columns as they were.

    Two more columns, ``n_lines`` and ``n_removed`` (with underscores before them where
    ``docs`` has such columns), count the lines that were there and those that went. Blank lines stay; a null or empty text stays as it is; a text may become
    empty. Rows with a null id pass through untouched and their lines count for
    nothing. Texts that share an id are told apart by a hash of the whole text; a repeated
    row loses the same lines as the first. An empty table gives an empty table.
    """
    gone_id, own, lines, split, n_lines, n_removed = (unused(c, docs.columns) for c in ("_gone_id", "_own", "_gone", "_split", "n_lines", "n_removed"))
    gone = removals(docs, id_col, text_col).groupBy(F.col("doc_id").alias(gone_id), F.col("own").alias(own)).agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias(lines))
    joined = docs.join(gone.hint("shuffle_hash"), (F.col(id_col).cast("long") == F.col(gone_id)) & (_own(text_col) == F.col(own)), "left")
    text = F.col(text_col).cast("string")
    joined = joined.withColumn(split, F.when(F.col(lines).isNotNull(), F.split(text, "\n")))
    # The numbers of the lines that stay come from a difference of sets, so the work is linear in the lines.
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(lines))
    kept = F.when(F.col(lines).isNull(), text).otherwise(F.array_join(F.transform(stay, lambda k: F.col(split)[k]), "\n"))
    counts = [
        F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias(n_lines),
        F.when(F.col(lines).isNull(), 0).otherwise(F.size(lines)).cast("long").alias(n_removed),
    ]
    return joined.select(*[kept.alias(c) if c == text_col else F.col(c) for c in docs.columns], *counts)
