"""Chat formatting with minimum-cost role repair.

A legal conversation is: system at most once and first, then user and assistant in
turn, the assistant last. An automaton over the last role written accepts just that. Each
given turn may be kept, relabelled, merged into the turn before it, and empty turns may be
inserted before it; each has a cost, and dynamic programming over the automaton finds
the cheapest repair.

The cost of a stretch of turns, from each state to each state, is a 4 x 4 matrix, and
stretches combine by the (min, +) product. So a conversation may span many partitions: each
partition sums up its first and last conversation in such a matrix, the driver joins
the matrices (two for each partition) and tells each partition the states at its
edges, and the partitions then choose and render their own turns.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import frozen

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, or the last role written
UNKNOWN = 0  # given role: 0 for any other, else as the states
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Other names of roles.
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT}
RELABEL, RELABEL_UNKNOWN, MERGE, INSERT = 2, 1, 1, 3
FAR = 1 << 40


def _ways(p: int, q: int) -> list[int] | None:
    """The fewest empty turns between states p and q, so that q may follow."""
    paths = [[]]
    for _ in range(4):
        for path in paths:
            if q in FOLLOWS[path[-1] if path else p]:
                return path
        paths = [[*path, s] for path in paths for s in FOLLOWS[path[-1] if path else p]]
    return None


def _options() -> dict[tuple[int, int, int], tuple[int, str, list[int]]]:
    """(state, given role, written role): cost, action, roles inserted before."""
    out = {}
    for p, r, o in product(range(4), range(4), (SYSTEM, USER, ASSISTANT)):
        name = 0 if r == o else RELABEL_UNKNOWN if r == UNKNOWN else RELABEL
        verb = "keep" if r == o else "relabel"
        found = []
        if (path := _ways(p, o)) is not None:
            found.append((name + INSERT * len(path), len(path), verb, path))
        if p == o:
            found.append((name + MERGE, 0, "merge" if r == o else "relabel+merge", []))
        if found:
            cost, _, verb, path = min(found, key=lambda x: x[:2])
            out[p, r, o] = cost, verb, path
    return out


OPTIONS = _options()
#: Cost matrix of one turn, by given role.
STEP = [np.array([[OPTIONS.get((p, r, o), (FAR,))[0] for o in range(4)] for p in range(4)], np.int64) for r in range(4)]
#: Cost of ending in a state: the empty turns up to an assistant's.
ENDING = [[] if s == ASSISTANT else [*_ways(s, ASSISTANT), ASSISTANT] for s in range(4)]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None]).min(1), FAR)


def _identity() -> np.ndarray:
    return np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)


def matrix(roles: list[int]) -> np.ndarray:
    m = _identity()
    for r in roles:
        m = _product(m, STEP[r])
    return m


def solve(roles: list[int], entry: int = START, end: int | None = None) -> list[int]:
    """The cheapest written roles. ``end`` is the state to end in; None: any, plus its ending.

    Among equal costs the smaller states win, from the last turn backwards.
    """
    best, back = [0 if s == entry else FAR for s in range(4)], []
    for r in roles:
        new, came = [FAR] * 4, [0] * 4
        for o in (SYSTEM, USER, ASSISTANT):
            new[o], came[o] = min((best[p] + int(STEP[r][p, o]), p) for p in range(4))
        back.append(came)
        best = [min(x, FAR) for x in new]
    s = end if end is not None else min(range(4), key=lambda s: (best[s] + INSERT * len(ENDING[s]), s))
    out = []
    for came in reversed(back):
        out.append(s)
        s = came[s]
    return out[::-1]


def role_code(role: str | None) -> int:
    return ALIASES.get((role or "").strip().lower(), UNKNOWN)


def _turn(role: int, text: str) -> str:
    """A turn without its closing mark. Marks within a text are broken up."""
    return f"<|{ROLES[role - 1]}|>\n" + text.replace("<|", "< |")


def _segments(batches):
    """(conversation, turns) of a task's sorted rows, in order."""
    conv, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if rows and row[0] != conv:
                yield conv, rows
                rows = []
            conv = row[0]
            rows.append(row)
    if rows:
        yield conv, rows


def _edges(batches):
    """The first and the last conversation of a task: (part, last?, only?, conv, turns, matrix)."""
    part, first, last = TaskContext.get().partitionId(), None, None
    for conv, rows in _segments(batches):
        last = (conv, len(rows), matrix([role_code(r[2]) for r in rows]).ravel().tolist())
        first = first or last
    if first:
        rows = [(part, False, *first)] + [(part, True, *last)] * (last is not first)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["part", "last", "conv", "n", "m"])


def _fixed(rows: list) -> dict[tuple[int, bool], tuple[int, int | None, int]]:
    """(part, last?) to (entry state, end state, turns before), for conversations over several parts."""
    out, runs = {}, []
    for r in sorted(rows, key=lambda r: (r["part"], r["last"])):
        if runs and runs[-1][-1]["conv"] == r["conv"] and runs[-1][-1]["part"] != r["part"]:
            runs[-1].append(r)
        else:
            runs.append([r])
    for run in runs:
        if len(run) == 1:
            continue
        cost, costs = np.array([0, FAR, FAR, FAR]), []
        mats = [np.array(r["m"], np.int64).reshape(4, 4) for r in run]
        for m in mats:
            costs.append(cost)
            cost = (cost[:, None] + m).min(0)
        state = min(range(4), key=lambda s: (int(cost[s]) + INSERT * len(ENDING[s]), s))
        before = sum(r["n"] for r in run)
        for k in range(len(run) - 1, -1, -1):
            entry = int((costs[k] + mats[k][:, state]).argmin())
            before -= run[k]["n"]
            out[run[k]["part"], run[k]["last"]] = entry, state, before, k == len(run) - 1
            state = entry
    return out


SCHEMA = "conv_id long, place long, turn long, role_in string, role_out string, action string, inserted array<string>, rendered string"


def _repaired(fixed: dict):
    def work(batches):
        part, out = TaskContext.get().partitionId(), []
        first, held = True, None

        def repair(conv, rows, last):
            entry, end, before, closes = fixed.get((part, last), (START, None, 0, True))
            state = entry
            for k, ((_, turn, role, text), o) in enumerate(zip(rows, solve([role_code(r[2]) for r in rows], entry, end))):
                _, action, path = OPTIONS[state, role_code(role), o]
                text = "\n" + (text or "").replace("<|", "< |") if "merge" in action else "".join(_turn(s, "") + "<|end|>\n" for s in path) + _turn(o, text or "")
                # A turn is closed by the one after it, as that may be merged into it.
                text = "<|end|>\n" * (state != START and "merge" not in action) + text
                state = o
                extra = [ROLES[s - 1] for s in path]
                if closes and k == len(rows) - 1:
                    text += "<|end|>\n" + "".join(_turn(s, "") + "<|end|>\n" for s in ENDING[o])
                out.append((conv, before + k, turn, role, ROLES[o - 1], action, extra, text))

        def batch():
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["conv_id", "place", "turn", "role_in", "role_out", "action", "inserted", "rendered"])
            out.clear()
            return made

        for segment in _segments(batches):
            if held:
                # Only a task's first and last conversation can go on elsewhere.
                repair(*held, False if first else None)
                first = False
                if len(out) > 4096:
                    yield batch()
            held = segment
        if held:
            repair(*held, not first)
        if out:
            yield batch()

    return work


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, place, turn, role_in, role_out, action, inserted, rendered``, a row for each turn.

    ``place`` counts a conversation's turns from 0 in the order (turn, role, text), nulls
    first; ties and repeated rows each are a turn. ``rendered`` in that order, put together,
    is the whole repaired conversation, with what was inserted before, and after the
    last turn. Null and empty texts are empty turns; null or strange roles may become any;
    the rows of a null conversation id are one conversation. Other columns are not read. An
    empty table gives an empty table.
    """
    rows = df.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("t"), F.col(role_col).cast("string").alias("r"), F.col(text_col).cast("string").alias("x"))
    rows = frozen(rows.repartitionByRange("c", "t", "r", "x").sortWithinPartitions("c", "t", "r", "x"))
    edges = rows.mapInArrow(_edges, "part int, last boolean, conv long, n long, m array<long>").collect()
    return rows.mapInArrow(_repaired(_fixed(edges)), SCHEMA)


def conversations(formatted: DataFrame) -> DataFrame:
    """``conv_id, text``: whole conversations, for those known to fit into a row."""
    parts = formatted.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "rendered"))).alias("p"))
    return parts.select("conv_id", F.array_join(F.col("p.rendered"), "").alias("text"))
