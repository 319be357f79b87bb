"""Chat formatting with minimum-cost role repair.

A legal conversation is a path of the turn automaton LEGAL that starts in START and ends in ENDS. Each turn
of the input keeps its role or is relabelled, and then is merged into the turn before it, follows it, or
follows empty turns that are inserted between them; dynamic programming over the automaton's state, the
role of the last turn so far, picks the cheapest choices.

Rows are sorted by conversation, across range partitions, and each partition is streamed once. A conversation
that lies within it is repaired there. Of one that may go on in another partition, or has more than BLOCK turns,
each block gets its matrix of least costs from every state to every state and the choices for each pair of states;
a conversation's matrices are combined in order, (min, +), to the states at the block borders, which pick the
choices. So no task holds more than a block's rows, however long a conversation is, and a task combines one 4 x 4
matrix for each block of a long conversation.
"""

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.tables import fitting, in_small_batches, settle

START, ROLES = "start", ("system", "user", "assistant")
STATES = (START, *ROLES)
LEGAL = {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
ENDS = (START, "assistant")
MERGE, INSERT, RELABEL, LABEL = 1, 2, 3, 1
BLOCK = 4096
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _gaps() -> dict[tuple[str, str], tuple[str, ...]]:
    """The fewest empty turns that make role b legal after state a."""
    found: dict[tuple[str, str], tuple[str, ...]] = {}
    for a in STATES:
        reached: dict[str, tuple[str, ...]] = {a: ()}
        frontier = [a]
        while frontier:
            here = frontier.pop(0)
            for b in LEGAL[here]:
                found.setdefault((a, b), reached[here])
                if b not in reached:
                    reached[b] = (*reached[here], b)
                    frontier.append(b)
    return found


GAPS = _gaps()
#: Empty turns that end a conversation legally from each state.
CLOSING = {s: () if s in ENDS else min(((*GAPS[s, e], e) for e in ENDS if (s, e) in GAPS), key=len) for s in STATES}


def _moves(role: str) -> list[tuple[int, int, int, str, bool]]:
    """(from, to, cost, new role, merged) of a turn, cheapest first; of equal costs, the kept role, an insertion and a merge come in that order."""
    out = []
    for new in ROLES:
        label = 0 if new == role else RELABEL if role in ROLES else LABEL
        for a, state in enumerate(STATES):
            if state == new:
                out.append((a, STATES.index(new), label + MERGE, new, True))
            if (state, new) in GAPS:
                out.append((a, STATES.index(new), label + INSERT * len(GAPS[state, new]), new, False))
    return sorted(out, key=lambda m: (m[2], m[3] != role, m[4], m[3], m[0]))


MOVES = {role: _moves(role) for role in (*ROLES, "?")}


def known(role: str | None) -> str:
    role = (role or "").strip().lower()
    return role if role in ROLES else "?"


def costs_from(entry: list[float], roles: list[str]) -> list[list[float]]:
    """Least costs of each state after 0, 1, ... turns."""
    table = [entry]
    for role in roles:
        before, now = table[-1], [math.inf] * len(STATES)
        for a, b, cost, _, _ in MOVES[role]:
            now[b] = min(now[b], before[a] + cost)
        table.append(now)
    return table


def choices(roles: list[str], table: list[list[float]], leave: int) -> list[int]:
    """The cheapest choice for each turn on the way to the state `leave`, by CODES."""
    out, state = [], leave
    for i in range(len(roles) - 1, -1, -1):
        a, _, _, new, merged = next(m for m in MOVES[roles[i]] if m[1] == state and table[i][m[0]] + m[2] == table[i + 1][state])
        out.append(CODES[a, new, merged])
        state = a
    return out[::-1]


#: Numbers of the choices (state before, new role, merged).
CODES = {(a, new, merged): 2 * (len(ROLES) * a + i) + merged for a in range(len(STATES)) for i, new in enumerate(ROLES) for merged in (False, True)}


def _entering(state: int) -> list[float]:
    return [0 if s == state else math.inf for s in range(len(STATES))]


@lru_cache(1 << 16)
def repair(roles: tuple[str, ...]) -> tuple[list[int], int]:
    """The choices of a whole conversation's cheapest repair, and its last state."""
    table = costs_from(_entering(0), roles)
    leave = min(range(len(STATES)), key=lambda s: (table[-1][s] + INSERT * len(CLOSING[STATES[s]]), s))
    return choices(roles, table, leave), leave


def ways(roles: list[str]) -> tuple[list[float], list[bytes]]:
    """Least costs from each state to each, and of each turn the choices on all these ways (0 where there is no way)."""
    costs, every = [], []
    for entry in range(len(STATES)):
        table = costs_from(_entering(entry), roles)
        costs += table[-1]
        every += [choices(roles, table, leave) if table[-1][leave] < math.inf else [0] * len(roles) for leave in range(len(STATES))]
    return costs, [bytes(turn) for turn in zip(*every, strict=True)]


def join_blocks(matrices: list[list[list[float]]]) -> list[tuple[int, int]]:
    """Entry and exit state of each block of the cheapest legal conversation."""
    best = [[0 if s == 0 else math.inf for s in range(len(STATES))]]
    for m in matrices:
        best.append([min(best[-1][a] + m[a][b] for a in range(len(STATES))) for b in range(len(STATES))])
    state = min(range(len(STATES)), key=lambda s: (best[-1][s] + INSERT * len(CLOSING[STATES[s]]), s))
    out = []
    for m, before in zip(matrices[::-1], best[-2::-1], strict=True):
        a = min(range(len(STATES)), key=lambda s: (before[s] + m[s][state], s))
        out.append((a, state))
        state = a
    return out[::-1]


_KNOWN = (*ROLES, "?")
_PLANNED = "conv_id long, turn long, role string, text string, slot long, code int, leave int, pid int, block long, choices binary, costs array<double>, n long"


class _Plan:
    """Rows of one partition, sorted by conversation, with their choices."""

    def __init__(self, block: int):
        self.block = block
        self.held: list[pa.RecordBatch] = []
        self.rows = self.emitted = self.blocks = 0
        self.first = True

    def _out(self, rows: pa.RecordBatch, **more) -> pa.RecordBatch:
        n, kinds = rows.num_rows, {"slot": pa.int64(), "code": pa.int32(), "leave": pa.int32(), "block": pa.int64(), "choices": pa.binary(), "costs": pa.list_(pa.float64()), "n": pa.int64()}
        made = {name: pa.nulls(n, kind) if more.get(name) is None else pa.array(more[name], kind) for name, kind in kinds.items()}
        columns = [rows.column(c) for c in ("conv_id", "turn", "role", "text")] + [made["slot"], made["code"], made["leave"], rows.column("pid"), made["block"], made["choices"], made["costs"], made["n"]]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _PLANNED.split(", ")])

    def whole(self, rows: pa.RecordBatch, starts: list[int]) -> pa.RecordBatch:
        """Rows of whole conversations that begin at `starts`."""
        roles = [_KNOWN[c] for c in rows.column("known").to_pylist()]
        slots, codes, leaves = [], [], []
        for a, b in zip(starts, [*starts[1:], rows.num_rows], strict=True):
            code, leave = repair(tuple(roles[a:b]))
            slots += range(b - a)
            codes += code
            leaves += [None] * (b - a - 1) + [leave]
        return self._out(rows, slot=slots, code=codes, leave=leaves)

    def part(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        """A block of a conversation that goes on elsewhere."""
        n = rows.num_rows
        costs, every = ways([_KNOWN[c] for c in rows.column("known").to_pylist()])
        out = self._out(rows, slot=range(n), block=[self.blocks] * n, choices=every, costs=[costs] + [None] * (n - 1), n=[n] * n)
        self.blocks += 1
        return out

    def close(self, last: bool) -> Iterator[pa.RecordBatch]:
        """The open conversation ends, or the partition."""
        if self.held:
            rows = pa.Table.from_batches(self.held).combine_chunks().to_batches()[0]
            yield self.part(rows) if self.first or last or self.emitted else self.whole(rows, [0])
        self.first = self.first and not (self.held or self.emitted)
        self.held, self.rows, self.emitted = [], 0, 0

    def hold(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        while rows.num_rows:
            some = rows.slice(0, self.block - self.rows)
            self.held.append(some)
            self.rows += some.num_rows
            rows = rows.slice(some.num_rows)
            if self.rows == self.block and rows.num_rows:
                yield self.part(pa.Table.from_batches(self.held).combine_chunks().to_batches()[0])
                self.emitted, self.held, self.rows = self.emitted + 1, [], 0

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = ()
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, null = pc.fill_null(batch.column("conv_id"), 0).to_numpy(), pc.is_null(batch.column("conv_id")).to_numpy(zero_copy_only=False)
            new = np.concatenate(([before != (ids[0], null[0])], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])))
            before = (ids[-1], null[-1])
            cuts = np.flatnonzero(new).tolist()
            if not cuts:
                yield from self._full(batch)
                continue
            yield from self._full(batch.slice(0, cuts[0]))
            yield from self.close(False)
            if len(cuts) > 1:
                inner, starts = batch.slice(cuts[0], cuts[-1] - cuts[0]), [c - cuts[0] for c in cuts[:-1]]
                if self.first:  # it may have begun in an earlier partition
                    yield from self._full(inner.slice(0, (starts[1:] or [inner.num_rows])[0]))
                    yield from self.close(False)
                    inner, starts = inner.slice((starts[1:] or [inner.num_rows])[0]), [x - starts[1] for x in starts[1:]]
                if starts:
                    yield self.whole(inner, starts)
            yield from self._full(batch.slice(cuts[-1]))
        yield from self.close(True)

    def _full(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Holds rows of the open conversation; one block more than full goes out."""
        if self.held and self.rows == self.block and rows.num_rows:
            yield self.part(pa.Table.from_batches(self.held).combine_chunks().to_batches()[0])
            self.emitted, self.held, self.rows = self.emitted + 1, [], 0
        yield from self.hold(rows)


def _borders(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: (r["pid"], r["block"]))
    states = len(STATES)
    found = join_blocks([[r["costs"][i * states : i * states + states] for i in range(states)] for r in rows])
    at = np.cumsum([0] + [r["n"] for r in rows])
    yield pa.RecordBatch.from_arrays(
        [pa.array([r["pid"] for r in rows], pa.int32()), pa.array([r["block"] for r in rows], pa.int64()), pa.array([states * a + b for a, b in found], pa.int32()), pa.array([b for _, b in found], pa.int32()), pa.array(at[:-1], pa.int64()), pa.array([r is rows[-1] for r in rows])],
        names=["pid", "block", "way", "left", "ahead", "last"],
    )


def _empty(roles: tuple[str, ...]) -> str:
    return "".join(f"{OPEN}{x}\n{CLOSE}\n" for x in roles)


def _of(choice: Column, values: list) -> Column:
    """The value of each choice's number; values are strings or tuples of them."""
    each = [F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, tuple) else F.lit(v) for v in values]
    return F.get(F.array(*each), choice)  # element_at takes a null index of an array without nulls for a value


def repair_chats(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each row of conversations: conv_id, slot, turn, role, new_role, merged, inserted (roles of the
    empty turns put before it), appended (those put after the conversation's last turn), rendered.

    slot counts a conversation's rows from 0, in order of turn; rows of one turn follow each other by role, then by
    the MD5 of their text; rows that agree in all this are alike. Turns without a number come last. A conversation's
    rendered values, in order of slot, concatenate to its repaired text; they stay rows, as a conversation of any
    length could not be one value. A null or unknown role may become any role at cost LABEL; a null text is empty,
    and a text of any length stays whole. Rows with a null conv_id are one conversation. An empty table gives an
    empty result, and other columns, whatever their names, are not read.
    """
    role = F.trim(F.lower(F.coalesce("role", F.lit("")).cast("string")))
    code = F.array_position(F.array(*map(F.lit, ROLES)), role)
    rows = in_small_batches(conversations).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role"), F.col("text"))
    rows = rows.withColumns({"known": F.when(code > 0, code - 1).otherwise(len(ROLES)).cast("int"), "tie": F.md5(F.coalesce("text", F.lit("")).cast("binary")), "row": F.monotonically_increasing_id()})
    # row numbers serve only to deal equal rows to several partitions
    order = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.coalesce("role", F.lit("")), F.col("tie"), F.col("row")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id())
    planned = settle(ranged.select("conv_id", "turn", "role", "text", "known", "pid").mapInArrow(lambda batches: _Plan(block).run(batches), _PLANNED), "planned")

    parts = planned.where("costs IS NOT NULL").select("conv_id", "pid", "block", "costs", "n")
    borders = settle(parts.groupBy("conv_id").applyInArrow(_borders, "pid int, block long, way int, left int, ahead long, last boolean"), "borders", narrow=True)
    done = planned.where("block IS NULL").select("conv_id", "slot", "turn", "role", "text", "code", "leave")
    joined = planned.where("block IS NOT NULL").join(fitting(borders), ["pid", "block"])
    chosen = F.conv(F.hex(F.substring("choices", F.col("way") + 1, 1)), 16, 10).cast("int")
    rest = joined.select("conv_id", (F.col("ahead") + F.col("slot")).alias("slot"), "turn", "role", "text", chosen.alias("code"), F.when(F.col("last") & (F.col("slot") == F.col("n") - 1), F.col("left")).alias("leave"))

    number = {v: k for k, v in CODES.items()}
    every = [number[k] for k in range(len(number))]
    gaps = [() if merged else GAPS.get((STATES[a], new), ()) for a, new, merged in every]
    before = ["\n" if merged else ("" if STATES[a] == START else f"{CLOSE}\n") + _empty(gap) + f"{OPEN}{new}\n" for (a, new, merged), gap in zip(every, gaps, strict=True)]
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))  # markers that a text itself holds are broken up
    after = F.coalesce(_of(F.col("leave"), [f"{CLOSE}\n" + _empty(CLOSING[s]) for s in STATES]), F.lit(""))
    return done.unionByName(rest).select(
        "conv_id", "slot", "turn", "role", _of(F.col("code"), [new for _, new, _ in every]).alias("new_role"), (F.col("code") % 2 == 1).alias("merged"), _of(F.col("code"), gaps).alias("inserted"),
        F.coalesce(_of(F.col("leave"), [CLOSING[s] for s in STATES]), F.array().cast("array<string>")).alias("appended"), F.concat(_of(F.col("code"), before), text, after).alias("rendered"),
    )
