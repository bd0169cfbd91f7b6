"""Chat formatting: minimum-cost repair of role sequences, then rendering.

A legal conversation is an optional system message, then user and assistant in turn, ending with the assistant.  A
dynamic program over the automaton of the last message's role (none, system, user, assistant) chooses for every turn
whether it starts a message of its role, starts one of another role (relabel), joins the message before it (merge), or
first gets an empty message of the missing role inserted, at least total cost.  Repaired turns are rendered one
by one; their pieces in order are the rendered conversation.

A conversation may be of any length: it is cut into chunks of turns.  Every chunk is summarized by the least cost between
any two states (a min-plus matrix); the matrices are chained per conversation; then every chunk is decided by
itself, given the states it starts and ends in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentkit.llm.storage import stage

# Roles, costs, marks.
ROLES = ["system", "user", "assistant"]
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "developer": "system"}
MERGE, RELABEL, INSERT = 1.0, 4.0, 2.0
OPEN, CLOSE, JOINT = "<|im_start|>", "<|im_end|>\n", "\n"
#: States: role of the last message, or none yet.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NONE: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Turn numbers per chunk.
CHUNK = 256


@dataclass(frozen=True)
class Move:
    cost: float
    start: int
    end: int
    action: str
    inserted: int  # role of an empty message before the turn, or NONE


def _moves(role: int) -> list[Move]:
    """All ways to place a turn of *role* (NONE: unknown), in order of preference at equal cost."""
    out = []
    for state in range(4):
        for target in NEXT[state]:
            out.append(Move(0.0 if target == role else RELABEL, state, target, "keep" if target == role else "relabel", NONE))
        if state != NONE:
            same = state == role
            out.append(Move(MERGE if same else MERGE + RELABEL, state, state, "merge" if same else "relabel_merge", NONE))
        for between in NEXT[state]:
            for target in NEXT[between]:
                if between != SYSTEM:
                    out.append(Move(INSERT + (0.0 if target == role else RELABEL), state, target, "keep" if target == role else "relabel", between))
    return sorted(out, key=lambda m: (m.cost, m.inserted, m.start, m.end))


MOVES = {role: _moves(role) for role in range(4)}
STEP = {role: np.array([[min([m.cost for m in MOVES[role] if (m.start, m.end) == (i, j)], default=np.inf) for j in range(4)] for i in range(4)])
        for role in MOVES}
#: Cost of ending: the missing messages are inserted.
ENDING = np.array([np.inf, 2 * INSERT, INSERT, 0.0])


def role_code(role: Column) -> Column:
    """1 system, 2 user, 3 assistant (any case, aliases included), 0 for others and null."""
    name = F.lower(F.trim(role))
    out = F.lit(0)
    for k, known in enumerate(ROLES, 1):
        out = F.when(name.isin(known, *[a for a, r in ALIASES.items() if r == known]), k).otherwise(out)
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


def chunk_matrix(roles: list[int]) -> np.ndarray:
    out = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
    for role in roles:
        out = _product(out, STEP[role])
    return out


def repair(roles: list[int], start: int = NONE, end: int | None = None) -> list[Move]:
    """The moves of least total cost from *start* to *end* (to the cheapest ending if None)."""
    costs = np.full(4, np.inf)
    costs[start] = 0.0
    taken: list[list[Move | None]] = []
    for role in roles:
        best: list[Move | None] = [None] * 4
        new = np.full(4, np.inf)
        for move in MOVES[role]:
            value = costs[move.start] + move.cost
            if value < new[move.end] - 1e-9:
                new[move.end], best[move.end] = value, move
        costs = new
        taken.append(best)
    state = int(np.argmin(costs + ENDING)) if end is None else end
    out = []
    for best in reversed(taken):
        move = best[state]
        out.append(move)
        state = move.start
    return out[::-1]


def _runs(batches, width: int):
    """Consecutive rows with equal first *width* columns, as lists of tuples."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:width] != key:
                if rows:
                    yield key, rows
                key, rows = row[:width], []
            rows.append(row)
    if rows:
        yield key, rows


def _table(rows: list[tuple], schema: pa.Schema):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _emit(rows, schema: pa.Schema, size: int = 4096):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _table(held, schema)
            held = []
    yield _table(held, schema)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv_id, turn, seq, role_in, role_out, action, inserted, ending, piece.

    Turns are ordered by number (null first), role, then text; repeated rows are turns of their own.  seq counts them from 0 inside
    a chunk, so (conv_id, turn, seq) orders a conversation.  *inserted* is the role of an empty message before the turn, *ending*
    lists the roles of empty messages after the last one.  Null texts are empty, null conversations are left out, and the
    marks of the format are broken up inside texts.  Chaining holds one small matrix per chunk of a conversation.
    """
    base = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role_in"),
        role_code(F.col(role_col)).alias("code"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK).cast("long"), F.lit(-(2**62))))
    # Only role codes travel for the first two steps; counts stand for runs of equal (turn, code).
    slim = base.groupBy("conv_id", "chunk", "turn", "role_in", "code").agg(F.count(F.lit(1)).alias("n"))
    slim = slim.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "turn", F.col("role_in").asc_nulls_first())

    def power(role: int, n: int) -> np.ndarray:
        out, base = chunk_matrix([]), STEP[role]
        while n:
            if n & 1:
                out = _product(out, base)
            base, n = _product(base, base), n >> 1
        return out

    matrix_schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("costs", pa.list_(pa.float64()))])

    def matrices(batches):
        def rows():
            for (conv, chunk), found in _runs(batches, 2):
                out = chunk_matrix([])
                for row in found:
                    out = _product(out, power(row[4], row[5]))
                yield conv, chunk, out.reshape(-1).tolist()
        yield from _emit(rows(), matrix_schema)

    chunks = slim.select("conv_id", "chunk", "turn", "role_in", "code", "n").mapInArrow(matrices, "conv_id long, chunk long, costs array<double>")
    ordered = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    state_schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()),
                              ("first", pa.bool_()), ("last", pa.bool_())])

    def chain(batches):
        def rows():
            for (conv,), found in _runs(batches, 1):
                costs = [np.array([0.0, np.inf, np.inf, np.inf])]
                steps = [np.array(row[2]).reshape(4, 4) for row in found]
                for step in steps:
                    costs.append((costs[-1][:, None] + step).min(axis=0))
                state = int(np.argmin(costs[-1] + ENDING))
                states = [state]
                for k in range(len(steps) - 1, -1, -1):
                    state = int(np.argmin(costs[k] + steps[k][:, state]))
                    states.append(state)
                states.reverse()
                for k, row in enumerate(found):
                    yield conv, row[1], states[k], states[k + 1], k == 0, k == len(found) - 1
        yield from _emit(rows(), state_schema)

    states = stage(ordered.mapInArrow(chain, "conv_id long, chunk long, start int, stop int, first boolean, last boolean"), "states")
    placed = base.join(states, ["conv_id", "chunk"]).select("conv_id", "chunk", "turn", "role_in", "text", "code", "start", "stop", "first", "last")
    placed = placed.repartition("conv_id", "chunk").sortWithinPartitions(
        "conv_id", "chunk", "turn", F.col("role_in").asc_nulls_first(), "text")
    out_schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("seq", pa.int64()), ("role_in", pa.string()), ("role_out", pa.string()),
                            ("action", pa.string()), ("inserted", pa.string()), ("ending", pa.string()), ("piece", pa.string())])

    def render(batches):
        def rows():
            for (conv, _), found in _runs(batches, 2):
                moves = repair([r[5] for r in found], found[0][6], found[0][7])
                for k, (row, move) in enumerate(zip(found, moves)):
                    piece = "" if row[8] and k == 0 else JOINT if "merge" in move.action else CLOSE
                    if move.inserted:
                        piece += f"{OPEN}{ROLES[move.inserted - 1]}\n{CLOSE}"
                    if "merge" not in move.action:
                        piece += f"{OPEN}{ROLES[move.end - 1]}\n"
                    piece += row[4].replace("<|im_", "<| im_")
                    ending = ""
                    if row[9] and k == len(found) - 1:
                        missing = {SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT]}.get(move.end, [])
                        ending = ",".join(ROLES[m - 1] for m in missing)
                        piece += CLOSE + "".join(f"{OPEN}{ROLES[m - 1]}\n{CLOSE}" for m in missing)
                    yield (conv, row[2], k, row[3], ROLES[move.end - 1], move.action, ROLES[move.inserted - 1] if move.inserted else "", ending, piece)
        yield from _emit(rows(), out_schema, 512)

    return placed.mapInArrow(render, "conv_id long, turn long, seq long, role_in string, role_out string, action string, "
                                     "inserted string, ending string, piece string")
