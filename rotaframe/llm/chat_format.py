"""Chat formatting with minimum-cost role repair.

Legal conversations are the words of a small automaton: an optional system turn,
then user and assistant in alternation, user first. Each given turn may be kept
or relabelled (as any role), may open a message or be merged into the one before
it if that has the same role, and empty messages may be put in before it; all at
a cost. Dynamic programming over the automaton's states finds the cheapest
repair, and the repaired messages are rendered with a template.

A step of that program is a (min, +) product with a small matrix of transition
costs, and such products can be bracketed anyhow. So a conversation of more than
`large` turns needs no task that holds it: range partitioning cuts it into
pieces, each piece is reduced to one matrix and the order of its paths of equal
cost, these alone are chained per conversation, and each piece is then traced
between its known ends. The rows are those of the conversation taken whole.

Result: one row for each given turn, with the part of the rendered conversation
that it adds; the parts in turn order make up the whole.

Defined cases: turns are ordered by turn (null first), then role, then text;
repeated rows are turns of their own; a null or unknown role may become any role
at a small cost; a null text counts as empty; rows with a null conversation id
make one conversation; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the last message.
START, STATES = 0, 4
FOREVER = 1 << 50


@dataclass(frozen=True)
class Costs:
    merge: int = 2
    relabel: int = 4
    unknown: int = 1
    to_system: int = 6
    insert: int = 5


@dataclass(frozen=True)
class Step:
    """One way to take a turn: the state after it, its cost, whether it is merged, and the messages put in before it."""

    to: int
    cost: int
    merged: bool
    inserted: tuple[int, ...]


def _follows(state: int, role: int) -> bool:
    """Whether a message of a role (1 to 3) may come after a state."""
    return {1: state == START, 2: state in (START, 1, 3), 3: state == 2}[role]


@cache
def steps(state: int, role: int, costs: Costs) -> tuple[Step, ...]:
    """All sensible ways to take a turn with a role (0: unknown) after a state; the first of equals is preferred."""
    out = []
    for target in (1, 2, 3):
        label = 0 if target == role else costs.relabel if role else costs.unknown
        if target == 1 and role != 1:
            label += costs.to_system
        if _follows(state, target):
            out.append(Step(target, label, False, ()))
        if state == target:
            out.append(Step(target, label + costs.merge, True, ()))
        for put in (2, 3):
            if _follows(state, put) and _follows(put, target):
                out.append(Step(target, label + costs.insert, False, (put,)))
    return tuple(sorted(out, key=lambda s: (s.cost, s.to != role, s.merged, len(s.inserted))))


@cache
def transition(role: int, costs: Costs) -> np.ndarray:
    """Least costs from state to state over one turn."""
    m = np.full((STATES, STATES), FOREVER, dtype=np.int64)
    for state in range(STATES):
        for step in steps(state, role, costs):
            m[state, step.to] = min(m[state, step.to], step.cost)
    return m


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) product of matrices, or of a vector and a matrix."""
    return np.minimum((a[..., :, None] + b).min(axis=-2), FOREVER)


def ranked_chain(m: np.ndarray, rank: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """chain(m, t), and the ranks of the first states for each last one.

    rank[first, last] orders the cheapest paths to a last state as repair() does: read from
    the end, the lesser state goes first. So first states of equal cost are told apart.
    """
    through = m[:, :, None] + t
    before = through.argmin(axis=1)
    key = before * STATES + np.take_along_axis(rank, before, axis=1)
    return np.minimum(through.min(axis=1), FOREVER), key.argsort(axis=0).argsort(axis=0)


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    return ROLES.index(name) + 1 if name in ROLES else 0


def repair(roles: list[int], costs: Costs, entry: np.ndarray | None = None, exit_state: int | None = None) -> tuple[int, list[tuple[int, Step]]]:
    """Cost, and for each turn the state before it and the step taken. entry: least costs of the states before the first turn."""
    if entry is None:
        entry = np.full(STATES, FOREVER, dtype=np.int64)
        entry[START] = 0
    before = [entry]
    for role in roles:
        before.append(chain(before[-1], transition(role, costs)))
    state = int(before[-1].argmin()) if exit_state is None else exit_state
    cost = int(before[-1][state])
    taken = []
    for i in range(len(roles) - 1, -1, -1):
        best = None
        for earlier in range(STATES):
            for step in steps(earlier, roles[i], costs):
                if step.to == state and before[i][earlier] + step.cost == before[i + 1][state]:
                    best = (earlier, step)
                    break
            if best:
                break
        taken.append(best)
        state = best[0]
    return cost, taken[::-1]


@dataclass(frozen=True)
class Template:
    begin: str = "<|{role}|>\n"
    end: str = "<|end|>\n"
    between_merged: str = "\n\n"

    def fragment(self, text: str, state: int, step: Step, last: bool) -> str:
        """What a turn adds: the end of the message before it, messages put in, its own beginning and text, and the end if it is the last."""
        # a template's signs in a text are told apart by a space
        text = text.replace("<|", "< |")
        if step.merged:
            out = self.between_merged + text
        else:
            out = self.end if state != START else ""
            for put in step.inserted:
                out += self.begin.format(role=ROLES[put - 1]) + self.end
            out += self.begin.format(role=ROLES[step.to - 1]) + text
        return out + self.end if last else out


OUT = "turn long, role string, new_role string, action string, inserted string, rendered string, conversation_cost long"
NAMES = ["conv_id", "turn", "role", "new_role", "action", "inserted", "rendered", "conversation_cost"]


def _out_rows(conv, turns: list[tuple], taken: list[tuple[int, Step]], cost: int, last: bool, template: Template) -> list[tuple]:
    out = []
    for i, ((turn, role, text), (state, step)) in enumerate(zip(turns, taken, strict=True)):
        action = "merge" if step.merged else "keep"
        if role_number(role) != step.to:
            action = "relabel, merge" if step.merged else "relabel"
        out.append((conv, turn, role, ROLES[step.to - 1], action, ",".join(ROLES[p - 1] for p in step.inserted), template.fragment(text or "", state, step, last and i == len(turns) - 1), cost))
    return out


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), *[pa.string()] * 5, pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=NAMES)


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[object, list[tuple], pa.DataType]]:
    """Neighbouring turns of one conversation, at most `most` at a time."""
    key, turns, kind, any_yet = None, [], None, False
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, *turn in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
            if any_yet and (conv != key or len(turns) >= most):
                yield key, turns, kind
                turns = []
            key, any_yet = conv, True
            turns.append(tuple(turn))
    if turns:
        yield key, turns, kind


def chat_format(conversations: DataFrame, costs: Costs = Costs(), template: Template = Template(), large: int = 4096, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:  # noqa: B008
    """conv_id, turn, role, new_role, action, inserted, rendered, conversation_cost for each turn."""
    kind = conversations.select(conv_col).schema[0].dataType.simpleString()
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("turns")).filter(F.col("turns") > large).select(F.col("conv_id").alias("large_id"))
    is_large = F.col("conv_id").eqNullSafe(F.col("large_id"))
    small = rows.join(sizes, is_large, "left_anti").repartition("conv_id").sortWithinPartitions(*order)
    schema = f"conv_id {kind}, {OUT}"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[tuple] = []
        arrow = None
        for conv, turns, arrow in _runs(batches, 1 << 62):
            cost, taken = repair([role_number(r) for _, r, _ in turns], costs)
            some += _out_rows(conv, turns, taken, cost, True, template)
            if len(some) >= 2000:
                yield _batch(some, arrow)
                some = []
        if some:
            yield _batch(some, arrow)

    out = small.mapInArrow(whole, schema)
    if not sizes.take(1):
        return out
    return out.unionByName(_large(rows.join(sizes, is_large, "left_semi").repartitionByRange(*order).sortWithinPartitions(*order), costs, template, large, kind, schema))


def _large(rows: DataFrame, costs: Costs, template: Template, most: int, kind: str, schema: str) -> DataFrame:
    """Conversations of which no task holds more than a piece."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own = 0, None

        def tagged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal own
            for b in it:
                if b.num_rows:
                    own = b.column("slice")[0].as_py()
                yield b

        for conv, turns, arrow in _runs(tagged(batches), most):
            m = np.where(np.eye(STATES, dtype=bool), 0, FOREVER)
            rank = np.repeat(np.arange(STATES)[:, None], STATES, axis=1)
            for _, role, _ in turns:
                m, rank = ranked_chain(m, rank, transition(role_number(role), costs))
            turn_type = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], type=arrow), pa.array([(own << 33) + number]), pa.array([m.ravel().tolist()], type=pa.list_(pa.int64())), pa.array([rank.ravel().tolist()], type=pa.list_(pa.int64())), pa.array([[{"turn": a, "role": b, "text": c} for a, b, c in turns]], type=pa.list_(turn_type))],
                names=["conv_id", "piece", "matrix", "rank", "turns"],
            )
            number += 1

    held = written(rows.withColumn("slice", F.spark_partition_id()).mapInArrow(pieces, f"conv_id {kind}, piece long, matrix array<long>, rank array<long>, turns array<struct<turn: long, role: string, text: string>>"))

    def ends(table: pa.Table) -> pa.Table:
        """The matrices of one conversation, a piece each: the state before each piece with its cost, all others closed, and the state after it."""
        table = table.sort_by("piece")
        matrices, ranks = ([np.array(m, dtype=np.int64).reshape(STATES, STATES) for m in table.column(c).to_pylist()] for c in ("matrix", "rank"))
        v = np.full(STATES, FOREVER, dtype=np.int64)
        v[START] = 0
        before = [v]
        for m in matrices:
            before.append(chain(before[-1], m))
        state = int(before[-1].argmin())
        cost, after, entry = int(before[-1][state]), [], []
        for v, m, rank in zip(before[-2::-1], matrices[::-1], ranks[::-1], strict=True):
            after.append(state)
            total = v + m[:, state]
            state = int(np.where(total == total.min(), rank[:, state], STATES).argmin())
            entry.append(np.where(np.arange(STATES) == state, v, FOREVER).tolist())
        after.reverse()
        entry.reverse()
        last = [i == len(after) - 1 for i in range(len(after))]
        return pa.table({"piece": table.column("piece"), "entry": pa.array(entry, type=pa.list_(pa.int64())), "after": pa.array(after, type=pa.int64()), "last": pa.array(last), "cost": pa.array([cost] * len(after), type=pa.int64())})

    known = held.select("conv_id", "piece", "matrix", "rank").groupBy("conv_id").applyInArrow(ends, "piece long, entry array<long>, after long, last boolean, cost long")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                turns = [(t["turn"], t["role"], t["text"]) for t in row["turns"]]
                _, taken = repair([role_number(r) for _, r, _ in turns], costs, np.array(row["entry"], dtype=np.int64), row["after"])
                yield _batch(_out_rows(row["conv_id"], turns, taken, row["cost"], row["last"], template), batch.schema.field("conv_id").type)

    return held.select("conv_id", "piece", "turns").join(known, "piece").select("conv_id", "turns", "entry", "after", "last", "cost").mapInArrow(trace, schema)
