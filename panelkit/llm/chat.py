"""Chat formatting: minimum-cost role repair over a legal-turn automaton, then rendering.

Legal sequences are an optional system turn followed by user and assistant turns in alternation,
ending with the assistant. Every input turn is kept under its role (cost 0) or relabelled (cost 3);
a turn given the role of the turn before it is merged into that one (cost 1); an empty turn may be
put in where a role is missing (cost 2 each, at the end too). Dynamic programming over the state
"role of the last turn" finds the cheapest repair. Ties go to the smaller end state, and backwards
from there to the smaller role, in the order system, user, assistant.

Scale: rows are range-partitioned on (conversation, turn) and stored, so a conversation of any
length is a run of neighbouring partitions. The cost of a run of turns is a 3 x 4 matrix over
(state before, state after), and such matrices combine, so only the matrices of runs cut by a
partition border (two per partition at most) are combined on the driver; the second pass resolves
and renders every run on its own. Output is one row per turn, whose pieces in order give the text.

Defined results: a null or unknown role is relabelled at the usual cost; null text is empty; a
null conversation id is a conversation of its own; null turns come first; equal turns are ordered
by role and text; an empty table gives no rows; only the four named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from panelkit.llm.common import store

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
MERGE, INSERT, RELABEL = 1, 2, 3
INF = 1 << 50

# Empty turns needed to go from a state to a turn of a role; None where no insertion makes it legal.
_GAPS = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (ASSISTANT, USER): (),
}
# Empty turns needed after the last turn.
_TAIL = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def step_costs() -> np.ndarray:
    """cost[state, role of input or 0 if unknown, role given] of one turn."""
    cost = np.full((4, 4, 4), INF, np.int64)
    for state in range(4):
        for given in (SYSTEM, USER, ASSISTANT):
            if state == given:
                move = MERGE
            elif (state, given) in _GAPS:
                move = INSERT * len(_GAPS[state, given])
            else:
                continue
            for role in range(4):
                cost[state, role, given] = move + (0 if role == given else RELABEL)
    return cost


_COST = step_costs()
TAIL_COST = np.array([INSERT * len(_TAIL[s]) for s in range(4)], np.int64)


def run_matrix(roles: list[int]) -> np.ndarray:
    """Cheapest cost from each state before a run of turns to each state after it."""
    out = np.full((4, 4), INF, np.int64)
    np.fill_diagonal(out, 0)
    for role in roles:
        out = np.minimum((out[:, :, None] + _COST[:, role, :][None]).min(axis=1), INF)
    return out


def solve(roles: list[int], before: int, after: int) -> list[int]:
    """Roles given to the turns of a run on its cheapest way between two states."""
    best = np.full(4, INF, np.int64)
    best[before] = 0
    back = np.zeros((len(roles), 4), np.int8)
    for i, role in enumerate(roles):
        total = best[:, None] + _COST[:, role, :]
        back[i] = total.argmin(axis=0)
        best = np.minimum(total.min(axis=0), INF)
    given, state = [0] * len(roles), after
    for i in range(len(roles) - 1, -1, -1):
        given[i] = state
        state = int(back[i, state])
    return given


def chain(matrices: list[np.ndarray]) -> list[int]:
    """States at the borders of consecutive runs, the first START, on the cheapest legal way."""
    best = np.full(4, INF, np.int64)
    best[START] = 0
    back = []
    for m in matrices:
        total = best[:, None] + m
        back.append(total.argmin(axis=0))
        best = np.minimum(total.min(axis=0), INF)
    state = int((best + TAIL_COST).argmin())
    states = [state]
    for b in reversed(back):
        state = int(b[state])
        states.append(state)
    return states[::-1]


def header(role: int) -> str:
    return f"<|{ROLES[role - 1]}|>\n"


def render(roles: list[int], texts: list[str | None], given: list[int], before: int, last: bool) -> list[tuple[str, int, str]]:
    """(action, empty turns put in, piece of text) of each turn of a run."""
    out, state = [], before
    for i, (role, text, new) in enumerate(zip(roles, texts, given)):
        action = "keep" if role == new else "relabel"
        if state == new:
            gap, piece, action = (), "\n" + (text or ""), "merge" if role == new else "relabel_merge"
        else:
            gap = _GAPS[state, new]
            piece = ("" if state == START else "<|end|>\n") + "".join(header(g) + "<|end|>\n" for g in gap) + header(new) + (text or "")
        state = new
        tail = _TAIL[state] if last and i + 1 == len(roles) else None
        if tail is not None:
            piece += "<|end|>\n" + "".join(header(g) + "<|end|>\n" for g in tail)
        out.append((action, len(gap) + len(tail or ()), piece))
    return out


def _runs(batches: Iterator[pa.RecordBatch]):
    """Consecutive rows of one conversation inside a partition: (part, id), columns turn, role, text and line."""
    current, held = None, ([], [], [], [])
    for batch in batches:
        d = batch.to_pydict()
        for part, cid, turn, role, text, line in zip(d["part"], d["conv_id"], d["turn"], d["role"], d["text"], d["line"]):
            key = (part, cid)
            if key != current:
                if current is not None:
                    yield current, held
                current, held = key, ([], [], [], [])
            held[0].append(turn)
            held[1].append(role)
            held[2].append(text)
            held[3].append(line)
    if current is not None:
        yield current, held


_CODE = {name: i + 1 for i, name in enumerate(ROLES)}


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per input turn: conversation, turn, place, given role, action, empty turns put in, and its piece of text.

    `place` is unique and rises along a conversation, also over equal and null turns: its pieces, joined in order of
    place, are the rendered text.
    """
    spark = turns.sparkSession
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    # The last key spreads repeated rows too.
    order = ["conv_id", "turn", "role", "text", "tie"]
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    # Stored under its partition number, so that both passes see the same runs whatever files they are read from.
    rows = store(rows.withColumn("line", F.monotonically_increasing_id()), "chat")

    def edges(batches):
        """First and last run of a partition, of which alone the conversation may go on elsewhere."""
        ends: dict = {}
        for (part, cid), (_, names, _, _) in _runs(batches):
            entry = (cid, [_CODE.get(r, 0) for r in names])
            ends[part] = (ends.get(part, (entry,))[0], entry)
        out = []
        for part, (first, final) in ends.items():
            for side, (cid, roles) in enumerate((first, final) if final is not first else (first,)):
                out.append((part, side, cid, run_matrix(roles).ravel().tolist()))
        cols = list(zip(*out)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], conv_type),
             pa.array(cols[3], pa.list_(pa.int64()))], names=["part", "side", "conv_id", "costs"])

    kind = rows.schema["conv_id"].dataType
    conv_type = to_arrow_type(kind)
    sorted_rows = rows.repartition(F.col("part")).sortWithinPartitions("part", "line")
    cut = sorted_rows.mapInArrow(edges, f"part int, side int, conv_id {kind.simpleString()}, costs array<long>")
    cut = sorted(cut.collect(), key=lambda r: (r["part"], r["side"]))  # two rows per partition at most
    states: dict = {}
    i = 0
    while i < len(cut):
        j = i
        while j + 1 < len(cut) and cut[j + 1]["conv_id"] == cut[i]["conv_id"]:
            j += 1
        if j > i:
            at = chain([np.array(r["costs"], np.int64).reshape(4, 4) for r in cut[i:j + 1]])
            for k, r in enumerate(cut[i:j + 1]):
                states[r["part"], r["conv_id"]] = (at[k], at[k + 1], k == j - i)
        i = j + 1
    shared = spark.sparkContext.broadcast(states)

    def resolve(batches):
        size, cols = 0, [[] for _ in range(8)]
        for (part, cid), (numbers, names, texts, lines) in _runs(batches):
            roles = [_CODE.get(r, 0) for r in names]
            before, after, last = shared.value.get((part, cid), (START, None, True))
            if after is None:
                after = chain([run_matrix(roles)])[-1]
            given = solve(roles, before, after)
            for k, (action, put_in, piece) in enumerate(render(roles, texts, given, before, last)):
                for c, v in zip(cols, (cid, numbers[k], lines[k], names[k], ROLES[given[k] - 1], action, put_in, piece)):
                    c.append(v)
                size += len(piece)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names_out)
                    size, cols = 0, [[] for _ in range(8)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names_out)

    turn_kind, role_kind = rows.schema["turn"].dataType, rows.schema["role"].dataType
    types = [conv_type, to_arrow_type(turn_kind), pa.int64(), to_arrow_type(role_kind), pa.string(), pa.string(), pa.int64(), pa.string()]
    names_out = ["conv_id", "turn", "place", "role", "role_out", "action", "n_inserted", "piece"]
    return sorted_rows.mapInArrow(
        resolve, f"conv_id {kind.simpleString()}, turn {turn_kind.simpleString()}, place long, role {role_kind.simpleString()}, "
        "role_out string, action string, n_inserted long, piece string")
