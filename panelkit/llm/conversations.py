"""Conversation structure repair by a dynamic programme over secondary-sorted turns.

Each turn has at most one fault: blank (no character other than white space), duplicate (role and
text seen earlier in the conversation), truncated (last such character is not one of `.!?`). A
conversation is legal if the initials of its roles read `(s?(ua)+)?`. Edits make it so: Keep (0),
Rerole to user or assistant (1), Delete (2, the only one for blank and duplicate turns), Insert an
empty user or assistant turn anywhere (5); a truncated turn that stays costs 5 more. The cheapest
edits win; of equal ones those whose initials D, I, K, R in order are least.

Two passes over turns repartitioned by conversation and sorted by turn, both streaming through
mapInPandas with their state carried across Arrow batches:

1. Backwards: the state is the cost of the rest from each of the four automaton states. Less their
   least value there are few such states, so the step of a row is mostly a lookup. The best edit
   of each state (with the inserts before it) is a compact back-pointer of 4 bits; every
   `SPILL_ROWS` rows they are spilled as one row that sorts just before the turns it speaks of.
2. Forwards: turns and spilled pointers meet in one sorted stream; following the pointers from the
   start gives the edits, of which no more than one chunk is held.

Ties need no more than this: two choices in one state differ in the edits they write next, and
neither is the beginning of the other.

Scale: a conversation of any length streams through with bounded memory (its audit string and
digests are part of the result). It does so in one task, because a digest over its turns in order
can only be made in order. Duplicates are found before, by the first turn of each (conversation,
role, text): an aggregation with partial results, so a hot text does no harm. Damaged turns are
stored once, so both passes see the same rows when executors are lost.

Defined results: null role and text are one space; null turns come first; equal turns are ordered
by role, then by the SHA-256 of the text; repeated rows are duplicates; rows without a conversation
id form one conversation; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import SPACES, store

START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = {USER: "user", ASSISTANT: "assistant"}
# State after a turn of an initial, where it is legal.
_NEXT = {
    (START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER,
}
# State after an inserted turn or a turn of either new role: the only legal one.
_FORCED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
# Inserts needed after the last turn.
_TAIL = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
INITIALS = ["", "s", "u", "a"]
FINE, MUST_GO, CUT = range(3)
# What a pointer says: inserts before the row (two reach every state), then its edit; in ASCII order as written.
CHOICES = sorted(((n, e) for n in range(3) for e in "DKR"), key=lambda c: "I" * c[0] + c[1])
SPILL_ROWS = 50_000


def _moves(state: int, initial: str, kind: int) -> Iterator[tuple[int, int, int]]:
    """(choice, cost, state after) of a row's edits, in the order of their initials."""
    for code, (inserts, edit) in enumerate(CHOICES):
        at, cost = state, INSERT * inserts
        for _ in range(inserts):
            at = _FORCED[at]
        if edit == "D":
            yield code, cost + DELETE, at
        elif kind != MUST_GO:
            cost += TRUNCATED * (kind == CUT)
            if edit == "R":
                yield code, cost + REROLE, _FORCED[at]
            elif (at, initial) in _NEXT:
                yield code, cost + KEEP, _NEXT[at, initial]


_MOVES = {(i, k): [list(_moves(s, initial, k)) for s in range(4)] for i, initial in enumerate(INITIALS) for k in range(3)}
END = tuple(INSERT * _TAIL[s] for s in range(4))


class Steps:
    """The backward step of a row, remembered per (costs of the rest, initial, kind)."""

    def __init__(self):
        self.known: dict = {}

    def __call__(self, rest: tuple, initial: int, kind: int) -> tuple[tuple, int, int]:
        """Costs from before the row less their least, that least, and the four choices in 16 bits."""
        key = (rest, initial, kind)
        if key not in self.known:
            best = [min((cost + rest[to], code) for code, cost, to in moves) for moves in _MOVES[initial, kind]]
            least = min(b for b, _ in best)
            pointers = sum(code << 4 * s for s, (_, code) in enumerate(best))
            self.known[key] = (tuple(b - least for b, _ in best), least, pointers)
        return self.known[key]


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Damaged copies of the turns by crc32 of `conv:turn` modulo 20; `gone` marks those to be dropped.

    0 drops a turn, 1 empties its text, 2 removes its end marks, 3 repeats it, 4 makes its role user.
    """
    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    h = F.crc32(F.concat(plain(conv), F.lit(":"), plain(turn)).cast("binary")) % 20
    new_text = F.when(h == 1, F.lit("")).when(h == 2, F.translate(plain(text), ".!?", "")).otherwise(plain(text))
    return turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.when(h == 4, F.lit("user")).otherwise(plain(role)).alias("role"), new_text.alias("text"), (h == 0).alias("gone"),
        F.explode(F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


_ORDER = ["has_turn", "turn", "role", "th", "line"]
_KEYS = "key string, has_turn boolean, turn long, role string, th binary, line long, kind int"
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _prepared(turns: DataFrame, gone: str | None) -> DataFrame:
    """Stored turns with their sort keys, initial, and the faults that show in the turn itself."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    marks = F.rtrim(text, F.lit(SPACES))
    rows = turns.select(
        # The key is never null, so that pandas keeps every value as it is.
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"),
        F.col("turn").isNotNull().alias("has_turn"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        role.alias("role"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("th"), text.alias("text"),
        # 0 stands for any other initial, and for the empty role.
        F.greatest(F.array_position(F.array(*map(F.lit, INITIALS)), F.substring(role, 1, 1)) - 1, F.lit(0)).cast("int").alias("initial"),
        (marks == "").alias("blank"), (~F.right(marks, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
        (F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)).alias("gone"),
    )
    return store(rows.withColumn("line", F.monotonically_increasing_id()), "turns")


def _backwards(spill_rows: int):
    """Pass 1 over rows in falling order: chunks of pointers, the counts with the chunk that comes first."""
    columns = [f.split()[0] for f in _KEYS.split(", ")] + ["pointers", "head", *_COUNTS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps, key, out = Steps(), None, []
        pointers, last, counts, rest, total, later, first_of = [], None, None, None, 0, None, None
        turns = None

        def chunk(head: bool) -> None:
            values = [0] * 6
            if head:
                distinct, low, high = turns
                gaps = high - low + 1 - distinct if distinct else 0
                values = [gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], total + rest[START]]
            at = last or (key, False, 0, "", b"", -1)
            # Spilled in rising order, as they are read.
            out.append((*at, 0, np.array(pointers[::-1], "<u2").tobytes(), head, *values))

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.key != key:
                    if key is not None:
                        chunk(True)
                    key, pointers, last, rest, total, later = row.key, [], None, END, 0, None
                    counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
                    turns, first_of = (0, 0, 0), None
                if row.kind == 0:  # a marker: the row that follows is the first of its role and text
                    first_of = row.line
                    continue
                if row.gone:
                    continue
                if len(pointers) == spill_rows:
                    chunk(False)
                    pointers = []
                fault = "blank" if row.blank else "duplicate" if first_of != row.line else "truncated" if row.truncated else None
                if fault:
                    counts[fault] += 1
                if later is not None and INITIALS[row.initial] + later not in ("su", "ua", "au"):
                    counts["illegal"] += 1
                later = INITIALS[row.initial]
                if row.has_turn:
                    distinct, low, high = turns
                    if not distinct or row.turn != low:
                        turns = (distinct + 1, row.turn, high if distinct else row.turn)
                kind = CUT if fault == "truncated" else MUST_GO if fault else FINE
                rest, least, pointer = steps(rest, row.initial, kind)
                total += least
                pointers.append(pointer)
                last = (key, row.has_turn, row.turn, row.role, row.th, row.line)
            if out:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if key is not None:
            chunk(True)
            yield pd.DataFrame(out, columns=columns)

    return run


class _Digest:
    """One row per conversation: counts, cost, the edits' initials and the digest of the repaired turns."""

    columns = ["key", *_COUNTS, "audit", "repaired_sha256"]
    schema = "key string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"

    def __init__(self):
        self.out, self.size = [], 0

    def begin(self, key, counts):
        self.key, self.counts, self.audit, self.sha, self.any = key, counts, [], hashlib.sha256(), False

    def edit(self, row, edit, role):
        self.audit.append(edit)
        if edit != "D":
            said = f"{role}:{'' if edit == 'I' else row.text}".encode("utf-8", "surrogatepass")
            self.sha.update(b"\n" + said if self.any else said)
            self.any = True

    def end(self):
        self.out.append((self.key, *self.counts, "".join(self.audit), self.sha.hexdigest()))
        self.size += len(self.audit)


class _Turns:
    """One row per edit: its number, the edit, the turn it came from, and role and text of the turn that stays."""

    columns = ["key", "place", "edit", "has_turn", "turn", "role", "text"]
    schema = "key string, place long, edit string, has_turn boolean, turn long, role string, text string"

    def __init__(self):
        self.out, self.size = [], 0

    def begin(self, key, counts):
        self.key, self.place = key, 0

    def edit(self, row, edit, role):
        text = None if edit == "D" else "" if edit == "I" else row.text
        has_turn = edit != "I" and row.has_turn
        self.out.append((self.key, self.place, edit, has_turn, row.turn if has_turn else 0, None if edit == "D" else role, text))
        self.place += 1
        self.size += len(text or "")

    def end(self):
        pass


def _forwards(kind_of_sink):
    """Pass 2 over rows and pointer chunks in rising order."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sink, key, state, pointers, at = kind_of_sink(), None, START, None, 0

        def finish():
            for _ in range(_TAIL[state]):
                insert(None)
            sink.end()

        def insert(row):
            nonlocal state
            state = _FORCED[state]
            sink.edit(row, "I", ROLES[state])

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.kind == 0:
                    if row.head:
                        if key is not None:
                            finish()
                        key, state = row.key, START
                        sink.begin(key, [getattr(row, c) for c in _COUNTS])
                    pointers, at = np.frombuffer(row.pointers, "<u2"), 0
                    continue
                inserts, edit = CHOICES[int(pointers[at]) >> 4 * state & 15]
                at += 1
                for _ in range(inserts):
                    insert(row)
                role = row.role
                if edit == "R":
                    state = _FORCED[state]
                    role = ROLES[state]
                elif edit == "K":
                    state = _NEXT[state, role[:1]]
                sink.edit(row, edit, role)
                if len(sink.out) >= 5_000 or sink.size > 4_000_000:
                    yield pd.DataFrame(sink.out, columns=sink.columns)
                    sink.out, sink.size = [], 0
        if key is not None:
            finish()
        yield pd.DataFrame(sink.out, columns=sink.columns)

    return run


def _solved(turns: DataFrame, gone: str | None, sink, spill_rows: int) -> DataFrame:
    rows = _prepared(turns, gone)
    falling = ["key", *[F.col(c).desc() for c in _ORDER], "kind"]
    here = rows.where(~F.col("gone"))
    firsts = here.groupBy("key", "role", "th").agg(F.min(F.struct("has_turn", "turn", "line")).alias("f")).select(
        "key", "f.has_turn", "f.turn", "role", "th", "f.line", F.lit(0).alias("kind"))
    faults = ["initial", "blank", "truncated", "gone"]
    slim = rows.select("key", *_ORDER, F.lit(1).alias("kind"), *faults).unionByName(firsts.select(
        "*", F.lit(0).alias("initial"), *[F.lit(False).alias(c) for c in faults[1:]]))
    pointers = slim.repartition("key").sortWithinPartitions(*falling).mapInPandas(
        _backwards(spill_rows), f"{_KEYS}, pointers binary, head boolean, " + ", ".join(f"{c} long" for c in _COUNTS))
    merged = here.select("key", *_ORDER, F.lit(1).alias("kind"), "text").unionByName(
        pointers.withColumn("text", F.lit("")), allowMissingColumns=True)
    merged = merged.fillna(0, _COUNTS).fillna(False, ["head"])
    out = merged.repartition("key").sortWithinPartitions("key", *_ORDER, "kind").mapInPandas(_forwards(sink), sink.schema)
    kind = turns.schema["conv_id"].dataType
    return out.select(F.when(F.col("key") != "", F.substr("key", F.lit(2))).cast(kind).alias("conv_id"), *[c for c in out.columns if c != "key"])


def digests(turns: DataFrame, gone: str | None = None, spill_rows: int = SPILL_ROWS) -> DataFrame:
    """One row per conversation: gaps in its turns, counts of faults, cost, audit string and digest of the repaired turns.

    Turns with a true `gone` are left out, but their conversation has a row.
    """
    return _solved(turns, gone, _Digest, spill_rows)


def repair(turns: DataFrame, gone: str | None = None, spill_rows: int = SPILL_ROWS) -> DataFrame:
    """One row per edit in order of `place`: K, R and I with the role and text that stay, D with nulls."""
    out = _solved(turns, gone, _Turns, spill_rows)
    return out.withColumn("turn", F.when(F.col("has_turn"), F.col("turn"))).drop("has_turn")
