"""Conversation repair against an exhaustive search of the cheapest edits, least audit string first."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from panelkit.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile("(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        out += [] if h == 0 else [(turn, role, text)] * (2 if h == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


def cheapest(rows, kinds):
    """Uniform-cost search over (cost, audit): the first finished sequence is the cheapest, and least of these."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, initials, turns = heapq.heappop(heap)
        if (audit, i, initials) in seen:
            continue
        seen.add((audit, i, initials))
        if i == len(rows) and LEGAL.fullmatch(initials):
            return cost, audit, turns
        def go(price, letter, step, turn):
            new = initials + (turn[0][:1] if turn else "")
            # Only beginnings of legal sequences are followed.
            if re.fullmatch("(s?(ua)*u?)?", new) and (turn is None or turn[0]):
                heapq.heappush(heap, (cost + price, audit + letter, i + step, new, turns + ((turn,) if turn else ())))
        if not audit.endswith("II"):
            go(5, "I", 0, ("user", ""))
            go(5, "I", 0, ("assistant", ""))
        if i < len(rows):
            _, role, text = rows[i]
            go(2, "D", 1, None)
            if kinds[i] not in ("blank", "duplicate"):
                more = 5 if kinds[i] == "truncated" else 0
                go(more, "K", 1, (role, text))
                go(1 + more, "R", 1, ("user", text))
                go(1 + more, "R", 1, ("assistant", text))


def brute(conv, rows):
    rows = damaged(rows)
    kinds, seen = [], set()
    for _, role, text in rows:
        plain = text.strip(" \t\n\v\f\r")
        kinds.append("blank" if not plain else "duplicate" if (role, text) in seen else "truncated" if plain[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, repaired = cheapest(rows, kinds)
    initials = [r[:1] for _, r, _ in rows]
    return (
        conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest(),
    )


def conversations_of(rng, n):
    rows = []
    for conv in [None, *range(n)]:
        for k in range(rng.randrange(1, 8)):
            turn = rng.choice([k, k, k, k, k, k + 2, None])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["a.", "b!", "c", " ", "", "é?\n", None, f"t{k}.", f"u{k}", f"v{k}.", "😀. "])
            rows.append((conv, turn, role, text))
    return rows


@pytest.fixture(scope="module")
def cases():
    rows = conversations_of(random.Random(11), 700)
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return rows, sorted((brute(c, g) for c, g in groups.items()), key=str)


@pytest.mark.parametrize("spill_rows", [1, 3, conversations.SPILL_ROWS])
def test_rows_equal_exhaustive_search(spark, cases, spill_rows):
    rows, want = cases
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = conversations.digests(conversations.damage(frame), "gone", spill_rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert any(r[7] == "" for r in want) and len({r[7] for r in want}) > 100


def test_repaired_turns_give_the_digest(spark, cases):
    rows, want = cases
    frame = conversations.damage(spark.createDataFrame(rows, SCHEMA))
    edits = {}
    for r in sorted(conversations.repair(frame, "gone").collect(), key=lambda r: (str(r["conv_id"]), r["place"])):
        edits.setdefault(r["conv_id"], []).append(r)
    for row in want:
        got = edits.get(row[0], [])
        assert "".join(r["edit"] for r in got) == row[7]
        said = "\n".join(f"{r['role']}:{r['text']}" for r in got if r["edit"] != "D")
        assert hashlib.sha256(said.encode()).hexdigest() == row[8]
        assert [r["place"] for r in got] == list(range(len(got)))


def test_giant_conversation_spills_and_streams(spark):
    n = 30_000
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}.") for i in range(n)] + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(8)
    got = {r["conv_id"]: r for r in conversations.digests(frame, spill_rows=1000).collect()}
    assert got[1]["audit"] == "K" * n and got[1]["cost"] == 0 and got[2]["audit"] == "KK"
    said = "\n".join(f"{r[2]}:{r[3]}" for r in rows[:n])
    assert got[1]["repaired_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[1]["gaps"] == got[1]["illegal"] == 0


def test_hot_text_large_ids_empty_table_and_other_columns(spark):
    big = 2**60 + 1
    frame = spark.createDataFrame(
        [(big, None, "user", "same.", 1, "x"), *[(big, big + i, "user", "same.", 1, "x") for i in range(50)]],
        SCHEMA + ", line int, key string")
    row = conversations.digests(frame).first()
    assert (row["conv_id"], row["duplicate"], row["gaps"]) == (big, 50, 0)
    assert row["audit"] == "D" * 51
    assert conversations.digests(frame.limit(0)).count() == 0
    gone = conversations.damage(spark.createDataFrame([(c, 0, "user", "a.") for c in range(200)], SCHEMA))
    assert conversations.digests(gone, "gone").count() == 200
