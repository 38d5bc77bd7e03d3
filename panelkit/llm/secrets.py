"""Secret scans: pattern matches, and sliding-window Shannon entropy per character class.

Three patterns give the base spans: `assign` (a name like password or api_key, then = or :, then a
value of 8 or more), `access` (AKIA keys of 16 or more) and `hex` (32 or more lower-case hex
digits). Further spans come from candidate strings, runs of 20 or more of `[A-Za-z0-9+/_=-]`. A
candidate belongs to the narrowest character class that holds all of its characters (hex, alnum,
base64). A window of 20 slides over it; the counts of its characters are kept up as one enters and
one leaves, and so is the sum of c*log2(c), from which the entropy follows. Windows at or above the
class's threshold, joined where they touch, are spans of kind `<class>_entropy`. An allow-list
suppresses candidates (not base spans) that are no secrets: without a digit or without a letter,
made of plain words and plain numbers, UUIDs, integrity hashes, and placeholders.

Spans are in code points, the end exclusive. Entropy is compared in whole millionths, so every
engine draws the line at the same place. DataFrame functions only; a row is judged by itself, so
there is no shuffle and no group.

Defined results: a null text is empty and has no spans; repeated rows each get their own result; an
empty table gives an empty result; only the id and text columns are read, so other columns cannot
clash with results.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names before an assigned secret, in either case, and the base patterns.
NAMES = ["password", "passwd", "secret", "token", "api_?key"]
VALUE = "[A-Za-z0-9+/_.=-]"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMED = "(" + "|".join(_either_case(n) for n in NAMES) + ")"
ASSIGN = NAMED + r"""["']?\x20*[:=]\x20*["']?(""" + VALUE + "+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}

# Width of the sliding window, which is also the shortest candidate.
WINDOW = 20
CANDIDATE = "[A-Za-z0-9+/_=-]{%d,}" % WINDOW
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Character classes from narrow to wide: name, its characters, least entropy of a window in bits.
CLASSES = [
    ("hex", _DIGITS + "abcdef" + "ABCDEF", 2.9),
    ("alnum", _DIGITS + _LOWER + _UPPER, 3.5),
    ("base64", _DIGITS + _LOWER + _UPPER + "+/_=-", 3.6),
]
KINDS = [*LEAST, *[f"{name}_entropy" for name, _, _ in CLASSES]]
# Candidates that are no secrets, as patterns over the whole candidate.
ALLOWED = {
    "no digit or no letter": "[^0-9]+|[^A-Za-z]+",
    "plain words and numbers": "[+/_=-]*([A-Za-z]+|[0-9]+)([+/_=-]+([A-Za-z]+|[0-9]+))*[+/_=-]*",
    "UUID": "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    "integrity hash": "(sha256|sha384|sha512)-.*",
    "placeholder": ".*([eE][xX][aA][mM][pP][lL][eE]|[pP][lL][aA][cC][eE][hH][oO][lL][dD][eE][rR]|[xX]{6}|[dD][uU][mM][mM][yY]).*",
}
_BLOCK = 256
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def parts_of_sum(window: int = WINDOW) -> list[int]:
    """c*log2(c) of every count, in whole millionths."""
    return [round(1e6 * c * math.log2(c)) if c else 0 for c in range(window + 1)]


def most_sum(least_bits: float, window: int = WINDOW) -> int:
    """The sum of c*log2(c) up to which a window has the given entropy: H = log2(w) - sum/w."""
    return math.floor(1e6 * window * (math.log2(window) - least_bits))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it in `body`."""
    return F.transform(F.array(value), body)[0]


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _ends(lengths: Column) -> Column:
    """Running totals, in blocks, so that a text with very many matches costs no square of them."""
    def run(sizes: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: _total(F.slice(sizes, b * _BLOCK + 1, _BLOCK)))
        before = let(sums, lambda s: F.transform(s, lambda _, b: _total(F.slice(s, 1, b))))
        return let(before, lambda at: F.transform(sizes, lambda _, i: F.get(at, F.floor(i / _BLOCK).cast("int")) + _total(
            F.slice(sizes, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK + 1))))

    return let(lengths, lambda sizes: F.when(F.size(sizes) == 0, sizes).otherwise(run(sizes)))


def _matches(text: Column, pattern: str, body: Callable[[Column], Column], kind: str, group: int = 0) -> Column:
    """body(all leftmost non-overlapping matches as structs of start, end and the wanted group).

    The starts follow from the lengths of the matches and of the text between them.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    ends = let(found, lambda m: let(between, lambda g: _ends(F.transform(m, lambda x, i: F.length(x) + F.length(F.get(g, i))))))
    wanted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pairs = F.zip_with(F.arrays_zip(ends.alias("end"), found.alias("all")), wanted,
                       lambda p, w: F.struct((p["end"] - F.length(p["all"])).alias("start"), p["end"].alias("end"), w.alias("part")))
    out = body(pairs)
    return F.when(text.rlike(pattern), out).otherwise(F.array().cast(kind))


def _base(text: Column, kind: str, pattern: str, group: int = 0) -> Column:
    code, least = KINDS.index(kind), LEAST[kind]

    def spans(pairs: Column) -> Column:
        kept = F.filter(pairs, lambda p: F.length(p["part"]) >= least)
        return F.transform(kept, lambda p: F.struct(p["start"].alias("start"), F.lit(code).alias("kind"), p["end"].alias("end")))

    return _matches(text, pattern, spans, _SPAN, group)


def _hot_stretches(candidate: Column, alphabet: str, most: int) -> Column:
    """Joined windows whose entropy is high enough, as (from, to) inside the candidate.

    The state holds the window's count of every character of the class, the sum of c*log2(c), and
    the stretch that is open.
    """
    pieces = F.array(*[F.lit(v).cast("long") for v in parts_of_sum()])
    places = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)

    def scan(at: Column) -> Column:
        stretch = "array<struct<a:int,b:int>>"
        start = F.struct(
            F.array_repeat(F.lit(0), len(alphabet)).alias("n"), F.lit(0).cast("long").alias("s"), F.lit(0).alias("i"),
            F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.array().cast(stretch).alias("out"))

        def step(z: Column, new: Column) -> Column:
            old = F.when(z["i"] >= WINDOW, F.get(at, z["i"] - WINDOW)).otherwise(F.lit(-1))

            def moved(o: Column) -> Column:
                had = F.coalesce(F.get(z["n"], F.when(o >= 0, o)), F.lit(0))
                has = F.get(z["n"], new) - (o == new).cast("int")
                s = (z["s"] + F.when(o >= 0, F.get(pieces, had - 1) - F.get(pieces, had)).otherwise(F.lit(0))
                     + F.get(pieces, has + 1) - F.get(pieces, has))
                return F.struct(
                    F.transform(z["n"], lambda c, k: c + (k == new).cast("int") - (k == o).cast("int")).alias("n"),
                    s.alias("s"), (z["i"] + 1).alias("i"))

            def joined(m: Column) -> Column:
                hot, first = (m["i"] >= WINDOW) & (m["s"] <= F.lit(most)), m["i"] - WINDOW
                goes_on = (z["b"] >= 0) & (first <= z["b"])
                closes = hot & (z["b"] >= 0) & ~goes_on
                return F.struct(
                    m["n"].alias("n"), m["s"].alias("s"), m["i"].alias("i"),
                    F.when(hot & ~goes_on, first).otherwise(z["a"]).alias("a"),
                    F.when(hot, m["i"]).otherwise(z["b"]).alias("b"),
                    F.when(closes, F.array_append(z["out"], F.struct(z["a"].alias("a"), z["b"].alias("b"))))
                    .otherwise(z["out"]).alias("out"))

            return let(let(old, moved), joined)

        def finish(z: Column) -> Column:
            return F.when(z["b"] >= 0, F.array_append(z["out"], F.struct(z["a"].alias("a"), z["b"].alias("b")))).otherwise(z["out"])

        return F.aggregate(at, start, step, finish)

    return let(places, scan)


def _entropy(text: Column) -> Column:
    def spans(pairs: Column) -> Column:
        allowed = "|".join(f"(?:{a})" for a in ALLOWED.values())
        kept = F.filter(pairs, lambda p: ~p["part"].rlike(f"^(?:{allowed})$"))

        def of_class(p: Column, code: int, alphabet: str, bits: float) -> Column:
            return F.transform(_hot_stretches(p["part"], alphabet, most_sum(bits)), lambda h: F.struct(
                (p["start"] + h["a"]).alias("start"), F.lit(code).alias("kind"), (p["start"] + h["b"]).alias("end")))

        def of(p: Column) -> Column:
            made = F.lit(None).cast(_SPAN)
            for name, alphabet, bits in reversed(CLASSES):
                inside = F.length(F.translate(p["part"], alphabet, "")) == 0
                made = F.when(inside, of_class(p, KINDS.index(f"{name}_entropy"), alphabet, bits)).otherwise(made)
            return made

        return F.flatten(F.transform(kept, of))

    return _matches(text, CANDIDATE, spans, _SPAN)


def _written(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    named = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(
        F.get(named, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, `base` and `added` spans as arrays of (start, kind number, end)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(_base(text, "assign", ASSIGN, 2), _base(text, "access", ACCESS), _base(text, "hex", "[0-9a-f]{32,}"))
    return docs.select(F.col(id_col).alias("doc_id"), base.alias("base"), _entropy(text).alias("added"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text."""
    # Spans are built once per row: a generator keeps them from being written out again in each result column.
    found = scan(docs, id_col, text_col).select("doc_id", F.inline(F.array(F.struct("base", "added"))))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(kind) for kind in LEAST], F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.concat("base", "added")).alias("spans"))


def oracle_sql() -> str:
    """DuckDB SQL for the rows of `digests` over `documents`; windows are counted anew, not incrementally."""
    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def matched(name: str, pattern: str, group: int = 0) -> str:
        p = quoted(pattern)
        return f"""SELECT r, '{name}' AS name, len(m[i]) AS n, p[i] AS part,
 CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
 FROM (SELECT r, m, p, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, regexp_extract_all(text, {p}) AS m,
 regexp_extract_all(text, {p}, {group}) AS p, string_split_regex(text, {p}) AS g FROM d))"""

    base = " UNION ALL ".join(
        f"SELECT r, {KINDS.index(k)} AS kind, a, a + n AS b FROM ({matched(k, pattern, group)}) WHERE length(part) >= {LEAST[k]}"
        for k, pattern, group in (("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0)))
    allowed = " OR ".join(f"regexp_full_match(part, {quoted(a)})" for a in ALLOWED.values())
    classes = " ".join(
        f"WHEN len(translate(part, '{alphabet}', '')) = 0 THEN {KINDS.index(name + '_entropy')}" for name, alphabet, _ in CLASSES)
    limits = " ".join(f"WHEN {KINDS.index(name + '_entropy')} THEN {most_sum(bits)}" for name, _, bits in CLASSES)
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    written = f"([{kinds}])[kind + 1] || ':' || a || ':' || b, ',' ORDER BY a, kind, b"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {k}) AS n_{name}" for k, name in enumerate(LEAST))
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
 b AS ({base}),
 c AS (SELECT row_number() OVER () AS c, r, a, part, CASE {classes} END AS kind FROM ({matched("candidate", CANDIDATE)}) WHERE NOT ({allowed})),
 w AS (SELECT c, k, string_split(substr(part, k + 1, {WINDOW}), '') AS w FROM (SELECT c, part, unnest(range(len(part) - {WINDOW} + 1)) AS k FROM c)),
 s AS (SELECT c, k, CAST(list_sum(list_transform(list_distinct(w), lambda x: ({parts_of_sum()[1:]})[len(list_filter(w, lambda y: y = x))])) AS BIGINT) AS s FROM w),
 h AS (SELECT c, k, a, r, kind FROM s JOIN c USING (c) WHERE s <= CASE kind {limits} END),
 o AS (SELECT *, CASE WHEN k <= lag(k) OVER (PARTITION BY c ORDER BY k) + {WINDOW} THEN 0 ELSE 1 END AS new FROM h),
 i AS (SELECT *, sum(new) OVER (PARTITION BY c ORDER BY k) AS island FROM o),
 e AS (SELECT any_value(r) AS r, any_value(kind) AS kind, any_value(a) + min(k) AS a, any_value(a) + max(k) + {WINDOW} AS b FROM i GROUP BY c, island),
 x AS (SELECT r, {counts}, string_agg({written}) AS written FROM b GROUP BY r),
 y AS (SELECT r, string_agg({written}) AS spans FROM (SELECT * FROM b UNION ALL SELECT * FROM e) GROUP BY r)
 SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in LEAST)}, sha256(coalesce(written, '')) AS base_sha256,
 coalesce(spans, '') AS spans FROM d LEFT JOIN x USING (r) LEFT JOIN y USING (r)"""
