"""Quality rules: base counts of every text and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed 1- and 2-grams of text pieces (runs of letters and
digits, and runs of other marks): trusted-target documents against the whole raw corpus. It is
divided by the number of n-grams, and a document is kept when it reaches a fixed threshold.
DataFrame functions only.

Defined results: a null text is an empty text (no words, `base_failed`); repeated rows each get
their own result; without trusted documents every ratio is 0, so the base rules alone decide; an
empty table gives an empty result. Only the id and text columns are read, so other columns cannot
clash with results.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import SPACES, WORD_GAP, fresh, hash_bound, let, pin

# Hash buckets of the n-grams: the width of the two multinomials.
BUCKETS = 1 << 14
# Added to every bucket count of both multinomials.
SMOOTHING = 1.0
# Least mean log-likelihood ratio per n-gram of a kept document.
THRESHOLD = -0.25
# Most labelled documents that the trusted target is fitted on (the lowest hashes of their ids).
TRUSTED_ROWS = 20_000

SYMBOLS = "#*$%&|<>"
PIECES = r"[\p{L}\p{N}]++|[^\s\p{L}\p{N}]++"


def ngram_hashes(text: Column) -> Column:
    """64-bit hashes of all 1- and 2-grams of a text's pieces; the bucket is the hash modulo the width.

    The 2-gram of two neighbours is mixed from their two 1-gram hashes, so no string is rebuilt.
    """
    ones = F.transform(F.regexp_extract_all(F.lower(text), F.lit(PIECES), F.lit(0)), lambda t: F.xxhash64(t))
    return F.transform(F.array(F.struct(ones.alias("h"))), lambda s: F.concat(
        s["h"], F.zip_with(s["h"], F.slice(s["h"], 2, F.size(s["h"])), lambda a, b: F.xxhash64(a, b))))[0]


def trusted_ids(labels: DataFrame, most: int = TRUSTED_ROWS) -> DataFrame:
    """Ids labelled as good, at most `most` of them, chosen by hash; bounded, so safe to broadcast.

    The ids are counted first, so that only those under a hash bound, hardly more than `most`, are ordered.
    """
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    h = F.xxhash64("doc_id")
    return good.where(h <= F.lit(hash_bound(good.count(), most))).orderBy(h, "doc_id").limit(most)


def fit_ratio(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """One row with `weights`, the log ratio of each bucket; raw counts cover every document."""
    marked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(
        F.broadcast(trusted.select(F.col("doc_id").alias("id"), F.lit(1).alias("good"))), "id", "left"
    )
    seen = marked.select(F.explode(ngram_hashes(F.col("text"))).alias("h"), F.col("good"))
    counts = seen.groupBy(F.pmod("h", F.lit(buckets)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    # At most `buckets` rows meet here.
    table = every.join(counts, "b", "left").agg(
        F.array_sort(F.collect_list(F.struct(
            "b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")))).alias("c"),
        F.coalesce(F.sum("raw"), F.lit(0)).alias("raw_all"), F.coalesce(F.sum("target"), F.lit(0)).alias("target_all"),
    )
    smooth, whole = F.lit(SMOOTHING), F.lit(SMOOTHING * buckets)
    ratio = F.transform("c", lambda x: F.log((x["target"] + smooth) / (F.col("target_all") + whole))
                        - F.log((x["raw"] + smooth) / (F.col("raw_all") + whole)))
    none = F.transform("c", lambda x: F.lit(0.0))
    return pin(table.select(F.when(F.col("target_all") > 0, ratio).otherwise(none).alias("weights")))


def _repeat_words(w: str) -> str:
    """SQL: words inside 3-word windows that occur twice or more, from the word array `w`.

    Each window is one long: the low bits hold its place, the others its hash. After sorting, equal
    windows are neighbours; the words themselves are compared, so the count is exact.
    """
    hashes = (f"transform(slice({w}, 1, greatest(size({w}) - 2, 0)), (x, i) -> "
              f"xxhash64(x, get({w}, i + 1), get({w}, i + 2)))")
    packed = "sort_array(transform(h, (x, i) -> shiftleft(x, b) | i))"
    near = "filter(s, (x, k) -> shiftright(x, b) <=> shiftright(get(s, k - 1), b) or shiftright(x, b) <=> shiftright(get(s, k + 1), b))"

    def same(step: str) -> str:
        there = f"cast(get(c, k {step} 1) & m as int)"
        return " and ".join(f"get({w}, cast(x & m as int) + {j}) <=> get({w}, {there} + {j})" for j in range(3))

    twice = f"filter(c, (x, k) -> {same('-')} or {same('+')})"
    cover = (f"aggregate(array_sort(transform({twice}, x -> cast(x & m as int))), struct(0 as n, -3 as last), "
             "(a, p) -> struct(a.n + least(3, p - a.last) as n, p as last), a -> a.n)")
    inner = let(packed, "s", let(near, "c", let("shiftleft(1L, b) - 1", "m", cover)))
    inner = let(f"length(bin(size({w})))", "b", inner)
    return let(hashes, "h", f"if(size(array_distinct(h)) = size(h), 0, {inner})")


def base_counts(text: Column) -> dict[str, Column]:
    """The counts that need no word array."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_dup = F.transform(F.array(F.struct(lines.alias("l"))), lambda s: F.size(s["l"]) - F.size(F.array_distinct(s["l"])))[0]
    return {
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": n_dup.cast("long"),
    }


def annotate(df: DataFrame, weights: DataFrame, into: str, text_col: str = "text", threshold: float = THRESHOLD,
             buckets: int = BUCKETS) -> DataFrame:
    """Add one struct column named `into` with all counts, the ratio and the verdict of each row.

    `into` must not be a column of the frame.
    """
    text, w, g = (fresh(df, f"__{into}_{n}") for n in ("text", "w", "g"))
    out = df.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumns({
        w: F.array_remove(F.split(F.col(text), WORD_GAP, -1), ""), g: ngram_hashes(F.col(text)),
    })
    # The weights are `buckets` numbers, so they go into the plan as one constant.
    ratios = F.from_json(F.lit(json.dumps(weights.first()["weights"])), "array<double>")
    total = F.aggregate(F.col(g), F.lit(0.0), lambda a, h: a + F.get(ratios, F.pmod(h, F.lit(buckets)).cast("int")))
    repeat = F.expr(_repeat_words(f"`{w}`")).cast("long")
    counts = base_counts(F.col(text))
    out = out.withColumn(into, F.struct(
        F.size(w).cast("long").alias("n_words"), *[c.alias(n) for n, c in counts.items()], repeat.alias("n_repeat_words"),
        F.when(F.size(g) > 0, total / F.size(g)).otherwise(F.lit(0.0)).alias("score"),
    )).drop(text, w, g)
    c = F.col(into)
    failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
    return out.withColumn(into, c.withField("base_failed", failed)
                          .withField("kept", ~failed & (c["score"] >= F.lit(threshold))))


def keep_good(df: DataFrame, weights: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that pass, with their own columns only.

    Rows go through a generator, not a filter: a filter would be pushed below the columns it reads, and
    the word array, written out inside the window functions, would be made again for every word.
    """
    into = fresh(df, "quality")
    out = annotate(df, weights, into, text_col, threshold)
    return out.withColumn(into, F.explode(F.filter(F.array(F.col(into)), lambda q: q["kept"]))).drop(into)
