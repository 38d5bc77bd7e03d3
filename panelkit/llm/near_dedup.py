"""MinHash near-duplicate groups: universal hash minima, banding, verification, large-star and small-star.

1. One pass over the texts makes each document's shingle set (64-bit hashes), a fingerprint of the
   set, HASHES universal hash minima, and BANDS band keys of ROWS minima each.
2. Documents with equal sets form one class; only classes are compared.
3. A band key shared by classes is a bucket. Buckets may hold a third of all rows, so pairs are not
   spelled out. Every member is compared with the bucket's hub (the class with the largest buckets).
   What remains outside a bucket's main component is then compared, in broadcast blocks, with all
   members of the bucket. So each pair of a bucket is compared, or already lies in one component.
4. A pair is confirmed on the two full sets, after a signature estimate far below the threshold
   has been ruled out (6 standard deviations of HASHES minima).
5. Components of the links: alternating large-star and small-star until nothing changes.

Steps whose result is small are stored before the next one is planned: the driver holds the code, statistics and
metrics of a plan, and a step that two later ones read would be planned and run twice.

A pair at the threshold of 0.8 shares a band but for 1 in 4 million (2.5e-7), and passes the signature
estimate but for 1 in 120 million. Equal sets are told by their size and a fingerprint of 128 bits; sets of
64-bit hashes stand for sets of shingles.

Defined results: null and empty texts have empty sets and are linked with nothing; rows with a null
id take no part in links and are kept; repeated rows share a class and, with the same id, are all
kept; the smallest id of a component represents it; only the id and text columns are read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import encoded, fresh, pin, store

ROWS = 6
BANDS = 50
HASHES = ROWS * BANDS
SIMILARITY_PERCENT = 80
# Signature estimates below this rule a pair out.
SCREEN = 0.8 - 6 * (0.8 * 0.2 / HASHES) ** 0.5
# Most outsiders, and about the most shingles of them, in one broadcast block.
BLOCK_MEMBERS = 4096
BLOCK_SHINGLES = 2_000_000
# Members of a bucket that meet its hub in one task.
BUCKET_PART = 256

_U64 = np.uint64
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(20_240_607)
_MULT = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_ROW_MULT = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) | _U64(1)
_BAND_SALT = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_BASE = _U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def hashed_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and 64-bit hashes of the words of a text: polynomials of their bytes, mixed."""
    data = np.frombuffer(raw, np.uint8)
    gap = _GAP[data]
    word = ~gap
    starts = np.flatnonzero(word & np.concatenate(([True], gap[:-1])))
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    at = np.flatnonzero(word)
    first = np.searchsorted(at, starts)
    sizes = np.diff(np.concatenate((first, [len(at)])))
    place = at - np.repeat(starts, sizes)
    power = np.concatenate(([_U64(1)], np.cumprod(np.full(int(sizes.max()) - 1, _BASE)))) if sizes.max() > 1 else np.ones(1, np.uint64)
    return starts, mix(np.add.reduceat((data[at].astype(np.uint64) + _U64(1)) * power[place], first) + sizes.astype(np.uint64))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's `words`-word shingles; fewer words are one shingle."""
    _, h = hashed_words(encoded(text).lower())
    if not len(h):
        return h
    width = min(words, len(h))
    total = np.full(len(h) - width + 1, _U64(width))
    for j in range(width):
        total = mix(total) + h[j:len(h) - width + 1 + j]
    return np.unique(mix(total))


def minima(members: np.ndarray) -> np.ndarray:
    """The least value of every universal hash (a * x + b modulo 2^32) over a set."""
    x = (members >> _U64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        values = _MULT[:, None] * x[None, i:i + 1024]
        values += _ADD[:, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    grid = values.reshape(BANDS, ROWS).astype(np.uint64)
    return mix((mix(grid + _U64(1)) * _ROW_MULT).sum(axis=1, dtype=np.uint64) + _BAND_SALT)


def records(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, text hash, set size, set fingerprint, band keys and a signature of one byte per minimum."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sizes, one, two, keys, signatures = [], [], [], [], []
            for text in texts:
                s = shingle_set(text, words)
                sizes.append(len(s))
                one.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                two.append(int(mix(s ^ _BASE).sum(dtype=np.uint64).astype(np.int64)))
                if len(s):
                    m = minima(s)
                    keys.append(band_keys(m).astype(np.int64))
                    signatures.append((m & np.uint32(255)).astype(np.uint8).tobytes())
                else:
                    keys.append(None)
                    signatures.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
                names=["doc_id", "th", "n", "fp1", "fp2", "bands", "sig"])

    return rows.mapInArrow(run, f"doc_id {kind}, th long, n long, fp1 long, fp2 long, bands array<long>, sig binary")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (a, b): root is the smallest node of the component."""
    edges = pin(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            return pin(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select("b", F.col("b").alias("root")).distinct()))
        seen = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = pin(both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = pin(rest.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())


def _estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity estimates from byte signatures, chance agreement of a byte taken out."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def _sizes_fit(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= SIMILARITY_PERCENT * F.greatest(a, b)


def _screen(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and signature estimates do not rule the link out."""
    side = classes.select("cls", "n", "sig")
    rows = pairs.join(side.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
    rows = rows.join(side.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
    rows = rows.where(_sizes_fit(F.col("na"), F.col("nb"))).select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, HASHES)
            b = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, HASHES)
            yield batch.select(["a", "b"]).filter(pa.array(_estimate(a, b) >= SCREEN))

    return rows.mapInArrow(run, "a long, b long")


def _is_link(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= SIMILARITY_PERCENT * (len(a) + len(b) - both)


def _confirm(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Pairs whose full sets reach the similarity."""
    rows = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a")
    rows = rows.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches):
        last, of_last = None, None
        for batch in batches:
            linked = []
            for b, ta, tb in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if b != last:
                    last, of_last = b, shingle_set(tb, words)
                linked.append(_is_link(shingle_set(ta, words), of_last))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _join_key(members: DataFrame, keys: DataFrame) -> DataFrame:
    """Members (with the size n of their bucket) joined with one row per key; large buckets are dealt over several tasks."""
    parts = F.ceil(F.col("n") / F.lit(BUCKET_PART)).cast("long")
    dealt = members.withColumn("part", F.pmod(F.xxhash64("cls"), parts))
    return dealt.join(keys.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n"), ["key", "part"]).drop("part")


def _hub_pairs(members: DataFrame) -> DataFrame:
    """Pairs of every member with its bucket's hub, the member of the largest weight (the sum of its buckets' sizes)."""
    weight = members.groupBy("cls").agg(F.sum("n").alias("w"))
    hubs = members.join(weight, "cls").groupBy("key").agg(F.max(F.struct("w", -F.col("cls"))).alias("h"), F.first("n").alias("n"))
    rows = _join_key(members, hubs.select("key", "n", (-F.col("h.col2")).alias("hub"))).where("cls <> hub")
    return rows.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct()


def _open_buckets(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members (key, cls, comp) of the buckets that still touch several components.

    A bucket of two is left out, as the hub has met its only other member.
    """
    rows = members.where("n > 2").join(groups.select(F.col("node").alias("cls"), "root"), "cls", "left")
    rows = rows.select("key", "cls", "n", F.coalesce("root", "cls").alias("comp"))
    still = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.first("n").alias("n")).where("x <> y").select("key", "n")
    return _join_key(rows, pin(still)).drop("n")


def _outsider_links(rows: DataFrame, classes: DataFrame, texts: DataFrame, words: int) -> list[DataFrame]:
    """Links between members outside a bucket's main component (outsiders) and members of its other components.

    Outsiders are taken in blocks of bounded number and size. A block is broadcast, every member of its
    buckets meets it once, whatever the number of buckets they share, and of the links between an outsider and one
    component each task reports the first.
    """
    spark = rows.sparkSession
    parts = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = parts.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m"))
    outside = pin(rows.join(main.select("key", F.col("m.comp").alias("main")), "key").where("comp <> main").select("key", "cls", "comp"))
    kinds = outside.select("cls").distinct().join(classes.select("cls", "n"), "cls")
    count, size = kinds.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    pieces = max(-(-count // BLOCK_MEMBERS), -(-size // BLOCK_SHINGLES))
    found = []
    for k in range(pieces):
        mine = outside.where(F.pmod(F.xxhash64("cls"), F.lit(pieces)) == k)
        block = mine.groupBy("cls").agg(F.collect_list("key").alias("keys"), F.first("comp").alias("comp"))  # BANDS keys at most
        block = block.join(classes.select("cls", "n", "sig"), "cls").join(texts, "cls").collect()
        shared = spark.sparkContext.broadcast([
            (r["cls"], r["comp"], r["n"], bytes(r["sig"]), shingle_set(r["text"], words), r["keys"]) for r in block])
        # The block's keys are bounded like its members.
        touched = rows.join(F.broadcast(mine.select("key").distinct()), "key").groupBy("cls").agg(
            F.collect_list("key").alias("keys"), F.first("comp").alias("comp"))
        touched = touched.join(classes.select("cls", "n", "sig"), "cls").join(texts, "cls").select("cls", "comp", "n", "sig", "keys", "text")

        def run(batches, shared=shared):
            block = shared.value
            comp, n = np.array([r[1] for r in block], np.int64), np.array([r[2] for r in block], np.int64)
            sig = np.frombuffer(b"".join(r[3] for r in block), np.uint8).reshape(-1, HASHES)
            at: dict[int, list[int]] = {}
            for i, r in enumerate(block):
                for key in r[5]:
                    at.setdefault(key, []).append(i)
            done = set()
            for batch in batches:
                out = []
                for cls, c, size, s, keys, text in zip(*(batch.column(i).to_pylist() for i in range(6))):
                    near = np.unique(np.concatenate([at[key] for key in keys]))
                    near = near[(comp[near] != c) & (100 * np.minimum(n[near], size) >= SIMILARITY_PERCENT * np.maximum(n[near], size))]
                    near = near[_estimate(sig[near], np.frombuffer(s, np.uint8)) >= SCREEN]
                    mine = None
                    for i in near.tolist():
                        if (i, c) in done:
                            continue
                        mine = shingle_set(text, words) if mine is None else mine
                        if _is_link(block[i][4], mine):
                            done.add((i, c))
                            out.append((block[i][0], cls))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())],
                                                 names=["a", "b"])

        found.append(pin(touched.mapInArrow(run, "a long, b long")))
        shared.destroy()  # the links are stored, so no task needs the block again
    return found


def classify(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, th (hash of the text), n_shingles, component_id and kept."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = store(records(docs, words), "records")
    classes = found.where("n > 0 and doc_id is not null").groupBy("n", "fp1", "fp2").agg(
        F.min(F.struct("doc_id", "th")).alias("r"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = store(classes.select(
        F.monotonically_increasing_id().alias("cls"), F.col("r.doc_id").alias("rep"), F.col("r.th").alias("th"),
        "n", "fp1", "fp2", "bands", "sig"), "classes")

    keys = classes.select("cls", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = store(keys.join(shared, "key").select("key", "cls", "n"), "members")

    # Texts of the classes in buckets, fetched once for all confirmations; rows of one id and text are the same text.
    inside = members.select("cls").distinct().join(classes.select("cls", F.col("rep").alias("doc_id"), "th"), "cls")
    texts = inside.join(docs.withColumn("th", F.xxhash64("text")), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("cls", "text")
    texts = store(texts, "texts")

    hub_pairs = pin(_screen(pin(_hub_pairs(members)), classes))
    groups = components(_confirm(hub_pairs, texts, words))
    links = _outsider_links(pin(_open_buckets(members, groups)), classes, texts, words)
    if links:
        links.append(groups.select(F.col("node").alias("a"), F.col("root").alias("b")))
        groups = components(reduce(DataFrame.union, links))

    named = classes.select("cls", "rep", "n", "fp1", "fp2")
    named = named.join(groups.select(F.col("node").alias("cls"), "root"), "cls", "left")
    named = pin(named.select("rep", "n", "fp1", "fp2", F.coalesce("root", "cls").alias("root")))
    named = named.join(named.groupBy("root").agg(F.min("rep").alias("component_id")), "root")
    out = found.select("doc_id", "th", "n", "fp1", "fp2").join(named.select("n", "fp1", "fp2", "component_id"), ["n", "fp1", "fp2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "th", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_single(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of each group, all columns kept: the smallest id, nulls last, then the smallest row key.

    Rows are grouped under a stored row key, so repeated rows, rows that share an id and rows without an id
    are members like all others. Rows with an empty set are in no group and are kept.
    """
    key = fresh(docs, "row_key")
    rows = store(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    groups = classify(rows, words, key, text_col).select(F.col("doc_id").alias(key), "component_id")
    ids = rows.select(key, F.col(id_col).alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col(key).alias("row"))).alias("first")
    kept = pin(groups.join(ids, key).groupBy("component_id").agg(first).select(F.col("first.row").alias(key)))
    return rows.join(kept, key, "left_semi").select(docs.columns)
