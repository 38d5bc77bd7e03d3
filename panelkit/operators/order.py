"""Ranks, n-tiles, running totals and exact quantiles that do not put a group in one task.

A bounded sample of the order keys gives range boundaries, which are fixed in the plan. A row's range
is then a function of the row alone (a binary search among the boundaries), so nothing has to be
stored for later branches to agree, and a lost task is made again as it was. Per (group, range)
subtotals, combined before the shuffle, give each range its offset; positions and sums inside a range
come from one window, so the rows are exchanged once. A hot group or key value is spread over as
many ranges as its share of the rows.

The n-th row in an order needs no ranking at all: the subtotals name its range, only that range is
ordered, and its key then divides the rows by comparison.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.classic.column import Column as ClassicColumn

from panelkit.functions.scalars import col, hash_uniform
from panelkit.operators.joins import group_join, null_safe_join
from panelkit.session import RANGE_ROWS_KEY, conf_int, materialise, names, with_row

# Rows that a range is meant to hold, the most ranges, and sampled keys per range.
RANGE_ROWS = 500_000
MOST_RANGES = 2048
SAMPLES_PER_RANGE = 16
# Size of the quantile sketches, and how far brackets reach to both sides: twice their error at 99 percent.
SKETCH_SIZE = 4000
MARGIN = 0.003
_AT, _RANGE, _PLACE = "__at", "__range", "__place"


def _directed(c: Column) -> tuple[Column, bool, bool]:
    """The value of an order column, whether it falls, and whether nulls come first."""
    node = c._jc.node()
    if node.getClass().getSimpleName() != "SortOrder":
        return c, False, True
    value = ClassicColumn(SparkContext._active_spark_context._jvm.org.apache.spark.sql.Column(node.child()))
    return value, "Descending" in node.sortDirection().toString(), "NullsFirst" in node.nullOrdering().toString()


class _Ranges:
    """Range boundaries of a frame's order keys."""

    def __init__(self, df: DataFrame, order: Sequence[Column]):
        self.order = list(order)
        self.keys = [_directed(c) for c in self.order]
        slim = df.select(*[self._plain(df, v).alias(f"k{i}") for i, (v, _, _) in enumerate(self.keys)])
        self.types = [f.dataType for f in slim.schema]
        self.rows = slim.count()
        wanted = min(MOST_RANGES, -(-self.rows // conf_int(df.sparkSession, RANGE_ROWS_KEY, RANGE_ROWS)))
        self.bounds: list = []
        self._list: Column | None = None
        if wanted > 1:
            # The sample is bounded by MOST_RANGES * SAMPLES_PER_RANGE keys, whatever the number of rows.
            share = wanted * SAMPLES_PER_RANGE / self.rows
            drawn = slim.where(hash_uniform_of(slim) < share)
            by = [_in_direction(F.col(f"k{i}"), down, first) for i, (_, down, first) in enumerate(self.keys)]
            drawn = drawn.orderBy(*by).collect()
            picked = [drawn[len(drawn) * i // wanted] for i in range(1, wanted)] if drawn else []
            self.bounds = [b for a, b in zip([None, *picked], picked) if a != b]

    @staticmethod
    def _plain(df: DataFrame, value: Column) -> Column:
        """Times go through the driver as whole microseconds."""
        kind = df.select(value.alias("v")).schema["v"].dataType
        return F.unix_micros(value) if isinstance(kind, T.TimestampType) else value

    def _before(self, a: Sequence[Column], b: Sequence[Column]) -> Column:
        """Whether the keys a come strictly before the keys b."""
        out = F.lit(False)
        for (_, down, nulls_first), x, y in reversed(list(zip(self.keys, a, b))):
            less = F.coalesce(x > y if down else x < y, F.lit(False))
            null = x.isNull() & y.isNotNull() if nulls_first else x.isNotNull() & y.isNull()
            out = less | null | (x.eqNullSafe(y) & out)
        return out

    def _constants(self, row) -> list[Column]:
        return [F.lit(v).cast(t) for v, t in zip(row, self.types)]

    def _listed(self) -> Column:
        """The boundaries as one constant, written once however often it is used."""
        if self._list is None:
            self._list = F.array(*[F.struct(*[c.alias(f"k{i}") for i, c in enumerate(self._constants(b))]) for b in self.bounds])
        return self._list

    def of(self, df: DataFrame) -> Column:
        """The range of each row: how many boundaries are not behind it."""
        n = len(self.bounds)
        if not n:
            return F.lit(0)
        mine = [self._plain(df, v) for v, _, _ in self.keys]
        bounds = self._listed()
        steps = [1 << i for i in reversed(range(n.bit_length()))]

        def narrow(i: Column, step: Column) -> Column:
            bound = F.get(bounds, i + step - 1)
            reached = (i + step <= n) & ~self._before(mine, [bound[f"k{j}"] for j in range(len(mine))])
            return i + F.when(reached, step).otherwise(F.lit(0))

        return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), narrow)

    def not_behind(self, df: DataFrame, row) -> Column:
        """Whether a row comes before, or is, the row with the given keys."""
        return ~self._before(self._constants(row), [self._plain(df, v) for v, _, _ in self.keys])

    def nth(self, df: DataFrame, n: int):
        """The keys of the n-th row, 1-based; None if there are fewer rows."""
        if n < 1 or n > self.rows:
            return None
        slim = df.select(*[self._plain(df, v).alias(f"k{i}") for i, (v, _, _) in enumerate(self.keys)], self.of(df).alias(_RANGE))
        before, wanted = 0, 0
        if self.bounds:
            for r in sorted(slim.groupBy(_RANGE).count().collect()):  # one row a range
                wanted = r[_RANGE]
                if before + r["count"] >= n:
                    break
                before += r["count"]
        by = [_in_direction(F.col(f"k{i}"), down, first) for i, (_, down, first) in enumerate(self.keys)]
        place = F.row_number().over(W.partitionBy(_RANGE).orderBy(*by))
        found = slim.where(F.col(_RANGE) == wanted).withColumn("__n", place).where(F.col("__n") == n - before).first()
        return found[:len(self.keys)]


def _in_direction(c: Column, down: bool, nulls_first: bool) -> Column:
    if down:
        return c.desc_nulls_first() if nulls_first else c.desc_nulls_last()
    return c.asc_nulls_first() if nulls_first else c.asc_nulls_last()


def hash_uniform_of(df: DataFrame) -> Column:
    """A repeatable number in [0, 1) from all columns of a row."""
    return F.shiftrightunsigned(F.xxhash64(*df.columns), 11) / F.lit(float(1 << 53))


def _placed(df: DataFrame, ranges: _Ranges, by: list[str]) -> DataFrame:
    """Rows with the struct (group, range) that they are dealt by; nulls in it are equal to each other."""
    return df.withColumn(_AT, F.struct(*by, ranges.of(df).alias(_RANGE)))


def _offsets(placed: DataFrame, by: list[str], sums: Mapping[str, Column]) -> DataFrame:
    """Per (group, range): exclusive running totals and totals of the group; at most ranges x groups rows."""
    parts = placed.groupBy(_AT).agg(*[c.alias(s) for s, c in sums.items()])
    group = W.partitionBy(*[F.col(_AT)[c] for c in by], F.lit(0)) if by else W.partitionBy(F.lit(0))
    before = group.orderBy(F.col(_AT)[_RANGE]).rowsBetween(W.unboundedPreceding, -1)
    return parts.select(
        _AT, *[F.sum(s).over(before).alias(f"{s}__before") for s in sums],
        *[F.sum(s).over(group).alias(f"{s}__all") for s in sums])


def assign_ranks(
    df: DataFrame,
    order: Sequence[str | Column],
    by: str | Sequence[str] = (),
    name: str = "rank",
    total: str | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add each row's 1-based position within its group and, if named, the group's row count.

    `order` must end in a unique key so that positions are repeatable. Boundaries and subtotals are
    read from `source` if given: the same rows before other columns were added to them.
    """
    by, order = names(by), [col(c) for c in order]
    source = df if source is None else source
    ranges = _Ranges(source, order)
    placed = _placed(df, ranges, by)
    here = W.partitionBy(_AT)
    # The new columns are named last, as their names may be those of the helper columns.
    out = placed.withColumn(_PLACE, F.row_number().over(here.orderBy(*order)).cast("long"))
    place, size = F.col(_PLACE), F.col("__n__all")
    if not ranges.bounds:  # one range: its positions are those of the group
        if total:
            out = out.withColumn("__n__all", F.count(F.lit(1)).over(here))
    else:
        out = out.join(_offsets(_placed(source, ranges, by), by, {"__n": F.count(F.lit(1))}), _AT)
        place = place + F.coalesce("__n__before", F.lit(0))
    return out.select(*df.columns, place.alias(name), *([size.alias(total)] if total else []))


def tile_of(rank: Column, total: Column, n: int) -> Column:
    """Closed form of SQL ntile(n) from a row's position and its group's size."""
    size, extra = F.floor(total / n), total % n
    wide = extra * (size + 1)
    return F.when(rank <= wide, F.floor((rank - 1) / (size + 1)) + 1).otherwise(
        extra + F.floor((rank - 1 - wide) / F.greatest(size, F.lit(1))) + 1
    )


def assign_tiles(
    df: DataFrame, order: Sequence[str | Column], n: int, by: str | Sequence[str] = (), name: str = "tile",
    source: DataFrame | None = None,
) -> DataFrame:
    """SQL ntile(n) per group; `source` as in `assign_ranks`."""
    ranked = assign_ranks(df, order, by, "__rank", "__total", source)
    tile = tile_of(F.col("__rank"), F.col("__total"), n).cast("int")
    return ranked.withColumn(name, tile).drop("__rank", "__total")


def running_totals(
    df: DataFrame, order: Sequence[str | Column], sums: Mapping[str, str], by: str | Sequence[str] = ()
) -> DataFrame:
    """Inclusive running totals per group: `sums` maps new column name to the column summed."""
    by, order = names(by), [col(c) for c in order]
    ranges = _Ranges(df, order)
    placed = _placed(df, ranges, by)
    local = W.partitionBy(_AT).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    if not ranges.bounds:
        return placed.select(*df.columns, *[F.sum(c).over(local).alias(new) for new, c in sums.items()])
    out = placed.select("*", *[F.sum(c).over(local).alias(f"__l_{new}") for new, c in sums.items()])
    out = out.join(_offsets(placed, by, {f"__{new}": F.sum(c) for new, c in sums.items()}), _AT)
    return out.select(
        # A total is null only while no value has come yet, here or in the ranges before.
        *df.columns, *[F.coalesce(F.col(f"__l_{new}") + F.col(f"__{new}__before"), f"__l_{new}", f"__{new}__before").alias(new)
                       for new in sums]
    )


def exact_quantiles(
    df: DataFrame, columns: str | Sequence[str], probs: Sequence[float], by: str | Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolation quantiles: one row per (group, variable) with a `quantiles` array.

    Two scans serve all columns and groups: one sketches brackets around the wanted positions, the
    other counts the values inside them one by one and those between them in blocks. Both results
    are small and stored, because a sketch may differ when it is made again.
    """
    by, columns = names(by), names(columns)
    slim = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    counts = _bracketed_counts(slim, columns, probs, by)
    found = _values_at(counts, probs, by)
    # Without groups it is a row per column.
    found = materialise(found) if by else slim.sparkSession.createDataFrame(found.collect(), found.schema)
    # A position that fell between the brackets (the sketch's error is bounded only with high probability).
    missed = found.where(F.exists("quantiles", lambda q: q.isNull())).limit(1).count()
    if missed:
        found = _values_at(_all_counts(slim, columns, by), probs, by)
    return found


def _bracketed_counts(slim: DataFrame, columns: list[str], probs: Sequence[float], by: list[str]) -> DataFrame:
    """Rows (group, variable, least value, times, single): single values inside brackets, blocks of values between.

    A group without values has one row of zero times.
    """
    lows, highs = [max(p - MARGIN, 0.0) for p in probs], [min(p + MARGIN, 1.0) for p in probs]
    sketched = slim.groupBy(*by).agg(*[
        F.struct(F.min(c).alias("min"), F.max(c).alias("max"), F.kll_sketch_agg_double(c, F.lit(SKETCH_SIZE)).alias("sketch")).alias(c)
        for c in columns
    ])

    def bracket(c: str) -> Column:
        # The sketch leaves NaN out; one without values cannot be asked.
        known = F.col(c)["min"].isNotNull() & ~F.isnan(F.col(c)["min"])
        wanted = F.array(*[F.lit(float(p)) for p in lows + highs])
        at, n = F.when(known, F.kll_sketch_get_quantile_double(F.col(c)["sketch"], wanted)), len(probs)
        lo = [F.col(c)["min"] if p == 0.0 else at[i] for i, p in enumerate(lows)]
        hi = [F.col(c)["max"] if p == 1.0 else at[n + i] for i, p in enumerate(highs)]
        return F.struct(F.array(*lo).alias("lo"), F.array(*hi).alias("hi"))

    brackets = sketched.select(*by, *[bracket(c).alias(f"__b_{c}") for c in columns])
    if by:
        rows = group_join(slim, materialise(brackets), by)
    else:
        # One row, fixed by making it a local one.
        rows = with_row(slim, slim.sparkSession.createDataFrame([brackets.first()], brackets.schema), "__b").select("*", "__b.*")

    def entry(c: str) -> Column:
        x, b = F.col(c), F.col(f"__b_{c}")
        slots = range(len(probs))
        # Brackets wholly below the value number the block it is in; both ends rise with the slot.
        passed = sum((F.coalesce(x > b["hi"][j], F.lit(False)).cast("int") for j in slots), F.lit(0))
        inside = F.lit(False)
        for j in slots:
            inside = inside | x.between(b["lo"][j], b["hi"][j])
        return F.struct(F.lit(c).alias("variable"), F.when(~inside, passed).alias("block"), x.alias("v"))

    keys = [*by, "variable"]
    entries = rows.select(*by, F.inline(F.array(*[entry(c) for c in columns])))
    single = F.col("block").isNull()
    counted = entries.groupBy(*keys, "block", F.when(single, F.col("v")).alias("__v")).agg(
        F.min("v").alias("v"), F.count("v").alias("times"))
    return materialise(counted.select(*keys, "v", "times", (single & F.col("v").isNotNull()).alias("single")))


def _all_counts(slim: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    long = slim.unpivot(by, columns, "variable", "v")
    return long.groupBy(*by, "variable", "v").agg(F.count("v").alias("times"), F.lit(True).alias("single"))


def _values_at(counts: DataFrame, probs: Sequence[float], by: list[str]) -> DataFrame:
    """The quantiles from counted values; null where a position lies in a block."""
    keys = [*by, "variable"]
    totals = counts.groupBy(*keys).agg(F.sum("times").alias("n"))
    placed = running_totals(counts.where(F.col("times") > 0), [F.col("v").asc()], {"upto": "times"}, keys)
    placed = null_safe_join(placed, totals, keys, "inner")

    def value_at(pos: Column) -> Column:
        here = F.col("single") & (pos >= F.col("upto") - F.col("times")) & (pos < F.col("upto"))
        return F.max(F.when(here, F.col("v")))

    at = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    low, high = [value_at(F.floor(a)) for a in at], [value_at(F.ceil(a)) for a in at]
    part = [F.max(a - F.floor(a)) for a in at]
    found = placed.groupBy(*keys).agg(F.array(*[x + (y - x) * z for x, y, z in zip(low, high, part)]).alias("quantiles"))
    # Groups without a value have a row too, with a null array.
    return null_safe_join(totals.select(*keys), found, keys)


def top_share(df: DataFrame, order: Sequence[str | Column], share: float, by: str | Sequence[str] = ()) -> DataFrame:
    """The first int(rows * share) rows of each group in the given order, which must end in a unique key."""
    if not names(by):
        ranges = _Ranges(df, [col(c) for c in order])
        last = ranges.nth(df, math.floor(ranges.rows * float(share)))
        return df.limit(0) if last is None else df.where(ranges.not_behind(df, last))
    ranked = assign_ranks(df, order, by, "__rank", "__total")
    keep = F.col("__rank") <= F.floor(F.col("__total") * F.lit(float(share)))
    return ranked.where(keep).drop("__rank", "__total")


def flag_first(df: DataFrame, order: Sequence[str | Column], k: int, name: str) -> DataFrame:
    """1 for the first k rows in the given order, which must end in a unique key, and 0 for the others."""
    ranges = _Ranges(df, [col(c) for c in order])
    last = ranges.nth(df, min(k, ranges.rows))
    first = F.lit(0) if last is None else ranges.not_behind(df, last).cast("int")
    return df.withColumn(name, first)


def top_rows(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """The first n rows; each task keeps n candidates, so n is meant to be small."""
    return df.orderBy(*order).limit(n)


def sample_entities(df: DataFrame, entity: str, n: int, seed: int) -> DataFrame:
    """All rows of n entities drawn repeatably: the n lowest keyed hashes."""
    drawn = df.select(entity).distinct().orderBy(hash_uniform([entity], seed), entity).limit(n)
    return df.join(drawn, entity, "left_semi")
