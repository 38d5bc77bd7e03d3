"""Exact k-nearest-neighbour classification with pivots and triangle-inequality bounds.

A bounded sample of training rows serves as pivots; every training row belongs to the cell of its
nearest pivot, and a cell is known by its number of rows and its least and largest distance to the
pivot. Cells lie in blocks of bounded size: near ones share a block, and a hot one is cut into
hashed blocks. A query first searches its own cell (one block of it), which bounds its k-th distance,
and then only the blocks with a cell whose lower bound does not exceed that: by the triangle
inequality over the pivot's distances, and by half the gap to its own pivot. Ties at the bound are
searched too, so the result is that of comparing all pairs.

The queries that visit a block are cut into hashed parts, and every (block, part) is one group, so a
row is sent once per part or block and not once per cell. A group measures roughly first (a matrix
product, or sums of minima over small integers) and exactly where the rough value is within reach; it
keeps k candidates per query, and no pair table is ever produced. Distances to pivots depend on the
row alone, so lost tasks are made again as they were.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from panelkit.plans.splits import hash_folds
from panelkit.session import materialise

# Most training rows of a block and most queries of a group. Where all pairs are fewer, blocks are smaller, so that
# there are about _GROUPS groups, but not below _LEAST_ROWS.
BLOCK_ROWS = 32_768
_GROUPS = 64
_LEAST_ROWS = 2048
# How many parts of its size the queries of a group are where a size is given.
_QUERY_PART = 8
# Most pivots; they and the cell statistics are all that goes through the driver.
MOST_PIVOTS = 512
# Training rows a cell is meant to hold while there are fewer than MOST_PIVOTS cells.
_CELL_ROWS = 500
_CELLS = 4_000_000
# Training rows and pairs that are measured roughly at a time, and pairs that are measured exactly.
_SEGMENT, _TILE, _EXACT = 2048, 131_072, 50_000
# Values of differences from pivots at a time, few enough to stay in a processor's cache.
_PIVOT_CELLS = 131_072
# Relative room for rounding in bounds and in distances taken from products.
_SLACK = 1e-9


def _distances(query: np.ndarray, base: np.ndarray, metric: str, p: float) -> np.ndarray:
    """Distances of matching rows (broadcast over the leading axes)."""
    gap = np.abs(query - base)
    if metric == "manhattan":
        return gap.sum(axis=-1)
    if metric == "minkowski" and p != 2:
        return (gap**p).sum(axis=-1) ** (1.0 / p)
    return np.sqrt((gap * gap).sum(axis=-1))


def _all_distances(query: np.ndarray, base: np.ndarray, metric: str, p: float) -> np.ndarray:
    return _distances(query[:, None, :], base[None, :, :], metric, p)


def _chunks(n: int, width: int, most: int = _CELLS) -> Iterator[slice]:
    step = max(1, most // max(1, width))
    for at in range(0, n, step):
        yield slice(at, min(n, at + step))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _points(rows: pa.Table) -> np.ndarray:
    """The features of some rows as a matrix."""
    lists = rows.column("features").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("features of one length are wanted")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(sizes), -1)


class _Product:
    """Squared Euclidean distances from a matrix product, with room for its rounding."""

    def __init__(self, points: np.ndarray, base: np.ndarray):
        self.own, self.theirs = (points * points).sum(axis=1), (base * base).sum(axis=1)
        self.left = np.column_stack((points, np.ones(len(points)), self.own))
        self.right = np.column_stack((-2.0 * base, self.theirs, np.ones(len(base))))

    def within(self, q: np.ndarray, b: slice, bound: np.ndarray) -> np.ndarray:
        limit = bound * bound + _SLACK * (self.own[q] + self.theirs[b].max())
        return self.left[q] @ self.right[b].T <= limit[:, None]


class _Minima:
    """Lower bounds of Manhattan distances from values on a scale of small integers.

    |a - b| is a + b - 2 min(a, b), so a pair needs the sum of minima only. Rounding to the scale
    changes a difference by at most one step, and values beyond its ends only come closer.
    """

    def __init__(self, points: np.ndarray, base: np.ndarray):
        self.width = base.shape[1]
        levels = min(32_767, 65_534 // max(1, self.width))
        some = base[:: max(1, len(base) // 2000)]
        low, high = np.quantile(some, 0.001, axis=0), np.quantile(some, 0.999, axis=0)
        self.step = max(float((high - low).max(initial=0.0)) / levels, 1e-300)

        def scaled(x: np.ndarray) -> np.ndarray:
            # Each column in one piece, as `within` runs along it.
            return np.ascontiguousarray(np.clip(np.rint((x - low) / self.step), 0, levels).astype(np.int16).T)

        self.left, self.right = scaled(points), scaled(base)
        self.own = self.left.sum(axis=0, dtype=np.int64)
        self.start = (-((self.right.sum(axis=0, dtype=np.int64) + 1) // 2)).astype(np.int16)

    def within(self, q: np.ndarray, b: slice, bound: np.ndarray) -> np.ndarray:
        least = (self.own[q] - self.width - bound * (1 + _SLACK) / self.step) / 2 - 1
        limit = np.clip(np.floor(least), -32_768, 32_767).astype(np.int16)
        # The sums stay within 16 bits: they start at minus half of the training row's sum.
        sums = np.repeat(self.start[None, b], len(q), axis=0)
        least_of = np.empty_like(sums)
        for mine, theirs in zip(self.left[:, q], self.right[:, b]):
            np.minimum(mine[:, None], theirs, out=least_of)
            np.add(sums, least_of, out=sums)
        return sums >= limit[:, None]


class _Search:
    """The k nearest of some training rows (in id order by `place`) for some queries, cell by cell."""

    def __init__(self, points, base, place, k, metric, p, folds=None, bound=None):
        self.points, self.base, self.place, self.k, self.metric, self.p, self.folds = points, base, place, k, metric, p, folds
        n = len(points)
        self.d, self.at = np.full((n, k), np.inf), np.full((n, k), -1, np.int64)
        self.bound = np.full(n, np.inf) if bound is None else bound.copy()
        self.waiting: list = []
        self.rough = None
        if metric == "euclidean" or (metric == "minkowski" and p == 2):
            self.rough = _Product(points, base)
        elif metric == "manhattan" and base.shape[1] <= 2048:
            self.rough = _Minima(points, base)

    def _merge(self) -> None:
        """Put the waiting candidates among the k best; equal distances go to the lower place."""
        if not self.waiting:
            return
        q, b, d = map(np.concatenate, zip(*self.waiting))
        self.waiting = []
        touched = np.unique(q)
        held = self.at[touched] >= 0
        q = np.concatenate((np.repeat(touched, held.sum(axis=1)), q))
        b, d = np.concatenate((self.at[touched][held], b)), np.concatenate((self.d[touched][held], d))
        order = np.lexsort((self.place[b], d, q))
        q, b, d = q[order], b[order], d[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = rank < self.k
        self.d[touched], self.at[touched] = np.inf, -1
        self.d[q[kept], rank[kept]], self.at[q[kept], rank[kept]] = d[kept], b[kept]
        self.bound[touched] = np.minimum(self.bound[touched], self.d[touched, -1])

    def _offer(self, q: np.ndarray, b: np.ndarray) -> None:
        """Measure candidate pairs exactly and keep those within the bound."""
        if self.folds is not None:
            other = self.folds[0][q] != self.folds[1][b]
            q, b = q[other], b[other]
        for part in _chunks(len(q), 1, _EXACT):
            d = _distances(self.points[q[part]], self.base[b[part]], self.metric, self.p)
            kept = np.isfinite(d) & (d <= self.bound[q[part]])
            self.waiting.append((q[part][kept], b[part][kept], d[kept]))
        if sum(len(x[0]) for x in self.waiting) > max(_EXACT, max(4, self.k) * len(self.points)):
            self._merge()

    def _exact(self, q: np.ndarray, b: slice) -> None:
        """Measure all pairs; used while a query has no bound yet."""
        for part in _chunks(len(q), (b.stop - b.start) * self.base.shape[1]):
            d = _all_distances(self.points[q[part]], self.base[b], self.metric, self.p)
            if self.folds is not None:
                d[self.folds[0][q[part], None] == self.folds[1][None, b]] = np.inf
            within = np.isfinite(d) & (d <= self.bound[q[part], None])
            if self.k < d.shape[1]:
                within &= d <= np.partition(d, self.k - 1, axis=1)[:, self.k - 1:self.k]
            i, j = np.nonzero(within)
            self.waiting.append((q[part][i], j + b.start, d[i, j]))
        self._merge()

    def cell(self, rows: slice, q: np.ndarray) -> None:
        """Search the given training rows for the given queries."""
        start = rows.start
        while start < rows.stop and len(q):
            known = np.isfinite(self.bound[q]) if self.rough is not None else np.zeros(len(q), bool)
            # A few rows are enough for a first bound.
            width = _SEGMENT if known.all() or self.rough is None else max(256, 2 * self.k)
            b = slice(start, min(rows.stop, start + width))
            start = b.stop
            if not known.all():
                self._exact(q[~known], b)
            for part in _chunks(int(known.sum()), b.stop - b.start, _TILE):
                some = q[known][part]
                i, j = np.divmod(np.flatnonzero(self.rough.within(some, b, self.bound[some])), b.stop - b.start)
                self._offer(some[i], j + b.start)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, training row, distance) in order."""
        self._merge()
        q, j = np.nonzero(self.at >= 0)
        return q, self.at[q, j], self.d[q, j]


class _Cells:
    """Pivots with what is known of their cells; small enough to travel with every task."""

    def __init__(self, pivots: np.ndarray, metric: str, p: float, block_rows: int | None):
        self.pivots, self.metric, self.p, self.block_rows = pivots, metric, p, block_rows
        n = len(pivots)
        self.rows, self.low, self.high, self.queries = np.zeros(n, int), np.zeros(n), np.zeros(n), np.zeros(n, int)

    @property
    def is_metric(self) -> bool:
        return self.metric != "minkowski" or self.p >= 1

    def own(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot of each row and the distance to it."""
        cell, distance = np.zeros(len(points), np.int32), np.zeros(len(points))
        for part in _chunks(len(points), self.pivots.size, _PIVOT_CELLS):
            d = _all_distances(points[part], self.pivots, self.metric, self.p)
            cell[part] = d.argmin(axis=1)
            distance[part] = d[np.arange(len(d)), cell[part]]
        return cell, distance

    def learn(self, stats) -> None:
        for r in stats:
            if r["side"]:
                self.queries[r["cell"]] = r["n"]
            else:
                self.rows[r["cell"]], self.low[r["cell"]], self.high[r["cell"]] = r["n"], r["low"], r["high"]
        if self.block_rows is None:
            even = math.isqrt(int(self.rows.sum()) * int(self.queries.sum()) // _GROUPS)
            self.block_rows = self.query_rows = min(BLOCK_ROWS, max(_LEAST_ROWS, even))
        else:
            self.query_rows = max(1, self.block_rows // _QUERY_PART)
        self._lay_out()

    def _lay_out(self) -> None:
        """Blocks of cells along a chain from pivot to nearest pivot; larger cells have blocks of their own."""
        n = len(self.pivots)
        self.first, self.parts = np.zeros(n, int), np.maximum(1, -(-self.rows // self.block_rows))
        left, at, block, held = np.ones(n, bool), 0, 0, 0
        for _ in range(n):
            left[at] = False
            if held and (held + self.rows[at] > self.block_rows):
                block, held = block + 1, 0
            self.first[at] = block
            held += self.rows[at]
            if self.parts[at] > 1:
                block, held = block + self.parts[at], 0
            if left.any():
                others = np.flatnonzero(left)
                at = others[_distances(self.pivots[at], self.pivots[others], self.metric, self.p).argmin()]
        self.blocks = block + 1 if held or not block else block

    def lies_in(self) -> np.ndarray:
        """Whether a block has rows of a cell: [cell, block]."""
        at = np.arange(self.blocks)[None, :]
        inside = (at >= self.first[:, None]) & (at < (self.first + self.parts)[:, None])
        return (inside & (self.rows > 0)[:, None]).astype(np.float32)

    def query_parts(self, visits: np.ndarray) -> list[int]:
        return np.maximum(1, -(-visits // self.query_rows)).tolist()

    def least(self, d: np.ndarray, away: np.ndarray, cells) -> np.ndarray:
        """Lower bounds of the distances to the rows of some cells, from those to their pivots and the own one."""
        bound = np.maximum(np.maximum(d - self.high[cells], self.low[cells] - d), (d - away[:, None]) / 2)
        return bound - _SLACK * (d + self.high[cells])

    def to_visit(self, points: np.ndarray, kth: np.ndarray, k: int, by_fold: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Which cells can hold a row at most as far as the k-th distance found so far (inf if fewer were found), and that bound."""
        held = self.rows > 0
        for part in _chunks(len(points), self.pivots.size):
            d = np.concatenate([_all_distances(points[part][s], self.pivots, self.metric, self.p)
                                for s in _chunks(part.stop - part.start, self.pivots.size, _PIVOT_CELLS)])
            bound = kth[part]
            if self.is_metric and not by_fold:
                # Enough whole cells within reach bound the k-th distance too.
                reach = np.where(held, d + self.high, np.inf)
                order = reach.argsort(axis=1, kind="stable")
                enough = (np.cumsum(self.rows[order], axis=1) < k).sum(axis=1)
                ends = np.take_along_axis(reach, order, axis=1)
                last = np.minimum(enough, len(self.rows) - 1)
                bound = np.minimum(bound, np.where(enough < len(self.rows), ends[np.arange(len(d)), last], np.inf))
            bound = bound * (1 + _SLACK)
            wanted = held[None, :] & (self.least(d, d.min(axis=1), slice(None)) <= bound[:, None]) if self.is_metric \
                else np.broadcast_to(held, d.shape)
            yield wanted, bound


def _celled(df: DataFrame, cells: _Cells) -> DataFrame:
    """Add each row's cell; rows without a finite distance to it have no neighbours and are nobody's."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                batch["cell"], batch["away"] = cells.own(_matrix(batch["features"]))
                yield batch[np.isfinite(batch["away"])]

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.where(F.col("features").isNotNull()).mapInPandas(run, f"{fields}, cell int, away double")


def _pick(values: Sequence[int], at: str) -> Column:
    return F.get(F.array(*[F.lit(int(v)) for v in values]), F.col(at))


def _hashed(n: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")


def _every(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def _in_block(cells: _Cells, seed: int) -> Column:
    """The block of a row by its cell and, in a cell of several blocks, its hash."""
    return (_pick(cells.first, "cell") + _hashed(_pick(cells.parts, "cell"), seed)).cast("int")


def _shaped(df: DataFrame, id_col: str, features: str, label: str, fold: str | None) -> DataFrame:
    # Single precision is kept as it is until the rows are measured.
    single = isinstance(getattr(df.schema[features].dataType, "elementType", None), T.FloatType)
    return df.select(
        F.col(id_col).alias("id"), F.col(features).cast(f"array<{'float' if single else 'double'}>").alias("features"),
        F.col(label).cast("int").alias("label"), (F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"),
    )


def _dealt(df: DataFrame, groups: int, *keys: str) -> DataFrame:
    """Rows dealt by key to a fixed number of tasks, as small inputs may be much work."""
    return df.repartition(max(1, min(2048, 2 * groups)), *keys)


def _cells_of(train: DataFrame, test: DataFrame, metric: str, p: float, block_rows: int | None):
    """Pivots by lowest hash of the id with the statistics of their cells, and both sides with their cells, stored.

    None without a training row.
    """
    n = train.count()
    most = min(MOST_PIVOTS, max(1, n // min(_CELL_ROWS, block_rows or _CELL_ROWS)))
    # At most MOST_PIVOTS rows reach the driver; each task keeps as many.
    drawn = train.where(F.col("features").isNotNull()).orderBy(F.xxhash64("id"), "id").limit(most).select("features").collect()
    pivots = np.array([r["features"] for r in drawn], float)
    pivots = np.unique(pivots[np.isfinite(pivots).all(axis=1)], axis=0) if len(pivots) else pivots
    if not len(pivots):
        return None
    cells = _Cells(pivots, metric, p, block_rows)
    sides = [materialise(_celled(df, cells)) for df in (train, test)]
    both = sides[0].select(F.lit(0).alias("side"), "cell", "away").unionByName(sides[1].select(F.lit(1).alias("side"), "cell", "away"))
    cells.learn(both.groupBy("side", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect())
    return cells, *sides


def _own_cell_search(train: DataFrame, test: DataFrame, k: int, cells: _Cells, by_fold: bool, kinds: list[str]) -> DataFrame:
    """One row per query: candidates from a block of its own cell, the blocks still to be visited, and rows compared in all."""
    parts = cells.query_parts(-(-cells.queries // cells.parts))
    groups = int((np.array(parts) * cells.parts)[cells.queries > 0].sum())
    left = train.select("*", _in_block(cells, 1).alias("block"), _every(_pick(parts, "cell")).alias("qb"))
    right = test.select("*", _in_block(cells, 2).alias("block"), _hashed(_pick(parts, "cell"), 3).alias("qb"))
    single = isinstance(train.schema["features"].dataType.elementType, T.FloatType)
    schema = (f"id {kinds[0]}, features array<{'float' if single else 'double'}>, label int, fold int, own int, block int, away double, "
              f"kth double, near array<struct<id:{kinds[1]},label:int,distance:double>>, visits array<int>, compared long")

    def search(train: pa.Table, test: pa.Table) -> pa.Table:
        points = _points(test) if len(test) else np.zeros((0, 0))
        q, b, d = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        kth = np.full(len(test), np.inf)
        if len(train) and len(test):
            train = train.sort_by("id")
            folds = (test.column("fold").to_numpy(), train.column("fold").to_numpy()) if by_fold else None
            one = _Search(points, _points(train), np.arange(len(train)), k, cells.metric, cells.p, folds)
            one.cell(slice(0, len(train)), np.arange(len(test)))
            q, b, d = one.found()
            kth = one.d[:, -1]
        ends = np.searchsorted(q, np.arange(len(test) + 1)).astype(np.int32)
        near = pa.StructArray.from_arrays(
            [train.column("id").take(pa.array(b)).combine_chunks(), train.column("label").take(pa.array(b)).combine_chunks(), pa.array(d)],
            names=["id", "label", "distance"])
        own, block = test.column("cell").to_numpy(), test.column("block").to_numpy()
        lies_in = cells.lies_in()
        visits, sizes, bounds, compared, at = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)], [np.zeros(0, int)], 0
        for wanted, bound in cells.to_visit(points, kth, k, by_fold) if len(test) else ():
            n = np.arange(len(wanted))
            mine, here = own[at + n], block[at + n]
            at += len(n)
            wanted = wanted.copy()
            wanted[n, mine] = True
            compared.append(wanted @ cells.rows)
            # The own cell is done, or the block of it that the query was searched in.
            whole = cells.parts[mine] == 1
            wanted[n[whole], mine[whole]] = False
            to = wanted.astype(np.float32) @ lies_in > 0
            to[n[~whole], here[~whole]] = False
            visits.append(np.nonzero(to)[1])
            sizes.append(to.sum(axis=1))
            bounds.append(bound)
        visited = pa.ListArray.from_arrays(
            pa.array(np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)), pa.array(np.concatenate(visits).astype(np.int32)))
        return pa.table({
            "id": test.column("id"), "features": test.column("features"), "label": test.column("label"), "fold": test.column("fold"),
            "own": test.column("cell"), "block": test.column("block"), "away": test.column("away"),
            "kth": pa.array(np.concatenate(bounds)), "near": pa.ListArray.from_arrays(pa.array(ends), near),
            "visits": visited, "compared": pa.array(np.concatenate(compared).astype(np.int64))})

    keys = ["cell", "block", "qb"]
    left, right = (_dealt(df, groups, *keys) for df in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, schema)


def _other_cells_search(train: DataFrame, home: DataFrame, k: int, cells: _Cells, by_fold: bool, kinds: list[str]) -> DataFrame:
    """Candidates from all other cells within reach, block by block."""
    visits = np.zeros(cells.blocks, int)
    for r in home.select(F.explode("visits").alias("to")).groupBy("to").count().collect():  # at most one row a block
        visits[r["to"]] = r["count"]
    parts = cells.query_parts(visits)
    left = train.withColumn("to", _in_block(cells, 1)).select("*", _every(_pick(parts, "to")).alias("qb"))
    right = home.select("id", "features", "label", "fold", "own", "block", "away", "kth", F.explode("visits").alias("to"))
    right = right.select("*", _hashed(_pick(parts, "to"), 3).alias("qb"))
    schema = f"query_id {kinds[0]}, query_label int, id {kinds[1]}, label int, distance double"

    def search(train: pa.Table, test: pa.Table) -> pa.Table:
        if len(train) and len(test):
            train = train.sort_by("id")
            cell = train.column("cell").to_numpy()
            order = np.argsort(cell, kind="stable")
            starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
            folds = (test.column("fold").to_numpy(), train.column("fold").to_numpy()[order]) if by_fold else None
            points, to, away = _points(test), int(test.column("to")[0].as_py()), test.column("away").to_numpy()
            own, block = test.column("own").to_numpy(), test.column("block").to_numpy()
            one = _Search(points, _points(train)[order], order, k, cells.metric, cells.p, folds, test.column("kth").to_numpy())
            for start, stop in zip(starts, [*starts[1:], len(order)]):
                c = int(cell[order[start]])
                wanted = (own != c) | (block != to)
                if cells.is_metric:
                    d = np.concatenate([_distances(points[s], cells.pivots[c], cells.metric, cells.p) for s in _chunks(len(points), points.shape[1])])
                    wanted &= cells.least(d[:, None], away, [c])[:, 0] <= one.bound * (1 + _SLACK)
                one.cell(slice(int(start), int(stop)), np.flatnonzero(wanted))
            q, b, d = one.found()
            b = order[b]
        else:
            q, b, d = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        q, b = pa.array(q), pa.array(b)
        return pa.table({"query_id": test.column("id").take(q), "query_label": test.column("label").take(q),
                         "id": train.column("id").take(b), "label": train.column("label").take(b), "distance": pa.array(d)})

    groups = int(sum(n for n, v in zip(parts, visits) if v))
    left, right = (_dealt(df, groups, "to", "qb") for df in (left, right))
    return left.groupBy("to", "qb").cogroup(right.groupBy("to", "qb")).applyInArrow(search, schema)


def nearest(
    train: DataFrame, test: DataFrame, k: int, id_col: str, features: str, label: str,
    metric: str = "euclidean", p: float = 2.0, fold: str | None = None, block_rows: int | None = None,
) -> DataFrame:
    """The k nearest training rows of every test row, ties broken by training id.

    With `fold`, a training row of the query's own fold is not a candidate. Rows without features
    have no neighbours and are nobody's.
    """
    kinds = [df.schema[id_col].dataType.simpleString() for df in (test, train)]
    train, test = (_shaped(df, id_col, features, label, fold) for df in (train, test))
    found = _cells_of(train, test, metric, p, block_rows)
    schema = f"query_id {kinds[0]}, query_label int, id {kinds[1]}, label int, distance double, rank int"
    if found is None:
        return train.sparkSession.createDataFrame([], schema)
    cells, train, test = found
    # Stored, because the second search and the result both read it.
    home = materialise(_own_cell_search(train, test, k, cells, fold is not None, kinds))
    found = home.select(F.col("id").alias("query_id"), F.col("label").alias("query_label"), F.inline("near"))
    found = found.unionByName(_other_cells_search(train, home, k, cells, fold is not None, kinds))
    order = W.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def visited_share(
    train: DataFrame, test: DataFrame, k: int, id_col: str, features: str, metric: str = "euclidean", p: float = 2.0,
    block_rows: int | None = None,
) -> DataFrame:
    """One row: pairs of test and training rows in the cells that `nearest` visits, all pairs, and the share."""
    kinds = [df.schema[id_col].dataType.simpleString() for df in (test, train)]
    train, test = (_shaped(df.withColumn("__y", F.lit(0)), id_col, features, "__y", None) for df in (train, test))
    cells, train, test = _cells_of(train, test, metric, p, block_rows)
    home = _own_cell_search(train, test, k, cells, False, kinds)
    pairs = home.agg(F.sum("compared").alias("compared"), (F.count(F.lit(1)) * int(cells.rows.sum())).alias("all_pairs"))
    return pairs.withColumn("share", F.col("compared") / F.col("all_pairs"))


def vote(near: DataFrame, settings: Sequence[tuple[int, str]]) -> DataFrame:
    """Class and class-1 share per query for every (k, weighting), from one neighbour search.

    Inverse-distance weights give all the weight to exact matches when there are any. Equal votes
    go to the lowest class.
    """
    configs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("weights")) for k, w in settings])
    used = near.select("*", F.inline(configs)).where(F.col("rank") <= F.col("k"))
    keys = ["k", "weights", "query_id", "query_label"]
    touching = F.max((F.col("distance") == 0).cast("int")).over(W.partitionBy(*keys)) == 1
    inverse = F.when(touching, (F.col("distance") == 0).cast("double")).otherwise(
        F.try_divide(F.lit(1.0), F.col("distance"))
    )
    used = used.withColumn("__w", F.when(F.col("weights") == "distance", inverse).otherwise(F.lit(1.0)))
    votes = used.groupBy(*keys, "label").agg(F.sum("__w").alias("__w"))
    best = F.max_by("label", F.struct(F.round("__w", 12), -F.col("label")))
    ones = F.sum(F.when(F.col("label") == 1, F.col("__w")).otherwise(F.lit(0.0)))
    return votes.groupBy(*keys).agg(best.alias("predicted"), (ones / F.sum("__w")).alias("score"))


def evaluation_grid(near: DataFrame, ks: Sequence[int], weights: Sequence[str]) -> DataFrame:
    """Accuracy for every (k, weighting), all from one neighbour search with the largest k."""
    hit = (F.col("predicted") == F.col("query_label")).cast("double")
    voted = vote(near, [(k, w) for k in ks for w in weights])
    return voted.groupBy("k", "weights").agg(F.avg(hit).alias("accuracy"))


def grid_counts(
    train: DataFrame, test: DataFrame, ks: Sequence[int], metrics: Sequence[str], weights: Sequence[str], id_col: str,
    features: str, label: str, p: float = 2.0,
) -> DataFrame:
    """Rows by actual and predicted class for every (side, metric, k, weighting): training and test side.

    One neighbour search with the largest k serves a metric and side. On the training side a row is
    its own nearest neighbour, as it is for a classifier that scores its training rows.
    """
    out = None
    for metric in metrics:
        for side, rows in (("train", train), ("test", test)):
            near = nearest(train, rows, max(ks), id_col, features, label, metric, p)
            voted = vote(near, [(k, w) for k in ks for w in weights])
            counts = voted.groupBy("k", "weights", F.col("query_label").alias("actual"), "predicted").agg(F.count(F.lit(1)).alias("n"))
            counts = counts.select(F.lit(side).alias("side"), F.lit(metric).alias("metric"), "*")
            out = counts if out is None else out.unionByName(counts)
    return out


def grid_accuracy(counts: DataFrame) -> DataFrame:
    """Training and test accuracy of every (metric, k, weighting) from the counts of `grid_counts`."""
    hit = F.col("actual") == F.col("predicted")

    def share(side: str) -> Column:
        here = F.col("side") == side
        return F.sum(F.when(here & hit, F.col("n")).otherwise(F.lit(0))) / F.sum(F.when(here, F.col("n")))

    return counts.groupBy("metric", "k", "weights").agg(share("train").alias("training_acc"), share("test").alias("test_acc"))


def cross_validated_accuracy(
    df: DataFrame, ks: Sequence[int], folds: int, id_col: str, features: str, label: str, seed: int = 0,
    metric: str = "euclidean",
) -> DataFrame:
    """Mean over folds of the accuracy for each k; one search in which own-fold rows are no candidates."""
    folded = hash_folds(df, [id_col], seed, folds)
    near = nearest(folded, folded, max(ks), id_col, features, label, metric, fold="fold")
    voted = hash_folds(vote(near, [(k, "uniform") for k in ks]), ["query_id"], seed, folds)
    hit = (F.col("predicted") == F.col("query_label")).cast("double")
    return voted.groupBy("k", "fold").agg(F.avg(hit).alias("a")).groupBy("k").agg(F.avg("a").alias("accuracy"))
