"""Exact top-k inner-product search by no-random-access aggregation (NRA).

The stated queries go in lanes of bounded bytes; for each lane every task works through its own rows, which stay
where they are, block by block. In a block every dimension is a list sorted by component. A query reads the list of
dimension d from its top (from its bottom where the query's component is negative), so that contributions fall along
the list. Contributions are counted from the least the list can give, so what has been read is a lower bound of a
row's score, and that plus the contribution at the reading position of each unread list an upper one. Lists are read
in growing prefixes. The best k lower bounds of the block, the best k scores of the task's earlier blocks and a
bounded seed of rows scored beforehand give the score to beat; a row whose upper bound is below it is out. A query
stops reading when no row but few can qualify, and the scores of those are resolved exactly. The bounds of a batch
of queries are matrix products, as what has been read depends only on the depth and the sign of the query's component.

Winners of each task are merged per query.

Defined results: null ids, null vectors and vectors with null or non-finite components take no part; vectors
meet only vectors of their own length; rows that repeat a vec_id count once (the smallest vector); ties go to
the smaller vec_id; very long vectors only make lanes and blocks smaller in rows; other columns, of any name, are
ignored; an empty table gives an empty result. Scores must fit a long.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blocklens.llm.common import materialize, ship

#: Rows of a block; components of a block and of a lane of queries, at most about.
BLOCK, BLOCK_COMPONENTS, LANE_COMPONENTS = 4096, 1 << 20, 1 << 20
#: Rows that give each query a first score to beat.
SEED_ROWS = 1024
#: Rows of a written part.
PART_ROWS = 8192
#: Queries whose bounds are computed at once.
BATCH = 256
#: Integers up to here add up exactly in double precision over a vector.
EXACT = 2**53
NONE = np.iinfo(np.int64).min


def quantized(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v array<long> of floor(scale * x) for vectors that take part, one row for each id."""
    x = F.col(vec_col)
    fine = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).groupBy(F.col(id_col).cast("long").alias("vec_id")).agg(F.min(v).alias("v"))


class Lists:
    """A block: its rows and, of every dimension, the sorted list and each row's place in it."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows.astype(np.float64)
        order = np.argsort(rows, axis=0, kind="stable")
        self.place = np.empty_like(order)
        np.put_along_axis(self.place, order, np.arange(len(rows))[:, None], axis=0)
        self.sorted = np.take_along_axis(self.rows, order, axis=0)
        # from the least a list can give, read from its top and from its bottom
        self.above = np.concatenate([self.rows - self.sorted[0], self.rows - self.sorted[-1]], axis=1)


def prefixes(n: int, k: int) -> list[int]:
    """Depths at which bounds are compared."""
    return sorted({min(n, max(k, math.ceil(n * x))) for x in (1 / 64, 1 / 16, 1 / 4, 1 / 2, 5 / 8, 3 / 4, 7 / 8, 1)})


def nra(queries: np.ndarray, block: Lists, k: int, floor: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each query the rows that can be among its k best and reach its floor (all ties included), and the depth read."""
    n = len(block.rows)
    lanes, depths = [np.arange(n)] * len(queries), np.zeros(len(queries), np.int64)
    if n <= k:
        return lanes, depths
    open_, before = np.arange(len(queries)), 0
    sides = np.concatenate([np.maximum(queries, 0.0), np.minimum(queries, 0.0)], axis=1)  # read from the top, from the bottom
    least = sides @ np.concatenate([block.sorted[0], block.sorted[-1]])
    lower = np.repeat(least[:, None], n, axis=1)
    for depth in prefixes(n, k):
        read = np.concatenate([block.place >= n - depth, block.place < depth], axis=1)
        new = read & np.concatenate([block.place < n - before, block.place >= before], axis=1)
        lower += sides @ (block.above * new).T
        ahead = sides * np.concatenate([block.sorted[n - depth] - block.sorted[0], block.sorted[depth - 1] - block.sorted[-1]])
        unread = ahead.sum(axis=1)[:, None] - ahead @ read.T.astype(np.float64)
        beat = np.maximum(floor[open_], np.partition(lower, n - k, axis=1)[:, n - k])
        alive = lower + unread >= beat[:, None]
        done = (alive.sum(axis=1) <= max(4 * k, n // 32)) | (depth == n)
        for i in np.flatnonzero(done):
            lanes[open_[i]], depths[open_[i]] = np.flatnonzero(alive[i]), depth
        if done.all():
            break
        open_, sides, lower, before = open_[~done], sides[~done], lower[~done], depth
    return lanes, depths


class Race:
    """The k best rows so far of every query of a lane, of one length of vectors."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.queries, self.k, self.floor = ids, queries, k, floor.copy()
        self.rows = np.full((len(ids), k), NONE)
        self.scores = np.full((len(ids), k), NONE)
        self.largest = int(np.abs(queries).max(initial=0))

    def run(self, ids: np.ndarray, data: np.ndarray) -> None:
        """Let the rows of a block take part."""
        width = data.shape[1]
        small = int(np.abs(data).max(initial=0)) * self.largest * max(1, width) < EXACT // 4
        block = Lists(data) if small and width else None
        for at in range(0, len(self.ids), BATCH):
            asked = self.queries[at : at + BATCH]
            floor = np.where(self.floor[at : at + BATCH] == NONE, -np.inf, self.floor[at : at + BATCH].astype(np.float64))
            lanes = nra(asked.astype(np.float64), block, self.k + 1, floor)[0] if block else [np.arange(len(ids))] * len(asked)
            for i, (query, lane) in enumerate(zip(asked, lanes, strict=True), at):
                lane = lane[ids[lane] != self.ids[i]]
                if not len(lane):
                    continue
                if small:
                    scores = data[lane] @ query
                else:  # components too large for exact doubles: unbounded integers
                    scores = np.array([sum(int(a) * int(b) for a, b in zip(data[j], query, strict=True)) for j in lane], np.int64)
                self.take(i, ids[lane], scores)

    def take(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        there = self.scores[i] != NONE
        ids, scores = np.concatenate([self.rows[i][there], ids]), np.concatenate([self.scores[i][there], scores])
        best = np.lexsort((ids, -scores))[: self.k]
        self.rows[i, : len(best)], self.scores[i, : len(best)] = ids[best], scores[best]
        if len(best) == self.k:
            self.floor[i] = max(self.floor[i], scores[best[-1]])

    def winners(self) -> pa.RecordBatch:
        """query_id, vec_id, score of what can be among the k best of all tasks."""
        i, j = np.nonzero((self.scores != NONE) & (self.scores >= self.floor[:, None]))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[i]), pa.array(self.rows[i, j]), pa.array(self.scores[i, j])], ["query_id", "vec_id", "score"])


def _stack(vectors: list, width: int) -> np.ndarray:
    return np.array(vectors, np.int64).reshape(len(vectors), width)


def _search(batches, shared, k: int, block: int):
    """Rows (vec_id, v) of a task -> the winners of each query of the lane."""
    races = {width: Race(*asked, k) for width, asked in shared.value.items()}
    waiting: dict[int, tuple[list, list]] = {}

    def run(width):
        ids, vectors = waiting.pop(width)
        races[width].run(np.array(ids, np.int64), _stack(vectors, width))

    for batch in batches:
        for vec_id, v in zip(batch.column("vec_id").to_pylist(), batch.column("v"), strict=True):
            width = len(v)
            if width in races:
                ids, vectors = waiting.setdefault(width, ([], []))
                ids.append(vec_id)
                vectors.append(v.values.to_numpy())
                if len(ids) >= min(block, max(64, BLOCK_COMPONENTS // max(1, width))):
                    run(width)
    for width in list(waiting):
        run(width)
    for race in races.values():
        yield race.winners()


def _lane(asked: DataFrame, seeds: list, k: int) -> dict:
    """width -> (ids, queries, scores to beat) of the queries of a lane."""
    by_width: dict[int, tuple[list, list]] = {}
    for r in asked.select("vec_id", "v").toArrow().to_pylist():  # bounded by LANE_COMPONENTS
        ids, vectors = by_width.setdefault(len(r["v"]), ([], []))
        ids.append(r["vec_id"])
        vectors.append(r["v"])
    out = {}
    for width, (ids, vectors) in by_width.items():
        race = Race(np.array(ids, np.int64), _stack(vectors, width), np.full(len(ids), NONE), k)
        known = [r for r in seeds if len(r["v"]) == width]
        if known:
            race.run(np.array([r["vec_id"] for r in known], np.int64), _stack([r["v"] for r in known], width))
        out[width] = (race.ids, race.queries, race.floor)
    return out


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of every query row (vec_id divisible by `every`)."""
    spark = vectors.sparkSession
    ship(spark)
    rows = quantized(vectors, scale).withColumn("dim", F.size("v"))
    n = vectors.count()
    rows = materialize(rows.repartition(max(1, math.ceil(n / PART_ROWS))))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    components = asked.agg(F.sum(F.greatest("dim", F.lit(1)))).first()[0] or 0
    lanes = math.ceil(components / LANE_COMPONENTS)
    seeds = rows.limit(SEED_ROWS).select("vec_id", "v").toArrow().to_pylist()  # scores to beat only: all rows are read below
    schema = "query_id long, vec_id long, score long"
    found = spark.createDataFrame([], schema)
    for lane in range(lanes):
        own = asked if lanes == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(lanes)) == lane)
        shared = spark.sparkContext.broadcast(_lane(own, seeds, k))
        best = rows.select("vec_id", "v").mapInArrow(partial(_search, shared=shared, k=k, block=BLOCK), schema)
        if lanes > 1:
            best = materialize(best)
            shared.destroy()
        found = found.unionByName(best)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
