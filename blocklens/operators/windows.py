"""Windows over a whole ordered table without a single task: running totals, neighbours, islands.

The table is cut into cells of a fixed width of the order key; inside a cell ordinary windows run in parallel, and one
row for each cell (its total, its edges) carries the result across. Cells are themselves put into cells of cells, so the
last step, which is one task, sees a row for each CELL x CELL keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of a cell of the order key, and of a cell of cells in cells.
CELL = 4096


def _cells(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("__cell", F.floor(F.col(key) / CELL).cast("long"))


def _carried(totals: DataFrame) -> DataFrame:
    """__cell, __carry: the sum of __sum of all cells before, in two levels."""
    wide = totals.withColumn("__wide", F.floor(F.col("__cell") / CELL).cast("long"))
    before = lambda w: F.coalesce(F.sum("__sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    far = wide.groupBy("__wide").agg(F.sum("__sum").alias("__sum")).select("__wide", before(Window.orderBy("__wide")).alias("__far"))
    near = wide.withColumn("__near", before(Window.partitionBy("__wide").orderBy("__cell")))
    return near.join(far, "__wide").select("__cell", (F.col("__near") + F.col("__far")).alias("__carry"))


def running_total(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """df with `name`: the sum of value over the rows before, in the order of key (unique)."""
    celled = _cells(df, key)
    within = Window.partitionBy("__cell").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    carried = _carried(celled.groupBy("__cell").agg(F.sum(value).alias("__sum")))
    total = F.coalesce(F.sum(value).over(within), F.lit(0)) + F.col("__carry")
    return celled.join(carried, "__cell").withColumn(name, total).drop("__cell", "__carry")


def previous(df: DataFrame, key: str, columns: dict[str, str], steps: int = 1) -> DataFrame:
    """df with the named columns of the row whose key is `steps` smaller (null if there is none): a shifted self-join."""
    shifted = df.select((F.col(key) + steps).alias(key), *[F.col(c).alias(n) for n, c in columns.items()])
    return df.join(shifted, key, "left")


def islands(df: DataFrame, key: str) -> DataFrame:
    """first, last, n of every run of consecutive keys (unique whole numbers)."""
    celled = _cells(df.select(key), key)
    rank = F.row_number().over(Window.partitionBy("__cell").orderBy(key))
    parts = celled.withColumn("__g", F.col(key) - rank).groupBy("__cell", "__g").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    parts, done = parts.select("first", "last"), None
    # runs that touch an edge of their cell go on in the next one; only such runs meet in the next step
    for width in (CELL, CELL * CELL):
        edge = (F.col("first") % width == 0) | (F.col("last") % width == width - 1)
        whole = parts.where(~edge)
        done = whole if done is None else done.unionByName(whole)
        wider = F.floor(F.col("first") / (width * CELL)) if width == CELL else F.lit(0)
        parts = _touching(parts.where(edge).withColumn("__wide", wider))
    return done.unionByName(parts).withColumn("n", F.col("last") - F.col("first") + 1)


def _touching(parts: DataFrame) -> DataFrame:
    """first, last of the runs put together where one begins after the other's end, inside each __wide."""
    order = Window.partitionBy("__wide").orderBy("first")
    new = F.when(F.lag("last").over(order) == F.col("first") - 1, 0).otherwise(1)
    runs = parts.withColumn("__new", new).withColumn("__run", F.sum("__new").over(order))
    return runs.groupBy("__wide", "__run").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("first", "last")
