"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions.

Every source gets a share of the token budget in proportion to its weight. A source cannot be repeated more
than `max_epochs` times: its target stops there, and the excess is dealt again by weight among the others
until no target is above its cap. With t(i) = min(cap(i), level * weight(i)) this is a search for one number,
the level, which only rises; each round is one aggregation over the table of sources.

Repetitions: a source with rate r = target / size takes floor(r) whole copies of every document, and one more
copy of some documents so that their words make up the fraction r - floor(r). Which ones: documents are put
into cells (size class, seeded hash bin of id and text); cells are visited from the largest class to the smallest, and a cell
is taken when the error carried so far says so (error diffusion), so that the words taken stay within about
half a cell of the smallest class of the target. Cells of a source are bounded in number (classes x bins), so
no task ever holds the documents of a hot source.

Defined results: null text or text without words has size 0 and takes 0 words; null source is a source of its
own, last in order; repeated rows each count and share their bin, so a row that repeats is taken as often each time
and a source that consists of few distinct rows comes as near its target as these allow; a very long text is one
document of a large size class; ties in weight need no rule; an empty table gives an empty result; other columns, of
any name, are ignored by the report and pass through the mix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blocklens.llm.common import WORD, materialize, ship

WEIGHTS = (5.0, 2.0, 1.0)
BINS = 1024


def source_order(sources: DataFrame) -> DataFrame:
    """(source, ord): place of each source by code point, null last. Distributed sort, no single task."""
    schema = T.StructType([sources.schema["source"], T.StructField("ord", T.LongType())])
    ranked = sources.select("source").orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex()
    return sources.sparkSession.createDataFrame(ranked.map(lambda x: (x[0][0], x[1])), schema)


def targets(per_source: DataFrame, weights=WEIGHTS, budget: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """(source, source_size) -> with target: the capped share of budget x all sizes."""
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("ord", F.lit(n)) + 1).cast("int"))
    ordered = source_order(per_source).select(F.col("source").alias("__s"), "ord")
    table = materialize(
        per_source.join(ordered, F.col("source").eqNullSafe(F.col("__s")))
        .select("source", "source_size", w.alias("weight"), (F.lit(float(max_epochs)) * F.col("source_size")).alias("cap"))
    )
    whole, open_weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    total = budget * (whole or 0)
    level, capped = 0.0, -1
    remaining = total
    while open_weight:
        level = remaining / open_weight
        above = F.lit(level) * F.col("weight") > F.col("cap")
        now, fixed, rest = table.agg(F.count_if(above), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        if now == capped:
            break
        capped, remaining, open_weight = now, total - (fixed or 0.0), rest
    return table.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def _diffuse(cells: pd.DataFrame) -> pd.DataFrame:
    """Cells of one source -> a bitmap of the taken bins per size class."""
    cells = cells.sort_values(["__class", "__bin"], ascending=[False, True])
    share = float(cells["__share"].iloc[0])
    carried, taken = 0.0, {}
    for c, b, words in zip(cells["__class"], cells["__bin"], cells["__words"], strict=True):
        carried += share * words
        bits = taken.setdefault(c, np.zeros(BINS, dtype=np.uint8))
        if carried >= words / 2:
            bits[b] = 1
            carried -= words
    return pd.DataFrame({"__source": [cells["__source"].iloc[0]] * len(taken), "__class": list(taken), "__bits": [np.packbits(x, bitorder="little").tobytes() for x in taken.values()]})


def copies(rows: DataFrame, seed: int = 17, weights=WEIGHTS, budget: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """rows (__size, __site, __key, any other columns not of these names) plus __source_size, __target and __copies.

    __key: a hash of what tells rows apart; it decides the bin.
    """
    spark = rows.sparkSession
    ship(spark)
    size = F.col("__size")
    celled = rows.withColumns({"__class": F.when(size > 0, F.floor(F.log2(size)).cast("int")), "__bin": F.pmod(F.xxhash64(F.lit(seed), "__key"), F.lit(BINS)).cast("int")})
    cells = materialize(celled.groupBy(F.col("__site").alias("source"), "__class", "__bin").agg(F.sum("__size").alias("__words")))
    goal = materialize(targets(cells.groupBy("source").agg(F.sum("__words").alias("source_size")), weights, budget, max_epochs))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.floor(rate).cast("long").alias("__whole"), (rate - F.floor(rate)).alias("__share"))
    picked = (
        cells.where("__class is not null")
        .join(goal.where("__share > 0"), F.col("source").eqNullSafe(F.col("__source")))
        .groupBy("__source")
        .applyInPandas(_diffuse, T.StructType([T.StructField("__source", cells.schema["source"].dataType), T.StructField("__class", T.IntegerType()), T.StructField("__bits", T.BinaryType())]))
    )
    picked = materialize(picked).select(F.col("__source").alias("__psource"), F.col("__class").alias("__pclass"), "__bits")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__bin") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, F.col("__bin") % 8).bitwiseAND(1)
    extra = F.coalesce(bit, F.lit(0)).cast("long")
    out = celled.join(goal, F.col("__site").eqNullSafe(F.col("__source")), "left").join(picked, F.col("__site").eqNullSafe(F.col("__psource")) & (F.col("__class") == F.col("__pclass")), "left")
    return out.withColumn("__copies", F.when(size > 0, F.col("__whole") + extra).otherwise(F.lit(0)).cast("long")).drop("__class", "__bin", "__source", "__whole", "__share", "__psource", "__pclass", "__bits")


def _measured(docs: DataFrame, *carried) -> DataFrame:
    """The carried columns with __size (words of the text, 0 for null), __site and __key."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(*carried, size.alias("__size"), F.col("source").alias("__site"), F.xxhash64("doc_id", "text").alias("__key"))


def mix_report(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs."""
    mixed = copies(_measured(docs, "doc_id"), seed)
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """docs with every row repeated as often as the mix takes it; columns as given, of any names."""
    mixed = copies(_measured(docs, F.struct("*").alias("__row")), seed)
    return mixed.where("__copies > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__copy")).select("__row.*")
