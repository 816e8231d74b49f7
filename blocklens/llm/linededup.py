"""Line dedup: removal of lines that stand on many sites.

The spread of a line is the number of distinct sites (sources) it stands on. A HyperLogLog sketch of the sites
is kept for each line hash and merged by aggregation, map side first, so a line in a third of all documents
costs a sketch for each task. The estimate decides where it is clear; lines whose estimate is within `band` of
the threshold are counted exactly. A line on `min_sites` sites or more is boilerplate: the document with the
smallest id that has it keeps it, every other one loses it.

Lines are compared without spaces, tabs and carriage returns at their ends, by 128 bits of xxhash64 (two
seeds). Blank lines are never removed. Only the positions of removed lines meet the documents again.

Defined results: null text stays null and has no lines; null site is the site ''; rows that repeat an id are
the same document (each loses or keeps the line); null ids keep a line only if no id stands on it; documents
stay even if nothing is left of them; a line on exactly min_sites sites goes; a line that stands several times in
the document that keeps it stays each time; very long texts cost time linear in their lines; other columns, of any
name, pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens.llm.common import free_name, materialize

MIN_SITES = 10
#: log2 of the sketch's registers: a relative error of about 3 % at 10.
LOG_REGISTERS = 10
#: Estimates within this share of the threshold are counted exactly: over six standard errors.
BAND = 0.25


def _lines(docs: DataFrame) -> DataFrame:
    """__id, __text_hash, __pos, __h1, __h2, __site of every line that is not blank."""
    line = F.trim(F.col("__line"), F.lit(" \t\r"))
    return (
        docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text_hash"), F.coalesce("source", F.lit("")).alias("__site"), F.posexplode(F.split("text", "\n")).alias("__pos", "__line"))
        .where(line != "")
        .select("__id", "__text_hash", "__pos", F.xxhash64(line).alias("__h1"), F.xxhash64(F.lit(1), line).alias("__h2"), "__site")
    )


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """__h1, __h2, __first: the lines on at least min_sites sites and the smallest id that has each."""
    lines = _lines(docs)
    spread = lines.groupBy("__h1", "__h2").agg(F.hll_sketch_agg("__site", F.lit(LOG_REGISTERS)).alias("sketch"), F.min("__id").alias("__first"))
    judged = materialize(spread.withColumn("sites", F.hll_sketch_estimate("sketch")).where(F.col("sites") >= min_sites * (1 - band)).select("__h1", "__h2", "__first", "sites"))
    clear = judged.where(F.col("sites") > min_sites * (1 + band))
    unclear = judged.where(F.col("sites") <= min_sites * (1 + band))
    counted = lines.join(unclear.select("__h1", "__h2"), ["__h1", "__h2"], "left_semi").select("__h1", "__h2", "__site").distinct().groupBy("__h1", "__h2").count().where(F.col("count") >= min_sites)
    exact = unclear.join(counted.select("__h1", "__h2"), ["__h1", "__h2"], "left_semi")
    return materialize(clear.unionByName(exact).select("__h1", "__h2", "__first"))


def removals(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """__id, __text_hash, __removed: the positions of the lines to remove from the documents that lose any."""
    bad = boilerplate(docs, min_sites)
    hits = _lines(docs).join(bad, ["__h1", "__h2"]).where(~F.col("__id").eqNullSafe(F.col("__first")))
    return materialize(hits.groupBy("__id", "__text_hash").agg(F.collect_set("__pos").alias("__removed")))


def _with_lines(docs: DataFrame, kept: list[str], min_sites: int) -> tuple[DataFrame, str, str]:
    """The columns `kept` of docs with the array of lines and of removed positions (null: none), and the names of both."""
    lines, hash_, removed, id_, text_hash = (free_name(docs, x) for x in ("lines", "hash", "removed", "id", "text_hash"))
    hits = removals(docs, min_sites).toDF(id_, text_hash, removed)
    left = docs.select(*kept, F.split("text", "\n").alias(lines), F.xxhash64("text").alias(hash_))
    # texts meet the positions by a merge join at every size: the plan does not turn from one size to another
    met = left.join(hits.hint("merge"), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(hash_) == F.col(text_hash)), "left")
    return met.drop(hash_, id_, text_hash), lines, removed


def _cleaned(lines: str, removed: str):
    """The text of the lines that stay; linear in lines and removals."""
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce(F.col(removed), F.array().cast("array<int>")))
    return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs without boilerplate lines; n_chars follows where there is such a column."""
    met, lines, removed = _with_lines(docs, [c for c in docs.columns if c != "text"], min_sites)
    out = met.withColumn("text", _cleaned(lines, removed))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def line_report(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines (not blank), n_removed, clean_sha256 of the text left, for every row of docs."""
    met, lines, removed = _with_lines(docs.select("doc_id", "text", "source"), ["doc_id"], min_sites)
    n_lines = F.size(F.filter(lines, lambda x: F.trim(x, F.lit(" \t\r")) != ""))
    return met.select(
        "doc_id",
        F.when(F.col(lines).isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.coalesce(F.array_size(removed), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(_cleaned(lines, removed), 256).alias("clean_sha256"),
    )
