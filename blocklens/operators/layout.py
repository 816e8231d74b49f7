"""Archive layout: unions of archive and live window, reorgs, verification, compaction, garbage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blocklens.operators.windows import islands
from blocklens.registry import query

#: Compaction: widest run, batches a merge may rewrite, fixed cost of a merge in batches.
MAX_WIDTH, BUDGET_BATCHES, FIXED_BATCHES = 16, 64, 4


def union_at(archive: DataFrame, live: DataFrame, promoted: int, number: str = "number") -> DataFrame:
    """Archive rows up to `promoted`, live rows above it; rows of both during a promotion count once."""
    return archive.where(F.col(number) <= promoted).unionByName(live.where(F.col(number) > promoted))


def merge_run(objects: list[tuple[int, int, bool]], max_objects: int, batch: int) -> tuple[int, int]:
    """(position, width) of the run of objects (first, last, base) to merge next, (-1, 0) for none.

    A planning table of at most some thousand rows; spans of runs come from running totals.
    """
    n = len(objects)
    above = sum(not base for *_, base in objects)
    # a run breaks at a base object or a gap: number the unbroken stretches
    stretch, spans = [0] * n, [last - first + 1 for first, last, _ in objects]
    for i in range(1, n):
        joined = objects[i][0] == objects[i - 1][1] + 1 and not objects[i][2] and not objects[i - 1][2]
        stretch[i] = stretch[i - 1] + (not joined)
    upto = [0]
    for s in spans:
        upto.append(upto[-1] + s)

    def runs(w):
        return [(upto[i + w] - upto[i], -i) for i in range(n - w + 1) if stretch[i] == stretch[i + w - 1] and not objects[i][2]]

    least = {w: min(found) for w in range(2, min(n, MAX_WIDTH) + 1) if (found := runs(w))}
    if above > max_objects:
        valued = [((w - 1) / (s + batch * FIXED_BATCHES), -w, -i) for w, (s, i) in least.items() if s <= batch * BUDGET_BATCHES]
        if valued:
            _, w, i = max(valued)
            if -w >= 3:
                return i, -w
    else:
        for w in sorted(least, reverse=True):
            if least[w][0] <= batch:
                return -least[w][1], w
        return -1, 0
    pairs = [(max(spans[i], spans[i + 1]) / min(spans[i], spans[i + 1]), spans[i] + spans[i + 1], -i) for i in range(n - 1) if stretch[i] == stretch[i + 1] and not objects[i][2]]
    return (-min(pairs)[2], 2) if pairs else (-1, 0)


def promotion_target(promoted: int, finalized: int, batch: int, group: int, oldest_age: float, max_age: float, max_batches: int, live_head: int | None = None, network_head: int | None = None) -> int | None:
    """The block to promote to, at the end of a group; None to wait.

    Full batches go at once. Less goes only when the oldest block is older than max_age and the live window is within a
    batch of the network's head, as all blocks are old while the window catches up.
    """
    head = finalized if live_head is None else live_head
    reach = min(finalized, head, promoted + batch * max_batches)
    target = reach - (reach + 1) % group
    if target <= promoted:
        return None
    catching_up = network_head is not None and network_head - head > batch
    full = target - promoted >= batch
    return target if full or (oldest_age >= max_age and not catching_up) else None


@query("ST03 TR08", "SELECT number, hash, number > 100 AS live FROM blocks", "blocks")
def archive_live_union(v):
    side = lambda live: v.blocks.select("number", "hash", F.lit(live).alias("live"))
    return union_at(side(False), side(True), 100)


@query("ST05", "SELECT DISTINCT sender FROM transactions EXCEPT SELECT recipient FROM transactions", "transactions")
def diff_coverage(v):
    return v.transactions.select("sender").subtract(v.transactions.select(F.col("recipient").alias("sender")))


@query("ST06 TR06", "SELECT number, hash FROM blocks WHERE number > 95 AND number <= 120", "blocks")
def removed_on_reorg(v):
    ancestor, spooled = 95, 120
    return v.blocks.where(F.col("number") <= spooled).select("number", "hash").subtract(v.blocks.where(F.col("number") <= ancestor).select("number", "hash"))


@query("ST07", "SELECT first, last FROM (SELECT number * 10 AS first, number * 10 + 9 AS last FROM blocks WHERE number NOT BETWEEN 4 AND 7) UNION ALL SELECT 40, 79", "blocks")
def replaced_run(v):
    objects = v.blocks.select((F.col("number") * 10).alias("first"), (F.col("number") * 10 + 9).alias("last"))
    run = objects.where("first between 40 and 70")
    merged = run.agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return objects.join(run.select("first"), "first", "left_anti").unionByName(merged)


@query("JN21 TR06", "SELECT max(number) AS ancestor FROM blocks WHERE number < 83", "blocks")
def fork_ancestor(v):
    own = v.blocks.select("number", "hash")
    node = own.select("number", F.when(F.col("number") < 83, F.col("hash")).otherwise(F.sha2("hash", 256)).alias("hash"))
    return own.join(node, ["number", "hash"]).agg(F.max("number").alias("ancestor"))


#: Blocks of a live window, at most.
LIVE_WINDOW = 20


@query("WN12", f"WITH b AS (SELECT number FROM blocks WHERE number % 37 <> 11), i AS (SELECT number, number - row_number() OVER (ORDER BY number) AS g FROM b), r AS (SELECT min(number) AS first, max(number) AS last FROM i GROUP BY g ORDER BY last DESC LIMIT 1) SELECT greatest(first, last - {LIVE_WINDOW - 1}) AS first, last, last - greatest(first, last - {LIVE_WINDOW - 1}) + 1 AS n FROM r", "blocks")
def contiguous_window(v):
    held = v.blocks.where("number % 37 <> 11").select("number")
    first = F.greatest("first", F.col("last") - (LIVE_WINDOW - 1))
    return islands(held, "number").orderBy(F.col("last").desc()).limit(1).select(first.alias("first"), "last", (F.col("last") - first + 1).alias("n"))


@query("WN13", "WITH b AS (SELECT DISTINCT l_orderkey AS n FROM lineitem), i AS (SELECT n, n - row_number() OVER (ORDER BY n) AS g FROM b) SELECT min(n) AS first, max(n) AS last, count(*) AS n FROM i GROUP BY g")
def window_runs(v):
    return islands(v.table("lineitem").select(F.col("l_orderkey").alias("k")).distinct(), "k")


@query("AG31", "SELECT r.block, bool_and(r.gas > 0) AS consistent, sum(r.gas) = max(b.gas_used) AS sums FROM (SELECT block, cumulative_gas - lag(cumulative_gas, 1, 0) OVER (PARTITION BY block ORDER BY tx_index) AS gas FROM receipts) r JOIN blocks b ON r.block = b.number GROUP BY r.block", "blocks")
def block_checks(v):
    gas = F.col("cumulative_gas") - F.lag("cumulative_gas", 1, 0).over(Window.partitionBy("block").orderBy("tx_index"))
    sums = v.receipts.withColumn("gas", gas).groupBy("block").agg(F.bool_and(F.col("gas") > 0).alias("consistent"), F.sum("gas").alias("s"))
    return sums.join(v.blocks.select(F.col("number").alias("block"), "gas_used"), "block").select("block", "consistent", (F.col("s") == F.col("gas_used")).alias("sums"))


@query("AG32", "SELECT block, tx_index FROM transactions ORDER BY md5('seed7:' || CAST(block AS VARCHAR) || ':' || CAST(tx_index AS VARCHAR)) LIMIT 64", "transactions")
def seeded_sample(v):
    key = F.md5(F.concat_ws(":", F.lit("seed7"), F.col("block").cast("string"), F.col("tx_index").cast("string")))
    return v.transactions.orderBy(key).limit(64).select("block", "tx_index")


@query("AG33", "SELECT number, number % 128 = 0 AS rerun, number % 997 = 0 AS crosscheck FROM blocks WHERE number % 128 = 0 OR number % 997 = 0", "blocks")
def systematic_sample(v):
    return v.blocks.select("number", (F.col("number") % 128 == 0).alias("rerun"), (F.col("number") % 997 == 0).alias("crosscheck")).where("rerun or crosscheck")


@query("SC19", "SELECT o.id, o.unreferenced_at + 604800 AS due FROM (SELECT p_partkey AS id, 1700000000 + p_partkey * 1000 AS unreferenced_at FROM part) o WHERE o.id NOT IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1992-02-15') AND o.unreferenced_at + 604800 <= 1700700000")
def gc_candidates(v):
    objects = v.table("part").select(F.col("p_partkey").alias("id"), (F.lit(1_700_000_000) + F.col("p_partkey") * 1000).alias("at"))
    used = v.table("lineitem").where("l_shipdate < timestamp_ntz'1992-02-15 00:00:00'").select(F.col("l_partkey").alias("id"))
    return objects.join(used, "id", "left_anti").select("id", (F.col("at") + 604_800).alias("due")).where("due <= 1700700000")


#: Blocks of a batch and shards of the live window.
BATCH_BLOCKS, SHARDS = 256, 16


def index_level(span, batch: int = BATCH_BLOCKS):
    """The tier of an index object: level l covers at least batch x 4^l blocks."""
    return sum((span >= batch * 4**i).cast("int") for i in range(1, 16))


@query(
    "SF32 SF31",
    f"SELECT number, CAST(greatest(0, floor(log2(span // {BATCH_BLOCKS}) / 2)) AS INTEGER) AS level, CAST(('0x' || substr(hash, 1, 2)) AS BIGINT) % {SHARDS} AS shard FROM (SELECT number, hash, {BATCH_BLOCKS} * (1 + number * number % 5000) - number % 2 AS span FROM blocks)",
    "blocks",
)
def index_levels(v):
    """Level of an index object by its span, shard of a record by the first byte of its hash."""
    n = F.col("number")
    span = BATCH_BLOCKS * (1 + n * n % 5000) - n % 2
    return v.blocks.select("number", index_level(span).alias("level"), (F.conv(F.substring("hash", 1, 2), 16, 10).cast("long") % SHARDS).alias("shard"))


def tiles(files: DataFrame, covered: str = "reach") -> DataFrame:
    """Of files (part, first, last) those that tile each part without gap or overlap beyond need: in order of their begin,
    the longest of each begin, as far as it reaches past all before it."""
    longest = files.groupBy("part", "first").agg(F.max("last").alias("last"))
    before = F.max("last").over(Window.partitionBy("part").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    begin = F.greatest("first", F.coalesce(F.col(covered) + 1, F.col("first")))
    return longest.withColumn(covered, before).where(F.col(covered).isNull() | (F.col("last") > F.col(covered))).select("part", begin.alias("first"), "last", (F.col(covered).isNotNull() & (F.col("first") > F.col(covered) + 1)).alias("gap"))


@query(
    "SC09",
    """WITH f AS (SELECT l_orderkey // 1000 AS part, l_orderkey // 7 * 7 AS first, l_orderkey // 7 * 7 + l_linenumber * 3 AS last FROM lineitem WHERE l_linenumber > 1),
m AS (SELECT part, first, max(last) AS last FROM f GROUP BY part, first),
r AS (SELECT *, max(last) OVER (PARTITION BY part ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m)
SELECT part, greatest(first, coalesce(reach + 1, first)) AS first, last, reach IS NOT NULL AND first > reach + 1 AS gap FROM r WHERE reach IS NULL OR last > reach""",
)
def range_tiles(v):
    first = F.floor(F.col("l_orderkey") / 7) * 7
    files = v.table("lineitem").where("l_linenumber > 1").select(F.floor(F.col("l_orderkey") / 1000).alias("part"), first.alias("first"), (first + F.col("l_linenumber") * 3).alias("last"))
    return tiles(files)


@query("TR04 TR09 TR10", "SELECT number // 8 AS grp, count(*) AS n, min(number) AS first, max(number) AS last, max_by(hash, number) AS head FROM blocks GROUP BY 1", "blocks")
def block_groups(v):
    return v.blocks.groupBy(F.floor(F.col("number") / 8).alias("grp")).agg(F.count("*").alias("n"), F.min("number").alias("first"), F.max("number").alias("last"), F.max_by("hash", "number").alias("head"))


@query("TR13", "SELECT number, least(number - 32, 120) AS safe, least(number - 64, 110) AS finalized FROM blocks WHERE number >= 64", "blocks")
def capped_pointers(v):
    return v.blocks.where("number >= 64").select("number", F.least(F.col("number") - 32, F.lit(120)).alias("safe"), F.least(F.col("number") - 64, F.lit(110)).alias("finalized"))
