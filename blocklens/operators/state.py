"""Versioned state: as-of lookups, overlays, history building, merges of layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blocklens.registry import query


def as_of(state: DataFrame, n: int) -> DataFrame:
    """key, block, value: the newest change of every key at or before n; a cleared key has a null value."""
    return state.where(F.col("block") <= n).groupBy("key").agg(F.max("block").alias("block"), F.max_by("value", "block").alias("value"))


def as_of_batch(state: DataFrame, probes: DataFrame) -> DataFrame:
    """key, n, block, value for every probe (key, n) that has a change at or before n.

    One window over the union of changes and probes, so a hot key costs its sort, not the product of its changes
    and probes. The change travels as a struct: a cleared value is a found answer, not a gap.
    """
    changes = state.select("key", F.col("block").alias("at"), F.lit(0).alias("side"), F.struct("block", "value").alias("change"))
    asked = probes.select("key", F.col("n").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(changes.schema["change"].dataType).alias("change"))
    seen = Window.partitionBy("key").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = changes.unionByName(asked).withColumn("last", F.last("change", ignorenulls=True).over(seen))
    return found.where((F.col("side") == 1) & F.col("last").isNotNull()).select("key", F.col("at").alias("n"), F.col("last.block").alias("block"), F.col("last.value").alias("value"))


def overlay(archive: DataFrame, live: DataFrame, promoted: int, n: int) -> DataFrame:
    """State at n from the archive up to `promoted` and the live window above it; the live row wins."""
    both = archive.where(F.col("block") <= promoted).unionByName(live.where(F.col("block") > promoted))
    return as_of(both, n)


def history(changes: DataFrame) -> DataFrame:
    """key, block, value of a change stream: last change of each block, changes without effect dropped.

    Absent and cleared are the same, so a first change that clears nothing is dropped as well.
    """
    last = changes.groupBy("key", "block").agg(F.max_by(F.struct("value"), "tx_num")["value"].alias("value"))
    before = F.lag("value").over(Window.partitionBy("key").orderBy("block"))
    return last.withColumn("before", before).where(~F.col("value").eqNullSafe(F.col("before"))).drop("before")


def merge_layers(layers: list[DataFrame]) -> DataFrame:
    """Union of sorted runs over disjoint block ranges, sorted by key and block inside partitions."""
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer)
    return out.distinct().repartition("key").sortWithinPartitions("key", "block")


@query("JN08 SC07 FL08", "SELECT key, max(block) AS block, max_by(struct_pack(v := value), block).v AS value FROM state WHERE block <= 48 GROUP BY key", "state")
def state_as_of(v):
    return as_of(v.state, 48)


_PROBES = "SELECT DISTINCT key, n FROM (SELECT key, unnest([5, 20, 40, 80]) AS n FROM state)"


@query("JN08", f"WITH p AS ({_PROBES}), r AS (SELECT p.key, p.n, s.block, s.value, row_number() OVER (PARTITION BY p.key, p.n ORDER BY s.block DESC) AS rn FROM p JOIN state s ON s.key = p.key AND s.block <= p.n) SELECT key, CAST(n AS BIGINT) AS n, block, value FROM r WHERE rn = 1", "state")
def state_as_of_batch(v):
    probes = v.state.select("key").distinct().select("key", F.explode(F.array(*[F.lit(n).cast("long") for n in (5, 20, 40, 80)])).alias("n"))
    return as_of_batch(v.state, probes)


@query("JN09 ST03 ST04", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY block DESC) AS rn FROM state WHERE block <= 70) SELECT key, block, value FROM r WHERE rn = 1", "state")
def state_overlay(v):
    return overlay(v.state, v.state, 50, 70)


@query("JN10", "WITH w AS (SELECT key, max(block) AS wiped FROM changes WHERE kind = 'signup' GROUP BY key), r AS (SELECT key, block, value, row_number() OVER (PARTITION BY key ORDER BY block DESC) AS rn FROM state) SELECT r.key, r.block, CASE WHEN w.wiped IS NULL OR w.wiped <= r.block THEN r.value END AS value FROM r LEFT JOIN w ON r.key = w.key WHERE rn = 1", "state")
def state_wipe(v):
    newest = as_of(v.state, 1 << 40)
    wipes = v.changes.where("kind = 'signup'").groupBy("key").agg(F.max("block").alias("wiped"))
    return newest.join(wipes, "key", "left").select("key", "block", F.when(F.col("wiped").isNull() | (F.col("wiped") <= F.col("block")), F.col("value")).alias("value"))


@query("AG23 AG25 WN03 WN04", "WITH b AS (SELECT *, lag(value) OVER (PARTITION BY key ORDER BY block) AS before FROM state) SELECT key, block, value FROM b WHERE value IS DISTINCT FROM before", "state")
def state_history(v):
    return history(v.changes)


@query("SC12 SC13 JN15", "WITH r AS (SELECT key, block, value, row_number() OVER (PARTITION BY key ORDER BY block DESC) AS rn FROM state WHERE key BETWEEN 10 AND 30 AND block <= 60) SELECT key, block, value FROM r WHERE rn = 1", "state")
def scan_pinned(v):
    return as_of(v.state.where("key between 10 and 30"), 60)


@query("SC07", "WITH r AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY block DESC) AS rn FROM state) SELECT key, value FROM r WHERE rn = 1 AND value IS NOT NULL", "state")
def live_values(v):
    return v.state.groupBy("key").agg(F.max_by("value", "block").alias("value")).where("value is not null")


@query("JN12", "WITH b AS (SELECT number, CAST(coalesce(sum(n) OVER (ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base, n FROM (SELECT block AS number, count(*) AS n FROM transactions GROUP BY block)) SELECT c.tx_num, b.number AS block FROM changes c JOIN b ON c.tx_num >= b.base AND c.tx_num < b.base + b.n", "transactions changes")
def txnum_to_block(v):
    from blocklens.operators.windows import running_total

    counts = v.transactions.groupBy(F.col("block").alias("number")).agg(F.count("*").alias("n"))
    base = running_total(counts, "number", "n", "base")
    # range join by cells: a block is listed in each cell of transaction numbers that it touches
    cell = 256
    cells = base.withColumn("cell", F.explode(F.sequence(F.floor(F.col("base") / cell), F.floor((F.col("base") + F.col("n") - 1) / cell))))
    asked = v.changes.select("tx_num", F.floor(F.col("tx_num") / cell).alias("cell"))
    return asked.join(cells, "cell").where((F.col("tx_num") >= F.col("base")) & (F.col("tx_num") < F.col("base") + F.col("n"))).select("tx_num", F.col("number").alias("block"))


@query("JN11", "SELECT l.address, count(*) AS slots, a.address IS NULL AS orphan FROM (SELECT DISTINCT address, topic1 FROM raw_logs) l LEFT JOIN (SELECT s_suppkey AS address FROM supplier WHERE s_suppkey % 9 <> 0) a ON l.address = a.address GROUP BY l.address, a.address", "raw_logs")
def account_slots(v):
    slots = v.raw_logs.select("address", "topic1").distinct().groupBy("address").agg(F.count("*").alias("slots"))
    accounts = v.table("supplier").where("s_suppkey % 9 <> 0").select(F.col("s_suppkey").alias("address"), F.lit(True).alias("known"))
    return slots.join(accounts, "address", "left").select("address", "slots", F.col("known").isNull().alias("orphan"))


@query("AG24", "SELECT sha256(topic0 || CAST(topic1 % 50 AS VARCHAR)) AS code_hash, min(block) AS first_block FROM raw_logs GROUP BY 1", "raw_logs")
def distinct_code(v):
    return v.raw_logs.groupBy(F.sha2(F.concat("topic0", (F.col("topic1") % 50).cast("string")), 256).alias("code_hash")).agg(F.min("block").alias("first_block"))


@query("AG26", "SELECT DISTINCT key, block, value FROM state", "state")
def merged_layers(v):
    return merge_layers([v.state.where("block < 30"), v.state.where("block between 30 and 60"), v.state.where("block > 60")])


@query("JN14", "WITH p AS (SELECT key, block AS n FROM state WHERE block > 0), r AS (SELECT p.key, p.n, s.value, row_number() OVER (PARTITION BY p.key, p.n ORDER BY s.block DESC) AS rn FROM p JOIN state s ON s.key = p.key AND s.block <= p.n - 1), w AS (SELECT key, n, CASE WHEN n % 13 = 0 THEN coalesce(value, 0) + 1 ELSE value END AS claimed, value FROM r WHERE rn = 1) SELECT key, n, claimed, value FROM w WHERE claimed IS DISTINCT FROM value", "state")
def witness_mismatch(v):
    asked = v.state.where("block > 0").select("key", (F.col("block") - 1).alias("n"))
    before = as_of_batch(v.state, asked).select("key", (F.col("n") + 1).alias("n"), "value")
    claimed = F.when(F.col("n") % 13 == 0, F.coalesce("value", F.lit(0)) + 1).otherwise(F.col("value"))
    return before.select("key", "n", claimed.alias("claimed"), "value").where(~F.col("claimed").eqNullSafe(F.col("value")))


@query("JN15 EX08", "WITH k AS (SELECT unnest(range(0, 40)) AS ordinal), r AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY block DESC) AS rn FROM state WHERE block <= 64) SELECT k.ordinal, (k.ordinal * 37) % 200 AS key, r.value FROM k LEFT JOIN r ON r.key = (k.ordinal * 37) % 200 AND r.rn = 1", "state")
def multi_key_lookup(v):
    asked = v.spark.range(40).select(F.col("id").alias("ordinal"), (F.col("id") * 37 % 200).alias("key"))
    return asked.join(as_of(v.state, 64).select("key", "value"), "key", "left").select("ordinal", "key", "value").orderBy("ordinal")


@query("ST09", "WITH u AS (SELECT key, value, 0 AS prio FROM state WHERE block = 31 UNION ALL SELECT key, value, 1 FROM state WHERE block = 30 UNION ALL SELECT key, value, 2 FROM state WHERE block = 29), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY prio) AS rn FROM u) SELECT key, value, prio FROM r WHERE rn = 1 ORDER BY prio, key LIMIT 4096", "state")
def witness_hints(v):
    at = lambda n, prio: v.state.where(F.col("block") == n).select("key", "value", F.lit(prio).alias("prio"))
    hints = at(31, 0).unionByName(at(30, 1)).unionByName(at(29, 2))
    first = hints.groupBy("key").agg(F.min(F.struct("prio", "value")).alias("h")).select("key", "h.value", "h.prio")
    return first.orderBy("prio", "key").limit(4096)


@query("AG29", "SELECT CAST(count(DISTINCT key) AS BIGINT) AS keys, count(*) AS entries, count(*) FILTER (WHERE value IS NULL) AS cleared, CAST(ceil(count(*) / 1024.0) AS BIGINT) AS pages, (SELECT max(n) FROM (SELECT count(*) AS n FROM state GROUP BY key)) AS most FROM state", "state")
def domain_summary(v):
    per_key = v.state.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("c"))
    return per_key.agg(F.count("*").alias("keys"), F.sum("n").alias("entries"), F.sum("c").alias("cleared"), F.ceil(F.sum("n") / 1024.0).alias("pages"), F.max("n").alias("most"))


@query("SC08", "SELECT key, count(*) AS changes, min(tx_num) AS first_tx, max(tx_num) AS last_tx FROM changes GROUP BY key", "changes")
def change_streams(v):
    return v.changes.groupBy("key").agg(F.count("*").alias("changes"), F.min("tx_num").alias("first_tx"), F.max("tx_num").alias("last_tx"))
