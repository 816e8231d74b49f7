"""Point lookups, block, transaction and receipt objects, counts and derived columns."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from blocklens.functions.hexes import quantity, storage_word
from blocklens.registry import query


def effective_gas_price() -> Column:
    """Types 0 and 1 pay their price; later types the base fee and tip, up to their maximum."""
    return F.when(F.col("type") < 2, F.col("price")).otherwise(F.when(F.col("base_fee").isNull(), F.col("price")).otherwise(F.least(F.col("base_fee") + F.col("tip_cap"), F.col("price"))))


EFFECTIVE_SQL = "CASE WHEN type < 2 THEN price WHEN base_fee IS NULL THEN price ELSE least(base_fee + tip_cap, price) END"


@query("SC02 SC04 SC05 PR01 SF01", "SELECT number, printf('0x%x', number) AS number_hex, hash, parent_hash, printf('0x%x', gas_used) AS gas_used_hex, printf('0x%x', base_fee) AS base_fee_hex, timestamp FROM blocks", "blocks")
def chain_blocks(v):
    return v.blocks.select("number", quantity(F.col("number")).alias("number_hex"), "hash", "parent_hash", quantity(F.col("gas_used")).alias("gas_used_hex"), quantity(F.col("base_fee")).alias("base_fee_hex"), "timestamp")


@query("SC03 JN07", "SELECT number, hash, gas_used, base_fee FROM blocks WHERE number = 7", "blocks")
def block_by_number(v):
    return v.between(7, 7).blocks.select("number", "hash", "gas_used", "base_fee")


@query("PR03 PR04 PR05 PR06", f"SELECT t.block, tx_index, t.hash, type, sender, recipient, {EFFECTIVE_SQL} AS effective_gas_price, CASE WHEN type = 0 AND price % 80 >= 35 THEN (price % 80 - 35) // 2 END AS chain_id, CASE WHEN type = 3 THEN price % 6 + 1 ELSE 0 END AS blob_count FROM transactions t JOIN blocks b ON t.block = b.number", "blocks")
def chain_transactions(v):
    sig = F.col("price") % 80
    return (
        v.transactions.join(v.blocks.select(F.col("number").alias("block"), "base_fee"), "block")
        .select(
            "block", "tx_index", "hash", "type", "sender", "recipient", effective_gas_price().alias("effective_gas_price"),
            F.when((F.col("type") == 0) & (sig >= 35), F.floor((sig - 35) / 2)).alias("chain_id"),
            F.when(F.col("type") == 3, F.col("price") % 6 + 1).otherwise(F.lit(0)).cast("long").alias("blob_count"),
        )
    )


@query("JN07 PR12", "SELECT w.hash, t.block, t.tx_index, t.sender FROM (SELECT sha256(CAST(x AS VARCHAR)) AS hash FROM (SELECT unnest(range(0, 3000000, 997)) AS x)) w LEFT JOIN transactions t ON w.hash = t.hash", "transactions")
def tx_by_hash(v):
    wanted = v.spark.range(0, 3_000_000, 997).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    return wanted.join(v.transactions, "hash", "left").select("hash", "block", "tx_index", "sender")


@query("JN07", "SELECT block, tx_index, hash FROM transactions WHERE block = 3 AND tx_index = 42", "transactions")
def tx_by_block_and_index(v):
    return v.between(3, 3).transactions.where("tx_index = 42").select("block", "tx_index", "hash")


@query(
    "JN13 PR07 PR09 WN01 WN02",
    f"""WITH g AS (SELECT *, cumulative_gas - lag(cumulative_gas, 1, 0) OVER (PARTITION BY block ORDER BY tx_index) AS gas_used FROM receipts),
n AS (SELECT block, tx_index, count(*) AS logs FROM raw_logs GROUP BY block, tx_index)
SELECT g.block, g.tx_index, g.hash, type, CASE WHEN g.status = 'F' THEN 1 WHEN g.status = 'O' THEN 0 END AS status, CASE WHEN g.status = 'P' THEN sha256('root' || g.hash) END AS root,
  g.gas_used, cumulative_gas, {EFFECTIVE_SQL} AS effective_gas_price, coalesce(n.logs, 0) AS logs,
  CAST(coalesce(sum(coalesce(n.logs, 0)) OVER (PARTITION BY g.block ORDER BY g.tx_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_log_index
FROM g JOIN blocks b ON g.block = b.number LEFT JOIN n ON g.block = n.block AND g.tx_index = n.tx_index""",
    "blocks raw_logs",
)
def block_receipts(v):
    order = Window.partitionBy("block").orderBy("tx_index")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    counts = v.raw_logs.groupBy("block", "tx_index").agg(F.count("*").alias("logs"))
    return (
        v.receipts.join(v.blocks.select(F.col("number").alias("block"), "base_fee"), "block")
        .join(counts, ["block", "tx_index"], "left")
        .withColumn("logs", F.coalesce("logs", F.lit(0)))
        .select(
            "block", "tx_index", "hash", "type", F.when(F.col("status") == "F", 1).when(F.col("status") == "O", 0).alias("status"), F.when(F.col("status") == "P", F.sha2(F.concat(F.lit("root"), "hash"), 256)).alias("root"),
            (F.col("cumulative_gas") - F.lag("cumulative_gas", 1, 0).over(order)).alias("gas_used"), "cumulative_gas", effective_gas_price().alias("effective_gas_price"), "logs",
            F.coalesce(F.sum("logs").over(before), F.lit(0)).alias("first_log_index"),
        )
    )


@query("PR14", "WITH w AS (SELECT unnest(range(0, 400)) AS number) SELECT w.number, b.n AS txs FROM w LEFT JOIN (SELECT block, count(*) AS n FROM transactions GROUP BY block) b ON w.number = b.block", "transactions")
def block_tx_counts(v):
    counts = v.transactions.groupBy(F.col("block").alias("number")).agg(F.count("*").alias("txs"))
    return v.spark.range(400).withColumnRenamed("id", "number").join(counts, "number", "left")


@query("PR02 SF51 SF53", "SELECT b.number, b.hash, t.hashes FROM blocks b JOIN (SELECT block, string_agg(hash, ',' ORDER BY tx_index) AS hashes FROM transactions GROUP BY block) t ON b.number = t.block", "blocks")
def block_objects(v):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("tx_index", "hash"))), lambda x: x["hash"])
    bodies = v.transactions.groupBy(F.col("block").alias("number")).agg(F.array_join(ordered, ",").alias("hashes"))
    return v.blocks.select("number", "hash").join(bodies, "number")


@query("PR13 JN13", "SELECT number, number % 3 AS ordinal, sha256('uncle' || CAST(number AS VARCHAR)) AS uncle FROM blocks WHERE number % 5 = 0", "blocks")
def uncle_by_index(v):
    uncles = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i.cast("long") == F.col("number") % 3, F.sha2(F.concat(F.lit("uncle"), F.col("number").cast("string")), 256)))
    return v.blocks.where("number % 5 = 0").select("number", F.posexplode(uncles).alias("i", "uncle")).where("uncle is not null").select("number", F.col("i").cast("long").alias("ordinal"), "uncle")


@query("SC11 WN02", "SELECT number, CAST(coalesce(sum(n) OVER (ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base, n AS txs FROM (SELECT block AS number, count(*) AS n FROM transactions GROUP BY block)", "transactions")
def block_boundaries(v):
    from blocklens.operators.windows import running_total

    counts = v.transactions.groupBy(F.col("block").alias("number")).agg(F.count("*").alias("txs"))
    return running_total(counts, "number", "txs", "base")


@query("PR17 SF16", "SELECT key, max(block) AS block, '0x' || lpad(printf('%x', max(value)), 64, '0') AS word FROM state WHERE value IS NOT NULL GROUP BY key", "state")
def storage_words(v):
    return v.state.where("value is not null").groupBy("key").agg(F.max("block").alias("block"), F.max("value").alias("v")).select("key", "block", storage_word(F.col("v")).alias("word"))


@query("PR16", "SELECT key, len(list(value)) AS nonce, CAST(sum(value) AS BIGINT) AS balance, CASE WHEN key % 4 = 0 THEN sha256(CAST(key AS VARCHAR)) END AS code_hash FROM state WHERE value IS NOT NULL GROUP BY key", "state")
def account_values(v):
    return v.state.where("value is not null").groupBy("key").agg(F.count("*").alias("nonce"), F.sum("value").alias("balance")).select("key", "nonce", "balance", F.when(F.col("key") % 4 == 0, F.sha2(F.col("key").cast("string"), 256)).alias("code_hash"))


@query("PR18 SF44", "SELECT max(number) AS head, CASE WHEN 1600010000 - max(timestamp) <= 60 THEN 'following' WHEN 1600010000 - max(timestamp) <= 3600 THEN 'delayed' ELSE 'archive' END AS state FROM blocks", "blocks")
def status_document(v):
    age = F.lit(1_600_010_000) - F.max("timestamp")
    return v.blocks.agg(F.max("number").alias("head"), F.when(age <= 60, "following").when(age <= 3600, "delayed").otherwise("archive").alias("state"))


@query("PR19 PR22", "SELECT '0x1' AS chain_id, '1' AS net_version, false AS syncing, true AS listening, 0 AS accounts, min(number) AS earliest, max(number) AS latest FROM blocks", "blocks")
def capabilities(v):
    return v.blocks.agg(F.min("number").alias("earliest"), F.max("number").alias("latest")).select(F.lit("0x1").alias("chain_id"), F.lit("1").alias("net_version"), F.lit(False).alias("syncing"), F.lit(True).alias("listening"), F.lit(0).alias("accounts"), "earliest", "latest")


@query("SF06 SF07 AG22", "SELECT CAST(('0x' || substr(hash, 1, 12)) AS BIGINT) AS prefix, CAST(('0x' || substr(hash, 1, 12)) AS BIGINT) >> 42 AS bucket, block, tx_index FROM transactions", "transactions")
def hash_index(v):
    prefix = F.conv(F.substring("hash", 1, 12), 16, 10).cast("long")
    return v.transactions.select(prefix.alias("prefix"), F.shiftright(prefix, 42).alias("bucket"), "block", "tx_index")


@query("AG22 SF32", "SELECT n, CAST(greatest(0, ceil(log2(n / 2048.0))) AS INTEGER) AS bits FROM (SELECT count(*) AS n FROM transactions)", "transactions")
def hash_index_bits(v):
    return v.transactions.agg(F.count("*").alias("n")).select("n", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / 2048.0)).cast("int")).alias("bits"))


@query("SF52 PR09", "SELECT block, tx_index, price AS l1_fee, type AS origin FROM transactions", "transactions")
def receipt_extras(v):
    pairs = F.array(F.struct(F.lit("l1_fee").alias("k"), F.col("price").cast("string").alias("v")), F.struct(F.lit("origin").alias("k"), F.col("type").cast("string").alias("v")))
    extras = v.transactions.select("block", "tx_index", F.map_from_entries(pairs).alias("m"))
    return extras.select("block", "tx_index", F.col("m")["l1_fee"].cast("long").alias("l1_fee"), F.col("m")["origin"].cast("int").alias("origin"))


@query("SC06", "SELECT number, length(body) = size AS whole, sha256(body) = digest AS genuine FROM frames", "frames")
def frame_audit(v):
    """Stored frames against the length and digest that were signed; the view has cut and altered ones."""
    return v.frames.select("number", (F.length("body") == F.col("size")).alias("whole"), (F.sha2("body", 256) == F.col("digest")).alias("genuine"))


@query("PR15 SC04", "SELECT t.block, t.tx_index, t.hash, r.cumulative_gas FROM transactions t JOIN receipts r ON t.block = r.block AND t.tx_index = r.tx_index", "receipts")
def joined_frames(v):
    blocks = v.transactions.select("block", "tx_index", "hash")
    return blocks.join(v.receipts.select("block", "tx_index", "cumulative_gas"), ["block", "tx_index"])
