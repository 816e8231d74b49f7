"""Whole objects as columns: headers, block bodies, transactions and receipts by type, rendered as served.

A field that an object's type or fork does not have is null. Fields that the tables do not hold are derived from those
they hold: digests stand for roots and signatures, and forks begin at fixed blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens.functions.hexes import quantity
from blocklens.operators import fees
from blocklens.operators.lookup import EFFECTIVE_SQL, effective_gas_price
from blocklens.registry import query

#: First blocks of the view's forks that add header fields; difficulty ends with MERGED.
BASE_FEE, WITHDRAWALS, BEACON_ROOT, REQUESTS, MERGED = 5, 15, 20, 30, 60


def address(n: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(n)), 40, "0"))


def _digest(label: str, n: Column) -> Column:
    return F.concat(F.lit("0x"), F.sha2(F.concat(F.lit(label), n.cast("string")), 256))


def _trimmed(digest: Column) -> Column:
    """A digest as a quantity: without leading zeros."""
    return F.concat(F.lit("0x"), F.regexp_replace(digest, "^0+(?=.)", ""))


def _from(first: int, x: Column) -> Column:
    return F.when(F.col("number") >= first, x)


def headers(blocks: DataFrame) -> DataFrame:
    """The hash and the 21 fields of every header."""
    n = F.col("number")
    data = lambda c: F.concat(F.lit("0x"), F.col(c))
    return blocks.select(
        data("hash").alias("hash"), data("parent_hash").alias("parentHash"), _digest("uncles", n).alias("sha3Uncles"), address(F.col("miner")).alias("miner"), _digest("state", n).alias("stateRoot"),
        _digest("txs", n).alias("transactionsRoot"), _digest("receipts", n).alias("receiptsRoot"), F.concat(F.lit("0x"), F.repeat(F.sha2(F.concat(F.lit("bloom"), n.cast("string")), 256), F.lit(8))).alias("logsBloom"),
        quantity(F.when(n < MERGED, n * 1000 + 131_072).otherwise(F.lit(0)).cast("long")).alias("difficulty"), quantity(n).alias("number"), quantity(F.col("gas_limit")).alias("gasLimit"), quantity(F.col("gas_used")).alias("gasUsed"),
        quantity(F.col("timestamp")).alias("timestamp"), F.concat(F.lit("0x"), F.lower(F.hex(F.concat(F.lit("block "), n.cast("string")).cast("binary")))).alias("extraData"), _digest("mix", n).alias("mixHash"),
        F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(n * 7)), 16, "0")).alias("nonce"), _from(BASE_FEE, quantity(F.col("base_fee"))).alias("baseFeePerGas"), _from(WITHDRAWALS, _digest("withdrawals", n)).alias("withdrawalsRoot"),
        quantity(F.col("blob_gas_used")).alias("blobGasUsed"), quantity(F.col("excess_blob_gas")).alias("excessBlobGas"), _from(BEACON_ROOT, _digest("beacon", n)).alias("parentBeaconBlockRoot"), _from(REQUESTS, _digest("requests", n)).alias("requestsHash"),
    )


@query(
    "PR01 SF01",
    f"""SELECT '0x' || hash AS hash, '0x' || parent_hash AS parentHash, '0x' || sha256('uncles' || number) AS sha3Uncles, '0x' || lpad(printf('%x', miner), 40, '0') AS miner, '0x' || sha256('state' || number) AS stateRoot,
  '0x' || sha256('txs' || number) AS transactionsRoot, '0x' || sha256('receipts' || number) AS receiptsRoot, '0x' || repeat(sha256('bloom' || number), 8) AS logsBloom,
  printf('0x%x', CASE WHEN number < {MERGED} THEN number * 1000 + 131072 ELSE 0 END) AS difficulty, printf('0x%x', number) AS number, printf('0x%x', gas_limit) AS gasLimit, printf('0x%x', gas_used) AS gasUsed, printf('0x%x', timestamp) AS timestamp,
  '0x' || lower(hex('block ' || number)) AS extraData, '0x' || sha256('mix' || number) AS mixHash, '0x' || lpad(printf('%x', number * 7), 16, '0') AS nonce, CASE WHEN number >= {BASE_FEE} THEN printf('0x%x', base_fee) END AS baseFeePerGas,
  CASE WHEN number >= {WITHDRAWALS} THEN '0x' || sha256('withdrawals' || number) END AS withdrawalsRoot, CASE WHEN blob_gas_used IS NOT NULL THEN printf('0x%x', blob_gas_used) END AS blobGasUsed,
  CASE WHEN excess_blob_gas IS NOT NULL THEN printf('0x%x', excess_blob_gas) END AS excessBlobGas, CASE WHEN number >= {BEACON_ROOT} THEN '0x' || sha256('beacon' || number) END AS parentBeaconBlockRoot,
  CASE WHEN number >= {REQUESTS} THEN '0x' || sha256('requests' || number) END AS requestsHash FROM blocks""",
    "blocks",
)
def header_objects(v):
    return headers(v.blocks)


@query(
    "PR02 SF51 SF53",
    f"""WITH t AS (SELECT block, string_agg('0x' || hash, ',' ORDER BY tx_index) AS transactions, 500 + 110 * count(*) AS size FROM transactions GROUP BY block)
SELECT '0x' || b.hash AS hash, printf('0x%x', number) AS number, printf('0x%x', size) AS size, transactions, CASE WHEN number % 5 = 0 THEN '0x' || sha256('uncle' || number) ELSE '' END AS uncles,
  CASE WHEN number >= {WITHDRAWALS} THEN array_to_string([printf('0x%x', number * 3 + i) || ':' || printf('0x%x', (number + i) % 50) || ':0x' || lpad(printf('%x', number % 500 + i), 40, '0') || ':' || printf('0x%x', number * 10 + i) FOR i IN range(number % 3)], ',') END AS withdrawals
FROM blocks b JOIN t ON t.block = b.number""",
    "blocks",
)
def block_bodies(v):
    """Size, transaction hashes, uncle hashes and withdrawals (index:validator:address:amount) of every block."""
    n = F.col("number")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("tx_index", "hash"))), lambda x: F.concat(F.lit("0x"), x["hash"]))
    bodies = v.transactions.groupBy(F.col("block").alias("number")).agg(F.array_join(ordered, ",").alias("transactions"), (F.lit(500) + 110 * F.count("*")).alias("size"))
    one = lambda i: F.concat_ws(":", quantity(n * 3 + i), quantity((n + i) % 50), address(n % 500 + i), quantity(n * 10 + i))
    withdrawals = F.array_join(F.transform(F.slice(F.array(*[F.lit(i).cast("long") for i in range(3)]), F.lit(1), (n % 3).cast("int")), one), ",")
    uncles = F.when(n % 5 == 0, _digest("uncle", n)).otherwise(F.lit(""))
    # Ahead of the select: inside a lambda, Spark takes a name for an alias of the same select before it takes it for a column.
    blocks = v.blocks.join(bodies, "number").withColumn("withdrawals", _from(WITHDRAWALS, withdrawals))
    return blocks.select(F.concat(F.lit("0x"), F.col("hash")).alias("hash"), quantity(n).alias("number"), quantity(F.col("size")).alias("size"), "transactions", uncles.alias("uncles"), "withdrawals")


_RS = "'0x' || regexp_replace(sha256('{}' || t.hash), '^0+(.)', '\\1')"


@query(
    "PR03 PR04 PR05 PR06 SF51",
    f"""SELECT '0x' || b.hash AS blockHash, printf('0x%x', t.block) AS blockNumber, printf('0x%x', b.timestamp) AS blockTimestamp, '0x' || lpad(printf('%x', sender), 40, '0') AS "from", '0x' || t.hash AS hash, printf('0x%x', tx_index) AS transactionIndex, printf('0x%x', type) AS type,
  printf('0x%x', price % 1000) AS nonce, printf('0x%x', CASE WHEN type < 2 THEN price ELSE {EFFECTIVE_SQL} END) AS gasPrice, printf('0x%x', 21000 + price % 7919) AS gas, CASE WHEN recipient IS NOT NULL THEN '0x' || lpad(printf('%x', recipient), 40, '0') END AS "to", printf('0x%x', price * 3) AS value,
  '0x' || lower(hex(status)) AS input, printf('0x%x', CASE WHEN type = 0 THEN price % 80 ELSE price % 2 END) AS v, {_RS.format('r')} AS r, {_RS.format('s')} AS s, CASE WHEN type > 0 THEN printf('0x%x', price % 2) END AS yParity,
  CASE WHEN type > 0 THEN '0x1' WHEN price % 80 >= 35 THEN printf('0x%x', (price % 80 - 35) // 2) END AS chainId, CASE WHEN type >= 2 THEN printf('0x%x', tip_cap) END AS maxPriorityFeePerGas, CASE WHEN type >= 2 THEN printf('0x%x', price) END AS maxFeePerGas,
  CASE WHEN type >= 1 THEN array_to_string(['0x' || lpad(printf('%x', sender + i), 40, '0') || ':' || printf('0x%x', i) FOR i IN range(price % 3)], ',') END AS accessList, CASE WHEN type = 3 THEN printf('0x%x', price // 10) END AS maxFeePerBlobGas,
  CASE WHEN type = 3 THEN array_to_string(['0x01' || substr(sha256(t.hash || i), 3) FOR i IN range(price % 6 + 1)], ',') END AS blobVersionedHashes, CASE WHEN type = 4 THEN '0x1:0x' || lpad(printf('%x', sender + 7), 40, '0') || ':' || printf('0x%x', price % 11) END AS authorizationList
FROM transactions t JOIN blocks b ON t.block = b.number""",
    "blocks",
)
def transaction_objects(v):
    """The fields of every transaction by its type; access lists as address:keys, authorizations as chain:address:nonce."""
    kind, price = F.col("type"), F.col("price")
    blocks = v.blocks.select(F.col("number").alias("block"), F.concat(F.lit("0x"), F.col("hash")).alias("blockHash"), "timestamp", "base_fee")
    first = lambda n, most: F.slice(F.array(*[F.lit(i).cast("long") for i in range(most)]), F.lit(1), n.cast("int"))
    access = F.array_join(F.transform(first(price % 3, 3), lambda i: F.concat_ws(":", address(F.col("sender") + i), quantity(i))), ",")
    blobs = F.array_join(F.transform(first(price % 6 + 1, 6), lambda i: F.concat(F.lit("0x01"), F.substring(F.sha2(F.concat("digest", i.cast("string")), 256), 3, 62))), ",")
    signature = F.when(kind == 0, price % 80).otherwise(price % 2)
    return v.transactions.withColumnRenamed("hash", "digest").join(blocks, "block").select(
        "blockHash", quantity(F.col("block")).alias("blockNumber"), quantity(F.col("timestamp")).alias("blockTimestamp"), address(F.col("sender")).alias("from"), F.concat(F.lit("0x"), F.col("digest")).alias("hash"), quantity(F.col("tx_index")).alias("transactionIndex"),
        quantity(kind).alias("type"), quantity(price % 1000).alias("nonce"), quantity(effective_gas_price()).alias("gasPrice"), quantity(F.lit(21_000) + price % 7919).alias("gas"), address(F.col("recipient")).alias("to"), quantity(price * 3).alias("value"),
        F.concat(F.lit("0x"), F.lower(F.hex(F.col("status").cast("binary")))).alias("input"), quantity(signature).alias("v"), _trimmed(F.sha2(F.concat(F.lit("r"), "digest"), 256)).alias("r"), _trimmed(F.sha2(F.concat(F.lit("s"), "digest"), 256)).alias("s"),
        F.when(kind > 0, quantity(price % 2)).alias("yParity"), F.when(kind > 0, F.lit("0x1")).when(price % 80 >= 35, quantity(F.floor((price % 80 - 35) / 2))).alias("chainId"), F.when(kind >= 2, quantity(F.col("tip_cap"))).alias("maxPriorityFeePerGas"),
        F.when(kind >= 2, quantity(price)).alias("maxFeePerGas"), F.when(kind >= 1, access).alias("accessList"), F.when(kind == 3, quantity(F.floor(price / 10))).alias("maxFeePerBlobGas"), F.when(kind == 3, blobs).alias("blobVersionedHashes"),
        F.when(kind == 4, F.concat_ws(":", F.lit("0x1"), address(F.col("sender") + 7), quantity(price % 11))).alias("authorizationList"),
    )


@query(
    "PR09 PR06",
    f"""WITH RECURSIVE forks(since, target, most, fraction) AS (VALUES {", ".join(map(str, fees.SCHEDULE))}),
p AS (SELECT number, excess_blob_gas AS excess, fraction FROM blocks ASOF JOIN forks ON timestamp >= since WHERE excess_blob_gas IS NOT NULL),
{fees._series_sql("p", "excess", "fraction", "paid")}
SELECT t.block, t.tx_index, printf('0x%x', type) AS type, CASE WHEN type = 3 THEN printf('0x%x', (t.price % 6 + 1) * {fees.GAS_PER_BLOB}) END AS blobGasUsed, CASE WHEN type = 3 THEN printf('0x%x', coalesce(paid.price, 0)) END AS blobGasPrice
FROM transactions t LEFT JOIN paid ON paid.number = t.block""",
    "blocks",
)
def receipt_blobs(v):
    """Blob gas and its price in the receipts of type 3."""
    prices = fees.blob_prices(v).select(F.col("number").alias("block"), "blob_fee")
    blob = F.col("type") == 3
    used = (F.col("price") % 6 + 1) * fees.GAS_PER_BLOB
    return v.transactions.join(prices, "block", "left").select("block", "tx_index", quantity(F.col("type")).alias("type"), F.when(blob, quantity(used)).alias("blobGasUsed"), F.when(blob, quantity(F.coalesce("blob_fee", F.lit(0).cast("long")))).alias("blobGasPrice"))
