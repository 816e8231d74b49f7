"""Chain-shaped views over the star-schema tables: pure expressions, the same in Spark and in DuckDB SQL.

Block n holds the orders 100 n to 100 n + 99 (block 0 those from -99 on, and blocks below it 100 n - 99 to 100 n, as //
in DuckDB cuts towards zero); an order is a transaction, its lines are the logs, the events are state changes, usage and
samples, customers are accounts. No view shuffles more than its own key needs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_TXS = 100
GAS_LIMIT = 5_000_000
GENESIS_TIME = 1_600_000_000
SLOT = 12
#: Blocks whose link to the parent is broken in the view, so that continuity checks find something.
BROKEN_EVERY = 97
FIRST_BLOB_BLOCK = 20
BLOB_GAS = 131_072
#: Tables that are laid out by block, and their keys.
BLOCK_KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey"}


def epoch_seconds(ts: str) -> Column:
    """Whole seconds of a timestamp without zone; independent of the session's zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def cents(x: str) -> Column:
    return F.round(F.col(x) * 100).cast("long")


def block_of(key: str) -> Column:
    """The block of an order key in whole numbers: doubles would merge blocks beyond 2^53."""
    return F.expr(f"{key} div {BLOCK_TXS}")


class Views:
    """Lazy frames of one data set; every property is a plan, nothing is read before an action."""

    def __init__(self, spark: SparkSession, sf_dir: str, span: tuple[int, int] | None = None):
        self.spark, self.sf_dir, self.span = spark, sf_dir, span

    def between(self, first: int, last: int) -> Views:
        """The same views of the blocks first..last alone. The range is one of keys, which scans can prune by."""
        return Views(self.spark, self.sf_dir, (first, last))

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if self.span and name in BLOCK_KEYS:
            first, last = self.span
            low = first * BLOCK_TXS - (BLOCK_TXS - 1 if first <= 0 else 0)
            high = last * BLOCK_TXS + (BLOCK_TXS - 1 if last >= 0 else 0)
            df = df.where(F.col(BLOCK_KEYS[name]).between(low, high))
        return df

    @cached_property
    def transactions(self) -> DataFrame:
        """block, tx_index, hash, type, sender, recipient, price, tip_cap, status."""
        key = F.col("o_orderkey")
        kind = (F.col("o_custkey") % 5).cast("int")
        return self.table("orders").select(
            block_of("o_orderkey").alias("block"),
            (key % BLOCK_TXS).cast("int").alias("tx_index"),
            F.sha2(key.cast("string"), 256).alias("hash"),
            kind.alias("type"),
            F.col("o_custkey").alias("sender"),
            F.when(key % 50 != 0, (F.col("o_custkey") * 7 + 3) % 1000).alias("recipient"),
            cents("o_totalprice").alias("price"),
            (cents("o_totalprice") % 1000).alias("tip_cap"),
            F.col("o_orderstatus").alias("status"),
        )

    @cached_property
    def gas(self) -> DataFrame:
        """block, tx_index, gas of every transaction with lines."""
        return (
            self.table("lineitem")
            .groupBy("l_orderkey")
            .agg((F.lit(100) * F.sum(F.col("l_quantity").cast("long"))).alias("extra"))
            .select(block_of("l_orderkey").alias("block"), (F.col("l_orderkey") % BLOCK_TXS).cast("int").alias("tx_index"), "extra")
        )

    @cached_property
    def receipts(self) -> DataFrame:
        """transactions with cumulative_gas, as a receipt stores it."""
        gas = F.lit(21000) + F.coalesce("extra", F.lit(0))
        running = Window.partitionBy("block").orderBy("tx_index").rowsBetween(Window.unboundedPreceding, 0)
        return self.transactions.join(self.gas, ["block", "tx_index"], "left").withColumn("cumulative_gas", F.sum(gas).over(running)).drop("extra")

    @cached_property
    def blocks(self) -> DataFrame:
        """number, hash, parent_hash, miner, timestamp, gas_limit, gas_used, base_fee, blob fields."""
        n = F.col("number")
        name = lambda x: F.sha2(F.concat(F.lit("block"), x.cast("string")), 256)
        blob = n >= FIRST_BLOB_BLOCK
        return (
            self.receipts.groupBy(F.col("block").alias("number"))
            .agg(F.max("cumulative_gas").alias("gas_used"))
            .select(
                "number",
                name(n).alias("hash"),
                F.when(n % BROKEN_EVERY != BROKEN_EVERY - 1, name(n - 1)).otherwise(F.sha2(F.lit("broken"), 256)).alias("parent_hash"),
                (n * 31 % 500).alias("miner"),
                (n * SLOT + GENESIS_TIME).alias("timestamp"),
                F.lit(GAS_LIMIT).cast("long").alias("gas_limit"),
                "gas_used",
                (F.lit(10_000_000) + n * 7919 % 1_000_000).cast("long").alias("base_fee"),
                F.when(blob, n % 7 * BLOB_GAS).cast("long").alias("blob_gas_used"),
                F.when(blob, n * BLOB_GAS % 50_000_000).cast("long").alias("excess_blob_gas"),
            )
        )

    @cached_property
    def raw_logs(self) -> DataFrame:
        """block, tx_index, address, topic0..topic2, data (topic2 is missing where the line is open)."""
        return self.table("lineitem").select(
            block_of("l_orderkey").alias("block"),
            (F.col("l_orderkey") % BLOCK_TXS).cast("int").alias("tx_index"),
            F.col("l_suppkey").alias("address"),
            F.col("l_returnflag").alias("topic0"),
            F.col("l_partkey").alias("topic1"),
            F.when(F.col("l_linestatus") == "F", F.col("l_linenumber").cast("long")).alias("topic2"),
            cents("l_extendedprice").alias("data"),
            F.col("l_linenumber").alias("line"),
            cents("l_tax").alias("tax"),
            cents("l_discount").alias("discount"),
            F.col("l_shipdate").alias("shipped"),
        )

    @cached_property
    def logs(self) -> DataFrame:
        """block, tx_index, log_index (running over the block), address, topics, data."""
        return numbered_logs(self.raw_logs)

    @cached_property
    def frames(self) -> DataFrame:
        """number, body, size, digest: stored frames of transaction hashes; a few are cut or altered after they were signed."""
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("tx_index", "hash"))), lambda x: x["hash"])
        whole = self.transactions.groupBy(F.col("block").alias("number")).agg(F.array_join(ordered, "").alias("sent"))
        n = F.col("number")
        body = F.when(n % 53 == 7, F.expr("left(sent, length(sent) - 1)")).when(n % 41 == 3, F.concat(F.lit("!"), F.expr("substring(sent, 2)"))).otherwise(F.col("sent"))
        return whole.select("number", body.alias("body"), F.length("sent").cast("long").alias("size"), F.sha2("sent", 256).alias("digest"))

    @cached_property
    def changes(self) -> DataFrame:
        """tx_num, key, block, value: a change stream in transaction order; null value: cleared."""
        events = self.table("events").select("event_id", "user_id", "event_type", "value", epoch_seconds("ts").alias("s"))
        start = events.agg(F.floor(F.min("s") / 3600).alias("h0"))
        return events.crossJoin(F.broadcast(start)).select(  # start is one row
            F.col("event_id").alias("tx_num"),
            F.col("user_id").alias("key"),
            (F.floor(F.col("s") / 3600) - F.col("h0")).cast("long").alias("block"),
            F.when(F.col("event_type") != "error", cents("value")).alias("value"),
            F.col("event_type").alias("kind"),
        )

    @cached_property
    def state(self) -> DataFrame:
        """key, block, value: the last change of each key in each block."""
        last = F.max_by(F.struct("value"), "tx_num")["value"]
        return self.changes.groupBy("key", "block").agg(last.alias("value"))

    @cached_property
    def usage(self) -> DataFrame:
        """id, account, hour, method, sec (epoch seconds), units: metered calls."""
        price = F.when(F.col("event_type") == "view", 10).when(F.col("event_type") == "click", 15).when(F.col("event_type") == "purchase", 50).when(F.col("event_type") == "signup", 20).otherwise(5)
        return self.table("events").select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("account"),
            F.floor(epoch_seconds("ts") / 3600).cast("long").alias("hour"),
            F.col("event_type").alias("method"),
            epoch_seconds("ts").alias("sec"),
            price.cast("long").alias("units"),
            F.col("value").alias("ms"),
            F.get_json_object("props", "$.k").cast("long").alias("k"),
        )

    @cached_property
    def accounts(self) -> DataFrame:
        """address, plan, net, period_units, period_end (ms), created_day, suspended, wallet_check."""
        key = F.col("c_custkey")
        plan = F.when(key % 23 == 0, F.lit("internal")).otherwise(F.element_at(F.array(*[F.lit(x) for x in ("free", "unverified", "builder", "growth", "scale")]), (key % 5 + 1).cast("int")))
        return self.table("customer").select(
            key.alias("address"),
            plan.alias("plan"),
            F.when(key % 11 != 0, F.col("c_nationkey").cast("long")).alias("net"),
            (F.greatest(cents("c_acctbal"), F.lit(0)) * 40).alias("period_units"),
            (F.lit(1_700_000_000_000) + key % 60 * 86_400_000).cast("long").alias("period_end"),
            (F.lit(20240101) + key % 28).cast("long").alias("created_day"),
            (key % 17 == 0).alias("suspended"),
            F.when(key % 3 != 0, F.col("c_mktsegment")).alias("wallet_check"),
        )

    @cached_property
    def api_keys(self) -> DataFrame:
        """id, address, revoked: one to three keys of each account."""
        n = F.col("c_custkey") % 3
        return self.table("customer").select(
            F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("i"), F.col("c_custkey").alias("address")
        ).select((F.col("address") * 10 + F.col("i")).alias("id"), "address", ((F.col("address") + F.col("i")) % 7 == 0).alias("revoked"))

    @cached_property
    def invoices(self) -> DataFrame:
        """id, address, status, usd_cents, months, created_at (ms)."""
        key = F.col("o_orderkey")
        status = F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
        months = F.element_at(F.array(F.lit(1), F.lit(6), F.lit(12)), (key % 3 + 1).cast("int"))
        return self.table("orders").select(key.alias("id"), F.col("o_custkey").alias("address"), status.alias("status"), cents("o_totalprice").alias("usd_cents"), months.cast("long").alias("months"), (epoch_seconds("o_orderdate") * 1000).alias("created_at"))


def numbered_logs(raw_logs: DataFrame) -> DataFrame:
    """raw_logs of whole blocks with the running number of each log in its block."""
    order = Window.partitionBy("block").orderBy("tx_index", "line", "address", "topic1", "data", "tax", "discount", "shipped", "topic0")
    return raw_logs.withColumn("log_index", (F.row_number().over(order) - 1).cast("int")).select("block", "tx_index", "log_index", "address", "topic0", "topic1", "topic2", "data")


#: name -> (views it reads, SQL)
VIEW_SQL = {
    "transactions": (
        "",
        f"""SELECT CAST(o_orderkey // {BLOCK_TXS} AS BIGINT) AS block, CAST(o_orderkey % {BLOCK_TXS} AS INTEGER) AS tx_index, sha256(CAST(o_orderkey AS VARCHAR)) AS hash,
  CAST(o_custkey % 5 AS INTEGER) AS type, o_custkey AS sender, CASE WHEN o_orderkey % 50 <> 0 THEN (o_custkey * 7 + 3) % 1000 END AS recipient,
  CAST(round(o_totalprice * 100) AS BIGINT) AS price, CAST(round(o_totalprice * 100) AS BIGINT) % 1000 AS tip_cap, o_orderstatus AS status FROM orders""",
    ),
    "receipts": (
        "transactions",
        """SELECT t.*, CAST(sum(21000 + coalesce(g.extra, 0)) OVER (PARTITION BY t.block ORDER BY t.tx_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_gas
FROM transactions t LEFT JOIN (SELECT l_orderkey // 100 AS block, l_orderkey % 100 AS tx_index, 100 * sum(CAST(l_quantity AS BIGINT)) AS extra FROM lineitem GROUP BY ALL) g ON t.block = g.block AND t.tx_index = g.tx_index""",
    ),
    "blocks": (
        "receipts",
        f"""SELECT number, sha256('block' || CAST(number AS VARCHAR)) AS hash,
  CASE WHEN number % {BROKEN_EVERY} <> {BROKEN_EVERY - 1} THEN sha256('block' || CAST(number - 1 AS VARCHAR)) ELSE sha256('broken') END AS parent_hash,
  number * 31 % 500 AS miner, number * {SLOT} + {GENESIS_TIME} AS timestamp, CAST({GAS_LIMIT} AS BIGINT) AS gas_limit, gas_used, CAST(10000000 + number * 7919 % 1000000 AS BIGINT) AS base_fee,
  CASE WHEN number >= {FIRST_BLOB_BLOCK} THEN number % 7 * {BLOB_GAS} END AS blob_gas_used, CASE WHEN number >= {FIRST_BLOB_BLOCK} THEN number * {BLOB_GAS} % 50000000 END AS excess_blob_gas
FROM (SELECT block AS number, max(cumulative_gas) AS gas_used FROM receipts GROUP BY block)""",
    ),
    "raw_logs": (
        "",
        """SELECT CAST(l_orderkey // 100 AS BIGINT) AS block, CAST(l_orderkey % 100 AS INTEGER) AS tx_index, l_suppkey AS address, l_returnflag AS topic0, l_partkey AS topic1,
  CASE WHEN l_linestatus = 'F' THEN CAST(l_linenumber AS BIGINT) END AS topic2, CAST(round(l_extendedprice * 100) AS BIGINT) AS data, l_linenumber AS line,
  CAST(round(l_tax * 100) AS BIGINT) AS tax, CAST(round(l_discount * 100) AS BIGINT) AS discount, l_shipdate AS shipped FROM lineitem""",
    ),
    "logs": (
        "raw_logs",
        """SELECT block, tx_index, CAST(row_number() OVER (PARTITION BY block ORDER BY tx_index, line, address, topic1, data, tax, discount, shipped, topic0) - 1 AS INTEGER) AS log_index,
  address, topic0, topic1, topic2, data FROM raw_logs""",
    ),
    "frames": (
        "transactions",
        """SELECT number, CASE WHEN number % 53 = 7 THEN left(sent, length(sent) - 1) WHEN number % 41 = 3 THEN '!' || substr(sent, 2) ELSE sent END AS body, length(sent) AS size, sha256(sent) AS digest
FROM (SELECT block AS number, string_agg(hash, '' ORDER BY tx_index) AS sent FROM transactions GROUP BY block)""",
    ),
    "changes": (
        "",
        """SELECT event_id AS tx_num, user_id AS key, CAST(floor(epoch(ts) / 3600) - (SELECT floor(epoch(min(ts)) / 3600) FROM events) AS BIGINT) AS block,
  CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END AS value, event_type AS kind FROM events""",
    ),
    "state": ("changes", """SELECT key, block, value FROM (SELECT *, row_number() OVER (PARTITION BY key, block ORDER BY tx_num DESC) AS rn FROM changes) WHERE rn = 1"""),
    "usage": (
        "",
        """SELECT event_id AS id, user_id AS account, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, event_type AS method, CAST(floor(epoch(ts)) AS BIGINT) AS sec,
  CAST(CASE event_type WHEN 'view' THEN 10 WHEN 'click' THEN 15 WHEN 'purchase' THEN 50 WHEN 'signup' THEN 20 ELSE 5 END AS BIGINT) AS units, value AS ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    ),
    "accounts": (
        "",
        """SELECT c_custkey AS address, CASE WHEN c_custkey % 23 = 0 THEN 'internal' ELSE CASE c_custkey % 5 WHEN 0 THEN 'free' WHEN 1 THEN 'unverified' WHEN 2 THEN 'builder' WHEN 3 THEN 'growth' ELSE 'scale' END END AS plan,
  CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS net, greatest(CAST(round(c_acctbal * 100) AS BIGINT), 0) * 40 AS period_units, CAST(1700000000000 + c_custkey % 60 * 86400000 AS BIGINT) AS period_end, CAST(20240101 + c_custkey % 28 AS BIGINT) AS created_day,
  c_custkey % 17 = 0 AS suspended, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS wallet_check FROM customer""",
    ),
    "api_keys": ("", """SELECT c_custkey * 10 + i AS id, c_custkey AS address, (c_custkey + i) % 7 = 0 AS revoked FROM (SELECT c_custkey, unnest(range(0, c_custkey % 3 + 1)) AS i FROM customer)"""),
    "invoices": (
        "",
        """SELECT o_orderkey AS id, o_custkey AS address, CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS usd_cents,
  CAST(CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 6 ELSE 12 END AS BIGINT) AS months, CAST(floor(epoch(o_orderdate)) AS BIGINT) * 1000 AS created_at FROM orders""",
    ),
}


def with_views(body: str, names: list[str]) -> str:
    """body after a WITH clause of the named views and those they read."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for x in VIEW_SQL[name][0].split():
            need(x)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        need(name)
    body = body.strip()
    if not ordered:
        return body
    head = ",\n".join(f"{n} AS ({VIEW_SQL[n][1]})" for n in ordered)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    return f"WITH {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"
