"""Parsing and rendering, keyed ids, revert reasons, stored traces, forks, budgets and batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from blocklens.functions.hexes import address_word, parse_quantity
from blocklens.functions.network import hmac_sha256
from blocklens.functions.times import bucket
from blocklens.registry import query

#: Fixed selectors of revert data: a reason, a panic code.
REASON, PANIC = "08c379a0", "4e487b71"
KEY = b"network key of the tests"


@query("SF02 FL16", "SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE id END AS parsed FROM (SELECT o_orderkey AS id FROM orders)")
def parsed_quantities(v):
    text = F.concat(F.when(F.col("o_orderkey") % 7 == 0, F.lit("0xg")).when(F.col("o_orderkey") % 2 == 0, F.lit("0x00")).otherwise(F.lit("0X")), F.hex("o_orderkey"))
    return v.table("orders").select(F.col("o_orderkey").alias("id"), parse_quantity(text).alias("parsed"))


@query("SF13", "SELECT hash, rtrim(replace(replace(to_base64(CAST(substr(hash, 1, 20) AS BLOB)), '+', '-'), '/', '_'), '=') AS key FROM transactions", "transactions")
def url_keys(v):
    coded = F.base64(F.substring("hash", 1, 20).cast("binary"))
    return v.transactions.select("hash", F.rtrim(F.translate(coded, "+/", "-_"), F.lit("=")).alias("key"))


_PADS = [bytes(b ^ x for b in KEY.ljust(64, b"\x00")).hex() for x in (0x36, 0x5C)]


@query("SF08", f"SELECT address, sha256(from_hex('{_PADS[1]}') || from_hex(sha256(from_hex('{_PADS[0]}') || CAST(CAST(address AS VARCHAR) AS BLOB)))) AS tag FROM accounts", "accounts")
def keyed_ids(v):
    return v.accounts.select("address", hmac_sha256(KEY, F.col("address").cast("string")).alias("tag"))


@query("SF15", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS reason, CASE WHEN o_orderkey % 3 = 0 THEN 17 END AS panic FROM orders")
def revert_reasons(v):
    word = lambda n: F.lpad(F.hex(n), 64, "0")
    body = F.hex(F.col("o_orderpriority").cast("binary"))
    padded = F.rpad(body, 64, "0")
    data = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(PANIC), word(F.lit(17)))).otherwise(F.concat(F.lit(REASON), word(F.lit(32)), word(F.length("o_orderpriority")), padded))
    rows = v.table("orders").select(F.col("o_orderkey").alias("id"), F.lower(data).alias("d"))
    size = F.conv(F.substring("d", 9 + 64, 64), 16, 10).cast("int")
    reason = F.when(F.startswith("d", F.lit(REASON)), F.decode(F.unhex(F.substr(F.col("d"), F.lit(9 + 128), 2 * size)), "UTF-8"))
    return rows.select("id", reason.alias("reason"), F.when(F.startswith("d", F.lit(PANIC)), F.conv(F.substring("d", 9, 64), 16, 10).cast("int")).alias("panic"))


@query("SF16", "SELECT o_orderkey AS id, '0x' || lpad(printf('%x', o_custkey + 4294967296), 40, '0') AS address FROM orders")
def calldata_addresses(v):
    data = F.concat(F.lit("a9059cbb"), F.lpad(F.lower(F.hex(F.col("o_custkey") + 4_294_967_296)), 64, "0"), F.lpad(F.hex("o_orderkey"), 64, "0"), F.lit("f" * 64))
    words = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.substr(data, i * 64 + 9, F.lit(64)))
    return v.table("orders").select(F.col("o_orderkey").alias("id"), F.explode(words).alias("w")).select("id", address_word(F.col("w")).alias("address")).where("address is not null")


@query("SC24 SF22", "SELECT number, CASE WHEN number >= 100 THEN 'third' WHEN number >= 40 THEN 'second' ELSE 'first' END AS fork FROM blocks", "blocks")
def fork_of_block(v):
    forks = v.spark.createDataFrame([("first", 0, 40), ("second", 40, 100), ("third", 100, 1 << 40)], "fork string, since long, until long")
    return v.blocks.join(F.broadcast(forks), (F.col("number") >= F.col("since")) & (F.col("number") < F.col("until"))).select("number", "fork")  # a row for each fork


@query("SC23 SF14", "SELECT sec // 300 * 300 AS t, account % 3 AS script, count(*) AS requests, CAST(sum(units) AS BIGINT) AS units, max(k) AS peak FROM usage GROUP BY ALL ORDER BY t, script LIMIT 10000", "usage")
def preaggregated_usage(v):
    cube = v.usage.groupBy(bucket(F.col("sec"), 300).alias("t"), (F.col("account") % 3).alias("script")).agg(F.struct(F.count("*").alias("requests"), F.sum("units").alias("units")).alias("sum"), F.struct(F.max("k").alias("peak")).alias("quantiles"))
    return cube.orderBy("t", "script").limit(10_000).select("t", "script", "sum.requests", "sum.units", "quantiles.peak")


@query("SO01 SC15", "SELECT substr(hash, 1, 12) AS prefix, block, tx_index FROM transactions", "transactions")
def sorted_hashes(v):
    rows = v.transactions.select(F.substring("hash", 1, 12).alias("prefix"), "block", "tx_index")
    return rows.repartitionByRange("prefix").sortWithinPartitions("prefix", "block", "tx_index")


@query("EX05 EX06", "WITH f AS (SELECT block, tx_index, row_number() OVER (PARTITION BY block, tx_index ORDER BY line, address, topic1, data, tax, discount, shipped, topic0) - 1 AS i, data FROM raw_logs) SELECT p.block, p.tx_index, p.i, p.data, CAST(floor(log2(p.i + 1)) AS INTEGER) AS depth, count(c.i) AS subtraces FROM f p LEFT JOIN f c ON c.block = p.block AND c.tx_index = p.tx_index AND (c.i - 1) // 2 = p.i AND c.i > 0 GROUP BY ALL", "raw_logs")
def call_frames(v):
    order = Window.partitionBy("block", "tx_index").orderBy("line", "address", "topic1", "data", "tax", "discount", "shipped", "topic0")
    frames = v.raw_logs.withColumn("i", (F.row_number().over(order) - 1).cast("long")).select("block", "tx_index", "i", "data")
    children = frames.where("i > 0").groupBy("block", "tx_index", F.floor((F.col("i") - 1) / 2).alias("i")).agg(F.count("*").alias("n"))
    return frames.join(children, ["block", "tx_index", "i"], "left").select("block", "tx_index", "i", "data", F.floor(F.log2(F.col("i") + 1)).cast("int").alias("depth"), F.coalesce("n", F.lit(0)).alias("subtraces"))


#: Requests a second of a scope.
RATE = 4


def granted(wants, active, rate: int = RATE):
    """What each call of a second gets, in order: at most what it wants and what is left, and of these no more than a
    fair share among the isolates active in the second before, or half of what is left, whichever is larger."""
    state = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast("array<long>").alias("out"))

    def step(s, want):
        left = F.greatest(F.lit(rate) - s["spent"], F.lit(0))
        share = F.greatest(F.ceil(F.lit(rate) / active), F.floor(left / 2))
        got = F.greatest(F.least(want, left, share), F.lit(0)).cast("long")
        return F.struct((s["spent"] + got).alias("spent"), F.concat(s["out"], F.array(got)).alias("out"))

    return F.aggregate(wants, state, step, lambda s: s["out"])


# the view's clock: a minute of the events is a second; scope: kind of event, isolate: account % 5, a call wants k % 4 + 1
@query(
    "WN15",
    f"""WITH RECURSIVE c AS (SELECT method AS scope, sec // 60 AS s, id, account % 5 AS isolate, k % 4 + 1 AS want, row_number() OVER (PARTITION BY method, sec // 60 ORDER BY id) AS i FROM usage),
act AS (SELECT scope, s + 1 AS s, count(DISTINCT isolate) AS active FROM c GROUP BY ALL),
x AS (SELECT c.*, coalesce(active, 1) AS active FROM c LEFT JOIN act ON act.scope = c.scope AND act.s = c.s),
g(scope, s, i, id, tokens, spent) AS (
  SELECT scope, s, i, id, t, t FROM (SELECT x.*, CAST(greatest(0, least(want, {RATE}, greatest(ceil({RATE} / CAST(active AS DOUBLE)), {RATE} // 2))) AS BIGINT) AS t FROM x WHERE i = 1)
  UNION ALL
  SELECT scope, s, i, id, t, spent + t FROM (
    SELECT x.scope, x.s, x.i, x.id, g.spent, CAST(greatest(0, least(want, {RATE} - g.spent, greatest(ceil({RATE} / CAST(active AS DOUBLE)), ({RATE} - g.spent) // 2))) AS BIGINT) AS t
    FROM g JOIN x ON x.scope = g.scope AND x.s = g.s AND x.i = g.i + 1))
SELECT scope, s, id, tokens FROM g""",
    "usage",
)
def shared_budget(v):
    # a group is the calls of one scope in one second
    call = F.struct("id", (F.col("account") % 5).alias("isolate"), (F.col("k") % 4 + 1).alias("want"))
    seconds = v.usage.groupBy(F.col("method").alias("scope"), F.floor(F.col("sec") / 60).alias("s")).agg(F.array_sort(F.collect_list(call)).alias("calls"), F.count_distinct(F.col("account") % 5).alias("isolates"))
    active = seconds.select("scope", (F.col("s") + 1).alias("s"), F.col("isolates").alias("active"))
    met = seconds.join(active, ["scope", "s"], "left").withColumn("tokens", granted(F.transform("calls", lambda c: c["want"]), F.coalesce("active", F.lit(1))))
    return met.select("scope", "s", F.explode(F.arrays_zip("calls", "tokens")).alias("x")).select("scope", "s", "x.calls.id", "x.tokens")


#: A request of several calls, one of them unknown.
CALLS = (("eth_blockNumber",), ("eth_getBlockTransactionCountByNumber", "0x3"), ("eth_unknown",), ("eth_chainId",), ("eth_getUncleCountByBlockNumber", "0x5"))


@query(
    "SO09",
    """SELECT 0 AS ordinal, printf('0x%x', max(number)) AS result, CAST(NULL AS INTEGER) AS code FROM blocks UNION ALL SELECT 1, (SELECT printf('0x%x', count(*)) FROM transactions WHERE block = 3), NULL
UNION ALL SELECT 2, NULL, -32601 UNION ALL SELECT 3, '0x1', NULL UNION ALL SELECT 4, printf('0x%x', count(*)), NULL FROM blocks WHERE number = 5""",
    "blocks",
)
def batched_answers(v):
    """The answers of a batch in the order of its calls, each a result or an error."""
    from blocklens.plans.rpc import Node

    answers = Node(v).batch([{"id": i, "method": method, "params": list(params)} for i, (method, *params) in enumerate(CALLS)])
    rows = [(a["id"], a.get("result"), a["error"]["code"] if "error" in a else None) for a in answers]  # at most 32
    return v.spark.createDataFrame(rows, "ordinal int, result string, code int")


@query("TR07", "SELECT number, hash FROM blocks WHERE number % 9 = 4 AND timestamp > (SELECT max(timestamp) FROM blocks) - 1800", "blocks")
def live_fences(v):
    newest = v.blocks.agg(F.max("timestamp").alias("now"))
    return v.blocks.where("number % 9 = 4").crossJoin(F.broadcast(newest)).where("timestamp > now - 1800").select("number", "hash")  # the right side is one row


#: Blocks of a state layer.
LAYER = 50


def layer_filters(rows):
    """layer, lanes: a Bloom filter of the keys of each layer."""
    from blocklens.operators.logs import blooms

    return blooms(rows.select("layer", F.col("key").cast("string").alias("x")), "layer")


def may_hold(key):
    """True where the filter of a row admits the key: all its bits are set."""
    from blocklens.operators.logs import bloom_bits

    lanes = F.array(*[F.col(f"lane{i}") for i in range(32)])
    return F.forall(bloom_bits(key.cast("string")), lambda bit: F.getbit(F.get(lanes, F.floor(bit / 64).cast("int")), bit % 64) == 1)


@query("FL05 SC16", f"SELECT key, max(block) AS block, count(DISTINCT block // {LAYER}) AS layers FROM state GROUP BY key", "state")
def layer_lookup(v):
    """The newest block and the number of layers of every key, read from the layers whose filter admits it."""
    rows = v.state.select("key", "block", F.floor(F.col("block") / LAYER).alias("layer"))
    asked = rows.select("key").distinct()
    # a row for each layer, at most blocks / LAYER; each meets the keys that its filter admits
    admitted = asked.join(layer_filters(rows), may_hold(F.col("key"))).select("key", "layer")
    return rows.join(admitted, ["key", "layer"]).groupBy("key").agg(F.max("block").alias("block"), F.count_distinct("layer").alias("layers"))


@query(
    "TR14",
    """WITH e AS (SELECT account, id, method = 'error' AS failed, count(*) FILTER (WHERE method <> 'error') OVER (PARTITION BY account ORDER BY id ROWS UNBOUNDED PRECEDING) AS run FROM usage)
SELECT account, id, row_number() OVER (PARTITION BY account, run ORDER BY id) AS failures, least(300, CAST(pow(2, least(row_number() OVER (PARTITION BY account, run ORDER BY id), 8)) AS BIGINT)) AS wait FROM e WHERE failed""",
    "usage",
)
def retry_waits(v):
    """Waits after failures in a row of an account: two to the number of failures, at most 2^8 and five minutes."""
    order = Window.partitionBy("account").orderBy("id")
    run = F.count_if(F.col("method") != "error").over(order.rowsBetween(Window.unboundedPreceding, 0))
    failed = v.usage.select("account", "id", "method", run.alias("run")).where("method = 'error'")
    failures = F.row_number().over(Window.partitionBy("account", "run").orderBy("id"))
    return failed.select("account", "id", failures.cast("long").alias("failures")).withColumn("wait", F.least(F.lit(300), F.pow(F.lit(2), F.least("failures", F.lit(8))).cast("long")))
