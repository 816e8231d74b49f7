"""Metering, quotas, leases, invoices and the daily anomaly report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blocklens.functions import metering as M
from blocklens.functions.network import ipv4_network, ipv6_network
from blocklens.functions.times import duration_ms, utc_day, utc_month
from blocklens.registry import query
from blocklens.sources.chainview import block_of

# Fixed thresholds of the report.
OVER_QUOTA, NETWORK_ACCOUNTS, NETWORK_KEYS, KEY_NETWORKS, AUTO_SUSPEND = 1.0, 5, 10, 20, 20


def upsert(current: DataFrame, increments: DataFrame, key: list[str], value: str, cap: int | None = None) -> DataFrame:
    """Totals after adding increments per key; a key at its cap takes no more. Map-side combined, so hot keys are cheap."""
    added = current.select(*key, value).unionByName(increments.select(*key, value)).groupBy(*key).agg(F.sum(value).alias(value))
    return added if cap is None else added.withColumn(value, F.least(value, F.lit(cap)))


@query("AG01 SF40", "SELECT hour, CAST(sum(units) AS BIGINT) AS units, count(*) AS requests FROM usage GROUP BY hour", "usage")
def usage_hourly(v):
    return v.usage.groupBy("hour").agg(F.sum("units").alias("units"), F.count("*").alias("requests"))


@query("SF25 AG01", "SELECT account, method, count(*) AS calls, CAST(sum(CASE WHEN k % 17 = 0 THEN 5 WHEN method = 'view' THEN CASE WHEN k * 150 > 10000 THEN 50 ELSE 50 + CAST(ceil(greatest(k * 150 - 1000, 0) / 1000.0) AS BIGINT) * 5 END WHEN method = 'click' THEN 30 WHEN method = 'purchase' THEN 40 WHEN method = 'signup' THEN 80 ELSE 20 END) AS BIGINT) AS credits FROM usage GROUP BY account, method", "usage")
def usage_credits(v):
    names = F.when(F.col("method") == "view", "eth_getLogs").when(F.col("method") == "click", "eth_call").when(F.col("method") == "purchase", "trace_block").when(F.col("method") == "signup", "trace_replayTransaction").otherwise("unlisted_method")
    calls = v.usage.select("account", F.col("method").alias("event"), names.alias("method"), (F.col("k") * 150).alias("blocks"), F.when(F.col("k") % 17 == 0, -32601).alias("error"))
    return M.credits(calls).groupBy("account", F.col("event").alias("method")).agg(F.count("*").alias("calls"), F.sum("credits").alias("credits"))


@query("AG08 TR17", "SELECT account, hour // 24 AS day, CAST(least(sum(units), 200) AS BIGINT) AS units FROM usage GROUP BY account, hour // 24", "usage")
def usage_upsert(v):
    rows = v.usage.select("account", F.floor(F.col("hour") / 24).alias("day"), "units")
    return upsert(rows.where("units < 20"), rows.where("units >= 20"), ["account", "day"], "units", cap=200)


@query("AG09", "SELECT account, id, CAST(greatest(t - lag(t, 1, 0) OVER (PARTITION BY account ORDER BY id), 0) AS BIGINT) AS units FROM (SELECT account, id, max(units * (k + 1)) OVER (PARTITION BY account ORDER BY id ROWS UNBOUNDED PRECEDING) AS t FROM usage)", "usage")
def report_deltas(v):
    order = Window.partitionBy("account").orderBy("id")
    totals = v.usage.withColumn("t", F.max(F.col("units") * (F.col("k") + 1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return totals.select("account", "id", F.greatest(F.col("t") - F.lag("t", 1, 0).over(order), F.lit(0)).alias("units"))


#: The time of the report, in the middle of the view's periods.
_NOW = 1_702_500_000_000
_INCLUDED = "CASE plan WHEN 'public' THEN 10000000 WHEN 'free' THEN 20000000 WHEN 'unverified' THEN 0 WHEN 'builder' THEN 600000000 WHEN 'growth' THEN 3000000000 WHEN 'scale' THEN 20000000000 ELSE 20000000 END"


@query("FL10 SO02", f"SELECT address, plan, period_units AS used, CAST({_INCLUDED} AS BIGINT) AS included, CASE WHEN {_INCLUDED} > 0 THEN round(CAST(period_units AS DOUBLE) / {_INCLUDED}, 4) END AS ratio, suspended FROM accounts WHERE plan <> 'internal' AND period_end > {_NOW} AND period_units > {_INCLUDED} ORDER BY period_units DESC, address LIMIT 100", "accounts")
def over_quota(v):
    included = M.plan_value(F.col("plan"), 1)
    ratio = F.when(included > 0, F.round(F.col("period_units").cast("double") / included, 4))
    due = (F.col("plan") != "internal") & (F.col("period_end") > _NOW)
    return v.accounts.where(due & (F.col("period_units") > OVER_QUOTA * included)).select("address", "plan", F.col("period_units").alias("used"), included.alias("included"), ratio.alias("ratio"), "suspended").orderBy(F.col("used").desc(), "address").limit(100)


@query(
    "AG02 AG03 AG07 JN06",
    "SELECT net, count(*) AS accounts, count(*) FILTER (WHERE plan = 'free') AS free, count(*) FILTER (WHERE plan = 'unverified') AS unverified, count(*) FILTER (WHERE suspended) AS suspended, CAST(sum(coalesce(k.n, 0)) AS BIGINT) AS keys, min(created_day) AS first_at, max(created_day) AS last_at FROM accounts a LEFT JOIN (SELECT address, count(*) AS n FROM api_keys WHERE NOT revoked GROUP BY address) k ON a.address = k.address WHERE net IS NOT NULL GROUP BY net HAVING count(*) > 5 OR sum(coalesce(k.n, 0)) > 10 ORDER BY accounts DESC, net LIMIT 100",
    "accounts api_keys",
)
def crowded_networks(v):
    keys = v.api_keys.where("not revoked").groupBy("address").agg(F.count("*").alias("n"))
    per_net = v.accounts.where("net is not null").join(keys, "address", "left").groupBy("net").agg(
        F.count("*").alias("accounts"), F.count_if(F.col("plan") == "free").alias("free"), F.count_if(F.col("plan") == "unverified").alias("unverified"), F.count_if("suspended").alias("suspended"),
        F.sum(F.coalesce("n", F.lit(0))).alias("keys"), F.min("created_day").alias("first_at"), F.max("created_day").alias("last_at"),
    )
    return per_net.where((F.col("accounts") > NETWORK_ACCOUNTS) | (F.col("keys") > NETWORK_KEYS)).orderBy(F.col("accounts").desc(), "net").limit(100)


@query(
    "JN03 AG04 FL12 SF10",
    "WITH l AS (SELECT o_orderkey AS lease_id, CASE WHEN o_orderkey % 4 <> 0 THEN 'key:' ELSE 'net:' END || CAST(o_custkey * 10 AS VARCHAR) AS subject FROM orders), t AS (SELECT l_orderkey AS lease_id, 'net:' || CAST(l_suppkey AS VARCHAR) AS target FROM lineitem WHERE l_returnflag <> 'N') SELECT substr(l.subject, 5) AS key_id, k.address, count(DISTINCT t.target) AS networks FROM l JOIN t ON l.lease_id = t.lease_id LEFT JOIN api_keys k ON CAST(k.id AS VARCHAR) = substr(l.subject, 5) WHERE l.subject LIKE 'key:%' AND t.target LIKE 'net:%' GROUP BY substr(l.subject, 5), k.address HAVING count(DISTINCT t.target) > 20",
    "api_keys",
)
def keys_many_networks(v):
    kind = F.when(F.col("o_orderkey") % 4 != 0, F.lit("key:")).otherwise(F.lit("net:"))
    leases = v.table("orders").select(F.col("o_orderkey").alias("lease_id"), F.concat(kind, (F.col("o_custkey") * 10).cast("string")).alias("subject")).where(F.col("subject").like("key:%"))
    goals = v.table("lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("lease_id"), F.concat(F.lit("net:"), F.col("l_suppkey").cast("string")).alias("target")).where(F.col("target").like("net:%"))
    counted = leases.join(goals, "lease_id").groupBy(F.substring("subject", 5, 100).alias("key_id")).agg(F.countDistinct("target").alias("networks")).where(F.col("networks") > KEY_NETWORKS)
    return counted.join(v.api_keys.select(F.col("id").cast("string").alias("key_id"), "address"), "key_id", "left").select("key_id", "address", "networks")


@query("JN04", "SELECT address, plan FROM accounts a WHERE NOT EXISTS (SELECT 1 FROM invoices i WHERE i.address = a.address AND i.status = 'paid')", "accounts invoices")
def never_paid(v):
    return v.accounts.select("address", "plan").join(v.invoices.where("status = 'paid'"), "address", "left_anti")


@query("JN05", "SELECT address, plan FROM accounts WHERE address IN (SELECT address FROM api_keys WHERE NOT revoked)", "accounts api_keys")
def accounts_with_keys(v):
    return v.accounts.select("address", "plan").join(v.api_keys.where("not revoked"), "address", "left_semi")


@query("JN01", "SELECT k.id, k.address, a.plan, k.revoked, a.suspended FROM api_keys k JOIN accounts a ON k.address = a.address", "accounts api_keys")
def key_states(v):
    return v.api_keys.join(v.accounts, "address").select("id", "address", "plan", "revoked", "suspended")


@query("JN02", "SELECT DISTINCT address FROM api_keys WHERE id IN (11, 12, 50, 77, 110, 111, 205)", "api_keys")
def key_owners(v):
    return v.api_keys.where(F.col("id").isin(11, 12, 50, 77, 110, 111, 205)).select("address").distinct()


@query("AG06", "SELECT coalesce(wallet_check, 'legacy') AS check_result, count(*) AS accounts FROM accounts WHERE created_day >= 20240110 GROUP BY 1", "accounts")
def wallet_checks(v):
    return v.accounts.where("created_day >= 20240110").groupBy(F.coalesce("wallet_check", F.lit("legacy")).alias("check_result")).agg(F.count("*").alias("accounts"))


@query("AG08 SO02", "SELECT created_day AS day, net, count(*) AS accounts, count(*) FILTER (WHERE plan = 'free') AS free FROM accounts WHERE net IS NOT NULL AND created_day >= 20240120 GROUP BY ALL ORDER BY accounts DESC, day DESC, net LIMIT 50", "accounts")
def signup_networks(v):
    days = v.accounts.where("net is not null and created_day >= 20240120").groupBy(F.col("created_day").alias("day"), "net").agg(F.count("*").alias("accounts"), F.count_if(F.col("plan") == "free").alias("free"))
    return days.orderBy(F.col("accounts").desc(), F.col("day").desc(), "net").limit(50)


@query("AG05", "SELECT count(*) AS networks, CAST(coalesce(sum(units), 0) AS BIGINT) AS units FROM usage WHERE hour < 0", "usage")
def keyless_totals(v):
    return v.usage.where("hour < 0").agg(F.count("*").alias("networks"), F.coalesce(F.sum("units"), F.lit(0)).alias("units"))


@query("FL13 SF44 SO06", "SELECT id, address, usd_cents, created_at FROM invoices WHERE status = 'pending' AND created_at < 1000000000000 ORDER BY created_at, id LIMIT 100", "invoices")
def pending_payments(v):
    return v.invoices.where("status = 'pending' and created_at < 1000000000000").select("id", "address", "usd_cents", "created_at").orderBy("created_at", "id").limit(100)


@query("AG20", "SELECT count(*) FILTER (WHERE status = 'pending') AS pending, CAST(sum(usd_cents) FILTER (WHERE status = 'pending') AS BIGINT) AS cents, count(*) FILTER (WHERE status = 'pending' AND created_at < 900000000000) AS overdue FROM invoices", "invoices")
def refund_totals(v):
    open_ = F.col("status") == "pending"
    return v.invoices.agg(F.count_if(open_).alias("pending"), F.sum(F.when(open_, F.col("usd_cents"))).alias("cents"), F.count_if(open_ & (F.col("created_at") < 900_000_000_000)).alias("overdue"))


@query("AG35 SF28", "SELECT id, CAST((CAST(usd_cents AS HUGEINT) * unused) // bought AS BIGINT) AS refund_cents FROM (SELECT id, usd_cents, months * 2592000000 AS bought, greatest(0, least(months * 2592000000, created_at + months * 2592000000 - 915000000000)) AS unused FROM invoices WHERE status = 'paid')", "invoices")
def refund_proration(v):
    bought = F.col("months") * M.PERIOD_MS
    unused = F.greatest(F.lit(0), F.least(bought, F.col("created_at") + bought - 915_000_000_000))
    return v.invoices.where("status = 'paid'").select("id", M.prorated(F.col("usd_cents"), unused, bought).alias("refund_cents"))


@query("AG34 SF11", "SELECT id, printf('NR-%06d', row_number() OVER (ORDER BY created_at, id)) AS number FROM invoices WHERE status = 'paid'", "invoices")
def invoice_numbers(v):
    from blocklens.operators.windows import running_total

    # the day's numbers start after those of all days before
    day = F.floor(F.col("created_at") / 86_400_000)
    paid = v.invoices.where("status = 'paid'").withColumn("day", day)
    before = running_total(paid.groupBy("day").agg(F.count("*").alias("n")), "day", "n", "before").select("day", "before")
    rank = F.row_number().over(Window.partitionBy("day").orderBy("created_at", "id"))
    return paid.withColumn("rank", rank).join(before, "day").select("id", F.format_string("NR-%06d", F.col("before") + F.col("rank")).alias("number"))


@query("PR21 FL11 SF54 SF14", "SELECT address, plan, CAST(period_units AS DOUBLE) / 100 AS usd, wallet_check AS segment FROM accounts WHERE plan LIKE '%r%' AND lower(coalesce(wallet_check, '')) LIKE '%ma%' ORDER BY address LIMIT 200", "accounts")
def account_listing(v):
    billing = v.accounts.withColumn("billing", F.to_json(F.struct("plan", F.col("wallet_check").alias("segment"))))
    read = billing.withColumn("segment", F.get_json_object("billing", "$.segment"))
    return read.where(F.contains("plan", F.lit("r")) & F.contains(F.lower(F.coalesce("segment", F.lit(""))), F.lit("ma"))).select("address", "plan", (F.col("period_units").cast("double") / 100).alias("usd"), "segment").orderBy("address").limit(200)


@query("TR16", "SELECT target, CAST(sum(used) AS BIGINT) AS used, CAST(sum(reserved) AS BIGINT) AS reserved, sum(used) + sum(reserved) <= 60000 AS holds FROM (SELECT l_suppkey % 40 AS target, CAST(l_quantity AS BIGINT) AS used, CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) // 4 ELSE 0 END AS reserved FROM lineitem) GROUP BY target")
def lease_invariant(v):
    q = F.col("l_quantity").cast("long")
    rows = v.table("lineitem").select((F.col("l_suppkey") % 40).alias("target"), q.alias("used"), F.when(F.col("l_returnflag") == "N", F.floor(q / 4)).otherwise(F.lit(0)).alias("reserved"))
    return rows.groupBy("target").agg(F.sum("used").alias("used"), F.sum("reserved").alias("reserved")).withColumn("holds", F.col("used") + F.col("reserved") <= 60_000)


@query("SF26", "SELECT plan, months, CAST(floor(cents * months * CASE months WHEN 6 THEN 0.9::DOUBLE WHEN 12 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END + 0.5) AS BIGINT) AS net, CAST(floor(floor(cents * months * CASE months WHEN 6 THEN 0.9::DOUBLE WHEN 12 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END + 0.5) * 16 / 100::DOUBLE + 0.5) AS BIGINT) AS tax FROM (SELECT * FROM (VALUES ('builder', 1900), ('growth', 8900), ('scale', 59900)) p(plan, cents), (VALUES (1), (6), (12)) m(months))")
def plan_prices(v):
    rows = v.spark.createDataFrame([(n, r[0], m) for n, r in M.PLANS.items() if r[0] for m in M.DISCOUNTS], "plan string, cents long, months int")
    net = M.term_price(F.col("cents"), F.col("months"))
    return rows.select("plan", "months", net.alias("net"), M.tax_cents(net, F.lit(16)).alias("tax"))


@query("SF27", f"SELECT address, period_units >= {_INCLUDED} AS exhausted, CAST(CASE WHEN 5000000000 < e THEN e ELSE e + ((5000000000 - e) // 2592000000 + 1) * 2592000000 END AS BIGINT) AS period_end FROM (SELECT *, address * 10000000 AS e FROM accounts)", "accounts")
def usage_periods(v):
    end = F.col("address") * 10_000_000
    return v.accounts.select("address", (F.col("period_units") >= M.plan_value(F.col("plan"), 1)).alias("exhausted"), M.period_end(end, F.lit(5_000_000_000)).alias("period_end"))


@query("SF29", "SELECT id, usd_cents * 10000 AS units FROM invoices", "invoices")
def token_amounts(v):
    return v.invoices.select("id", M.token_units(F.col("usd_cents")).alias("units"))


#: A price of an ether in cents, with eight decimals of a dollar (test value).
ETHER_PRICE = 3_123_45678901


@query("SF29", f"SELECT id, CAST((CAST(usd_cents AS HUGEINT) * 1000000000000 + {ETHER_PRICE} - 1) // {ETHER_PRICE} AS BIGINT) AS units FROM invoices", "invoices")
def ether_amounts(v):
    """Cents in ether at a price of eight decimals, in units of 10^12 wei, rounded up."""
    return v.invoices.select("id", F.expr(f"(cast(usd_cents as decimal(20, 0)) * 1000000000000 + {ETHER_PRICE - 1}) div {ETHER_PRICE}").alias("units"))


@query("JN22", "SELECT i.id, CAST(coalesce(sum(l.data), 0) AS BIGINT) AS received, coalesce(sum(l.data), 0) >= i.usd_cents // 4 AS enough FROM invoices i LEFT JOIN raw_logs l ON l.block = i.id // 100 AND l.tx_index = i.id % 100 AND l.topic0 <> 'N' WHERE i.status = 'pending' GROUP BY i.id, i.usd_cents", "invoices raw_logs")
def payment_verification(v):
    received = v.raw_logs.where("topic0 <> 'N'").groupBy("block", "tx_index").agg(F.sum("data").alias("s"))
    asked = v.invoices.where("status = 'pending'").select("id", "usd_cents", block_of("id").alias("block"), (F.col("id") % 100).cast("int").alias("tx_index"))
    got = F.coalesce("s", F.lit(0))
    return asked.join(received, ["block", "tx_index"], "left").select("id", got.alias("received"), (got >= F.floor(F.col("usd_cents") / 4)).alias("enough"))


@query("TR18 JN04", "SELECT a.address, a.net FROM accounts a JOIN (SELECT net FROM accounts WHERE net IS NOT NULL GROUP BY net HAVING count(*) >= 20) n ON a.net = n.net WHERE NOT a.suspended AND a.plan IN ('free', 'unverified') AND NOT EXISTS (SELECT 1 FROM invoices i WHERE i.address = a.address AND i.status = 'paid')", "accounts invoices")
def auto_suspend(v):
    crowded = v.accounts.where("net is not null").groupBy("net").count().where(F.col("count") >= AUTO_SUSPEND).select("net")
    rows = v.accounts.where(~F.col("suspended") & F.col("plan").isin("free", "unverified")).join(crowded, "net", "left_semi")
    return rows.join(v.invoices.where("status = 'paid'"), "address", "left_anti").select("address", "net")


@query("AG28", "SELECT method AS name, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM usage GROUP BY method", "usage")
def counters(v):
    return v.usage.groupBy(F.col("method").alias("name")).agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("FL15", "SELECT address, CASE WHEN net IN (3, 7, 12) THEN 100 ELSE 1000 END AS cap FROM accounts", "accounts")
def datacenter_caps(v):
    return v.accounts.select("address", F.when(F.col("net").isin(3, 7, 12), 100).otherwise(1000).alias("cap"))


@query("SF09", "SELECT c_custkey AS id, CASE WHEN c_custkey % 300 < 256 THEN '10.' || CAST(c_custkey % 200 AS VARCHAR) || '.' || CAST(c_custkey % 300 AS VARCHAR) || '.0/24' END AS net FROM customer")
def client_networks(v):
    ip = F.concat_ws(".", F.lit("10"), (F.col("c_custkey") % 200).cast("string"), (F.col("c_custkey") % 300).cast("string"), F.lit("9"))
    return v.table("customer").select(F.col("c_custkey").alias("id"), ipv4_network(ip).alias("net"))


@query("SF09", "SELECT c_custkey AS id, '2001:db8:' || printf('%x', c_custkey % 4096) || ':0::/64' AS net FROM customer")
def client_networks6(v):
    """The /64 of IPv6 clients, written in full or shortened."""
    part = F.lower(F.hex(F.col("c_custkey") % 4096))
    full = F.concat(F.lit("2001:0db8:"), F.lpad(part, 4, "0"), F.lit(":0000:1:2:3:4"))
    short = F.concat(F.lit("2001:DB8:"), part, F.lit("::9"))
    return v.table("customer").select(F.col("c_custkey").alias("id"), ipv6_network(F.when(F.col("c_custkey") % 2 == 0, full).otherwise(short)).alias("net"))


@query("SF43", "SELECT id, CAST(k * 60000 + (k % 60) * 1000 AS DOUBLE) AS ms FROM usage", "usage")
def parsed_durations(v):
    return v.usage.select("id", duration_ms(F.concat(F.col("k").cast("string"), F.lit("m"), (F.col("k") % 60).cast("string"), F.lit("s"))).alias("ms"))


@query("SF40", "SELECT id, CAST(strftime(to_timestamp(sec) AT TIME ZONE 'UTC', '%Y%m%d') AS INTEGER) AS day, CAST(strftime(to_timestamp(sec) AT TIME ZONE 'UTC', '%Y%m') AS INTEGER) AS month FROM usage", "usage")
def calendar_keys(v):
    return v.usage.select("id", utc_day(F.col("sec")).alias("day"), utc_month(F.col("sec")).alias("month"))


@query("SF53 FL12 SF10", "SELECT id, split_part(c, ':', 2) AS asn, units FROM (SELECT id, 'asn:' || CAST(account AS VARCHAR) || ':202401' AS c, units FROM usage) WHERE c LIKE 'asn:%:202401' ORDER BY units DESC, id LIMIT 20", "usage")
def asn_buckets(v):
    named = v.usage.select("id", F.concat(F.lit("asn:"), F.col("account").cast("string"), F.lit(":202401")).alias("c"), "units").where(F.col("c").like("asn:%:202401"))
    return named.select("id", F.split_part("c", F.lit(":"), F.lit(2)).alias("asn"), "units").orderBy(F.col("units").desc(), "id").limit(20)


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query("SC22 SC21", f"SELECT table_name AS tbl, column_name AS col, ordinal_position AS place FROM information_schema.columns WHERE table_name IN {_TABLES}")
def catalog_columns(v):
    """Tables registered as views of this session and the columns that the catalog lists for them."""
    prefix = "blocklens_catalog_"
    for name in _TABLES:
        v.table(name).createOrReplaceTempView(prefix + name)
    listed = [t.name for t in v.spark.catalog.listTables() if t.name.startswith(prefix)]
    rows = [(t.removeprefix(prefix), c.name, i) for t in listed for i, c in enumerate(v.spark.catalog.listColumns(t), 1)]
    for name in listed:
        v.spark.catalog.dropTempView(name)
    return v.spark.createDataFrame(rows, "tbl string, col string, place int")
