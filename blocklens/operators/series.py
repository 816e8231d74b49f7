"""Time series: buckets, gap filling, rates, weighted quantiles; and reports over benchmark samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blocklens.functions.times import bucket
from blocklens.operators.windows import previous
from blocklens.registry import query


def gap_filled(rows: DataFrame, time: str, width: int, sums: list[str], peaks: list[str] = ()) -> DataFrame:
    """t and the aggregates of every bucket from the first to the last, zeros where there is no row."""
    per = rows.groupBy(bucket(F.col(time), width).alias("t")).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in peaks])
    ends = rows.agg(bucket(F.min(time), width).alias("a"), bucket(F.max(time), width).alias("b"))
    every = ends.where("a is not null").select(F.explode(F.sequence("a", "b", F.lit(width).cast("long"))).alias("t"))
    return every.join(per, "t", "left").select("t", *[F.coalesce(c, F.lit(0)).alias(c) for c in [*sums, *peaks]])


def last_per_bucket(samples: DataFrame, width: int) -> DataFrame:
    """bucket, t, executed: the last sample of every bucket (of samples of one second, the largest)."""
    return samples.groupBy(bucket(F.col("t"), width).alias("bucket")).agg(F.max(F.struct("t", "executed")).alias("s")).select("bucket", "s.t", "s.executed")


def rates(points: DataFrame) -> DataFrame:
    """points with rate: units per second since the point before, never negative, null for the first."""
    order = Window.orderBy("bucket")  # a row for each bucket of a range
    gap = F.col("t") - F.lag("t").over(order)
    return points.withColumn("rate", F.when(gap > 0, F.greatest(F.lit(0.0), (F.col("executed") - F.lag("executed").over(order)) / gap)))


def weighted(p: str, w: str) -> Column:
    """Mean of p by weight w; 0 without weight."""
    total = F.sum(w)
    return F.when(total > 0, F.sum(F.col(p) * F.col(w)) / total).otherwise(F.lit(0.0))


def nearest_rank(df: DataFrame, keys: list[str], value: str, percents: list[int]) -> DataFrame:
    """keys, n and p<percent>: the value at rank ceil(p / 100 * n), at least 1.

    Ranks come from counts per value, added up per key: a hot key is combined map side first.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    order = Window.partitionBy(*keys).orderBy(value)
    ranked = counts.withColumn("__upto", F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.sum("__c").over(Window.partitionBy(*keys)))
    at = lambda p: F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("__n") / 100))
    return ranked.groupBy(*keys).agg(F.first("__n").alias("n"), *[F.min(F.when(F.col("__upto") >= at(p), F.col(value))).alias(f"p{p}") for p in percents])


def samples(v) -> DataFrame:
    """label, cls, user, at, us (whole microseconds), ok, refused, credits of benchmark calls."""
    us = F.round(F.col("ms") * 1000).cast("long")
    return v.usage.select("id", F.col("method").alias("label"), F.concat(F.lit("c"), (F.col("account") % 4).cast("string")).alias("cls"), F.col("account").alias("user"), "sec", us.alias("us"), (F.col("k") % 13 != 0).alias("ok"), (F.col("k") % 13 == 0).alias("bad"), (F.col("k") % 26 == 0).alias("refused"), F.col("units").alias("credits"))


SAMPLES = "samples AS (SELECT id, method AS label, 'c' || CAST(account % 4 AS VARCHAR) AS cls, account AS user, sec, CAST(round(ms * 1000) AS BIGINT) AS us, k % 13 <> 0 AS ok, k % 26 = 0 AS refused, units AS credits FROM usage)"


def _rank_sql(p: int, keys: str, where: str = "") -> str:
    return f"SELECT {keys}, min(us) FILTER (WHERE rn >= greatest(1, ceil({p} * n / 100.0))) AS p{p} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY us) AS rn, count(*) OVER (PARTITION BY {keys}) AS n FROM samples {where}) GROUP BY {keys}"


@query("AG10 AG11 SF41 SF42", "WITH p AS (SELECT sec // 900 * 900 AS t, count(*) AS requests, sum(units) AS units, max(k) AS peak FROM usage GROUP BY 1), e AS (SELECT unnest(range((SELECT min(t) FROM p), (SELECT max(t) FROM p) + 900, 900)) AS t) SELECT e.t, coalesce(requests, 0) AS requests, CAST(coalesce(units, 0) AS BIGINT) AS units, coalesce(peak, 0) AS peak FROM e LEFT JOIN p ON e.t = p.t", "usage")
def usage_gap_filled(v):
    rows = v.usage.select("sec", F.lit(1).alias("requests"), "units", F.col("k").alias("peak"))
    return gap_filled(rows, "sec", 900, ["requests", "units"], ["peak"]).select("t", "requests", "units", "peak")


@query("AG12", "SELECT account % 3 AS chain, count(*) AS n, CAST(sum(k * units) * 1000 // sum(units) AS BIGINT) AS p95_milli FROM usage GROUP BY 1", "usage")
def weighted_quantiles(v):
    return v.usage.groupBy((F.col("account") % 3).alias("chain")).agg(F.count("*").alias("n"), F.floor(weighted("k", "units") * 1000).alias("p95_milli"))


@query("AG13 WN10 TR11 TR12", "WITH l AS (SELECT sec // 3600 * 3600 AS bucket, max(sec) AS t, max_by(id, sec * 1000000000 + id) AS executed FROM usage GROUP BY 1) SELECT bucket, t, executed, CAST(floor(1000000 * CASE WHEN t > lag(t) OVER (ORDER BY bucket) THEN greatest(0, (executed - lag(executed) OVER (ORDER BY bucket)) / (t - lag(t) OVER (ORDER BY bucket))::DOUBLE) END) AS BIGINT) AS micro_rate FROM l", "usage")
def head_rate(v):
    points = last_per_bucket(v.usage.select(F.col("sec").alias("t"), F.col("id").alias("executed")), 3600)
    return rates(points).select("bucket", "t", "executed", F.floor(F.col("rate") * 1_000_000).alias("micro_rate"))


@query("JN18", "SELECT c.chain, coalesce(t.requests, 0) AS requests, CAST(coalesce(t.units, 0) AS BIGINT) AS units FROM (SELECT unnest(range(0, 260)) AS chain) c LEFT JOIN (SELECT account AS chain, count(*) AS requests, sum(units) AS units FROM usage GROUP BY 1) t ON c.chain = t.chain ORDER BY requests DESC", "usage")
def per_chain_totals(v):
    totals = v.usage.groupBy(F.col("account").alias("chain")).agg(F.count("*").alias("requests"), F.sum("units").alias("units"))
    chains = v.spark.range(260).withColumnRenamed("id", "chain")
    return chains.join(totals, "chain", "left").select("chain", F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("units", F.lit(0)).alias("units"))


@query("PR20", "SELECT id, CASE WHEN k - 50 >= 0 THEN k - 50 END AS lag FROM usage", "usage")
def pipeline_points(v):
    lag = F.col("k") - 50
    return v.usage.select("id", F.when(lag >= 0, lag).alias("lag"))


@query("AG14 AG16 WN17", f"WITH {SAMPLES}, g AS (SELECT label, count(*) AS calls, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE refused) AS refused FROM samples GROUP BY label), a AS ({_rank_sql(50, 'label', 'WHERE ok')}), b AS ({_rank_sql(95, 'label', 'WHERE ok')}), m AS (SELECT label, max(us) AS most FROM samples WHERE ok GROUP BY label) SELECT g.label, calls, ok, refused, p50, p95, most FROM g LEFT JOIN a ON g.label = a.label LEFT JOIN b ON g.label = b.label LEFT JOIN m ON g.label = m.label", "usage")
def case_report(v):
    rows = samples(v)
    counts = rows.groupBy("label").agg(F.count("*").alias("calls"), F.count_if("ok").alias("ok"), F.count_if("refused").alias("refused"), F.max(F.when(F.col("ok"), F.col("us"))).alias("most"))
    return counts.join(nearest_rank(rows.where("ok"), ["label"], "us", [50, 95]).drop("n"), "label", "left").select("label", "calls", "ok", "refused", "p50", "p95", "most")


@query("AG15", f"WITH {SAMPLES} SELECT cls, us AS median FROM (SELECT cls, us, row_number() OVER (PARTITION BY cls ORDER BY us) AS rn, count(*) OVER (PARTITION BY cls) AS n FROM samples) WHERE rn = n // 2 + 1", "usage")
def upper_medians(v):
    counts = samples(v).groupBy("cls", "us").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("cls").orderBy("us"))
    ranked = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy("cls")))
    return ranked.where(F.col("upto") >= F.floor(F.col("n") / 2) + 1).groupBy("cls").agg(F.min("us").alias("median"))


@query("AG17", f"WITH {SAMPLES} SELECT user % 5 AS stage, count(*) AS calls, CAST(count(*) * 1000000 // (max(sec) - min(sec)) AS BIGINT) AS micro_rps, CAST(10000 * count(*) FILTER (WHERE NOT ok) // count(*) AS BIGINT) AS error_bp, CAST(sum(credits) * 1000 // count(*) AS BIGINT) AS milli_credits FROM samples GROUP BY 1", "usage")
def stage_throughput(v):
    n = F.count("*")
    return samples(v).groupBy((F.col("user") % 5).alias("stage")).agg(n.alias("calls"), F.floor(n * 1_000_000 / (F.max("sec") - F.min("sec"))).alias("micro_rps"), F.floor(10_000 * F.count_if("bad") / n).alias("error_bp"), F.floor(F.sum("credits") * 1000 / n).alias("milli_credits"))


@query("AG18", "SELECT plan, CAST(included // 20 AS BIGINT) AS requests, round(included / 20.0 / rps / 3600, 6) AS hours, CASE WHEN included > 0 THEN round(cents / 100.0 / (included / 20.0 / 1000000), 6) END AS revenue FROM (VALUES ('builder', 1900, 600000000, 250), ('growth', 8900, 3000000000, 1000), ('scale', 59900, 20000000000, 3000)) p(plan, cents, included, rps)")
def plan_economics(v):
    from blocklens.functions.metering import PLANS

    rows = v.spark.createDataFrame([(n, *r) for n, r in PLANS.items() if r[0]], "plan string, cents long, included long, rps long")
    calls = F.col("included") / 20.0
    return rows.select("plan", F.floor(calls).alias("requests"), F.round(calls / F.col("rps") / 3600, 6).alias("hours"), F.when(F.col("included") > 0, F.round(F.col("cents") / 100.0 / (calls / 1_000_000), 6)).alias("revenue"))


@query("AG19 AG38", "WITH p AS (SELECT * FROM (VALUES ('view', 3), ('click', 5), ('purchase', 11), ('error', 1)) p(method, nano)) SELECT u.method, coalesce(p.nano, 2) AS nano, CAST(sum(units) AS BIGINT) AS units, CAST(sum(units) * coalesce(p.nano, 2) AS BIGINT) AS cost, CAST(sum(units) * coalesce(p.nano, 2) * 1000000 // count(*) AS BIGINT) AS per_million FROM usage u LEFT JOIN p ON u.method = p.method GROUP BY u.method, p.nano", "usage")
def cost_model(v):
    prices = v.spark.createDataFrame([("view", 3), ("click", 5), ("purchase", 11), ("error", 1)], "method string, nano int")
    totals = v.usage.groupBy("method").agg(F.sum("units").alias("units"), F.count("*").alias("n"))
    nano = F.coalesce("nano", F.lit(2))
    return totals.join(prices, "method", "left").select("method", nano.alias("nano"), "units", (F.col("units") * nano).alias("cost"), F.floor(F.col("units") * nano * 1_000_000 / F.col("n")).alias("per_million"))


@query("JN16 ST08", f"WITH {SAMPLES}, a AS (SELECT label || cls AS label, count(*) AS n FROM samples WHERE user < 90 GROUP BY 1), b AS (SELECT label || cls AS label, count(*) AS n FROM samples WHERE user >= 60 AND label <> 'error' GROUP BY 1) SELECT coalesce(a.label, b.label) AS label, a.n AS before, b.n AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS change FROM a FULL JOIN b ON a.label = b.label", "usage")
def run_comparison(v):
    rows = samples(v).withColumn("label", F.concat("label", "cls"))
    a = rows.where("user < 90").groupBy("label").agg(F.count("*").alias("before"))
    b = rows.where("user >= 60 and not startswith(label, 'error')").groupBy("label").agg(F.count("*").alias("after"))
    return a.join(b, "label", "full_outer").withColumn("change", F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0)))


@query("JN17 FL14", "SELECT side, id, price FROM (SELECT 'left' AS side, * FROM (SELECT o_orderkey AS id, round(o_totalprice * 100)::BIGINT AS price FROM orders EXCEPT ALL SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN 0 ELSE round(o_totalprice * 100)::BIGINT END FROM orders) UNION ALL SELECT 'right', * FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN 0 ELSE round(o_totalprice * 100)::BIGINT END FROM orders EXCEPT ALL SELECT o_orderkey, round(o_totalprice * 100)::BIGINT FROM orders))")
def result_differences(v):
    a = v.invoices.select("id", F.col("usd_cents").alias("price"))
    b = a.select("id", F.when(F.col("id") % 101 == 0, F.lit(0)).otherwise(F.col("price")).cast("long").alias("price"))
    side = lambda x, y, n: x.exceptAll(y).select(F.lit(n).alias("side"), "id", "price")
    return side(a, b, "left").unionByName(side(b, a, "right"))


@query("AG37", f"WITH {SAMPLES}, s AS (SELECT user % 12 AS stage, count(*) AS calls, 100 * count(*) FILTER (WHERE NOT ok) <= 9 * count(*) AS healthy FROM samples GROUP BY 1) SELECT stage, calls FROM s WHERE stage < coalesce((SELECT min(stage) FROM s WHERE NOT healthy), 1000000)", "usage")
def load_ramp(v):
    stages = samples(v).groupBy((F.col("user") % 12).alias("stage")).agg(F.count("*").alias("calls"), (100 * F.count_if("bad") <= 9 * F.count("*")).alias("healthy"))
    first_bad = stages.where("not healthy").agg(F.coalesce(F.min("stage"), F.lit(1_000_000)).alias("stop"))
    return stages.crossJoin(F.broadcast(first_bad)).where("stage < stop").select("stage", "calls")  # the right side is one row


@query("AG36", f"WITH {SAMPLES}, g AS (SELECT label, cls, count(*) AS n, CAST(sum(us) AS BIGINT) AS total, CAST(sum(us) // count(*) AS BIGINT) AS mean FROM samples GROUP BY label, cls), a AS ({_rank_sql(50, 'label, cls')}) SELECT g.label, g.cls, g.n, total, mean, p50 FROM g JOIN a ON g.label = a.label AND g.cls = a.cls", "usage")
def cpu_profile(v):
    rows = samples(v)
    g = rows.groupBy("label", "cls").agg(F.sum("us").alias("total"), F.floor(F.sum("us") / F.count("us")).alias("mean"))
    return g.join(nearest_rank(rows, ["label", "cls"], "us", [50]), ["label", "cls"]).select("label", "cls", "n", "total", "mean", "p50")


@query("WN11", f"WITH {SAMPLES}, s AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY user ORDER BY id) <= 7200 THEN 0 ELSE 1 END AS new FROM samples), r AS (SELECT *, sum(new) OVER (PARTITION BY user ORDER BY id) AS session FROM s) SELECT user, CAST(session AS BIGINT) AS session, count(*) AS steps, CAST(sum(us) AS BIGINT) AS us, bool_and(ok) AS clean FROM r GROUP BY user, session", "usage")
def user_sessions(v):
    order = Window.partitionBy("user").orderBy("id")
    new = F.when(F.col("sec") - F.lag("sec").over(order) <= 7200, 0).otherwise(1)
    marked = samples(v).withColumn("new", new).withColumn("session", F.sum("new").over(order))
    return marked.groupBy("user", "session").agg(F.count("*").alias("steps"), F.sum("us").alias("us"), F.bool_and("ok").alias("clean"))


@query("SF55", "SELECT id, k AS hit, k % 7 AS miss FROM usage", "usage")
def header_counters(v):
    header = F.concat(F.lit("hit="), F.col("k").cast("string"), F.lit(" miss="), (F.col("k") % 7).cast("string"))
    number = lambda name: F.regexp_extract(F.col("h"), rf"{name}=(\d+)", 1).cast("long")
    return v.usage.select("id", header.alias("h")).select("id", number("hit").alias("hit"), number("miss").alias("miss"))


@query("WN05 JN20", "SELECT b.number, p.hash = b.parent_hash AS linked FROM blocks b JOIN blocks p ON p.number = b.number - 1", "blocks")
def parent_links(v):
    before = previous(v.blocks.select("number", "hash", "parent_hash"), "number", {"parent": "hash"})
    return before.where("parent is not null").select("number", (F.col("parent") == F.col("parent_hash")).alias("linked"))
