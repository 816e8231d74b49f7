import datetime as dt

import pytest
from pyspark.sql import functions as F

from blocklens.operators.windows import islands, running_total
from blocklens.sources.ranges import BlockRanges
from blocklens.sources.store import Conflict, Manifest, Store
from blocklens.streaming import ingest, meters


def name(n, fork=""):
    return f"h{n}{fork}"


def spool(spark, folder, rows):
    spark.createDataFrame(rows, ingest.SPOOL).coalesce(1).write.mode("append").parquet(folder)


def blocks(first, last, seq, fork="", parent_fork=""):
    return [(seq + i, "block", n, name(n, fork), name(n - 1, parent_fork if i == 0 else fork), f"p{n}{fork}") for i, n in enumerate(range(first, last + 1))]


def test_publish_is_compare_and_set(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    base = store.pin()
    assert base == Manifest()
    segment = store.write("blocks", spark.range(10).withColumnRenamed("id", "number"), 0, 9, ["number"])
    one = store.publish(base, [segment], 9)
    assert store.pin() == one
    with pytest.raises(Conflict):
        store.publish(base, [segment], 9)
    assert store.put("x", b"a") and not store.put("x", b"a")
    with pytest.raises(Conflict):
        store.put("x", b"b")
    schema = spark.range(1).withColumnRenamed("id", "number").schema
    more = store.write("blocks", spark.range(10, 20).withColumnRenamed("id", "number"), 10, 19, ["number"])
    two = store.publish(one, [*one.segments, more], 19)
    assert store.read(one, "blocks", schema).count() == 10 and store.read(two, "blocks", schema).count() == 20
    assert len(two.of("blocks", 12, 15)) == 1
    three = store.merge(two, "blocks", list(two.segments), schema, ["number"])
    assert len(three.segments) == 1 and store.read(three, "blocks", schema).count() == 20
    old = spark.createDataFrame([(s.path, 0) for s in two.segments], "path string, at long")
    assert store.garbage(three, old, 10**7).count() == 2 and store.garbage(three, old, 5).count() == 0


def test_ingest_reorg_promotion_and_restart(spark, tmp_path):
    live, folder = ingest.LiveWindow(spark, str(tmp_path / "node")), str(tmp_path / "spool")
    spool(spark, folder, blocks(0, 19, 0))
    live.follow(folder).awaitTermination()
    assert live.window().count() == 20
    # blocks 15 to 19 are replaced from ancestor 14, block 19 disappears
    spool(spark, folder, [(100, "reorg", 14, None, None, None), *blocks(15, 18, 101, "b", "")])
    live.follow(folder).awaitTermination()  # a restart: the checkpoint remembers what was read
    rows = {r["number"]: r["hash"] for r in live.window().collect()}
    assert rows == {n: name(n) for n in range(15)} | {n: name(n, "b") for n in range(15, 19)}
    assert live.promote(finalized=16, batch=8) == 15
    assert live.store.pin().archived == 15
    assert {r["number"]: r["hash"] for r in live.chain().collect()} == rows
    assert live.promote(finalized=16, batch=8) is None
    # a late duplicate of an archived block changes nothing
    spool(spark, folder, [(200, "block", 3, "late", "late", "late")])
    live.follow(folder).awaitTermination()
    assert {r["number"]: r["hash"] for r in live.chain().collect()} == rows


def test_promotion_refuses_broken_links(spark, tmp_path):
    live, folder = ingest.LiveWindow(spark, str(tmp_path / "node")), str(tmp_path / "spool")
    spool(spark, folder, blocks(0, 7, 0) + [(50, "block", 8, "h8", "elsewhere", "p")] + blocks(9, 15, 60))
    live.follow(folder).awaitTermination()
    with pytest.raises(ValueError):
        live.promote(finalized=15, batch=8)


def test_streamed_hours_equal_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, i % 3, start + dt.timedelta(minutes=7 * i), i % 5 + 1) for i in range(200)]
    source = str(tmp_path / "calls")
    frame = spark.createDataFrame(rows, "id long, account long, at timestamp, units long")
    frame.write.parquet(source)
    stream = meters.hourly_usage(meters.distinct_calls(spark.readStream.schema(frame.schema).parquet(source)), late=None)
    query = stream.writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = frame.groupBy("account", F.date_trunc("hour", "at").alias("hour")).agg(F.sum("units").alias("units"))
    got = {(r["account"], r["hour"]): r["units"] for r in spark.table("hours").collect()}
    want = {(r["account"], r["hour"]): r["units"] for r in batch.collect()}
    last = max(h for _, h in want)
    assert got and all(want[k] == v for k, v in got.items()) and {k for k in want if k[1] < last - dt.timedelta(hours=2)} <= set(got)


def test_range_source(spark):
    spark.dataSource.register(BlockRanges)
    df = spark.read.format("block_ranges").options(first=5, last=42, stretch=10).load()
    assert df.rdd.getNumPartitions() == 4
    assert [r["number"] for r in df.orderBy("number").collect()] == list(range(5, 43))


def test_running_total_and_islands(spark):
    keys = [n for n in range(0, 20000, 1) if n % 4999 != 7]
    df = spark.createDataFrame([(k, k % 3) for k in keys], "k long, x long")
    got = {r["k"]: r["before"] for r in running_total(df, "k", "x", "before").collect()}
    total = 0
    for k in keys:
        assert got[k] == total
        total += k % 3
    runs = sorted((r["first"], r["last"]) for r in islands(df, "k").collect())
    want, first = [], keys[0]
    for a, b in zip(keys, [*keys[1:], None], strict=True):
        if b != a + 1:
            want.append((first, a))
            first = b
    assert runs == want


def test_token_buckets_admit_in_event_order(spark, tmp_path):
    from blocklens.streaming.buckets import admit, refill

    rows = [(k, float(t)) for k in (1, 2) for t in (0, 0.1, 0.2, 0.3, 5, 5.1, 20)]
    source = str(tmp_path / "calls")
    frame = spark.createDataFrame(rows, "key long, at double")
    frame.write.parquet(source)
    stream = admit(spark.readStream.schema(frame.schema).parquet(source), rate=0.5, burst=2)
    stream.writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["key"], r["at"], r["admitted"]) for r in spark.table("admitted").collect())
    want = []
    for k in (1, 2):
        tokens, last = 2.0, 0.0
        for at in sorted(t for key, t in rows if key == k):
            tokens, last = refill(tokens, at - last, 0.5, 2), at
            want.append((k, at, tokens >= 1))
            tokens -= tokens >= 1
    assert got == want and {x[2] for x in got} == {True, False}
