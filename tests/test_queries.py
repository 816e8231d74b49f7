import re

import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

from blocklens.queries import QUERIES
from blocklens.sources.chainview import Views
from tests.conftest import DATA
from tests.oracle import duck_rows, spark_rows


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query_equals_oracle(spark, name):
    query = QUERIES[name]
    assert spark_rows(query(spark, DATA)) == duck_rows(query.sql, DATA)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def pushed(spark, name):
    """The pushed filters of every scan of a query."""
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"PushedFilters: \[(.*?)\], ReadSchema: struct<(.*?)>", plan)


def test_filters_and_columns_reach_the_scan(spark):
    scans = pushed(spark, "block_by_number")
    assert len(scans) == 2 and all("GreaterThanOrEqual" in f and "700" in f and "799" in f for f, _ in scans)
    by_address = pushed(spark, "logs_by_address")
    assert all("GreaterThanOrEqual(l_orderkey,1000)" in f and "LessThanOrEqual(l_orderkey,6099)" in f for f, _ in by_address)
    assert any("In(l_suppkey, [" in f and columns.count(":") <= 2 for f, columns in by_address)
    assert any("EqualTo(l_returnflag,R)" in f for f, _ in pushed(spark, "logs_by_topic0"))


def test_block_bodies_beyond_the_first_withdrawals(spark):
    got = QUERIES["block_bodies"](spark, DATA.replace("sf0.001", "sf0.01")).collect()
    assert max(int(r["number"], 16) for r in got) > 15 and any(r["withdrawals"] for r in got)


def test_block_bodies_equal_oracle_with_withdrawals(spark):
    folder = DATA.replace("sf0.001", "sf0.01")
    query = QUERIES["block_bodies"]
    names, rows = spark_rows(query(spark, folder))
    assert (names, rows) == duck_rows(query.sql, folder)
    assert {len(w.split(",")) if w else 0 for w in (r[names.index("withdrawals")] for r in rows) if w is not None} == {0, 1, 2}


@pytest.fixture(scope="module", params=[-750, 1 << 53, (1 << 63) - 2000], ids=["below zero", "beyond doubles", "largest"])
def shifted(request, tmp_path_factory):
    """Orders and lines with keys that start elsewhere."""
    out = tmp_path_factory.mktemp("shifted")
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        table = pq.read_table(f"{DATA}/{name}.parquet")
        pq.write_table(table.set_column(table.schema.get_field_index(key), key, pc.add(table[key], request.param)), out / f"{name}.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["block_bodies", "payment_verification"])
def test_blocks_of_any_order_key(spark, shifted, name):
    query = QUERIES[name]
    assert spark_rows(query(spark, shifted)) == duck_rows(query.sql, shifted)


def test_key_ranges_hold_whole_blocks(spark, shifted):
    v = Views(spark, shifted)
    sizes = {r["block"]: r["count"] for r in v.transactions.groupBy("block").count().collect()}
    for n in (min(sizes), sorted(sizes)[len(sizes) // 2], max(sizes)):
        assert v.between(n, n).transactions.count() == sizes[n]
