import hashlib
import hmac
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blocklens.functions import hexes, metering, network, rlp, times
from blocklens.functions.keccak import keccak256, keccak256_many
from blocklens.operators import fees
from blocklens.operators.layout import merge_run, promotion_target


def test_keccak_known_answers():
    assert keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert keccak256(b"abc").hex() == "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"
    messages = [bytes([i % 256]) * i for i in (0, 1, 135, 136, 137, 300)]
    assert keccak256_many(messages) == [keccak256(m) for m in messages]


def test_roots_and_addresses():
    assert rlp.ordered_root([]).hex() == "56e81f171bcc55a6ff8345e692c0f86e5b48e01b996cadc001622fb5e363b421"
    sender = bytes.fromhex("6ac7ea33f8831ea9dcc53393aaa88b25a785dbf0")
    assert rlp.contract_address(sender, 1).hex() == "343c43a37d37dff08ae8c4a11544c718abb4fcf8"


items = st.recursive(st.binary(max_size=70), lambda x: st.lists(x, max_size=5), max_leaves=12)


@settings(max_examples=60, deadline=None)
@given(items)
def test_rlp_round_trip(item):
    assert rlp.decode(rlp.encode(item)) == item


def test_bloom_has_no_false_negatives():
    values = [bytes([i]) * 20 for i in range(30)]
    header = rlp.bloom(values)
    assert all(rlp.bloom_admits(header, [[v], values]) for v in values)


def test_hex_columns(spark):
    row = spark.sql("select 255L n, '0x00fF' h, '0xabc' odd, '0x1g' bad").select(
        hexes.quantity(F.col("n")), hexes.quantity(F.lit(0)), hexes.parse_quantity(F.col("h")), hexes.parse_data(F.col("odd")), hexes.parse_data(F.col("h"), 2), hexes.parse_quantity(F.col("bad")), hexes.storage_word(F.col("n"))
    ).first()
    assert list(row)[:4] == ["0xff", "0x0", 255, None] and bytes(row[4]) == b"\x00\xff" and row[5] is None and row[6] == "0x" + "0" * 62 + "ff"


def test_hmac_and_networks(spark):
    key = b"secret"
    row = spark.createDataFrame([("1.2.3.4", "::ffff:9.8.7.6", "2001:db8::1", "300.1.1.1", "2001:0db8:0:0:1::")], "a string, b string, c string, d string, e string").select(
        network.hmac_sha256(key, F.col("a")), network.ipv4_network(F.col("a")), network.ipv4_network(F.col("b"), 32), network.ipv6_network(F.col("c")), network.ipv4_network(F.col("d")), network.ipv6_network(F.col("e"), 3)
    ).first()
    assert row[0] == hmac.new(key, b"1.2.3.4", hashlib.sha256).hexdigest()
    assert list(row)[1:] == ["1.2.3.0/24", "9.8.7.6", "2001:db8:0:0::/64", None, "2001:db8:0::/48"]


def test_durations(spark):
    rows = spark.createDataFrame([("1m30s",), ("250ms",), ("2h",), ("1.5s",), ("x",), ("",), ("-1.5h",), ("1s1s",), ("500us",), ("+.5s",), ("0",), ("3",), ("2µs1ns",)], "d string").select(times.duration_ms(F.col("d"))).collect()
    assert [r[0] for r in rows] == pytest.approx([90_000.0, 250.0, 7_200_000.0, 1_500.0, None, None, -5_400_000.0, 2_000.0, 0.5, 500.0, 0.0, None, 0.002001])


def test_credits_and_prices(spark):
    calls = spark.createDataFrame([("eth_call", None, None), ("eth_getLogs", 2500, None), ("eth_getLogs", 20_000, None), ("eth_getLogs", None, None), ("nope", None, None), ("nope", None, -32601), (None, None, None)], "method string, blocks long, error int")
    assert sorted(r["credits"] for r in metering.credits(calls).collect()) == sorted([30, 60, 50, 50, 20, 5, 5])
    assert metering.estimate(["eth_getLogs", "nope", None]) == 95 + 5 + 5
    assert metering.ether_units(1900, 3000 * 10**8) == 6_334_000_000_000_000


def test_fake_exponential_matches_integers(spark):
    cases = [(0, 3_338_477), (10_000_000, 3_338_477), (60_000_000, 5_007_716)]
    rows = spark.createDataFrame(cases, "n long, d long").select("n", "d", fees.fake_exponential(F.col("n"), F.col("d")).alias("x")).collect()
    assert all(r["x"] == fees.fake_exponential_int(r["n"], r["d"]) for r in rows)


def test_oracle_rule_by_hand(spark):
    cases = {50: [1] * 50, 20: [3] * 50, 7: [1] * 7, 0: [], 21: [1] + [3] * 49, 22: [3] * 12 + [1] * 38}
    rows = spark.createDataFrame(list(cases.items()), "want int, sizes array<int>").select("want", fees.blocks_read(F.col("sizes")).alias("n")).collect()
    assert [r["n"] for r in rows] == [r["want"] for r in rows]
    values = [[[n, n + 1, n + 2] for n in range(999, 949, -1)], [], [[]] * 30, [[10**15] * 3] * 50]
    tips = [r[0] for r in spark.createDataFrame([(x,) for x in values], "v array<array<long>>").select(fees.suggested_tip(F.col("v"))).collect()]
    assert tips == [992, fees.DEFAULT_PRICE, fees.DEFAULT_PRICE, fees.MAX_PRICE]  # 992: the 36th of 60 values


def test_a_series_that_is_too_long_is_refused(spark):
    with pytest.raises(Exception, match="terms|OVERFLOW|overflow|NUMERIC_VALUE_OUT_OF_RANGE"):
        spark.createDataFrame([(10**9, 3_338_477)], "n long, d long").select(fees.fake_exponential(F.col("n"), F.col("d"))).collect()


def test_carries_across_cells(spark, monkeypatch):
    from blocklens.operators import windows

    monkeypatch.setattr(windows, "CELL", 4)
    rng = random.Random(5)
    keys = sorted(rng.sample(range(400), 300))
    df = spark.createDataFrame([(k, k % 7) for k in keys], "k long, x long")
    got = {r["k"]: r["before"] for r in windows.running_total(df, "k", "x", "before").collect()}
    assert got == {k: sum(j % 7 for j in keys if j < k) for k in keys}
    runs = sorted((r["first"], r["last"], r["n"]) for r in windows.islands(df, "k").collect())
    want = []
    for k in keys:
        want = [*want[:-1], (want[-1][0], k, want[-1][2] + 1)] if want and want[-1][1] == k - 1 else [*want, (k, k, 1)]
    assert runs == want


def test_percentile_checks():
    assert fees.check_percentiles([0, 50, 100]) == [0, 50, 100]
    for bad in ([50, 50], [-1], [101], ["5"], [True]):
        with pytest.raises(Exception):
            fees.check_percentiles(bad)


def brute_run(objects, max_objects, batch):
    """All runs by direct sums."""

    def span(i, w):
        run = objects[i : i + w]
        whole = all(not o[2] for o in run) and all(b[0] == a[1] + 1 for a, b in zip(run, run[1:], strict=False))
        return sum(o[1] - o[0] + 1 for o in run) if whole else None

    n = len(objects)
    best = {w: min(((s, -i) for i in range(n - w + 1) if (s := span(i, w))), default=None) for w in range(2, min(16, n) + 1)}
    best = {w: b for w, b in best.items() if b}
    if sum(not o[2] for o in objects) > max_objects:
        values = [((w - 1) / (s + batch * 4), -w, -i) for w, (s, i) in best.items() if s <= 64 * batch]
        if values and -max(values)[1] >= 3:
            return max(values)[2], -max(values)[1]
        pairs = [(max(a[1] - a[0], b[1] - b[0]) + 1, min(a[1] - a[0], b[1] - b[0]) + 1, i) for i, (a, b) in enumerate(zip(objects, objects[1:], strict=False)) if span(i, 2)]
        found = min(((x / y, x + y, -i) for x, y, i in pairs), default=None)
        return (-found[2], 2) if found else (-1, 0)
    for w in sorted(best, reverse=True):
        if best[w][0] <= batch:
            return -best[w][1], w
    return -1, 0


def test_merge_run_equals_brute_force_and_keeps_the_cap():
    rng = random.Random(3)
    for _ in range(300):
        objects, at = [], 0
        for i in range(rng.randint(0, 14)):
            size = rng.choice([1, 8, 64, 256, 700])
            objects.append((at, at + size - 1, i == 0 and rng.random() < 0.5))
            at += size + (rng.random() < 0.1)
        cap = rng.randint(1, 8)
        assert merge_run(objects, cap, 256) == brute_run(objects, cap, 256)
    objects, most = [], 0
    for i in range(200):
        objects.append((i * 256, i * 256 + 255, False))
        while len(objects) > 6:
            at, width = merge_run(objects, 6, 256)
            assert width >= 2
            objects[at : at + width] = [(objects[at][0], objects[at + width - 1][1], False)]
        most = max(most, len(objects))
    assert most <= 6 and objects[0][0] == 0 and objects[-1][1] == 200 * 256 - 1


def test_promotion_target():
    assert promotion_target(-1, 300, 256, 8, 0, 3600, 4) == 295
    assert promotion_target(-1, 100, 256, 8, 0, 3600, 4) is None
    assert promotion_target(-1, 100, 256, 8, 7200, 3600, 4) == 95
    assert promotion_target(99, 99, 256, 8, 7200, 3600, 4) is None
    assert promotion_target(-1, 262, 260, 8, 0, 3600, 4) is None  # the last whole group ends at 255: no full batch
    assert promotion_target(-1, 100, 256, 8, 7200, 3600, 4, live_head=100, network_head=400) is None  # still catching up
    assert promotion_target(-1, 100, 256, 8, 7200, 3600, 4, live_head=90, network_head=300) == 87
    assert promotion_target(-1, 9000, 256, 8, 0, 3600, 4) == 1023


def test_gas_search():
    from blocklens.functions.search import gas_needed

    asked = []

    def at(need):
        return lambda gas: asked.append(gas) or gas >= need

    assert gas_needed(at(0), 10**7) == 21_000 and gas_needed(at(10**8), 10**7) is None
    for need in (21_001, 50_000, 123_456, 4_999_999):
        asked.clear()
        found = gas_needed(at(need), 5 * 10**6, peak=need - 2_000)
        assert need <= found <= need * 1.016 + 1 and len(asked) <= 28
