import pytest

from blocklens.operators import logs
from blocklens.plans.errors import QueryError, Refused
from blocklens.plans.pins import Pointers
from blocklens.plans.rpc import Node


@pytest.fixture(scope="module")
def node(views):
    return Node(views)


def test_pointers():
    p = Pointers.of(0, 10, 5, 50, 40)
    assert (p.finalized, p.safe, p.latest) == (10, 40, 40)
    assert p.number("earliest") == 0 and p.number("pending") == 40 and p.number("0xa") == 10 and p.number({"blockNumber": "0x1"}) == 1
    with pytest.raises(QueryError):
        p.number("newest")


def test_blocks_and_receipts(node):
    block = node.call("eth_getBlockByNumber", ["0x3", False])
    assert len(block["transactions"]) == 100 and node.call("eth_getBlockByHash", [block["hash"]])["number"] == "0x3"
    tx = node.call("eth_getTransactionByHash", [block["transactions"][5]])
    assert (tx["block"], tx["tx_index"]) == (3, 5)
    assert node.call("eth_getTransactionReceipt", [block["transactions"][5]])["tx_index"] == 5
    assert len(node.call("eth_getBlockReceipts", ["0x3"])) == 100
    assert node.call("eth_getBlockByNumber", ["0xffffff"]) is None


def test_logs(node, views):
    f = {"fromBlock": "0x2", "toBlock": "0x6", "address": [3, 4], "topics": [["A", "R"], None]}
    got = node.call("eth_getLogs", [f])
    want = [r.asDict() for r in views.logs.collect() if 2 <= r["block"] <= 6 and r["address"] in (3, 4) and r["topic0"] in ("A", "R")]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and want
    assert node.call("eth_getLogs", [{"fromBlock": "0x6", "toBlock": "0x2"}]) == []
    assert node.call("eth_getLogs", [f | {"address": ["0x" + "3".rjust(40, "0"), 4]}]) == got
    for bad in ({"address": "0x12"}, {"address": ["0x" + "z" * 40]}, {"topics": ["0x41"]}, {"topics": [None, "text"]}, {"address": 1.5}):
        with pytest.raises(QueryError) as e:
            node.call("eth_getLogs", [bad])
        assert e.value.code == -32602
    for bad in ({"topics": [None] * 5}, {"topics": "A"}, {"blockHash": "0x00", "fromBlock": "0x1"}):
        with pytest.raises(QueryError):
            node.call("eth_getLogs", [bad])


def test_limits_refuse_and_name_the_range_that_fits(views):
    with pytest.raises(Refused) as e:
        logs.checked(views.logs, logs.LogFilter(0, 20_000))
    assert e.value.data == {"fromBlock": "0x0", "toBlock": hex(9_999)}
    with pytest.raises(Refused) as e:
        logs.checked(views.logs, logs.LogFilter(0, 14), max_logs=1000)
    last = int(e.value.data["toBlock"], 16)
    fits, more = (views.logs.where(f"block <= {n}").count() for n in (last, last + 1))
    assert fits <= 1000 < more


def test_state_and_fees(node, views):
    key = views.state.where("value is not null").first()["key"]
    assert node.call("eth_getBalance", [key, "latest"]).startswith("0x")
    history = node.call("eth_feeHistory", ["0x4", "latest", [10, 90]])
    assert len(history["baseFeePerGas"]) == 5 and len(history["reward"]) == 4
    assert node.call("eth_feeHistory", [0, "latest"]) == {"oldestBlock": "0x0", "gasUsedRatio": None}
    assert int(node.call("eth_gasPrice", []), 16) > 0


def test_by_hash_uncles_and_state(node, views):
    block = node.call("eth_getBlockByNumber", ["0x5", False])
    assert node.call("eth_getBlockTransactionCountByHash", [block["hash"]]) == node.call("eth_getBlockTransactionCountByNumber", ["0x5"]) == "0x64"
    assert node.call("eth_getTransactionByBlockHashAndIndex", [block["hash"], "0x7"]) == node.call("eth_getTransactionByBlockNumberAndIndex", ["0x5", "0x7"])
    assert node.call("eth_getUncleCountByBlockNumber", ["0x5"]) == "0x1" and node.call("eth_getUncleCountByBlockNumber", ["0x6"]) == "0x0"
    assert node.call("eth_getUncleByBlockHashAndIndex", [block["hash"], "0x2"])["transactions"] is None and node.call("eth_getUncleByBlockNumberAndIndex", ["0x5", "0x0"]) is None
    assert node.call("eth_getBlockTransactionCountByHash", ["0x" + "0" * 64]) is None
    key = views.state.where(f"value is not null and block <= {node.pointers.latest}").first()["key"]
    assert int(node.call("eth_getStorageAt", [key, "0x0", "latest"]), 16) == int(node.call("eth_getBalance", [key, "latest"]), 16)
    assert node.call("eth_getStorageAt", [key, "0x1", "latest"]) == "0x" + "0" * 64
    assert int(node.call("eth_getTransactionCount", [key, "latest"]), 16) > 0 and node.call("eth_getCode", [4, "latest"]) == "0x34"


def test_batch(node):
    out = node.batch([{"id": 1, "method": "eth_chainId"}, {"id": 2, "method": "nope"}, {"id": 3}])
    assert out[0]["result"] == "0x1" and out[1]["error"]["code"] == -32601 and out[2]["error"]["code"] == -32600
    assert node.call("web3_sha3", ["0x"]).endswith("a470")
    with pytest.raises(QueryError):
        node.batch([{}] * 33)
