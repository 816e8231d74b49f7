"""The method catalogue over a data set: each call becomes a plan, answers come as plain values.

A request is at most 32 calls, answered in order; all calls of a request see the same pointers.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from blocklens.functions.keccak import keccak256
from blocklens.operators import fees, logs, state
from blocklens.plans.errors import QueryError, invalid_params, unavailable
from blocklens.plans.pins import Pointers
from blocklens.sources.chainview import Views

MAX_BATCH = 32


class Node:
    """Answers methods over Views; pointers are fixed when it is made."""

    def __init__(self, views: Views, pointers: Pointers | None = None):
        self.v = views
        self._pointers = pointers

    @cached_property
    def pointers(self) -> Pointers:
        if self._pointers:
            return self._pointers
        first, last = self.v.blocks.agg(F.min("number"), F.max("number")).first()
        return Pointers.of(first, max(first, last - 64), last - 64, last - 32, last)

    def batch(self, items: list[dict]) -> list[dict]:
        if not isinstance(items, list) or not items:
            raise invalid_params("a batch is a list of calls")
        if len(items) > MAX_BATCH:
            raise QueryError(-32005, f"at most {MAX_BATCH} calls")
        return [self.answer(x) for x in items]

    def answer(self, item: dict) -> dict:
        head = {"jsonrpc": "2.0", "id": item.get("id") if isinstance(item, dict) else None}
        try:
            if not isinstance(item, dict) or not isinstance(item.get("method"), str):
                raise QueryError(-32600, "invalid request")
            return head | {"result": self.call(item["method"], item.get("params") or [])}
        except QueryError as e:
            return head | {"error": {"code": e.code, "message": str(e)} | ({"data": e.data} if e.data else {})}

    def call(self, method: str, params: list):
        handler = METHODS.get(method)
        if handler is None:
            raise QueryError(-32601, f"method {method} is not served")
        return handler(self, *params)

    # --- blocks and transactions

    def block(self, ref=None, full: bool = False):
        n = self.number_of(ref)
        row = None if n is None else self.v.between(n, n).blocks.first()
        if row is None:
            return None
        txs = self.v.between(n, n).transactions.orderBy("tx_index").collect()  # one block
        listed = [t.asDict() for t in txs] if full else ["0x" + t["hash"] for t in txs]
        return {k: _render(k, x) for k, x in row.asDict().items()} | {"transactions": listed}

    def number_of(self, ref) -> int | None:
        """The number of a block given by hash, number or tag; None if no block has that hash."""
        if isinstance(ref, str) and len(ref) == 66:
            row = self.v.blocks.where(F.col("hash") == ref[2:].lower()).select("number").first()
            return row["number"] if row else None
        return self.pointers.number(ref)

    def count(self, ref=None):
        n = self.number_of(ref)
        found = 0 if n is None else self.v.between(n, n).transactions.count()
        return hex(found) if found else None

    def uncles(self, ref=None):
        """Uncles are kept for every fifth block, one each."""
        n = self.number_of(ref)
        return None if n is None or self.v.between(n, n).blocks.isEmpty() else hex(len(self._uncles(n)))

    def uncle(self, ref, index: str):
        n, i = self.number_of(ref), int(index, 16)
        return None if n is None else self._uncles(n).get(i)

    def _uncles(self, n: int) -> dict:
        from blocklens.registry import QUERIES

        rows = QUERIES["uncle_by_index"].build(self.v.between(n, n)).collect()  # one block
        return {r["ordinal"]: {"hash": "0x" + r["uncle"], "transactions": None} for r in rows}

    def transaction(self, digest: str):
        row = self.v.transactions.where(F.col("hash") == str(digest)[2:]).first()
        return row.asDict() if row else None

    def transaction_at(self, ref, index: str):
        n = self.number_of(ref)
        row = None if n is None else self.v.between(n, n).transactions.where(F.col("tx_index") == int(index, 16)).first()
        return row.asDict() if row else None

    def receipts(self, ref=None):
        from blocklens.registry import QUERIES

        n = self.number_of(ref)
        rows = [] if n is None else QUERIES["block_receipts"].build(self.v.between(n, n)).orderBy("tx_index").collect()  # one block
        return [r.asDict() for r in rows] or None

    def receipt(self, digest: str):
        from blocklens.registry import QUERIES

        tx = self.v.transactions.where(F.col("hash") == str(digest)[2:]).select("block").first()
        if tx is None:
            return None
        row = QUERIES["block_receipts"].build(self.v.between(tx["block"], tx["block"])).where(F.col("hash") == str(digest)[2:]).first()
        return row.asDict() if row else None

    # --- logs

    def logs(self, raw: dict):
        f = self.log_filter(raw)
        if f.first > f.last:
            return []
        return [r.asDict() for r in logs.checked(logs.near_logs(self.v, f), f).orderBy("block", "tx_index", "log_index").collect()]  # at most MAX_LOGS rows

    def log_filter(self, raw: dict) -> logs.LogFilter:
        """A filter object: scalar or list values, a block hash instead of a range, at most four positions."""
        if not isinstance(raw, dict):
            raise invalid_params("filter object required")
        if raw.get("topics") is not None and not isinstance(raw["topics"], list):
            raise invalid_params("topics must be an array")
        addresses = tuple(_address(x) for x in _many(raw.get("address")))
        topics = tuple(tuple(_topic(i, x) for x in _many(t)) or None for i, t in enumerate(raw.get("topics") or []))
        if "blockHash" in raw:
            if "fromBlock" in raw or "toBlock" in raw:
                raise invalid_params("blockHash cannot be combined with fromBlock or toBlock")
            row = self.v.blocks.where(F.col("hash") == str(raw["blockHash"])[2:]).select("number").first()
            if row is None:
                raise unavailable("unknown block")
            first = last = row["number"]
        else:
            first = self.pointers.number(raw.get("fromBlock"))
            last = min(self.pointers.number(raw.get("toBlock")), self.pointers.latest)
        return logs.LogFilter(first, last, addresses, topics)

    # --- state and fees

    def value(self, key: int, ref=None):
        n = self.pointers.number(ref)
        if not self.pointers.earliest <= n <= self.pointers.latest:
            raise unavailable("requested block is not available")
        row = state.as_of(self.v.state.where(F.col("key") == int(key)), n).first()
        return hex(row["value"]) if row and row["value"] is not None else "0x0"

    def storage(self, key: int, slot=0, ref=None):
        """Slot 0 of an account holds its value; all others are empty."""
        place = int(slot, 16) if isinstance(slot, str) else int(slot)
        value = self.value(key, ref) if place == 0 else "0x0"
        return "0x" + value[2:].rjust(64, "0")

    def code(self, key: int, ref=None):
        """Every fourth account has code: its number as text."""
        self.value(key, ref)  # refuses blocks that are not kept
        return "0x" + str(int(key)).encode().hex() if int(key) % 4 == 0 else "0x"

    def changes(self, key: int, ref=None):
        """The changes of an account up to a block: its nonce."""
        n = self.pointers.number(ref)
        if not self.pointers.earliest <= n <= self.pointers.latest:
            raise unavailable("requested block is not available")
        return hex(self.v.state.where((F.col("key") == int(key)) & (F.col("block") <= n) & F.col("value").isNotNull()).count())

    def fee_history(self, count, newest=None, percentiles=None):
        count = int(count, 16) if isinstance(count, str) and count[:2].lower() == "0x" else int(count)
        asked = fees.check_percentiles(list(percentiles or []))
        if count > fees.MAX_HISTORY:
            raise QueryError(-32005, f"at most {fees.MAX_HISTORY} blocks per request")
        last = self.pointers.number(newest)
        if count == 0:
            return {"oldestBlock": "0x0", "gasUsedRatio": None}
        if not self.pointers.earliest <= last <= self.pointers.latest:
            raise unavailable("requested block is not available")
        first = max(self.pointers.earliest, last - count + 1)
        near = self.v.between(first, last + 1)
        headers = near.blocks
        rows = headers.withColumn("next", fees.next_base_fee(F.col("base_fee"), F.col("gas_used"), F.col("gas_limit"))).orderBy("number").collect()  # at most 257 rows
        span = [r for r in rows if r["number"] <= last]
        follower = [r for r in rows if r["number"] == last + 1 <= self.pointers.latest]
        out = {
            "oldestBlock": hex(first),
            "baseFeePerGas": [hex(r["base_fee"] or 0) for r in span] + [hex(follower[0]["base_fee"] or 0) if follower else hex(span[-1]["next"])],
            "gasUsedRatio": [r["gas_used"] / r["gas_limit"] for r in span],
        }
        if asked:
            paid = fees.reward_percentiles(fees.fee_txs(near).where(F.col("block") <= last), headers.where(F.col("number") <= last), asked).collect()
            table = {(r["block"], r["p"]): r["reward"] for r in paid}
            out["reward"] = [[hex(table[r["number"], float(p)]) for p in asked] for r in span]
        return out

    def gas_price(self):
        return hex(fees.price_oracle(self.v).first()["gas_price"])

    def tip(self):
        return hex(fees.price_oracle(self.v).first()["tip"])

    def blob_fee(self):
        row = fees.scheduled(self.v.spark, self.v.between(self.pointers.latest, self.pointers.latest).blocks).first()
        if row is None or row["excess_blob_gas"] is None:
            return None
        return hex(fees.fake_exponential_int(row["excess_blob_gas"], row["fraction"])) if row["fraction"] else "0x0"


def _many(x) -> tuple:
    return () if x is None else tuple(x) if isinstance(x, list) else (x,)


def _sized(x: str, size: int, what: str) -> str:
    """The digits of hex data of exactly that many bytes."""
    if x[:2].lower() != "0x" or len(x) != 2 + 2 * size or any(c not in "0123456789abcdefABCDEF" for c in x[2:]):
        raise invalid_params(f"{what} must be {size} bytes of hex data")
    return x[2:]


def _address(x) -> int:
    """The view's addresses are numbers; hex data of 20 bytes stands for its number."""
    if isinstance(x, str):
        return int(_sized(x, 20, "address"), 16)
    if isinstance(x, bool) or not isinstance(x, int):
        raise invalid_params("address must be 20 bytes of hex data")
    return x


def _topic(position: int, x):
    """Topic 0 of the view is a letter, the others numbers; hex data of 32 bytes stands for either, padded left."""
    if isinstance(x, str) and x[:2].lower() == "0x":
        data = bytes.fromhex(_sized(x, 32, "topic"))
        return data.lstrip(b"\0").decode("latin-1") if position == 0 else int.from_bytes(data, "big")
    if isinstance(x, bool) or not isinstance(x, str if position == 0 else int):
        raise invalid_params("a topic must be 32 bytes of hex data")
    return x


def _render(name: str, x):
    if x is None:
        return None
    return "0x" + x if name in ("hash", "parent_hash") else hex(x)


def _sha3(_, data: str) -> str:
    try:
        return "0x" + keccak256(bytes.fromhex(data.removeprefix("0x"))).hex()
    except (ValueError, AttributeError):
        raise invalid_params("hex data required") from None


METHODS = {
    "web3_clientVersion": lambda n: "blocklens/1",
    "web3_sha3": _sha3,
    "net_version": lambda n: "1",
    "net_listening": lambda n: True,
    "rpc_modules": lambda n: {"eth": "1.0", "net": "1.0", "web3": "1.0", "debug": "1.0"},
    "eth_chainId": lambda n: "0x1",
    "eth_syncing": lambda n: False,
    "eth_accounts": lambda n: [],
    "eth_blockNumber": lambda n: hex(n.pointers.latest),
    "eth_getBlockByNumber": Node.block,
    "eth_getBlockByHash": Node.block,
    "eth_getBlockTransactionCountByNumber": Node.count,
    "eth_getBlockTransactionCountByHash": Node.count,
    "eth_getUncleCountByBlockNumber": Node.uncles,
    "eth_getUncleCountByBlockHash": Node.uncles,
    "eth_getUncleByBlockNumberAndIndex": Node.uncle,
    "eth_getUncleByBlockHashAndIndex": Node.uncle,
    "eth_getTransactionByHash": Node.transaction,
    "eth_getTransactionByBlockHashAndIndex": Node.transaction_at,
    "eth_getTransactionByBlockNumberAndIndex": Node.transaction_at,
    "eth_getTransactionReceipt": Node.receipt,
    "eth_getBlockReceipts": Node.receipts,
    "eth_getLogs": Node.logs,
    "eth_getBalance": Node.value,
    "eth_getStorageAt": Node.storage,
    "eth_getCode": Node.code,
    "eth_getTransactionCount": Node.changes,
    "eth_feeHistory": Node.fee_history,
    "eth_gasPrice": Node.gas_price,
    "eth_maxPriorityFeePerGas": Node.tip,
    "eth_blobBaseFee": Node.blob_fee,
}

