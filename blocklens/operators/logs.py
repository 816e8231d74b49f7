"""Log filters: exact scan, inverted index with exact residual, bloom admission, refusal limits."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blocklens.plans.errors import Refused, invalid_params
from blocklens.registry import query
from blocklens.sources.chainview import numbered_logs

MAX_RANGE, MAX_BLOCKS, MAX_LOGS = 10_000, 1_000, 10_000
#: Blocks of an index partition.
PARTITION = 65_536


@dataclass(frozen=True)
class LogFilter:
    """Blocks first..last; any of addresses (none: any); per position any of the values (None: any)."""

    first: int
    last: int
    addresses: tuple = ()
    topics: tuple = field(default=())

    def __post_init__(self):
        if len(self.topics) > 4:
            raise invalid_params("at most 4 topic positions")

    def groups(self) -> list[tuple[str, tuple]]:
        """(column, accepted values) of every condition besides the range."""
        out = [("address", tuple(self.addresses))] if self.addresses else []
        return out + [(f"topic{i}", tuple(t)) for i, t in enumerate(self.topics) if t]

    def condition(self) -> Column:
        """The exact predicate; a log without a topic at a filtered position does not match."""
        parts = [F.col("block").between(self.first, self.last)] + [F.col(c).isin(*values) for c, values in self.groups()]
        return reduce(lambda a, b: a & b, parts)


def scan(logs: DataFrame, f: LogFilter) -> DataFrame:
    """All logs of the filter out of numbered logs."""
    return logs.where(f.condition())


def near_logs(v, f: LogFilter, blocks: DataFrame | None = None) -> DataFrame:
    """Numbered logs of the blocks of the filter's range that have a matching log (or are among `blocks`), and of no others.

    The range is one of keys and the conditions are on columns of the table, so both reach the scan; numbering, which
    needs all logs of a block, shuffles the blocks with a match alone.
    """
    near = v.between(f.first, f.last)
    if blocks is None:
        if not f.groups():
            return near.logs
        blocks = near.raw_logs.where(f.condition()).select("block").distinct()
    return numbered_logs(near.raw_logs.join(blocks, "block", "left_semi"))


def pruned_scan(v, f: LogFilter) -> DataFrame:
    """All logs of the filter, by way of the blocks that match."""
    return scan(near_logs(v, f), f)


def index_entries(raw_logs: DataFrame, fields=("address", "topic0", "topic1", "topic2")) -> DataFrame:
    """Distinct (partition, tag, key, block) of every indexed value; keys are prefixes of a digest of tag and value."""
    tagged = F.explode(F.array(*[F.struct(F.lit(c).alias("tag"), F.col(c).cast("string").alias("value")) for c in fields]))
    rows = raw_logs.select("block", tagged.alias("e")).where("e.value is not null").select("block", "e.tag", "e.value").distinct()
    return rows.select(F.floor(F.col("block") / PARTITION).alias("part"), "tag", index_key(F.col("tag"), F.col("value")).alias("key"), "block").distinct()


def index_key(tag: Column, value: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws(":", tag, value), 256), 1, 12), 16, 10).cast("long")


def candidates(index: DataFrame, f: LogFilter) -> DataFrame | None:
    """Blocks that may hold matching logs: union inside a group, intersection across groups. None: all blocks."""
    found = None
    for tag, values in f.groups():
        keys = index.sparkSession.createDataFrame([(str(v),) for v in values], "value string").select(index_key(F.lit(tag), F.col("value")).alias("key"))
        parts = F.col("part").between(f.first // PARTITION, f.last // PARTITION)
        hit = index.where(parts & (F.col("tag") == tag) & F.col("block").between(f.first, f.last)).join(keys, "key", "left_semi").select("block").distinct()
        found = hit if found is None else found.join(hit, "block", "left_semi")
    return found


def indexed_scan(v, index: DataFrame, f: LogFilter) -> DataFrame:
    """The same rows as pruned_scan, by way of the index: only the blocks that it names are read."""
    return scan(near_logs(v, f, candidates(index, f)), f)


def fitting_last(counts: DataFrame, first: int, limit: int) -> int | None:
    """The last block so that first..last holds at most `limit` rows; counts: (block, n). None: nothing fits."""
    running = F.sum("n").over(Window.orderBy("block"))
    over = counts.withColumn("total", running).where(F.col("total") > limit).agg(F.min("block")).first()[0]
    return over - 1 if over is not None and over > first else None


def checked(logs: DataFrame, f: LogFilter, max_logs: int = MAX_LOGS, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """scan, refused (never cut) beyond the limits; the refusal names the range that fits.

    One sorted scan of at most max_logs + 1 rows tells whether the limits hold; only a refusal counts blocks.
    """
    if f.last - f.first + 1 > MAX_RANGE:
        raise Refused(f"a query spans at most {MAX_RANGE} blocks", f.first, f.first + MAX_RANGE - 1)
    found = scan(logs, f)
    head = found.orderBy("block", "tx_index", "log_index").limit(max_logs + 1).agg(F.count("*"), F.countDistinct("block")).first()
    if head[0] <= max_logs and head[1] <= max_blocks:
        return found
    counts = found.groupBy("block").agg(F.count("*").alias("n"))  # a row for each block of the range
    blocks = counts.count()
    if blocks > max_blocks:
        raise Refused(f"the query reads more than {max_blocks} blocks", f.first, fitting_last(counts.select("block", F.lit(1).alias("n")), f.first, max_blocks))
    raise Refused(f"the answer holds more than {max_logs} logs", f.first, fitting_last(counts, f.first, max_logs))


def bloom_bits(tag_value: Column) -> Column:
    """Three of 2,048 bit positions of a value."""
    digest = F.sha2(tag_value, 256)
    return F.array(*[(F.conv(F.substring(digest, 1 + 4 * i, 4), 16, 10).cast("int") % 2048) for i in range(3)])


def block_blooms(raw_logs: DataFrame, fields=("address", "topic0", "topic1", "topic2")) -> DataFrame:
    """block, lanes: the OR of the bits of all indexed values."""
    value = F.explode(F.array(*[F.concat_ws(":", F.lit(c), F.col(c).cast("string")) for c in fields]))
    return blooms(raw_logs.select("block", value.alias("x")), "block")


def blooms(values: DataFrame, key: str) -> DataFrame:
    """key, lanes: 32 lanes of 64 bits, the OR of the bits of all values x of a key; one combinable aggregation."""
    bits = values.select(key, "x").distinct().select(key, F.explode(bloom_bits(F.col("x"))).alias("bit"))
    lane = F.floor(F.col("bit") / 64)
    word = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))
    return bits.groupBy(key).agg(*[F.coalesce(F.bit_or(F.when(lane == i, word)), F.lit(0).cast("long")).alias(f"lane{i}") for i in range(32)])


def admitted(blooms: DataFrame, f: LogFilter) -> DataFrame:
    """Blocks whose bloom admits the filter: every group must have a value with all its bits."""
    import hashlib

    def bits(tag, value):
        h = hashlib.sha256(f"{tag}:{value}".encode()).hexdigest()
        return [int(h[4 * i : 4 * i + 4], 16) % 2048 for i in range(3)]

    def has(bit):
        return F.getbit(F.col(f"lane{bit // 64}"), F.lit(bit % 64)) == 1

    every = [reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [has(bit) for bit in bits(tag, v)]) for v in values]) for tag, values in f.groups()]
    out = blooms.where(F.col("block").between(f.first, f.last))
    return out.where(reduce(lambda a, b: a & b, every)) if every else out


_COLUMNS = "block, tx_index, log_index, address, topic0, topic1, topic2, data"
BY_ADDRESS = LogFilter(10, 60, addresses=(7, 11))
BY_TOPIC = LogFilter(0, 40, topics=(("R",),))
BY_BOTH = LogFilter(0, 100, addresses=(3, 4, 5, 6), topics=(("A", "N"), None, (1, 2, 3)))


@query("SF50 WN02 PR08 SO03", f"SELECT {_COLUMNS} FROM logs", "logs")
def chain_logs(v):
    return v.logs


@query("FL01 FL03 SO03", f"SELECT {_COLUMNS} FROM logs WHERE block BETWEEN 10 AND 60 AND address IN (7, 11)", "logs")
def logs_by_address(v):
    return pruned_scan(v, BY_ADDRESS).orderBy("block", "tx_index", "log_index")


@query("FL01", f"SELECT {_COLUMNS} FROM logs WHERE block BETWEEN 0 AND 40 AND topic0 = 'R'", "logs")
def logs_by_topic0(v):
    return pruned_scan(v, BY_TOPIC)


@query("FL01 FL02", f"SELECT {_COLUMNS} FROM logs WHERE block BETWEEN 0 AND 100 AND address IN (3, 4, 5, 6) AND topic0 IN ('A', 'N') AND topic2 IN (1, 2, 3)", "logs")
def logs_by_address_and_topics(v):
    return pruned_scan(v, BY_BOTH)


@query("AG21 ST01 ST02 FL01 FL09", f"SELECT {_COLUMNS} FROM logs WHERE block BETWEEN 0 AND 100 AND address IN (3, 4, 5, 6) AND topic0 IN ('A', 'N') AND topic2 IN (1, 2, 3)", "logs")
def logs_via_index(v):
    return indexed_scan(v, index_entries(v.between(BY_BOTH.first, BY_BOTH.last).raw_logs), BY_BOTH)


@query("FL04 PR11", f"SELECT {_COLUMNS} FROM logs WHERE block BETWEEN 0 AND 100 AND address IN (3, 4, 5, 6) AND topic0 IN ('A', 'N') AND topic2 IN (1, 2, 3)", "logs")
def logs_via_bloom(v):
    blooms = block_blooms(v.between(BY_BOTH.first, BY_BOTH.last).raw_logs)
    return scan(near_logs(v, BY_BOTH, admitted(blooms, BY_BOTH).select("block")), BY_BOTH)


@query(
    "AG21",
    """WITH f AS (SELECT block, unnest(['address', 'topic0', 'topic1', 'topic2']) AS tag, unnest([CAST(address AS VARCHAR), topic0, CAST(topic1 AS VARCHAR), CAST(topic2 AS VARCHAR)]) AS value FROM raw_logs),
e AS (SELECT DISTINCT block // 65536 AS part, tag, CAST(('0x' || substr(sha256(tag || ':' || value), 1, 12)) AS BIGINT) AS key, block FROM f WHERE value IS NOT NULL)
SELECT part, tag, key, count(*) AS n, min(block) AS first, max(block) AS last, string_agg(CAST(block AS VARCHAR), ',' ORDER BY block) AS blocks FROM e GROUP BY part, tag, key""",
    "raw_logs",
)
def log_index_postings(v):
    postings = F.array_sort(F.collect_list("block"))
    return (
        index_entries(v.raw_logs).groupBy("part", "tag", "key")
        .agg(F.count("*").alias("n"), F.min("block").alias("first"), F.max("block").alias("last"), F.array_join(F.transform(postings, lambda b: b.cast("string")), ",").alias("blocks"))
    )


@query("ST01 ST02", "SELECT block FROM raw_logs WHERE address IN (1, 2) INTERSECT SELECT block FROM raw_logs WHERE topic1 < 40", "raw_logs")
def candidate_blocks(v):
    f = LogFilter(0, 1 << 40, addresses=(1, 2), topics=(None, tuple(range(40))))
    return candidates(index_entries(v.raw_logs), f)


@query("SO04", "WITH c AS (SELECT block, count(*) AS n FROM raw_logs WHERE topic0 = 'R' GROUP BY block), r AS (SELECT block, n, CAST(sum(n) OVER (ORDER BY block) AS BIGINT) AS total FROM c) SELECT (SELECT CAST(sum(n) AS BIGINT) FROM c) AS logs, (SELECT min(block) - 1 FROM r WHERE total > 1000) AS fits_to", "raw_logs")
def logs_fitting_range(v):
    from blocklens.operators.windows import running_total

    counts = v.raw_logs.where("topic0 = 'R'").groupBy("block").agg(F.count("*").alias("n"))
    total = running_total(counts, "block", "n", "before").withColumn("total", F.col("before") + F.col("n"))
    return total.agg(F.sum("n").alias("logs"), (F.min(F.when(F.col("total") > 1000, F.col("block"))) - 1).alias("fits_to"))


@query("AG27 ST01", "SELECT tag, key, count(*) AS n FROM (SELECT DISTINCT tag, key, block FROM (SELECT block, 'address' AS tag, address AS key FROM raw_logs WHERE block < 60 UNION ALL SELECT block, 'address', address FROM raw_logs WHERE block >= 40)) GROUP BY tag, key", "raw_logs")
def index_merge(v):
    half = lambda c: v.raw_logs.where(c).select(F.lit("address").alias("tag"), F.col("address").alias("key"), "block").distinct()
    return half("block < 60").unionByName(half("block >= 40")).distinct().groupBy("tag", "key").agg(F.count("*").alias("n"))


@query("FL01 AG01", "SELECT block, count(*) AS logs, count(*) FILTER (WHERE topic2 IS NULL) AS short_logs, count(DISTINCT address) AS addresses FROM raw_logs GROUP BY block", "raw_logs")
def logs_per_block(v):
    return v.raw_logs.groupBy("block").agg(F.count("*").alias("logs"), F.count_if(F.col("topic2").isNull()).alias("short_logs"), F.countDistinct("address").alias("addresses"))
