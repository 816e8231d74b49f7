"""A Python data source over a numeric range: one partition for each stretch, for sources that answer by range.

spark.read.format("block_ranges").option("first", ..).option("last", ..).option("stretch", ..).load()
"""

from __future__ import annotations

import hashlib

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Stretch(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class BlockRanges(DataSource):
    """Headers of deterministic test blocks; a subclass answers `rows` from its own endpoint."""

    @classmethod
    def name(cls) -> str:
        return "block_ranges"

    def schema(self) -> str:
        return "number long, hash string, parent_hash string"

    def reader(self, schema):
        return RangeReader(self.options)


class RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.first, self.last = int(options.get("first", 0)), int(options["last"])
        self.stretch = max(1, int(options.get("stretch", 1000)))

    def partitions(self):
        return [Stretch(a, min(self.last, a + self.stretch - 1)) for a in range(self.first, self.last + 1, self.stretch)]

    def read(self, partition: Stretch):
        for n in range(partition.first, partition.last + 1):
            yield n, _name(n), _name(n - 1)


def _name(n: int) -> str:
    return hashlib.sha256(f"block{n}".encode()).hexdigest()
