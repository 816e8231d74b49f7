"""A snapshot store: immutable Parquet objects listed by numbered manifests.

A manifest is created only if its number is free, so publishing generation n + 1 is a compare-and-set on n: of
two writers one fails and starts again from the newest. Readers pin one manifest; as objects never change, a
pinned reader repeats its reads whatever is published meanwhile. All files go through Spark's file system.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(Exception):
    """Another writer published this generation."""


@dataclass(frozen=True)
class Segment:
    kind: str
    path: str
    first: int
    last: int


@dataclass(frozen=True)
class Manifest:
    generation: int = 0
    archived: int = -1
    segments: tuple[Segment, ...] = field(default=())

    def of(self, kind: str, first: int = 0, last: int = 1 << 62) -> list[Segment]:
        """Segments of a kind that overlap the range: pruning by the manifest alone."""
        return [s for s in self.segments if s.kind == kind and s.first <= last and s.last >= first]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [x.getPath().getName() for x in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def put(self, name: str, data: bytes) -> bool:
        """Create an object; False if it exists with the same bytes; Conflict if it exists with others."""
        path = self._path(name)
        try:
            out = self._fs.create(path, False)
        except Exception as e:
            if "exist" not in str(e).lower():
                raise
            if self.get(name) != data:
                raise Conflict(name) from None
            return False
        out.write(bytearray(data))
        out.close()
        return True

    def get(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def pin(self) -> Manifest:
        """The newest manifest."""
        numbers = [int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return Manifest()
        raw = json.loads(self.get(f"manifests/{max(numbers):012d}.json"))
        return Manifest(raw["generation"], raw["archived"], tuple(Segment(**s) for s in raw["segments"]))

    def publish(self, base: Manifest, segments: list[Segment], archived: int) -> Manifest:
        """Generation after base with these segments; Conflict if base is not the newest any more."""
        new = Manifest(base.generation + 1, archived, tuple(sorted(segments, key=lambda s: (s.kind, s.first))))
        try:
            made = self.put(f"manifests/{new.generation:012d}.json", json.dumps(asdict(new), sort_keys=True).encode())
        except Conflict:
            raise Conflict(f"generation {new.generation} exists") from None
        if not made:
            raise Conflict(f"generation {new.generation} exists")
        return new

    def write(self, kind: str, df: DataFrame, first: int, last: int, sort: list[str]) -> Segment:
        """An immutable object of df, sorted inside its files so that row groups prune; Bloom filters on the first key."""
        name = f"{kind}/{first:012d}-{last:012d}-{uuid.uuid4().hex[:12]}"
        df.repartitionByRange(*sort).sortWithinPartitions(*sort).write.mode("errorifexists").option(f"parquet.bloom.filter.enabled#{sort[0]}", "true").parquet(f"{self.root}/{name}")
        return Segment(kind, name, first, last)

    def read(self, pin: Manifest, kind: str, schema: T.StructType, first: int = 0, last: int = 1 << 62) -> DataFrame:
        """Rows of the pinned objects of a kind that overlap the range."""
        paths = [f"{self.root}/{s.path}" for s in pin.of(kind, first, last)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def garbage(self, pin: Manifest, unreferenced_since: DataFrame, now: int, keep_seconds: int = 7 * 86_400) -> DataFrame:
        """path, due of objects that no segment names and whose time is up; unreferenced_since: (path, at)."""
        named = self.spark.createDataFrame([(s.path,) for s in pin.segments], "path string")
        return unreferenced_since.join(named, "path", "left_anti").select("path", (F.col("at") + keep_seconds).alias("due")).where(F.col("due") <= now)

    def merge(self, base: Manifest, kind: str, run: list[Segment], schema: T.StructType, sort: list[str]) -> Manifest:
        """Compaction: the run of a kind replaced by one object with the union of its rows."""
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in run]).distinct()
        merged = self.write(kind, rows, min(s.first for s in run), max(s.last for s in run), sort)
        return self.publish(base, [s for s in base.segments if s not in run] + [merged], base.archived)
