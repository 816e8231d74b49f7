"""Ingest of blocks as a stream: exactly-once live window, reorgs, promotion into the archive.

The spool is a folder of Parquet files; each micro-batch replaces its own folder of the live table, so a replay
after a failure writes the same rows again. A block sent twice, or another block of the same number after a
reorg, wins by its batch and position; rows above a reorg's ancestor go with it. Only blocks at or below the
finalized pointer are promoted, so nothing in the archive is ever retracted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blocklens.operators.layout import promotion_target
from blocklens.sources.store import Store

#: kind: block, or reorg (number: the common ancestor).
SPOOL = T.StructType([T.StructField("seq", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("number", T.LongType()), T.StructField("hash", T.StringType()), T.StructField("parent_hash", T.StringType()), T.StructField("payload", T.StringType())])
LIVE = T.StructType([*SPOOL.fields, T.StructField("batch", T.LongType())])
BLOCK = T.StructType([T.StructField("number", T.LongType()), T.StructField("hash", T.StringType()), T.StructField("parent_hash", T.StringType()), T.StructField("payload", T.StringType())])


class LiveWindow:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.store = Store(spark, f"{self.root}/archive")

    def follow(self, spool: str, files_per_batch: int = 16):
        """The streaming query that drains the spool; start() has been called, it stops when all is read."""
        rows = self.spark.readStream.schema(SPOOL).option("maxFilesPerTrigger", files_per_batch).parquet(spool)
        return rows.writeStream.foreachBatch(self._write).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()

    def _write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/live/batch={batch}")

    def rows(self) -> DataFrame:
        """All live rows, superseded ones included."""
        try:
            return self.spark.read.schema(LIVE).option("basePath", f"{self.root}/live").parquet(f"{self.root}/live")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], LIVE)

    def window(self) -> DataFrame:
        """The live chain: newest row of each number that no later reorg removed, above the archive."""
        rows = self.rows()
        order = F.struct("batch", "seq")
        reorgs = rows.where("kind = 'reorg'").select(F.col("number").alias("ancestor"), order.alias("reorged"))
        blocks = rows.where("kind = 'block'").withColumn("at", order)
        latest = blocks.groupBy("number").agg(F.max_by(F.struct("hash", "parent_hash", "payload", "at"), "at").alias("b"))
        # the newest reorg among those with an ancestor below the number: a running maximum over ancestors
        marks = latest.select("number", F.lit(1).alias("side"), "b", F.lit(None).cast(reorgs.schema["reorged"].dataType).alias("reorged")).unionByName(
            reorgs.groupBy("ancestor").agg(F.max("reorged").alias("reorged")).select((F.col("ancestor") + 1).alias("number"), F.lit(0).alias("side"), F.lit(None).cast(latest.schema["b"].dataType).alias("b"), "reorged")
        )
        seen = F.max("reorged").over(Window.orderBy("number", "side"))  # the live window: some thousand rows
        kept = marks.withColumn("last", seen).where("side = 1").where(F.col("last").isNull() | (F.col("b.at") > F.col("last")))
        return kept.where(F.col("number") > self.store.pin().archived).select("number", "b.hash", "b.parent_hash", "b.payload")

    def chain(self, pin=None) -> DataFrame:
        """Archive and live window as one snapshot."""
        pin = pin or self.store.pin()
        return self.store.read(pin, "blocks", BLOCK).unionByName(self.window().where(F.col("number") > pin.archived))

    def promote(self, finalized: int, batch: int = 256, group: int = 8, oldest_age: float = 0.0, max_age: float = 3600.0, max_batches: int = 4) -> int | None:
        """Move finalized blocks of full groups into the archive; the new archived block, or None to wait."""
        pin = self.store.pin()
        to = promotion_target(pin.archived, finalized, batch, group, oldest_age, max_age, max_batches)
        if to is None:
            return None
        rows = self.window().where(F.col("number").between(pin.archived + 1, to))
        n, broken = rows.join(rows.select((F.col("number") + 1).alias("number"), F.col("hash").alias("before")), "number", "left").agg(F.count("*"), F.count_if(F.col("before").isNotNull() & (F.col("before") != F.col("parent_hash")))).first()
        if n != to - pin.archived or broken:
            raise ValueError(f"the window has {n} of {to - pin.archived} blocks and {broken} broken links")
        segment = self.store.write("blocks", rows, pin.archived + 1, to, ["number"])
        self.store.publish(pin, [*pin.segments, segment], to)
        return to
