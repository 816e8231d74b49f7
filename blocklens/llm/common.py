"""What the operators of this subpackage share: reading, materialising and shipping code to workers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder that holds the package; workers of a local session find the package here.
ROOT = str(Path(__file__).resolve().parents[2])

#: Rows of an Arrow batch between Spark and Python, at most.
ROWS_AT_ONCE = 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, also when the driver runs in another folder.

    On a cluster the package is installed or sent with --py-files; the extra path is then harmless.
    """
    # whole texts are long: batches of fewer rows bound the memory of a worker
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(batch)) <= ROWS_AT_ONCE:
        spark.conf.set(batch, ROWS_AT_ONCE)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset a local one of our own in local mode, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="blocklens-checkpoints-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def free_name(df: DataFrame, name: str) -> str:
    """A column name like __name that df has not, upper and lower case alike."""
    taken = {c.lower() for c in df.columns}
    out = f"__{name}"
    while out.lower() in taken:
        out += "_"
    return out


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is already gone
        pass


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors.

    The files stay until the driver ends, as frames returned to callers may still read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/blocklens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id, modulus: int, remainder: int):
    """True where crc32 of doc_id written as text leaves `remainder`; false for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


#: log2 of the bits of an id bitmap (128 KiB).
BITMAP_BITS = 20


def id_bitmap(ids: DataFrame, column: str = "doc_id") -> bytes:
    """A bitmap of fixed size of the ids modulo its bits, for in_bitmap() and marked().

    It spares a shuffle of texts where few are wanted; a join with ids afterwards makes it exact.
    """
    place = F.pmod(F.col(column), F.lit(1 << BITMAP_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 32).cast("int"))
    bits = bytearray(1 << (BITMAP_BITS - 3))
    for at, word in ids.groupBy(F.floor(place / 32).alias("at")).agg(F.bit_or(bit).alias("word")).collect():  # at most 2^15 rows
        bits[4 * at : 4 * at + 4] = word.to_bytes(4, "little")
    return bytes(bits)


def in_bitmap(ids: np.ndarray, bitmap: bytes) -> np.ndarray:
    """True for all ids of the bitmap and few others, in a worker."""
    place = ids & ((1 << BITMAP_BITS) - 1)
    return np.frombuffer(bitmap, np.uint8)[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1


_KEPT: dict = {}


def kept(key, make):
    """The object of this worker process under key, made if it is missing.

    A worker keeps one such table at a time: workers outlive the stages of a job, and the tables of one stage
    must not add to the memory of the next.
    """
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Give back the memory of the table of an earlier stage."""
    if _KEPT:
        _KEPT.clear()
        trim()


def trim() -> None:
    """Give back freed memory to the system."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps the pages
        ctypes.CDLL(None).malloc_trim(0)


def marked(key: Column, bitmap: bytes) -> Column:
    """True for all keys (longs) of an id bitmap and few others. The bitmap becomes part of the plan: for rare use."""
    place = F.pmod(key, F.lit(1 << BITMAP_BITS))
    byte = F.conv(F.hex(F.substring(F.lit(bytearray(bitmap)), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(1) == 1


#: Rows of one key beyond which a join deals the key to SPREAD tasks.
HOT = 1 << 20
SPREAD = 64


def join_split(rows: DataFrame, table: DataFrame, key: str, hot: int = HOT, spread: int = SPREAD) -> DataFrame:
    """rows left-joined with table, which has one row for each key; keys of more than `hot` rows are dealt to `spread` tasks.

    The hot keys are marked in a bitmap of fixed size over their hashes; all keys of a marked hash are dealt alike.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > hot)
    bitmap = id_bitmap(counts.select(F.xxhash64(key).alias("doc_id")))
    if not any(bitmap):
        return rows.join(table, key, "left")
    salt, is_hot = free_name(rows, "salt"), marked(F.xxhash64(key), bitmap)
    others = [F.col(c) for c in rows.columns if c != key]
    dealt = rows.withColumn(salt, F.when(is_hot, F.pmod(F.xxhash64(F.lit(1), *others), F.lit(spread))).otherwise(F.lit(0)).cast("int"))
    copies = table.withColumn(salt, F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [key, salt], "left").drop(salt)


#: Word separators of the contracts: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
