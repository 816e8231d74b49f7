"""Document fingerprints: canonical exact digest.

Canonical form: Unicode normalisation (NFKC), case folding, normalisation again, runs of white space to one
space, none at the ends. Its 128-bit xxhash is the bucket; inside a bucket of several documents the canonical
bytes themselves are compared, and where they differ the fingerprint gets the SHA-256 of the bytes appended.
So two documents have one fingerprint exactly if their canonical bytes are equal.

The byte comparison is a map-side combined minimum and maximum per bucket, so a bucket with a third of all
rows costs a row for each map task. Only texts whose bucket may hold several documents are sent: a bitmap of
fixed size over bucket prefixes, from counts over all documents and edited texts, says which. An edited text is
compared with its own document where it is made; one whose digest is also that of another text is made again from
the two texts it comes from, and meets the bodies of its bucket.

The next document (descending id) is found without a global sort in one task: documents are dealt into ranges of the
order (id descending, a hash of the text, place of the row) by Spark's range partitioner, which samples the keys, so
that neither outlier ids, repeated ids nor missing ids gather in one task. The last document of a range meets the
first of the range after it in a join of one row for each range.

Defined results: null text is the empty text; null ids come last (after the smallest id); rows that repeat an id
follow each other in the order of a hash of their text, equal rows in any order; equal documents are compared as
equal (likeness 1.0), others 0.0; a single document is its own next; very long texts are handled whole, one at a
time; other columns, of any name, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import unicodedata
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from blocklens.llm.common import id_bitmap, marked, materialize, ship

#: log2 of the bits of the bucket bitmap (2 MiB at 24).
PREFIX_BITS = 24
#: Bytes of text and documents of a range, about.
RANGE_BYTES, RANGE_ROWS = 1 << 24, 20_000
MADE = ["n_chars", "edited_sha256", "digest", "edited_digest", "sha", "edited_sha", "near_edited", "near_next"]
MADE_TYPES = "n_chars long, edited_sha256 string, digest string, edited_digest string, sha string, edited_sha string, near_edited double, near_next double"


def canonical(text: str) -> str:
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def digest(canon: bytes) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(canon)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def edited(text: str, following: str) -> str:
    """The last half of text replaced by the first as many code points of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def pair(text: str, canon: bytes, following: str, following_canon: bytes) -> tuple:
    """The values of MADE of a document and the one after it."""
    changed = edited(text, following)
    changed_canon = canonical(changed).encode()
    return (len(text), sha256(changed.encode()), digest(canon), digest(changed_canon), sha256(canon), sha256(changed_canon), float(changed_canon == canon), float(following_canon == canon))


def _made(rows: list, id_type) -> pa.RecordBatch:
    """Rows (part, edge, doc_id, h, next_id, next_h, body, *MADE) as a batch; edge 0: a pair, 1, 2: first and last document of a range."""
    names = ["part", "edge", "doc_id", "h", "next_id", "next_h", "body", *MADE]
    types = [pa.int32(), pa.int32(), id_type, pa.int64(), id_type, pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 5, pa.float64(), pa.float64()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, types, strict=True)], names)


def _pairs(batches, id_type):
    """The sorted rows of a range: every document with the one after it; the first and the last with their texts."""
    last, none = None, (None,) * len(MADE)
    for batch in batches:
        out = []
        for part, doc_id, h, text in zip(*(batch.column(c).to_pylist() for c in ("__part", "doc_id", "__h", "__text")), strict=True):
            canon = canonical(text).encode()
            if last is None:
                out.append((part, 1, doc_id, h, None, None, text, *none))
            else:
                _, before_id, before_h, before, before_canon = last
                out.append((part, 0, before_id, before_h, doc_id, h, None, *pair(before, before_canon, text, canon)))
            last = (part, doc_id, h, text, canon)
        yield _made(out, id_type)
    if last is not None:
        yield _made([(last[0], 2, last[1], last[2], None, None, last[3], *none)], id_type)


def _seams(batches, id_type):
    """Rows of the last document of a range and the first of the next -> their pairs."""
    for batch in batches:
        out = []
        for part, doc_id, h, text, next_id, next_h, following in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "h", "body", "next_id", "next_h", "next_body")), strict=True):
            out.append((part, 0, doc_id, h, next_id, next_h, None, *pair(text, canonical(text).encode(), following, canonical(following).encode())))
        yield _made(out, id_type)


def _canon(batches, bitmap):
    """(bucket, canonical bytes) of the documents whose bucket prefix is in the shared bitmap."""
    bits = np.frombuffer(bitmap.value, np.uint8)
    for batch in batches:
        buckets, bodies = [], []
        for text in batch.column("__text").to_pylist():
            canon = canonical(text).encode()
            bucket = digest(canon)
            p = int(bucket[: PREFIX_BITS // 4], 16)
            if bits[p >> 3] >> (p & 7) & 1:
                buckets.append(bucket)
                bodies.append(canon)
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.string()), pa.array(bodies, pa.binary())], ["digest", "body"])


def _edited_canon(batches):
    """Rows (digest, text, following) -> (digest, canonical bytes of the edited text)."""
    for batch in batches:
        bodies = [canonical(edited(t, f)).encode() for t, f in zip(batch.column("text").to_pylist(), batch.column("following").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(bodies, pa.binary())], ["digest", "body"])


def repeated(digests: DataFrame) -> DataFrame:
    """digest of the buckets with several rows."""
    return materialize(digests.groupBy("digest").count().where("count > 1").select("digest"))


def prefix_bitmap(several: DataFrame) -> bytes:
    """A bitmap of fixed size of the prefixes of buckets."""
    prefix = F.conv(F.substring("digest", 1, PREFIX_BITS // 4), 16, 10).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 32).cast("int"))
    lanes = several.select(prefix.alias("p")).groupBy(F.floor(F.col("p") / 32).alias("lane")).agg(F.bit_or(bit).alias("bits")).toPandas()  # at most 2^19 rows
    words = np.zeros(1 << (PREFIX_BITS - 5), np.uint32)
    words[lanes["lane"].to_numpy(np.int64)] = lanes["bits"].to_numpy(np.int64).astype(np.uint32)
    return words.tobytes()


def differing(bodies: DataFrame) -> DataFrame:
    """digest of the buckets that hold different canonical bytes; bodies: (digest, body). Combined map side."""
    return bodies.groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("most")).where("least <> most").select("digest")


def collisions(texts: DataFrame, made: DataFrame) -> DataFrame:
    """digest of the buckets that hold different canonical bytes, of documents or of edited texts.

    texts: doc_id, __text, __h; made: a row (doc_id, h, next_id, next_h, digest, edited_digest, near_edited) for each document.
    """
    changed = made.where("near_edited = 0").select(F.col("edited_digest").alias("digest"))  # the others are compared already
    several = repeated(made.select("digest").unionByName(changed))
    if several.isEmpty():
        return several
    shared = made.sparkSession.sparkContext.broadcast(prefix_bitmap(several))  # fixed size
    bodies = texts.mapInArrow(partial(_canon, bitmap=shared), "digest string, body binary")
    asked = made.where("near_edited = 0").join(several.withColumnRenamed("digest", "edited_digest"), "edited_digest", "left_semi")
    asked = materialize(asked.select(F.col("edited_digest").alias("digest"), "doc_id", "h", "next_id", "next_h").distinct())
    if not asked.isEmpty():
        key = F.xxhash64("doc_id", "h")
        ends = asked.select("doc_id", "h").unionByName(asked.select(F.col("next_id").alias("doc_id"), F.col("next_h").alias("h"))).distinct()
        near = texts.withColumnRenamed("__h", "h").where(marked(key, id_bitmap(ends.select(key.alias("doc_id")))))
        same = lambda x, y: [F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{y}.doc_id")), F.col(f"{x}.h") == F.col(f"{y}.h")]
        near = materialize(near.alias("t").join(ends.alias("e"), same("t", "e"), "left_semi").groupBy("doc_id", "h").agg(F.min("__text").alias("text")))
        first, second = (near.select(F.col("doc_id").alias(f"{x}_id"), F.col("h").alias(f"{x}_h"), F.col("text").alias(f"{x}_text")) for x in "ab")
        met = asked.join(first, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("h") == F.col("a_h"))).join(second, F.col("next_id").eqNullSafe(F.col("b_id")) & (F.col("next_h") == F.col("b_h")))
        bodies = bodies.unionByName(met.select("digest", F.col("a_text").alias("text"), F.col("b_text").alias("following")).mapInArrow(_edited_canon, "digest string, body binary"))
    return differing(bodies)


def ranges(docs: DataFrame, range_bytes: int = RANGE_BYTES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, __text, __h, __part of docs (doc_id, __text, __h), dealt and sorted by the order of documents."""
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("__text"))).first()
    parts = max(1, math.ceil((size or 0) / range_bytes), math.ceil(n / range_rows))
    order = [F.col("doc_id").desc_nulls_last(), F.col("__h"), F.col("__at")]
    placed = docs.withColumn("__at", F.monotonically_increasing_id())
    return placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "__text", "__h", F.spark_partition_id().alias("__part"))


def fingerprints(docs: DataFrame, range_bytes: int = RANGE_BYTES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    ship(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("__text")).withColumn("__h", F.xxhash64("__text"))
    kind, id_type = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)
    schema = f"part int, edge int, doc_id {kind}, h long, next_id {kind}, next_h long, body string, {MADE_TYPES}"
    inside = materialize(ranges(texts, range_bytes, range_rows).mapInArrow(partial(_pairs, id_type=id_type), schema))
    # a row for each range: which range comes after it, the first after the last
    firsts = inside.where("edge = 1")
    after = firsts.select("part").withColumn("to", F.lead("part").over(Window.orderBy("part"))).select("part", F.coalesce("to", F.min("part").over(Window.partitionBy())).alias("to"))
    heads = firsts.select(F.col("part").alias("to"), F.col("doc_id").alias("next_id"), F.col("h").alias("next_h"), F.col("body").alias("next_body"))
    ends = inside.where("edge = 2").select("part", "doc_id", "h", "body").join(after, "part").join(heads, "to")
    seams = materialize(ends.mapInArrow(partial(_seams, id_type=id_type), schema))
    made = inside.where("edge = 0").unionByName(seams)
    odd = materialize(collisions(texts, made))
    named = lambda digest, sha, odd: F.when(F.col(odd).isNotNull(), F.concat_ws("-", digest, sha)).otherwise(F.col(digest))
    return (
        made.join(odd.withColumnRenamed("digest", "__odd"), F.col("digest") == F.col("__odd"), "left")
        .join(odd.withColumnRenamed("digest", "__eodd"), F.col("edited_digest") == F.col("__eodd"), "left")
        .select("doc_id", "n_chars", "edited_sha256", named("digest", "sha", "__odd").alias("fingerprint"), named("edited_digest", "edited_sha", "__eodd").alias("edited_fingerprint"), "near_edited", "near_next")
    )
