"""SimHash near-duplicates by meet-in-the-middle ball hashing, and connected components of the links.

Two fingerprints within radius 2r have a common point within r of both. Every distinct fingerprint emits all
its variants with at most r flipped bits; fingerprints that share a variant are within 2r of each other, and
all pairs within 2r share one. Variants are shuffled by a linear hash of their bits (the parities of B groups
of positions): equal variants have equal hashes, and all variants of a fingerprint with one hash are the
fingerprint with one class of flips, so one row carries a whole class and is unfolded after the shuffle.
B grows with the number of fingerprints, so that a task's share stays bounded; parities spread a dense ball of
near copies over all hashes, and a group too large for one go is worked off in slices of its variants.

Inside a shuffle group equal variants are found by sorting; each set of fingerprints with one variant gives
links from its smallest member to the others (verified by counting the differing bits), which keeps all
connections without the square of the set. Links are deduplicated and components found by alternating
large-star and small-star steps, each written to the shared folder.

Defined results: null text has no words; no words: fingerprint zero, linked like any other; fewer words than a
shingle: the whole sequence is the one shingle; repeated rows share fingerprint and component; rows with null
id keep a fingerprint, the component is the smallest non-null id (null if there is none); other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens.llm.common import HOT, join_split, materialize, ship

BITS = 64
SEED = 42
#: Distinct fingerprints for each value of the variant hash.
PER_GROUP = 2048
#: Variants unfolded at once.
AT_ONCE = 1 << 20
#: One bit of each byte.
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased (A-Z) text, repeats included."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    hashed = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([hashed(b" ".join(found), seed)], np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(found) - words] + 1))
    return np.array([hashed(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of sets that stand in a row in `hashes`: a bit is 1 if set in over half a set's hashes."""
    out = np.zeros(len(sizes), np.uint64)
    there = np.flatnonzero(sizes)
    if not len(there):
        return out
    n = sizes[there]
    pieces = -(-n // 255)  # a byte counts to 255
    firsts, begins = np.cumsum(n) - n, np.cumsum(pieces) - pieces
    starts = np.repeat(firsts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(begins, pieces))
    counts = np.empty((len(n), BITS), np.int64)
    for bit in range(8):
        lanes = (hashes >> np.uint64(bit)) & LANES  # eight counters, a byte each
        bytes_ = np.add.reduceat(lanes, starts).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts[:, bit::8] = np.add.reduceat(bytes_, begins, axis=0, dtype=np.int64)
    out[there] = np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def in_rows(sets: list[np.ndarray], at_once: int = 1 << 18):
    """Stretches of about at_once hashes: (hashes in a row, sizes of the sets)."""
    part, total = [], 0
    for i, x in enumerate(sets):
        part.append(x)
        total += len(x)
        if total >= at_once or i == len(sets) - 1:
            yield np.concatenate(part), np.fromiter(map(len, part), np.int64, len(part))
            part, total = [], 0


def _fingerprints(batches, words: int, seed: int):
    for batch in batches:
        sets = [shingle_hashes(t, words, seed) for t in batch.column("__text").to_pylist()]
        marks = [majorities(*x) for x in in_rows(sets)]
        signed = np.concatenate([np.empty(0, np.uint64), *marks]).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(signed, pa.int64())], ["doc_id", "fp"])


def simhashes(docs: DataFrame, words: int = 4, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long)."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").alias("__text")).mapInArrow(partial(_fingerprints, words=words, seed=seed), f"doc_id {kind}, fp long")


# --- variants -----------------------------------------------------------------------------------------------


@lru_cache(maxsize=8)
def flips(parities: int, radius: int) -> list[tuple[int, np.ndarray]]:
    """(change of the hash, the flips that make it), for all flips of at most `radius` bits.

    Position p belongs to parity p mod `parities`.
    """
    out: dict[int, list[int]] = {}
    for r in range(radius + 1):
        for positions in combinations(range(BITS), r):
            change = flip = 0
            for p in positions:
                change ^= 1 << p % parities
                flip |= 1 << p
            out.setdefault(change, []).append(flip)
    return [(change, np.array(out[change], np.uint64)) for change in sorted(out)]


def variant_hash(fp, parities: int):
    """The parities of the bits of a fingerprint column."""
    out = F.lit(0)
    for j in range(parities):
        mask = sum(1 << p for p in range(j, BITS, parities))
        mask -= (mask >> 63) << 64
        out = out.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseAND(F.lit(mask).cast("long"))) % 2, j))
    return out


#: Sets of bits whose parities deal the variants of a group to slices: linear, so a flip's slice is known beforehand.
_DEALT = np.random.default_rng(SEED).integers(0, 1 << 63, 40, dtype=np.uint64)


def _slice_of(values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for j in range(n):
        out |= (np.bitwise_count(values & _DEALT[j]).astype(np.int64) & 1) << j
    return out


def shared_variants(changes: np.ndarray, fps: np.ndarray, classes: list[tuple[int, np.ndarray]]):
    """Of the fingerprints of one variant hash, slice by slice: the variants that several rows have, and place (of the
    variant) and row of each that has one.

    A slice holds about AT_ONCE variants. Every variant is made once, in its slice: the slice of fingerprint and flip
    together is the exclusive or of theirs.
    """
    total = sum(int((changes == c).sum()) * len(masks) for c, (_, masks) in enumerate(classes))
    n = max(0, math.ceil(math.log2(max(1, total) / AT_ONCE)))
    own = _slice_of(fps, n)
    parts = []
    for c, (_, masks) in enumerate(classes):
        at = np.flatnonzero(changes == c)
        if len(at):
            moves = _slice_of(masks, n)
            rows = {g: at[own[at] == g] for g in np.unique(own[at]).tolist()}
            parts.append((rows, [(y, masks[moves == y]) for y in np.unique(moves).tolist()]))
    for s in range(1 << n):
        variants, owners = [], []
        for rows, flipped in parts:
            for y, masks in flipped:
                who = rows.get(s ^ y)
                if who is not None:
                    variants.append((fps[who][:, None] ^ masks[None, :]).ravel())
                    owners.append(np.repeat(who.astype(np.int32), len(masks)))
        if not variants:
            continue
        v, o = np.concatenate(variants), np.concatenate(owners)
        ordered = np.sort(v)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(again):
            continue
        shared = again[np.concatenate(([True], again[1:] != again[:-1]))]
        # a bitmap spares the search for most of the others
        mixed = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
        bits = np.zeros(1 << 20, bool)
        bits[mixed(shared)] = True
        near = np.flatnonzero(bits[mixed(v)])
        place = np.minimum(np.searchsorted(shared, v[near]), len(shared) - 1)
        hit = shared[place] == v[near]
        yield shared, place[hit], o[near[hit]]


def _group_links(changes: np.ndarray, fps: np.ndarray, parities: int, radius: int) -> np.ndarray:
    """Verified, deduplicated links of one variant hash: rows (a, b), from the smallest owner of each variant to the others."""
    found = [np.empty((0, 2), np.uint64)]
    for _, place, row in shared_variants(changes, fps, flips(parities, radius)):
        who = fps[row]
        order = np.lexsort((who, place))
        place, who = place[order], who[order]
        first = np.concatenate(([True], place[1:] != place[:-1]))
        least = who[first][np.cumsum(first) - 1]
        near = (least != who) & (np.bitwise_count(least ^ who) <= 2 * radius)
        found.append(np.unique(np.stack([least[near], who[near]], axis=1), axis=0))
    return _spanning(np.unique(np.concatenate(found), axis=0))


def _spanning(links: np.ndarray) -> np.ndarray:
    """A spanning forest of the links, so that a dense ball leaves no more rows than it has members."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    kept = []
    for i, (a, b) in enumerate(links.tolist()):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept.append(i)
    return links[kept]


def _links(batches, parities: int, radius: int):
    """Rows sorted by hash -> links, hash by hash."""
    key, changes, fps = None, [], []

    def done():
        links = _group_links(np.concatenate(changes), np.concatenate(fps), parities, radius).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    for batch in batches:
        keys = batch.column("h").to_numpy()
        c, f = batch.column("c").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        if not len(keys):
            continue
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if key is not None and keys[lo] != key:
                yield done()
                changes, fps = [], []
            key = keys[lo]
            changes.append(c[lo:hi])
            fps.append(f[lo:hi])
    if key is not None:
        yield done()


def ball_links(fps: DataFrame, n: int, radius: int = 2) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp, n of them) that differ in at most 2 x radius bits.

    A spanning subset: its components are those of all links.
    """
    parities = min(32, max(6, math.ceil(math.log2(max(1, n) / PER_GROUP))))
    classes = flips(parities, radius)
    moves = F.array(*[F.struct(F.lit(i).cast("short").alias("c"), F.lit(change).alias("x")) for i, (change, _) in enumerate(classes)])
    rows = fps.withColumn("m", F.explode(moves)).select(variant_hash(F.col("fp"), parities).bitwiseXOR(F.col("m.x")).alias("h"), F.col("m.c").alias("c"), "fp")
    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(partial(_links, parities=parities, radius=radius), "a long, b long").distinct()


# --- components ---------------------------------------------------------------------------------------------


def components(links: DataFrame, hot: int = HOT) -> DataFrame:
    """node, root: the smallest node reachable, for every node of links (columns a, b).

    Alternating stars: large-star hangs a node's larger neighbours on its smallest neighbour, small-star the
    smaller ones; rounds are logarithmic in practice. The smallest neighbour is a combinable minimum, and a node
    with more than `hot` neighbours is dealt to many tasks when they learn of it (join_split), so no neighbourhood
    is ever gathered in one task.
    """
    pair = lambda df, x, y: df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    edges = materialize(pair(links.where("a <> b"), F.col("a"), F.col("b")).distinct())
    state = None
    while True:
        # large-star: all neighbours v > u go to min(N(u), u)
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = join_split(both.where("v > u"), least, "u", hot).select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        # small-star: the smaller neighbours of u, and u, go to the smallest
        large = materialize(large.withColumnRenamed("b", "u"))
        low = large.groupBy("u").agg(F.min("a").alias("m"))
        hung = join_split(large, low, "u", hot).select(F.col("m").alias("x"), F.explode(F.array("a", "u")).alias("y")).where("x <> y")
        edges = materialize(pair(hung, F.col("x"), F.col("y")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        state = now


def linked(marks: DataFrame, radius: int = 2) -> DataFrame:
    """marks (doc_id, fp) plus component_id: the smallest doc_id reachable over links of fingerprints."""
    heads = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("head")))
    links = materialize(ball_links(heads.select("fp"), heads.count(), radius))
    if links.isEmpty():
        owner = heads.select("fp", F.col("head").alias("component_id"))
    else:
        roots = components(links)
        placed = materialize(heads.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "head", F.coalesce("root", "fp").alias("root")))
        smallest = placed.groupBy("root").agg(F.min("head").alias("component_id"))
        owner = join_split(placed, smallest, "root").select("fp", "component_id")
    return join_split(marks, owner, "fp")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs."""
    marks = materialize(simhashes(docs, words))
    return linked(marks, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@lru_cache(maxsize=8)
def combos(bits: int, parities: int, radius: int) -> list[tuple[int, np.ndarray]]:
    """flips() for fingerprints of fewer bits."""
    return [(change, kept) for change, masks in flips(parities, radius) if len(kept := masks[masks < np.uint64(1 << bits)] if bits < BITS else masks)]
