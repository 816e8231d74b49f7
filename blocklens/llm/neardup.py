"""One document of each group of near copies: SimHash ball hashing over several short fingerprints.

Documents are sets of five-word shingles; two are near copies from a Jaccard similarity of 0.8. One 64-bit
fingerprint at a radius of four bits finds few of such pairs (they differ in about 15 % of the bits), so every
document has several independent fingerprints, of which only so many bits meet by ball hashing that chance
collisions stay rare. Both numbers are parameters, the same whatever the size of the table, so that two documents
link in every corpus or in none:

    bits    40: in a table a document meets 9 others by chance for every 10^8 documents; shape() says what to pass
            beyond that (each bit more halves them)
    tables  as many as find a pair at the threshold with the asked probability (11 of 40 bits find 0.95 of them)

In a table every fingerprint emits its variants within half the radius, which meet by their variant hash as in
simhash.py. Pairs are deduplicated and verified:
the differing bits of all fingerprints together (64 bits of each) estimate the angle between the shingle sets
and decide where they are clear; pairs near the threshold are settled by the Jaccard similarity of the sets
themselves, which are made again for their documents only. Links make components; the smallest id of each stays.

The fingerprints are worked off in rounds. All documents take part in all rounds and all links count; only pairs that
the links of earlier rounds already connect are not made again, as they add nothing to the components. In the first
rounds, over one and two fingerprints, each document of a variant pairs only with the most central one, which connects
a dense group of copies with few pairs. A shared variant does not prove a link, so the last round, over all
fingerprints, pairs every two documents that share a variant and are not connected yet; the pairs of a dense group,
connected by then, do not grow with its square. Those of a family of documents that are just below the threshold to
each other do; nothing but the verification of each can tell which of them are copies. So documents that stood in a
pair with one of many pairs in the first rounds bring their whole signature along in the last round, and their pairs
are judged by it where they are found; only pairs that may be links leave the task. Components are those of the links
of all rounds.

The angle holds for large sets only, so documents of at most 32 shingles take no part in this. Their links, also those
with larger documents, are found exactly: two sets of that similarity share one of the first shingles of both, in
order from the rarest (prefix filter); documents that share one are compared by their sets.

Defined results: documents without words (null, empty, blank) are copies of each other; of rows that repeat an id one
stays, linked by the smallest signature of its texts; rows without an id stay, as nothing tells them apart; very long
texts count with all their shingles; of a group the smallest id stays, so ties do not occur; an empty table gives an
empty result; columns, of any name, pass through.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blocklens.llm.common import id_bitmap, in_bitmap, materialize, release, ship
from blocklens.llm.simhash import SEED, combos, components, in_rows, majorities, shared_variants, shingle_hashes

#: Bits of a fingerprint that meet by ball hashing.
BITS = 40
RADIUS = 2
RECALL = 0.95
#: Standard errors around the threshold inside which pairs are settled exactly: to the side of more and of fewer differing bits.
UNCLEAR, SURE = 3.0, 4.5
#: Distinct documents for each variant hash of a table.
PER_GROUP = 8192
#: Documents of a variant up to which its pairs are listed from the variant; above, by blocks of documents.
FEW = 8
#: Documents of a block and those it is compared with at once.
BLOCK, ACROSS = 512, 8192
#: Shingles up to which a document's links are found by its set, not by fingerprints.
SHORT = 32
#: Compared pairs of a document from which it counts as the middle of a dense family.
MANY = 64
#: Pairs that a task holds before it passes them on.
HELD = 1 << 20


def differing_share(similarity: float) -> float:
    """Expected share of differing bits of two sets of that Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def needed_tables(similarity: float, bits: int, recall: float = RECALL, radius: int = RADIUS) -> int:
    """Fingerprints that find a pair of that similarity with that probability."""
    p = differing_share(similarity)
    hit = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(2 * radius + 1))
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def shape(n: int, similarity: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) with which each of n documents meets less than 0.1 others by chance: advice for callers."""
    bits = min(64, max(BITS, math.ceil(math.log2(max(2, n))) + 22))
    return bits, needed_tables(similarity, bits, recall)


def _remix(hashes: np.ndarray, table: int) -> np.ndarray:
    """Independent hashes of a table from the shingles' hashes."""
    x = hashes + np.uint64((table + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(sets: list[np.ndarray], tables: int) -> list[bytes]:
    """The fingerprints of shingle sets, eight bytes each."""
    marks = [np.stack([majorities(_remix(hashes, t), sizes) for t in range(tables)], axis=1) for hashes, sizes in in_rows(sets)]
    return [x.astype("<u8").tobytes() for part in marks for x in part]


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words, SEED))


def _signatures(batches, words: int, tables: int, longest: int):
    """doc_id, sig and, of sets of at most `longest`, the shingles."""
    release()
    for batch in batches:
        sets = [shingle_set(t, words) for t in batch.column("__text").to_pylist()]
        few = [x.view(np.int64) if len(x) <= longest else None for x in sets]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(signatures(sets, tables), pa.binary()), pa.array(few, pa.list_(pa.int64()))], ["doc_id", "sig", "few"])


def rounds(tables: int) -> list[tuple[range, bool]]:
    """(tables, whole) of each round: stars of the first one, of the next two, then all pairs of all."""
    stars = [x for x in (range(min(1, tables)), range(1, min(3, tables))) if len(x)]
    return [*((x, False) for x in stars), (range(tables), True)]


def _emitted(batches, bits: int, chosen: range, parities: int, whole: bool = False):
    """(doc_id, sig, root, dense) -> a row for each chosen table and class of flips: h (table and variant hash), c, fp,
    doc_id, root and, if whole, the signature of dense documents."""
    classes = combos(bits, parities, RADIUS)
    changes = np.array([x for x, _ in classes], np.int64)
    masks = [np.uint64(sum(1 << p for p in range(j, bits, parities))) for j in range(parities)]
    low = np.uint64((1 << bits) - 1)
    for full in batches:
        for at in range(0, full.num_rows, 500):
            batch = full.slice(at, 500)
            fps = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u8").reshape(batch.num_rows, -1)[:, list(chosen)] & low
            own = np.zeros(fps.shape, np.int64)
            for j, mask in enumerate(masks):
                own |= (np.bitwise_count(fps & mask).astype(np.int64) & 1) << j
            own += np.array(chosen, dtype=np.int64) << parities
            h = own[:, :, None] ^ changes[None, None, :]
            n = len(classes)
            ids, roots = (np.repeat(batch.column(x).to_numpy(), len(chosen) * n) for x in ("doc_id", "root"))
            columns = [pa.array(h.ravel().astype(np.int32)), pa.array(np.tile(np.arange(n, dtype=np.int16), fps.size)), pa.array(np.repeat(fps.ravel(), n).view(np.int64)), pa.array(ids, pa.int64()), pa.array(roots, pa.int64())]
            if whole:
                sig = pc.if_else(batch.column("dense"), batch.column("sig"), pa.scalar(None, pa.binary()))
                columns.append(sig.take(pa.array(np.repeat(np.arange(batch.num_rows), len(chosen) * n))))
            yield pa.RecordBatch.from_arrays(columns, ["h", "c", "fp", "doc_id", "root", "sig"][: len(columns)])


def _star_pairs(c: np.ndarray, fps: np.ndarray, ids: np.ndarray, roots: np.ndarray, classes):
    """Pairs of the documents of one variant hash that share a variant: a star for each variant, without pairs of one root.

    The centre is the member that shares most variants, so that the stars of a dense group have few centres.
    """
    for _, place, row in shared_variants(c, fps, classes):
        shares = np.bincount(row, minlength=len(ids))[row]
        who = ids[row]
        order = np.lexsort((who, -shares, place))
        place, who, root = place[order], who[order], roots[row][order]
        first = np.concatenate(([True], place[1:] != place[:-1]))
        star = np.cumsum(first) - 1
        centre, other = who[first][star], root[first][star] != root
        yield np.unique(np.stack([np.minimum(centre, who)[other], np.maximum(centre, who)[other]], axis=1), axis=0)


def _own_variant(x: np.ndarray, y: np.ndarray, fps: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The one of the variants shared by rows x and y that stands for the pair, so that one hash of a table finds it."""
    base = np.where(ids[x] < ids[y], fps[x], fps[y])
    rest = fps[x] ^ fps[y]
    for _ in range(RADIUS):
        low = rest & (~rest + np.uint64(1))
        base, rest = base ^ low, rest ^ low
    return base


class Judge:
    """Decides pairs of rows by their whole signatures, where both have one."""

    def __init__(self, sigs: list[bytes | None], bits: int, table: int, most: float):
        self.row = np.cumsum([x is not None for x in sigs]) - 1
        self.row[[x is None for x in sigs]] = -1
        known = b"".join(x for x in sigs if x is not None)
        self.sigs = np.frombuffer(known, "<u8").reshape(int((self.row >= 0).sum()), -1)
        self.low, self.table, self.most = np.uint64((1 << bits) - 1), table, most

    def keeps(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """False for pairs that differ in more bits than a link may, and for those that an earlier table finds as well."""
        out = np.ones(len(x), bool)
        a, b = self.row[x], self.row[y]
        known = np.flatnonzero((a >= 0) & (b >= 0))
        for i in range(0, len(known), 1 << 16):
            at = known[i : i + (1 << 16)]
            differing = self.sigs[a[at]] ^ self.sigs[b[at]]
            met = np.bitwise_count(differing & self.low) <= 2 * RADIUS
            out[at] = (np.bitwise_count(differing).sum(axis=1, dtype=np.int64) <= self.most) & (met.argmax(axis=1) == self.table)
        return out


def _all_pairs(c: np.ndarray, fps: np.ndarray, ids: np.ndarray, roots: np.ndarray, classes, judge: Judge | None = None):
    """All pairs of documents of different roots whose own variant is of this variant hash; each pair once, if judge keeps it."""

    def own(x, y, shared, chosen):
        v = _own_variant(x, y, fps, ids)
        place = np.minimum(np.searchsorted(shared, v), len(shared) - 1)
        keep = (shared[place] == v) & chosen[place]
        if judge:
            keep[keep] = judge.keeps(x[keep], y[keep])
        a, b = ids[x[keep]], ids[y[keep]]
        return np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)

    for shared, place, row in shared_variants(c, fps, classes):
        order = np.argsort(place, kind="stable")
        row = row[order]
        sizes = np.bincount(place, minlength=len(shared))
        starts = np.cumsum(sizes) - sizes
        mixed = np.minimum.reduceat(roots[row], starts) != np.maximum.reduceat(roots[row], starts)
        for k in range(2, FEW + 1):
            at = np.flatnonzero(mixed & (sizes == k))
            if len(at):
                i, j = np.triu_indices(k, 1)
                members = row[starts[at][:, None] + np.arange(k)]
                x, y = members[:, i].ravel(), members[:, j].ravel()
                apart = roots[x] != roots[y]
                yield np.unique(own(x[apart], y[apart], shared, sizes == k), axis=0)
        large = mixed & (sizes > FEW)
        rows = np.unique(row[np.repeat(large, sizes)])
        rows = rows[np.argsort(roots[rows], kind="stable")]
        for lo in range(0, len(rows), BLOCK):
            block = rows[lo : lo + BLOCK]
            for to in range(lo, len(rows), ACROSS):
                others = rows[to : to + ACROSS]
                if roots[block[0]] == roots[others[-1]]:  # sorted: all of one root
                    continue
                near = (np.bitwise_count(fps[block][:, None] ^ fps[others][None, :]) <= 2 * RADIUS) & (roots[block][:, None] < roots[others][None, :])
                x, y = np.nonzero(near)
                yield own(block[x], others[y], shared, large)


def _pairs(batches, bits: int, parities: int, whole: bool, most: float = math.inf):
    """Rows sorted by hash -> pairs; a pair that several hashes of a partition find counts once."""
    classes = combos(bits, parities, RADIUS)
    key, parts, sigs, found = None, [], [], []

    def passed_on():
        pairs = np.unique(np.concatenate(found), axis=0)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def done(last: bool):
        if parts:
            rows = [np.concatenate(x) for x in zip(*parts, strict=True)]
            judge = Judge(sigs, bits, int(key) >> parities, most) if any(x is not None for x in sigs) else None
            for pairs in _all_pairs(*rows, classes, judge) if whole else _star_pairs(*rows, classes):
                if len(pairs):
                    found.append(pairs)
                if sum(map(len, found)) >= HELD:
                    yield passed_on()
        if found and last:
            yield passed_on()

    for batch in batches:
        h, c, fp, ids, roots = (batch.column(n).to_numpy() for n in ("h", "c", "fp", "doc_id", "root"))
        if not len(h):
            continue
        edges = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if key is not None and h[lo] != key:
                yield from done(False)
                parts, sigs = [], []
            key = h[lo]
            if "sig" in batch.schema.names:
                sigs += batch.column("sig").slice(lo, hi - lo).to_pylist()
            parts.append((c[lo:hi], fp[lo:hi].view(np.uint64), ids[lo:hi], roots[lo:hi]))
    yield from done(True)


def _distances(batches):
    """Rows (a, b, sa, sb) -> a, b and the differing bits of their signatures."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(n).to_pylist()), "<u8").reshape(batch.num_rows, -1) for n in ("sa", "sb"))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64))], ["a", "b", "d"])


def _shingle_sets(batches, words: int, bitmap: bytes):
    """doc_id and shingle set of the documents of the bitmap."""
    release()
    for whole in batches:
        batch = whole.filter(pa.array(in_bitmap(whole.column("doc_id").to_numpy(), bitmap)))
        sets = [shingle_set(t, words).tobytes() for t in batch.column("__text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "shingles"])


def _similar(batches, similarity: float):
    """Rows (a, b, sa, sb) whose shingle sets have at least that Jaccard similarity."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def _with_both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """pairs (a, b) with the value of either side as sa and sb."""
    left, right = (table.select(F.col("doc_id").alias(k), F.col(value).alias(f"s{k}")) for k in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")


class ShingleSets:
    """The shingle sets of the documents that were asked for so far; a set is made once, for all rounds."""

    def __init__(self, docs: DataFrame, words: int):
        self.docs, self.words, self.known = docs, words, None

    def of(self, asked: DataFrame) -> DataFrame:
        """doc_id, shingles of the asked ids at least; of an id with several texts the smallest."""
        asked = asked.distinct()
        new = materialize(asked if self.known is None else asked.join(self.known.select("doc_id"), "doc_id", "left_anti"))
        if not new.isEmpty():
            sets = self.docs.mapInArrow(partial(_shingle_sets, words=self.words, bitmap=id_bitmap(new)), "doc_id long, shingles binary")
            sets = materialize(sets.join(new, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("shingles").alias("shingles")))
            self.known = sets if self.known is None else self.known.unionByName(sets)
        return self.known


def near_links(sets: ShingleSets, heads: DataFrame, n: int, similarity: float, bits: int, tables: int, chosen: range, whole: bool) -> tuple[DataFrame, DataFrame]:
    """a, b: verified links between heads (doc_id, sig, root, dense) of different roots that the chosen tables find, and
    a, b, d: all pairs that were compared, with their differing bits.

    whole: of all pairs that share a variant, else of a star for each variant.
    """
    parities = min(26, max(4, math.ceil(math.log2(max(1, n) / PER_GROUP))))
    p, size = differing_share(similarity), 64 * tables
    error = math.sqrt(size * p * (1 - p))
    most, least = size * p + UNCLEAR * error, size * p - SURE * error
    schema = "h int, c short, fp long, doc_id long, root long" + ", sig binary" * whole
    rows = heads.mapInArrow(partial(_emitted, bits=bits, chosen=chosen, parities=parities, whole=whole), schema)
    pairs = rows.repartition("h").sortWithinPartitions("h").mapInArrow(partial(_pairs, bits=bits, parities=parities, whole=whole, most=most), "a long, b long").distinct()
    judged = materialize(_with_both(pairs, heads, "sig").mapInArrow(_distances, "a long, b long, d long"))
    clear = judged.where(F.col("d") < least).select("a", "b")
    unclear = judged.where(F.col("d").between(least, most)).select("a", "b")
    if unclear.isEmpty():
        return clear, judged
    asked = unclear.select(F.col("a").alias("doc_id")).unionByName(unclear.select(F.col("b").alias("doc_id")))
    return clear.unionByName(_with_both(unclear, sets.of(asked), "shingles").mapInArrow(partial(_similar, similarity=similarity), "a long, b long")), judged


def crowded(judged: DataFrame, many: int = MANY) -> DataFrame:
    """doc_id of the documents that stand in a compared pair with one that has more than `many`."""
    ends = judged.select(F.col("a").alias("doc_id"), F.col("b").alias("other")).unionByName(judged.select(F.col("b").alias("doc_id"), F.col("a").alias("other")))
    hubs = ends.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > many).select(F.col("doc_id").alias("other"))
    return ends.join(hubs, "other", "left_semi").select("doc_id").unionByName(hubs.select(F.col("other").alias("doc_id"))).distinct()


def _short_links(batches, similarity: float):
    """Rows (h, doc_id, few) sorted by h -> links of the documents of each h with a short one among the two, by their sets.

    A spanning subset: its components are those of all links.
    """

    def of_group(ids: np.ndarray, sets: list) -> list:
        order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
        ids, sets = ids[order], [sets[i] for i in order]
        sizes = np.array([len(x) for x in sets])
        flat, owner, ends = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), np.cumsum(sizes)
        up, found = list(range(len(sets))), []

        def top(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for i in range(len(sets) - 1):
            if sizes[i] > SHORT:
                break
            last = np.searchsorted(sizes, sizes[i] / similarity + 1e-9, side="right")
            part = slice(ends[i], ends[last - 1])
            both = np.bincount(owner[part][np.isin(flat[part], sets[i])], minlength=last)[i + 1 : last]
            for j in (i + 1 + np.flatnonzero(both >= similarity * (sizes[i] + sizes[i + 1 : last] - both) - 1e-9)).tolist():
                x, y = top(i), top(j)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    found.append((int(ids[i]), int(ids[j])))
        return found

    key, ids, sets = None, [], []

    def done():
        links = np.array(of_group(np.array(ids), sets), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    for batch in batches:
        for h, i, x in zip(batch.column("h").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("few"), strict=True):
            if ids and h != key:
                yield done()
                ids, sets = [], []
            key = h
            ids.append(i)
            sets.append(x.values.to_numpy())
    if ids:
        yield done()


def short_links(heads: DataFrame, similarity: float) -> DataFrame:
    """a, b: links of the short documents of heads (doc_id, few)."""
    few = heads.where("size(few) > 0").select("doc_id", "few")
    each = few.select("doc_id", F.size("few").alias("size"), F.explode("few").alias("h"))
    counts = each.groupBy("h").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("n", "h"))
    first = each.join(counts, "h").withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1)
    rows = first.where("n > 1").select("doc_id", "h").join(few, "doc_id").select("h", "doc_id", "few")
    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(partial(_short_links, similarity=similarity), "a long, b long").distinct()


def _rooted(heads: DataFrame, links: DataFrame) -> DataFrame:
    """heads with the smallest document that the links connect them with as root."""
    roots = components(links).select(F.col("node").alias("doc_id"), F.col("root").alias("__root"))
    return heads.join(roots, "doc_id", "left").select("doc_id", "sig", "few", F.coalesce("__root", "root").alias("root"), "dense")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = RECALL, bits: int = BITS) -> DataFrame:
    """docs with one row for each group of near copies; columns as given."""
    ship(docs.sparkSession)
    tables = needed_tables(similarity, bits, recall)
    named = docs.where("doc_id is not null")
    texts = named.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__text"))
    longest = math.floor(SHORT / similarity + 1e-9)
    marks = materialize(texts.mapInArrow(partial(_signatures, words=words, tables=tables, longest=longest), "doc_id long, sig binary, few array<long>"))
    # equal signatures are copies; an id with several texts counts with the smallest signature
    first = marks.groupBy("sig").agg(F.min(F.struct("doc_id", "few")).alias("x")).groupBy("x.doc_id").agg(F.min(F.struct("sig", "x.few")).alias("y"))
    heads = materialize(first.select("doc_id", "y.sig", "y.few", F.col("doc_id").alias("root"), F.lit(False).alias("dense")))
    n, links = heads.count(), None
    found = materialize(short_links(heads, similarity))
    if not found.isEmpty():
        links = found
        heads = materialize(_rooted(heads, links))
    sets = ShingleSets(texts, words)
    for chosen, whole in rounds(tables):
        long = heads.where(F.col("few").isNull() | (F.size("few") > SHORT)).select("doc_id", "sig", "root", "dense")
        found, judged = near_links(sets, long, n, similarity, bits, tables, chosen, whole)
        found = materialize(found)
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            heads = materialize(_rooted(heads, links))
        if not whole:
            marked = crowded(judged).withColumn("crowded", F.lit(True))
            heads = materialize(heads.join(marked, "doc_id", "left").withColumn("dense", F.col("dense") | F.coalesce("crowded", F.lit(False))).drop("crowded"))
    keep = heads.where("doc_id = root").select("doc_id")
    kept = named.join(keep.hint("merge"), "doc_id", "left_semi").select(*docs.columns)  # the same plan at every size
    return kept.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))
