"""Operators against brute force, the libraries and held-out labels on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blocklens.llm import neardup, queries, topk
from blocklens.llm.fingerprints import canonical
from blocklens.llm.langid import predict_languages
from blocklens.llm.linededup import dedup_lines
from blocklens.llm.mixing import mix, mix_report
from blocklens.llm.neardup import one_of_each, shape
from blocklens.llm.packing import Packer, WordIds, pack
from blocklens.llm.pii import reliabilities
from blocklens.llm.simhash import _group_links, combos, components, flips, shingle_hashes, variant_hash
from blocklens.llm.tokencount import MergeCounts
from blocklens.llm.topk import Lists, nra
from blocklens.llm.toxicity import Codes, Network, Scorer, train, windows, word_codes
from tests.conftest import DATA
from tests.oracle import duck_rows, spark_rows


@pytest.fixture(scope="module")
def table():
    return pq.read_table(f"{DATA}/documents.parquet").to_pandas()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, DATA)) == duck_rows(queries.ORACLES[name], DATA)


# --- tokens

PIECES = st.text(alphabet=st.sampled_from(list("ab zé'sSİΣσß漢\n\t <|endoftext|>!?.,19² ́")), max_size=60)


@pytest.fixture(scope="module")
def counts():
    return MergeCounts(queries.vocabulary("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def words():
    return WordIds(queries.vocabulary("word_bpe_49k.json"))


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(PIECES, st.text(max_size=40)))
def test_counts_and_ids_equal_the_library(counts, words, text):
    text = text.encode("utf-8", "ignore").decode()
    assert counts.count(text) == len(counts.library.encode(text, add_special_tokens=False).ids)
    assert words.ids(text) == pack(words.encode(text).ids)


def test_corpus_counts_and_ids_equal_the_library(counts, words, table):
    for text in table.text:
        assert counts.count(text) == len(counts.library.encode(text, add_special_tokens=False).ids)
        assert words.ids(text) == pack(words.encode(text).ids)


def test_packed_pieces_round_trip(spark, words, table):
    got = queries.QUERIES["op3_best_fit_packing"](spark, DATA).toPandas()
    texts = dict(zip(table.doc_id, table.text, strict=True))
    for r in got.itertuples():
        ids = words.ids(texts[r.doc_id]) + (1).to_bytes(4, "little")
        part = ids[4 * r.start : 4 * (r.start + r.length)]
        assert len(part) == 4 * r.length and zlib.crc32(part) == r.ids_crc32 and r.start == 4096 * r.piece
    assert got.length.sum() == sum(len(words.ids(t)) // 4 + 1 for t in table.text)
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) * 1.02 + 1


def test_packer_is_best_fit_and_bounded():
    rng = random.Random(1)
    packer, bins = Packer(100, open_bins=5), {}
    for _ in range(2000):
        size = rng.randint(1, 100)
        free = {b for b, left in bins.items() if left >= size}
        to, offset = packer.place(size)
        assert packer.open <= 5
        if to in bins:
            assert bins[to] == min(bins[b] for b in free) and offset == 100 - bins[to]
        bins[to] = 100 - offset - size
        still = {b for found in packer.bins.values() for b in found}
        bins = {b: left for b, left in bins.items() if b in still}
    assert packer.made >= 1


# --- fingerprints


def test_edited_texts_and_likeness(spark, table):
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_fingerprints"](spark, DATA).collect()}
    ordered = table.sort_values("doc_id", ascending=False).reset_index(drop=True)
    by_text = {}
    for i, r in ordered.iterrows():
        following = ordered.text[(i + 1) % len(ordered)]
        changed = r.text[: len(r.text) - len(r.text) // 2] + following[: len(r.text) // 2]
        row = got[r.doc_id]
        assert row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and row["n_chars"] == len(r.text)
        assert row["near_next"] == float(canonical(r.text) == canonical(following)) and row["near_edited"] == float(canonical(r.text) == canonical(changed))
        by_text.setdefault(canonical(r.text), set()).add(row["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values()) and len(set.union(*by_text.values())) == len(by_text)


def test_canonical_form():
    assert canonical("  Straße  ﬁne\n") == canonical("STRASSE fine") and canonical("é") == canonical("é") and canonical("a b") != canonical("ab")


@pytest.mark.parametrize("extra", [[], [1 << 62], [None] * 300, [7] * 300])
def test_ranges_stay_small_and_cross_seams(spark, extra):
    from blocklens.llm.fingerprints import fingerprints, ranges

    rng = random.Random(len(extra))
    rows = [(i, f"Text {rng.randrange(60)} é  {'x' * rng.randrange(5)}") for i in range(400)] + [(i, f"more {n % 40}") for n, i in enumerate(extra)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    parts = ranges(df.select("doc_id", F.col("text").alias("__text"), F.xxhash64("text").alias("__h")), range_rows=50).groupBy("__part").count().collect()
    assert len(parts) >= len(rows) // 100 and max(r["count"] for r in parts) < 150
    got = fingerprints(df, range_rows=50).collect()
    assert len(got) == len(rows)
    if not extra or extra[0] == 1 << 62:
        ordered = sorted(rows, reverse=True)
        by = {r["doc_id"]: r for r in got}
        for (i, text), (_, following) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
            changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
            assert by[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and by[i]["near_next"] == float(canonical(text) == canonical(following))


def test_equal_buckets_with_other_bytes_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    from blocklens.llm import fingerprints

    # a weak digest: documents and edited texts fall into few buckets
    rows = [(4, "aXbq"), (3, "bYcq"), (2, "aXbq"), (1, "a")]
    weak = lambda canon: "0" * 31 + chr(canon[0])  # noqa: E731  the first letter decides the bucket
    after = {4: 3, 3: 2, 2: 1, 1: 4}
    text = dict(rows)
    made = []
    for i, t in rows:
        changed = fingerprints.edited(t, text[after[i]])
        made.append((i, i, after[i], after[i], weak(canonical(t).encode()), weak(canonical(changed).encode()), float(canonical(t) == canonical(changed))))
    made = spark.createDataFrame(made, "doc_id long, h long, next_id long, next_h long, digest string, edited_digest string, near_edited double")
    texts = spark.createDataFrame(rows, "doc_id long, __text string").withColumn("__h", F.col("doc_id"))
    asked = []
    monkeypatch.setattr(fingerprints, "differing", lambda bodies: asked.append(bodies) or bodies)
    real = type(texts).mapInArrow

    def in_arrow(self, f, schema):  # workers would digest with the true function
        if getattr(f, "func", None) is fingerprints._canon:
            return spark.createDataFrame([(weak(canonical(t).encode()), bytearray(canonical(t).encode())) for _, t in rows], schema)
        return real(self, f, schema)

    monkeypatch.setattr(type(texts), "mapInArrow", in_arrow)
    bodies = sorted((r["digest"][-1], bytes(r["body"])) for r in fingerprints.collisions(texts, made).collect())
    assert ("a", b"axby") in bodies and ("b", b"byax") in bodies  # edited texts stand among the bodies of their bucket
    monkeypatch.undo()
    odd = fingerprints.differing(spark.createDataFrame([(d, bytearray(b)) for d, b in bodies], "digest string, body binary"))
    assert sorted(r[0] for r in odd.collect()) == ["a", "b"]


# --- SimHash


def brute_mark(text):
    found = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    import xxhash

    shingles = [" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))] if found else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components_equal_brute_force(spark, table):
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_simhash"](spark, DATA).collect()}
    marks = {r.doc_id: brute_mark(r.text) for r in table.itertuples()}
    parent = {i: i for i in marks}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(marks)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (marks[i] ^ marks[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    for i in ids:
        assert got[i]["fingerprint"] == f"{marks[i]:016x}" and got[i]["component_id"] == root(i)


def test_ball_links_find_every_pair_of_a_dense_cluster():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 4, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(p) for p in rng.choice(64, k, replace=False))) for b in base for k in (1, 2, 3, 4, 4, 5, 6) for _ in range(12)]
    fps = np.unique(np.array([*base, *near], np.uint64))
    classes = flips(6, 2)
    assert sum(len(m) for _, m in classes) == 1 + 64 + 64 * 63 // 2
    hashes = {int(f): sum(((int(f) & sum(1 << p for p in range(j, 64, 6))).bit_count() & 1) << j for j in range(6)) for f in fps}
    groups = {}
    for f in fps:
        for c, (change, _) in enumerate(classes):
            groups.setdefault(hashes[int(f)] ^ change, []).append((c, f))
    parent = {int(f): int(f) for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for members in groups.values():
        for a, b in _group_links(np.array([c for c, _ in members], np.int16), np.array([f for _, f in members], np.uint64), 6, 2).tolist():
            assert (a ^ b).bit_count() <= 4
            parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {int(f): int(f) for f in fps}

    def wroot(x):
        while want[x] != x:
            x = want[x]
        return x

    for i, a in enumerate(fps.tolist()):
        for b in fps.tolist()[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                want[max(wroot(a), wroot(b))] = min(wroot(a), wroot(b))
    assert {f: root(f) for f in parent} == {f: wroot(f) for f in want}


def test_variant_hash_is_linear(spark):
    from pyspark.sql import functions as F

    fps = [0, -1, 1 << 62, 12345678901234567, -(1 << 63)]
    rows = spark.createDataFrame([(x,) for x in fps], "fp long").select("fp", variant_hash(F.col("fp"), 7).alias("h")).collect()
    for r in rows:
        bits = r["fp"] & (1 << 64) - 1
        assert r["h"] == sum(((bits & sum(1 << p for p in range(j, 64, 7))).bit_count() & 1) << j for j in range(7))
    assert sum(len(m) for _, m in combos(40, 5, 2)) == 1 + 40 + 40 * 39 // 2


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(900 + i, 900 + (i + 1) % 30) for i in range(30)] + [(7, 3), (3, 9)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {500 + i: 500 for i in range(80)} | {900 + i: 900 for i in range(30)} | {3: 3, 7: 3, 9: 3}


def test_near_copies_are_found_and_others_stay(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, groups = [], {}
    for g in range(40):
        text = [word() for _ in range(200)]
        groups[g * 100] = g
        rows.append((g * 100, " ".join(text)))
        if g < 20:
            for k in range(1, 6):
                copy = list(text)
                for _ in range(k if k < 4 else 0):
                    copy[rng.randrange(200)] = word()  # at most three changed words: similarity 0.85 and more
                rows.append((g * 100 + k, " ".join(copy)))
    kept = {r["doc_id"] for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(groups)
    assert shape(1000, 0.8) == (40, 11) == (neardup.BITS, neardup.needed_tables(0.8, neardup.BITS)) and shape(1 << 35, 0.8)[0] == 57


def test_chains_leave_one_document(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = []
    for g in range(150):
        text = [word() for _ in range(204)]
        for k, places in ((1, ()), (0, (20, 60, 100)), (2, (140, 170, 190))):  # 0 - 1 - 2: links at 0.86, the ends at 0.74
            rows.append((g * 10 + k, " ".join(word() if i in places else w for i, w in enumerate(text))))
    kept = {r["doc_id"] for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (kept >= {g * 10 for g in range(150)}, len(kept) <= 153) == (True, True), len(kept)


def test_all_pairs_of_a_dense_family_are_judged_once():
    rng = np.random.default_rng(6)
    bits, parities = 40, 4
    classes = combos(bits, parities, 2)
    base = rng.integers(0, 1 << bits, 3)
    fps = np.array([int(b) ^ sum(1 << int(p) for p in rng.choice(bits, k, replace=False)) for b in base for k in (0, 0, 1, 2, 2, 3, 3, 4) for _ in range(12)], np.uint64)
    ids = rng.permutation(len(fps)).astype(np.int64)
    roots = np.where(ids % 4 == 0, ids % 8, 1000 + ids)
    sigs = [f.tobytes() for f in fps]
    table = [pa.record_batch({"doc_id": ids, "sig": sigs, "root": roots, "dense": ids % 3 > 0})]
    rows = pd.concat(b.to_pandas() for b in neardup._emitted(table, bits, range(1), parities)).sort_values("h")
    got = []
    for _, g in rows.groupby("h"):
        for pairs in neardup._all_pairs(g.c.to_numpy(), g.fp.to_numpy().view(np.uint64), g.doc_id.to_numpy(), g.root.to_numpy(), classes):
            got += map(tuple, pairs.tolist())
    want = {(min(a, b), max(a, b)) for i, a in enumerate(ids.tolist()) for j, b in enumerate(ids.tolist()) if i < j and roots[i] != roots[j] and int(fps[i] ^ fps[j]).bit_count() <= 4}
    assert set(got) == want and len(got) == len(want)
    shuffled = [pa.RecordBatch.from_pandas(rows, preserve_index=False)]
    passed = [p for b in neardup._pairs(shuffled, bits, parities, True) for p in zip(*(x.to_pylist() for x in b.columns), strict=True)]
    assert set(passed) == want
    # with whole signatures of some: their pairs are judged on the spot, the others pass
    rows = pd.concat(b.to_pandas() for b in neardup._emitted(table, bits, range(1), parities, True)).sort_values("h")
    shuffled = [pa.RecordBatch.from_pandas(rows, preserve_index=False)]
    passed = [p for b in neardup._pairs(shuffled, bits, parities, True, 2) for p in zip(*(x.to_pylist() for x in b.columns), strict=True)]
    at = dict(zip(ids.tolist(), fps.tolist(), strict=True))
    assert set(passed) == {(a, b) for a, b in want if not (a % 3 and b % 3) or (at[a] ^ at[b]).bit_count() <= 2}


def test_templates_leave_one_document_of_each_component(spark):
    rng = random.Random(40)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = []
    for g in range(12):
        base = [word() for _ in range(150)]
        for k in range(48):  # edits at random places: similarities around the threshold
            text = list(base)
            for place in rng.sample(range(150), rng.randint(1, 7)):
                text[place] = word()
            rows.append((g * 100 + k, " ".join(text)))
    sets = {i: neardup.shingle_set(t, 5) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    near, links = 0, []
    for i in sets:
        for j in sets:
            if i < j and i // 100 == j // 100:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                similarity = both / (len(sets[i]) + len(sets[j]) - both)
                if similarity >= 0.8:
                    near += similarity < 0.85
                    links.append((i, j))
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
    kept = {r["doc_id"] for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {root(i) for i in sets}
    assert near > 100 and len(want) < 0.9 * len(rows)
    assert want <= kept and len(kept) <= 1.02 * len(want), (len(want), len(kept), len(rows))


def test_pairs_near_the_threshold_are_found(spark):
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows, pairs = [], 0
    while pairs < 300:
        text = [word() for _ in range(204)]
        other = [word() if i in {17, 58, 99, 140} else w for i, w in enumerate(text)]
        a, b = (neardup.shingle_set(" ".join(x), 5) for x in (text, other))
        both = len(np.intersect1d(a, b))
        assert 0.80 <= both / (len(a) + len(b) - both) <= 0.85
        rows += [(10 * pairs, " ".join(text)), (10 * pairs + 1, " ".join(other))]
        pairs += 1
    kept = {r["doc_id"] for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(10 * i + 1 not in kept for i in range(pairs))
    assert found >= 0.9 * pairs, found


def test_short_near_copies_are_settled_exactly(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows, alone = [], set()
    for g in range(200):
        text = [word() for _ in range(9)]
        rows += [(g * 10, " ".join(text[:8])), (g * 10 + 1, " ".join(text))]  # 4 and 5 shingles: 0.8
        other = [word() for _ in range(8)]
        rows += [(g * 10 + 2, " ".join(other[:7])), (g * 10 + 3, " ".join(other))]  # 3 and 4: 0.75
        alone |= {g * 10, g * 10 + 2, g * 10 + 3}
        text = [word() for _ in range(44)]
        rows += [(g * 10 + 4, " ".join(text[:36])), (g * 10 + 5, " ".join(text))]  # 32 and 40: 0.8
        alone.add(g * 10 + 4)
    kept = {r["doc_id"] for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == alone, (len(kept - alone), len(alone - kept))


# --- lines, mixing


def test_lines_on_many_sites_stay_once(spark):
    rows = [(i, f"own line {i}\n shared line \nsecond {i}", f"s{i % 12}") for i in range(24)] + [(100, "shared by nine", "s1")] + [(200 + i, "shared by nine", f"t{i}") for i in range(8)]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert "shared line" in got[0] and all("shared line" not in got[i] and got[i] == f"own line {i}\nsecond {i}" for i in range(1, 24))
    assert got[100] == "shared by nine" and got[203] == "shared by nine"


def test_water_filling_and_words_taken(spark, table):
    got = mix_report(spark.read.parquet(f"{DATA}/documents.parquet")).toPandas()
    again = mix_report(spark.read.parquet(f"{DATA}/documents.parquet").repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    got = got.merge(table[["doc_id", "source"]], on="doc_id")
    sizes = got.groupby("source")["size"].sum().sort_index()
    weights = np.array([(5, 2, 1)[i % 3] for i in range(len(sizes))], float)
    target, free, rest = np.zeros(len(sizes)), np.ones(len(sizes), bool), 1.5 * sizes.sum()
    while True:
        share = np.where(free, rest * weights / weights[free].sum(), 0)
        over = free & (share > 2 * sizes.values)
        if not over.any():
            target[free] = share[free]
            break
        target[over] = 2 * sizes.values[over]
        free &= ~over
        rest -= target[over].sum()
    per = got.groupby("source").agg(t=("target", "first"), k=("taken", "sum")).sort_index()
    assert np.allclose(per.t, target) and (abs(per.k - per.t) <= np.maximum(0.03 * per.t, 30)).all()
    assert (got.taken <= 2 * got["size"]).all()
    repeated = mix(spark.read.parquet(f"{DATA}/documents.parquet")).groupBy("doc_id").count().toPandas()
    want = got[got.taken > 0]
    assert dict(zip(repeated.doc_id, repeated["count"], strict=True)) == dict(zip(want.doc_id, want.taken // want["size"], strict=True))


# --- search


@pytest.mark.parametrize("kind", ["even", "clustered", "skewed"])
def test_nra_bounds_are_sound_and_skewed_lists_are_not_read_to_the_end(kind):
    rng = np.random.default_rng(3)
    rows = rng.integers(-900, 900, (1400, 16)).astype(float)
    if kind == "clustered":
        rows = np.round(rows / 300 + 500 * rng.integers(-1, 2, (1, 16)) * rng.integers(0, 3, (1400, 1)))
    if kind == "skewed":
        rows = np.round(rng.pareto(1.2, (1400, 16)) * 20)
    queries_ = rows[::50]
    floors = [np.full(len(queries_), -np.inf), np.sort(queries_ @ rows.T, axis=1)[:, -15]]  # nothing known, and a score to beat
    for floor in floors:
        lanes, depths = nra(queries_, Lists(rows), 10, floor)
        for q, lane in zip(queries_, lanes, strict=True):
            scores = rows @ q
            assert set(np.flatnonzero(scores >= np.sort(scores)[-10])) <= set(lane.tolist())
        assert (depths <= 1400).all()
        if kind == "skewed":
            assert np.median(depths) <= 1400 / 4 and (depths < 1400).mean() > 0.9
    # a score to beat from elsewhere shortens the reading
    far, none = (nra(queries_, Lists(rows), 10, f)[1].mean() for f in (floors[1] * 1.5 + 1e4, floors[0]))
    assert far <= none


def test_blocks_lanes_and_tasks_give_the_same_winners(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in rng.permutation(900)]  # many ties
    want = []
    data = {i: [int(1024 * x) for x in v] for i, v in rows}
    for q in (i for i in data if i % 20 == 0):
        ranked = sorted((-sum(a * b for a, b in zip(data[q], v, strict=True)), i) for i, v in data.items() if i != q)[:10]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(ranked, 1)]
    for name, value in (("BLOCK", 100), ("LANE_COMPONENTS", 100), ("PART_ROWS", 250), ("SEED_ROWS", 30)):
        monkeypatch.setattr(topk, name, value)
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


# --- personal data


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "ip" and any(int(x) > 255 for x in m.group().split("."))) or (kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits))) or (kind == "phone" and not 8 <= len(digits) <= 15):
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


HARD = [
    "a@b.c%d@e.f", "x@y.z..w@v.u", "a@b", "a@b.c.@d.e", "..a@b.c", "a@b.c-@d.e.f", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.4 00255.1.2.3", "1.2.3", "4539 5787-6362 1486", "4539  5787 6362 1486", "45395787636214864539578763621486",
    "+1 (555) 123-4567) +44 20.7946.0958 ++33123456789 +1-+2 3456 7890", "é👍 a.b+c@d-e.co é 10.0.0.1", "\x01a@b\x01c.d\x01 1\x012.3.4.5", "tel 555-123-4567 mail joe [at] corp [dot] com 2001:0db8:85a3:0000:0000:8a2e:0370:7334", "9" * 5000, "a." * 3000 + "@" + "b." * 3000 + "c",
]


def test_base_spans_equal_the_patterns(spark, table):
    rng = random.Random(9)
    fuzz = ["".join(rng.choice("a1.@-+ ()%_é9") for _ in range(rng.randint(0, 50))) for _ in range(2500)]
    fuzz += ["".join(rng.choice("4539578763621486 -") for _ in range(rng.randint(14, 40))) for _ in range(500)]
    texts = [*HARD, *fuzz, *table.text[:60]]
    from blocklens.llm.pii import find_personal_data

    got = {r["doc_id"]: r for r in find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        want = brute_spans(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (text[:80], want, got[i]["spans"])
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(w.startswith(k) for w in want) for k in ("email", "ip", "card", "phone")]
        assert set(want) <= set(got[i]["spans"].split(",")) | {""}


def test_wide_spans_are_accepted_and_rejected_by_the_classifier(spark):
    from blocklens.llm.pii import find_personal_data

    rng = random.Random(12)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = []
    for i in range(120):
        texts += [f"mail me at user{i}@corp.org", f"server 10.1.2.{i}", f"call +1 (415) 555-{1000 + i}", f'token = "{hexes(40)}"', f"a version {i}.0.{i}.1 and page {i}"]
    accepted = {"secret": 'api key: "' + hexes(40) + '" end', "email": "contact joe [at] corp [dot] com now", "phone": "phone 415-555-0199 today"}
    rejected = {"secret": "see " + "ab1" * 9 + " there", "phone": "order 000-000-0000 sent"}
    at = len(texts)
    rows = [*texts, *accepted.values(), *rejected.values()]
    got = {r["doc_id"]: r for r in find_personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    for n, (kind, text) in enumerate(accepted.items(), at):
        assert got[n]["spans"].startswith(f"{kind}:") and got[n]["n_spans"] == 1, (text, got[n])
        _, start, end = got[n]["spans"].split(":")
        assert text[int(start) : int(end)] in ("joe [at] corp [dot] com", "415-555-0199") or len(text[int(start) : int(end)]) == 40
    for n, text in enumerate(rejected.values(), at + len(accepted)):
        assert got[n]["spans"] == "" and got[n]["n_spans"] == 0, (text, got[n])
    assert all(got[i]["n_secret"] == ("token" in t) for i, t in enumerate(texts))


def test_a_text_of_very_many_matches_is_quick_and_right(spark):
    import time

    from blocklens.llm.pii import find_personal_data

    n = 40_000
    text = " ".join(f"10.0.{i % 256}.{i // 256}" for i in range(n)) + " 415-555-0199" * 3 + " x" * 100 + " u@v.org 2001:0db8:85a3:0000:0000:8a2e:0370:7334"
    begun = time.time()
    got = find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["n_ip"] == n and got["n_email"] == 1 and time.time() - begun < 60
    assert got["base_sha256"] == hashlib.sha256(",".join(brute_spans(text)).encode()).hexdigest()


def test_em_tells_reliable_labelers_from_noise():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < r, truth, ~truth) * 2 - 1 for r in (0.95, 0.9, 0.85, 0.5)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, good, bad = reliabilities(patterns, counts.astype(float))
    assert good[0][2] > 0.9 and bad[0][0] > 0.9 and abs(good[3][2] - bad[3][2]) < 0.1
    at = {tuple(p): s for p, s in zip(patterns, share, strict=True)}
    assert np.mean([(at[tuple(v)] > 0.5) == t for v, t in zip(votes, truth, strict=True)]) > 0.93


# --- classifiers


def test_languages_of_held_out_documents(spark, table):
    got = predict_languages(spark.read.parquet(f"{DATA}/documents.parquet")).toPandas().merge(table[["doc_id", "lang"]], on="doc_id")
    held = got[[zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]]
    assert held.held_out.all() and (held.lang == held.lang_pred).mean() > 0.95


@pytest.mark.parametrize("text", ["½ ² ①", "Ⅷ", "٣ 42", "_ -", "", None, "ᛮ"])
def test_texts_without_letters_have_no_language(spark, text):
    rows = [(i, "the cat sat on the mat", "en") for i in range(8)] + [(100, text, "en"), (101, "½ a ½", None)]
    got = {r["doc_id"]: r for r in predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert (got[100]["lang_pred"], got[100]["score"]) == ("und", 0.0) and got[101]["lang_pred"] == "en"


def test_toxicity_of_held_out_documents(spark):
    from blocklens.llm.toxicity import score_documents

    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    got = score_documents(docs, labels).toPandas().merge(labels.where("toxic is not null").toPandas(), on="doc_id")
    held = got[[zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]]
    assert held.held_out.all() and len(held) > 500 and (got.predicted == (got.score >= 0.5)).all()
    hit = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert hit / held.predicted.sum() > 0.85 and hit / held.toxic.sum() > 0.75


def test_network_gradients():
    net = Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = ["foo", "bar", "bazqux", "zip", "idiot", "!"]
    codes, rng = Codes(words), np.random.default_rng(0)
    at, mask, target = rng.integers(0, 6, (5, 16)), np.ones((5, 16), bool), np.array([1, 0, 1, 0, 1.0])
    mask[0, 4:], mask[3, 1:] = False, False

    def loss():
        logit = net.run(net.word_inputs(words).astype(np.float64)[at], mask)
        return np.mean(np.log1p(np.exp(-np.where(target == 1, logit, -logit))))

    for k, g in net.gradients(at, codes, mask, target).items():
        i = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = net.p[k][i]
        net.p[k][i] = old + 1e-4
        up = loss()
        net.p[k][i] = old - 1e-4
        down = loss()
        net.p[k][i] = old
        assert abs((up - down) / 2e-4 - g[i]) < 1e-4 + 0.02 * abs(g[i]), k


def test_training_finds_words_and_stems_and_scores_all_windows():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ter", "san", "du", "pel"]) for _ in range(rng.randint(2, 3)))
    texts, labels = [], []
    for i in range(600):
        body = [word() for _ in range(rng.randint(20, 300))]
        bad = i % 3 == 0
        if bad:
            body.insert(rng.randrange(len(body)), rng.choice(["scoundrel", "zorgf" + word()]))
        texts.append(" ".join(body))
        labels.append(int(bad))
    net = train(texts[:450], labels[:450])
    scores = Scorer(net).scores([*texts[450:], "", None, texts[1] + " scoundrel", ("kalo " * 80_000) + "scoundrel"])
    assert np.mean((scores[:150] >= 0.5) == np.array(labels[450:])) > 0.95
    assert scores[150] == scores[151] == 0.0 and scores[152] > 0.5 and scores[153] > 0.5
    assert train(["a b"], [1]) is None


def test_windows_cover_every_word():
    for n in (0, 1, 15, 16, 17, 24, 25, 100):
        starts = windows(n)
        assert {w for s in starts for w in range(s, min(n, s + 16))} == set(range(n)) and (np.diff(starts) <= 8).all()
    bucket, gram, first, stem = word_codes(["a", "longer"])
    assert len(bucket) == 2 and len(first) == 2 and stem.shape == (2, 6) and len(shingle_hashes("a b", 4)) == 1


# --- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "source_mix", "packing"]
    out = corpus_pipeline.run(spark, DATA).toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 4096 and len(out)
