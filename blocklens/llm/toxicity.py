"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Every word has a word input (an embedding by hash) and character inputs: the mean embedding of its byte
trigrams and that of its beginnings of several lengths, by hash, for inflected and compound words. A window of words runs through a gated recurrent unit in both directions; attention pools
the states; a linear unit gives the window's logit. All overlapping windows of the whole text are scored, the
document's score is that of its most toxic window.

Training: a sample of at most `per_class` labelled documents and `class_chars` characters of each class (documented
bounds on rows; a text of the sample is always whole), as bags of all their windows: in each round the network
picks the top window of every document and learns from these, and from random windows of clean documents. Embeddings of words and beginnings start from the log-odds of what they
stand for in the sample; word inputs are dropped at random in training, so that characters count.

Defined results: null text and text without words score 0.0; labels that are null or neither 0 nor 1 are not
learned from, an id with both labels is learned from with both; nothing to learn from (no row of one class): all
score 0.0; repeated rows repeat their result; very long texts are scored whole, in stretches that overlap by a
window; ties do not occur, as a score depends on its own text only; an empty table gives an empty result; other
columns are ignored or, in filtering, pass through.
"""

from __future__ import annotations

import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from blocklens.llm.common import free_name, held_out, kept, materialize, ship, trim

WINDOW, STRIDE = 16, 8
WORD_BITS, GRAM_BITS, STEM_BITS = 17, 12, 16
WORDS, GRAMS, STEMS = 1 << WORD_BITS, 1 << GRAM_BITS, 1 << STEM_BITS
#: Lengths of beginnings in bytes, the mark at the word's begin included.
STEM_SIZES = np.arange(4, 10)
WIDTH, HIDDEN, ATTENTION = 8, 8, 8
PER_CLASS = 2500
#: Log-odds from which a word or beginning speaks for a class at first, and by how much at most.
ODDS = 3.0, 3.0
#: Characters of the texts of a class to learn from, at most.
CLASS_CHARS = 32_000_000
#: Rounds of training, more where the sample is small, so that there are LEAST_STEPS steps of STEP windows; a round has one
#: step at least. All windows are scored anew up to twice ROUNDS times.
ROUNDS, STEP, LEAST_STEPS = 8, 128, 500
SEED = 7
#: Words whose inputs are kept by a worker.
KEPT = 120_000
#: Windows run at once.
BATCH = 4096
EDGES = ".,;:!?\"'()[]{}<>-_*#"


class Codes:
    """Of words: word bucket, trigram buckets of all words in a row with their start and number for each word, and
    buckets of beginnings (-1: the word is shorter)."""

    def __init__(self, words: list[str]):
        parts = [word_codes(words[i : i + 16_384]) for i in range(0, len(words), 16_384)]  # bounds what hashing takes
        self.bucket, self.gram, first, self.stem = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.first = first + np.repeat(np.cumsum([0, *(len(p[1]) for p in parts[:-1])]), [len(p[0]) for p in parts])
        self.size = np.diff(np.append(self.first, len(self.gram)))


def word_codes(words: list[str]) -> tuple[np.ndarray, ...]:
    data = [b"<" + w.strip(EDGES).encode("utf-8", "replace") + b">" for w in words]
    data = [d if len(d) > 2 else b"<\x00>" for d in data]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    raw = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    at = np.arange(len(raw)) - np.repeat(starts, sizes)
    mixed = (raw + np.uint64(1)) * (at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = (np.add.reduceat(mixed, starts) >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
    ends = starts[:, None] + np.minimum(STEM_SIZES, sizes[:, None])
    stem = ((sums[ends] - sums[starts][:, None]) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - STEM_BITS)).astype(np.int32)
    stem[sizes[:, None] < STEM_SIZES] = -1
    gram = (raw[:-2] << np.uint64(16)) | (raw[1:-1] << np.uint64(8)) | raw[2:]
    inside = at[:-2] < np.repeat(sizes, sizes)[:-2] - 2
    gram = ((gram[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GRAM_BITS)).astype(np.int32)
    firsts = np.concatenate(([0], np.cumsum(sizes - 2)[:-1]))
    return bucket, gram, firsts, stem


def windows(n: int) -> np.ndarray:
    """Starts of the overlapping windows over n words; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - WINDOW, STRIDE)
    return np.append(starts, n - WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters and both passes. Arrays have a leading axis of two where there is one for each direction."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale=0.1: rng.normal(0, scale, shape).astype(np.float32)
        h = HIDDEN
        self.p = {
            "word": draw(WORDS, WIDTH, scale=0.02), "gram": draw(GRAMS, WIDTH), "stem": draw(STEMS, WIDTH, scale=0.02), "in": draw(2, 3 * WIDTH, 3 * h, scale=0.3), "bias": np.zeros((2, 3 * h), np.float32),
            "rec": draw(2, h, 3 * h, scale=0.3), "att": draw(2 * h, ATTENTION, scale=0.3), "att_b": np.zeros(ATTENTION, np.float32), "att_v": draw(ATTENTION, scale=0.3), "out": draw(2 * h, scale=0.3), "out_b": np.zeros(1, np.float32),
        }

    def word_inputs(self, words: list[str]) -> np.ndarray:
        """(words, 2, 3h): what a word adds to the gates of either direction."""
        codes = Codes(words)
        chars = np.add.reduceat(self.p["gram"][codes.gram], codes.first, axis=0) / codes.size[:, None].astype(np.float32)
        x = np.concatenate([self.p["word"][codes.bucket], chars, self.stems(codes.stem)], axis=1)
        return (np.einsum("nw,dwg->ndg", x, self.p["in"], optimize=True) + self.p["bias"]).astype(np.float32)

    def stems(self, stem: np.ndarray) -> np.ndarray:
        """Mean embedding of the beginnings of words."""
        there = stem >= 0
        total = np.where(there[..., None], self.p["stem"][stem], np.float32(0)).sum(axis=1)
        return total / np.maximum(there.sum(axis=1, keepdims=True), 1).astype(np.float32)

    def run(self, gates: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """Logits of windows from gate inputs (n, WINDOW, 2, 3h); mask: where there is a word, None for everywhere."""
        n, h, p = len(gates), HIDDEN, self.p
        state = np.zeros((2, n, h), np.float32)
        states = np.empty((n, WINDOW, 2, h), np.float32)
        kept = []
        for t in range(WINDOW):
            back = WINDOW - 1 - t
            a = np.stack([gates[:, t, 0], gates[:, back, 1]])
            s = state @ p["rec"]
            zr = _sigmoid(a[..., : 2 * h] + s[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            new = np.tanh(a[..., 2 * h :] + r * s[..., 2 * h :])
            after = new + z * (state - new)
            if mask is not None:
                m = np.stack([mask[:, t], mask[:, back]])[..., None]
                after = np.where(m, after, state)
            if keep:
                kept.append((state, z, r, new, s[..., 2 * h :]))
            state = after
            states[:, t, 0], states[:, back, 1] = state[0], state[1]
        flat = states.reshape(n, WINDOW, 2 * h)
        u = np.tanh(flat @ p["att"] + p["att_b"])
        e = u @ p["att_v"]
        if mask is not None:
            e = np.where(mask, e, np.float32(-30))
        w = np.exp(e - e.max(axis=1, keepdims=True))
        w /= w.sum(axis=1, keepdims=True)
        pooled = (w[:, None, :] @ flat)[:, 0]
        logit = pooled @ p["out"] + p["out_b"][0]
        return (logit, (flat, u, w, pooled, kept)) if keep else logit

    def gradients(self, words: np.ndarray, codes: Codes, mask: np.ndarray, target: np.ndarray, rng=None) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of windows; words: (n, WINDOW) indexes into codes; rng: for dropped word inputs."""
        p, h, n = self.p, HIDDEN, len(words)
        used, local = np.unique(words, return_inverse=True)
        local = local.reshape(words.shape)
        lengths = codes.size[used]
        owner = np.repeat(np.arange(len(used)), lengths)
        inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        grams = codes.gram[np.repeat(codes.first[used], lengths) + inside]
        chars = np.zeros((len(used), WIDTH), np.float32)
        np.add.at(chars, owner, p["gram"][grams])
        chars /= lengths[:, None]
        bucket, stem = codes.bucket[used], codes.stem[used]
        there = stem >= 0
        heard = np.ones((len(used), 1), np.float32) if rng is None else (rng.random((len(used), 1)) < 0.5).astype(np.float32)
        x = np.concatenate([p["word"][bucket] * heard, chars, self.stems(stem)], axis=1)
        table = np.einsum("nw,dwg->ndg", x, p["in"]) + p["bias"]
        logit, (flat, u, w, pooled, kept) = self.run(table[local].astype(np.float32), mask, keep=True)
        g = {}
        d = ((_sigmoid(logit) - target) / n).astype(np.float32)
        g["out"], g["out_b"] = pooled.T @ d, d.sum(keepdims=True)
        dp = d[:, None] * p["out"]
        dflat = w[..., None] * dp[:, None, :]
        dw = (flat @ dp[..., None])[..., 0]
        de = w * (dw - (w * dw).sum(axis=1, keepdims=True))
        g["att_v"] = np.einsum("nt,nta->a", de, u)
        du = de[..., None] * p["att_v"] * (1 - u * u)
        g["att"], g["att_b"] = np.einsum("nth,nta->ha", flat, du), du.sum(axis=(0, 1))
        dflat = (dflat + du @ p["att"].T).reshape(n, WINDOW, 2, h)
        dgates = np.zeros((n, WINDOW, 2, 3 * h), np.float32)
        g["rec"] = np.zeros_like(p["rec"])
        carry = np.zeros((2, n, h), np.float32)
        for t in range(WINDOW - 1, -1, -1):
            back = WINDOW - 1 - t
            state, z, r, new, sn = kept[t]
            dh = carry + np.stack([dflat[:, t, 0], dflat[:, back, 1]])
            m = np.stack([mask[:, t], mask[:, back]])[..., None]
            stay, dh = np.where(m, 0, dh), np.where(m, dh, 0)
            dz = dh * (state - new) * z * (1 - z)
            dn = dh * (1 - z) * (1 - new * new)
            dr = dn * sn * r * (1 - r)
            ds = np.concatenate([dz, dr, dn * r], axis=-1)
            g["rec"] += np.swapaxes(state, 1, 2) @ ds
            carry = stay + dh * z + ds @ np.swapaxes(p["rec"], 1, 2)
            da = np.concatenate([dz, dr, dn], axis=-1)
            dgates[:, t, 0], dgates[:, back, 1] = da[0], da[1]
        dtable = np.zeros_like(table, dtype=np.float32)
        np.add.at(dtable, local.ravel(), dgates.reshape(-1, 2, 3 * h))
        g["bias"] = dtable.sum(axis=0)
        g["in"] = np.einsum("nw,ndg->dwg", x, dtable)
        dx = np.einsum("ndg,dwg->nw", dtable, p["in"])
        g |= {k: np.zeros_like(p[k]) for k in ("word", "gram", "stem")}
        np.add.at(g["word"], bucket, dx[:, :WIDTH] * heard)
        np.add.at(g["gram"], grams, (dx[:, WIDTH : 2 * WIDTH] / lengths[:, None])[owner])
        each = dx[:, 2 * WIDTH :] / np.maximum(there.sum(axis=1, keepdims=True), 1)
        np.add.at(g["stem"], stem[there], np.repeat(each, there.sum(axis=1), axis=0))
        return g


def _window_words(rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, mask) of the windows of one text."""
    at = starts[:, None] + np.arange(WINDOW)
    mask = at < len(rows)
    return rows[np.minimum(at, len(rows) - 1)], mask


class Bags:
    """The windows of all texts to learn from: the words of the texts in a row, and where each window starts and its text ends."""

    def __init__(self, docs: list[np.ndarray]):
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        begins = np.cumsum(sizes) - sizes
        starts = [windows(n) for n in sizes.tolist()]
        self.words = np.concatenate(docs)
        self.owner = np.repeat(np.arange(len(docs)), [len(x) for x in starts])
        self.start = np.concatenate(starts) + begins[self.owner]
        self.end = (begins + sizes)[self.owner]

    def __len__(self) -> int:
        return len(self.start)

    def take(self, which) -> tuple[np.ndarray, np.ndarray]:
        """(words, mask) of the windows at these places."""
        at = self.start[which][:, None] + np.arange(WINDOW)
        mask = at < self.end[which][:, None]
        return self.words[np.minimum(at, len(self.words) - 1)], mask

    def each(self, score) -> np.ndarray:
        """score(words, mask) of every window, a batch at a time."""
        return np.concatenate([score(*self.take(slice(i, i + BATCH))) for i in range(0, len(self), BATCH)])


def train(texts: list[str], labels: list[int], seed: int = SEED) -> Network | None:
    """Multiple-instance training; None if a class is missing."""
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    docs, target = [], []
    for text, label in zip(texts, labels, strict=True):
        words = (text or "").lower().split()
        if words:
            docs.append(np.array([index.setdefault(w, len(index)) for w in words], np.int32))
            target.append(label)
    target = np.array(target, np.float32)
    if not len(docs) or target.min() == target.max():
        return None
    net = Network(seed)
    words = list(index)
    del index
    codes = Codes(words)
    inputs = np.empty((len(words), 2, 3 * HIDDEN), np.float32)
    odds = {}
    for name, at in (("word", codes.bucket[:, None]), ("stem", codes.stem)):
        present = np.zeros((2, len(net.p[name])))
        for rows, label in zip(docs, target, strict=True):
            seen = np.unique(at[rows])
            present[int(label), seen[seen >= 0]] += 1
        value = np.log((present[1] + 0.1) / (target.sum() + 0.2)) - np.log((present[0] + 0.6) / ((1 - target).sum() + 1.2))
        net.p[name][:, 0] = np.where(present.sum(axis=0) >= 5, np.clip(value - ODDS[0], 0, ODDS[1]), 0)
        odds[name] = np.where(at >= 0, net.p[name][at, 0], 0).max(axis=1)
    odds = (odds["word"] + odds["stem"]).astype(np.float32)
    bags = Bags(docs)
    del docs
    owner = bags.owner
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    score = bags.each(lambda words, mask: np.where(mask, odds[words], np.float32(-9)).max(axis=1))  # round one: by log-odds
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    clean = np.flatnonzero(target[owner] == 0)
    step = 0
    rounds = max(ROUNDS, min(LEAST_STEPS, -(-LEAST_STEPS * STEP // (4 * int((target == 0).sum())))))
    again = -(-rounds // (2 * ROUNDS))
    for round_ in range(rounds):
        order = np.lexsort((rng.random(len(score)), -score, owner))
        top = order[first]
        toxic_top, clean_top = top[target == 1], top[target == 0]
        picked = np.concatenate([clean_top, rng.choice(clean, len(clean_top)), np.resize(rng.permutation(toxic_top), 2 * len(clean_top))])
        for at in np.split(rng.permutation(picked), range(STEP, len(picked), STEP)):
            step += 1
            taken, mask = bags.take(at)
            for k, g in net.gradients(taken, codes, mask, target[owner[at]], rng).items():
                m, v = moments[k]
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                net.p[k] -= (0.01 if round_ < 0.75 * rounds else 0.003) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if round_ % again == again - 1 and round_ + 1 < rounds:
            for i in range(0, len(words), 16_384):
                inputs[i : i + 16_384] = net.word_inputs(words[i : i + 16_384])
            score = bags.each(lambda words, mask: net.run(inputs[words], mask))
    return net


class Scorer(dict):
    """Word -> row of its gate inputs; scores texts with one network."""

    def __init__(self, net: Network):
        super().__init__()
        self.net = net
        self.reset()

    def reset(self):
        self.clear()
        self.inputs = np.empty((1 << 17, 2, 3 * HIDDEN), np.float32)
        self.known, self.pending = 0, []

    def __missing__(self, word: str) -> int:
        row = self[word] = self.known + len(self.pending)
        self.pending.append(word)
        return row

    def learn(self):
        n = self.known + len(self.pending)
        while n > len(self.inputs):
            self.inputs = np.concatenate([self.inputs, np.empty_like(self.inputs)])
        if self.pending:
            self.inputs[self.known : n] = self.net.word_inputs(self.pending)
        self.known, self.pending = n, []

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        group, size = [], 0
        for i, text in enumerate(texts):
            words = (text or "").lower().split()
            if words:
                # a very long text goes in stretches that overlap by a window
                for at in range(0, max(1, len(words) - WINDOW), BATCH * STRIDE):
                    part = words[at : at + BATCH * STRIDE + WINDOW]
                    rows = np.fromiter(map(self.__getitem__, part), np.int32, len(part))
                    group.append((i, rows))
                    size += len(rows) // STRIDE + 1
                    if size >= BATCH:
                        self._flush(group, out)
                        group, size = [], 0
        if group:
            self._flush(group, out)
        return out

    def _flush(self, group, out):
        self.learn()
        whole = [(i, r) for i, r in group if len(r) >= WINDOW]
        short = [(i, r) for i, r in group if len(r) < WINDOW]
        for part, masked in ((whole, False), (short, True)):
            if not part:
                continue
            cut = [_window_words(r, windows(len(r))) for _, r in part]
            words, mask = np.concatenate([w for w, _ in cut]), np.concatenate([m for _, m in cut])
            owner = np.repeat([i for i, _ in part], [len(w) for w, _ in cut])
            for at in range(0, len(words), BATCH):
                logit = self.net.run(self.inputs[words[at : at + BATCH]], mask[at : at + BATCH] if masked else None)
                np.maximum.at(out, owner[at : at + BATCH], _sigmoid(logit.astype(np.float64)))
        if self.known > KEPT:
            self.reset()


def _scorer(shared) -> Scorer:
    net = Network.__new__(Network)
    net.p = shared.value
    return Scorer(net)


def _score(batches, shared, key, schema: pa.Schema):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        scores = np.zeros(len(texts)) if shared is None else kept(("scorer", key), lambda: _scorer(shared)).scores(texts)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], schema=schema)


def sample(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, per_class: int = PER_CLASS, class_chars: int = CLASS_CHARS) -> list:
    """Rows (doc_id, text, __toxic) to learn from: labelled, not held out, whole texts; bounded in rows and characters.

    Rows of a class come in a seeded order of their ids. Of an id with several texts the smallest counts; a text that
    would take a class beyond class_chars is left out, and the next ones are tried.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder)).select("doc_id", F.col("toxic").cast("int").alias("__toxic")).distinct()
    order = F.xxhash64(F.lit(SEED), "doc_id")
    drawn = known.where("__toxic = 1").orderBy(order, "doc_id").limit(per_class).unionByName(known.where("__toxic = 0").orderBy(order, "doc_id").limit(per_class))
    # 2 x per_class ids at most, so their labels may be broadcast and their lengths collected
    rows = materialize(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "__toxic").agg(F.min("text").alias("text")).select("doc_id", "__toxic", "text", F.length("text").alias("n"), order.alias("at")))
    left, taken = {0: class_chars, 1: class_chars}, []
    for r in rows.select("doc_id", "__toxic", "n", "at").orderBy("at", "doc_id").collect():
        if (r["n"] or 0) <= left[r["__toxic"]]:
            left[r["__toxic"]] -= r["n"] or 0
            taken.append((r["doc_id"], r["__toxic"]))
    wanted = docs.sparkSession.createDataFrame(taken, rows.select("doc_id", "__toxic").schema)
    return rows.join(F.broadcast(wanted), ["doc_id", "__toxic"]).select("doc_id", "text", "__toxic").toArrow().to_pylist()


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, per_class: int = PER_CLASS, class_chars: int = CLASS_CHARS) -> Network | None:
    """A network from the labelled rows that are not held out, within the bounds of sample()."""
    rows = sample(docs, labels, modulus, remainder, per_class, class_chars)
    rows.sort(key=lambda r: (r["doc_id"], r["__toxic"]))
    net = train([r["text"] for r in rows], [r["__toxic"] for r in rows])
    del rows
    trim()  # the driver goes on with other stages
    return net


def with_scores(docs: DataFrame, net: Network | None, name: str) -> DataFrame:
    """docs with a score column of that name, which docs has not; all other columns pass through."""
    spark = docs.sparkSession
    ship(spark)
    shared = None if net is None else spark.sparkContext.broadcast(net.p)  # fixed size, about 4 MB
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(partial(_score, shared=shared, key=uuid.uuid4().hex, schema=to_arrow_schema(schema)), schema)


def score_documents(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    net = fit(docs, labels, modulus, remainder)
    scored = with_scores(docs.select("doc_id", "text"), net, "__score")
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic; columns as given."""
    score = free_name(docs, "score")
    return with_scores(docs, fit(docs, labels), score).where(F.col(score) < 0.5).select(*docs.columns)
