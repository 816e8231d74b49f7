"""Language identification with hyperdimensional profiles.

Each letter symbol has a random vector of +1 and -1. A letter trigram's vector is the product of its letters'
vectors, the earlier ones permuted (rolled by two and one places), a document's vector the sum over its
trigrams, a language's prototype the bundle of its documents' vectors at unit length. The prediction is the
prototype of highest cosine; the score is its share in a softmax over the cosines.

Symbols: a to z and the letters of Latin-1 have their own, other letters share 69 by code point; anything else
separates words. Prototypes are fitted on a sample of labelled rows of at most about `per_language` documents
of each language (a documented bound); every whole text is predicted.

Letters are the characters that str.isalpha accepts; digits, fractions, superscripts and number forms are none.

Defined results: null text or text without letters: `und`, score 0; null lang: not learned from; languages tie
by name; nothing to learn from: `und` for all; repeated rows repeat their result, and each counts in learning;
very long texts are encoded whole, trigram by trigram; other columns are ignored; an empty table gives an empty
result. The driver and each worker hold 4 KiB for each language that is learned.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens.llm.common import held_out, kept, ship

DIM = 1024
SEED = 2024
SYMBOLS = 128
PER_LANGUAGE = 2000
SHARPNESS = 20.0


@lru_cache(maxsize=1)
def _symbol_table() -> np.ndarray:
    """The symbol of every code point; 0 for all that are no letters."""
    table = np.arange(0x110000) % 69 + 59
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[0xDF:0x100] = np.arange(27, 60)
    table[[not chr(c).isalpha() for c in range(0x110000)]] = 0
    return table.astype(np.int32)


def symbols(text: str | None) -> np.ndarray:
    """The symbols of a text's letters, one 0 before, between and after its words; empty without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    s = np.concatenate([[0], _symbol_table()[points], [0]], dtype=np.int32)
    s = s[np.concatenate([[True], (s[1:] > 0) | (s[:-1] > 0)])]  # of a run of zeros, the first
    return s if len(s) > 1 else s[:0]


class Trigrams:
    """Vectors of the trigrams seen so far, made on demand."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        rng = np.random.default_rng(seed)
        letters = rng.integers(0, 2, (SYMBOLS, dim), dtype=np.int8) * 2 - 1
        self.first, self.second, self.third = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters
        self.row = np.full(SYMBOLS**3, -1, np.int32)
        self.vectors = np.empty((4096, dim), np.float32)
        self.used = 0

    def rows(self, codes: np.ndarray) -> np.ndarray:
        rows = self.row[codes]
        if (rows < 0).any():
            new = np.unique(codes[rows < 0])
            while self.used + len(new) > len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
            a, b, c = new // SYMBOLS**2, new // SYMBOLS % SYMBOLS, new % SYMBOLS
            self.vectors[self.used : self.used + len(new)] = self.first[a] * self.second[b] * self.third[c]
            self.row[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
            rows = self.row[codes]
        return rows

    def encode(self, text: str | None) -> np.ndarray | None:
        """The document's vector at unit length; None without letters."""
        s = symbols(text)
        if not len(s):
            return None
        counts = np.bincount(self.rows((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]))
        seen = np.flatnonzero(counts)
        vector = counts[seen].astype(np.float32) @ self.vectors[seen]
        return vector / max(float(np.linalg.norm(vector)), 1e-12)


def trigrams() -> Trigrams:
    """One for each worker process."""
    return kept("trigrams", Trigrams)


def _bundle(batches):
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            vector = trigrams().encode(text)
            if vector is not None:
                sums[lang] = sums.get(lang, 0) + vector.astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "bundle"])


def prototypes(docs: DataFrame, per_language: int = PER_LANGUAGE, parts: int = 12) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes at unit length, from docs (doc_id, text, lang) to learn from."""
    ship(docs.sparkSession)
    labelled = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return [], np.zeros((0, DIM), np.float32)
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", F.length("text")), F.lit(1_000_000))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1_000_000, per_language * 1_000_000 // n))])
    sample = labelled.where(draw < share[F.col("lang")]).select("text", "lang").repartition(parts)
    total: dict[str, np.ndarray] = {}
    for lang, bundle in sample.mapInArrow(_bundle, "lang string, bundle binary").collect():  # parts x languages rows
        total[lang] = total.get(lang, 0) + np.frombuffer(bundle)
    langs = sorted(total)
    if not langs:
        return [], np.zeros((0, DIM), np.float32)
    table = np.stack([total[x] for x in langs])
    return langs, (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _predict(batches, langs: list[str], table: np.ndarray):
    for batch in batches:
        names, scores = [], []
        for text in batch.column("__text").to_pylist():
            vector = trigrams().encode(text) if langs else None
            if vector is None:
                names.append("und")
                scores.append(0.0)
            else:
                cosines = table @ vector
                best = int(np.argmax(cosines))
                names.append(langs[best])
                scores.append(float(1.0 / np.exp(SHARPNESS * (cosines - cosines[best]).astype(np.float64)).sum()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def predict_languages(docs: DataFrame, modulus: int = 4, remainder: int = 2, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs; learns from the rows not held out."""
    rows = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"))
    langs, table = prototypes(rows.where(~F.col("held_out")), per_language)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "held_out", F.col("text").alias("__text")).mapInArrow(partial(_predict, langs=langs, table=table), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
