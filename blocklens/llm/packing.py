"""Best-fit packing of tokenised documents into sequences of a fixed length.

Tokens: the library encodes whole texts. As white space separates words for good in this vocabulary, a text of
plain characters is encoded word by word, and the identifiers of words are kept in a table of bounded size;
any other text (characters above U+017F, controls, special strings) is encoded whole.

Packing: bounded-space online best-fit. A packer keeps a fixed number of open bins in a bitset keyed by free
space (bit f is set if an open bin has f places free), so the fullest bin that still takes a piece is found by
a shift and the lowest set bit. When a bin must be opened and the fixed number is reached, the fullest closes.
Pieces are dealt to packers by hash (of their content and their place, so that equal rows part) in groups of about `per_packer`; a packer loses at most its last bins, so
the loss does not grow with the corpus. Only the lengths of pieces are shuffled, never texts or identifiers.

Defined results: null text is the empty text (one piece: the end identifier); a document longer than a sequence
is cut into pieces of full length and a shorter last piece; repeated rows are packed each on its own; bins of
equal free space tie to the one opened or filled last; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens.llm.common import kept, materialize, ship

END = 1
OPEN_BINS = 512
PER_PACKER = 20_000
#: Words whose identifiers are kept by a worker.
KEPT = 700_000
#: Left to the library as a whole text: other scripts, controls, U+0130 (lower case of two characters), special strings.
UNSAFE = re.compile(r"[^\t\n\x20-\x7e\xa1-\u012f\u0131-\u017f]|<\|")


class WordIds(dict):
    """Lower-case word -> its identifiers as little-endian 32-bit integers; computes what is missing.

    A word of letters is one pre-token, which goes to the vocabulary's merge model directly; a word with a
    final mark is two; any other goes through the whole tokenizer.
    """

    def __init__(self, path: str, kept: int = KEPT):
        super().__init__()
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.kept = kept
        tokenizer = Tokenizer.from_file(path)
        self.encode = partial(tokenizer.encode, add_special_tokens=False)
        self.merge = tokenizer.model.tokenize
        mapper = ByteLevel(add_prefix_space=False, use_regex=False)
        self.mapped = {x: mapper.pre_tokenize_str(chr(x))[0][0] for x in range(0x21, 0x250) if chr(x).isalpha()}

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            ids = pack([t.id for t in self.merge(word.translate(self.mapped))])
        elif word[-1] in ".,;:!?" and word[:-1].isalpha():
            ids = self[word[:-1]] + pack(self.encode(word[-1]).ids)
        else:
            ids = pack(self.encode(word).ids)
        if len(self) < self.kept and len(word) < 100:
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if UNSAFE.search(text):
            return pack(self.encode(text).ids)
        return b"".join(map(self.__getitem__, text.lower().split()))


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _pieces(batches, path: str, length: int):
    words = kept(("word ids", path), lambda: WordIds(path))
    step = 4 * length
    for batch in batches:
        rows, piece, start, size, crc = [], [], [], [], []
        for row, text in enumerate(batch.column("__text").to_pylist()):
            ids = words.ids(text or "") + END.to_bytes(4, "little")
            for n, at in enumerate(range(0, len(ids), step)):
                part = ids[at : at + step]
                rows.append(row)
                piece.append(n)
                start.append(at // 4)
                size.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def pieces(docs: DataFrame, path: str, length: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the documents cut into pieces of at most `length` tokens."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").alias("__text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_pieces, path=path, length=length), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Packer:
    """Bounded-space online best-fit."""

    def __init__(self, length: int, open_bins: int = OPEN_BINS):
        self.length, self.open_bins = length, open_bins
        self.free = 0  # bit f: some open bin has f places free
        self.bins: dict[int, list[int]] = {}
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        found = self.bins[free]
        out = found.pop()
        if not found:
            self.free &= ~(1 << free)
        return out

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of a piece of that size."""
        fits = self.free >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            to = self._take(free)
            self.open -= 1
        else:
            if self.open == self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
                self.open -= 1
            free, to = self.length, self.made
            self.made += 1
        left = free - size
        if left:
            self.bins.setdefault(left, []).append(to)
            self.free |= 1 << left
            self.open += 1
        return to, self.length - free


def _packed(group: pd.DataFrame, length: int, open_bins: int) -> pd.DataFrame:
    packer = Packer(length, open_bins)
    group = group.sort_values(["__at", "doc_id", "piece", "ids_crc32"], kind="stable")
    placed = [packer.place(int(n)) for n in group["length"]]
    base = int(group["__part"].iloc[0]) << 32
    group["sequence_id"] = [base + b for b, _ in placed]
    group["offset"] = [at for _, at in placed]
    return group.drop(columns=["__part", "__at"])


def packed(docs: DataFrame, path: str, length: int = 4096, open_bins: int = OPEN_BINS, per_packer: int = PER_PACKER) -> DataFrame:
    """The pieces of docs with sequence_id and offset."""
    cut = materialize(pieces(docs, path, length))
    parts = max(1, math.ceil(cut.count() / per_packer))
    at = F.xxhash64("doc_id", "piece", "ids_crc32", "length")
    # the row's place in the written pieces deals equal rows to different packers, too
    dealt = cut.withColumn("__at", at).withColumn("__part", F.pmod(F.xxhash64("__at", F.monotonically_increasing_id()), F.lit(parts)))
    kind = cut.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("__part").applyInPandas(partial(_packed, length=length, open_bins=open_bins), out)
