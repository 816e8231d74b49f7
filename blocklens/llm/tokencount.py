"""Token counts of a byte-level BPE vocabulary by heap-and-linked-list merging.

A text is cut at special strings and into pre-tokens; a pre-token starts as one symbol for each byte. Symbols
stand in a doubly linked list, adjacent pairs that have a merge in a heap; the pair of lowest rank (leftmost
first) is popped and merged until none is left. The count is the initial symbols minus the merges: no
identifiers are emitted. Counts of pre-tokens are kept in a table of bounded size, as words repeat.

Pre-tokens are cut with a pattern where all characters are below U+0250 and not controls, where the pattern's
classes are the same in every Unicode version; any other text is cut by the library's own pre-tokenizer.

Defined results: null text counts as empty (0 bytes, 0 tokens); rows are independent, so repeated rows repeat
their result and ties do not occur; a very long text is counted whole, pre-token by pre-token, and a pre-token of any
length by its own heap; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from functools import partial
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens.llm.common import kept, ship

#: Pre-token pattern of the vocabulary's byte-level splitter (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters outside of these are left to the library's splitter.
UNSAFE = re.compile(r"[^\t\n\x20-\x7e\xa1-ɏ]")
#: Pre-tokens whose counts are kept.
KEPT = 600_000


class MergeCounts(dict):
    """Pre-token -> tokens; computes what is missing."""

    def __init__(self, path: str, kept: int = KEPT):
        super().__init__()
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab = model["model"]["vocab"]
        self.kept = kept
        self.library = Tokenizer.from_file(path)
        self.special = [t["content"] for t in model["added_tokens"]]
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.find = regex.compile(PATTERN).findall
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        self.pairs = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        from tokenizers.pre_tokenizers import ByteLevel

        # the splitter maps bytes to printable characters; each byte's character is read off a short text
        mapper = ByteLevel(add_prefix_space=False, use_regex=False)
        chars = [chr(x) for x in (*range(0x80), *range(0x80, 0x800, 0x20), *range(0x80, 0xC0), *range(0x800, 0x10000, 0x800), *range(0x10000, 0x110000, 0x10000)) if not 0xD800 <= x < 0xE000]
        self.byte = {}
        for c in chars:
            for b, m in zip(c.encode(), mapper.pre_tokenize_str(c)[0][0], strict=True):
                self.byte.setdefault(b, vocab[m])
        self.mapped = {m: vocab[m] for m in ByteLevel.alphabet()}

    def __missing__(self, word: str) -> int:
        byte = self.byte
        n = self.merged([byte[b] for b in word.encode()])
        if len(self) < self.kept and len(word) < 100:  # long runs are not worth their memory
            self[word] = n
        return n

    def merged(self, symbols: list[int]) -> int:
        """Tokens that the symbols become."""
        n = len(symbols)
        if n < 2:
            return n
        pairs = self.pairs
        heap = []
        for i in range(n - 1):
            found = pairs.get((symbols[i], symbols[i + 1]))
            if found:
                heap.append((found[0], i, found[1]))
        heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        merges = 0
        while heap:
            rank, i, new = heappop(heap)
            j = after[i]
            if j >= n or symbols[i] < 0:
                continue
            found = pairs.get((symbols[i], symbols[j]))
            if not found or found[0] != rank:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            merges += 1
            if k < n:
                before[k] = i
                found = pairs.get((new, symbols[k]))
                if found:
                    heappush(heap, (found[0], i, found[1]))
            h = before[i]
            if h >= 0:
                found = pairs.get((symbols[h], new))
                if found:
                    heappush(heap, (found[0], h, found[1]))
        return n - merges

    def count(self, text: str) -> int:
        n = 0
        parts = [text]
        if self.cut and self.cut.search(text):
            parts = self.cut.split(text)
            n = len(parts) - 1
        for part in parts:
            if UNSAFE.search(part):
                mapped = self.mapped
                for word, _ in self.library.pre_tokenizer.pre_tokenize_str(part):
                    n += self.merged([mapped[c] for c in word])
            else:
                n += sum(map(self.__getitem__, self.find(part)))
        return n


def _count(batches, path: str):
    counts = kept(("merge counts", path), lambda: MergeCounts(path))
    for batch in batches:
        texts = batch.column("__text").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array([counts.count(t) for t in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("__text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(partial(_count, path=path), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
