"""Corpus pipeline: toxicity filter, line dedup, near-dedup, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from blocklens.llm.common import materialize, read
from blocklens.llm.linededup import dedup_lines
from blocklens.llm.mixing import mix
from blocklens.llm.packing import packed
from blocklens.llm.queries import vocabulary
from blocklens.llm.neardup import one_of_each
from blocklens.llm.toxicity import drop_toxic


def toxicity(spark, docs, sf_dir):
    """Documents that the classifier rejects go."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark, docs, sf_dir):
    """Lines that stand on many sites go, but for the first document that has them."""
    return dedup_lines(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies stays."""
    return one_of_each(docs)


def source_mix(spark, docs, sf_dir):
    """Documents are repeated as often as the mix takes them."""
    return mix(docs)


def packing(spark, docs, sf_dir):
    """Sequences of at most 4096 tokens."""
    return packed(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("packing", packing)]

#: The classifier and the hashes of the stages can't be expressed in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages in order over documents."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
