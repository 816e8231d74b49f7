"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blocklens.llm import fingerprints, langid, linededup, mixing, neardup, packing, pii, simhash, tokencount, topk, toxicity
from blocklens.llm.queries import vocabulary

EXTRA = ["size", "fp", "fingerprint", "score", "sequence_id", "target", "held_out", "c", "h", "__text_other", "number", "digest", "__id", "__hash", "__text_hash", "__removed", "__lines", "__source", "__site", "__size", "__key", "__copies", "__copy", "__row", "__score", "__score_", "root", "sig", "few", "dense", "__h", "__part", "edge", "__text", "__at"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(x, T.StringType()) for x in EXTRA]])
LONG = ("word " * 30_000).strip()


def rows(*items):
    return [(i, t, lang, s, None if t is None else len(t), *["x"] * len(EXTRA)) for i, t, lang, s in items]


ODD = rows(
    (1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", "a"), (4, LONG, "en", "b"), (5, "one two three four five six", "en", "b"), (5, "one two three four five six", "en", "b"),
    (6, "one two three four five six", "de", None), (None, "no id here", "en", "a"), (7, "Ünïcödé — 漢字 👍🏽 é", "xx", "c"), (8, "1" * 40_000, None, "c"), (9, "a@b.co, +1 (555) 123-4567, 10.0.0.1, 4539578763621486", "en", "a"),
    (9, "another text under nine", "en", "a"),
)


@pytest.fixture(scope="module", params=["odd", "empty"])
def docs(request, spark):
    return spark.createDataFrame(ODD if request.param == "odd" else [], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (4, 1, None), (5, 1, 1), (6, None, 0), (9, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


def same_rows(out, docs):
    assert out.count() == docs.count()
    return out.collect()


def test_reports_return_a_row_for_every_document(docs, labels):
    same_rows(linededup.line_report(docs), docs)
    same_rows(pii.find_personal_data(docs), docs)
    same_rows(tokencount.token_counts(docs, vocabulary("byte_bpe_50k.json")), docs)
    same_rows(fingerprints.fingerprints(docs), docs)
    same_rows(simhash.near_duplicates(docs), docs)
    same_rows(mixing.mix_report(docs), docs)
    for r in same_rows(langid.predict_languages(docs), docs):
        assert r["lang_pred"] != "und" or r["score"] == 0.0
    for r in same_rows(toxicity.score_documents(docs, labels), docs):
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)


def test_stages_keep_the_columns(docs, labels):
    for out in (toxicity.drop_toxic(docs, labels), linededup.dedup_lines(docs), neardup.one_of_each(docs), mixing.mix(docs)):
        assert out.columns == docs.columns
        out.write.format("noop").mode("overwrite").save()


def test_packing_holds_every_token_once(docs):
    got = packing.packed(docs, vocabulary("word_bpe_49k.json")).collect()
    assert len({(r["doc_id"]) for r in got}) == docs.select("doc_id").distinct().count()
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(x <= 4096 for x in ends.values())


def test_known_results(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    sim = by(simhash.near_duplicates(docs))
    assert sim[1]["fingerprint"] == "0" * 16 and {sim[i]["component_id"] for i in (1, 2, 3)} == {1} and sim[6]["component_id"] == 5
    lang = by(langid.predict_languages(docs))
    assert lang[1]["lang_pred"] == lang[2]["lang_pred"] == lang[8]["lang_pred"] == "und"
    found = pii.find_personal_data(docs).where("doc_id = 9 and n_email = 1").first()
    assert (found["n_ip"], found["n_card"], found["n_phone"]) == (1, 1, 1)
    kept = neardup.one_of_each(docs).select("doc_id").collect()
    assert sorted(r[0] for r in kept if r[0] is not None) == [1, 4, 5, 7, 8, 9] and sum(r[0] is None for r in kept) == 1
    counts = by(tokencount.token_counts(docs, vocabulary("byte_bpe_50k.json")))
    assert counts[1]["n_tokens"] == 0 and counts[1]["n_bytes"] == 0 and counts[4]["over_limit"]


def test_very_long_texts_and_repeated_rows(spark):
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(40_000))
    changed = long.replace("word5 ", "other5 ", 20)
    rows = [(1, long, "en", "a"), (2, changed, "en", "b"), (3, long, None, "c"), (4, "short text", "en", "a"), (4, "short text", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = neardup.one_of_each(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 4]
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.predict_languages(docs).collect()]
    assert sorted(got) == [(1, "en"), (2, "en"), (3, "en"), (4, "en"), (4, "en")]
    taken = mixing.mix_report(docs).where("doc_id = 4").collect()
    assert len(taken) == 2 and len(set(taken)) == 1


def test_many_removed_lines_in_one_document(spark):
    import time

    shared = [f"shared line {i}" for i in range(30_000)]
    rows = [(i, "\n".join([f"own {i}", *shared]), f"s{i}") for i in range(11)]
    begun = time.time()
    got = {r["doc_id"]: r for r in linededup.line_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [got[i]["n_removed"] for i in range(11)] == [0, *[30_000] * 10] and time.time() - begun < 90
    import hashlib

    assert got[5]["clean_sha256"] == hashlib.sha256(b"own 5").hexdigest()


def test_sample_is_bounded_in_rows_and_characters(spark):
    rows = [(i, "x" * 100) for i in range(40)] + [(40, "y" * 5000), (1, "a" * 50), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(41)] + [(3, 0, 1), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.sample(docs, labels, per_class=15, class_chars=1000)
    for label in (0, 1):
        texts = [r["text"] for r in got if r["__toxic"] == label]
        assert 5 <= len(texts) <= 15 and sum(len(t or "") for t in texts) <= 1000 and all(len(t or "") in (0, 50, 100) for t in texts)
    assert len({(r["doc_id"], r["__toxic"]) for r in got}) == len(got)
    assert sorted(map(str, got)) == sorted(map(str, toxicity.sample(docs.repartition(7), labels, per_class=15, class_chars=1000)))


def test_intermediate_tables_need_a_shared_folder(spark, monkeypatch):
    from blocklens.llm import common

    class Context:
        master = "spark://cluster:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_hot_keys_are_split_in_joins(spark):
    from blocklens.llm.common import join_split

    rows = spark.createDataFrame([(i % 3 if i < 90 else 100 + i, i) for i in range(120)], "k long, x long")
    table = spark.createDataFrame([(k, k * 2) for k in [0, 1, 2, *range(190, 215)]], "k long, y long")
    plain = sorted(map(str, rows.join(table, "k", "left").select("k", "x", "y").collect()))
    assert sorted(map(str, join_split(rows, table, "k", hot=20, spread=4).select("k", "x", "y").collect())) == plain


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (100, None), (200, [1.0, None]), (300, [nan, 1.0]), (400, [inf, 1.0]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, [1.0]), (4, []), (None, [1.0, 1.0]), (5, [1e12, 1.0]), (2, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("rank", F.lit("x"))
    got = [tuple(r) for r in topk.top_k(df).orderBy("query_id", "rank").collect()]
    big = 1024 * int(1024 * 1e12) + 512 * 1024
    assert got == [(0, 1, 5, big), (0, 2, 1, 1024 * 1024 + 512 * 512), (0, 3, 2, 1024 * 1024 + 512 * 512)]
    assert topk.top_k(df.limit(0)).count() == 0


def test_letters_are_told_apart_by_table_not_by_pattern():
    import re
    import time

    import numpy as np

    odd = "".join(c for c in map(chr, range(0x80, 0x110000)) if c.isalnum() and not c.isalpha())
    pattern = re.compile(rf"[\W\d_{odd}]+")
    texts = ["Une phrase, deux mots ; the 3rd: straße №5, x² ½Ⅷ — 漢字! " * 400] * 20
    langid.trigrams().encode("a"), pattern.sub(" ", "a")
    begun = time.process_time()
    plain = [pattern.sub(" ", t.lower()).strip() for t in texts]
    by_pattern, begun = time.process_time() - begun, time.process_time()
    got = [langid.trigrams().encode(t) for t in texts]
    assert time.process_time() - begun < by_pattern / 2
    assert all(np.array_equal(x, langid.trigrams().encode(p)) for x, p in zip(got, plain, strict=True))


def test_symbols_of_odd_texts():
    word = lambda *s: [0, *s, 0]
    assert langid.symbols("Ab  1c").tolist() == [0, 1, 2, 0, 3, 0] == langid.symbols("--ab_c\n").tolist()
    assert langid.symbols("é").tolist() == word(27 + 0xE9 - 0xDF) and len(langid.symbols("漢")) == 3
    for text in (None, "", " \n", "123", "½Ⅷ²①", "👍🏽", "÷×", "\ud800"):
        assert langid.symbols(text).tolist() == [] and langid.trigrams().encode(text) is None
