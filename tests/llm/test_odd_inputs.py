"""Small cases that operators and pipeline stages must survive: repeated rows and ids, clashing
roles, nothing to learn from, texts above one chunk."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import chat, language, minhash, passages, queries
from tests.llm import brute

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def near_pair(k=0):
    words = [f"w{k}x{i}" for i in range(60)]
    return " ".join(words), " ".join([*words[:-1], "other"])


def test_repeated_rows_do_not_multiply(spark):
    one, two = near_pair()
    rows = [(1, one)] * 40 + [(2, two)] * 40 + [(2, one), (3, None)]
    start = time.time()
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash.NearDup(width=4)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (2, 1, False), (3, 3, True)}
    assert time.time() - start < 60


def test_passages_of_repeated_rows_are_reported_once(spark):
    one, two = near_pair()
    rows = [(1, one)] * 3 + [(2, two)] * 2 + [(3, None), (None, one)]
    got = passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.source_id) for r in got] == [(2, 1)]
    none = spark.createDataFrame([], "doc_id long, text string, source_id string")
    assert passages.near_passages(none).count() == 0


@pytest.mark.parametrize("role", ["User", "System", "Assistant", "\\a", "user", "", "a: b### "])
def test_roles_are_read_back_as_spelled(spark, role):
    rows = [(1, 0, role, "x"), (1, 1, "assistant", r"\aUser: "), (1, 2, role, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    back = chat.read_chats(chat.format_chats(df)).first()
    assert [(t.role, t.text) for t in back.turns] == [(r[2], r[3] or "") for r in rows]
    assert back.loss_texts == [r"\aUser: "]


def test_nothing_to_learn_a_language_from(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text", None, "s", 9), (2, None, "en", "s", 0)], DOCUMENTS)
    for name, df in {"unlabelled": docs, "empty": docs.filter("false")}.items():
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = queries.op10_language(spark, str(tmp_path / name))
        assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
        assert [(r.lang_pred, r.score) for r in out.collect()] == [("und", 0.0)] * df.count()
    assert language.identify(docs, None).columns == [*docs.columns, "lang_pred", "score", "lang_spans"]


def test_near_dedup_judges_rows(spark):
    unique, other = near_pair(7)[0], near_pair(8)[0]
    one, two = near_pair()
    rows = [(3, one), (5, unique), (5, one), (5, unique), (None, two), (None, other), (9, two), (10, None), (10, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCUMENTS)
    left = corpus_pipeline.near_dedup(spark, docs, SF)
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert got == sorted([(3, one), (5, unique), (None, other), (10, None), (10, "")], key=str)
    assert corpus_pipeline.near_dedup(spark, docs.filter("false"), SF).count() == 0


def test_near_dedup_keeps_the_least_id_of_each_group(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    decided = minhash.near_duplicates(docs).filter("kept").select("doc_id")
    left = corpus_pipeline.near_dedup(spark, docs, SF)
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in decided.collect())
    assert left.count() < len(rows)


def test_stages_of_one_very_long_text_and_of_none(spark):
    long = " ".join(f"word{k % 5000} the quick fox" for k in range(120_000))  # above 1 MiB
    rows = [(1, long, "en", "s", len(long)), (2, long + " end", "en", "s", 1), (3, "a short english text of some words", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    now = corpus_pipeline.near_dedup(spark, corpus_pipeline.language_id(spark, docs, SF), SF)
    assert sorted(r.doc_id for r in now.collect()) == [1, 3]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.filter("false"), SF)
        assert out.count() == 0
        if name != "piece_ids":
            assert out.columns == docs.columns


def test_whole_texts_are_compared(spark):
    base = " ".join(f"t{k}" for k in range(200_000))
    rows = [(1, base), (2, base.replace("t199999", "x")), (3, base[: len(base) // 2])]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash.NearDup(width=4))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(1, 1), (2, 1), (3, 3)}
    assert len(brute.shingles(base, 4)) == 199_997 == got.filter("doc_id = 1").first().n_shingles
    assert got.filter(F.col("n_shingles") < 50_000).count() == 0
