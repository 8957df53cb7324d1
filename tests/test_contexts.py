"""Contexts by method and level, and sentences credited over the whole text."""

import math

import pytest
from pyspark.sql import functions as F

from terseforge.operators import units as U
from terseforge.plans import contexts as X

TEXTS = [(1, "The cat sat on the mat. A dog ran. The cat ran there."), (2, "One two three."), (3, None), (4, "word " * 30 + ".")]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "row_id long, body string")


def test_methods(texts):
    for method in X.METHODS:
        rows = {r["row_id"]: r for r in X.generate_context(texts, "row_id", method, "phrase", 0.5, most=20).collect()}
        assert set(rows) == {1, 2}
        assert all(r["context_masked"] == (method != "no") for r in rows.values())
        assert (rows[1]["masked_units"] is not None) == (method == "self-info")
    assert [r["row_id"] for r in X.generate_context(texts, "row_id", "no", limit=1).collect()] == [1]


def test_arguments_are_checked(texts):
    with pytest.raises(ValueError, match="method"):
        X.generate_context(texts, "row_id", "self-info-sent")
    with pytest.raises(ValueError, match="level"):
        X.generate_context(texts, "row_id", "self-info", "page")


def test_first_sections(spark):
    df = spark.createDataFrame([(1, ["A <cit.> b", "c"]), (2, []), (3, None), (4, ["  "])], "row_id long, sections array<string>")
    assert [tuple(r) for r in X.first_sections(df).collect()] == [(1, "A b")]


def test_whole_text_scores_equal_sentence_means_without_shared_tokens(spark, texts):
    some = texts.where("row_id = 1")
    rows = U.token_rows(some, "row_id", F.col("body"))
    model = U.unigram_model(rows).withColumn("self_info", F.lit(2.0))
    got = X.context_scored_sentences(some, "row_id", "body", model).collect()
    assert len(got) == 3 and all(math.isclose(r["self_info"], 2.0) for r in got)


def test_plain_chunks(spark, texts):
    rows = U.token_rows(texts.where("row_id = 2"), "row_id", F.col("body")).withColumn("self_info", F.lit(1.0))
    assert U.phrase_units(rows, "row_id", "plain").count() == rows.count()
