"""Frozen models that lack some of the words: nothing of a text may be lost."""

import math

import pytest
from pyspark.sql import functions as F

from terseforge.api import TextCompressor, compress
from terseforge.operators import scorers
from terseforge.operators import units as U
from terseforge.plans import contexts as X

SEEN = [(1, "The cat sat on the mat. The cat ran.")]
NEW = [(1, "The zebra sat on the mat. Quokkas ran."), (2, "Xylem grows slowly.")]


@pytest.fixture(scope="module")
def rows(spark):
    seen = spark.createDataFrame(SEEN, "doc_id long, text string")
    return U.token_rows(seen, "doc_id", F.col("text"))


def _model(rows, scorer):
    return U.unigram_model(rows) if scorer == "unigram" else U.bigram_model(rows, "doc_id")


@pytest.mark.parametrize("scorer", ["unigram", "bigram"])
@pytest.mark.parametrize("level", ["sent", "phrase", "token"])
@pytest.mark.parametrize("counts", [True, False])
def test_no_word_is_lost(spark, rows, scorer, level, counts):
    new = spark.createDataFrame(NEW, "doc_id long, text string")
    model = _model(rows, scorer)
    got = compress(new, ratio=0.0, level=level, scorer=scorer, model=model if counts else model.drop("n")).collect()
    for r in got:
        said = (r["context"] + "".join(r["masked_units"])).replace(" ", "")
        assert sorted(said) == sorted(dict(NEW)[r["doc_id"]].replace(" ", ""))
    assert {r["doc_id"] for r in got} == {1, 2}


def test_scores_of_the_unseen(spark, rows):
    new = U.token_rows(spark.createDataFrame(NEW, "doc_id long, text string"), "doc_id", F.col("text"))
    counts = {r["token"]: r["n"] for r in _model(rows, "unigram").collect()}
    size = sum(counts.values()) + len(counts)
    for broadcast in (U.BROADCAST_BYTES, 0):
        one = U.scored(new, _model(rows, "unigram"), broadcast).collect()
        two = scorers.bigram_tokens(new, "doc_id", _model(rows, "bigram"), broadcast).collect()
        assert len(one) == len(two) == new.count()
        for r in one:
            assert math.isclose(r["self_info"], -math.log((counts.get(r["token"], 0) + 1) / size))
        pairs = {(r["prev"], r["token"]) for r in _model(rows, "bigram").select("prev", "token").collect()}
        said = {(r["doc_id"], r["sent_idx"], r["pos"]): r for r in two}
        unseen = 0
        for (d, s, p), r in said.items():
            if (said[d, s, p - 1]["token"] if p else "<s>", r["token"]) not in pairs:
                unseen += 1
                assert math.isclose(r["self_info"], -math.log(0.3 * (counts.get(r["token"], 0) + 1) / size))
        assert unseen


def test_other_entries(spark, rows):
    context, masked = TextCompressor(spark, model=_model(rows, "unigram"))(NEW[1][1], 0.0)
    assert "Xylem" in context + "".join(masked)
    texts = spark.createDataFrame(NEW, "row_id long, body string")
    made = X.generate_context(texts, "row_id", "self-info", "token", 0.0, model=_model(rows, "unigram")).collect()
    assert {r["row_id"] for r in made} == {1, 2}
    assert len(X.context_scored_sentences(texts, "row_id", "body", _model(rows, "unigram")).collect()) == 3
