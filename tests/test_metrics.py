"""Overlap metrics, reports and tasks on hand-made values."""

import math

from pyspark.sql import functions as F

from terseforge.operators import metrics as E
from terseforge.plans import reports as R
from terseforge.plans import tasks as K
from terseforge.sources.html import markup_to_text


def test_lcs_against_the_table():
    import random

    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert E.lcs_length(a, b) == t[-1][-1]


def test_bleu_of_equal_texts_is_one(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat .", "the cat sat on the mat ."), (2, "a b c d e", "a b c d e")], "i int, p string, r string")
    row = E.corpus_bleu(df, "i", "p", "r").first()
    assert math.isclose(row["bleu"], 1.0) and row["brevity"] == 1.0
    none = spark.createDataFrame([(1, "x y", "a b c")], "i int, p string, r string")
    assert E.corpus_bleu(none, "i", "p", "r").first()["bleu"] == 0.0


def test_rouge_with_empty_sides(spark):
    df = spark.createDataFrame([(1, "", "a b"), (2, "a b", "a c"), (3, None, "a")], "i int, p string, r string")
    got = {r["i"]: r["f1"] for r in E.rouge_n(df, "i", "p", "r", 1).collect()}
    assert got == {1: 0.0, 2: 0.5, 3: 0.0}


def test_meteor_penalises_fragments():
    assert E.meteor_score(["a", "b"], ["a", "b"]) > E.meteor_score(["b", "a"], ["a", "b"]) > 0
    assert E.meteor_score([], ["a"]) == 0.0


def test_average_row_is_unweighted(spark):
    df = spark.createDataFrame([("SC-0.2", "summarisation", 0.25084), ("SC-0.2", "qa", 0.42558)], "m string, t string, bleu double")
    rows = {(r["m"], r["t"]): r["bleu"] for r in R.with_average_row(df, "m", "t", ["bleu"]).collect()}
    assert math.isclose(rows["SC-0.2", "avg"], 0.33821, abs_tol=1e-5)


def test_clean_answers(spark):
    rows = [("instruct", "qa", "x ASSISTANT: y "), ("instruct", "qa", "plain"), ("base", "summarisation", " a\nb\nc"), ("base", "qa", "a\n\nb"), ("base", "reconstruction", "a \nb")]
    df = spark.createDataFrame(rows, "k string, t string, a string")
    assert [r[0] for r in df.select(K.clean_answer(F.col("k"), F.col("t"), F.col("a"))).collect()] == ["y", "plain", "a\nb", "a", "a "]


def test_markup():
    assert markup_to_text("<p>One</p><p>Two <b>x</b></p>") == "One Two x"
    assert markup_to_text("a &lt; b") == "a < b"
    assert markup_to_text("plain") == "plain" and markup_to_text(None) is None
