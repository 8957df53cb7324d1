"""Cleaning and cutting against Python's own string functions."""

import re

import pytest
from pyspark.sql import functions as F

from terseforge.functions import text as T

SENTENCES = [
    "Dr. Smith e.g. this. Ok? Yes! No. i.e. é.à. Fin. A.B. c", "a. b. c", "É.é. x. y", "x.\ny.\r\nz?\tq", "a. ", "¿Sí? ½.½. z", "a. b.\x1cc", "", "   ", "。中文。没有 break. Next",
]
SPLIT = re.compile(r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?)\s")


def _column(spark, values, make):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r["x"] for r in df.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


def test_sentences_as_python(spark):
    want = [[s.strip() for s in SPLIT.split(t) if s.strip()] for t in SENTENCES]
    assert _column(spark, SENTENCES, T.sentences) == want


def test_collapse_as_python(spark):
    values = ["a \t\n b\x0bc\x1cd\x85e  f", "", " \n ", "x"]
    assert _column(spark, values, T.collapse) == [re.sub(r"\s+", " ", v) for v in values]
    assert _column(spark, values, T.strip) == [v.strip() for v in values]


def test_sections(spark):
    values = ["pre § A x\n§.§ B y\n§ C", "no mark", "§ \n§ Z §.§ q § ", None]
    assert _column(spark, values, T.sections) == [["A x §.§ B y ", "C"], ["no mark"], ["Z §.§ q "], None]


def test_tokens_tile(spark):
    for t, toks in zip(SENTENCES, _column(spark, [re.sub(r"\s+", " ", s).strip() for s in SENTENCES], T.tokens), strict=True):
        assert "".join(toks) == re.sub(r"\s+", " ", t).strip()


@pytest.mark.parametrize(("text", "mark", "want"), [("a\nb\nc", "\n", "a\nb"), ("abc", "\n", "abc"), ("a\n\nb", "\n\n", "a"), ("\n", "\n", "")])
def test_last_piece_dropped(spark, text, mark, want):
    assert _column(spark, [text], lambda c: T.last_piece_dropped(c, mark)) == [want]


def test_utterance_line(spark):
    df = spark.createDataFrame([("gpt", "Yes."), ("human", "so")], "r string, t string")
    assert [r[0] for r in df.select(T.utterance_line(F.col("r"), F.col("t"))).collect()] == ["gpt: Yes.", "human: so."]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(T.ngrams(F.col("t"), 2)).collect()] == [["a b", "b c"], [], []]
