"""Sources: article, news, conversation, question and result files, and plain text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ARTICLE = "entry_id string, published string, title string, authors array<string>, primary_category string, categories array<string>, text string"
NEWS = "title string, link string, content string"
CONVERSATION = "id string, conversations array<struct<`from`: string, value: string>>"
QUESTIONS = "Question string, Answer string"


def article_files(spark: SparkSession, path: str, limit: int | None = None, lines: bool = False) -> DataFrame:
    """Articles of a folder of JSON files, one object each; ``limit`` counts files in order of name.

    With ``lines`` every line is an object, as ``write_articles`` has them.
    """
    paths: str | list[str] = path
    if limit is not None:  # only the listed files are read
        listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select("path").orderBy("path").limit(limit)
        paths = [r["path"] for r in listed.collect()]
        if not paths:
            return spark.createDataFrame([], ARTICLE + ", file string")
    return spark.read.schema(ARTICLE).option("multiLine", not lines).option("encoding", "UTF-8").option("pathGlobFilter", "*.json").json(paths).withColumn("file", F.input_file_name())


def news_file(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """News with the link as entry_id; parquet or JSON lines by the path's ending."""
    rows = spark.read.parquet(path) if path.rstrip("/").endswith("parquet") else spark.read.schema(NEWS).json(path)
    named = rows.select("title", F.col("link").alias("entry_id"), F.col("content").alias("text"))
    return named if limit is None else named.orderBy("entry_id", "title", "text").limit(limit)


def conversation_lines(spark: SparkSession, path: str, limit: int | None = None, least_rounds: int = 4, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Turns of a JSON lines file: id, turn, role, text, num_rounds.

    ``limit`` counts conversations that pass the filters, in order of the file, and lets one more
    through, as the files that were made with it have one more.
    """
    rows = spark.read.schema(CONVERSATION).json(path).withColumn("num_rounds", F.size("conversations")).where(F.col("num_rounds") >= least_rounds)
    if keep is not None:
        rows = keep(rows)
    if limit is not None:
        placed = rows.withColumn("__at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
        rows = placed.orderBy("__at").limit(limit + 1).drop("__at")
    turns = rows.select("id", "num_rounds", F.posexplode("conversations").alias("turn", "u"))
    return turns.select("id", "num_rounds", "turn", F.col("u.from").alias("role"), F.col("u.value").alias("text"))


def question_files(spark: SparkSession, path: str) -> DataFrame:
    """Questions and answers of tab-separated files: file, questions, answers; malformed lines drop out.

    A file without one good line has null arrays; a file of no bytes is not listed by the reader.
    """
    rows = spark.read.schema(QUESTIONS).option("sep", "\t").option("header", True).option("mode", "DROPMALFORMED").csv(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "Question", "Answer")
    packed = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "Question", "Answer"))).alias("q"))
    found = packed.select("file", F.transform("q", lambda x: x["Question"]).alias("questions"), F.transform("q", lambda x: x["Answer"]).alias("answers"))
    every = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return every.withColumn("k", bare(F.col("file"))).join(found.withColumn("k", bare(F.col("file"))).drop("file"), "k", "left").drop("k")


def result_table(spark: SparkSession, path: str, key: str = "ratio") -> DataFrame:
    """A CSV of metrics whose first, unnamed column becomes ``key``."""
    rows = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return rows.withColumnRenamed(rows.columns[0], key)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Plain files, one text each: file, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def submitted(articles: DataFrame, first: str, last: str, limit: int = 8000) -> DataFrame:
    """Articles submitted between two days, the latest first, at most ``limit``."""
    at = F.try_to_timestamp("published", F.lit("yyyyMMddHHmmss"))
    return articles.withColumn("__at", at).where((F.col("__at") >= first) & (F.col("__at") < last)).orderBy(F.desc("__at"), "entry_id").limit(limit).drop("__at")


def main_tex(files: DataFrame, doc: str, name: str) -> DataFrame:
    """Of each document the only .tex file, or main.tex among several; other documents drop out."""
    tex = files.where(F.lower(F.col(name)).endswith(".tex"))
    counted = tex.withColumn("__n", F.count("*").over(Window.partitionBy(doc)))
    return counted.where((F.col("__n") == 1) | (F.col(name) == "main.tex")).drop("__n")


def role_of(c: Column) -> Column:
    """A role without the spellings it is delivered in."""
    return F.lower(F.trim(c))


def token_file(spark: SparkSession, path: str) -> DataFrame:
    """token and self_info of a tab-separated file; tokens keep their blanks and line ends."""
    return spark.read.schema("token string, self_info double").options(sep="\t", escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
