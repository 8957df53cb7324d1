"""Sinks: articles, scored corpora that can be resumed, answers, metrics, tokens and printed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terseforge.plans.tasks import pending


def write_articles(articles: DataFrame, path: str) -> None:
    """JSON, one object per article."""
    articles.write.mode("overwrite").json(path)


def write_scored(scored: DataFrame, path: str) -> None:
    """The checkpoint of a scored corpus; a second write appends what it adds."""
    scored.write.mode("append").parquet(path)


def unscored(articles: DataFrame, path: str, key: str) -> DataFrame:
    """The articles that a checkpoint does not hold yet."""
    return pending(articles, articles.sparkSession.read.parquet(path), [key])


def write_answers(answers: DataFrame, path: str) -> None:
    """Answers by dataset, model, task and ratio; contexts without a ratio share the null partition."""
    shared = answers.withColumn("ratio", F.when(F.col("context_type") != "no", F.col("ratio")))
    shared.write.mode("append").partitionBy("dataset", "model", "task", "ratio").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One CSV file with a header; metric tables are small."""
    metrics.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_tokens(tokens: DataFrame, path: str) -> None:
    """token and self_info, tab-separated."""
    tokens.select("token", "self_info").write.mode("overwrite").options(sep="\t", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_texts(texts: DataFrame, column: str, path: str) -> None:
    """One text per line; line ends inside a text become blanks."""
    texts.select(F.regexp_replace(column, r"[\r\n]+", " ").alias("value")).write.mode("overwrite").text(path)


def latex_table(table: DataFrame, places: int = 3, most: int = 10_000) -> str:
    """A small table as LaTeX; one of more than ``most`` rows is an error."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no printed table")
    show = lambda v: f"{v:.{places}f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = [" & ".join(table.columns) + r" \\", r"\midrule", *(" & ".join(show(v) for v in r) + r" \\" for r in rows)]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(table.columns)}}}", r"\toprule", *lines, r"\bottomrule", r"\end{tabular}"])


def chat_table(turns: DataFrame, key: str) -> DataFrame:
    """Conversations in the published form: ``key`` and chat, an array of (role, text) in order."""
    packed = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("u"))
    return packed.select(key, F.transform("u", lambda x: F.array(x["role"], x["text"])).alias("chat"))


def write_conversations(turns: DataFrame, path: str, key: str = "conv_id") -> None:
    """JSON lines: id and conversations, an array of (from, value) in order of the turns."""
    packed = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("u"))
    packed.select(F.col(key).cast("string").alias("id"), F.transform("u", lambda x: F.struct(x["role"].alias("from"), x["text"].alias("value"))).alias("conversations")).write.mode("overwrite").json(path)


def write_news(news: DataFrame, path: str) -> None:
    """JSON lines: title, link, content."""
    news.select("title", "link", "content").write.mode("overwrite").json(path)


def performance_lines(metrics: DataFrame, keys: list[str]) -> list[str]:
    """One line per cell of a small table of metrics, for the log of an experiment."""
    rows = metrics.orderBy(*keys).limit(10_000).collect()
    return [" ".join(f"{k}={r[k]}" for k in keys) + ": " + ", ".join(f"{c} {r[c]:.4f}" if isinstance(r[c], float) else f"{c} {r[c]}" for c in metrics.columns if c not in keys) for r in rows]


def write_questions(questions: DataFrame, path: str, by: str, order: str) -> None:
    """Tab-separated files of Question and Answer, one for each value of ``by``, in its folder, in ``order``."""
    placed = questions.repartition(by).sortWithinPartitions(by, order)
    placed.select(by, F.col("question").alias("Question"), F.col("answer").alias("Answer")).write.mode("overwrite").option("sep", "\t").option("header", True).partitionBy(by).csv(path)
