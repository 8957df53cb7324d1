"""The experiment: contexts of articles by method, level and ratio, through a task, measured and logged.

    python -m terseforge.experiment ARTICLES OUT --model base --ratios 0.2 0.35 --tasks reconstruction
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terseforge.operators import metrics as E
from terseforge.plans import contexts as X
from terseforge.plans import tasks as K
from terseforge.sources import writers as W

TASKS = ("reconstruction", "summarisation")
METHODS = ("self-info", "Random")
RATIOS = (0.2, 0.35, 0.5, 0.65, 0.8)


def answers(contexts: DataFrame, task: str, family: str, generator: str = "identity") -> DataFrame:
    """Contexts with the cleaned answer of a task."""
    prompt = {"reconstruction": K.reconstruct_prompt, "summarisation": K.summarise_prompt}[task](F.lit(family), F.col("context"))
    made = K.generated(contexts.withColumn("prompt", prompt), "prompt", generator)
    return made.withColumn("answer", K.clean_answer(F.lit(family), F.lit(task), F.col("answer"))).drop("prompt")


def run(texts: DataFrame, key: str = "row_id", methods: tuple[str, ...] = METHODS, levels: tuple[str, ...] = ("phrase",), ratios: tuple[float, ...] = RATIOS, tasks: tuple[str, ...] = TASKS, family: str = "base", generator: str = "identity", metrics: tuple[str, ...] = ("bleu", "meteor", "rouge")) -> DataFrame:
    """task, method, level, ratio and metrics: each cell's answers against those under the unmasked contexts.

    ``texts`` has ``key`` and body. The unmasked contexts are made once for all ratios.
    """
    bare = X.generate_context(texts, key, "no")
    cells = None
    for task in tasks:
        reference = answers(bare, task, family, generator).select(key, F.col("answer").alias("reference"))
        for method in methods:
            for level in levels:
                for ratio in ratios:
                    made = answers(X.generate_context(texts, key, method, level, ratio), task, family, generator)
                    cell = made.join(reference, key).select(F.lit(task).alias("task"), F.lit(method).alias("method"), F.lit(level).alias("level"), F.lit(ratio).alias("ratio"), F.concat_ws("|", F.lit(task), F.lit(method), F.lit(level), F.lit(str(ratio)), F.col(key).cast("string")).alias("pair"), "answer", "reference")
                    cells = cell if cells is None else cells.unionByName(cell)
    return E.evaluate(cells, "pair", "answer", "reference", metrics, ["task", "method", "level", "ratio"])


def main(argv: list[str] | None = None) -> None:
    """Runs the experiment over a folder of article files; writes metrics and logs each cell."""
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("articles")
    p.add_argument("out")
    p.add_argument("--articles-limit", type=int)
    p.add_argument("--model", default="base", help="the name of a model, which decides its family")
    p.add_argument("--generator", default="identity")
    p.add_argument("--methods", nargs="+", default=METHODS, choices=METHODS)
    p.add_argument("--levels", nargs="+", default=("phrase",), choices=X.LEVELS)
    p.add_argument("--ratios", nargs="+", type=float, default=RATIOS)
    p.add_argument("--tasks", nargs="+", default=TASKS, choices=TASKS)
    a = p.parse_args(argv)
    from terseforge.runtime import session
    from terseforge.sources.readers import article_files

    spark: SparkSession = session("experiment")
    articles = article_files(spark, a.articles, a.articles_limit)
    from terseforge.functions import text as T

    texts = X.first_sections(articles.select(F.col("entry_id").alias("row_id"), T.sections(F.col("text")).alias("sections")))
    kind = spark.range(1).select(K.family(F.lit(a.model)).alias("k")).first()["k"]
    found = run(texts, "row_id", tuple(a.methods), tuple(a.levels), tuple(a.ratios), tuple(a.tasks), kind, a.generator).cache()
    W.write_metrics(found, a.out)
    logging.basicConfig(level=logging.INFO)
    for line in W.performance_lines(found, ["task", "method", "level", "ratio"]):
        logging.info(line)


if __name__ == "__main__":
    main()
