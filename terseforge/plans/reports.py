"""Tables over measured cells: means, unweighted subtotals, gaps to a baseline, transposition, heat maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The metrics of a cell, in the order of the reports.
METRICS = ("bleu", "meteor", "rouge1", "rouge2", "rougeL")
#: Score given to role markers; it takes part in percentiles and not in a heat map's maximum.
SENTINEL = 100.0


def mean_by(cells: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean of every metric per group."""
    return cells.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])


def with_average_row(means: DataFrame, group: str, member: str, metrics: list[str], label: str = "avg") -> DataFrame:
    """The rows and, per group, the unweighted mean of its members under ``label``."""
    average = means.groupBy(group).agg(*[F.avg(m).alias(m) for m in metrics]).withColumn(member, F.lit(label))
    return means.select(group, member, *metrics).unionByName(average)


def gaps(means: DataFrame, group: str, member: str, baseline: str, metrics: list[str]) -> DataFrame:
    """Baseline minus the group's value per member, for every other group. The baseline's few rows are broadcast."""
    base = means.where(F.col(group) == baseline).select(member, *[F.col(m).alias(f"base_{m}") for m in metrics])
    return means.where(F.col(group) != baseline).join(F.broadcast(base), member).select(group, member, *metrics, *[(F.col(f"base_{m}") - F.col(m)).alias(f"gap_{m}") for m in metrics])


def formatted(value: Column, gap: Column, places: int = 2) -> Column:
    """A value without its leading digit and the gap in brackets, as printed tables have them."""
    return F.concat(F.substr(F.format_string("%.3f", value), F.lit(2)), F.lit(" ("), F.substr(F.format_string(f"%.{places}f", gap), F.lit(2)), F.lit(")"))


def transposed(table: DataFrame, key: str, metrics: list[str], values: list[str]) -> DataFrame:
    """Metrics as rows, the listed values of ``key`` as columns."""
    long = table.unpivot([key], metrics, "metric", "value")
    return long.groupBy("metric").pivot(key, values).agg(F.first("value"))


def heat(units: DataFrame, key: str, order: list[str], power: float = 1.2) -> DataFrame:
    """Units with their score raised, scaled to 0-100 in the document, and marked above the median.

    Sentinels are left out of the maximum and shown as 100; documents are independent.
    """
    doc = Window.partitionBy(key)
    real = F.when(F.col("self_info") != SENTINEL, F.pow("self_info", F.lit(power)))
    raised = units.withColumn("__p", real)
    low, high = F.min("__p").over(doc), F.max("__p").over(doc)
    scaled = F.when(F.col("self_info") == SENTINEL, 100.0).when(high > low, 100 * (F.col("__p") - low) / (high - low)).otherwise(0.0)
    median = F.percentile("self_info", F.lit(0.5)).over(doc)
    return raised.select(key, *order, "text", "self_info", scaled.alias("heat"), (F.col("self_info") > median).alias("high"))


def heat_map(heated: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One LaTeX line per document: high units coloured by their heat, the others struck out."""
    cell = F.when(F.col("high"), F.concat(F.lit("\\colorize{"), F.format_string("%.1f", F.col("heat")), F.lit("}{"), F.col("text"), F.lit("}"))).otherwise(F.concat(F.lit("\\sout{"), F.col("text"), F.lit("}")))
    packed = heated.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, cell.alias("c")))).alias("u"))
    return packed.select(key, F.array_join(F.transform("u", lambda x: x["c"]), "").alias("latex"))


def low_runs(units: DataFrame, key: str, order: str, limit: str) -> DataFrame:
    """key, first, last, n of each run of neighbouring units under the document's limit that a higher one ends."""
    w = Window.partitionBy(key).orderBy(order)
    low = F.col("self_info") < F.col(limit)
    runs = units.withColumn("__low", low).withColumn("__run", F.sum(F.when(~low, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__end", F.max(order).over(Window.partitionBy(key)))
    grouped = runs.where("__low").groupBy(key, "__run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), F.max("__end").alias("__end"))
    return grouped.where(F.col("last") < F.col("__end")).select(key, "first", "last", "n")
