"""Compression of streamed documents.

Against a frozen model a document is compressed by itself, so the whole plan is one narrow map over
the stream, without state: sentences, scores and the mask are array expressions in the row. Here a
sentence's score is the mean code length of its words' lengths, which needs no table; a scored stream
joins a static model table instead.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terseforge.functions import text as T
from terseforge.operators import masking as M
from terseforge.runtime import shared_folder


def length_score(sentence: Column) -> Column:
    """A stand-in score of a sentence: the logarithm of its mean token length."""
    toks = T.tokens(sentence)
    return F.round(F.ln(F.length(sentence) / F.nullif(F.size(toks), F.lit(0)) + 1.0), 6)


def compressed(stream: DataFrame, key: str, text: str, ratio: float) -> DataFrame:
    """key, context, n_masked of every document; works on batch and streaming data alike."""
    units = F.transform(T.sentences(T.collapse(F.col(text))), lambda s: F.struct(s.alias("text"), length_score(s).alias("self_info")))
    held = stream.select(key, units.alias("units"))
    return held.select(key, M.masked_text(F.col("units"), ratio, "sent").alias("context"), F.size(M.masked_units(F.col("units"), ratio)).cast("bigint").alias("n_masked"))


def compress_stream_once(spark: SparkSession, path: str, key: str, text: str, ratio: float, out: str | None = None) -> DataFrame:
    """Runs the stream over all files that are there, and returns what it wrote.

    Offsets and results go under ``out`` (a folder that executors share); a run that is started again
    with the same folder goes on where the last one stopped and writes no file twice.
    """
    root = out or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    static = spark.read.parquet(path)
    local = path.removeprefix("file://")
    source = path if os.path.isdir(local) else f"{os.path.dirname(path)}/{os.path.basename(path)}*"
    stream = spark.readStream.schema(static.schema).parquet(source)
    started = compressed(stream, key, text, ratio).writeStream.format("parquet").option("checkpointLocation", f"{root}/offsets").option("path", f"{root}/rows").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.parquet(f"{root}/rows")
