"""Exact token counts under a public tokenizer, and the budgets that add them up.

A document over ``CHUNK`` characters is cut, only at positions where the tokenizer's pre-splitting
provably ends a piece whatever stands on either side: before white space that follows a character
which is none (no alternative of the pattern holds white space after anything else), or between a
letter and a CJK mark. Its chunks are spread over all workers by a salt and their exact counts are
summed, so the sum equals the count of the uncut text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terseforge.runtime import durable, small_batches

#: Rank file of the tokenizer; any of the same kind may be named instead.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters from which a document is cut.
CHUNK = 50_000
# Fixed value: white space as the tokenizer's pattern has it, which Python's own class widens by U+001C to U+001F.
_BLANK = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_BOUNDARY = re.compile(rf"(?<=[^{_BLANK}])(?=[{_BLANK}])|(?<=[^\W\d_])(?=[。，！？、；：])")


@lru_cache(maxsize=2)
def encoding(path: str):  # noqa: ANN201
    """The tokenizer of a rank file, once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def independent_chunks(text: str, size: int = CHUNK) -> list[str]:
    """The text in chunks of at least ``size`` characters, cut only at proven boundaries."""
    out, start = [], 0
    while len(text) - start > size:
        m = _BOUNDARY.search(text, start + size)
        if m is None:
            break
        out.append(text[start : m.start()])
        start = m.start()
    out.append(text[start:])
    return out


def _kinds(df: DataFrame, n: int) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema[:n])


def token_counts(df: DataFrame, keys: list[str], text: str, path: str = TOKENIZER, size: int = CHUNK) -> DataFrame:
    """``keys`` and n_tokens (bigint) of every row; ``keys`` must name a row.

    A null or empty text has 0 tokens. The texts are read once: those of at most ``size`` characters
    are counted there, longer ones are cut there, and only their chunks go on, dealt out over all
    workers by a salt; their counts are summed. What the one pass gives is kept in the shared folder.
    Other columns are ignored.
    """
    small_batches(df.sparkSession)
    n = len(keys)
    source = df.select(*keys, F.col(text).alias("__t"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoding(path).encode_ordinary
        for batch in batches:
            rows, counts, salts, chunks = [], [], [], []
            for i, t in enumerate(batch.column(n).to_pylist()):
                parts = independent_chunks(t, size) if t and len(t) > size else None
                for k, part in enumerate(parts or [None]):
                    rows.append(i)
                    counts.append(None if parts else len(count(t)) if t else 0)
                    salts.append(k)
                    chunks.append(part)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in range(n)], pa.array(counts, pa.int64()), pa.array(salts, pa.int32()), pa.array(chunks, pa.string())], names=[*keys, "n_tokens", "__salt", "__t"])

    def count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoding(path).encode_ordinary
        for batch in batches:
            found = [len(count(t)) for t in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(n)], pa.array(found, pa.int64())], names=[*keys, "n_tokens"])

    first = durable(source.mapInArrow(read, f"{_kinds(source, n)}, n_tokens bigint, __salt int, __t string"))
    long = first.where(F.col("__t").isNotNull()).select(*keys, "__t", "__salt").repartition(*keys, "__salt").select(*keys, "__t")
    summed = long.mapInArrow(count_chunks, f"{_kinds(source, n)}, n_tokens bigint").groupBy(*keys).agg(F.sum("n_tokens").alias("n_tokens"))
    return first.where(F.col("__t").isNull()).select(*keys, "n_tokens").unionByName(summed)


def budget(counts: DataFrame, slices: list[str]) -> DataFrame:
    """Totals over every combination of ``slices`` and over all rows (slices null): documents, tokens."""
    return counts.groupBy(*slices).agg(F.count("*").alias("n_texts"), F.sum("n_tokens").alias("n_tokens"))


def canonical_source(c: Column) -> Column:
    """A source's name without the spellings it is delivered in: case and outer blanks."""
    return F.lower(F.trim(c))


def mixture(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: str = TOKENIZER, total_tokens: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(copies, shares): the mixture's copies of documents, and the shares asked and reached.

    Token totals per source give each source's rate, target share x mixture size / its tokens. A
    document comes floor(rate) times, plus once more if its seeded hash falls below the fraction.
    ``total_tokens`` is the size asked for; by default it is the largest at which no source would need
    more than its max_repeats, so that every share can be met. Targets without documents, or whose
    share or cap is null or not above 0, are reported with rate 0 and the shares of the others are
    scaled to one. A rate above the cap is cut to the cap: a larger mixture then falls short of its
    size, and the shares reported are those reached. Sources are matched without case and outer blanks; a null source is never drawn.

    copies: ``key``, source, copy_no (from 0), n_tokens. shares: source, target_share, max_repeats,
    n_documents, n_tokens, rate, expected_tokens, mixed_tokens, mixed_share. Targets are few: the
    rates are broadcast, the documents are never shuffled.
    """
    named = documents.select(F.col(key), canonical_source(F.col(source)).alias("source"), F.col(text).alias("__text"))
    asked = targets.select(canonical_source(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")).groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    wanted = named.join(F.broadcast(asked.select("source")), "source", "left_semi")
    counts = token_counts(wanted, [key, "source"], "__text", path)
    per = counts.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))
    rows = asked.join(per, "source", "left").collect()  # one row per target
    present = [r for r in rows if all((r[c] or 0) > 0 for c in ("n_tokens", "target_share", "max_repeats"))]
    weight = sum(r["target_share"] for r in present) or 1.0
    room = min((r["max_repeats"] * r["n_tokens"] * weight / r["target_share"] for r in present), default=0.0)
    size = room if total_tokens is None else float(total_tokens)
    rates = [(r["source"], r["target_share"], r["max_repeats"], r["n_documents"] or 0, r["n_tokens"] or 0, min(float(r["max_repeats"]), r["target_share"] / weight * size / r["n_tokens"]) if r in present else 0.0) for r in rows]
    spark = documents.sparkSession
    table = spark.createDataFrame(rates, "source string, target_share double, max_repeats int, n_documents bigint, n_tokens bigint, rate double")
    # 52 bits of a hash of the key and the seed: uniform in [0, 1), whatever the partitioning.
    uniform = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 12) / F.lit(float(1 << 52))
    whole = F.floor("rate")
    copies_of = (whole + F.when(uniform < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    drawn = counts.join(F.broadcast(table.select("source", "rate")), "source").withColumn("__n", copies_of).where("__n > 0")
    copies = drawn.select(key, "source", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("copy_no"), "n_tokens")
    mixed = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("__n")).alias("mixed_tokens"))
    joined = table.join(F.broadcast(mixed), "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    total = joined.agg(F.sum("mixed_tokens").alias("__all"))
    shares = joined.join(F.broadcast(total)).select("source", "target_share", "max_repeats", "n_documents", "n_tokens", "rate", (F.col("rate") * F.col("n_tokens")).alias("expected_tokens"), "mixed_tokens", F.when(F.col("__all") > 0, F.col("mixed_tokens") / F.col("__all")).otherwise(0.0).alias("mixed_share"))
    return copies, shares
