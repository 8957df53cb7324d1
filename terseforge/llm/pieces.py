"""Splitting oversized items at natural boundaries, range by range.

No task needs an item as a whole. A range is a stretch of an item that begins at the start of a line
after a blank line; since no boundary rule looks across a blank line, its halo is no more than the
rest of the block in which it ends. Items in tables are cut into ranges where they are read. Giant
files are read by byte range through the cluster's file system: a task takes the blocks that begin in
its range and reads on to the end of the last one.

A worker finds the boundaries of its ranges and reports two small tables: a summary of the stretches
per boundary level, which ranges of one task are added up to before they leave it, and the offsets
at which a cut can be needed. Summaries are stitched over an item's parts by a prefix sum of their
lengths. Pieces are packed from the offsets alone, which pass in order through a window of one
piece's reach: each cut is the farthest paragraph boundary that keeps the limit, else the farthest
sentence boundary, else white space, else the limit itself. Neither table depends on where ranges end.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terseforge.llm.sentences import sentence_spans
from terseforge.runtime import reachable, small_batches

LIMIT, OVERLAP = 6000, 200
#: Least characters of a range; it ends with the block that reaches them.
RANGE = 200_000
LEVELS = ("paragraph", "sentence", "space")

_BLANK_LINES = re.compile(r"\n(?:[^\S\n]*\n)+")
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n")
_SPACE = re.compile(r"\s+")


# --- boundaries of one range ----------------------------------------------------------------------


def ranges_of(text: str, size: int) -> Iterator[str]:
    """A text in ranges of at least ``size`` characters, cut after blank lines."""
    start = 0
    while start < len(text):
        m = _BLANK_LINES.search(text, start + size)
        end = m.end() if m else len(text)
        yield text[start:end]
        start = end


class Boundaries:
    """Where a range can be divided: per level the stretches' ends and starts, and the places to cut."""

    def __init__(self, chunk: str) -> None:
        self.chunk, self.own = chunk, len(chunk)
        self.first = self.own - len(chunk.lstrip())
        self.last = len(chunk.rstrip())
        self.paragraphs: list[tuple[int, int]] = []  # (end of a stretch, start of the next)
        self.cuts: list[int] = []
        for m in _BLANK_LINES.finditer(chunk):
            end = m.start()
            while end and chunk[end - 1].isspace():
                end -= 1
            if end:  # blank lines before all words belong to the range before
                start = m.end()
                while start < self.own and chunk[start].isspace():
                    start += 1
                self.paragraphs.append((end, start))
                self.cuts.append(_BLANK_LINE.match(chunk, m.start()).end())
        spans = sentence_spans(chunk)
        blocks = {s for _, s in self.paragraphs}
        self.sentences = [(a[1], b[0]) for a, b in zip(spans, spans[1:], strict=False)]
        self.inner = [s for _, s in self.sentences if s not in blocks]
        if self.paragraphs and self.paragraphs[-1][1] == self.own:
            self.sentences.append(self.paragraphs[-1])

    def stretches(self, least: int) -> list[tuple[int | None, int | None, int]]:
        """Per level: end of the first stretch, start of the last, longest between; of runs without white space only those over ``least``."""
        out: list[tuple[int | None, int | None, int]] = []
        for gaps in (self.paragraphs, self.sentences):
            out.append((gaps[0][0], gaps[-1][1], max((b[0] - a[1] for a, b in zip(gaps, gaps[1:], strict=False)), default=0)) if gaps else (None, None, 0))
        inside = _SPACE.search(self.chunk, self.first)
        if inside is None or self.first == self.own:
            return [*out, (None, None, 0)]
        tail = self.own
        while not self.chunk[tail - 1].isspace():
            tail -= 1
        runs = [m.end() - m.start() for m in re.compile(rf"\S{{{least + 1},}}").finditer(self.chunk, inside.end(), tail)]
        return [*out, (inside.start(), tail, max(runs, default=0))]

    def places(self, reach: int) -> list[list[int]]:
        """Per level the offsets at which a cut can be needed.

        A finer level is cut at only where a stretch of ``reach`` has no place of a coarser one, so
        between neighbours that are nearer than that its places are left out.
        """
        inner = _needed(self.inner, self.cuts, self.own, reach)
        coarse = sorted({*self.cuts, *inner})
        spaces: list[int] = []
        edges = [0, *coarse, self.own]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if b - a > reach or k in (0, len(coarse)):
                for m in _SPACE.finditer(self.chunk, a, b):
                    spaces += range(m.start() + 1, m.end() + 1)
        return [self.cuts, inner, spaces]


def _needed(fine: list[int], coarse: list[int], own: int, reach: int) -> list[int]:
    """Places of a fine level in gaps of a coarse one wider than ``reach``, and in the first and last gap."""
    edges = [0, *coarse, own]
    out: list[int] = []
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if b - a > reach or k in (0, len(coarse)):
            out += fine[bisect.bisect_left(fine, a) : bisect.bisect_left(fine, b)]
    return out


class Summary:
    """Stretches of consecutive ranges, added up."""

    def __init__(self) -> None:
        self.own = self.added = 0
        self.first: int | None = None
        self.last: int | None = None
        self.heads: list[int | None] = [None] * len(LEVELS)
        self.tails: list[int | None] = [None] * len(LEVELS)
        self.longest = [0] * len(LEVELS)

    def add(self, b: Boundaries, least: int) -> None:
        base = self.own
        self.own += b.own
        if b.first == b.own:
            self.tails = [base + b.own if t == base else t for t in self.tails]
            return  # nothing but white space
        for k, (head, tail, longest) in enumerate(b.stretches(least)):
            if head is not None:
                if self.tails[k] is None:
                    self.heads[k] = base + head
                else:
                    begun = base + b.first if self.tails[k] == base else self.tails[k]
                    self.longest[k] = max(self.longest[k], base + head - begun, longest)
                if self.heads[k] == base + head:
                    self.longest[k] = max(self.longest[k], longest)
                self.tails[k] = base + tail
        self.first = base + b.first if self.first is None else self.first
        self.last = base + b.last


_SUMMARY = "own bigint, added bigint, first bigint, last bigint, heads array<bigint>, tails array<bigint>, longest array<bigint>"
_SUMMARY_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()))


def _ddl(df: DataFrame, n: int) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema[:n])


# --- items in tables --------------------------------------------------------------------------------


def _oversized(df: DataFrame, keys: list[str], text: str, limit: int) -> DataFrame:
    small_batches(df.sparkSession)
    return df.where(F.length(text) > limit).select(*keys, F.col(text).alias("__t"))


def item_summaries(df: DataFrame, keys: list[str], text: str, limit: int = LIMIT, size: int = RANGE) -> DataFrame:
    """Of every item over the limit: keys, part (0) and the summary of its ranges, in one narrow pass."""
    source = _oversized(df, keys, text, limit)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for t in batch.column(n):
                s = Summary()
                for chunk in ranges_of(t.as_py(), size):
                    s.add(Boundaries(chunk), limit)
                made.append(s)
            values = [[getattr(s, c.split()[0]) for s in made] for c in _SUMMARY.split(", ")]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(n)], pa.array([0] * len(made), pa.int64()), *map(pa.array, values, _SUMMARY_KINDS)], names=[*keys, "part", *[c.split()[0] for c in _SUMMARY.split(", ")]])

    return source.mapInArrow(run, f"{_ddl(source, n)}, part bigint, {_SUMMARY}")


def item_places(df: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """Of every item over the limit, range by range: keys, part, own and places per level."""
    source = _oversized(df, keys, text, limit)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column(n)):
                for part, chunk in enumerate(ranges_of(t.as_py(), size)):
                    places = Boundaries(chunk).places(limit - overlap)
                    yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(i, 1) for k in range(n)], pa.array([part], pa.int64()), pa.array([len(chunk)], pa.int64()), pa.array([places], pa.list_(pa.list_(pa.int32()))), pa.array([0], pa.int64())], names=[*keys, "part", "own", "places", "added"])

    return source.mapInArrow(run, f"{_ddl(source, n)}, part bigint, own bigint, places array<array<int>>, added bigint")


# --- giant files ------------------------------------------------------------------------------------


def file_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of UTF-8 files, in order within each byte range: path, at (first byte of the range), block.

    The readers go through the cluster's file system. A byte range has
    ``spark.sql.files.maxPartitionBytes`` at most; a block belongs to the range in which it begins.
    """
    reachable(spark)
    rows = spark.read.option("lineSep", "\n\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("block"), F.col("_metadata.file_size").alias("bytes"))


class _Chunk(NamedTuple):
    path: str
    at: int  # first byte of the byte range
    no: int  # number in the byte range
    text: str
    added: int  # summed over a file, the characters of a blank line that its end does not have


def _file_chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[_Chunk]:
    """Ranges of at least ``size`` characters, put together from blocks.

    Every block is given the blank line that ended it. Only the last one of a file may have had none:
    then the bytes add up to two more than the file has.
    """
    path, at, no, held, n, added = None, None, 0, [], 0, 0
    for batch in batches:
        for p, a, block, size_of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (p, a) != (path, at) or n >= size:
                if held:
                    yield _Chunk(path, at, no, "".join(held), added)
                no = no + 1 if (p, a) == (path, at) else 0
                path, at, held, n, added = p, a, [], 0, -size_of if a == 0 and no == 0 else 0
            held.append(block + "\n\n")
            n += len(block) + 2
            added += len(block.encode()) + 2
    if held:
        yield _Chunk(path, at, no, "".join(held), added)


def file_summaries(spark: SparkSession, path: str, limit: int = LIMIT, size: int = RANGE) -> DataFrame:
    """Of every file and byte range: path, part (its first byte) and the summary of its blocks."""
    source = file_blocks(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[str, int], Summary] = {}
        for c in _file_chunks(batches, size):
            s = made.setdefault((c.path, c.at), Summary())
            s.add(Boundaries(c.text), limit)
            s.added += c.added
        values = [[getattr(s, c.split()[0]) for s in made.values()] for c in _SUMMARY.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.string()), pa.array([a for _, a in made], pa.int64()), *map(pa.array, values, _SUMMARY_KINDS)], names=["path", "part", *[c.split()[0] for c in _SUMMARY.split(", ")]])

    return source.mapInArrow(run, f"path string, part bigint, {_SUMMARY}")


def file_places(spark: SparkSession, path: str, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """Of every file, range by range: path, part, own and places per level."""
    source = file_blocks(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _file_chunks(batches, size):
            # Ranges of a file are in the order of their byte range, then of their number in it.
            yield pa.RecordBatch.from_arrays([pa.array([c.path], pa.string()), pa.array([(c.at << 16) + c.no], pa.int64()), pa.array([len(c.text)], pa.int64()), pa.array([Boundaries(c.text).places(limit - overlap)], pa.list_(pa.list_(pa.int32()))), pa.array([c.added], pa.int64())], names=["path", "part", "own", "places", "added"])

    return source.mapInArrow(run, "path string, part bigint, own bigint, places array<array<int>>, added bigint")


# --- stitching ----------------------------------------------------------------------------------------


def cut_levels(parts: DataFrame, keys: list[str], limit: int = LIMIT) -> DataFrame:
    """keys, cut_level of items over the limit: the coarsest level that alone leaves no stretch over it, else none.

    ``parts`` are summaries; an item's parts are few, since each adds up all ranges of a task. Their
    lengths are prefix-summed, and the stretches that cross parts are completed.
    """
    w = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("base", F.coalesce(F.sum("own").over(w), F.lit(0)))
    columns, sums = [], []
    for k, level in enumerate(LEVELS):
        head, tail = (F.col("base") + F.col(c)[k] for c in ("heads", "tails"))
        before = F.last(F.when(F.col("tails")[k].isNotNull(), tail), True).over(w)
        begun = F.coalesce(F.when(before == F.col("base"), F.col("base") + F.col("first")).otherwise(before), F.first(F.col("base") + F.col("first"), True).over(w), F.col("base") + F.col("first"))
        columns += [F.greatest(F.col("longest")[k], head - begun).alias(f"most_{level}"), tail.alias(f"tail_{level}")]
        sums += [F.max(f"most_{level}").alias(f"most_{level}"), F.max(f"tail_{level}").alias(f"tail_{level}")]
    items = placed.select(*keys, (F.col("own") - F.col("added")).alias("own"), (F.col("base") + F.col("first")).alias("begin"), (F.col("base") + F.col("last")).alias("end"), *columns).groupBy(*keys).agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("own").alias("own"), *sums)
    fits = [F.greatest(F.coalesce(f"most_{v}", F.lit(0)), F.col("end") - F.coalesce(f"tail_{v}", "begin")) <= limit for v in LEVELS]
    level = F.when(F.col("end").isNull(), "space").when(fits[0], LEVELS[0]).when(fits[1], LEVELS[1]).when(fits[2], LEVELS[2]).otherwise("none")
    return items.where(F.col("own") > limit).select(*keys, level.alias("cut_level"))


class Packer:
    """Cuts an item from its places, given range by range; it keeps those within reach of the last cut."""

    def __init__(self, reach: int) -> None:
        self.reach, self.at, self.base = reach, 0, 0
        self.levels: list[list[int]] = [[] for _ in LEVELS]

    def add(self, own: int, places: list[list[int]]) -> Iterator[tuple[int, int, str]]:
        """(begin, end, level) of the pieces that are settled once ``own`` more characters are known.

        The last two may be an added blank line, so they settle nothing yet.
        """
        for mine, new in zip(self.levels, places, strict=True):
            mine += [self.base + x for x in new]
        self.base += own
        yield from self._settled(self.base - 2)
        self.levels = [mine[bisect.bisect_right(mine, self.at) :] for mine in self.levels]

    def _settled(self, known: int) -> Iterator[tuple[int, int, str]]:
        while known - self.at > self.reach:
            cut, name = self.at + self.reach, "none"
            for mine, level in zip(self.levels, LEVELS, strict=True):
                k = bisect.bisect_right(mine, self.at + self.reach) - 1
                if k >= 0 and mine[k] > self.at:
                    cut, name = mine[k], level
                    break
            yield self.at, cut, name
            self.at = cut

    def end(self, added: int) -> Iterator[tuple[int, int, str]]:
        """The last pieces; ``added`` characters at the end are not the item's."""
        last = self.base - added
        yield from self._settled(last)
        if last > self.at:
            yield self.at, last, "end"


def piece_offsets(places: DataFrame, keys: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """keys, piece_no, start_pos, end_pos, cut_level (of the piece's end; ``end`` for the last).

    Two neighbours share ``overlap`` characters, or all of the first if it is shorter. Only offsets
    move, sorted by part, and are packed as they pass. Items within the limit give no piece.
    """
    source = places.select(*keys, "part", "own", "places", "added").repartition(*keys).sortWithinPartitions(*keys, "part")
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, packer, no, added = None, None, 0, 0
        out: list[tuple] = []

        def emit(found: Iterator[tuple[int, int, str]]) -> None:
            nonlocal no
            for begin, end, level in found:
                if no or level != "end" or end > limit:
                    out.append((*item, no, max(begin - overlap, 0), end, level))
                no += 1

        kinds = None
        for batch in batches:
            if kinds is None:
                kinds = [batch.schema.field(k).type for k in range(n)]
            for row in zip(*(c for c in batch.columns), strict=True):
                mine = tuple(v.as_py() for v in row[:n])
                if packer is None or mine != item:
                    if packer:
                        emit(packer.end(added))
                    item, packer, no, added = mine, Packer(limit - overlap), 0, 0
                added += row[n + 3].as_py()
                emit(packer.add(row[n + 1].as_py(), row[n + 2].as_py()))
                if len(out) > 10_000:
                    yield _rows(out, kinds)
                    out = []
        if packer:
            emit(packer.end(added))
            yield _rows(out, kinds)

    def _rows(out: list[tuple], kinds: list) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * (n + 4)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*kinds, pa.int64(), pa.int64(), pa.int64(), pa.string()], strict=True)], names=[*keys, "piece_no", "start_pos", "end_pos", "cut_level"])

    return source.mapInArrow(run, f"{_ddl(source, n)}, piece_no bigint, start_pos bigint, end_pos bigint, cut_level string")


def piece_texts(df: DataFrame, offsets: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The pieces' texts by offset: one join of the oversized items with their offsets."""
    return df.select(*keys, F.col(text).alias("__t")).join(offsets, keys).select(*keys, "piece_no", "start_pos", "end_pos", "cut_level", F.substring("__t", F.col("start_pos").cast("int") + 1, (F.col("end_pos") - F.col("start_pos")).cast("int")).alias("piece"))
