"""Near-duplicate records by circulant MinHash, banding and exact Jaccard verification.

Two permutations make all signature coordinates: the first places a shingle in a universe of
``UNIVERSE`` positions, the second is shifted circularly by one position for each coordinate, so
coordinate k of a set is the smallest value of the second permutation k places after its members.
Read as windows of one array, the coordinates of a shingle lie side by side in memory.

Records with equal shingle sets are one class and are compared once, through a representative.
Representatives that agree in a band of coordinates are candidates, and candidates are verified by
the exact Jaccard similarity of their shingle sets. Pairs link representatives; the membership table
leads from them to all records.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terseforge.runtime import durable, small_batches

#: Defaults of the operator; TESTDATA names other values for its query.
SHINGLE, THRESHOLD = 5, 0.8
UNIVERSE = 1 << 22
#: Probability with which a pair at the threshold may share no band, and the most bands and rows of a band.
ESCAPE, MOST_BANDS, MOST_ROWS = 0.002, 128, 6
#: Classes in a bucket from which its classes do not meet one by one but where an exact prefix join brings them together.
HOT = 500
#: Threshold from which a candidate's sets are compared by size and parity before they are fetched.
PARITY = 0.8
#: Counters that order the shingles of that join; shingles that share one are ordered by their hash.
CELLS = 1 << 20

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float) -> tuple[int, int]:
    """(bands, rows): the longest bands of which few enough keep the escape at the threshold.

    A pair of similarity s shares a band of r rows with probability s^r. Below a threshold where even
    single rows would be too many, the rows stay single and the bands as many as the escape asks.
    """
    for rows in range(MOST_ROWS, 0, -1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(ESCAPE) / math.log(1 - p)) if p > 0 else 0
        if bands and (bands <= MOST_BANDS or rows == 1):
            return bands, rows
    raise ValueError("a threshold must be above 0")


def without_markup(text: str) -> str:
    """Each tag read as a blank, entities decoded."""
    return html.unescape(_TAG.sub(" ", text)) if "<" in text or "&" in text else text


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; the same everywhere."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, each computed once per worker."""

    def __init__(self) -> None:
        self.table: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        import xxhash

        if len(self.table) > 2_000_000:  # bounds the worker's memory
            self.table = {}
        table = self.table
        for w in {w for w in words if w not in table}:
            table[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def shingles(text: str | None, size: int, unit: str = "word") -> np.ndarray:
    """Sorted distinct hashes of every ``size`` consecutive words; shorter texts are one shingle.

    With ``unit`` "char" the units are characters, runs of white space being one blank.
    """
    if unit == "char":
        h = np.frombuffer(" ".join((text or "").lower().split()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    else:
        words = _WORD.findall((text or "").lower())
        h = word_hashes()(words) if words else np.empty(0, np.uint64)
    if not len(h):
        return np.empty(0, np.uint64)
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        out = mix(out * _ODD + h[k : k + n])
    return np.unique(out)


def all_shingles(texts: list[str | None], size: int, unit: str = "word") -> tuple[np.ndarray, np.ndarray]:
    """The ``shingles`` of every text one after the other, and where each text's begin (and the last one's end).

    Many short texts of characters are hashed and sorted together.
    """
    plain = [" ".join((t or "").lower().split()) for t in texts] if unit == "char" else []
    lengths = np.fromiter(map(len, plain), np.int64, len(plain))
    if unit != "char" or not len(lengths) or (lengths < size).any() or lengths.sum() > 1_000_000:
        made = [shingles(t, size, unit) for t in texts]
        return np.concatenate([np.empty(0, np.uint64), *made]), np.cumsum([0, *map(len, made)])
    codes = np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = lengths - size + 1
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) + row * (size - 1)
    out = np.zeros(len(row), np.uint64)
    for k in range(size):
        out = mix(out * _ODD + codes[at + k])
    by = np.lexsort((out, row))
    out, row = out[by], row[by]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(n)))])


@lru_cache(maxsize=2)
def permutation(coordinates: int) -> np.ndarray:
    """Windows [position, coordinate] of the second permutation, which wraps around."""
    second = np.random.default_rng(20230401).permutation(UNIVERSE).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:coordinates]]), coordinates)


def signature(members: np.ndarray, coordinates: int) -> np.ndarray:
    """All coordinates of one set: the first permutation is the finaliser, cut to the universe."""
    at = (mix(members ^ _ODD) & np.uint64(UNIVERSE - 1)).astype(np.int64)
    view = permutation(coordinates)
    out = view[at[:2048]].min(0)
    for lo in range(2048, len(at), 2048):  # bounds the memory of a long text
        np.minimum(out, view[at[lo : lo + 2048]].min(0), out=out)
    return out


def all_signatures(members: np.ndarray, begins: np.ndarray, coordinates: int) -> np.ndarray:
    """The ``signature`` of every set, none of them empty; ``begins`` as ``all_shingles`` gives it."""
    view = permutation(coordinates)
    out = np.empty((len(begins) - 1, coordinates), np.int32)
    i = 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(begins, begins[i] + 2048, "right")) - 1)  # bounds the memory
        if j == i + 1:
            out[i] = signature(members[begins[i] : begins[j]], coordinates)
        else:
            at = (mix(members[begins[i] : begins[j]] ^ _ODD) & np.uint64(UNIVERSE - 1)).astype(np.int64)
            out[i:j] = np.minimum.reduceat(view[at], begins[i:j] - begins[i], axis=0)
        i = j
    return out


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band, different between bands; of one signature or of many."""
    parts = sig.reshape(*sig.shape[:-1], bands, rows).astype(np.uint64)
    out = mix(np.arange(1, bands + 1, dtype=np.uint64) * _ODD)
    for k in range(rows):
        out = mix(out * _ODD + parts[..., k])
    return out.view(np.int64)


def _per_text(records: DataFrame, keys: list[str], text: str, markup: str | None, columns: str, make) -> DataFrame:  # noqa: ANN001
    """``keys`` and the columns that ``make`` gives for a batch's texts, with the places of those that stay."""
    flag = F.coalesce(F.col(markup), F.lit(False)) if markup else F.lit(False)
    source = records.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("__t"), flag.alias("__m"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[: len(keys)]) + ", " + columns
    kinds = [pa.list_(pa.int64()) if "array" in c else pa.int64() for c in columns.split(",")]
    names = [c.split()[0] for c in columns.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [without_markup(t) if m else t for t, m in zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True)]
            rows, made = make(texts)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in range(len(keys))], *[pa.array(m, kind) for m, kind in zip(made, kinds, strict=True)]], names=[*keys, *names])

    return source.mapInArrow(run, schema)


def prefix_pairs(records: DataFrame, keys: list[str], text: str, threshold: float, size: int, markup: str | None = None, unit: str = "word", sought: str | None = None) -> DataFrame:
    """__p (hash of the dividing columns), a_rep < b_rep: every pair of records of similarity >= ``threshold``, and some others.

    Exact, without signatures. All shingles stand in one order, those of many records last; any order
    gives every pair, this one few others. Of two similar sets the smaller has its first common shingle
    among its first n - ceil(2t / (1 + t) n) + 1, the larger among its first n - ceil(tn) + 1, and what
    follows it in both is enough for the threshold. So parts that many records have in common are never
    joined unless the records are similar by them. With the boolean column ``sought`` only pairs with
    such a record are asked for: its shingles alone are counted, and no other shingle is sent.
    """
    spark = records.sparkSession
    small_batches(spark)
    *parts, ident = keys
    flag = F.coalesce(F.col(markup), F.lit(False)) if markup else F.lit(False)
    wanted = F.col(sought) if sought else F.lit(True)
    source = records.where(F.col(text).isNotNull()).select((F.xxhash64(*parts) if parts else F.lit(0).cast("bigint")).alias("__p"), F.col(ident).alias("rep"), wanted.alias("__s"), F.col(text).alias("__t"), flag.alias("__m"))

    def sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return all_shingles([without_markup(t) if m else t for t, m in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)], size, unit)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            np.add.at(total, sets(batch)[0] & np.uint64(CELLS - 1), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["cell", "n"])

    counts = source.where("__s").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(CELLS, np.int64)
    held[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    order = spark.sparkContext.broadcast(held)  # bounded by CELLS

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = order.value
        for batch in batches:
            members, begins = sets(batch)
            counted = cells[members & np.uint64(CELLS - 1)]
            size_of = np.diff(begins)
            before = np.concatenate([[0], np.cumsum(counted == 0)])
            unknown = before[begins[1:]] - before[begins[:-1]]  # that many come first and meet nothing
            last = size_of - np.ceil(threshold * size_of - 1e-9).astype(np.int64) + 1
            rows, made, waiting = [], [], 0
            sending = np.flatnonzero((unknown < last) & (size_of > 0)).tolist()
            for i in sending:
                s, often, n, k = members[begins[i] : begins[i + 1]], counted[begins[i] : begins[i + 1]], size_of[i], unknown[i]
                by = np.lexsort((s, often))[k : last[i]]
                made.append((s[by].view(np.int64), np.arange(k, k + len(by), dtype=np.int32), np.full(len(by), n, np.int32)))
                rows.append((i, len(by)))
                waiting += len(by)
                if waiting > 100_000 or i == sending[-1]:
                    at = pa.array(np.repeat([r for r, _ in rows], [k for _, k in rows]))
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), *(pa.array(np.concatenate(c)) for c in zip(*made, strict=True))], names=["__p", "rep", "__s", "w", "pos", "n"])
                    rows, made, waiting = [], [], 0

    kind = source.schema["rep"].dataType.simpleString()
    met = source.mapInArrow(entries, f"__p bigint, rep {kind}, __s boolean, w bigint, pos int, n int").withColumn("__n", F.count("*").over(Window.partitionBy("__p", "w"))).where("__n > 1")
    a = met.where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * (2 * threshold / (1 + threshold)) - 1e-9)).select("__p", "w", *(F.col(c).alias(f"a{c}") for c in ("rep", "__s", "pos", "n")))
    b = met.select(F.col("__p").alias("__q"), F.col("w").alias("v"), *(F.col(c).alias(f"b{c}") for c in ("rep", "__s", "pos", "n")))
    smaller = (F.col("an") < F.col("bn")) | ((F.col("an") == F.col("bn")) & (F.col("arep") < F.col("brep")))
    enough = F.least(F.col("an") - F.col("apos"), F.col("bn") - F.col("bpos")) >= (F.col("an") + F.col("bn")) * (threshold / (1 + threshold)) - 1e-9
    pairs = a.join(b, (F.col("__p") == F.col("__q")) & (F.col("w") == F.col("v")) & smaller & enough & (F.col("a__s") | F.col("b__s")))
    return pairs.select("__p", F.least("arep", "brep").alias("a_rep"), F.greatest("arep", "brep").alias("b_rep")).distinct()


def verified(candidates: DataFrame, records: DataFrame, keys: list[str], text: str, threshold: float, size: int, markup: str | None = None, unit: str = "word") -> DataFrame:
    """The candidates of similarity >= ``threshold``: the dividing columns, a_rep, b_rep, n_shared, similarity."""
    *parts, ident = keys
    needed = candidates.select(*parts, F.explode(F.array("a_rep", "b_rep")).alias(ident)).distinct()

    def make(texts: list[str]):  # noqa: ANN202
        members, begins = all_shingles(texts, size, unit)
        return np.arange(len(texts)), (np.split(members.view(np.int64), begins[1:-1]),)

    sets = durable(_per_text(records.join(needed, keys, "left_semi"), keys, text, markup, "__s array<bigint>", make))
    both = candidates.join(sets.select(*parts, F.col(ident).alias("a_rep"), F.col("__s").alias("__a")), [*parts, "a_rep"]).join(sets.select(*parts, F.col(ident).alias("b_rep"), F.col("__s").alias("__z")), [*parts, "b_rep"])
    shared = both.select(*parts, "a_rep", "b_rep", F.size(F.array_intersect("__a", "__z")).alias("n_shared"), (F.size("__a") + F.size("__z")).alias("__n"))
    return shared.withColumn("similarity", F.col("n_shared") / (F.col("__n") - F.col("n_shared"))).where(F.col("similarity") >= threshold).drop("__n")


def near_duplicates(records: DataFrame, keys: list[str], text: str, threshold: float = THRESHOLD, size: int = SHINGLE, markup: str | None = None, unit: str = "word") -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of the records whose shingle sets are similar.

    ``keys``: columns that divide the collection (may be several) and last the record's unique id; only
    records that agree in all but the id are compared. members: ``keys``, rep, one row for every
    record that has a word; records of equal shingle sets share the rep, their smallest id. pairs: the
    dividing columns, a_rep < b_rep, n_shared, similarity >= ``threshold``, one row per pair of classes.
    ``markup`` may name a boolean column: in its rows tags are read as blanks and entities decoded.
    Null, empty and wordless texts belong to no class; texts shorter than a shingle are one shingle of
    all their words. Nothing is capped: copies are merged before the bands, so a hot group of copies
    takes one entry in each bucket, and a pair met in several buckets is verified once. Classes of a
    bucket of more than ``HOT`` are joined exactly (``prefix_pairs``), whatever other bands they share.
    """
    spark = records.sparkSession
    small_batches(spark)
    bands, rows = bands_for(threshold)
    *parts, ident = keys

    def sketch(texts: list[str]):  # noqa: ANN202
        members, begins = all_shingles(texts, size, unit)
        kept = np.flatnonzero(np.diff(begins))
        if not len(kept):
            return [], ([], [], [])
        begins = np.append(begins[kept], begins[-1])
        prints = [np.add.reduceat(mix(h), begins[:-1]).view(np.int64) for h in (members * _ODD, members ^ _ODD)]
        flips = np.uint64(1) << (mix(members ^ np.uint64(CELLS)) & np.uint64(63))
        return kept, (*prints, np.diff(begins), np.bitwise_xor.reduceat(flips, begins[:-1]).view(np.int64), list(band_hashes(all_signatures(members, begins, bands * rows), bands, rows)))

    sketches = _per_text(records, keys, text, markup, "fp bigint,fp2 bigint,n bigint,parity bigint,bands array<bigint>", sketch)
    classes = durable(sketches)
    first = classes.groupBy(*parts, "fp", "fp2").agg(F.min(ident).alias("rep"))
    members = classes.select(*keys, "fp", "fp2").join(first, [*parts, "fp", "fp2"]).select(*keys, "rep")
    # In the widest shuffle of the job the dividing columns are one hash; they come back with the candidates.
    part = F.xxhash64(*parts) if parts else F.lit(0)
    entries = classes.join(first.withColumnRenamed("rep", ident), [*keys, "fp", "fp2"]).select(part.alias("__p"), F.col(ident).alias("rep"), F.explode("bands").alias("band"))
    # Said here, the condition that the join below infers for one side holds for both, and they share a shuffle.
    counted = entries.where("band is not null").withColumn("__n", F.count("*").over(Window.partitionBy("__p", "band")))

    several = counted.where("__n > 1").select("__p", "band", "rep", (F.col("__n") > HOT).alias("__hot"))
    left = several.withColumnRenamed("rep", "a_rep")
    right = several.where("not __hot").select(F.col("__p").alias("__q"), F.col("band").alias("__band"), F.col("rep").alias("b_rep"))
    # Classes of a bucket meet, and the entries of hot buckets come out unmet, all in one join.
    both_kinds = left.join(right, (F.col("__p") == F.col("__q")) & (F.col("band") == F.col("__band")) & (F.col("a_rep") < F.col("b_rep")), "left").where("b_rep is not null or __hot")
    found = durable(both_kinds.select("__p", "a_rep", "b_rep", F.when(F.col("__hot"), F.col("band")).alias("band")).distinct())
    met, hot = found.where("band is null").select("__p", "a_rep", "b_rep"), found.where("band is not null")
    if not hot.isEmpty():
        # Texts that have a part in common and mostly little else: the exact join finds all that are similar.
        crowded = records.join(hot.select("__p", F.col("a_rep").alias(ident)).distinct().join(first.select(*parts, part.alias("__p"), F.col("rep").alias(ident)), ["__p", ident]).drop("__p"), keys, "left_semi")
        met = met.unionByName(prefix_pairs(crowded, keys, text, threshold, size, markup, unit)).distinct()
    if threshold >= PARITY:
        # A shingle of one set only flips one bit, so as many bits differ as shingles do, or fewer: no similar pair is lost.
        known = classes.select(part.alias("__p"), F.col(ident).alias("rep"), "n", "parity")
        for side in "ab":
            met = met.join(known.select("__p", F.col("rep").alias(f"{side}_rep"), F.col("n").alias(f"{side}_n"), F.col("parity").alias(f"{side}_parity")), ["__p", f"{side}_rep"])
        most = (F.col("a_n") + F.col("b_n")) * ((1 - threshold) / (1 + threshold)) + 1e-9
        met = met.where(F.bit_count(F.col("a_parity").bitwiseXOR(F.col("b_parity"))) <= most).select("__p", "a_rep", "b_rep")
    named = first.select(*parts, part.alias("__p"), F.col("rep").alias("a_rep")) if parts else None
    candidates = durable(met.drop("__p") if named is None else met.join(named, ["__p", "a_rep"]).select(*parts, "a_rep", "b_rep"))
    return verified(candidates, records, keys, text, threshold, size, markup, unit), members


def record_pairs(pairs: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs of records: the dividing columns, a_id < b_id; copies expanded, for results that ask for it."""
    *parts, ident = keys
    own = members.select(*parts, F.col("rep").alias("a_rep"), F.col(ident).alias("a_id"))
    other = members.select(*parts, F.col("rep").alias("b_rep"), F.col(ident).alias("b_id"))
    within = own.join(other.withColumnRenamed("b_rep", "a_rep"), [*parts, "a_rep"]).where("a_id < b_id").select(*parts, "a_id", "b_id")
    across = pairs.select(*parts, "a_rep", "b_rep").join(own, [*parts, "a_rep"]).join(other, [*parts, "b_rep"]).select(*parts, F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"))
    return within.unionByName(across)


def groups(pairs: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """One row per record: ``keys``, group_id (smallest id it is linked to, directly or not), n_links.

    n_links counts the other classes linked to the record's class. The smallest label is handed along
    the links and then followed to its own label, so chains shorten by half in each round; only a
    count comes to the driver.
    """
    *parts, ident = keys
    links = durable(pairs.select(*parts, F.col("a_rep").alias("u"), F.col("b_rep").alias("v")).unionByName(pairs.select(*parts, F.col("b_rep").alias("u"), F.col("a_rep").alias("v"))))
    degree = links.groupBy(*parts, "u").agg(F.count("*").alias("n_links"))
    labels = durable(links.groupBy(*parts, "u").agg(F.least(F.min("v"), F.first("u")).alias("label")))
    while True:
        told = links.join(labels.select(*parts, F.col("u").alias("v"), F.col("label").alias("theirs")), [*parts, "v"]).groupBy(*parts, "u").agg(F.min("theirs").alias("theirs"))
        near = labels.join(told, [*parts, "u"]).select(*parts, "u", F.col("label").alias("old"), F.least("label", "theirs").alias("label"))
        up = labels.select(*parts, F.col("u").alias("label"), F.col("label").alias("higher"))
        new = durable(near.join(up, [*parts, "label"], "left").select(*parts, "u", "old", F.least("label", F.coalesce("higher", "label")).alias("label")))
        changed = new.where("old <> label").count()
        labels = new.drop("old")
        if not changed:
            break
    known = labels.join(degree, [*parts, "u"]).withColumnRenamed("u", "rep")
    return members.join(known, [*parts, "rep"], "left").select(*keys, F.coalesce("label", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
