"""Evaluation passages inside documents, found through template windows.

Both sides are folded (NFKC, no zero-width characters or soft hyphens, lower case) and cut into
words, runs of letters and digits. Canonicalisation turns words into template codes: numbers, names
and units become typed placeholders, other words stay themselves. A word is a name if the items
write it with a capital and never without, or if no item has it and the document writes it so.

Every window of ``WINDOW`` words has two hashes. The template hash takes literal words as they are
and of a placeholder its type and how far back in the window the same value stood, so equal hashes
mean equal literals and slots that repeat in the same places: each placeholder of one side stands for
one value of the other throughout, and the reverse. The identity hash takes the words themselves.
Windows are joined by template hash; equal identities make the passage verbatim, other slots make it
re-parameterised. Windows of fewer than ``LEAST_LITERAL`` literals are joined by identity alone.

Items within ``ITEM_CHARS`` are indexed in the driver and broadcast, and the documents are read in
one narrow pass. More items are cut into windows by the cluster and joined with the documents'
windows by a shuffle, again in one pass over the documents. Both give the same rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terseforge.runtime import small_batches

#: Consecutive words that make a leak.
WINDOW = 12
#: Literal words that a window needs before its template speaks for it.
LEAST_LITERAL = 5
#: Characters of all items up to which they are indexed in the driver (20 bytes a window, fewer windows than characters).
ITEM_CHARS = 10_000_000
#: Distinct words of the items that are broadcast at most (9 bytes each).
VOCABULARY_WORDS = 20_000_000
#: Bits of the map by which windows that no item has stay out of the shuffle.
MAP_BITS = 1 << 26

_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤⁦-⁯﻿]")
# Units of measure.
UNITS = frozenset("percent prozent cent ciento cento процента km kg mg cm mm ms hz khz mhz ghz kb mb gb kronen couronnes coronas coroas euro euros dollars usd eur metres meters litres hours minutes seconds".split())
_NUMBER, _NAME, _UNIT = 1, 2, 3
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_ALONE = np.uint64(0xA0761D6478BD642F)


def fold(text: str | None) -> str:
    """NFKC without zero-width characters and soft hyphens; the case is kept."""
    if not text:
        return ""
    if text.isascii():
        return text
    return _HIDDEN.sub("", unicodedata.normalize("NFKC", _HIDDEN.sub("", text)))


def words(text: str | None) -> list[str]:
    """Words of a text, lower-cased."""
    return [w.lower() for w in _WORD.findall(fold(text))]


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolled(size: int, n: int, value) -> np.ndarray:  # noqa: ANN001
    """Hash of each of ``n`` windows from the values at their places."""
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _STEP + value(k)
    return _scramble(out)


def window_hashes(words: np.ndarray, slots: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template hash, identity hash, by identity only) of every run of ``size`` words.

    ``words``: hash of each word; ``slots``: its placeholder type, or 0 for a literal.
    """
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, bool)
    mixed = _scramble(words * _MIX)
    identity = _rolled(size, n, lambda k: mixed[k : k + n])
    at = np.flatnonzero(slots)
    back = np.full(len(words), size, np.int64)  # words back to the same value, where it is a placeholder
    order = at[np.argsort(words[at], kind="stable")]
    if len(order) > 1:
        step = np.diff(order)
        same = words[order[1:]] == words[order[:-1]]
        back[order[1:][same]] = np.minimum(step[same], size)
    first, again = mixed.copy(), mixed
    first[at] = _scramble(slots[at].astype(np.uint64) * _MIX + np.uint64(1))
    if len(at):
        again = first.copy()
        again[at] = _scramble((slots[at].astype(np.uint64) * np.uint64(64) + back[at].astype(np.uint64)) * _MIX)
    template = _rolled(size, n, lambda k: np.where(back[k : k + n] <= k, again[k : k + n], first[k : k + n]))
    literals = np.concatenate([[0], np.cumsum(slots == 0)])
    alone = literals[size:] - literals[:-size] < LEAST_LITERAL
    return np.where(alone, _scramble(identity ^ _ALONE), template), identity, alone


def _names(texts: list[str]) -> set[str]:
    """Words that the items write with a capital, inside a sentence too, and never without."""
    capital, small = set(), set()
    for t in texts:
        for m in re.finditer(r"([.!?:»\"“„]\s*|^\s*)?([^\W_]+)", fold(t)):
            w = m[2]
            if w[0].islower():
                small.add(w.lower())
            elif m[1] is None and len(w) > 3 and w[0].isupper() and not w.isupper():
                capital.add(w.lower())
    return capital - small


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


@dataclass
class Vocabulary:
    """Hashes of the items' words, sorted, and which of them are names."""

    words: np.ndarray
    names: np.ndarray

    @classmethod
    def of(cls, words: dict[int, bool]) -> Vocabulary:
        hashes = np.fromiter(words, np.uint64, len(words))
        flags = np.fromiter(words.values(), bool, len(words))
        order = np.argsort(hashes)
        return cls(hashes[order], flags[order])


class Coder:
    """Hashes and placeholder types of words, found once each; one serves a Python worker's task."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self._start()

    def _start(self) -> None:
        self.ids: dict[str, int] = {}
        self.hashes, self.kinds = np.empty(0, np.uint64), np.empty(0, np.int8)

    def __call__(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.ids) > 1_000_000:  # bounds the worker's memory
            self._start()
        ids = self.ids
        new = list({w for w in found if w not in ids})
        if new:
            ids.update(zip(new, range(len(ids), len(ids) + len(new)), strict=True))
            lows = [w.lower() for w in new]
            hashes = np.fromiter(map(_hash, lows), np.uint64, len(new))
            at = np.minimum(np.searchsorted(self.vocabulary.words, hashes), max(len(self.vocabulary.words) - 1, 0))
            known = self.vocabulary.words[at] == hashes if len(self.vocabulary.words) else np.zeros(len(new), bool)
            named = self.vocabulary.names[at] & known if len(known) and len(self.vocabulary.names) else known
            capital = np.fromiter((w[0].isupper() and len(w) > 3 for w in new), bool, len(new))
            kinds = np.where(named | (~known & capital), _NAME, 0).astype(np.int8)
            kinds[np.fromiter((w in UNITS for w in lows), bool, len(new))] = _UNIT
            kinds[np.fromiter((w[0].isdigit() for w in new), bool, len(new))] = _NUMBER
            self.hashes, self.kinds = np.concatenate([self.hashes, hashes]), np.concatenate([self.kinds, kinds])
        rows = np.fromiter(map(ids.__getitem__, found), np.int64, len(found))
        return self.hashes[rows], self.kinds[rows]


def vocabulary_of(texts: list[str]) -> Vocabulary:
    """The words of all items, and the names among them."""
    names = _names(texts)
    return Vocabulary.of({_hash(w): w in names for w in {w for t in texts for w in words(t)}})


@dataclass
class ItemIndex:
    """Windows of all items, sorted by template hash."""

    vocabulary: Vocabulary
    templates: np.ndarray
    identities: np.ndarray
    alone: np.ndarray
    owners: np.ndarray
    keys: pa.Array
    seen: np.ndarray

    def hits(self, templates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window of the document, window of the index) for equal template hashes."""
        maybe = np.flatnonzero(self.seen[(templates >> np.uint64(40)).astype(np.int64)])
        lo = np.searchsorted(self.templates, templates[maybe], "left")
        n = np.searchsorted(self.templates, templates[maybe], "right") - lo
        ends = np.cumsum(n)
        return np.repeat(maybe, n), np.arange(int(n.sum())) - np.repeat(ends - n, n) + np.repeat(lo, n)


def build_index(keys: pa.Array, texts: list[str | None], size: int = WINDOW) -> ItemIndex:
    """Index of items; an item's equal windows stand in it once."""
    known = [t or "" for t in texts]
    vocabulary = vocabulary_of(known)
    coder = Coder(vocabulary)
    parts = [window_hashes(*coder(_WORD.findall(fold(t))), size) for t in known]
    owners = np.repeat(np.arange(len(known)), [len(t) for t, _, _ in parts])
    templates, identities, alone = (np.concatenate([*[p[k] for p in parts], np.empty(0, kind)]) for k, kind in enumerate((np.uint64, np.uint64, bool)))
    order = np.lexsort((owners, identities, templates))
    new = np.ones(len(order), bool)
    new[1:] = np.any([a[order][1:] != a[order][:-1] for a in (templates, identities, owners)], axis=0)
    order = order[new]
    seen = np.zeros(1 << 24, bool)
    seen[(templates >> np.uint64(40)).astype(np.int64)] = True
    return ItemIndex(vocabulary, templates[order], identities[order], alone[order], owners[order], keys, seen)


def _batch_windows(coder: Coder, texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a batch of texts that lie in one text: owner, template, identity, by identity only."""
    found = [_WORD.findall(fold(t)) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in found])
    templates, identities, alone = window_hashes(*coder([w for ws in found for w in ws]), size)
    n = len(templates)
    inside = owner[:n] == owner[size - 1 : size - 1 + n]
    return owner[:n][inside], templates[inside], identities[inside], alone[inside]


def leaks(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = WINDOW, item_chars: int = ITEM_CHARS) -> DataFrame:
    """Every (document, item) that share a window of equal template: kind and counts.

    Columns: ``doc_key``, ``item_key`` (of any type), kind (``verbatim`` or ``reparameterised``),
    windows (of the document). A pair has one row; any verbatim window makes it verbatim. Null and
    short texts share nothing; empty tables give no rows. A document that comes twice is reported
    twice in the narrow pass, once a key in the shuffled one. Other columns are ignored.
    """
    small_batches(documents.sparkSession)
    docs = documents.select(F.col(doc_key), F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    asked = items.select(F.col(item_key), F.col(item_text).alias("__text")).where(F.col("__text").isNotNull())
    chars = asked.agg(F.coalesce(F.sum(F.length("__text")), F.lit(0)).alias("n")).first()["n"]
    return _narrow(docs, asked, size) if chars <= item_chars else _shuffled(docs, asked, size)


def _narrow(docs: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """One pass over the documents against a broadcast index."""
    doc_key, item_key = docs.columns[0], asked.columns[0]
    table = asked.toArrow()  # bounded by the caller's measure
    index = docs.sparkSession.sparkContext.broadcast(build_index(table.column(0).combine_chunks(), table.column(1).to_pylist(), size))
    schema = f"`{doc_key}` {docs.schema[0].dataType.simpleString()}, `{item_key}` {asked.schema[0].dataType.simpleString()}, kind string, windows bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        coder = Coder(known.vocabulary)
        for batch in batches:
            owner, templates, identities, _ = _batch_windows(coder, batch.column(1).to_pylist(), size)
            mine, theirs = known.hits(templates)
            same = identities[mine] == known.identities[theirs]
            fits = same | ~known.alone[theirs]
            mine, theirs, same = mine[fits], theirs[fits], same[fits]
            # One entry per window of the document and item, then one per document and item.
            pairs, at = np.unique(np.stack([owner[mine], known.owners[theirs], mine], 1) if len(mine) else np.empty((0, 3), np.int64), axis=0, return_inverse=True)
            verbatim = np.zeros(len(pairs), bool)
            np.logical_or.at(verbatim, at.ravel(), same)
            rows, at, n = np.unique(pairs[:, :2], axis=0, return_inverse=True, return_counts=True)
            whole = np.zeros(len(rows), bool)
            np.logical_or.at(whole, at.ravel(), verbatim)
            kinds = pa.array(np.where(whole, "verbatim", "reparameterised").tolist(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[:, 0])), known.keys.take(pa.array(rows[:, 1])), kinds, pa.array(n, pa.int64())], names=[doc_key, item_key, "kind", "windows"])

    return docs.mapInArrow(run, schema)


def _windows(df: DataFrame, key: str, vocabulary, size: int, wanted=None) -> DataFrame:  # noqa: ANN001
    """``key``, t (template), i (identity), alone of every window; ``wanted`` may hold a map of the templates asked for."""
    schema = f"`{key}` {df.schema[0].dataType.simpleString()}, t bigint, i bigint, alone boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary.value)
        for batch in batches:
            owner, templates, identities, alone = _batch_windows(coder, batch.column(1).to_pylist(), size)
            if wanted is not None:
                bit = (templates & np.uint64(MAP_BITS - 1)).astype(np.int64)
                kept = (wanted.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                owner, templates, identities, alone = owner[kept], templates[kept], identities[kept], alone[kept]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(templates.view(np.int64)), pa.array(identities.view(np.int64)), pa.array(alone)], names=[key, "t", "i", "alone"])

    return df.mapInArrow(run, schema)


def _item_vocabulary(asked: DataFrame) -> Vocabulary:
    """The vocabulary of many items, put together by the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            small, capital = {}, _names(texts)
            for t in texts:
                for m in _WORD.finditer(fold(t)):
                    low = m[0].lower()
                    small[low] = small.get(low, False) or m[0][0].islower()
            yield pa.RecordBatch.from_arrays([pa.array(np.array([_hash(w) for w in small], np.uint64).view(np.int64)), pa.array(list(small.values())), pa.array([w in capital for w in small])], names=["h", "small", "capital"])

    found = asked.mapInArrow(run, "h bigint, small boolean, capital boolean").groupBy("h").agg((F.bool_or("capital") & ~F.bool_or("small")).alias("name"))
    n = found.count()
    if n > VOCABULARY_WORDS:
        raise ValueError(f"the items have {n} distinct words; more than {VOCABULARY_WORDS} are not broadcast")
    table = found.toArrow()
    hashes = table.column(0).to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], table.column(1).to_numpy()[order].astype(bool))


def _map_of(windows: DataFrame) -> np.ndarray:
    """The templates that items have, as bits; put together from a few parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(MAP_BITS >> 3, np.uint8)
        for batch in batches:
            bit = (batch.column(0).to_numpy().view(np.uint64) & np.uint64(MAP_BITS - 1)).astype(np.int64)
            np.bitwise_or.at(bits, bit >> 3, np.left_shift(np.uint8(1), (bit & 7).astype(np.uint8)))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(MAP_BITS >> 3, np.uint8)
    for row in windows.select("t").repartition(16).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(row["bits"], np.uint8)
    return out


def _shuffled(docs: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """Windows of both sides joined by template hash."""
    doc_key, item_key = docs.columns[0], asked.columns[0]
    sc = docs.sparkSession.sparkContext
    vocabulary = sc.broadcast(_item_vocabulary(asked))  # bounded by VOCABULARY_WORDS
    theirs = _windows(asked, item_key, vocabulary, size).distinct().withColumnsRenamed({item_key: "__item", "i": "__i"})
    mine = _windows(docs, doc_key, vocabulary, size, sc.broadcast(_map_of(theirs))).groupBy(doc_key, "t", "i").agg(F.count("*").alias("n")).withColumnRenamed(doc_key, "__doc")  # MAP_BITS bits
    same = F.col("i") == F.col("__i")
    met = mine.join(theirs, "t").where(same | ~F.col("alone")).groupBy("__doc", "__item", "t", "i").agg(F.bool_or(same).alias("same"), F.first("n").alias("n"))
    rows = met.groupBy("__doc", "__item").agg(F.when(F.bool_or("same"), "verbatim").otherwise("reparameterised").alias("kind"), F.sum("n").alias("windows"))
    return rows.select(F.col("__doc").alias(doc_key), F.col("__item").alias(item_key), "kind", "windows")
