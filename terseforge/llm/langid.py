"""Language of documents and of their segments, by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. Each language has a probability for every piece;
a word's probability is the sum over all its segmentations into pieces, found by the forward
algorithm, so no single segmentation has to be chosen. Words are runs of letters of one script, and
pieces never cross them, so a sentence's score is the sum of its words' scores and each distinct
word is scored once per Python worker.

The piece probabilities are fitted by expectation maximisation on a bounded sample of labelled rows
(``SAMPLE_DOCS`` rows, ``SAMPLE_CHARS`` characters each); documents that the first fit contradicts
leave the second. Everything else, the scores and the segments, covers every document whole.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terseforge.llm.sentences import sentence_spans
from terseforge.runtime import hashed_sample, small_batches

LANGUAGES = ("en", "de", "fr", "es", "pt", "ru", "zh", "ja")
#: Bounds of the labelled sample that the piece probabilities are fitted on.
SAMPLE_DOCS, SAMPLE_CHARS = 3000, 1500
#: Folder of the public tokenizers' files, and the vocabulary used here.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Most that one word may tell against a language (nats), so that no name decides a sentence.
CLIP = 5.0
#: In scripts without blanks ``CLIP`` holds for so many characters, and a word counts so many.
CLIP_CHARS, WORD_CHARS = 4, 2
#: A longer run of letters is scored by itself, with its sums scaled at every character.
RUN_CHARS = 60
#: Cost (nats) of changing the language between two sentences; evidence below it is taken for noise.
SWITCH = 6.0

# Letters that stand among digits (hexadecimal lines, versions, addresses) are no word.
WORD = re.compile(r"[ぁ-ゟ]+|[゠-ヿ]+|[㐀-鿿]+|(?<![\w/=])[^\W\d_぀-ヿ㐀-鿿]++(?![0-9_])")
_NO_BLANKS = re.compile("[぀-鿿]")
_MARKER = re.compile(r"^(?:human|gpt|user|assistant|system)\s*:\s*", re.I)
_CITATION = re.compile(r"<(?:cit|ref)\.>")


def _units(word: str, chars: int) -> int:
    """1, or in a script without blanks the number of stretches of ``chars``."""
    return -(-len(word) // chars) if "぀" <= word[0] <= "鿿" else 1


@lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, int]:
    """Index of every lower-case piece of a sentencepiece vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = dict.fromkeys(p.lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)) for p in (sp.id_to_piece(i),))
    return {p: k for k, p in enumerate(found)}


@lru_cache(maxsize=2)
def _longest(path: str) -> int:
    """Characters of the longest piece."""
    return max(map(len, pieces(path)), default=1)


_PREFIXED: list[tuple[dict[str, int], dict[str, int]]] = []


def _prefixed(index: dict[str, int]) -> dict[str, int]:
    """The pieces with their indexes, and every beginning of a piece that is none with -1."""
    if not _PREFIXED or _PREFIXED[0][0] is not index:
        _PREFIXED[:] = [(index, dict.fromkeys((p[:k] for p in index for k in range(1, len(p))), -1) | index)]
    return _PREFIXED[0][1]


def _lattice(words: list[str], index: dict[str, int], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids [word, end, length - 1] of every substring, and the words' lengths.

    Index ``len(index)`` stands for no piece; a single character that is no piece has index
    ``len(index) + 1``.
    """
    none, unknown = len(index), len(index) + 1
    size = max(map(len, words))
    ids = np.full((len(words), size + 1, min(size, longest)), none, np.int32)
    get = _prefixed(index).get
    for w, word in enumerate(words):
        own, n = ids[w], len(word)
        for i in range(n):
            for j in range(i + 1, n + 1):
                k = get(word[i:j])
                if k is None:
                    break  # no piece begins like this
                if k >= 0:
                    own[j, j - i - 1] = k
            if own[i + 1, 0] == none:
                own[i + 1, 0] = unknown
    return ids, np.fromiter(map(len, words), np.int32, len(words))


def _marked(word: str) -> str:
    """Words of spaced scripts carry the vocabulary's word-start sign."""
    return word if "぀" <= word[0] <= "鿿" else "▁" + word


def forward(words: list[str], index: dict[str, int], probs: np.ndarray) -> np.ndarray:
    """Log-probability [word, language]: the sum over all segmentations of each word.

    ``probs`` has a row for every piece, then a zero row for no piece and one for an unknown
    character. Words are scored in groups of similar length, very long ones one by one.
    """
    out = np.empty((len(words), probs.shape[1]), np.float64)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    longest = max(map(len, index), default=1)
    while order and len(words[order[-1]]) > RUN_CHARS:
        out[order[-1]] = _forward_long(_marked(words[order[-1]]), index, probs, longest)
        order.pop()
    for lo in range(0, len(order), 2000):
        part = order[lo : lo + 2000]
        ids, lengths = _lattice([_marked(words[i]) for i in part], index, longest)
        alpha = np.zeros((ids.shape[1], len(part), probs.shape[1]))
        alpha[0] = 1.0
        for j in range(1, ids.shape[1]):
            for k in range(min(j, ids.shape[2])):
                at = ids[:, j, k]
                hit = np.flatnonzero(at != len(index))
                if len(hit):
                    alpha[j, hit] += alpha[j - 1 - k, hit] * probs[at[hit]]
        out[part] = np.log(np.maximum(alpha[lengths, np.arange(len(part))], 1e-300))
    return out


def _forward_long(word: str, index: dict[str, int], probs: np.ndarray, longest: int) -> np.ndarray:
    """``forward`` of one word of any length: only the last sums are kept, scaled so that none vanishes."""
    recent = [np.ones(probs.shape[1])]  # sums up to the last characters, the latest first
    scale = np.zeros(probs.shape[1])
    for j in range(1, len(word) + 1):
        total = recent[0] * probs[index.get(word[j - 1], len(index) + 1)]
        for k in range(2, min(j, longest) + 1):
            at = index.get(word[j - k : j])
            if at is not None:
                total = total + recent[k - 1] * probs[at]
        recent.insert(0, total)
        del recent[longest:]
        if j % 8 == 0:
            top = np.maximum(total, 1e-300)
            recent = [r / top for r in recent]
            scale += np.log(top)
    return scale + np.log(np.maximum(recent[0], 1e-300))


def fit(texts: list[str], labels: list[int], path: str, rounds: int = 2) -> np.ndarray:
    """Piece probabilities [piece + 2, language] from labelled texts, by expectation maximisation."""
    index, longest = pieces(path), _longest(path)
    n, k = len(index), len(LANGUAGES)
    docs = [Counter(WORD.findall(t.lower())) for t in texts]
    keep = [True] * len(docs)
    probs = np.zeros((n + 2, k))
    for turn in range(2):
        per: list[Counter] = [Counter() for _ in LANGUAGES]
        for d, y, good in zip(docs, labels, keep, strict=True):
            if good:
                per[y].update(d)
        vocabulary = sorted(set().union(*per))
        if not vocabulary:
            break
        lattices = []
        by_length = sorted(vocabulary, key=len)
        for lo in range(0, len(by_length), 2000):
            part = by_length[lo : lo + 2000]
            weight = np.array([[per[y][w] for y in range(k)] for w in part], np.float64)
            lattices.append((*_lattice([_marked(w) for w in part], index, longest), weight))
        probs[:n] = 1.0 / n
        probs[n + 1] = 1e-7
        for _ in range(rounds):
            counts = np.zeros((n + 2, k))
            for ids, lengths, weight in lattices:
                _expect(ids, lengths, weight, probs, counts, n)
            counts[n] = 0
            counts[:n] += 0.02
            counts[n + 1] += 0.02
            probs = counts / counts.sum(0)
            probs[n] = 0
        if turn == 0:
            found = word_scores(vocabulary, path, probs)
            at = {w: i for i, w in enumerate(vocabulary)}
            for i, (d, y) in enumerate(zip(docs, labels, strict=True)):
                rows = [at[w] for w in d if w in at]
                keep[i] = bool(rows) and int(found[rows].sum(0).argmax()) == y
    return probs


def _expect(ids: np.ndarray, lengths: np.ndarray, weight: np.ndarray, probs: np.ndarray, counts: np.ndarray, none: int) -> None:
    """Adds the expected piece counts of weighted words, by forward and backward sums."""
    m, size, longest = ids.shape
    alpha = np.zeros((size, m, probs.shape[1]))
    beta = np.zeros_like(alpha)
    alpha[0] = 1.0
    beta[lengths, np.arange(m)] = 1.0
    for j in range(1, size):
        for k in range(min(j, longest)):
            alpha[j] += alpha[j - 1 - k] * probs[ids[:, j, k]]
    for j in range(size - 1, 0, -1):
        for k in range(min(j, longest)):
            beta[j - 1 - k] += beta[j] * probs[ids[:, j, k]]
    total = np.maximum(alpha[lengths, np.arange(m)], 1e-300)
    for j in range(1, size):
        for k in range(min(j, longest)):
            at = ids[:, j, k]
            hit = np.flatnonzero(at != none)
            if len(hit):
                np.add.at(counts, at[hit], (weight * alpha[j - 1 - k] * beta[j] / total)[hit] * probs[at[hit]])


def word_scores(words: list[str], path: str, probs: np.ndarray) -> np.ndarray:
    """Each word's evidence [word, language]: log-probability below the best, at most ``CLIP`` a word.

    A run of a script without blanks holds many words, so it may tell ``CLIP`` for every ``CLIP_CHARS``.
    """
    scores = forward(words, pieces(path), probs)
    most = CLIP * np.fromiter((_units(w, CLIP_CHARS) for w in words), np.float64, len(words))
    return np.maximum(scores - scores.max(1, keepdims=True), -most[:, None]).astype(np.float32)


class Scorer:
    """Scores words once each; one lives in a Python worker for as long as the worker does."""

    def __init__(self, path: str, probs: np.ndarray) -> None:
        self.path, self.probs = path, probs
        self._start()

    def _start(self) -> None:
        self.ids: dict[str, int] = {}
        self.table = np.zeros((1 << 12, len(LANGUAGES)), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        """Evidence [word, language] of a list of words with repetitions."""
        ids = self.ids
        if len(ids) > 1_000_000:  # bounds the worker's memory
            self._start()
            ids = self.ids
        new = list({w for w in words if w not in ids})
        if new:
            base = len(ids)
            if base + len(new) > len(self.table):
                grown = np.zeros((2 * (base + len(new)), len(LANGUAGES)), np.float32)
                grown[:base] = self.table[:base]
                self.table = grown
            self.table[base : base + len(new)] = word_scores(new, self.path, self.probs)
            ids.update(zip(new, range(base, base + len(new)), strict=True))
        return self.table[np.fromiter(map(ids.__getitem__, words), np.int32, len(words))]

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Evidence [text, language] and the number of words of each text, by length without blanks."""
        words: list[str] = []
        counts, said = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            found = WORD.findall(t)
            if not any(len(w) > 1 or "぀" <= w <= "鿿" for w in found):
                found = []  # single letters among signs are no words
            counts[i] = len(found)
            said[i] = sum(_units(w, WORD_CHARS) for w in found) if _NO_BLANKS.search(t) else len(found)
            words += found
        out = np.zeros((len(texts), len(LANGUAGES)))
        if words:
            has = np.flatnonzero(counts)
            starts = (np.cumsum(counts) - counts)[has]
            out[has] = np.add.reduceat(self.rows(words), starts, axis=0, dtype=np.float64)
        return out, said


_SCORERS: dict[tuple[str, str], Scorer] = {}


def scorer(path: str, probs: np.ndarray) -> Scorer:
    """This worker's scorer for a model, known by a digest of all its probabilities."""
    key = (path, hashlib.blake2b(np.ascontiguousarray(probs), digest_size=16).hexdigest())
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(path, probs)
    return _SCORERS[key]


def labelled_sample(df: DataFrame, key: str, text: str, lang: str, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int]]:
    """A bounded sample of rows whose label names one of the languages, by the hash of their key."""
    label = F.lower(F.substring(F.trim(lang), 1, 2))
    n = df.where(label.isin(*LANGUAGES)).count()  # reads the labels only
    named = df.select(F.col(key).alias("__k"), label.alias("__l"), F.substring(text, 1, chars).alias("__t")).where(F.col("__l").isin(*LANGUAGES) & F.col("__t").isNotNull())
    rows = hashed_sample(named, "__k", docs, n)  # bounded by docs and chars
    return [r["__t"] for r in rows], [LANGUAGES.index(r["__l"]) for r in rows]


def _smoothed(scores: np.ndarray) -> np.ndarray:
    """Best language of each sentence under a cost for each change (Viterbi)."""
    n, k = scores.shape
    best, back = scores[0].copy(), np.empty((n, k), np.int32)
    for i in range(1, n):
        top = int(best.argmax())
        stay = best >= best[top] - SWITCH
        back[i] = np.where(stay, np.arange(k), top)
        best = np.where(stay, best, best[top] - SWITCH) + scores[i]
    path = np.empty(n, np.int32)
    path[-1] = int(best.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def _segments(spans: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int, int, float, int]]:
    """(start, end, language, confidence, sentences) of each stretch of one language."""
    if not spans:
        return []
    best = scores.argmax(1)
    path = best if (best == best[0]).all() else _smoothed(scores)
    out, lo = [], 0
    for i in range(1, len(spans) + 1):
        if i == len(spans) or path[i] != path[lo]:
            total = scores[lo:i].sum(0)
            total = np.exp(total - total.max())
            out.append((spans[lo][0], spans[i - 1][1], int(path[lo]), float(total[path[lo]] / total.sum()), i - lo))
            lo = i
    return out


def document_languages(df: DataFrame, key: str, text: str, lang: str, path: str = VOCABULARY, sample: DataFrame | None = None) -> DataFrame:
    """Languages of every document: key, lang, confidence, label, segments.

    ``lang`` is the language of most of the text; ``segments`` has an entry (start_pos, end_pos,
    seg_lang, confidence, sentences) for each longest stretch of sentences in one language. Headings,
    role markers, citation markers and lines without words belong to none. A null or blank text, or
    one without words, has lang null, confidence 0 and no segments. ``label`` is the delivered label's
    first two letters in lower case. Other columns of ``df`` are ignored, whatever their names.
    ``sample`` may name another table of the same columns to fit the model on.
    """
    spark = df.sparkSession
    small_batches(spark)
    texts, labels = labelled_sample(df if sample is None else sample, key, text, lang)
    probs = fit(texts, labels, path)
    model = spark.sparkContext.broadcast(probs)  # bounded by the vocabulary
    source = df.select(F.col(key), F.lower(F.substring(F.trim(F.col(lang)), 1, 2)).alias("label"), F.col(text).alias("__text"))
    schema = f"`{key}` {source.schema[0].dataType.simpleString()}, label string, lang string, confidence double, segments array<struct<start_pos:int,end_pos:int,seg_lang:string,confidence:double,sentences:int>>"
    kind = pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), ("seg_lang", pa.string()), ("confidence", pa.float64()), ("sentences", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = scorer(path, model.value)
        for batch in batches:
            spans, sizes, said = [], [], []
            for t in batch.column(2).to_pylist():
                own = [(s, e) for s, e in sentence_spans(t, lines=True) if not t.startswith("§", s)]
                for s, e in own:
                    piece = t[s:e]
                    if ":" in piece[:12]:
                        piece = _MARKER.sub("", piece)
                    if "<" in piece:
                        piece = _CITATION.sub("", piece)
                    said.append(piece.lower())
                spans.append(own)
                sizes.append(len(own))
            scores, words = judge.sentences(said)
            lang_, sure, segments, at = [], [], [], 0
            for own, size in zip(spans, sizes, strict=True):
                real = np.flatnonzero(words[at : at + size])
                mine = scores[at : at + size][real]
                at += size
                found = _segments([own[i] for i in real], mine)
                segments.append([{"start_pos": s, "end_pos": e, "seg_lang": LANGUAGES[y], "confidence": c, "sentences": m} for s, e, y, c, m in found])
                if found:
                    length = defaultdict(int)
                    for s, e, y, _, _ in found:
                        length[y] += e - s
                    top = max(length, key=lambda y: (length[y], -y))
                    lang_.append(LANGUAGES[top])
                    sure.append(max(c for _, _, y, c, _ in found if y == top) * length[top] / sum(length.values()))
                else:
                    lang_.append(None)
                    sure.append(0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang_, pa.string()), pa.array(sure, pa.float64()), pa.array(segments, kind)], names=[key, "label", "lang", "confidence", "segments"])

    return source.mapInArrow(run, schema)


def label_faults(languages: DataFrame, key: str) -> DataFrame:
    """Segments of two or more sentences of the documents that have several, or whose label is not theirs."""
    kept = languages.select(key, "label", F.filter("segments", lambda s: s["sentences"] >= 2).alias("s"))
    wrong = (F.size("s") > 1) | ~F.coalesce(F.col("label") == F.try_element_at("s", F.lit(1))["seg_lang"], F.lit(False))
    return kept.where((F.size("s") > 0) & wrong).select(key, F.posexplode("s").alias("segment_no", "__s")).select(key, "segment_no", F.col("__s.seg_lang").alias("seg_lang"))
