"""Personal data in free text: a linear-chain conditional random field over word shapes.

The field is trained on a small labelled table (``pii_table``: sentences in which personal data are
marked as slots, filled by rule) by maximum likelihood, and decoded by Viterbi in numpy batches of
texts of similar length and bounded tokens. A token's features depend on the token alone, its shape,
ending, lists of common names and a short list of words, seen from up to three places away, so each
distinct token is scored once per Python worker and a sentence's scores are sums of table rows.
Where a text holds the words of a decoded span once more, it is decoded again with evidence for it.

An exact check follows the decoding: a found span is trimmed to the form of its type (an address of
electronic mail has a domain with a top level, a phone number takes its extension along) or dropped.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terseforge.llm.pii_table import FAMILY_NAMES, GIVEN, SURNAMES, labelled_table
from terseforge.runtime import small_batches

TYPES = ("email", "phone", "id_number", "address", "name")
#: Labels: O, then B and I of each type.
N_LABELS = 1 + 2 * len(TYPES)
#: Sentences filled from the labelled table, seed, batches and rounds of the fit, weight of the penalty.
EXAMPLES, SEED, BATCHES, ROUNDS, PENALTY = 7000, 7, 12, 9, 4e-4
#: Share of the tokens that show only their shape while the field is fitted.
BLIND = 0.25
REACH = 3
#: A feature is kept if the labelled table shows it more often than this.
SEEN = 3
#: Evidence (nats) for the words of a span that the same text was found to hold elsewhere.
HISTORY = 4.0
#: Tokens, with their filling, that are decoded at once.
TOKENS_AT_ONCE = 60_000

_TOKEN = re.compile(r"&#?\w{1,8};|[぀-ヿ㐀-鿿]|[^\W\d_぀-ヿ㐀-鿿]+|\d+|[^\w\s]|_")
_HTML = ("p", "li", "b", "br", "ul", "a", "href", "mailto", "div", "i", "em", "strong", "span")


# --- features -----------------------------------------------------------------------------------


def tokens(text: str) -> tuple[list[str], list[int], list[int]]:
    """Tokens with their starts and ends."""
    found, starts, ends = [], [], []
    for m in _TOKEN.finditer(text):
        found.append(m[0])
        starts.append(m.start())
        ends.append(m.end())
    return found, starts, ends


def _shape(t: str) -> str:
    if t[0].isdigit():
        return f"d{min(len(t), 9)}"
    if not t[0].isalpha():
        return "p" + (t if len(t) < 8 else "&")
    if "぀" <= t[0] <= "鿿":
        return "cjk"
    if t.isupper():
        return "X" if len(t) == 1 else "XX"
    return ("Xx" if t[0].isupper() else "x") + ("1" if len(t) < 3 else "")


def features(t: str, blind: bool = False) -> list[str]:
    """Features of a token alone: shape, lists of names, word, and ending; ``blind`` leaves the last two out."""
    low = t.lower()
    shape = _shape(t)
    out = ["s=" + shape]
    if low in _GIVEN or low in _SURNAMES:  # the list speaks, not the name
        return out + ["given"] * (low in _GIVEN) + ["surname"] * (low in _SURNAMES) + (["n=" + shape] if shape != "cjk" else [] if blind else ["w=" + low])
    if blind:
        return out
    out.append("w=" + low)
    if t[0].isalpha() and len(t) > 3:
        out += ["e3=" + low[-3:], "e4=" + low[-4:], "c=" + ("X" if t[0].isupper() else "x") + low[-3:]]
    return out


_GIVEN = frozenset(g.lower() for g in GIVEN)
_SURNAMES = frozenset(g.lower() for g in SURNAMES) | frozenset(FAMILY_NAMES)
#: Coarse classes of tokens; two neighbours and the gap between them (none, blanks, a line end) are one joint.
CLASSES = 20
EDGE = 19
N_JOINTS = 3 * CLASSES * CLASSES
NO_JOINT = N_JOINTS - 1  # after the last token


def coarse(t: str, known: bool) -> int:
    """Class of a token; ``known``: the labelled table has shown the word often."""
    low = t.lower()
    if t[0].isdigit():
        return min(len(t), 5) - 1
    if not t[0].isalpha():
        return 5 if t in ".!?" else 6 if t == "," else 7 if t in "-–/()+" else 8
    if "぀" <= t[0] <= "鿿":
        return 9 if low in _SURNAMES else 10
    if low in _GIVEN:
        return 11 if t[0].isupper() else 12
    if low in _SURNAMES:
        return 13 if t[0].isupper() else 12
    if t.isupper():
        return 14 if len(t) == 1 else 15
    return (16 if known else 17) if t[0].isupper() else 18


def _pairs(classes: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Joint of every token with the one before it; the first stands after an edge."""
    before = np.concatenate([[EDGE], classes[:-1]]) if len(classes) else classes
    return (before * CLASSES + classes) * 3 + gaps


class Field:
    """Weights of the field: per place and feature, per kind of joint, transitions, and starts."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, joint: np.ndarray, trans: np.ndarray) -> None:
        self.index, self.weights, self.joint, self.trans = index, weights, joint, trans
        self.digest = hashlib.blake2b(weights.tobytes() + joint.tobytes() + trans.tobytes() + repr(sorted(index)).encode(), digest_size=16).hexdigest()


def _joints(text: str, starts: list[int], ends: list[int]) -> list[int]:
    return [0 if s == e else (2 if "\n" in text[e:s] else 1) for s, e in zip(starts, [0, *ends], strict=False)]


def _labels(starts: list[int], ends: list[int], spans: list[tuple[int, int, str]]) -> list[int]:
    out = [0] * len(starts)
    for s, e, kind in spans:
        first = True
        for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
            if a >= s and b <= e:
                out[k] = 1 + 2 * TYPES.index(kind) + (0 if first else 1)
                first = False
    return out


def _allowed() -> np.ndarray:
    """Transitions: I follows only B or I of its own type."""
    ok = np.ones((N_LABELS, N_LABELS), bool)
    for k in range(len(TYPES)):
        ok[:, 2 + 2 * k] = False
        ok[1 + 2 * k, 2 + 2 * k] = ok[2 + 2 * k, 2 + 2 * k] = True
    return ok


class _Batch:
    """Labelled sentences as arrays, with the sums over their features prepared."""

    def __init__(self, table: list[tuple[list[int], list[int], list[int]]], of_kind: np.ndarray, n_features: int) -> None:
        self.b, places = len(table), 2 * REACH + 1
        self.most = most = max(len(own) for own, _, _ in table)
        ids = np.zeros((self.b, most + 2 * REACH), np.int32)
        joint_ids = np.full((self.b, most, 2), NO_JOINT, np.int32)
        gold = np.zeros((self.b, most), np.int32)
        sizes = np.array([len(own) for own, _, _ in table])
        for i, (own, js, ys) in enumerate(table):
            ids[i, REACH : REACH + len(own)] = own
            joint_ids[i, : len(js), 0] = js
            joint_ids[i, : len(js), 1] = [*js[1:], NO_JOINT]
            gold[i, : len(ys)] = ys
        own_kinds, ids = np.unique(ids, return_inverse=True)
        ids = ids.reshape(self.b, -1)
        self.of_kind = of_kind = of_kind[own_kinds]
        self.mask = np.arange(most)[None] < sizes[:, None]
        self.rows, self.cols = np.nonzero(self.mask)
        self.placed = [_Summed(ids[self.rows, self.cols + p], len(of_kind)) for p in range(places)]
        self.joined = [_Summed(joint_ids[self.rows, self.cols, k], N_JOINTS) for k in range(2)]
        self.spread = _Summed(of_kind.ravel(), n_features)
        self.pair_rows, self.pair_cols = np.nonzero(self.mask[:, 1:])
        transitions = np.zeros((N_LABELS, N_LABELS))
        np.add.at(transitions, (gold[self.pair_rows, self.pair_cols], gold[self.pair_rows, self.pair_cols + 1]), 1.0)
        self.observed = [*self._gathered(np.eye(N_LABELS, dtype=np.float32)[gold[self.rows, self.cols]]), transitions]

    def _gathered(self, per_token: np.ndarray) -> list[np.ndarray]:
        """Sums of a value per token over each place's features, and over each joint."""
        width = self.of_kind.shape[1]
        return [np.stack([self.spread.add(np.repeat(p.add(per_token), width, axis=0)) for p in self.placed]), np.stack([j.add(per_token) for j in self.joined])]

    def gradient(self, weights: np.ndarray, joint: np.ndarray, trans: np.ndarray, ok: np.ndarray) -> list[np.ndarray]:
        """Of the log-likelihood, a sentence, by forward and backward sums."""
        rows, cols, most = self.rows, self.cols, self.most
        em = sum(weights[p][self.of_kind].sum(1)[q.ids] for p, q in enumerate(self.placed)) + joint[0][self.joined[0].ids] + joint[1][self.joined[1].ids]
        dense = np.zeros((self.b, most, N_LABELS), np.float32)
        dense[rows, cols] = em
        t = np.where(ok, np.exp(np.clip(trans, -20, 20)), 0).astype(np.float32)
        x = np.exp(np.clip(dense - dense.max(2, keepdims=True), -60, 0))
        start = np.ones(N_LABELS, np.float32)
        start[2::2] = 0
        alpha, scale = np.zeros_like(x), np.ones((self.b, most), np.float32)
        for k in range(most):
            a = x[:, 0] * start if k == 0 else (alpha[:, k - 1] @ t) * x[:, k]
            scale[:, k] = np.maximum(a.sum(1), 1e-30)
            alpha[:, k] = a / scale[:, k : k + 1]
        beta = np.ones_like(x)
        for k in range(most - 2, -1, -1):
            after = ((x[:, k + 1] * beta[:, k + 1]) @ t.T) / scale[:, k + 1 : k + 2]
            beta[:, k] = np.where(self.mask[:, k + 1 : k + 2], after, 1.0)
        gamma = (alpha * beta)[rows, cols]
        gamma /= np.maximum(gamma.sum(1, keepdims=True), 1e-30)
        left = alpha[self.pair_rows, self.pair_cols] / scale[self.pair_rows, self.pair_cols + 1][:, None]
        expected = [*self._gathered(gamma), (left.T @ (x * beta)[self.pair_rows, self.pair_cols + 1]) * t]
        return [(o - e) / self.b for o, e in zip(self.observed, expected, strict=True)]


@lru_cache(maxsize=1)
def train(n: int = EXAMPLES, seed: int = SEED, rounds: int = ROUNDS) -> Field:
    """Fits the field to the labelled table by penalised maximum likelihood (Adam, in batches).

    A share ``BLIND`` of the tokens shows its shape only, so that the field learns to read words that
    no table holds from their surroundings.
    """
    rng = random.Random(seed)
    table = []
    for text, spans in labelled_table(n, seed):
        t, s, e = tokens(text)
        if t:
            table.append(([(w, rng.random() < BLIND) for w in t], _joints(text, s, e), _labels(s, e, spans)))
    kinds = {t: k + 1 for k, t in enumerate(sorted({t for own, _, _ in table for t in own}))}  # 0: no token
    counts: dict[str, int] = {}
    for own, _, _ in table:
        for t in own:
            for f in features(*t):
                counts[f] = counts.get(f, 0) + 1
    index = {f: k + 1 for k, f in enumerate(sorted(f for f, c in counts.items() if c > SEEN))}  # 0: absent
    of_kind = np.zeros((len(kinds) + 1, 8), np.int32)
    for t, k in kinds.items():
        known = [index[f] for f in features(*t) if f in index]
        of_kind[k, : len(known)] = known
    classes = {t: coarse(t[0], "w=" + t[0].lower() in index) for t in kinds}
    rows = [([kinds[t] for t in own], _pairs(np.array([classes[t] for t in own]), np.array(js)).tolist(), ys) for own, js, ys in table]
    rng.shuffle(rows)
    rows.sort(key=lambda r: len(r[0]) // 12)  # batches of similar length
    size = -(-len(rows) // BATCHES)
    batches = [_Batch(rows[lo : lo + size], of_kind, len(index) + 1) for lo in range(0, len(rows), size)]
    ok = _allowed()
    params = [np.zeros(shape, np.float32) for shape in ((2 * REACH + 1, len(index) + 1, N_LABELS), (2, N_JOINTS, N_LABELS), (N_LABELS, N_LABELS))]
    moment, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for turn in range(rounds):
        rng.shuffle(batches)
        for batch in batches:
            step += 1
            params[0][:, 0] = 0
            rate = 0.12 * (1 - turn / (rounds + 1))
            for k, (p, g) in enumerate(zip(params, batch.gradient(*params, ok), strict=True)):
                grad = g - PENALTY * p
                moment[k] = 0.9 * moment[k] + 0.1 * grad
                second[k] = 0.99 * second[k] + 0.01 * grad * grad
                p += rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    params[0][:, 0] = 0
    return Field(index, params[0].astype(np.float32), params[1].astype(np.float32), np.where(ok, params[2], -1e4).astype(np.float32))


class _Summed:
    """Sums rows by id, with the sorting done once."""

    def __init__(self, ids: np.ndarray, size: int) -> None:
        self.ids, self.size = ids, size
        self.order = np.argsort(ids, kind="stable")
        ordered = ids[self.order]
        self.bounds = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        self.found = ordered[self.bounds]

    def add(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.size, values.shape[1]), values.dtype)
        out[self.found] = np.add.reduceat(values[self.order], self.bounds, axis=0)
        return out


# --- decoding -----------------------------------------------------------------------------------


class Decoder:
    """Finds personal data with a trained field; one lives in a Python worker."""

    def __init__(self, field: Field) -> None:
        self.field = field
        self._start()

    def _start(self) -> None:
        self.ids: dict[str, int] = {}
        self.table = np.zeros((1 << 12, 2 * REACH + 1, N_LABELS), np.float32)
        self.classes = np.zeros(1 << 12, np.int64)

    def _rows(self, found: list[str]) -> np.ndarray:
        if len(self.ids) > 300_000:  # bounds the worker's memory
            self._start()
        ids = self.ids
        for t in {t for t in found if t not in ids}:
            k = ids[t] = len(ids)
            if k + 1 >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.classes = np.concatenate([self.classes, np.zeros_like(self.classes)])
            known = [self.field.index[f] for f in features(t) if f in self.field.index]
            self.table[k] = self.field.weights[:, known].sum(1)
            self.classes[k] = coarse(t, "w=" + t.lower() in self.field.index)
        return np.fromiter(map(ids.__getitem__, found), np.int64, len(found))

    def batch(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Spans of every text."""
        cut = [tokens(t) for t in texts]
        sizes = np.array([len(c[0]) for c in cut], np.int64)
        everything = [t for c in cut for t in c[0]]
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not everything:
            return out
        rows = self._rows(everything)
        n = len(rows)
        owner = np.repeat(np.arange(len(texts)), sizes)
        em = np.zeros((n, N_LABELS), np.float32)
        for p in range(2 * REACH + 1):
            off = p - REACH
            lo, hi = max(0, -off), min(n, n - off)
            if lo < hi:
                same = owner[lo:hi] == owner[lo + off : hi + off]
                em[lo:hi][same] += self.table[rows[lo + off : hi + off][same], p]
        joints = np.concatenate([np.array(_joints(t, c[1], c[2]), np.int64) for t, c in zip(texts, cut, strict=True)])
        firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
        classes = self.classes[rows]
        before = np.concatenate([[EDGE], classes[:-1]])
        before[firsts] = EDGE
        joints += (before * CLASSES + classes) * 3
        em += self.field.joint[0][joints]
        after = np.concatenate([joints[1:], [NO_JOINT]])
        after[np.cumsum(sizes)[sizes > 0] - 1] = NO_JOINT
        em += self.field.joint[1][after]
        # No path leaves O where every other label loses more than any two transitions can give.
        trans = self.field.trans
        gain = 2 * float(max(trans[trans > -1e3].max(), 0)) - 2 * float(min(trans[0, 0], 0))
        hopeful = (em[:, 1:].max(1) - em[:, 0] + gain) > 0
        chosen = np.unique(owner[hopeful])
        ends = np.cumsum(sizes)
        for i, path in self._paths(em, chosen, ends, sizes):
            out[i] = self._spans(texts[i], cut[i][1], cut[i][2], path)
        again = [i for i in chosen.tolist() if out[i] and self._recall(texts[i], cut[i][1], cut[i][2], out[i], em[ends[i] - sizes[i] : ends[i]])]
        for i, path in self._paths(em, np.array(again, np.int64), ends, sizes):
            out[i] = self._spans(texts[i], cut[i][1], cut[i][2], path)
        return out

    def _paths(self, em: np.ndarray, chosen: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The best path of each chosen text, in groups of similar length and bounded tokens."""
        chosen = chosen[np.argsort(sizes[chosen], kind="stable")]
        lo = 0
        while lo < len(chosen):
            hi = lo + 1
            while hi < len(chosen) and (hi + 1 - lo) * sizes[chosen[hi]] <= TOKENS_AT_ONCE:
                hi += 1
            yield from zip(chosen[lo:hi].tolist(), self._viterbi(em, chosen[lo:hi], ends, sizes), strict=True)
            lo = hi

    @staticmethod
    def _recall(text: str, starts: list[int], ends: list[int], spans: list[tuple[int, int, str]], em: np.ndarray) -> bool:
        """Adds evidence where the text holds the words of a found span once more; whether it did."""
        added = False
        for s, e, kind in spans:
            if kind == "address":
                continue
            said = text[s:e]
            at = text.find(said)
            while at >= 0:
                first, last = bisect.bisect_left(starts, at), bisect.bisect_left(ends, at + len(said))
                if not any(a < at + len(said) and at < b for a, b, _ in spans) and first < len(starts) and starts[first] == at and last < len(ends) and ends[last] == at + len(said):
                    label = 1 + 2 * TYPES.index(kind)
                    em[first, label] += HISTORY
                    em[first + 1 : last + 1, label + 1] += HISTORY
                    added = True
                at = text.find(said, at + len(said))
        return added

    def _viterbi(self, em: np.ndarray, part: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        most = int(sizes[part].max())
        at = (ends[part] - sizes[part])[:, None] + np.arange(most)[None]
        live = np.arange(most)[None] < sizes[part][:, None]
        x = em[np.where(live, at, 0)]
        best = x[:, 0].copy()
        best[:, 2::2] = -1e4
        back = np.zeros((most, len(part), N_LABELS), np.int8)
        for k in range(1, most):
            total = best[:, :, None] + self.field.trans[None]
            back[k] = total.argmax(1)
            stepped = total.max(1) + x[:, k]
            best = np.where(live[:, k : k + 1], stepped, best)
        paths = []
        last = best.argmax(1)
        for b, i in enumerate(part):
            n = int(sizes[i])
            path = np.empty(n, np.int8)
            path[-1] = last[b]
            for k in range(n - 1, 0, -1):
                path[k - 1] = back[k, b, path[k]]
            paths.append(path)
        return paths

    @staticmethod
    def _spans(text: str, starts: list[int], ends: list[int], path: np.ndarray) -> list[tuple[int, int, str]]:
        out: list[tuple[int, int, str]] = []
        k, n = 0, len(path)
        if not path.any():
            return out
        while k < n:
            label = int(path[k])
            if label == 0:
                k += 1
                continue
            kind = (label - 1) // 2
            last = k
            while last + 1 < n and path[last + 1] == 2 + 2 * kind:
                last += 1
            span = fitted(text, starts[k], ends[last], TYPES[kind])
            if span and (not out or span[0] >= out[-1][1]):
                out.append((*span, TYPES[kind]))
                if TYPES[kind] == "email" and span[1] < ends[last]:  # two of them in a row
                    k = max(k + 1, bisect.bisect_left(starts, span[1], k, last + 1))
                    path[k : last + 1] = [1 + 2 * kind] + [2 + 2 * kind] * (last - k) if k <= last else []
                    continue
            k = last + 1
        return out


# --- the exact check ------------------------------------------------------------------------------

_AT = r"(?:\s?(?:@|＠|&#64;|&#x40;|&commat;|%40)\s?|\s?[\[(]\s?at\s?[\])]\s?)"
_DOT = r"(?:\.|&#46;|&#x2e;|&period;|\s?[\[(]\s?dot\s?[\])]\s?)"
_L = "A-Za-z0-9À-ɏЀ-ӿ"
_EMAIL = re.compile(rf"[{_L}](?:[{_L}_+%-]|{_DOT}(?=[{_L}_+-]))*{_AT}(?:[{_L}](?:[{_L}_-]*[{_L}])?{_DOT})+[A-Za-zÀ-ɏЀ-ӿ]{{2,}}", re.I)
_PHONE = re.compile(r"(?:\+\d{1,3}[\s.-]?)?(?:\d[\s.-]?)?(?:\(\d{1,5}\)[\s.-]?)?\d[\d\s./-]*\d")
_EXTENSION = re.compile(r",?\s?(?:ext\.?|extension|x|доб\.?|Durchwahl|poste|内线)\s?\d{1,6}", re.I)
_ID = re.compile(r"(?<![\w])(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|\d{3}[- ]\d{2}[- ]\d{4}|\d{6,}-?[A-Z]|[A-Z]{0,3}\d[\dA-Z]{6,}|[A-Z]\d{2}[A-Z]\d{5,})(?![\w])")
_LETTERS = r"[^\W\d_]+(?:['’][^\W\d_]+)*"
_NAME = re.compile(rf"{_LETTERS}\.?(?:(?:, | |-|·|・){_LETTERS}\.?)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_NEXT_SENTENCE = re.compile(r"(?<!Ave)(?<!Rd)(?<!St)(?<!ул)(?<!д)(?<!г)(?<!пр)(?<!кв)(?<!str)\.\s+(?=[^\W\d_])")
_CAP = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][^\W\d_]+(?:[’'][^\W\d_]+)?"
_NAME_BEFORE = re.compile(rf"{_CAP}, (?=\d|Flat|PO Box|Apt)")
# Titles, which a name does not include, and prepositions, which an address does not.
_TITLE = re.compile(r"(?:mr|mrs|ms|miss|dr|prof|professor|president|chancellor|sir|lady|m|mme|mlle|monsieur|madame|sr|sra|señor|señora|senhor|senhora|herr|herrn|frau|don|doña|dona|господин|госпожа|доктор|писатель|дорогой|уважаемый|dear|hi)\b\.?\s+", re.I)
_PREPOSITION = re.compile(r"(?:to|at|in|on|from|near|nach|aus|von|au|aux|en|de|na|no|em|para|в|на|по)\s+(?=\d|[^\W\d_]{3,} [^\W\d_]*\s?\d)", re.I)
_CJK_ADDRESS = re.compile(r"(?:(?![是在于址到はに])[぀-ヿ㐀-鿿])+?[路街道巷町市区县県]\d+(?:[-－]\d+)*(?:号|丁目\d+番地|番地|番)?(?:\d+室)?")
_DIGIT = re.compile(r"\d")
_NO_NUMBER = re.compile(r"[^\W\d_]{3,}[\s:]+")


def _words_around(text: str, start: int, end: int, n: int) -> tuple[int, int]:
    """The span widened to whole runs without blanks, and by ``n`` such runs on each side in its line."""
    for _ in range(n + 1):
        while start and text[start - 1] in " \xa0":
            start -= 1
        while start and not text[start - 1].isspace() and text[start - 1] not in "<>":
            start -= 1
        while end < len(text) and text[end] in " \xa0":
            end += 1
        while end < len(text) and not text[end].isspace() and text[end] not in "<>":
            end += 1
    return start, end


def _run(text: str, start: int, end: int) -> tuple[int, int]:
    """The span widened to whole runs of letters, digits and the signs inside numbers."""
    while start and (text[start - 1].isalnum() or text[start - 1] in "+(-"):
        start -= 1
    while end < len(text) and (text[end].isalnum() or text[end] == "-"):
        end += 1
    return start, end


def fitted(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """The span in the form of its type, or None if it has not that form."""
    if kind == "email":
        for m in _EMAIL.finditer(text, *_words_around(text, start, end, 2)):
            if m.start() < end and m.end() > start:
                return m.span()
        return None
    if kind == "phone":
        for m in _PHONE.finditer(text, *_run(text, start, end)):
            if m.start() < end and m.end() > start and 6 <= len(_DIGIT.findall(m[0])) <= 15:
                more = _EXTENSION.match(text, m.end())
                return m.start(), more.end() if more else m.end()
        return None
    if kind == "id_number":
        word = _NO_NUMBER.match(text, start, end)
        start = word.end() if word else start
        for m in _ID.finditer(text, *_run(text, start, end)):
            if m.start() < end and m.end() > start and m.end() - m.start() >= end - start - 2:
                return m.span()
        while start < end and not text[start].isalnum():
            start += 1
        while start < end and not text[end - 1].isalnum():
            end -= 1
        return (start, end) if len(_DIGIT.findall(text, start, end)) >= 5 and not any(c.islower() for c in text[start:end]) else None
    for stop in "\n<":  # a name or an address stays on its line and in its element
        at = text.find(stop, start + 1, end)
        end = at if at > 0 else end
    while start < end and (text[start].isspace() or text[start] in "\"“„«'(,:;.-<>/"):
        start += 1
    while start < end and (text[end - 1].isspace() or text[end - 1] in "\"”“»')(,:;<>/-" or (text[end - 1] == "." and kind == "address" and not text[start:end].endswith(("Ave.", "Rd.", "St.")))):
        end -= 1
    if kind == "name":
        while title := _TITLE.match(text, start, end):
            start = title.end()
        m = _NAME.match(text, start, end)
        if m is None:
            return None
        end = m.end()
        if text[start:end].endswith(("'s", "’s")):
            end -= 2
        if text[end - 1] == "." and not (end - start > 2 and text[end - 2].isupper() and text[end - 3] in " ."):
            end -= 1  # the point of an initial is its own, any other ends the sentence
        parts = re.split(r"[ ,\-·・]+", text[start:end])
        return (start, end) if len(parts) > 1 or (_CJK.match(text, start) and end - start > 1) else None
    if _CJK.search(text, start, end):
        m = _CJK_ADDRESS.search(text, start, end + 1)
        return m.span() if m else (start, end) if _DIGIT.search(text, start, end) else None
    start = max(start, text.rfind('"', start, end) + 1)
    stop = _NEXT_SENTENCE.search(text, start, end)
    end = stop.start() if stop else end
    before = _NAME_BEFORE.match(text, start, end) or _PREPOSITION.match(text, start, end)
    start = before.end() if before else start
    if not any(c.isdigit() for c in text[start:end]) or not any(c.isalpha() for c in text[start:end]):
        return None
    return (start, end) if start < end else None


_DECODERS: dict[str, Decoder] = {}


def _decoder(field: Field) -> Decoder:
    """This worker's decoder for a field, known by a digest of its weights."""
    if field.digest not in _DECODERS:
        _DECODERS.clear()
        _DECODERS[field.digest] = Decoder(field)
    return _DECODERS[field.digest]


def personal_data(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, pii_type, start_pos, end_pos: every occurrence in the stored text of every row.

    One narrow pass without a shuffle. Null and empty texts have none; repeated rows are read each by
    itself. Other columns are ignored, whatever their names.
    """
    return _found(df, keys, text, False)


def redacted(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, n_found and the text with each occurrence replaced by its type in brackets; null stays null."""
    return _found(df, keys, text, True)


def _found(df: DataFrame, keys: list[str], text: str, replace: bool) -> DataFrame:
    spark = df.sparkSession
    small_batches(spark)
    field = spark.sparkContext.broadcast(train())  # bounded by the labelled table
    source = df.select(*keys, F.col(text).alias("__t"))
    if not replace:
        source = source.where(F.length("__t") > 0)
    n = len(keys)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[: n])
    schema = ddl + (", n_found int, text string" if replace else ", pii_type string, start_pos int, end_pos int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(field.value)
        for batch in batches:
            texts = batch.column(n).to_pylist()
            spans = decoder.batch([t or "" for t in texts])
            if replace:
                new = []
                for t, own in zip(texts, spans, strict=True):
                    for s, e, kind in reversed(own):
                        t = f"{t[:s]}[{kind.upper()}]{t[e:]}"
                    new.append(t)
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(n)], pa.array([len(s) for s in spans], pa.int32()), pa.array(new, pa.string())], names=[*keys, "n_found", "text"])
            else:
                flat = [(i, s, e, kind) for i, own in enumerate(spans) for s, e, kind in own]
                at = pa.array([f[0] for f in flat], pa.int32())
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in range(n)], pa.array([f[3] for f in flat], pa.string()), pa.array([f[1] for f in flat], pa.int32()), pa.array([f[2] for f in flat], pa.int32())], names=[*keys, "pii_type", "start_pos", "end_pos"])

    return source.mapInArrow(run, schema)
