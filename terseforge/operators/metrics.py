"""Overlap metrics between pairs of texts.

n-gram metrics are relational: both sides' n-grams go through one aggregation that counts each side,
so no join is needed; pairs are dealt out by key before they are cut, so no n-gram is shuffled. Metrics
that follow the order of tokens (longest common subsequence, chunked alignment) run in Arrow batches.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terseforge.functions import text as T


def rouge_tokens(c: Column) -> Column:
    """Lower-case runs of basic letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def bleu_tokens(c: Column) -> Column:
    """Tokens in the manner of the machine translation evaluations: signs apart, numbers whole."""
    t = F.concat(F.lit(" "), F.regexp_replace(c, r"\n", " "), F.lit(" "))
    for code, sign in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(code), F.lit(sign))
    # The published order of replacements.
    for pattern, by in ((r"([{-~\[-` -&(-+:-@/])", " $1 "), (r"([^0-9])([.,])", "$1 $2 "), (r"([.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 ")):
        t = F.regexp_replace(t, pattern, by)
    return F.filter(F.split(t, " +", -1), lambda x: x != "")


def gram_hashes(toks: Column, n: int) -> Column:
    """A 64-bit hash of every run of ``n`` tokens."""
    last = F.size(toks) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(toks, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def gram_counts(pairs: DataFrame, key: str, prediction: str, reference: str, orders: list[int], tokens: Callable[[Column], Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per pair: key, ``keep``, and for each order n: n_pred_n, n_ref_n, n_both_n (clipped overlap).

    The pairs' texts are dealt out by key once; their n-grams are counted where they arise and never
    move. A null side counts as an empty text. ``key`` must name a pair.
    """
    none = F.array().cast("array<string>")
    placed = pairs.select(key, *keep, prediction, reference).repartition(key)
    both = placed.select(key, *keep, F.coalesce(tokens(F.col(prediction)), none).alias("__p"), F.coalesce(tokens(F.col(reference)), none).alias("__r"))

    def marked(side: str, mine: int, n: int) -> Column:
        return F.transform(gram_hashes(F.col(side), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"), F.lit(mine).alias("mine")))

    grams = F.flatten(F.array(*[marked(side, mine, n) for n in orders for side, mine in (("__p", 1), ("__r", 0))]))
    rows = both.select(key, *keep, F.explode_outer(grams).alias("x")).select(key, *keep, "x.n", "x.g", "x.mine")
    each = rows.groupBy(key, *keep, "n", "g").agg(F.sum("mine").alias("cp"), F.sum(1 - F.col("mine")).alias("cr"))
    both_sides = F.least("cp", "cr")
    return each.groupBy(key, *keep).agg(*[F.coalesce(F.sum(F.when(F.col("n") == n, c)), F.lit(0)).alias(f"{name}_{n}") for n in orders for name, c in (("n_pred", F.col("cp")), ("n_ref", F.col("cr")), ("n_both", both_sides))])


def _scores(n: int) -> tuple[Column, Column, Column]:
    """Precision, recall and f1 of an order; 0 where a side has no n-gram."""
    p = F.coalesce(F.col(f"n_both_{n}") / F.nullif(F.col(f"n_pred_{n}"), F.lit(0)), F.lit(0.0))
    r = F.coalesce(F.col(f"n_both_{n}") / F.nullif(F.col(f"n_ref_{n}"), F.lit(0)), F.lit(0.0))
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def rouge_n(pairs: DataFrame, key: str, prediction: str, reference: str, n: int) -> DataFrame:
    """key, precision, recall, f1 of the n-gram overlap; 0 where a side has none."""
    counts = gram_counts(pairs, key, prediction, reference, [n], rouge_tokens)
    p, r, f = _scores(n)
    return counts.select(key, p.alias("precision"), r.alias("recall"), f.alias("f1"))


def rouge_f1(pairs: DataFrame, key: str, prediction: str, reference: str, orders: tuple[int, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """key, ``keep``, rouge1, rouge2, ...: f1 of several orders in one pass."""
    counts = gram_counts(pairs, key, prediction, reference, list(orders), rouge_tokens, keep)
    return counts.select(key, *keep, *[_scores(n)[2].alias(f"rouge{n}") for n in orders])


def corpus_bleu(pairs: DataFrame, key: str, prediction: str, reference: str, by: list[str] | None = None, order: int = 4) -> DataFrame:
    """bleu (with the precisions and brevity penalty) of all pairs, or of each group of ``by``.

    Counts are added over the corpus before the precisions are taken; a zero precision gives 0.
    """
    by = by or []
    counts = gram_counts(pairs, key, prediction, reference, list(range(1, order + 1)), bleu_tokens, tuple(by))
    sums = counts.groupBy(*by).agg(*[F.coalesce(F.sum(f"{c}_{n}"), F.lit(0)).alias(f"{c}_{n}") for n in range(1, order + 1) for c in ("n_both", "n_pred", "n_ref")])
    pred_len, ref_len = F.col("n_pred_1"), F.col("n_ref_1")
    p = [F.col(f"n_both_{n}") / F.nullif(F.col(f"n_pred_{n}"), F.lit(0)) for n in range(1, order + 1)]
    penalty = F.when(pred_len >= ref_len, 1.0).when(pred_len == 0, 0.0).otherwise(F.exp(1 - ref_len / pred_len))
    found = p[0] > 0
    logs = F.ln(p[0])
    for x in p[1:]:
        found = found & (x > 0)
        logs = logs + F.ln(x)
    return sums.select(*by, *[F.coalesce(x, F.lit(0.0)).alias(f"p{n}") for n, x in enumerate(p, 1)], penalty.alias("brevity"), F.when(F.coalesce(found, F.lit(False)), penalty * F.exp(logs / order)).otherwise(0.0).alias("bleu"))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with a row of the table as the bits of one number."""
    places: dict[str, int] = {}
    for k, t in enumerate(a):
        places[t] = places.get(t, 0) | (1 << k)
    row = 0
    for t in b:
        hit = places.get(t, 0) | row
        row = hit & ~(hit - ((row << 1) | 1)) if hit else row
    return row.bit_count()


def meteor_score(prediction: list[str], reference: list[str]) -> float:
    """Unigram alignment of equal tokens, then of equal stems, with the fragmentation penalty; no synonyms."""
    def stem(t: str) -> str:
        for end in ("ations", "ation", "ings", "ing", "ies", "ied", "ers", "er", "ed", "es", "s", "ly"):
            if t.endswith(end) and len(t) - len(end) > 2:
                return t[: -len(end)]
        return t

    free: dict[int, dict[str, list[int]]] = {0: {}, 1: {}}
    for k in reversed(range(len(reference))):
        free[0].setdefault(reference[k], []).append(k)
        free[1].setdefault(stem(reference[k]), []).append(k)
    used: set[int] = set()
    aligned: dict[int, int] = {}
    for stage, form in enumerate((str, stem)):
        for i, t in enumerate(prediction):
            if i in aligned:
                continue
            spots = free[stage].get(form(t), [])
            while spots and spots[-1] in used:
                spots.pop()
            if spots:
                aligned[i] = spots.pop()
                used.add(aligned[i])
    m = len(aligned)
    if not m:
        return 0.0
    chunks = sum(1 for n, (i, k) in enumerate(sorted(aligned.items())) if n == 0 or aligned.get(i - 1) != k - 1)
    p, r = m / len(prediction), m / len(reference)
    return 10 * p * r / (r + 9 * p) * (1 - 0.5 * (chunks / m) ** 3)


def lcs_members(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of one longest common subsequence with ``b``."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    out, i, j = set(), len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def _f1(hits: int, n_pred: int, n_ref: int) -> float:
    p, r = (hits / n_pred, hits / n_ref) if hits else (0.0, 0.0)
    return 2 * p * r / (p + r) if hits else 0.0


def rouge_l_sum(prediction: list[list[str]], reference: list[list[str]]) -> float:
    """F1 over lines: for each line of the reference the union of its longest common subsequences with the prediction's lines."""
    n_pred, n_ref = sum(map(len, prediction)), sum(map(len, reference))
    if len(prediction) == len(reference) == 1:
        return _f1(lcs_length(prediction[0], reference[0]), n_pred, n_ref)
    left, right = Counter(t for x in prediction for t in x), Counter(t for x in reference for t in x)
    hits = 0
    for line in reference:
        for k in sorted(set().union(*(lcs_members(line, x) for x in prediction))):
            if left[line[k]] > 0 and right[line[k]] > 0:
                hits += 1
                left[line[k]] -= 1
                right[line[k]] -= 1
    return _f1(hits, n_pred, n_ref)


def ordered_metrics(pairs: DataFrame, key: str, prediction: str, reference: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, ``keep``, rougeL, rougeLsum, meteor of each pair, in Arrow batches; a null side counts as an empty text."""
    @F.pandas_udf("struct<rougeL:double,rougeLsum:double,meteor:double>")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for p, r in batches:
            rows = []
            for a, b in zip(p, r, strict=True):
                a, b = [list(x) for x in a], [list(x) for x in b]
                flat, other = [t for x in a for t in x], [t for x in b for t in x]
                rows.append((_f1(lcs_length(flat, other), len(flat), len(other)), rouge_l_sum(a, b), meteor_score(flat, other)))
            yield pd.DataFrame(rows, columns=["rougeL", "rougeLsum", "meteor"])

    def lines(c: str) -> Column:
        return F.transform(F.split(F.coalesce(c, F.lit("")), "\n", -1), rouge_tokens)

    cut = pairs.select(key, *keep, lines(prediction).alias("__p"), lines(reference).alias("__r"))
    return cut.select(key, *keep, score("__p", "__r").alias("s")).select(key, *keep, "s.rougeL", "s.rougeLsum", "s.meteor")


#: What each metric of ``evaluate`` reports.
REPORTED = {"bleu": ("bleu",), "meteor": ("meteor",), "rouge": ("rouge1", "rouge2", "rougeL", "rougeLsum")}


def evaluate(pairs: DataFrame, key: str, prediction: str, reference: str, metrics: tuple[str, ...] = ("bleu", "meteor", "rouge"), by: list[str] | None = None) -> DataFrame:
    """All metrics of a set of pairs in one row, or in one for each group of ``by``.

    BLEU is of the corpus, the others are means over pairs. ``key`` must name a pair.
    """
    unknown = set(metrics) - REPORTED.keys()
    if unknown:
        raise ValueError(f"no metric named {sorted(unknown)}; there are {sorted(REPORTED)}")
    by = by or []
    parts = []
    if "bleu" in metrics:
        parts.append(corpus_bleu(pairs, key, prediction, reference, by).select(*by, "bleu"))
    if "rouge" in metrics:
        parts.append(rouge_f1(pairs, key, prediction, reference, (1, 2), tuple(by)).groupBy(*by).agg(F.avg("rouge1").alias("rouge1"), F.avg("rouge2").alias("rouge2")))
    ordered = [c for m, names in (("rouge", ("rougeL", "rougeLsum")), ("meteor", ("meteor",))) if m in metrics for c in names]
    if ordered:
        parts.append(ordered_metrics(pairs, key, prediction, reference, tuple(by)).groupBy(*by).agg(*[F.avg(c).alias(c) for c in ordered]))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, by) if by else out.crossJoin(F.broadcast(part))  # one row each
    return out.select(*by, *[c for m in metrics for c in REPORTED[m]])


def brevity(pred: int, ref: int) -> float:
    """The brevity penalty of two lengths."""
    return 1.0 if pred >= ref else 0.0 if pred == 0 else math.exp(1 - ref / pred)
