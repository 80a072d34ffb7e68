"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import regex
from pyspark.sql import DataFrame, functions as F

from lacuna.llm.labelled import fit_on_labelled, fold
from lacuna.llm.texts import by_text

WORD = re.compile(r"\w+")

#: Second person in the languages of the corpus.
YOU = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch sie tu te toi ton ta tes vous votre vos "
                "tú ti usted ustedes vosotros su tus".split())

#: Letters that digits and signs stand for when a word is disguised.
PLAIN = str.maketrans("013457@$!|", "oieastasil")
# words with signs inside, before or behind; what joins single letters may be repeated
MIXED = re.compile(r"[\w@$!|*]+(?:[.\-_]+[\w@$!|*]+)*")
HAS_LETTER, HAS_SIGN = re.compile(r"[^\W\d_]"), re.compile(r"[0-9@$!|*.\-_]")


def disguises(text: str) -> list[str]:
    """Words that mix letters with digits or signs, without the signs that end a sentence; the lexicon decides what they are."""
    words = (w.strip("!|*_") for w in MIXED.findall(text))
    return [w for w in words if HAS_SIGN.search(w) and HAS_LETTER.search(w)]


#: Words remembered per task; only speed depends on it.
MEMORY = 600_000

#: Word starts of these lengths are terms of the lexicon beside whole words, for inflected forms.
STARTS = (4, 5, 6)

#: Words between a lexicon word and a second person that count as near.
NEAR = 5

FEATURES = ("words", "hit_count", "hit_share", "weight_share", "most", "start_count", "start_share", "disguised_hits", "disguised_share", "you_share",
            "you_near", "capitals", "shouted", "exclaims", "questions", "signs", "doubled")


def terms(word: str) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in STARTS if len(word) > n]]


def learn_lexicon(examples: list[tuple[str, int]], least: float = 20.0, share: float = 0.75) -> dict[str, float]:
    """Term to weight: terms whose documents are toxic far more often than all are, by the likelihood-ratio statistic."""
    total = Counter(y for _, y in examples)
    with_term: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for text, y in examples:
        with_term[y].update({t for w in set(WORD.findall(text.lower())) for t in terms(w)})
    n = sum(total.values())
    base = total[1] / n if n else 0
    found = {}
    for term, k in with_term[1].items():
        m = k + with_term[0][term]
        p = k / m
        if not 0 < base < 1 or p < max(share, 2 * base):
            continue
        gain = k * math.log(p / base) + ((m - k) * math.log((1 - p) / (1 - base)) if m > k else 0)
        if 2 * gain >= least:
            found[term] = math.log((k + 0.5) / (m - k + 0.5) * (1 - base) / base)
    return found


class Features(dict):
    """Word to (weight as a whole word, weight by its start), remembered per distinct word; and a text's features."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word):
        if len(self) >= MEMORY:
            self.clear()
        whole = self.lexicon.get(word, 0.0)
        start = max((self.lexicon.get(f"{word[:n]}*", 0.0) for n in STARTS if len(word) > n), default=0.0)
        kind = 0 if not (whole or start) and word not in YOU else 1
        value = self[word] = (kind, whole, start)
        return value

    def of(self, text: str) -> list[float]:
        words = WORD.findall(text.lower())
        n = max(1, len(words))
        marked = [(i, w, k) for i, (w, k) in enumerate(zip(words, map(self.__getitem__, words))) if k[0]]
        hits = [(i, k[1]) for i, _, k in marked if k[1]]
        starts = [(i, k[2]) for i, _, k in marked if k[2]]
        you = [i for i, w, _ in marked if w in YOU]
        disguised = disguises(text)
        plain = [self[re.sub(r"[*.\-_]", "", d.lower().translate(PLAIN))] for d in disguised]
        letters = len(CAPITAL.findall(text))
        near, j = 0, 0
        for i in sorted({i for i, _ in hits + starts}):
            while j < len(you) and you[j] < i - NEAR:
                j += 1
            near += j < len(you) and you[j] <= i + NEAR
        chars = max(1, len(text))
        return [math.log1p(len(words)), len(hits), len(hits) / n, sum(w for _, w in hits) / n, max([0.0, *(w for _, w in hits + starts)]),
                len(starts), len(starts) / n, sum(1 for k in plain if k[1] or k[2]), len(disguised) / n, len(you) / n, near / n,
                letters / chars, len(SHOUTED.findall(text)) / n, text.count("!") / n, text.count("?") / n,
                len(SIGN.findall(text)) / chars, len(DOUBLED.findall(text)) / n]


# capitals of any script, at every size
CAPITAL = regex.compile(r"\p{Lu}")
SHOUTED = regex.compile(r"\b\p{Lu}{3,}\b")
SIGN = re.compile(r"[#&*$%@!?]")
DOUBLED = re.compile(r"([!?.#*&$%])\1+")


def down(x: np.ndarray, leaf: np.ndarray, split: list[tuple[int, float]]) -> np.ndarray:
    """The next level's node of every row."""
    feature, limit = (np.array(c)[leaf] for c in zip(*split))
    return 2 * leaf + (x[np.arange(len(x)), feature] > limit)


def margins(x: np.ndarray, start: float, rate: float, trees: list) -> np.ndarray:
    out = np.full(len(x), start)
    for splits, values in trees:
        leaf = np.zeros(len(x), np.int64)
        for split in splits:
            leaf = down(x, leaf, split)
        out += rate * values[leaf]
    return out


class Trees:
    """Trees of fixed depth on binned features, fitted to the gradients of the log loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        share = (y.sum() + 1) / (len(y) + 2)
        self.start, self.rate, self.trees = math.log(share / (1 - share)), rate, []
        margin = np.full(len(y), self.start)
        if len(np.unique(y)) < 2:
            return
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)  # bin b: at most edges[b]
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            leaf, splits = np.zeros(len(y), np.int64), []
            for level in range(depth):
                split = []
                for node in range(1 << level):
                    rows = leaf == node
                    best = (1e-6, 0, math.inf)
                    if rows.sum() >= 2:
                        total_g, total_h = g[rows].sum(), h[rows].sum()
                        for f, e in enumerate(edges):
                            if not len(e):
                                continue
                            left_g = np.cumsum(np.bincount(binned[rows, f], g[rows], len(e) + 1))[:-1]
                            left_h = np.cumsum(np.bincount(binned[rows, f], h[rows], len(e) + 1))[:-1]
                            gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
                            at = int(gain.argmax())
                            if gain[at] > best[0]:
                                best = (gain[at], f, e[at])
                    split.append(best[1:])
                splits.append(split)
                leaf = down(x, leaf, split)
            sums = np.bincount(leaf, g, 1 << depth), np.bincount(leaf, h, 1 << depth)
            values = sums[0] / (sums[1] + ridge)
            self.trees.append((splits, values))
            margin += rate * values[leaf]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return margins(x, self.start, self.rate, self.trees)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(margins, probabilities): the rising step function nearest to the labels, by pooling adjacent violators.
    Two imagined examples, one of each class at the share of the sample, keep the ends off 0 and 1."""
    levels, of = np.unique(margin, return_inverse=True)  # examples of one margin are one step
    blocks: list[list[float]] = []  # sum, count, last margin, first margin
    for m, v, n in zip(levels, np.bincount(of, y), np.bincount(of)):
        blocks.append([float(v), float(n), m, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, c, last, _ = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += c
            blocks[-1][2] = last
    share = y.mean()
    value = [(s + share) / (c + 1) for s, c, _, _ in blocks]
    at = np.array([x for _, _, last, first in blocks for x in (first, last)])
    return at, np.maximum.accumulate(np.repeat(value, 2))


def fit(examples: list[tuple[str, int]]) -> dict:
    """Lexicon, trees and calibration. Trees see, and calibration uses, only texts whose labels their lexicon has not seen."""
    examples = list(dict.fromkeys(examples))  # copies would make every word of theirs look telling
    y = np.array([v for _, v in examples], float)
    if len(np.unique(y)) < 2:
        trees = Trees(np.zeros((len(y), len(FEATURES))), y)
        return {"lexicon": {}, "start": trees.start, "rate": trees.rate, "trees": [], "at": np.zeros(1), "value": np.array([(y.sum() + 1) / (len(y) + 2)])}
    folds = np.arange(len(y)) % 3
    x, out = np.zeros((len(y), len(FEATURES))), np.zeros(len(y))
    for k in range(3):
        seen = Features(learn_lexicon([e for e, f in zip(examples, folds) if f != k]))
        for i in np.flatnonzero(folds == k):
            x[i] = seen.of(examples[i][0])
    for k in range(3):
        out[folds == k] = Trees(x[folds != k], y[folds != k]).margin(x[folds == k])
    trees = Trees(x, y)
    at, value = isotonic(out, y)
    return {"lexicon": learn_lexicon(examples), "start": trees.start, "rate": trees.rate, "trees": trees.trees, "at": at, "value": value}


def scorer(model: dict):
    """A function from texts to probabilities."""
    features = Features(model["lexicon"])

    def score(texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        margin = margins(np.array([features.of(t) for t in texts]), model["start"], model["rate"], model["trees"])
        # a trace of the margin keeps apart what calibration ties
        return np.clip(np.interp(margin, model["at"], model["value"]) + 1e-6 * np.tanh(margin / 8), 0, 1)

    return score


def toxicity(df: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, rows: int = 6000, most_bytes: int = 48_000_000,
             key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` of every row.

    The model is fitted in one task on at most ``rows`` labelled texts of ``most_bytes`` bytes in all outside the
    held-out fold; labels are used nowhere else. Null and empty texts have all features 0. Rows are
    independent: repeated rows get the same score, null keys are not held out, other columns are left
    out. Without labels, or with labels of one class, every score is the smoothed share of label 1.
    """
    model = fit_on_labelled(df, labels, label, rows, most_bytes, fit, key, text)

    def make():
        score = scorer(model)
        return lambda texts: {"score": score(texts)}

    scored = by_text(df, [key], text, make, "score double")
    return scored.select(key, (F.coalesce(fold(F.col(key)), F.lit(-1)) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
