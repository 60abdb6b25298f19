"""Toxicity by a classifier chain.

One logistic model a category, in a fixed order.  Each sees the presence of the
selected words and word beginnings, how many terms of a learned lexicon a text
holds, its length, and the probabilities of the categories before it.  In
training these probabilities come from models fitted without the document's own
fold, so a later model learns how reliable earlier ones really are; in use they
come from the models fitted on all training rows.

The first category, ``toxic``, is labelled.  The lexicon is learned from it: the
features that stand almost only in toxic rows.  The later categories are levels
among toxic rows that the lexicon gives: ``severe`` rows hold at least as many
terms as the middle one, in ``dense`` ones they are at least as large a share of
the words.  No word is built in.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystream.llm._arrow import map_texts
from tallystream.llm._sample import least_by_hash

_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are features.
STEMS = (4, 5, 6)
CATEGORIES = ("toxic", "severe", "dense")
#: A lexicon feature's least association with the label, and least share of toxic rows among those with it.
LEAST_SCORE, LEAST_SHARE = 6.0, 0.9


def features_of(word: str) -> list[str]:
    """A word and, if it is longer, its beginnings (with a trailing ``*``)."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def document_features(text: str | None) -> set[str]:
    """The features of all words of a text, lower-cased."""
    return {f for w in set(_WORD.findall((text or "").lower())) for f in features_of(w)}


def scaled(hits, words) -> np.ndarray:
    """The two features of a text's counts: lexicon terms and words."""
    return np.stack((np.log1p(np.asarray(hits, float)) / 2, np.log1p(np.asarray(words, float)) / 8), -1)


@dataclass
class Chain:
    """A fitted chain: feature places, the lexicon, and weights, bias and threshold of each category in order."""

    categories: list[str]
    places: dict[str, int]
    lexicon: frozenset[str]
    levels: tuple[float, float]
    weights: list[np.ndarray]
    biases: list[float]
    thresholds: list[float]

    def word_places(self, word: str) -> tuple[tuple[int, ...], bool]:
        """Places of the features that a word brings, and whether it is a term of the lexicon."""
        names = features_of(word)
        return tuple(self.places[x] for x in names if x in self.places), not self.lexicon.isdisjoint(names)

    def inputs(self, texts: list[str | None], known: dict | None = None) -> np.ndarray:
        """A row of features a text: those present, and the two counts."""
        known = {} if known is None else known
        out, hits, lengths = np.zeros((len(texts), len(self.places))), [0] * len(texts), [0] * len(texts)
        for k, text in enumerate(texts):
            words = _WORD.findall(text.lower()) if text else []
            lengths[k] = len(words)
            for w, n in Counter(words).items():
                at = known.get(w)
                if at is None:
                    at = known[w] = self.word_places(w)
                if at[0]:
                    out[k, at[0]] = 1
                if at[1]:
                    hits[k] += n
        return np.hstack((out, scaled(hits, lengths)))

    def probabilities(self, inputs: np.ndarray) -> np.ndarray:
        """Probability of each category, from rows of features."""
        out = np.zeros((len(inputs), len(self.categories)))
        for k, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            out[:, k] = sigmoid(inputs @ w[: inputs.shape[1]] + logit(out[:, :k]) @ w[inputs.shape[1] :] + b)
        return out

    def flags(self, p: np.ndarray) -> np.ndarray:
        """Which categories hold; a level only together with ``toxic``."""
        out = p >= np.array(self.thresholds)
        out[:, 1:] &= out[:, :1]
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    """Log-odds, bounded, as earlier probabilities enter later models."""
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge-penalised logistic model, by accelerated gradient descent."""
    n, d = x.shape
    w, b = np.zeros(d), 0.0
    if not 0 < y.sum() < n:
        return w, float(logit(np.array([(y.sum() + 0.5) / (n + 1)]))[0]) if n else 0.0
    v = np.random.default_rng(0).normal(size=d)
    for _ in range(12):  # the largest eigenvalue bounds the step
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) + 1e-12
    top = float(np.linalg.norm(x @ v) ** 2) / n + 1
    rate = 1 / (0.25 * top + l2)
    wm, bm, t = w, b, 1.0
    for _ in range(steps):
        r = (sigmoid(x @ wm + bm) - y) / n
        new, newb = wm - rate * (x.T @ r + l2 * wm), bm - rate * r.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        wm, bm = new + (t - 1) / nt * (new - w), newb + (t - 1) / nt * (newb - b)
        w, b, t = new, newb, nt
    return w, float(b)


def select_features(rows: list[set[str]], y: np.ndarray, size: int, least: int) -> tuple[list[str], frozenset[str]]:
    """The features of most association with the labels ``y``, by the signed root of chi-square, and the lexicon."""
    counts: dict[str, list[int]] = {}
    for features, label in zip(rows, y.tolist(), strict=True):
        for f in features:
            c = counts.setdefault(f, [0, 0])
            c[0] += 1
            c[1] += label
    n, total = len(rows), float(y.sum())
    names = sorted(f for f, c in counts.items() if c[0] >= least)
    if not names:
        return [], frozenset()
    df, hit = np.array([counts[f] for f in names], float).T
    expected = df * total / n
    score = (hit - expected) / np.sqrt(np.maximum(expected * (1 - df / n) * (1 - total / n), 1e-9) + 0.5)
    best = np.argsort(-np.abs(score), kind="stable")[:size]
    strong = np.flatnonzero((score >= LEAST_SCORE) & (hit >= LEAST_SHARE * df))
    return [names[i] for i in sorted(best.tolist())], frozenset(names[i] for i in strong.tolist())


def level_labels(toxic: np.ndarray, hits: np.ndarray, words: np.ndarray, levels: tuple[float, float]) -> np.ndarray:
    """The labels of all categories: toxic rows, and those of them whose terms reach either level."""
    share = hits / np.maximum(words, 1)
    return np.stack((toxic, toxic * (hits >= levels[0]), toxic * (share >= levels[1])), 1).astype(float)


def fit_chain(samples: list[tuple[str, bool]], folds: int = 5, size: int = 700, least: int = 3, l2: float = 1e-4) -> Chain:
    """A chain for (text, toxic) rows; a row's fold is its place in the list modulo ``folds``.

    Thresholds maximise F1 of the out-of-fold probabilities.
    """
    toxic = np.array([label for _, label in samples], float)
    names, lexicon = select_features([document_features(t) for t, _ in samples], toxic, size, least) if samples else ([], frozenset())
    chain = Chain(list(CATEGORIES), {f: k for k, f in enumerate(names)}, lexicon, (np.inf, np.inf), [], [], [])
    x = chain.inputs([t for t, _ in samples])
    hits, words = np.expm1(x[:, -2] * 2), np.expm1(x[:, -1] * 8)
    marked = (toxic > 0) & (hits > 0.5)
    if marked.any():
        chain.levels = (float(np.median(np.round(hits[marked]))) - 0.5, float(np.median(hits[marked] / np.maximum(words[marked], 1))) - 1e-9)
    y = level_labels(toxic, hits, words, chain.levels)
    fold, earlier = np.arange(len(samples)) % folds, np.zeros((len(samples), 0))
    for k in range(y.shape[1]):
        z = np.hstack((x, logit(earlier)))
        own = np.zeros(len(samples))
        for f in range(folds):
            w, b = logistic(z[fold != f], y[fold != f, k], l2)
            own[fold == f] = sigmoid(z[fold == f] @ w + b)
        w, b = logistic(z, y[:, k], l2)
        chain.weights.append(w)
        chain.biases.append(b)
        chain.thresholds.append(best_threshold(own, y[:, k]))
        earlier = np.hstack((earlier, own[:, None]))
    return chain


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability, between two rows', at which F1 is highest; beyond any without positive rows."""
    if not y.sum():
        return 1.01
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    k = int(f1.argmax())
    after = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float(min(max((p[order[k]] + after) / 2, 0.1), 0.95))


def training_rows(docs: DataFrame, labels: DataFrame, positive: Column, per_class: int, max_chars: int, doc_id: str = "doc_id", text: str = "text") -> list[tuple[str, bool]]:
    """Labelled texts of up to ``max_chars`` characters, at most ``per_class`` positive and as many other ones.

    The least by hash of their id are taken, of rows that share an id the least text.
    A document with conflicting labels counts as positive; rows without id,
    label or text are left out.
    """
    one = labels.filter(F.col(doc_id).isNotNull() & positive.isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(positive.cast("int")).alias("positive"))
    ids = least_by_hash(one, "positive", per_class).select("id", "positive", "mix").collect()
    if not ids:
        return []
    spark = docs.sparkSession
    side = spark.createDataFrame([(r["id"], r["positive"], r["mix"]) for r in ids], T.StructType([T.StructField("id", labels.schema[doc_id].dataType), T.StructField("positive", T.IntegerType()), T.StructField("mix", T.LongType())]))
    short = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).filter(F.char_length("text") <= max_chars)
    found = short.join(F.broadcast(side), F.col("doc") == F.col("id")).groupBy("mix", "id", "positive").agg(F.min("text").alias("text"))
    rows = sorted(found.collect(), key=lambda r: (r["mix"], r["id"]))
    return [(r["text"], bool(r["positive"])) for r in rows]


def fit(docs: DataFrame, labels: DataFrame, positive: Column, per_class: int = 1500, max_chars: int = 20_000) -> Chain:
    """The chain of the categories, from a bounded sample of labelled documents."""
    return fit_chain(training_rows(docs, labels, positive, per_class, max_chars))


def score(docs: DataFrame, chain: Chain, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``p_<category>`` of each category and ``is_<category>``, of every row.

    The whole text is read.  A null or empty text has no feature and gets the
    models' base rates.  A category without positive training rows is never
    flagged, and a level only where ``toxic`` is.  Repeated rows are scored each, alike.
    """
    fields = [T.StructField(f"p_{c}", T.DoubleType()) for c in chain.categories] + [T.StructField(f"is_{c}", T.BooleanType()) for c in chain.categories]

    def kernel():
        known: dict[str, tuple] = {}

        def compute(texts):
            if len(known) > 400_000:
                known.clear()
            p = chain.probabilities(chain.inputs(texts.to_pylist(), known))
            return [*(np.round(p[:, c], 6).tolist() for c in range(p.shape[1])), *(x.tolist() for x in chain.flags(p).T)]

        return compute

    return map_texts(docs, text, list(keep), fields, kernel)
