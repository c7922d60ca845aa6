"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of a text. Each is scaled by the log of how much more often toxic
texts hold it than others (Wang and Manning 2012), and a logistic regression is trained on the
scaled features. A score is the logistic function of a sum over the features of the whole text.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame

from parley.llm.common import remainder
from parley.llm.hashed import char_ngrams, fitted, labelled_sample, scored

ORDERS = (4, 6)
BITS = 20
#: Bound on the labelled texts that are learned from.
ROWS = 8000
SEED = 3
ROUNDS = 60
RATE = 0.1
PENALTY = 1e-3
#: N-grams with a smaller log-count ratio, either way, say too little to be weighed.
LEAST_RATIO = 2.0
#: An n-gram must be in this share of the number of toxic texts, within these bounds.
SHARE, FEWEST, MOST = 0.02, 3, 15
BY, HELD, THRESHOLD = 4, 2, 0.3


def fit(texts: list[str], labels: np.ndarray) -> bytes:
    """Weights for each hashed n-gram and a bias; with one class or no rows, the smoothed base rate."""
    weights = np.zeros(1 << BITS)
    rate = (labels.sum() + 0.5) / (len(labels) + 1.0)
    bias = float(np.log(rate / (1 - rate)))
    if len(set(labels.tolist())) < 2:
        return pickle.dumps((weights.astype(np.float32), bias))
    rows = [char_ngrams(t, ORDERS, BITS) for t in texts]
    norms = np.array([_norm(len(r)) for r in rows])
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    held = np.bincount(flat, minlength=1 << BITS)
    toxic = np.bincount(flat, weights=labels[owner], minlength=1 << BITS)
    ratio = np.log((1 + toxic) / (1 + labels.sum())) - np.log((1 + held - toxic) / (1 + (1 - labels).sum()))
    least = np.clip(SHARE * labels.sum(), FEWEST, MOST)
    ratio = np.where((held >= least) & (np.abs(ratio) > LEAST_RATIO), ratio, 0.0)
    told = ratio[flat] != 0
    flat, owner = flat[told], owner[told]
    scale = ratio[flat] / norms[owner]
    step, drift, spread = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(1 << BITS)
    for round_ in range(1, ROUNDS + 1):
        raw = bias + np.bincount(owner, weights=step[flat] * scale, minlength=len(rows))
        error = 1 / (1 + np.exp(-np.clip(raw, -50, 50))) - labels
        slope = np.bincount(flat, weights=error[owner] * scale, minlength=1 << BITS) + PENALTY * step
        slope /= len(rows)
        drift, spread = 0.9 * drift + 0.1 * slope, 0.999 * spread + 0.001 * slope**2
        step -= RATE * (drift / (1 - 0.9**round_)) / (np.sqrt(spread / (1 - 0.999**round_)) + 1e-8)
        bias -= RATE * error.mean()
    return pickle.dumps(((step * ratio).astype(np.float32), float(bias)))


def _norm(features: int) -> float:
    """Long texts hold more n-grams by chance; the fourth root keeps single telling ones audible."""
    return max(features, 1) ** 0.25


def score(model: bytes, texts: list[str]) -> np.ndarray:
    weights, bias = pickle.loads(model)
    raw = np.empty(len(texts))
    for i, text in enumerate(texts):
        features = char_ngrams(text, ORDERS, BITS)
        raw[i] = bias + float(weights[features].sum(dtype=np.float64)) / _norm(len(features))
    return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = ROWS) -> DataFrame:
    """(key, held_out, score, predicted) for every row of ``docs``.

    Learned from at most about ``rows`` labelled texts whose key is not held out. NULL and empty
    texts are scored like a text without known n-grams; a NULL key is not held out and never learned
    from; equal keys stay apart; without labels every score is one half. Other columns than key,
    text and, of ``labels``, key and ``toxic`` are not looked at.
    """
    sample = labelled_sample(docs, labels, "toxic", remainder(labels[key], BY) != HELD, rows, SEED, key, text)
    model = docs.sparkSession.sparkContext.broadcast(fitted(sample, fit))
    return scored(docs, model, score, BY, HELD, THRESHOLD, key, text)
