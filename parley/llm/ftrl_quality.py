"""Quality by logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

One pass per epoch over the labelled texts, each text an update (McMahan et al. 2013). The L1 part
keeps most weights at zero, so a model is a short list of hashes and weights, and a score is a
sparse dot product over the features of the whole text.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame

from parley.llm.common import remainder
from parley.llm.hashed import fitted, labelled_sample, scored, word_ngrams

ORDERS = (1, 2)
BITS = 20
#: Bound on the labelled texts that are learned from.
ROWS = 8000
SEED = 5
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.05, 0.1
BY, HELD, THRESHOLD = 3, 1, 0.5


def fit(texts: list[str], labels: np.ndarray) -> bytes:
    """Sparse weights and a bias; with one class or no rows, the smoothed base rate."""
    rate = (labels.sum() + 0.5) / (len(labels) + 1.0)
    bias = float(np.log(rate / (1 - rate)))
    if len(set(labels.tolist())) < 2:
        return pickle.dumps((np.zeros(1 << BITS, dtype=np.float32), bias))
    rows = [word_ngrams(t, ORDERS, BITS) for t in texts]
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    order = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            at = rows[k]
            if not len(at):
                continue
            x = 1 / _norm(len(at))
            weight = _weights(z[at], n[at])
            error = 1 / (1 + np.exp(-np.clip(bias + weight.sum() * x, -35, 35))) - labels[k]
            slope = error * x
            sigma = (np.sqrt(n[at] + slope**2) - np.sqrt(n[at])) / ALPHA
            z[at] += slope - sigma * weight
            n[at] += slope**2
            bias -= 0.02 * error
    return pickle.dumps((_weights(z, n).astype(np.float32), float(bias)))


def _norm(features: int) -> float:
    return max(features, 1) ** 0.25


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    shrunk = np.sign(z) * L1 - z
    return np.where(np.abs(z) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2))


def score(model: bytes, texts: list[str]) -> np.ndarray:
    weights, bias = pickle.loads(model)
    raw = np.empty(len(texts))
    for i, text in enumerate(texts):
        at = word_ngrams(text, ORDERS, BITS)
        raw[i] = bias + float(weights[at].sum(dtype=np.float64)) / _norm(len(at))
    return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = ROWS) -> DataFrame:
    """(key, held_out, score, predicted) for every row of ``docs``.

    Learned from at most about ``rows`` labelled texts whose key is not held out. NULL and empty
    texts are scored like a text without known n-grams; a NULL key is not held out and never learned
    from; equal keys stay apart; without labels every score is one half. Other columns than key,
    text and, of ``labels``, key and ``quality`` are not looked at.
    """
    sample = labelled_sample(docs, labels, "quality", remainder(labels[key], BY) != HELD, rows, SEED, key, text)
    model = docs.sparkSession.sparkContext.broadcast(fitted(sample, fit))
    return scored(docs, model, score, BY, HELD, THRESHOLD, key, text)
