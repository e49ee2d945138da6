"""Toxicity by classifier chains.

Categories are predicted in a fixed order by linear models; each model sees the words of a text and the probabilities of the
categories before it. In training those probabilities are out-of-fold: a document's earlier probabilities come from models, and from a
choice of features, that never saw it, so later models meet them as they will be in use. Texts with equal words are in one fold.
The last link of the chain is the labelled verdict ``toxic``. The labels have no finer categories, so the earlier links learn those that the
labelled toxic documents form: ``N_CATEGORIES`` clusters of their telling features, whatever the language, the largest first.

Features are the presence of words and of word beginnings (4 and 5 letters, for languages that compound). Only features whose
share among positives clearly exceeds that among negatives are kept (at most ``MAX_FEATURES``). Training takes at most
``TRAIN_TOXIC`` toxic and ``TRAIN_CLEAN`` other documents, drawn by hash from those whose crc32(doc_id) mod 5 is not 0; the bounds don't grow with the
corpus. The threshold maximises F1 on out-of-fold probabilities.

Defined cases: null and empty texts have probability 0 and aren't toxic; without labels of both values nothing is toxic; null labels
and null ids are ignored; a document labelled both ways counts as toxic; of rows with an equal doc_id the least text is learned; repeated
rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from erspark.llm.common import drawn_by_hash
from erspark.llm.langid import held_out
from erspark.llm.linear import logistic, sigmoid
from erspark.plans.lineage import cut, small_batches

#: Categories that the labelled toxic documents are parted into.
N_CATEGORIES = 3
CHAIN = (*(f"category_{k + 1}" for k in range(N_CATEGORIES)), "toxic")
TRAIN_TOXIC = 2000
TRAIN_CLEAN = 4000
MAX_FEATURES = 1024
FOLDS = 5
_WORD = re.compile(r"[^\W_]+")
_CACHE = 1 << 20


def _marks(word: str) -> list[int]:
    out = [zlib.crc32(word.encode())]
    if len(word) > 4:
        out.append(zlib.crc32(b"4" + word[:4].encode()))
    if len(word) > 5:
        out.append(zlib.crc32(b"5" + word[:5].encode()))
    return out


def marks(text: str) -> np.ndarray:
    """The distinct feature hashes of a text."""
    return np.unique(np.array([m for w in set(_WORD.findall(text.lower())) for m in _marks(w)], np.uint32))


def _rows(batches):
    for batch in batches:
        x = pa.array([marks(t or "").tobytes() for t in batch.column(1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), x], ["toxic", "x"])


def matrix(rows: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    """Presence of the ``chosen`` features (sorted hashes), a row per text."""
    x = np.zeros((len(rows), len(chosen)), np.float32)
    if len(chosen):
        flat = np.concatenate(rows)
        at = np.minimum(np.searchsorted(chosen, flat), len(chosen) - 1)
        hit = chosen[at] == flat
        x[np.repeat(np.arange(len(rows)), [len(r) for r in rows])[hit], at[hit]] = 1
    return x


def categories(x: np.ndarray, count: int = N_CATEGORIES, rounds: int = 15, tries: int = 8) -> np.ndarray:
    """A category of each row: spherical k-means, the best of several fixed starts, the largest cluster first."""
    x = x * np.log((len(x) + 1) / (x.sum(axis=0) + 1))
    x = x / np.maximum(1e-9, np.sqrt((x * x).sum(axis=1, keepdims=True)))
    best, most = np.zeros(len(x), np.int64), -1.0
    for seed in range(tries):
        centres = x[np.random.default_rng(seed).choice(len(x), min(count, len(x)), replace=False)]
        for _ in range(rounds):
            own = (x @ centres.T).argmax(axis=1)
            sums = np.stack([x[own == k].sum(axis=0) for k in range(len(centres))])
            centres = sums / np.maximum(1e-9, np.sqrt((sums * sums).sum(axis=1, keepdims=True)))
        near = x @ centres.T
        if near.max(axis=1).sum() > most + 1e-6:
            best, most = near.argmax(axis=1), float(near.max(axis=1).sum())
    order = np.argsort(-np.bincount(best, minlength=count), kind="stable")
    return np.argsort(order, kind="stable")[best]


class Chain:
    """Feature hashes, the weights of each link, and the verdict's threshold."""

    def __init__(self, rows: list[np.ndarray], toxic: np.ndarray):
        chosen = self._select(rows, toxic)
        self.index = {int(h): k for k, h in enumerate(chosen)}
        x = matrix(rows, chosen)
        own = np.full(len(rows), -1)
        own[toxic > 0] = categories(x[toxic > 0]) if len(chosen) else 0
        fold = np.array([zlib.crc32(r.tobytes()) % FOLDS for r in rows])
        folds = [(fold == f, matrix(rows, self._select([r for r, out in zip(rows, fold == f, strict=True) if not out], toxic[fold != f]))) for f in range(FOLDS) if (fold == f).any() and (fold != f).any()]
        earlier = np.empty((len(rows), 0), np.float32)
        self.weights: list[np.ndarray] = []
        for k, name in enumerate(CHAIN):
            y = toxic if name == "toxic" else (own == k).astype(np.float64)
            self.weights.append(logistic(np.hstack([x, earlier]), y))
            outside = np.zeros(len(rows))
            for held, part in folds:
                seen = np.hstack([part, earlier])
                outside[held] = sigmoid(self._margin(seen[held], logistic(seen[~held], y[~held])))
            earlier = np.hstack([earlier, outside[:, None].astype(np.float32)])
        self.threshold = self._threshold(earlier[:, -1], toxic)

    @staticmethod
    def _select(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
        if not (toxic > 0).any():
            return np.empty(0, np.uint32)
        flat = np.concatenate(rows)
        positive = np.repeat(toxic > 0, [len(r) for r in rows])
        known, where = np.unique(flat, return_inverse=True)
        p = np.bincount(where, positive, len(known))
        n = np.bincount(where, ~positive, len(known))
        a, b = max(1, (toxic > 0).sum()), max(1, (toxic <= 0).sum())
        odds = np.log((p + 0.5) / (a - p + 0.5)) - np.log((n + 0.5) / (b - n + 0.5))
        z = odds / np.sqrt(1 / (p + 0.5) + 1 / (n + 0.5) + 1 / (a - p + 0.5) + 1 / (b - n + 0.5))
        good = np.flatnonzero((p >= 3) & (z > 2.5) & (odds > 1.5))
        return np.sort(known[good[np.argsort(-z[good], kind="stable")[:MAX_FEATURES]]])

    @staticmethod
    def _margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return x @ w[:-1] + w[-1]

    @staticmethod
    def _threshold(p: np.ndarray, y: np.ndarray) -> float:
        cuts = np.linspace(0.1, 0.9, 33)
        f1 = [2 * ((p > c) & (y > 0)).sum() / max(1, (p > c).sum() + (y > 0).sum()) for c in cuts]
        best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
        return float(cuts[best[len(best) // 2]])

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the chain's links, one column each."""
        first = x.shape[1]
        for w in self.weights:
            x = np.hstack([x, sigmoid(self._margin(x, w))[:, None]])
        return x[:, first:]


def fit(docs: DataFrame, labels: DataFrame) -> Chain | None:
    told = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out())
    told = cut(told.filter("toxic IN (0, 1)"))
    sizes = {r.toxic: r["count"] for r in told.groupBy("toxic").count().collect()}
    chosen = drawn_by_hash(told, "toxic", sizes, {0: TRAIN_CLEAN, 1: TRAIN_TOXIC})
    chosen = cut(chosen.select(F.col("doc_id").alias("chosen_id"), "toxic"))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id"))
    sample = sample.groupBy("chosen_id").agg(F.max("toxic").cast("long").alias("toxic"), F.min("text").alias("text")).select("toxic", "text")
    rows = sample.mapInArrow(_rows, "toxic long, x binary").toPandas().sort_values(["toxic", "x"])
    toxic = rows.toxic.to_numpy(np.float64)
    if not (toxic > 0).any() or not (toxic <= 0).any():
        return None
    return Chain([np.frombuffer(b, np.uint32) for b in rows.x], toxic)


_SCORES = StructType([*(StructField(f"p_{c}", DoubleType()) for c in CHAIN), StructField("toxic", BooleanType())])


def predictor(model: Chain | None):
    @F.pandas_udf(_SCORES)
    def predict(texts: pd.Series) -> pd.DataFrame:
        p = np.zeros((len(texts), len(CHAIN)))
        if model and len(texts):
            cache: dict[str, list[int]] = {}
            known = [i for i, t in enumerate(texts) if t]
            for k in range(0, len(known), 256):
                own = known[k : k + 256]
                x = np.zeros((len(own), len(model.index)))
                for row, i in enumerate(own):
                    for w in set(_WORD.findall(texts.iloc[i].lower())):
                        hit = cache.get(w)
                        if hit is None:
                            if len(cache) >= _CACHE:
                                cache.clear()
                            hit = cache[w] = [model.index[m] for m in _marks(w) if m in model.index]
                        if hit:
                            x[row, hit] = 1
                p[own] = model.predict(x)
        out = pd.DataFrame(p, columns=_SCORES.names[:-1])
        out["toxic"] = p[:, -1] > (model.threshold if model else 1)
        return out

    return predict


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, the probability of each category, and the verdict toxic."""
    small_batches(docs.sparkSession)
    predict = predictor(fit(docs, labels))
    return docs.select("doc_id", held_out().alias("held_out"), predict("text").alias("m")).select("doc_id", "held_out", "m.*")
