"""Language identification by hierarchical discrimination.

First a linear machine per language family (one against the rest) picks the family; within it one-versus-one linear support
vector machines on the same features vote for the language. Features are hashed byte n-grams (1 to 3) of the lower-cased text, as
square roots of their shares, scaled to length 1.

The models learn from at most ``TRAIN_DOCS`` documents in all, dealt evenly over the languages (a bound that does not grow with
the corpus), or one of each language if there are more languages than that, whose crc32(doc_id) mod 5 is not 0. Neither lang, source nor
doc_id enters a prediction.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if there is nothing to learn from; with
one language, it is predicted always; every language with a document to learn from is learned, however many there are; a null doc_id is never
held out and never learned from; of rows with equal lang and doc_id the least text is learned; repeated rows give repeated rows; extra
columns are ignored.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from erspark.llm.common import drawn_by_hash
from erspark.llm.linear import sigmoid, svm
from erspark.plans.lineage import cut, small_batches

#: Families of ISO 639-1 codes; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"),
    "uralic": ("fi", "et", "hu"),
    "baltic": ("lt", "lv"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indo-aryan": ("hi", "bn", "mr", "ur", "ne", "gu", "pa"),
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
DIMS = 4096
TRAIN_DOCS = 4000
FOLDS = 5
_LETTER = re.compile(r"[^\W\d_]")
_SOME_LETTER = r"[\p{L}\p{Nl}\p{No}]"
_STEP = 1 << 20


def features(text: str) -> np.ndarray:
    data = np.frombuffer(text.lower().encode(), np.uint8)
    counts = np.zeros(DIMS, np.int64)
    for k in range(0, len(data), _STEP):
        a = data[k : k + _STEP + 2].astype(np.uint32)
        two = (a[:-1] << np.uint32(8)) | a[1:]
        three = (two[:-1] << np.uint32(8)) | a[2:]
        for n, gram in ((1, a[: _STEP]), (2, two[:_STEP]), (3, three[:_STEP])):
            h = (gram + np.uint32(n << 28)) * np.uint32(2654435761)
            counts += np.bincount(h >> np.uint32(20), minlength=DIMS)
    x = np.sqrt(counts / max(1, counts.sum()))
    return (x / max(1e-9, np.sqrt((x * x).sum()))).astype(np.float32)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _rows(batches):
    for batch in batches:
        lang, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keep = [i for i, t in enumerate(text) if t and _LETTER.search(t)]
        yield pa.RecordBatch.from_arrays([pa.array([lang[i] for i in keep], pa.string()), pa.array([features(text[i]).tobytes() for i in keep], pa.binary())], ["lang", "x"])


class Hierarchy:
    """Family machines and, by family, one-versus-one machines."""

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray):
        self.langs = langs
        self.family_of = [FAMILY.get(lang, f"={lang}") for lang in langs]
        self.families = sorted(set(self.family_of))
        own = np.array([self.families.index(f) for f in self.family_of], np.int64)
        fam = own[y] if len(y) else y
        weights = [svm(x, np.where(fam == k, 1.0, -1.0)) for k in range(len(self.families))] if len(self.families) > 1 else []
        self.pairs = [(a, b) for a, b in combinations(range(len(langs)), 2) if own[a] == own[b]]
        for a, b in self.pairs:
            some = (y == a) | (y == b)
            weights.append(svm(x[some], np.where(y[some] == a, 1.0, -1.0)))
        self.own = own
        self.weights = np.array(weights, np.float32).reshape(-1, DIMS + 1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language number and a score from 0 to 1 of each row."""
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        n = len(self.families) if len(self.families) > 1 else 0
        fam = margin[:, :n].argmax(axis=1) if n else np.zeros(len(x), np.int64)
        score = sigmoid(3 * margin[:, :n].max(axis=1)) if n else np.ones(len(x))
        votes = np.zeros((len(x), len(self.langs)))
        for k, (a, b) in enumerate(self.pairs):
            p = sigmoid(3 * margin[:, n + k])
            votes[:, a] += (p > 0.5) + 0.5 * p
            votes[:, b] += (p <= 0.5) + 0.5 * (1 - p)
        votes[self.own[None, :].repeat(len(x), 0) != fam[:, None]] = -1
        best = votes.argmax(axis=1)
        rivals = np.bincount(self.own)[fam] - 1
        sure = np.where(rivals > 0, votes[np.arange(len(x)), best] / np.maximum(1, 1.5 * rivals), 1.0)
        return best, np.clip(score * sure, 0, 1)


def fit(docs: DataFrame) -> Hierarchy | None:
    """Learn from the documents that aren't held out."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & F.col("text").rlike(_SOME_LETTER))
    sizes = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not sizes:
        return None
    each = max(1, TRAIN_DOCS // len(sizes))
    listed = usable.select("lang", "doc_id")
    chosen = drawn_by_hash(listed, "lang", {r.lang: r["count"] for r in sizes}, {r.lang: each for r in sizes})
    chosen = cut(chosen.select(F.col("lang").alias("chosen_lang"), F.col("doc_id").alias("chosen_id")).distinct())
    met = (F.col("doc_id") == F.col("chosen_id")) & (F.col("lang") == F.col("chosen_lang"))
    sample = usable.select("lang", "text", "doc_id").join(F.broadcast(chosen), met, "left_semi").groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    rows = sample.select("lang", "text").mapInArrow(_rows, "lang string, x binary").toPandas().sort_values(["lang", "x"])
    langs = sorted(set(rows.lang))
    if not langs:
        return None
    x = np.frombuffer(b"".join(rows.x), np.float32).reshape(-1, DIMS)
    return Hierarchy(langs, x, np.array([langs.index(v) for v in rows.lang], np.int64))


_PREDICTED = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def predictor(model: Hierarchy | None):
    @F.pandas_udf(_PREDICTED)
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model else []
        for k in range(0, len(known), 256):
            own = known[k : k + 256]
            best, score = model.predict(np.stack([features(texts.iloc[i]) for i in own]))
            scores[own] = score
            for i, b in zip(own, best, strict=True):
                langs[i] = model.langs[b]
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return predict


def identify_languages(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred and score."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "lang", "text")
    predict = predictor(fit(docs))
    return docs.select("doc_id", held_out().alias("held_out"), predict("text").alias("m")).select("doc_id", "held_out", "m.*")
