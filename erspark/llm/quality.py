"""Quality rules with risk-controlled thresholds.

Every text gets six ratios (``METRICS``), each of which grows with junk. Labelled good documents are the holdout: per
stratum (language) and ratio the cutoffs of a fixed grid are tested from lax to strict. A cutoff passes while the
exact binomial (Clopper-Pearson) upper bound of the share of good documents that it rejects stays within the ratio's
part of ``MAX_FALSE``. The tests of one ratio run in a fixed order and stop at the first failure, so they need no
correction among themselves; of the certified cutoffs the laxest is taken that rejects as many labelled bad documents as the strictest
(a rule that catches none isn't armed). ``DELTA`` is divided by the number of strata times ratios (Bonferroni).

What is guaranteed: with probability 1 - ``DELTA``, in all strata at once, the armed rules reject at most ``MAX_FALSE`` of the distinct
good texts that pass the base rules, if labelled texts are drawn like the others. Copies of a text in a stratum count once, as they are no
independent trials. The base rules are no part of it: what they reject is fixed, whatever the labels say. A stratum with too few labels arms
no rule. Every stratum has thresholds of its own, however many there are; they are a table that rows meet by a join.

Base rules need no labels: fewer than ``MIN_WORDS`` words, or over ``MAX_REPEAT`` % of words in repeated windows.

Defined cases: null and empty texts have no words and fail the base rules; a null stratum value is a stratum of its
own; labels that are null are ignored and a document with labels 0 and 1 counts as good, as does a text whose copies have both; repeated rows
give repeated rows; extra columns are ignored by ``quality_report`` and kept by ``keep_good``; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from erspark.llm.common import marked
from erspark.plans.lineage import cut, small_batches

MIN_WORDS = 10
MAX_REPEAT = 20
WINDOW = 5
MAX_FALSE = 0.03
DELTA = 0.05
#: Tables of thresholds up to this size are broadcast.
BROADCAST_BYTES = 32 << 20
METRICS = ("repeat_share", "dup_line_share", "symbol_share", "caps_share", "stutter_share", "bang_share")
#: Steps from 1 (strictest) to GRID (laxest); step k stands for the cutoff k / GRID.
GRID = 50

_SYMBOL = re.compile(r"[#*$%&|<>]")
_BANG = re.compile(r"[!?]")
_SPACES = {c: " " for c in range(9, 14)}

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = StructType([StructField(c, LongType()) for c in COUNTS] + [StructField(m, DoubleType()) for m in METRICS])


def _windows(words: list[bytes]) -> np.ndarray:
    """A number for each window of WINDOW words, equal exactly where the words are."""
    known: dict[bytes, int] = {}
    one = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    _, two = np.unique(one[:-1] * len(known) + one[1:], return_inverse=True)
    _, four = np.unique(two[:-2] * (two.max() + 1) + two[2:], return_inverse=True)
    return four[:-1] * len(known) + one[4:]


def repeat_words(words: list[bytes]) -> int:
    """Words inside any WINDOW-word window that is found twice or more in the text."""
    if len(words) <= WINDOW:
        return 0
    windows = _windows(words)
    _, where, count = np.unique(windows, return_inverse=True, return_counts=True)
    again = count[where] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple:
    """The row of MEASURES for one text."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    chars = sum(map(len, words))
    if len(text) != len(data):
        chars = len(b"".join(words).decode())
    symbols = len(_SYMBOL.findall(text))
    lines = [x for x in data.split(b"\n") if x.split()]
    dups = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    caps = sum(map(bytes.isupper, words)) if len(text) == len(data) else sum(map(str.isupper, text.translate(_SPACES).split(" ")))
    stutters = sum(a == b for a, b in pairwise(words))
    return (
        n, chars, symbols, dups, repeats,
        repeats / n if n else 0.0, dups / len(lines) if lines else 0.0, min(1.0, symbols / n) if n else 0.0,
        min(1.0, caps / n) if n else 0.0, stutters / n if n else 0.0, min(1.0, len(_BANG.findall(text)) / n) if n else 0.0,
    )


@F.pandas_udf(MEASURES)
def measure_udf(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=[*COUNTS, *METRICS])


# as it is costly, no filter may be pushed below it: that would run it twice
measure_udf = measure_udf.asNondeterministic()


def base_failed(m: str = "m") -> Column:
    return (F.col(f"{m}.n_words") < MIN_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > MAX_REPEAT * F.col(f"{m}.n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), exact up to rounding."""
    if k >= n:
        return 1.0
    if p <= 0 or p >= 1:
        return float(p <= 0)
    total, log_p, log_q = 0.0, math.log(p), math.log1p(-p)
    for i in range(k, -1, -1):
        term = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q)
        total += term
        if i < n * p and term < total * 1e-17:
            break
    return min(1.0, total)


def upper_bound_holds(k: int, n: int, share: float, delta: float) -> bool:
    """Whether the exact upper confidence bound (level 1 - delta) of k among n is at most ``share``: so it is if and
    only if k or fewer would be seen with probability delta at most, were the true share ``share``."""
    return n > 0 and binomial_cdf(k, n, share) <= delta


def choose_steps(good: dict[tuple, dict[int, int]], bad: dict[tuple, dict[int, int]], totals: dict, max_false: float, delta: float, strata: int | None = None) -> dict[tuple, int]:
    """A certified step by (stratum, metric): the laxest that rejects as many labelled bad documents as the strictest certified one.
    All certified steps hold at once, so the choice among them may look at the labels. ``good`` and ``bad``: documents by step of
    their ratio, step k being the laxest cutoff k / GRID that they exceed; ``totals``: good documents by stratum, of ``strata`` in all
    (None: these)."""
    chosen = {}
    each, level = max_false / len(METRICS), delta / max(1, (strata or len(totals)) * len(METRICS))
    for stratum, n in totals.items():
        for metric in METRICS:
            rejected, caught, most, best = 0, 0, 0, None
            for step in range(GRID - 1, 0, -1):
                rejected += good.get((stratum, metric), {}).get(step, 0)
                if not upper_bound_holds(rejected, n, each, level):
                    break
                caught += bad.get((stratum, metric), {}).get(step, 0)
                if caught > most:
                    most, best = caught, step
            if best is not None:
                chosen[stratum, metric] = best
    return chosen


def _step(metric: str) -> Column:
    """The largest k with ratio > k / GRID, or -1."""
    return (F.ceil(F.col(f"m.{metric}") * GRID) - 1).cast("int")


_CUTS = ", ".join(f"cut_{m} double" for m in METRICS)


def _chooser(max_false: float, delta: float, strata: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts: dict[int, dict[tuple, dict[int, int]]] = {0: {}, 1: {}}
        for quality, metric, step, n in rows[["quality", "metric", "step", "n"]].itertuples(index=False):
            counts[quality].setdefault((0, metric), {})[step] = n
        n = int(rows.n[(rows.quality == 1) & (rows.metric == METRICS[0])].sum())
        chosen = choose_steps(counts[1], counts[0], {0: n} if n else {}, max_false, delta, strata)
        return pd.DataFrame([[key[0], *(chosen[0, m] / GRID if (0, m) in chosen else None for m in METRICS)]], columns=["own_stratum", *(f"cut_{m}" for m in METRICS)])

    return run


def certified_cutoffs(measured: DataFrame, labels: DataFrame, max_false: float = MAX_FALSE, delta: float = DELTA) -> DataFrame:
    """(own_stratum, cut_<ratio> ...): the certified cutoffs, null where none is armed. ``measured`` has doc_id, stratum, copy (a hash of
    the text) and m. A stratum's counts by ratio and step, 600 rows at most, meet in one task; the driver sees one number."""
    told = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    steps = F.array(*[F.struct(F.lit(m).alias("metric"), _step(m).alias("step")) for m in METRICS])
    held = measured.filter(~base_failed()).select("doc_id", "stratum", "copy", steps.alias("steps")).join(told, "doc_id")
    held = held.groupBy("stratum", "copy").agg(F.max("quality").alias("quality"), F.first("steps").alias("steps"))
    counts = cut(held.select("stratum", "quality", F.explode("steps").alias("s")).groupBy("stratum", "quality", "s.metric", "s.step").agg(F.count("*").alias("n")))
    strata = counts.filter("quality = 1").select("stratum").distinct().count()
    kind = dict(measured.dtypes)["stratum"]
    return cut(counts.groupBy("stratum").applyInPandas(_chooser(max_false, delta, strata), f"own_stratum {kind}, {_CUTS}"))


def judged(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``rows`` (stratum, m, ...) with ``kept``: whether no base rule and no armed rule rejects."""
    size = cutoffs.agg(F.sum(F.octet_length(F.coalesce("own_stratum", F.lit(""))) + 64)).first()[0] or 0
    met = rows.join(F.broadcast(cutoffs) if size <= BROADCAST_BYTES else cutoffs, F.col("stratum").eqNullSafe(F.col("own_stratum")), "left")
    passes = ~base_failed()
    for metric in METRICS:
        passes = passes & F.coalesce(F.col(f"m.{metric}") <= F.col(f"cut_{metric}"), F.lit(True))
    return met.withColumn("kept", passes)


def _measured(docs: DataFrame, stratum: str) -> DataFrame:
    return docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), F.xxhash64("text").alias("copy"), measure_udf("text").alias("m"))


def quality_report(docs: DataFrame, labels: DataFrame, stratum: str = "lang", max_false: float = MAX_FALSE, delta: float = DELTA) -> DataFrame:
    """Per row of ``docs``: doc_id, the measures, base_failed and kept."""
    small_batches(docs.sparkSession)
    rows = cut(_measured(docs, stratum))
    return judged(rows, certified_cutoffs(rows, labels, max_false, delta)).select("doc_id", "m.*", base_failed().alias("base_failed"), "kept")


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", max_false: float = MAX_FALSE, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs``, all columns, that pass base rules and certified thresholds. A first pass measures the labelled documents, found by
    a bitmap of fixed size, a second one all, so no text is ever shuffled."""
    small_batches(docs.sparkSession)
    own = docs.select("doc_id", F.col(stratum).alias("stratum"), "text")
    labelled, _ = marked(own, labels.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).filter("doc_id IS NOT NULL"), ("doc_id",))
    cutoffs = certified_cutoffs(_measured(labelled, "stratum"), labels, max_false, delta)
    rows = docs.select(F.struct("*").alias("row"), F.col(stratum).cast("string").alias("stratum"), measure_udf("text").alias("m"))
    return judged(rows, cutoffs).filter("kept").select("row.*")
