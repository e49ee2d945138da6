"""Hyper-parameter search with a resumable trial table."""

from __future__ import annotations

import json
import random
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erspark.operators import clustering, lsh, matching, metrics, minhash, sampling
from erspark.operators.features import hybrid_features
from erspark.plans.lineage import cut
from erspark.plans.params import FeatureParams, LshParams, MatchParams

# Fixed values: (low, high) of each parameter; integers are drawn as integers.
SPACE = {
    "shingle_size": (2, 8), "mw_weight": (1, 16), "stop_shingle_freq": (0.0, 0.1), "gamma": (0.5, 0.95), "epsilon": (0.1, 0.9), "mu": (0.1, 0.9),
    "alpha": (0.1, 0.9), "beta": (0.1, 0.9), "delta": (0.1, 0.9), "threshold": (0.1, 0.9),
}
SCHEMA = "number long, value double, params string"


class MatchingObjective:
    """Mean F1 of bootstraps; features are kept by feature setting."""

    def __init__(self, products: DataFrame, target: int = 200, bootstraps: int = 5, draw: str = "hashed"):
        self.products = cut(products)
        self.target, self.seeds = target, range(bootstraps)
        self.oob = cut(sampling.drawn(self.products, self.seeds, draw))
        self.pairs = lsh.tuning_lsh_params(target)
        self.kept: dict[FeatureParams, DataFrame] = {}

    def features(self, f: FeatureParams) -> DataFrame:
        if f not in self.kept:
            self.kept[f] = cut(hybrid_features(self.products, f))
        return self.kept[f]

    def __call__(self, x: dict) -> float:
        f = FeatureParams(x["shingle_size"], x["mw_weight"], x["stop_shingle_freq"])
        m = MatchParams(x["gamma"], x["epsilon"], x["mu"], x["alpha"], x["beta"], x["delta"], x["threshold"])
        scores = [self.bootstrap(self.features(f), self.pairs[x["lsh_pair_index"]], m, seed) for seed in self.seeds]
        return sum(scores) / len(scores)

    def bootstrap(self, features: DataFrame, p: LshParams, m: MatchParams, seed: int) -> float:
        ids = cut(self.oob.filter(F.col("seed") == seed).select("id"))
        if ids.count() < 2:
            return 0.0
        own = self.products.join(ids, "id", "left_semi")
        pairs = cut(lsh.candidate_pairs(cut(minhash.signatures(features.join(ids, "id", "left_semi"), p.size, seed)), p))
        found = clustering.clusters(matching.pair_similarity(pairs, own, m), m.epsilon)
        row = metrics.metrics(metrics.class_counts(pairs, found, own), ids.select(F.count("*")).first()[0] * F.lit(1)).first()
        return float(row.f1)


def suggest(draw: random.Random, trials: list[tuple[float, dict]], n_pairs: int, warm_up: int = 10) -> dict:
    """The next point: uniform at first, later around one of the best quarter of the trials or, one time in five, uniform again."""
    uniform = {k: draw.randint(a, b) if isinstance(a, int) else draw.uniform(a, b) for k, (a, b) in SPACE.items()} | {"lsh_pair_index": draw.randrange(n_pairs)}
    if len(trials) < warm_up or draw.random() < 0.2:
        return uniform
    good = sorted(trials, key=lambda t: -t[0])[: max(2, len(trials) // 4)]
    centre, out = draw.choice(good)[1], dict(uniform)
    for k, (a, b) in SPACE.items():
        near = min(b, max(a, draw.gauss(centre[k], (b - a) / 8)))
        out[k] = round(near) if isinstance(a, int) else near
    if draw.random() < 0.7:
        out["lsh_pair_index"] = centre["lsh_pair_index"]
    return out


def optimise(spark: SparkSession, objective: Callable[[dict], float], path: str, n_trials: int, n_pairs: int, seed: int = 0) -> DataFrame:
    """Run ``n_trials`` more trials and append each to the Parquet trial table at ``path``; an existing table is continued. The
    trials, best first."""
    known = read_trials(spark, path)
    trials = [(r.value, json.loads(r.params)) for r in known.orderBy("number").collect()]
    for number in range(len(trials), len(trials) + n_trials):
        x = suggest(random.Random(seed * 1_000_003 + number), trials, n_pairs)
        trials.append((objective(x), x))
        spark.createDataFrame([(number, trials[-1][0], json.dumps(x, sort_keys=True))], SCHEMA).write.mode("append").parquet(path)
    return read_trials(spark, path).orderBy(F.desc("value"), "number")


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)
