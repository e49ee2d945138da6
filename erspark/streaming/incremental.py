"""Incremental matching: arriving products meet a stored band table. Stop shingles and coefficients must be frozen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erspark.functions import text as T
from erspark.operators import lsh, minhash
from erspark.plans.params import FeatureParams, LshParams


def band_table(products: DataFrame, stops: list[str], f: FeatureParams, p: LshParams, seed: int = 0) -> DataFrame:
    """(id, band, bucket) row by row, without a shuffle, so it serves streams and tables alike. ``stops`` is the frozen stop list."""
    cleaned = T.clean_text(F.col("title"))
    shingles = T.char_shingles(cleaned, f.shingle)
    if stops:
        shingles = F.when(F.length(cleaned) < f.shingle, shingles).otherwise(F.array_except(shingles, F.split(F.lit("|".join(stops)), r"\|")))
    features = F.array_union(shingles, T.weighted_words(T.model_words(F.col("title"), F.col("features")), f.weight))
    hashes = minhash.feature_hashes(features)
    return lsh.band_rows(products.select("id", minhash.native_signature(hashes, p.size, seed).alias("sig")), p)


def candidates_of_stream(arriving: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, other): a stream-static join of arriving bands with the stored ones, which holds no state of its own. A pair comes once for
    each band that it shares; the sink removes repeats."""
    known = stored.select("band", "bucket", F.col("id").alias("other"))
    return arriving.join(known, ["band", "bucket"]).filter("id != other").select("id", "other")
