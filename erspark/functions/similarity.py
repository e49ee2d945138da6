"""Similarity operators as Column builders, from leaf measures to the score of a product pair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from erspark.functions import patterns as P
from erspark.functions.text import digits, kgrams, let, letters
from erspark.plans.params import MatchParams


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != ""))


def share(part: Column, whole: Column) -> Column:
    """part / whole, and 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole)


def cosine_of_sets(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / (F.sqrt(F.size(a).cast("double")) * F.sqrt(F.size(b).cast("double"))))


def token_cosine(a: Column, b: Column) -> Column:
    return let(tokens(a), lambda x: let(tokens(b), lambda y: cosine_of_sets(x, y)))


def jaccard_of_sets(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of distinct values; 0 if both are empty."""
    return let(F.size(F.array_intersect(a, b)), lambda n: share(n, F.size(a) + F.size(b) - n))


def kgram_jaccard(a: Column, b: Column, k: int = P.KEY_GRAM) -> Column:
    return let(kgrams(a, k), lambda x: let(kgrams(b, k), lambda y: jaccard_of_sets(x, y)))


def norm_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; 0 for two empty texts."""
    return share(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b)))


def split_words(words: Column) -> Column:
    """Words with their letters and digits apart, made once per product."""
    return F.transform(words, lambda w: F.struct(w.alias("w"), letters(w).alias("a"), digits(w).alias("n")))


def word_pairs(a: Column, b: Column) -> Column:
    """All pairs of two arrays of split words, in nested-loop order, with their letter distance."""
    pair = lambda x, y: F.struct(x["w"].alias("x"), y["w"].alias("y"), norm_levenshtein(x["a"], y["a"]).alias("d"), (x["n"] == y["n"]).alias("same"))
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: pair(x, y))))


def weighted_of_pairs(pairs: Column, strict: bool) -> Column:
    used = F.filter(pairs, lambda p: (p["d"] > P.STRICT_DISTANCE) & p["same"]) if strict else pairs
    weight = lambda p: (F.length(p["x"]) + F.length(p["y"])).cast("double")
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
    add = lambda acc, p: F.struct((acc["s"] + (1.0 - norm_levenshtein(p["x"], p["y"])) * weight(p)).alias("s"), (acc["w"] + weight(p)).alias("w"))
    return F.aggregate(used, start, add, lambda acc: share(acc["s"], acc["w"]))


def weighted_word_similarity(a: Column, b: Column, strict: bool) -> Column:
    """Length-weighted mean of 1 - edit distance over all pairs of words; ``strict`` keeps pairs of equal digits and unlike letters."""
    return let(split_words(a), lambda x: let(split_words(b), lambda y: weighted_of_pairs(word_pairs(x, y), strict)))


def title_similarity(tokens1: Column, tokens2: Column, words1: Column, words2: Column, p: MatchParams) -> Column:
    """1 for titles that agree, -1 where model words disagree in digits, else a blend. The words are split words."""

    def verdict(cosine: Column, pairs: Column) -> Column:
        unlike = F.filter(pairs, lambda x: x["d"] > p.threshold)
        lenient = p.beta * cosine + (1 - p.beta) * weighted_of_pairs(pairs, False)
        blended = F.when(F.exists(unlike, lambda x: x["same"]), p.delta * weighted_of_pairs(pairs, True) + (1 - p.delta) * lenient).otherwise(lenient)
        return F.when(cosine > p.alpha, F.lit(1.0)).when(F.exists(unlike, lambda x: ~x["same"]), F.lit(-1.0)).otherwise(blended)

    return let(cosine_of_sets(tokens1, tokens2), lambda c: F.when(c > p.alpha, F.lit(1.0)).otherwise(let(word_pairs(words1, words2), lambda x: verdict(c, x))))


def key_value_match(features1: Column, features2: Column, gamma: float) -> Column:
    """Greedy matching of attributes: each of the first side, in order, takes the first unmatched one of the second side whose key is
    similar enough. A struct of sim, w, m, the matched keys and the attributes left over. Attributes carry kg, vg:
    the grams of key and value."""
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0.0).alias("sim"), F.lit(0.0).alias("w"), F.lit(0).alias("m"), none.alias("matched"), F.transform(features2, lambda f: f["key"]).alias("open"))

    def step(acc: Column, f: Column) -> Column:
        scored = F.transform(F.filter(features2, lambda g: F.array_contains(acc["open"], g["key"])), lambda g: F.struct(jaccard_of_sets(f["kg"], g["kg"]).alias("s"), g["key"].alias("key"), g["vg"].alias("vg")))
        hit = F.get(F.filter(scored, lambda s: s["s"] > gamma), F.lit(0))
        take = lambda h: F.when(h.isNull(), acc).otherwise(
            F.struct(
                (acc["sim"] + h["s"] * jaccard_of_sets(f["vg"], h["vg"])).alias("sim"),
                (acc["w"] + h["s"]).alias("w"),
                (acc["m"] + 1).alias("m"),
                F.array_append(acc["matched"], f["key"]).alias("matched"),
                F.array_remove(acc["open"], h["key"]).alias("open"),
            )
        )
        return let(hit, take)

    return F.aggregate(features1, start, step)


def word_overlap(features1: Column, matched: Column, features2: Column, left: Column) -> Column:
    """Jaccard index of the model words in the values of unmatched attributes. Attributes carry mw: the words of the value."""
    words1 = F.array_distinct(F.flatten(F.transform(F.filter(features1, lambda f: ~F.array_contains(matched, f["key"])), lambda f: f["mw"])))
    words2 = F.array_distinct(F.flatten(F.transform(F.filter(features2, lambda f: F.array_contains(left, f["key"])), lambda f: f["mw"])))
    return jaccard_of_sets(words1, words2)


def block_reason(shop1: Column, shop2: Column, brand1: Column, brand2: Column, res1: Column, res2: Column) -> Column:
    """shop, brand or resolution where a block check settles the pair at similarity 0; else null."""
    unlike = lambda a, b, none: (a != b) & (a != none) & (b != none)
    return F.when((shop1 == shop2) & (shop1 != ""), "shop").when(unlike(brand1, brand2, P.NO_BRAND), "brand").when(unlike(res1, res2, P.NO_RESOLUTION), "resolution")


def hybrid_similarity(n1: Column, n2: Column, match: Column, overlap: Column, title: Column, p: MatchParams) -> Column:
    """The weighted sum of attribute, word and title similarity."""
    least = F.greatest(F.lit(1), F.least(n1, n2))
    mean = share(match["sim"], match["w"])
    part = match["m"] / least
    plain = part * mean + (1 - part) * overlap
    first = (1 - p.mu) * part
    full = first * mean + (1 - p.mu - first) * overlap + p.mu * title
    return F.when(title == -1, plain).otherwise(full)
