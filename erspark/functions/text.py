"""Text operators as Column builders; nothing leaves the JVM. Null texts and null attribute values count as empty."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from erspark.functions import patterns as P


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _united(low: Column, unicode: bool) -> Column:
    flag = (lambda p: p) if unicode else (lambda p: p.replace("(?U)", ""))
    out = low
    for pattern, unit in P.UNITS:
        out = F.regexp_replace(out, flag(pattern), unit)
    marked = F.lit(False)
    for mark in P.UNIT_MARKS:
        marked = marked | low.contains(mark)
    return F.when(marked & low.rlike(flag(r"(?U)\d")), out).otherwise(low)


def united(text: Column) -> Column:
    """Lower-case, units in one spelling. Texts of ASCII only take the faster ASCII classes, which agree with the Unicode ones on them, and texts
    that name no unit are left as they are."""
    ascii_only = lambda t: F.octet_length(t) == F.char_length(t)
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.when(ascii_only(low), _united(low, False)).otherwise(_united(low, True)))


def clean_text(text: Column) -> Column:
    """``united`` with other characters than a-z, 0-9, hyphen and space as spaces, single spaces."""
    return F.trim(F.regexp_replace(united(text), P.BETWEEN, " "))


def _kgrams(text: Column, k: int) -> Column:
    """By an array of characters, as finding the i-th character of a string takes time i."""

    def grams(chars: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(chars) - k), lambda i: F.concat(*[F.get(chars, i + n) for n in range(k)]))
        return F.when(F.size(chars) < k, F.array().cast("array<string>")).otherwise(F.array_distinct(every))

    return let(F.split(text, ""), grams)


def kgrams(text: Column, k: int) -> Column:
    """The distinct substrings of length k; none if the text is shorter. The text is bound, as it may be a long expression."""
    return let(text, lambda t: _kgrams(t, k))


def char_shingles(cleaned: Column, k: int) -> Column:
    """The k-grams of a cleaned text; a shorter text is its own only shingle."""
    return let(cleaned, lambda c: F.when(F.length(c) < k, F.array(c)).otherwise(_kgrams(c, k)))


def title_words(title: Column, lower: bool = True) -> Column:
    """Model words of a raw title, in order of first occurrence."""
    def found(text: Column) -> Column:
        return F.when(text.rlike(P.IN_TITLE_WORD), F.regexp_extract_all(text, F.lit(P.TITLE_WORD), F.lit(1))).otherwise(F.array().cast("array<string>"))

    words = let(F.coalesce(title, F.lit("")), found)
    return F.array_distinct(F.transform(words, F.lower) if lower else words)


def value_words(features: Column, lower: bool = True) -> Column:
    """Model words of attribute values, in attribute order."""
    found = F.flatten(F.transform(features, lambda f: F.regexp_extract_all(F.coalesce(f["value"], F.lit("")), F.lit(P.VALUE_WORD), F.lit(0))))
    return F.array_distinct(F.transform(found, F.lower) if lower else found)


def brand_words(features: Column) -> Column:
    """Lower-cased values of all attributes called brand, in any case."""
    own = F.filter(features, lambda f: F.lower(f["key"]) == "brand")
    return F.array_distinct(F.transform(own, lambda f: F.lower(F.coalesce(f["value"], F.lit("")))))


def model_words(title: Column, features: Column) -> Column:
    return F.array_union(F.array_union(title_words(title), value_words(features)), brand_words(features))


def weighted_words(words: Column, weight: int) -> Column:
    """Words as features. A word with letters and digits counts ``weight`` times (0: not at all), any other once."""
    mixed = lambda w: w.rlike(r"\p{IsAlphabetic}") & w.rlike(r"\p{Nd}")
    once = lambda w: F.array(F.concat(F.lit("MW_"), w, F.lit("_0")))
    if weight <= 0:
        return F.array_distinct(F.flatten(F.transform(F.filter(words, lambda w: ~mixed(w)), once)))
    times = F.sequence(F.lit(0), F.lit(weight - 1))
    many = lambda w: F.transform(times, lambda i: F.concat(F.lit("MW_"), w, F.lit("_"), i.cast("string")))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.when(mixed(w), many(w)).otherwise(once(w)))))


def whole_word(text: Column, word: Column) -> Column:
    return text.contains(word) & F.rlike(text, F.concat(F.lit(r"\b\Q"), word, F.lit(r"\E\b")))


def brand(title: Column, features: Column, brands: Sequence[str] = ()) -> Column:
    """The lower-cased value of Brand, else the longest (then first) of ``brands`` that is a whole word of the title, else na."""
    own = F.get(F.filter(features, lambda f: f["key"] == P.BRAND_KEY), F.lit(0))["value"]
    stated = F.lower(F.coalesce(own, F.lit(P.NO_BRAND)))
    known = sorted({b.lower() for b in brands}, key=lambda b: (-len(b), b))
    if not known:
        return stated
    low = F.lower(F.coalesce(title, F.lit("")))
    hit = F.get(F.filter(F.array(*[F.lit(b) for b in known]), lambda b: whole_word(low, b)), F.lit(0))
    return F.when(stated == P.NO_BRAND, F.coalesce(hit, stated)).otherwise(stated)


def resolution(features: Column) -> Column:
    """The first match in the values of attributes whose key holds "resolution", in attribute order; else NA."""
    own = F.filter(features, lambda f: F.lower(f["key"]).contains("resolution"))
    found = F.transform(own, lambda f: F.regexp_extract(F.coalesce(f["value"], F.lit("")), P.RESOLUTION, 0))
    return F.coalesce(F.get(F.filter(found, lambda m: m != ""), F.lit(0)), F.lit(P.NO_RESOLUTION))


def letters(word: Column) -> Column:
    return F.regexp_replace(word, "[0-9]", "")


def digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")
