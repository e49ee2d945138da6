"""Benchmark decontamination by a distributed positional inverted index.

Every window of ``WINDOW`` consecutive words of a benchmark item (an item of fewer words is one window) is looked up in
the documents. Pass 1 counts, over all documents, the terms that windows hold; windows with a term that never occurs
are settled there. The two rarest places of every other window name the index terms. Pass 2 stores the postings (document, position) of these
terms as a table, those of a rarest term with the words around them, and the number of words of each document. From there on only the
index is read. The lists of a window's rarest and second rarest place, each moved by its offset, are intersected by an equi-join on
(document, window, cell of positions): where both agree, the stored words settle the rest, so phrase matches are exact; where they
differ by up to ``SLOP`` positions, the window is a proximity match. The path is the same at every size.

Native: DataFrame functions only. Term and window tables are broadcast only where their measured size is below
``BROADCAST_BYTES``; above it the same joins shuffle. Second lists pass a bitmap of fixed size (``common.marked``) before the join.

Defined cases: null and empty texts have no words; items without words have no window; items with a null id mark hits
but aren't listed; repeated windows and items count once; rows with equal doc_id and text have equal results; extra columns
are ignored by ``contamination`` and kept by ``keep_clean``; empty tables work.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from erspark.llm.common import keyed, marked, once, told_of, unique_ids
from erspark.plans.lineage import cut, stored

WINDOW = 10
#: Positions by which the two rarest words of a window may be off in a proximity match.
SLOP = 5
BROADCAST_BYTES = 32 << 20
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text after A-Z is lower-cased; all-ASCII texts take the faster ``lower``."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))
    return F.array_remove(F.split(low, _BREAK), "")


def windows_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, window, n): the windows of every item, each as its words."""
    rows = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    last = F.greatest(F.size("words") - WINDOW, F.lit(0))
    rows = rows.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return rows.select("item_id", F.slice("words", F.col("at") + 1, WINDOW).alias("window")).distinct()


def _fits(df: DataFrame, text: Column) -> bool:
    """Whether the measured size of ``df`` allows a broadcast."""
    return (df.agg(F.sum(F.octet_length(text) + 64)).first()[0] or 0) <= BROADCAST_BYTES


def _sized(df: DataFrame, text: Column) -> DataFrame:
    """``df``, marked for broadcast only if its measured size allows it."""
    return F.broadcast(df) if _fits(df, text) else df


def rarest_places(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(wid, window, first_term, first_at, second_term, second_at) of the windows all of whose terms occur in ``docs``.
    Places are ordered by the number of postings of their term, then by offset."""
    own = cut(windows.select("window").distinct().withColumn("wid", F.monotonically_increasing_id()))
    terms = own.select("wid", F.posexplode("window").alias("at", "term"))
    vocabulary = cut(terms.select("term").distinct())
    found = docs.select(F.explode(words_of(F.col("text"))).alias("term")).join(_sized(vocabulary, F.col("term")), "term", "left_semi")
    counts = found.groupBy("term").count()
    places = terms.join(counts, "term", "left").groupBy("wid").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "at", "term"))).alias("places")
    )
    places = places.filter(F.col("places")[0]["n"] > 0)
    second = F.coalesce(F.get("places", F.lit(1)), F.get("places", F.lit(0)))
    places = places.select(
        "wid", F.col("places")[0]["term"].alias("first_term"), F.col("places")[0]["at"].alias("first_at"), second["term"].alias("second_term"), second["at"].alias("second_at")
    )
    return cut(places.join(own, "wid"))


def positional_index(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The postings of the terms that ``places`` names, as a stored table: (doc_id, told, term, at, context, context_from). Postings of a
    window's rarest term hold the words within WINDOW - 1 of them as context. The empty term stands once in each document, behind its last word."""
    named = places.select(F.col("first_term").alias("term"), F.lit(True).alias("leads")).union(places.select("second_term", F.lit(False)))
    ends = docs.sparkSession.createDataFrame([("", False)], "term string, leads boolean")
    named = cut(named.groupBy("term").agg(F.max("leads").alias("leads")).union(ends))
    rows = docs.select("doc_id", "told", words_of(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "told", "words", F.posexplode(F.array_append("words", F.lit(""))).alias("at", "term"))
    low = F.greatest(F.col("at") - (WINDOW - 1), F.lit(0))
    context = F.slice("words", low + 1, 2 * WINDOW - 1)
    if _fits(named, F.col("term")):
        rows = rows.join(F.broadcast(named), "term").withColumn("context", F.when(F.col("leads"), context))
    else:
        # no shuffled row may carry its whole text: those that may be named take their context first
        rows = marked(rows, named, ("term",))[0].select("doc_id", "told", "term", "at", context.alias("context")).join(named, "term")
        rows = rows.withColumn("context", F.when(F.col("leads"), F.col("context")))
    return stored(rows.select("doc_id", "told", "term", "at", "context", low.alias("context_from")), "positional-index")


def _moved(index: DataFrame, places: DataFrame, which: str) -> DataFrame:
    own = places.select("wid", F.col(f"{which}_term").alias("term"), F.col(f"{which}_at").alias("off"))
    return index.select("doc_id", "told", "term", "at").join(_sized(own, F.col("term")), "term").select("doc_id", "told", "wid", (F.col("at") - F.col("off")).alias("start"))


def _same(*names: str):
    """Equality of columns with those of the same names and a 2 behind; ids may be null."""
    out = F.lit(True)
    for name in names:
        out = out & (F.col(name).eqNullSafe(F.col(f"{name}2")) if name == "doc_id" else F.col(name) == F.col(f"{name}2"))
    return out


def intersected(index: DataFrame, places: DataFrame, slop: int) -> DataFrame:
    """(doc_id, told, wid, start, off): pairs of the moved lists of a window's two rarest places that differ by ``off``, at most ``slop``.
    Positions meet through neighbouring cells of width ``slop`` + 1, so no two lists are multiplied."""
    width = slop + 1
    near = (0,) if slop == 0 else (-1, 0, 1)
    first = _moved(index, places, "first").withColumn("cell", F.explode(F.array(*[F.floor(F.col("start") / width) + k for k in near])))
    second, _ = marked(_moved(index, places, "second").withColumn("cell", F.floor(F.col("start") / width)), first, ("doc_id", "told", "wid", "cell"))
    second = second.withColumnsRenamed({c: f"{c}2" for c in second.columns})
    off = F.abs(F.col("start") - F.col("start2"))
    return first.join(second, _same("doc_id", "told", "wid", "cell")).filter(off <= slop).select("doc_id", "told", "wid", "start", off.alias("off"))


def exact(index: DataFrame, places: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, told, window, start, n): the pairs without offset whose window the words around the rarest posting hold."""
    whole = _sized(places.select("wid", "window", "first_at"), F.concat_ws(" ", "window"))
    rows = pairs.filter("off = 0 AND start >= 0").select("doc_id", "told", "wid", "start").distinct().join(whole, "wid")
    rows = rows.withColumn("at", F.col("start") + F.col("first_at"))
    context = index.filter("context IS NOT NULL").select(F.col("doc_id").alias("doc_id2"), F.col("told").alias("told2"), F.col("at").alias("at2"), "context", "context_from")
    rows = rows.join(context, _same("doc_id", "told", "at")).filter(F.col("start") >= F.col("context_from"))
    held = F.slice("context", F.col("start") - F.col("context_from") + 1, F.size("window"))
    return rows.filter(held == F.col("window")).select("doc_id", "told", "window", "start", F.size("window").alias("n"))


def phrase_matches(docs: DataFrame, windows: DataFrame, unique: bool) -> DataFrame:
    """(doc_id, told, window, start, n): every occurrence of a window in a document, once; ``told`` as by ``common.told_of``."""
    rows = keyed(docs, unique)
    places = rarest_places(rows, windows)
    index = positional_index(once(rows, unique), places)
    return exact(index, places, intersected(index, places, 0))


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = SLOP) -> DataFrame:
    """(doc_id, item_id): documents where the two rarest words of a window stand as in the window, give or take ``slop`` positions."""
    windows, unique = cut(windows_of(items)), unique_ids(docs)
    rows = keyed(docs, unique)
    places = rarest_places(rows, windows)
    near = intersected(positional_index(once(rows, unique), places), places, slop)
    return near.select("doc_id", "wid").distinct().join(places.select("wid", "window"), "wid").join(windows, "window").select("doc_id", "item_id").distinct()


def contamination(docs: DataFrame, items: DataFrame, slop: int = SLOP) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit (words inside any occurrence), n_items, items_sha256, contaminated, and n_near
    (items with a proximity match, phrase matches included)."""
    windows = cut(windows_of(items))
    unique = unique_ids(docs)
    rows = keyed(docs, unique)
    places = rarest_places(rows, windows)
    index = positional_index(once(rows, unique), places)
    pairs = cut(intersected(index, places, slop))
    found = cut(exact(index, places, pairs))
    keys = ["doc_id", "told"]
    before = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.groupBy(*keys, "start").agg(F.max(F.col("start") + F.col("n")).alias("stop"))
    fresh = F.greatest(F.col("stop") - F.greatest(F.col("start"), F.coalesce(F.max("stop").over(before), F.lit(0))), F.lit(0))
    hits = spans.withColumn("fresh", fresh).groupBy(*keys).agg(F.sum("fresh").alias("n_hit"))
    named = found.select(*keys, "window").distinct().join(windows, "window").select(*keys, "item_id").distinct()
    named = named.groupBy(*keys).agg(F.count("item_id").alias("n_items"), F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("listed"))
    ids = places.select("wid", "window").join(windows, "window").select("wid", "item_id")
    near = pairs.select(*keys, "wid").distinct().join(ids, "wid").groupBy(*keys).agg(F.count_distinct("item_id").alias("n_near"))
    words = index.filter("term = ''").select(*keys, F.col("at").cast("long").alias("n_words"))
    out = rows.select(*keys)
    for k, part in enumerate((words, hits, named, near)):
        part = part.withColumnsRenamed({c: f"{c}_{k}" for c in keys})
        out = out.join(part, F.col("doc_id").eqNullSafe(F.col(f"doc_id_{k}")) & (F.col("told") == F.col(f"told_{k}")), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        "doc_id", count("n_words").alias("n_words"), count("n_hit").alias("n_hit"), count("n_items").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("listed", F.array().cast("array<string>"))).cast("binary"), 256).alias("items_sha256"), (count("n_hit") > 0).alias("contaminated"), count("n_near").alias("n_near"),
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window occurs."""
    unique = unique_ids(docs)
    bad = phrase_matches(docs, cut(windows_of(items)), unique).select(F.col("doc_id").alias("bad_id"), F.col("told").alias("bad_told")).distinct()
    bad = cut(bad)
    return docs.join(bad, docs.doc_id.eqNullSafe(bad.bad_id) & (told_of(unique) == bad.bad_told), "left_anti")
