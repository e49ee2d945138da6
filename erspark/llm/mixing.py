"""Mixing sources to target weights by blocks.

The words of each source, its documents in a fixed pseudorandom order, form one stream that is packed into blocks of
``block`` words. Sources share the words of the mix by weight (1, 2, 3, repeating, in code-point order, null last); a
target stops at ``REPEATS`` times its source, and what it leaves is shared by weight among the others. A source's slots
take its blocks through a pseudorandom permutation of the block indices, which each pass enters at another place, and
the last slot takes only the words that the target still lacks. Output shards have equal numbers of slots. Each shard draws how many
of them every source fills (``shard_counts``): a multinomial draw, conditioned on the totals that the targets fix, so that sources meet their
targets to a word. A source's slots are dealt to the shards by these counts, and slots and blocks are joined by index.

Permutations are swap-or-not networks: each round is an involution on 0..n-1, so any n gives a bijection that needs
no state and no sort. Native: DataFrame functions only.

Defined cases: null text has no words; documents without words take nothing; a null source is a source; rows with
null or repeated ids are kept apart; equal rows are interchangeable; extra columns are ignored by ``mixed_documents`` and kept by
``mixed_texts`` (those of a map type don't tell rows apart); an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from erspark.plans.lineage import cut

BLOCK = 256
REPEATS = 3
ROUNDS = 12
WORD = r"[^\x20\x09-\x0D]+"
_P = 2147483647
_CHUNK = 4_000
_SPAN = 1 << 14
N_SHARDS = 64


def _mix(x: Column) -> Column:
    """A number below 2^31 that depends on the non-negative ``x`` in no simple way."""
    y = (x % _P * 48271 + 11) % _P
    y = y.bitwiseXOR(F.shiftright(y, 15))
    y = (y * 69621 + 7) % _P
    return y.bitwiseXOR(F.shiftright(y, 13))


def rounds_of(n: Column, key: Column) -> Column:
    """The rounds of a keyed permutation of 0..n-1: an array of (pivot, a, b), to be made once per key."""

    def one(i: Column) -> Column:
        first, second, third = (_mix(key + i * 3 + k) for k in range(3))
        return F.struct(((first * 1000003 + second) % n).alias("pivot"), (third % (_P - 1) + 1).alias("a"), first.alias("b"))

    return F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda i: one(i.cast("long")))


def permuted(x: Column, n: Column, rounds: Column) -> Column:
    """The image of ``x`` under the permutation of 0..n-1 that ``rounds`` describe."""

    def turn(at: Column, r: Column) -> Column:
        other = (r["pivot"] - at + n) % n
        high = F.greatest(at, other)
        told = ((high % _P + F.shiftright(high, 31) * 7919) % _P * r["a"] + r["b"]) % _P
        return F.when(F.shiftright(told, 9).bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(rounds, x.cast("long"), turn)


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed, which keeps apart rows that differ in any."""
    names = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*[F.col(f"`{n}`") for n in names], *[F.col(f"`{n}`").isNull() for n in names])


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a pseudorandom order key of 60 bits, with a row id (``rid``) of its own for each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    order = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary"))).cast("binary"))
    rows = docs.select("doc_id", "source", row_key(docs).alias("told"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.conv(F.substring(order, 1, 15), 16, 10).cast("long").alias("order_key"))
    return cut(rows.withColumn("rid", F.monotonically_increasing_id()))


def targets(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per source: source_no (from 1, in code-point order), source_size, target, and what the slots need."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")
    sizes = sizes.withColumn("source_no", number).withColumn("weight", (F.col("source_no") - 1) % 3 + 1).withColumn("room", REPEATS * F.col("source_size"))
    every, ordered = Window.partitionBy(), Window.orderBy(F.col("room") / F.col("weight"), "source_no")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("room").over(before), F.lit(0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = sizes.withColumn("level", left.cast("double") / rest)
    level = level.withColumn("free", F.col("room") > F.col("level") * F.col("weight"))
    level = level.withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("room") / F.col("weight"), "source_no", "level"))).over(every)["level"])
    target = F.when(F.col("free"), F.least(F.col("level") * F.col("weight"), F.col("room").cast("double"))).otherwise(F.col("room").cast("double"))
    named = F.md5(F.coalesce(F.col("source"), F.lit("\0")).cast("binary"))
    out = level.select("source", "source_no", "source_size", target.alias("target"), F.conv(F.substring(named, 1, 7), 16, 10).cast("long").alias("key"))
    out = out.withColumn("wanted", F.least(F.floor(F.col("target") + 0.5), REPEATS * F.col("source_size")))
    out = out.withColumn("n_blocks", F.ceil(F.col("source_size") / block))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("wanted") / F.col("source_size"))).otherwise(0)
    out = out.withColumn("passes", full).withColumn("lack", F.col("wanted") - F.col("passes") * F.col("source_size"))
    last = F.when(F.col("lack") > 0, F.least(F.col("n_blocks"), F.ceil(F.col("lack") / block) + 1)).otherwise(0)
    return cut(out.withColumn("n_slots", F.col("passes") * F.col("n_blocks") + last))


def _spread(rows: DataFrame, count: str, keys: tuple[str, ...]) -> DataFrame:
    """``rows`` once for each number (``k``) from 0 to ``count`` - 1, in spans that are dealt out by ``keys``."""
    spans = rows.filter(F.col(count) > 0).withColumn("span", F.explode(F.sequence(F.lit(0), F.floor((F.col(count) - 1) / _SPAN).cast("int"))))
    spans = spans.repartition(*keys, "span").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(_SPAN - 1))))
    return spans.withColumn("k", F.col("span").cast("long") * _SPAN + F.col("k")).filter(F.col("k") < F.col(count)).drop("span")


def source_slots(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source_no, slot, pass, block, take, whole): the slots that a source fills, in its own order, ``take`` words of a block each."""
    keyed = sources.withColumn("rounds", rounds_of(F.col("n_blocks"), F.col("key")))
    rows = _spread(keyed, "n_slots", ("source_no",)).withColumnRenamed("k", "slot")
    rows = rows.withColumn("pass", F.floor(F.col("slot") / F.col("n_blocks"))).withColumn("at", F.col("slot") % F.col("n_blocks"))
    rows = rows.withColumn("block", permuted((F.col("at") + F.col("pass") * 104729) % F.col("n_blocks"), F.col("n_blocks"), F.col("rounds")))
    rows = rows.withColumn("length", F.when(F.col("block") == F.col("n_blocks") - 1, F.col("source_size") - F.col("block") * block).otherwise(F.lit(block).cast("long")))
    rows = cut(rows.select("source_no", "slot", "pass", "at", "block", "length", "passes", "lack"))
    short = rows.filter((F.col("pass") == F.col("passes")) & (F.col("length") < block)).select("source_no", F.col("at").alias("short_at"), F.col("length").alias("short_length"))
    rows = rows.join(short, "source_no", "left")
    begin = F.col("at") * block - F.when(F.col("at") > F.col("short_at"), block - F.col("short_length")).otherwise(0)
    take = F.when(F.col("pass") < F.col("passes"), F.col("length")).otherwise(F.least(F.col("length"), F.col("lack") - begin))
    return rows.withColumn("take", take).filter("take > 0").select("source_no", "slot", "pass", "block", "take", (F.col("take") == F.col("length")).alias("whole"))


def shard_counts(own: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """(shard, source_no, n, length): how many of its ``length`` slots each output shard draws from each source. Of all shards' slots, as many
    fall to a source as ``own`` has of it: one ticket per slot of a source, drawn by a keyed permutation of the places in the shards."""
    counted = own.groupBy("source_no").agg(F.count("*").alias("tickets"))
    before = F.coalesce(F.sum("tickets").over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tickets = counted.select("source_no", "tickets", before.alias("offset"), F.sum("tickets").over(Window.partitionBy()).alias("total"))
    tickets = cut(tickets.withColumn("deal", rounds_of(F.col("total"), F.lit(15485863).cast("long"))))
    drawn = _spread(tickets, "tickets", ("source_no",)).withColumn("place", permuted(F.col("offset") + F.col("k"), F.col("total"), F.col("deal")))
    length = F.ceil(F.col("total") / n_shards)
    drawn = drawn.select("source_no", F.floor(F.col("place") / length).cast("int").alias("shard")).groupBy("shard", "source_no").agg(F.count("*").alias("n"))
    return cut(drawn.withColumn("length", F.sum("n").over(Window.partitionBy("shard"))))


def slots(sources: DataFrame, block: int = BLOCK, n_shards: int = N_SHARDS) -> DataFrame:
    """(shard, position, source_no, pass, block, take, whole): the mix as a list of slots. The counts that a shard has drawn say how many
    slots of each source it takes; they stand in the shard in a pseudorandom order."""
    own = cut(source_slots(sources, block))
    counts = shard_counts(own, n_shards)
    past = lambda group, order: F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = counts.withColumn("slots_before", past("source_no", "shard")).withColumn("places_before", past("shard", "source_no"))
    ranges = ranges.withColumn("order", rounds_of(F.col("length"), F.col("shard").cast("long") + 32452843))
    dealt = _spread(ranges, "n", ("source_no", "shard")).withColumn("position", permuted(F.col("places_before") + F.col("k"), F.col("length"), F.col("order")))
    dealt = dealt.select("shard", "position", "source_no", (F.col("slots_before") + F.col("k")).alias("slot"))
    return dealt.join(own.hint("merge"), ["source_no", "slot"]).select("shard", "position", "source_no", "pass", "block", "take", "whole")


def pieces(rows: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rid, doc_id, size, source_no, source_size, target, block, low, high): the words low..high-1 of a block that a
    document fills, one row per block that it touches; a document without words has one row with a null block."""
    n = rows.count()
    bits = min(40, max(0, math.ceil(math.log2(max(1, n / _CHUNK)))))
    rows = rows.join(sources.select(F.col("source").alias("named"), "source_no", "source_size", "target"), F.col("source").eqNullSafe(F.col("named")))
    rows = rows.withColumn("chunk", F.shiftright("order_key", 60 - bits))
    inside = Window.partitionBy("source_no", "chunk").orderBy("order_key", F.col("doc_id").asc_nulls_first(), "size", "rid")
    sums = rows.groupBy("source_no", "chunk").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "chunk", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("words_before"))
    placed = rows.withColumn("stop", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(sums, ["source_no", "chunk"])
    placed = placed.withColumn("stop", F.col("stop") + F.col("words_before")).withColumn("start", F.col("stop") - F.col("size"))
    touched = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block)))
    out = placed.withColumn("block", F.explode_outer(touched))
    low, high = F.greatest(F.col("start") - F.col("block") * block, F.lit(0)), F.least(F.col("stop") - F.col("block") * block, F.lit(block))
    return out.select("rid", "doc_id", "told", "size", "source_no", "source_size", "target", "start", "block", low.alias("low"), high.alias("high"))


def block_uses(dealt: DataFrame) -> DataFrame:
    """(source_no, block, whole, shards, short, short_shard): how often slots take all words of a block and in which shards (REPEATS + 1 at most), and
    how many words the one slot takes that stops within it (0 if none does)."""
    stops = F.when(~F.col("whole"), F.col("take"))
    return dealt.groupBy("source_no", "block").agg(
        F.count_if("whole").alias("whole"), F.collect_set(F.when(F.col("whole"), F.col("shard"))).alias("shards"), F.coalesce(F.max(stops), F.lit(0)).alias("short"),
        F.max(F.when(~F.col("whole"), F.col("shard"))).alias("short_shard"),
    )


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken (the words that the mix takes, repeats counted) and n_shards (the
    output shards that hold any of them)."""
    rows = sized(docs)
    sources = targets(rows, block)
    joined = pieces(rows, sources, block).join(block_uses(slots(sources, block)).hint("merge"), ["source_no", "block"], "left")
    part = F.greatest(F.least(F.col("high"), F.col("short")) - F.col("low"), F.lit(0))
    taken = F.coalesce(F.col("whole") * (F.col("high") - F.col("low")) + part, F.lit(0))
    used = F.coalesce(F.when(part > 0, F.array_append("shards", F.col("short_shard"))).otherwise(F.col("shards")), F.array().cast("array<int>"))
    every = F.size(F.array_distinct(F.flatten(F.collect_list(used)))).cast("long")
    return joined.groupBy("rid", "doc_id", "size", "source_size", "target").agg(F.sum(taken).alias("taken"), every.alias("n_shards")).drop("rid")


def mixed_texts(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as documents, all columns of ``docs``: one row per row and copy, with the words that this copy takes.
    A copy that takes all words keeps its text as it is; otherwise the words taken are joined by single spaces (and
    n_chars, where there is such a column, follows). Rows of which nothing is taken are absent."""
    rows = sized(docs)
    sources = targets(rows, block)
    joined = pieces(rows, sources, block).join(block_uses(slots(sources, block)).hint("merge"), ["source_no", "block"])
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("whole") + 1))
    joined = joined.withColumn("copy", copies).withColumn("high", F.when(F.col("copy") <= F.col("whole"), F.col("high")).otherwise(F.least("high", "short")))
    joined = joined.filter(F.col("high") > F.col("low")).withColumn("from", F.col("block") * block - F.col("start"))
    span = F.struct((F.col("from") + F.col("low")).alias("first"), (F.col("high") - F.col("low")).alias("n"))
    takes = joined.withColumn("span", span).groupBy("rid", "doc_id", "told", "size", "copy").agg(F.array_sort(F.collect_list("span")).alias("spans"), F.sum("span.n").alias("n"))
    takes = cut(takes.select("doc_id", "told", "spans", (F.col("n") == F.col("size")).alias("all_words")))
    again = cut(rows.groupBy("doc_id", "told").count().filter("count > 1").select("doc_id", "told"))
    packed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("own_id"), row_key(docs).alias("own_told"))
    same = lambda other: F.col("own_id").eqNullSafe(other.doc_id) & (F.col("own_told") == other.told)
    if not again.isEmpty():
        # of equal rows one is enough to write the takes of all
        packed = packed.join(again, same(again), "left_anti").union(packed.join(again, same(again), "left_semi").dropDuplicates(["own_id", "own_told"]))
    words = F.regexp_extract_all(F.col("doc.text"), F.lit(WORD), F.lit(0))
    # the words are a variable of the outer transform, so a text is split once, not once per span
    some = F.transform(F.array(words), lambda own: F.concat_ws(" ", F.flatten(F.transform("spans", lambda s: F.slice(own, s["first"].cast("int") + 1, s["n"].cast("int"))))))[0]
    out = packed.join(takes, same(takes)).withColumn("taken_text", F.when(F.col("all_words"), F.col("doc.text")).otherwise(some))
    made = {"text": F.col("taken_text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("all_words"), F.col("doc.n_chars")).otherwise(F.length("taken_text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[made.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])
