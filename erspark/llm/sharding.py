"""Sharding by sampled splitters, under the law ``bytes``: shards of nearly equal size.

Rows are ordered by a digest of the text, then by a digest of the doc_id, so equal texts are neighbours. A size-weighted
sample of keys (at most about ``SAMPLE`` * ranges of them) gives quantile boundaries; rows are dealt into the ranges
between them, and a range that still holds over ``OVERFULL`` times its share is divided again at its own sample
keys. Ranges only make the order distributed: exact sizes and counts before each range and within it give every row
its global offset, and the offset decides the shard.

Equal texts stay in one shard wherever they fit into one: groups above 1/``GROUP_PART`` of a shard (there are fewer than
GROUP_PART * n_shards) are packed first, the largest first, each into the least filled shard if it fits there; the others
are laid in key order over what room the shards have left, and a smaller group goes where its middle falls. A group that fits nowhere is
laid out row by row.

Native: DataFrame functions only; the driver sees totals, boundaries (MAX_RANGES short keys at most) and the large groups.

Defined cases: a null text has size 1 and crc32 0 and groups with empty texts; null doc_ids sort as empty; equal rows
are interchangeable; one row larger than a shard fills it alone; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from erspark.plans.lineage import cut

N_SHARDS = 8
ROWS_PER_RANGE = 20_000
MAX_RANGES = 4096
SAMPLE = 48
OVERFULL = 1.5
#: Groups of equal texts above this part of a shard are packed before all others.
GROUP_PART = 64
_ORDER = ("text_key", "id_key", "doc_id")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.substring(F.md5(text.cast("binary")), 1, 16).alias("text_key"),
        F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 16).alias("id_key"),
    )


def _key() -> Column:
    return F.concat("text_key", "id_key")


def _range_of(bounds: list[str]) -> Column:
    """The number of boundaries at or below the row's key, by binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    array = F.split(F.lit(",".join(bounds)), ",")

    def step(low: Column, width: Column) -> Column:
        at = low + width
        return F.when((at <= len(bounds)) & (F.get(array, at - 1) <= _key()), at).otherwise(low)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def splitters(rows: DataFrame, big: DataFrame, total: int, n_ranges: int) -> list[str]:
    """Boundary keys. ``big`` names the text keys of large groups, which ranges may cut; other groups are never cut."""
    chance = F.col("size") * float(SAMPLE * n_ranges) / float(max(1, total))
    drawn = F.pmod(F.xxhash64(_key(), F.col("size")), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.filter(drawn < chance).select("text_key", _key().alias("key"))
    whole = F.concat("text_key", F.lit("0" * 16))
    sample = cut(sample.join(F.broadcast(big.select("text_key", F.lit(True).alias("cuttable"))), "text_key", "left").select(F.when(F.col("cuttable"), F.col("key")).otherwise(whole).alias("key")))

    def picked(pieces: DataFrame) -> list[str]:
        first = pieces.filter("piece > 0").groupBy("part", "piece").agg(F.min("key").alias("key"))
        return sorted({r.key for r in first.select("key").collect()})

    n = F.count("*").over(Window.partitionBy("part"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    whole_range = sample.withColumn("part", F.lit(0)).withColumn("piece", F.floor(rank * n_ranges / n))
    bounds = picked(whole_range)
    share = total / n_ranges
    sizes = rows.groupBy(_range_of(bounds).alias("part")).agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > OVERFULL * share)
    over = cut(sizes.select("part", F.ceil(F.col("bytes") / share).alias("times")))
    if over.isEmpty():
        return bounds
    ranged = sample.select("key", F.substring("key", 1, 16).alias("text_key"), F.substring("key", 17, 16).alias("id_key"))
    ranged = ranged.select("key", _range_of(bounds).alias("part")).join(F.broadcast(over), "part")
    again = picked(ranged.withColumn("piece", F.floor(rank * F.col("times") / n)))
    return sorted({*bounds, *again})


def packed(groups: list[tuple[str, int]], total: int, n_shards: int) -> tuple[dict[str, int], list[int]]:
    """The shard of each group (text key, bytes) that fits into one, and the room that all shards have left."""
    room = [-(-total // n_shards)] * n_shards
    where = {}
    for key, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        best = max(range(n_shards), key=lambda k: (room[k], -k))
        if size <= room[best]:
            where[key] = best
            room[best] -= size
    return where, room


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard) and grown_shard (null)."""
    spark = docs.sparkSession
    rows = cut(keyed(docs, id_col, text_col))
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    large = rows.groupBy("text_key").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") * n_shards * GROUP_PART > total)
    groups = [(r.text_key, r.bytes) for r in large.collect()]
    where, room = packed(groups, total, n_shards)
    big = spark.createDataFrame([(key, where.get(key)) for key, _ in groups], "text_key string, own_shard int")
    n_ranges = min(MAX_RANGES // 2, max(2 * n_shards, math.ceil(count / ROWS_PER_RANGE)))
    bounds = splitters(rows, big, total, n_ranges)

    dealt = rows.withColumn("part", _range_of(bounds))
    dealt = dealt.join(F.broadcast(big.withColumn("big", F.lit(True))), "text_key", "left")
    dealt = dealt.withColumn("laid", F.when(F.col("own_shard").isNull(), F.col("size")).otherwise(0))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("part").agg(F.sum("laid").alias("bytes"))
    sums = sums.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"))

    order = ["text_key", "id_key", F.col("doc_id").asc_nulls_first(), "size"]
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy("part", "text_key")
    placed = dealt.withColumn("stop", F.sum("laid").over(inside))
    placed = placed.withColumn("group_stop", F.max("stop").over(group)).withColumn("group_start", F.min(F.col("stop") - F.col("laid")).over(group))
    placed = placed.join(F.broadcast(sums), "part")
    middle = 2 * F.col("bytes_before") + F.when(F.col("big"), 2 * F.col("stop") - F.col("laid")).otherwise(F.col("group_start") + F.col("group_stop"))
    ends = [2 * sum(room[: k + 1]) for k in range(n_shards - 1)]
    free = sum((F.when(middle >= end, 1).otherwise(0) for end in ends), F.lit(0))
    placed = cut(placed.select("doc_id", "size", "text_crc32", "text_key", "id_key", "part", F.coalesce("own_shard", free).cast("int").alias("shard")))
    past = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("part", "shard").orderBy(*order)).cast("long") - 1
    return placed.withColumn("rank", rank).join(F.broadcast(ahead), ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("ahead") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
