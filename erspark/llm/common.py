"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drawn_by_hash(rows: DataFrame, group: str, sizes: dict, wanted: dict) -> DataFrame:
    """About the ``wanted`` number of rows of each group, and no more: those with the smallest hash of doc_id. The groups' ``sizes`` give a
    hash bound that few more pass, so ranking sees a bounded number of rows however large a group is."""
    span = 1 << 30
    place = F.pmod(F.xxhash64("doc_id"), F.lit(span))
    most = {value: span if size <= 4 * wanted[value] else span * 2 * wanted[value] // size for value, size in sizes.items()}
    of = lambda numbers: F.lit(0) if not numbers else F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for item in numbers.items() for x in item]), F.col(group)), F.lit(0))
    bound, limit = of(most), of({value: wanted[value] for value in sizes})
    some = rows.filter(place < bound).withColumn("hash_place", place)
    rank = F.row_number().over(Window.partitionBy(group).orderBy("hash_place", "doc_id"))
    return some.withColumn("hash_rank", rank).filter(F.col("hash_rank") <= limit).drop("hash_place", "hash_rank")


#: Bits of the bitmap of ``marked``: 8 MB, whatever the tables hold.
MARK_BITS = 26


def marked(rows: DataFrame, members: DataFrame, keys: tuple[str, ...] = ("doc_id", "told")) -> tuple[DataFrame, DataFrame]:
    """``rows`` split in two: those that may have a row in ``members`` (equal ``keys``), and those that surely have none. The split is
    made by a bitmap of 2^MARK_BITS hashed places, so what is broadcast has a fixed size; as it fills, more rows count as possible members, none is lost."""
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << MARK_BITS))
    bits = members.select(place.alias("place")).groupBy(F.shiftright("place", 15).alias("mark_bucket")).agg(F.bitmap_construct_agg(F.col("place") % 32768).alias("mark_bits"))
    met = rows.join(F.broadcast(bits), F.shiftright(place, 15) == F.col("mark_bucket"), "left")
    byte = F.conv(F.hex(F.substring("mark_bits", (F.shiftright(place, 3) % 4096 + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    return met.filter(bit).select(*rows.columns), met.filter(~bit).select(*rows.columns)


def told() -> Column:
    """A hash of the text, which keeps apart rows that share a doc_id."""
    return F.xxhash64(F.col("text"), F.col("text").isNull())


def unique_ids(docs: DataFrame) -> bool:
    """Whether no doc_id is repeated or null."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").isEmpty()


def told_of(unique: bool) -> Column:
    """What keeps apart rows of an equal doc_id: nothing is needed where ids are unique, otherwise a hash of the text."""
    return F.lit(0).cast("long") if unique else told()


def keyed(docs: DataFrame, unique: bool | None = None) -> DataFrame:
    """(doc_id, told, text), ``told`` as by ``told_of``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.select("doc_id", told_of(unique_ids(rows) if unique is None else unique).alias("told"), "text")


def once(rows: DataFrame, unique: bool) -> DataFrame:
    """Keyed rows without repeats; where ids are unique there are none to look for."""
    return rows if unique else rows.dropDuplicates(["doc_id", "told"])


def met(texts: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """``texts`` (doc_id, told, text) with the columns of ``lists`` (d, t, ...)."""
    return texts.join(lists, texts.doc_id.eqNullSafe(lists.d) & (texts.told == lists.t), how).drop("d", "t")


def by_text(rows: DataFrame, what: Column, name: str) -> DataFrame:
    return rows.groupBy(F.col("doc_id").alias("d"), F.col("told").alias("t")).agg(F.collect_list(what).alias(name))
