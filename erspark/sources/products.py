"""Product sources: the nested JSON file, and product views over the fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erspark.operators.sampling import numbered
from erspark.plans.lineage import cut

SCHEMA = "map<string,array<struct<title:string,shop:string,featuresMap:map<string,string>>>>"


LINE = "model_id string, title string, shop string, featuresMap map<string,string>"


def _products(rows: DataFrame) -> DataFrame:
    """Products from rows (id, true_model_id, p), numbered in the order of the id."""
    entries = F.coalesce(F.map_entries("p.featuresMap"), F.array().cast("array<struct<key:string,value:string>>"))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    features = F.transform(keys, lambda k: F.struct(k.alias("key"), F.coalesce(last(k), F.lit("")).alias("value")))
    items = numbered(cut(rows))
    return items.select(F.col("position").cast("long").alias("id"), "true_model_id", F.coalesce("p.title", F.lit("")).alias("title"), F.coalesce("p.shop", F.lit("")).alias("shop"), features.alias("features"))


def from_json(spark: SparkSession, path: str) -> DataFrame:
    """Products of a file, or of the files of a folder, that hold one object {model_id: [product, ...]} each. Ids follow the order of the files' paths,
    then of the file. Of repeated attribute keys the first place and the last value count; null values are empty. A file is
    read by one task; ``from_json_lines`` is the form for large inputs."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", SCHEMA).alias("models"))
    models = raw.select("file", F.posexplode(F.map_entries("models")).alias("i", "model"))
    items = models.select("file", "i", F.col("model.key").alias("true_model_id"), F.posexplode("model.value").alias("j", "p"))
    return _products(items.select(F.struct("file", "i", "j").alias("id"), "true_model_id", "p"))


def from_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Products of files with one object {model_id, title, shop, featuresMap} a line, which tasks read in parts. Ids follow the order of the files'
    paths, then of the lines. Blank lines are left out, a line that is no object fails the read; otherwise as ``from_json``."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    told = lines.filter(F.trim("value") != "").select(F.struct("file", "block", "line").alias("id"), F.from_json("value", LINE, {"mode": "FAILFAST"}).alias("p"))
    return _products(told.select("id", F.col("p.model_id").alias("true_model_id"), "p"))


def _feature(key, value):
    key = F.lit(key) if isinstance(key, str) else key
    return F.struct(key.alias("key"), F.coalesce(value, F.lit("")).alias("value"))


def documents_view(documents: DataFrame, length: int | None = None) -> DataFrame:
    """Documents as products: the text, or its first ``length`` characters, as title, the source as shop, exact copies as truth."""
    text = F.coalesce("text", F.lit(""))
    title = text if length is None else F.substring(text, 1, length)
    return documents.select(
        F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("true_model_id"), title.alias("title"),
        F.coalesce("source", F.lit("")).alias("shop"), F.array(_feature("Brand", F.col("lang")), _feature("n_chars", F.col("n_chars").cast("string"))).alias("features"),
    )


def part_view(part: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Parts as products with model words, ratios and resolutions. Columns of ``keep`` stay."""
    size, odd, n = F.col("p_size").cast("string"), F.col("p_partkey") % 2 == 1, F.length("p_type")
    title = F.concat("p_brand", F.lit(" "), "p_name", F.lit(" "), "p_type", F.lit(" "), size, F.lit(" inch M"), F.col("p_partkey").cast("string"), F.lit("X"), size, F.lit(" "), size, F.lower(F.substring("p_type", 1, 2)))
    pixels = F.concat((1000 + 100 * n).cast("string"), F.lit(" x "), (500 + 100 * n).cast("string"))
    features = F.array(
        _feature("Brand", F.col("p_brand")), _feature("Type", F.col("p_type")), _feature("Screen Size", F.concat(size, F.lit(".5 inches"))),
        _feature(F.when(odd, "Aspect Ratio").otherwise("Ratio"), F.concat(size, F.lit(":9"))),
        _feature(F.when(odd, "Native Resolution").otherwise("Resolution (native)"), pixels),
    )
    return part.select(F.col("p_partkey").alias("id"), F.concat_ws("|", "p_name", "p_brand", "p_type").alias("true_model_id"), title.alias("title"), F.concat(F.lit("shop"), (F.col("p_partkey") % 4).cast("string")).alias("shop"), features.alias("features"), *keep)
