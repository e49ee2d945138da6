import pytest
from pyspark.sql import functions as F

from erspark.functions import text as T

FEATURES = "array<struct<key:string,value:string>>"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "cleaned"),
    [
        ('Samsung UN40H6350 40" 1080p 120-Hertz (54.6 Inches)', "samsung un40h6350 40inch 1080p 120hz 54 6inch"),
        ("LG - 32 - inch, 20 pounds", "lg - 32inch 20lbs"), ("5 lb", "5 lb"), (None, ""), ("", ""), ("  A \t b ", "a b"),
    ],
)
def test_clean_text(spark, raw, cleaned):
    assert one(spark, T.clean_text(F.col("t")), t=raw) == cleaned


@pytest.mark.parametrize(("raw", "found"), [('Samsung UN40H6350 40" 1080p', ["UN40H6350", '40"', "1080p"]), ("Sony 55 inch 3D", ["3D"]), ('LN-46A (54.6")', ["46A", '54.6")']), ("KDL40", []), (None, [])])
def test_title_words(spark, raw, found):
    assert one(spark, T.title_words(F.col("t"), lower=False), t=raw) == found


@pytest.mark.parametrize(("value", "found"), [("54.6 inches", ["54.6"]), ("16:9, 4:3", ["16:9", "4:3"]), ("1920 x 1080", ["1920 x 1080"]), ("1920X1080", []), ("(1920 x 1080)", []), ("about 54.6", []), (None, [])])
def test_value_words(spark, value, found):
    features = F.array(F.struct(F.lit("k").alias("key"), F.col("v").alias("value")))
    assert one(spark, T.value_words(features), v=value) == found


@pytest.mark.parametrize(("text", "k", "grams"), [("tv", 3, []), ("tvs", 3, ["tvs"]), ("aaaa", 3, ["aaa"]), ("", 3, [])])
def test_kgrams(spark, text, k, grams):
    assert one(spark, T.kgrams(F.col("t"), k), t=text) == grams
    assert one(spark, T.char_shingles(F.col("t"), k), t=text) == (grams or [text])


@pytest.mark.parametrize(("weight", "expected"), [(0, ["MW_40_0", "MW_sony_0"]), (2, ["MW_a1_0", "MW_a1_1", "MW_40_0", "MW_sony_0"])])
def test_weighted_words(spark, weight, expected):
    assert one(spark, T.weighted_words(F.array(F.lit("a1"), F.lit("40"), F.lit("sony")), weight), t="") == expected


def test_brand_and_resolution(spark):
    rows = [("New lg oled TV", [("Max resolution", "about"), ("RESOLUTION", "1920 X 1080 ")]), ("x", [("Brand", "SONY"), ("brand", "other")])]
    df = spark.createDataFrame(rows, f"t string, f {FEATURES}")
    got = df.select(T.brand(F.col("t"), F.col("f"), ["LG", "oled tv", "G"]).alias("b"), T.brand(F.col("t"), F.col("f")).alias("n"), T.resolution(F.col("f")).alias("r"), T.brand_words(F.col("f")).alias("w")).collect()
    assert [(r.b, r.n, r.r, r.w) for r in got] == [("oled tv", "na", "1920 X 1080", []), ("sony", "sony", "NA", ["other", "sony"][::-1])]


def test_letters_and_digits(spark):
    assert (one(spark, T.letters(F.col("t")), t="UN40H6350"), one(spark, T.digits(F.col("t")), t="UN40H6350")) == ("UNH", "406350")
