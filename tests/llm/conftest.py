import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "Zeta,", "été", "straße", "ÑANDÚ", "x1", "a-b", "#tag"]


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", "er", "in", "th"]) for _ in range(n))


def edge_rows():
    """(doc_id, text, lang, source, n_chars) with nulls, blanks, repeats, ties, copies, shared passages and a very long text."""
    shared = prose(1, 80)
    rows = [
        (1, prose(2, 60) + " " + shared, "en", "b", 1), (2, shared + " " + prose(3, 60), "en", "a", 1), (3, prose(4, 30), None, None, None), (4, "", "de", "a", 0),
        (5, None, "fr", None, None), (6, " \t\n ", "en", "b", 3), (7, prose(2, 60) + " " + shared, "en", "b", 1), (7, prose(2, 60) + " " + shared, "en", "b", 1), (8, prose(5, 30), "en", "é", 1),
        (8, prose(6, 40) + shared, "de", "é", 1), (None, prose(7, 30) + " " + shared, "de", "b", 1), (None, None, None, None, None), (9, "aaaa " * 400, "en", "c", 1), (10, prose(8, 5000) + "\n\n" + shared + "\x00\x01" + prose(8, 200), "fr", "c", 1),
        (11, "x", "en", "c", 1), (12, "AKIA" + "A" * 20 + " password: hunter22", "en", "c", 1), (13, "été " * 60, "fr", "b", 1), (14, prose(2, 60) + " " + shared + ".", "en", "b", 1), (15, "Ünïcödé wörds here", "en", "b", 1),
    ]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edges(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows(), SCHEMA)
    clash = ["size", "shard", "fp", "told", "rid", "slot", "pos", "row", "m", "term", "window", "stratum", "block", "component", "k1", "kept", "taken", "bad_id", "d", "t"]
    return df.select("*", *[F.lit("clash").alias(c) for c in clash])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
