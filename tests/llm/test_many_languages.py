"""Every language of a table is learned."""

import random

from erspark.llm import langid


def test_more_languages_than_a_hundred(spark):
    draw = random.Random(3)
    rows, number = [], 0
    for k in range(104):
        lang, words = f"q{k:03d}", ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(6)]
        for _ in range(10 if k < 100 else 8):
            rows.append((number, " ".join(draw.choice(words) for _ in range(30)), lang))
            number += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify_languages(df).collect()}
    assert {f"q{k:03d}" for k in range(104)} == set(got.values())
    assert sum(got[d] == lang for d, _, lang in rows) / len(rows) > 0.95


def test_a_language_is_learned_from_its_texts_with_letters(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_DOCS", 2)
    rows = [(k, "1234 5678", "aa") for k in range(40)] + [(k, "zeta omega kappa", "aa") for k in range(40, 50)] + [(k, "der die das und", "de") for k in range(50, 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify_languages(df).collect()} == {"aa", "de", "und"}
