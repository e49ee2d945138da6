"""Suffix dedup of rows that stand more than once."""

from collections import Counter

import pytest
from test_duplicates import COLUMNS, dedup_bytes, passages

from erspark.llm import suffixes


@pytest.mark.parametrize("parts", [1, 7])
def test_equal_rows_count_as_one_text(spark, parts):
    alone = " ".join(f"w{k * k}" for k in range(300))
    once = [(k, t) for k, t in passages(5, 12) if k is not None]
    once = list(dict(once).items()) + [(200, alone), (201, "x" + alone[:400]), (202, "ab" * 150), (203, "own " + alone[::-1])]
    times = {200: 3, 202: 2, 203: 2, once[0][0]: 2}
    rows = [r for r in once for _ in range(times.get(r[0], 1))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = Counter(tuple(r) for r in suffixes.dedup_bytes(df).select(*COLUMNS).collect())
    assert got == Counter({row: n * times.get(row[0], 1) for row, n in dedup_bytes(once).items()})
    assert [r[2] for r in got if r[0] in (200, 203)] == [0, 0]


def test_equal_rows_with_null_id_keep_their_text(spark):
    text = " ".join(f"n{k * 7}" for k in range(200))
    df = spark.createDataFrame([(None, text)] * 2 + [(0, "other")], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in suffixes.dedup_bytes(df).collect()} == {(None, 0), (0, 0)}
