"""Texts of many words take time and memory in proportion to their length."""

from erspark.llm import decontam, mixing


def test_contamination_of_a_long_text_by_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(40_000))), (2, "w5 w6"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([("a", " ".join(f"w{k}" for k in range(100, 130))), ("b", "w39998 w39999")], "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontam.contamination(docs, items).collect()}
    assert got == {1: (40_000, 32, 2), 2: (2, 0, 0), 3: (0, 0, 0)}


def test_a_long_text_is_mixed_in_order(spark):
    """The words that a copy takes stand as in the text, and as many as ``mixed_documents`` counts."""
    rows = [(1, " ".join(f"{k}" for k in range(50_000)), "a"), (2, " ".join(f"{k}" for k in range(30_000)), "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.doc_id: r.taken for r in mixing.mixed_documents(docs).collect()}
    got = {1: 0, 2: 0}
    for r in mixing.mixed_texts(docs).collect():
        numbers = [int(w) for w in r.text.split(" ")]
        assert all(a < b for a, b in zip(numbers, numbers[1:], strict=False))
        got[r.doc_id] += len(numbers)
    assert got == taken and taken[1] < 50_000 < sum(taken.values())
