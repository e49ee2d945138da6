import json

import pytest

from erspark.operators.clustering import upgma
from erspark.plans.lineage import replaced, stored
from erspark.sources.products import from_json, from_json_lines


def products(df):
    return [(r.id, r.true_model_id, r.title, r.shop, [tuple(f) for f in r.features]) for r in df.orderBy("id").collect()]


def test_json_files_of_a_folder(spark, tmp_path):
    for name in "ba":
        (tmp_path / f"{name}.json").write_text(json.dumps({f"{name}{k}": [{"title": f"{name}{k}{j}", "shop": "s", "featuresMap": {"k": "1"}} for j in range(2)] for k in range(2)}))
    rows = products(from_json(spark, str(tmp_path)))
    assert [r[:3] for r in rows] == [(n, t[:2], t) for n, t in enumerate(f"{x}{k}{j}" for x in "ab" for k in range(2) for j in range(2))]


def test_json_lines(spark, tmp_path):
    lines = [{"model_id": f"m{k // 2}", "title": f"t{k}", "shop": "s", "featuresMap": {"k": str(k)}} for k in range(500)]
    text = "\n\n".join(json.dumps(x) for x in lines)
    for name, part in (("1.json", text), ("2.json", '{"title": null, "featuresMap": {"a": "1", "b": null, "a": "2"}, "other": 3}\n')):
        (tmp_path / name).write_text(part)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = products(from_json_lines(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows[:500] == [(k, f"m{k // 2}", f"t{k}", "s", [("k", str(k))]) for k in range(500)]
    assert rows[500:] == [(500, None, "", "", [("a", "2"), ("b", "")])]


def test_json_lines_refuse_other_text(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"model_id": "m"}\nnot json\n')
    with pytest.raises(Exception, match="MALFORMED"):
        from_json_lines(spark, str(tmp_path)).collect()


def test_ties_don_t_depend_on_the_order_of_pairs():
    import numpy as np

    rng = np.random.default_rng(0)
    i, j = np.triu_indices(12, 1)
    dist = rng.choice([0.1, 0.2, 0.3, 0.7], len(i))
    labels = set()
    for _ in range(20):
        order = rng.permutation(len(i))
        labels.add(tuple(upgma(12, i[order], j[order], dist[order], 0.45)))
    assert len(labels) == 1


def test_replaced_removes_what_its_rows_no_longer_need(spark, tmp_path, monkeypatch):
    from erspark.plans import lineage

    monkeypatch.setattr(lineage, "shared_dir", lambda _: str(tmp_path))
    tables = lambda: sorted(p.name.split("-")[0] for p in tmp_path.iterdir())
    one, path = replaced(spark, lambda: stored(spark.range(5), "scratch"), "one")
    assert tables() == ["one"] and one.count() == 5
    two, _ = replaced(spark, lambda: stored(one.filter("id > 1"), "scratch"), "two", path)
    assert tables() == ["two"] and two.count() == 3

    def fails():
        stored(two, "scratch")
        raise RuntimeError

    with pytest.raises(RuntimeError):
        replaced(spark, fails, "three", None)
    assert tables() == ["two"]
    assert stored(two, "kept").count() == 3 and tables() == ["kept", "two"]
