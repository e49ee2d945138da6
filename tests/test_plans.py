import json
import random

import pytest
from pyspark.sql import functions as F

from erspark.plans import curves, sweep, tuning
from erspark.plans.matching import evaluate, match
from erspark.plans.params import FULL, FeatureParams, LshParams, MatchParams
from erspark.queries import parts
from erspark.sources.products import documents_view, from_json
from erspark.streaming.incremental import band_table, candidates_of_stream

SF = "/root/testdata/sf0.01"


def docs(spark, sf):
    """The heads that the regression counts were made for."""
    return documents_view(spark.read.parquet(f"{sf}/documents.parquet"), 200)


def test_documents_run_end_to_end(spark):
    m = evaluate(docs(spark, SF), FULL[0], LshParams(50, 4), FULL[1]).first()
    assert m.n_comp == 238
    assert (m.pq, m.pc, m.f1) == pytest.approx((91 / 238, 1.0, 0.6520), abs=5e-5)


def test_documents_clusters(spark):
    pairs, found = match(docs(spark, SF), FULL[0], LshParams(20, 10), FULL[1])
    assert pairs.count() == 177
    sizes = [r["count"] for r in found.groupBy("cluster_id").count().collect()]
    assert (len(sizes), sum(n * (n - 1) // 2 for n in sizes)) == (95, 165)


def test_parts_run_end_to_end(spark):
    m = evaluate(parts(spark, SF), FULL[0], LshParams(50, 4), FULL[1]).first()
    assert m.n_comp == 2950
    assert m.f1 == pytest.approx(0.0456, abs=5e-5)


def test_grid_equals_single_bootstraps(spark):
    products = docs(spark, "/root/testdata/sf0.001")
    values = sweep.grid(pairs=[LshParams(8, 2), LshParams(5, 3)], bootstraps=2) | {"EPSILON": [0.3, 0.454]}
    rows = sweep.run_grid(products, values).collect()
    assert len(rows) == 4 and [r.Mean_F1_star for r in rows] == sorted((r.Mean_F1_star for r in rows), reverse=True)
    assert len(rows[0]) == 18
    for r in rows[:2]:
        m = MatchParams(r.Gamma, r.Epsilon, r.Mu, r.Alpha, r.Beta, r.Delta, r.Threshold)
        own = [sweep.bootstrap_metrics(products, FULL[0], LshParams(r.Bands, r.Rows), m, seed).first() for seed in range(2)]
        assert r.Mean_F1 == pytest.approx(sum(x.f1 for x in own) / 2)
        assert r.Mean_PQ == pytest.approx(sum(x.pq for x in own) / 2)
        assert r.Frac_Comps == pytest.approx(sum(x.frac_comp for x in own) / 2)
    curve = curves.combined_curve(spark.createDataFrame(rows), spark.createDataFrame(rows))
    assert curve.count() == 8 and curves.performance_curve(spark.createDataFrame(rows)).columns == ["Frac_Comps", "Mean_F1", "Mean_F1_star"]


def test_grid_by_the_sequential_draw(spark):
    products = docs(spark, "/root/testdata/sf0.001")
    row = sweep.run_grid(products, sweep.grid(pairs=[LshParams(8, 2)], bootstraps=1), draw="sequential").first()
    own = sweep.bootstrap_metrics(products, FULL[0], LshParams(8, 2), FULL[1], 0, draw="sequential").first()
    assert (row.Mean_F1, row.Mean_PC, row.Frac_Comps) == pytest.approx((own.f1, own.pc, own.frac_comp)) and own.n_comp > 0


def test_bootstrap_of_one_row_is_zero(spark):
    one = docs(spark, "/root/testdata/sf0.001").limit(1)
    assert tuple(sweep.bootstrap_metrics(one, FULL[0], LshParams(2, 2), FULL[1], 0).first()) == (0.0, 0.0, 0.0, 0.0, 0, 0.0)


def test_tuning_resumes(spark, tmp_path):
    path = str(tmp_path / "trials")
    score = lambda x: -abs(x["gamma"] - 0.7)
    assert tuning.optimise(spark, score, path, 3, 12).count() == 3
    rows = tuning.optimise(spark, score, path, 2, 12).collect()
    assert sorted(r.number for r in rows) == [0, 1, 2, 3, 4] and rows[0].value == max(r.value for r in rows)
    x = tuning.suggest(random.Random(1), [(r.value, json.loads(r.params)) for r in rows] * 4, 12)
    assert all(a <= x[k] <= b for k, (a, b) in tuning.SPACE.items()) and 0 <= x["lsh_pair_index"] < 12


def test_tuning_objective(spark):
    objective = tuning.MatchingObjective(docs(spark, "/root/testdata/sf0.001"), target=16, bootstraps=1)
    x = {"shingle_size": 4, "mw_weight": 2, "stop_shingle_freq": 0.0138, "lsh_pair_index": 3, "gamma": 0.7, "epsilon": 0.45, "mu": 0.8, "alpha": 0.5, "beta": 0.8, "delta": 0.2, "threshold": 0.5}
    assert 0 <= objective(x) <= 1 and len(objective.kept) == 1


def test_json_source(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text('{"m1": [{"title": "A", "shop": "s", "featuresMap": {"k": "1", "z": "2", "k": "3"}}, {"title": null}], "m2": [{"shop": "t", "featuresMap": {}}]}')
    rows = from_json(spark, str(path)).orderBy("id").collect()
    assert [(r.id, r.true_model_id, r.title, r.shop, [tuple(f) for f in r.features]) for r in rows] == [
        (0, "m1", "A", "s", [("k", "3"), ("z", "2")]), (1, "m1", "", "", []), (2, "m2", "", "t", []),
    ]


def test_stream_meets_stored_bands(spark, tmp_path):
    f, p = FeatureParams(3, 2, 1.0), LshParams(4, 1)
    schema = "id long, title string, shop string, features array<struct<key:string,value:string>>"
    stored = band_table(spark.createDataFrame([(1, "sony 40 inch led", "", []), (2, "unlike", "", [])], schema), ["son"], f, p)
    spark.createDataFrame([(9, "sony 40 inch led", "", [])], schema).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = candidates_of_stream(band_table(arriving, ["son"], f, p), stored).writeStream.format("memory").queryName("near").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("near").distinct().collect()} == {(9, 1)}


def test_cli_compare(spark, tmp_path):
    from erspark import cli

    path = tmp_path / "p.json"
    path.write_text(json.dumps({f"m{k}": [{"title": f"tv {k}", "shop": s, "featuresMap": {"Brand": "b"}} for s in "ab"] for k in range(4)}))
    cli.main(["match", str(path), "--out", str(tmp_path / "out")])
    assert set(spark.read.parquet(str(tmp_path / "out")).columns) == {"id", "cluster_id"}
    cli.main(["compare", str(path), "--out", str(tmp_path / "curve"), "--bootstraps", "1"])
    curve = spark.read.parquet(str(tmp_path / "curve"))
    assert {(r.model, r["count"]) for r in curve.groupBy("model").count().collect()} == {("full", 99), ("restricted", 99)}
