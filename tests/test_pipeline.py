"""Entry points end to end, and the small sources and sinks."""

import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsloom import pipeline
from newsloom.operators import recommend
from newsloom.plans import base
from newsloom.sources import click_log, sinks


@pytest.fixture(scope="module")
def tables(spark, sf):
    return base.stored(spark, sf)


def test_build_writes_all_tables(spark, tables, tmp_path):
    a, i, c = tables
    report = pipeline.build(spark, a, i, str(tmp_path))
    assert json.loads((tmp_path / "reports/log_pipeline.json").read_text())["n_articles"] == report["n_articles"] == a.count()
    assert set(report["n_users_with_features"]) == {"val", "test"} and report["splits"]["train"]["rows"] == i.where("split = 'train'").count()
    facts, n = click_log.table_facts(spark, str(tmp_path / "processed/log/click_history"))
    assert dict(facts)["click_time"] == "timestamp_ntz" and n == report["n_clicks"] > 0
    late = i.withColumn("impression_time", F.when(F.col("split") == "train", F.lit(datetime(2999, 1, 1)).cast("timestamp_ntz")).otherwise(F.col("impression_time")))
    with pytest.raises(AssertionError):
        pipeline.build(spark, a, late, str(tmp_path / "x"))


def test_prediction_files_and_serving(spark, sf, tables, tmp_path):
    a, i, _ = tables
    index = recommend.build_index(a, "vectors", vectors=base.vectors(spark, sf))
    pipeline.predict(spark, i, index, str(tmp_path), methods=("fusion_score",))
    with zipfile.ZipFile(tmp_path / "fusion_score.zip") as z:
        assert z.namelist() == ["prediction.txt"]
        lines = z.read("prediction.txt").decode().splitlines()
    ids = [int(x.split(" ")[0]) for x in lines]
    shown = {r.impression_id: len(r.candidate_ids) for r in i.where("split = 'test'").collect() if r.candidate_ids}
    assert ids == sorted(ids) and set(ids) == set(shown)
    assert all(sorted(json.loads(x.split(" ")[1])) == list(range(1, shown[k] + 1)) for k, x in zip(ids, lines))
    out = pipeline.serve(spark, i, index, batch=40, calls=1)
    assert out["n"] == 1 and out["p50_ms"] <= out["p99_ms"] and out["ms_per_impression"] > 0 and out["peak_mb"] > 0


def test_serving_figures():
    seen = []
    out = pipeline.serving_figures(seen.append, range(10), warm=3)
    assert seen == [0, 1, 2, *range(10)] and out["n"] == 10 and out["workers"]["100"] <= out["workers"]["10000"]


def test_rows_and_samples(spark):
    d = spark.createDataFrame([(1, True), (2, False), (3, None)], "impression_id long, is_beyond_accuracy boolean")
    assert [r.impression_id for r in click_log.accuracy_rows(d).orderBy("impression_id").collect()] == [2, 3]
    assert click_log.accuracy_rows(d.drop("is_beyond_accuracy")).count() == 3
    one = click_log.sample_json(d.orderBy("impression_id"), 1)
    assert len(one) == 1 and json.loads(one[0]) == {"impression_id": 1, "is_beyond_accuracy": True} and "\n" in one[0]


def test_reports_are_small(spark, monkeypatch):
    d = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0)], "m string, s string, v double")
    assert sinks.report_of(d, ["m", "s"]) == {"a": {"x": {"v": 1.0}, "y": {"v": 2.0}}}
    monkeypatch.setattr(sinks, "REPORT_ROWS", 1)
    with pytest.raises(ValueError):
        sinks.report_of(d, ["m", "s"])


def test_archives_unpack_once_and_stay_inside(tmp_path):
    with zipfile.ZipFile(tmp_path / "log.zip", "w") as z:
        z.writestr("a/b.txt", "x")
    got = click_log.extract_if_absent(str(tmp_path), "log")
    assert (tmp_path / "log/a/b.txt").read_text() == "x"
    (tmp_path / "log.zip").unlink()
    assert click_log.extract_if_absent(str(tmp_path), "log") == got
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../out.txt", "x")
    with pytest.raises(ValueError):
        click_log.extract_if_absent(str(tmp_path), "bad")
    assert not (tmp_path / "out.txt").exists()
