"""Entry points: build all tables of a log, write a prediction file, measure serving.

    python -m newsloom.pipeline build ARTICLES BEHAVIORS OUT
    python -m newsloom.pipeline predict ARTICLES BEHAVIORS VECTORS OUT
    python -m newsloom.pipeline serve ARTICLES BEHAVIORS VECTORS OUT
"""

from __future__ import annotations

import math
import resource
import sys
import time
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import features, guards, recommend
from newsloom.shared import materialize
from newsloom.sources import click_log, sinks


def build(spark: SparkSession, articles: DataFrame, interactions: DataFrame, out: str, name: str = "log") -> dict:
    """Write the unified tables, the features of articles and of users before val and before test, and a
    report, and give the report. Splits out of order or clicks past a cutoff stop it."""
    guards.assert_split_order(interactions)
    tables = {"articles": articles, "interactions": interactions, "click_history": click_log.click_history(interactions)}
    for t, d in tables.items():
        sinks.write_table(d, f"{out}/processed/{name}/{t}")
    articles, interactions, clicks = (spark.read.parquet(f"{out}/processed/{name}/{t}") for t in tables)
    train = click_log.candidates(interactions).where("split = 'train'")
    sinks.write_table(features.article_features(articles, train), f"{out}/feature_store/{name}/article_features")
    bounds = {r["split"]: r for r in guards.split_bounds(interactions).collect()}  # one row a split
    users = {}
    for split in ("val", "test"):
        cut = bounds[split]["first_time"] if split in bounds else None
        if cut is None:
            continue
        before = clicks.where(F.col("click_time") < F.lit(cut))
        guards.assert_before_cutoff(before, cut, label=f"{name}/user_features_{split}")
        path = f"{out}/feature_store/{name}/user_features_{split}"
        sinks.write_table(features.user_features(before, F.lit(cut)), path)
        users[split] = click_log.table_facts(spark, path)[1]
    report = {
        "name": name, "n_articles": articles.count(), "n_interactions": interactions.count(), "n_clicks": clicks.count(), "n_users_with_features": users, "leakage_check": "passed",
        "splits": {k: {"rows": r["n_rows"], "first_time": r["first_time"], "last_time": r["last_time"]} for k, r in bounds.items()},
    }
    sinks.write_report(spark, report, f"{out}/reports/{name}_pipeline.json")
    return report


def predict(spark: SparkSession, interactions: DataFrame, index: recommend.Index, out: str, split: str = "test", methods: tuple[str, ...] = recommend.SCORES) -> None:
    """Rank files of a split, one for each method, with a zip beside it."""
    own = interactions.where(F.col("split") == split)
    scored = recommend.retrieval_scores(own, index)
    lines = materialize(recommend.prediction_lines(scored, methods), "lines")
    for m in methods:
        sinks.write_rank_file(lines.where(F.col("method") == m).select(F.col("impression_id").alias("ordinal"), "line"), f"{out}/{m}", f"{out}/{m}.zip")


def serving_figures(call: Callable[[int], object], requests: Sequence[int], warm: int = 2, targets: Sequence[int] = (100, 1_000, 10_000)) -> dict:
    """Latency percentiles in milliseconds of calls one after the other, requests a second of one worker, the
    workers that the targets (requests a second) ask for, and the greatest memory of this process."""
    for r in list(requests)[:warm]:
        call(r)
    took = []
    for r in requests:
        began = time.perf_counter()
        call(r)
        took.append((time.perf_counter() - began) * 1e3)
    p50, p95, p99 = (float(x) for x in np.percentile(took, (50, 95, 99)))
    rate = 1e3 / max(float(np.mean(took)), 1e-9)
    return {"n": len(took), "p50_ms": p50, "p95_ms": p95, "p99_ms": p99, "mean_ms": float(np.mean(took)), "per_second": rate, "workers": {str(t): math.ceil(t / rate) for t in targets}, "peak_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024}


def serve(spark: SparkSession, interactions: DataFrame, index: recommend.Index, batch: int = 256, calls: int = 5, split: str = "test") -> dict:
    """Figures of scoring and ranking batches of impressions; a call is one batch, so divide by its size."""
    own = materialize(interactions.where(F.col("split") == split), "serving")
    parts = max(1, own.count() // batch)

    def call(k: int) -> int:
        some = own.where(F.pmod(F.xxhash64("impression_id"), F.lit(parts)) == k % parts)
        return recommend.prediction_lines(recommend.retrieval_scores(some, index)).count()

    out = serving_figures(call, range(calls))
    return out | {"batch": batch, "ms_per_impression": out["mean_ms"] / batch}


def main(argv: list[str]) -> None:
    spark = SparkSession.builder.appName("newsloom").getOrCreate()
    what, a, b, *rest = argv
    arts, inter = click_log.articles(spark.read.parquet(a)), materialize(click_log.interactions(spark.read.parquet(b)), "interactions")
    if what == "build":
        print(build(spark, arts, inter, rest[0]))
        return
    vectors, out = rest
    index = recommend.build_index(materialize(arts, "articles"), "vectors", vectors=spark.read.parquet(vectors))
    if what == "predict":
        predict(spark, inter, index, out)
    elif what == "serve":
        sinks.write_report(spark, serve(spark, inter, index), f"{out}/serving.json")
    else:
        raise SystemExit(__doc__)


if __name__ == "__main__":
    main(sys.argv[1:])
