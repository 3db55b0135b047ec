"""What the passes over a whole split join by broadcast, as that passes through the driver's memory."""

import re

import pytest

import __spark_entry__
from newsloom import shared


@pytest.mark.parametrize("name", ["prediction_pass", "evaluation_report"])
def test_index_and_scores_broadcast_no_terms_and_no_rows(spark, sf, name, monkeypatch):
    plans = {}

    def store(df, path, *partition_by):
        plans[re.sub("-[0-9a-f]+$", "", path.rsplit("/", 1)[1])] = df._jdf.queryExecution().executedPlan().toString()
        return shared_store(df, path, *partition_by)

    shared_store = shared.store
    monkeypatch.setattr(shared, "store", store)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    try:
        df = __spark_entry__.queries()[name](spark, sf)
        if name == "prediction_pass":
            plans["result"] = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert {"interactions", "articles", "postings", "vectors", "scored"} <= set(plans)
    for table in {"interactions", "articles", "postings", "vectors", "terms", "scored", "result"} & set(plans):
        keys = {k for line in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plans[table]) for k in re.findall(r"[a-z_]+(?=#)", line)}
        assert keys <= {"field", "vec_id"}, table  # a mean length a field, and the stored embeddings
