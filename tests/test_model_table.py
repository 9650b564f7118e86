import numpy as np
import pytest
from pyspark.sql import functions as F

from semproxy.functions.scoring import ProxyModel
from semproxy.operators import model_table
from semproxy.operators.cascade import score_rows
from semproxy.operators.model_table import (
    append_versions,
    broadcast_versions,
    history_bytes,
    model_versions,
    score_as_of,
    with_model,
)

MODELS = [ProxyModel((float(i), -0.5), i / 4) for i in range(5)]


@pytest.fixture
def versions(spark):
    sent = [("run", 0, 0, MODELS[0]), ("run", 0, 3, MODELS[1]), ("run", 1, 2, MODELS[2]), ("other", 0, 1, MODELS[3])]
    return model_versions(spark, sent)


@pytest.mark.parametrize("bound", [model_table.BROADCAST_BYTES, 0])
def test_the_last_model_at_or_before_the_round(blobs, versions, bound, monkeypatch):
    monkeypatch.setattr(model_table, "BROADCAST_BYTES", bound)
    rows = blobs.select("id", "shard", "embedding", F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("round"))
    found = score_as_of(rows, versions, "run").collect()
    assert len(found) == 1500
    plain = {
        (number, r["id"]): r["score"]
        for number in (0, 1, 2)
        for r in score_rows(blobs.select("id", "embedding"), MODELS[number]).collect()
    }
    last = {0: [0, 0, 0, 3, 3], 1: [None, None, 2, 2, 2], 2: [None] * 5}
    which = {(0, 0): 0, (0, 3): 1, (1, 2): 2}
    for r in found:
        expected = last[r["shard"]][r["round"]]
        assert r["model_round"] == expected
        if expected is None:
            assert r["score"] is None
        else:
            assert np.isclose(r["score"], plain[which[r["shard"], expected], r["id"]], atol=1e-12)


def test_the_plan_holds_no_weights(blobs, versions, monkeypatch):
    rows = blobs.select("id", "shard", "embedding", F.lit(3).alias("round"))
    wide = ProxyModel((123.456789, 2.0), 0.0)
    path_free = versions.unionByName(versions.withColumn("run_id", F.lit("x"))).checkpoint()
    plan = score_as_of(rows, path_free, "run")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "0.5" not in plan and str(wide.weights[0]) not in plan
    monkeypatch.setattr(model_table, "BROADCAST_BYTES", 0)
    plan = with_model(rows, path_free, "run")._jdf.queryExecution().logical().toString()
    assert "strategy=broadcast" not in plan


def test_versions_are_written_once(spark, versions, tmp_path):
    path = str(tmp_path / "versions")
    append_versions(versions, path)
    more = append_versions(broadcast_versions(spark, "run", (0, 1), 5, MODELS[4]), path)
    assert more.count() == 6
    assert history_bytes(more, "run") == 5 * (2 * 8 + model_table.VERSION_BYTES)
    with pytest.raises(ValueError, match="there already"):
        append_versions(model_versions(spark, [("run", 0, 3, MODELS[0])]), path)
    with pytest.raises(ValueError, match="there already"):
        append_versions(model_versions(spark, [("new", 0, 3, MODELS[0])] * 2), path)
    assert more.count() == 6


def test_another_width_is_an_error(blobs, spark):
    wide = model_versions(spark, [("run", 0, 0, ProxyModel((1.0, 2.0, 3.0), 0.0))])
    rows = blobs.where("shard = 0").select("id", "shard", "embedding", F.lit(0).alias("round"))
    with pytest.raises(Exception, match="width"):
        score_as_of(rows, wide, "run").collect()
