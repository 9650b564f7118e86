from semproxy.operators.training import LogisticTrainer
from semproxy.plans.presets import STRATEGIES
from semproxy.plans.sweep import (
    PRESETS,
    REPORT_COLUMNS,
    SweepRun,
    run_sweep,
    sweep_grid,
    write_sweep_report,
)


def test_grid_sizes():
    assert len(sweep_grid(**PRESETS["full"])) == 135
    assert len(sweep_grid(**PRESETS["sample"])) == 9
    assert len(sweep_grid(**PRESETS["loader-benchmark"])) == 6
    assert len(sweep_grid(**PRESETS["uncertainty-centers"])) == 162
    runs = sweep_grid(**PRESETS["uncertainty-centers"])
    assert len({run.run_id for run in runs}) == len(runs)


def test_report(spark, blobs, tmp_path):
    grid = [
        SweepRun("random", "direct", 12, 2, 0.5, 0.2, 0.8),
        SweepRun("cluster", "cluster_propagation", 8, 1),
    ]
    pool, gold = blobs.select("id", "text", "embedding"), blobs.select("id", "label")
    report = run_sweep(pool, gold, grid, "blobs", 3, LogisticTrainer(l2=1.0, max_iter=15))
    written = write_sweep_report(report, str(tmp_path / "report"))
    assert tuple(written.columns) == REPORT_COLUMNS and len(REPORT_COLUMNS) == 45
    rows = {r["sampler"]: r for r in written.collect()}
    random_run, cluster_run = rows["random"], rows["cluster"]
    assert random_run["phase_a_labels"] == 12 and cluster_run["phase_a_labels"] <= 8
    assert random_run["rows"] == 300 and random_run["embedding_dimensions"] == 2
    for row in rows.values():
        calls = row["phase_a_labels"] + row["band_02_escalations"]
        assert row["band_02_total_calls"] == calls
        assert abs(row["band_02_hosted_75rps_seconds"] - calls / 75) < 1e-9
        assert 0.5 < row["proxy_accuracy"] <= 1.0
        assert row["initial_matrix_copy_ms"] is None
    assert random_run["recursive_training_ms"] > 0 == cluster_run["recursive_training_ms"]


def test_strategy_names():
    assert {"random", "recursive", "gc1", "gc2", "gc1rec", "gc2rec"} <= set(STRATEGIES)
    assert {f"lc{i}{s}" for i in range(1, 5) for s in ("", "rec")} <= set(STRATEGIES)
