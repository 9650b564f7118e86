import uuid

import pytest
from pyspark.sql import functions as F

from semproxy.operators.labeling import AnswerLog, FunctionLabeler


@pytest.fixture
def rows(spark):
    return spark.range(100).select(F.col("id").cast("string").alias("id"), F.lit("text").alias("text"))


def broken_once(folder, bad):
    """A labeler function that writes down every call and fails at one id while a file is there."""
    (folder / "broken").write_text("")

    def label(row):
        with open(folder / f"calls-{row.id}", "a") as file:
            file.write("x")
        if row.id == bad and (folder / "broken").exists():
            raise RuntimeError("the model is down")
        return int(row.id) % 2

    return label


@pytest.mark.parametrize("tasks", [1, 4])
def test_a_killed_task_buys_finished_batches_once(rows, tmp_path, tasks):
    labeler = FunctionLabeler(broken_once(tmp_path, "57"), tasks, uuid.uuid4().hex, batch=5)
    with pytest.raises(Exception, match="the model is down"):
        labeler.label(rows).collect()
    (tmp_path / "broken").unlink()
    before = {p.name: len(p.read_text()) for p in tmp_path.glob("calls-*")}
    assert 0 < len(before) < 100 or tasks > 1
    found = labeler.label(rows.repartition(7)).collect()
    assert {r["id"]: r["label"] for r in found} == {str(i): i % 2 for i in range(100)}
    calls = {p.name: len(p.read_text()) for p in tmp_path.glob("calls-*")}
    assert len(calls) == 100
    # Only answers of the batch that was cut off are bought again.
    assert sum(n > 1 for n in calls.values()) <= 5 * tasks
    assert calls["calls-57"] == 2


def test_answers_serve_later_selections(rows, tmp_path):
    name = uuid.uuid4().hex
    first = FunctionLabeler(lambda row: 1, 3, name).label(rows.where("id < 50"))
    assert first.count() == 50
    later = FunctionLabeler(lambda row: 0, 3, name).label(rows)
    assert {r["label"]: r["count"] for r in later.groupBy("label").count().collect()} == {0: 50, 1: 50}


def test_half_written_batches_do_not_count(tmp_path):
    log = AnswerLog(str(tmp_path / "log"))
    log.write(0, {"a": 1})
    (tmp_path / "log" / "0" / "x.part").write_text('{"b"')
    assert log.read(0) == {"a": 1} and log.read(1) == {}


def test_without_a_log_nothing_is_kept(rows):
    found = FunctionLabeler(lambda row: 1).label(rows)
    assert found.agg(F.sum("label")).first()[0] == 100
    with pytest.raises(ValueError):
        FunctionLabeler(lambda row: 1, batch=0)
