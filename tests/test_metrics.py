import random

import pytest
from pyspark.sql import functions as F

from semproxy.operators import cascade, metrics
from semproxy.plans.sweep import evaluate_proxy


def make(n, seed, digits):
    rng = random.Random(seed)
    return [
        (f"{i}", rng.choice([0, 1, 1]), round(rng.random(), digits), rng.choice(["x", "x", "y"]))
        for i in range(n)
    ]


ROWS = make(400, 1, 1) + [("a", 1, 1.0, "x"), ("b", 0, 0.0, "y"), ("c", 1, 0.5, "y")]


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame(ROWS, "id string, label int, score double, run string").cache()


def ordered(rows):
    return sorted(rows, key=lambda r: (-abs(r[2] - 0.5), r[0]))


def right(row):
    return int((row[2] >= 0.5) == (row[1] == 1))


def curve(rows):
    kept, result = 0, []
    for n, row in enumerate(ordered(rows), 1):
        kept += right(row)
        result.append(kept / n)
    return result


def test_aurac_and_curve(scores):
    expected = sum(curve(ROWS)) / len(ROWS)
    assert metrics.aurac(scores).first()[0] == pytest.approx(expected, abs=1e-12)
    points = metrics.risk_coverage_curve(scores).orderBy("kept").collect()
    assert [p["id"] for p in points] == [r[0] for r in ordered(ROWS)]
    assert [p["accuracy"] for p in points] == pytest.approx(curve(ROWS))
    assert points[-1]["coverage"] == 1.0
    for row in metrics.aurac(scores, ["run"], 2).collect():
        mine = [r for r in ROWS if r[3] == row["run"]]
        assert row["aurac"] == pytest.approx(sum(curve(mine)) / len(mine), abs=1e-12)


def test_shuffle_partitions_do_not_matter(spark, scores):
    found = set()
    for number in ("8", "3", "31"):
        spark.conf.set("spark.sql.shuffle.partitions", number)
        found.add(
            (
                round(metrics.aurac(scores.repartition(5)).first()[0], 12),
                round(metrics.auc(scores).first()[0], 12),
            )
        )
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(found) == 1


def test_auc(scores):
    def expected(rows):
        pos = [r[2] for r in rows if r[1] == 1]
        neg = [r[2] for r in rows if r[1] == 0]
        won = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
        return won / (len(pos) * len(neg))

    assert metrics.auc(scores).first()[0] == pytest.approx(expected(ROWS))
    for row in metrics.auc(scores, ["run"]).collect():
        mine = [r for r in ROWS if r[3] == row["run"]]
        assert row["auc"] == pytest.approx(expected(mine))
    assert metrics.auc(scores.where("label = 1")).first()[0] is None


def test_published_oracle_values(spark):
    n = 20_000
    for share, published in ((0.808, 0.980), (0.674, 0.940)):
        row = spark.range(1).select(
            metrics.oracle_aurac(F.lit(n), F.lit(int(share * n))).alias("o")
        )
        assert row.first()["o"] == pytest.approx(published, abs=6e-4)


def test_harmonic(spark):
    values = spark.createDataFrame([(n,) for n in (0, 1, 2, 63, 64, 65, 1000)], "n long")
    for row in values.select("n", metrics.harmonic(F.col("n")).alias("h")).collect():
        exact = sum(1 / i for i in range(1, row["n"] + 1))
        assert row["h"] == pytest.approx(exact, abs=1e-13)


def test_naurac(scores):
    row = metrics.naurac(scores).first()
    n, k = len(ROWS), sum(r[1] for r in ROWS)
    ideal = (k + sum(k / i for i in range(k + 1, n + 1))) / n
    area = sum(curve(ROWS)) / n
    assert row["oracle_aurac"] == pytest.approx(ideal)
    assert row["naurac"] == pytest.approx((area - k / n) / (ideal - k / n))


def test_accuracy_at_budget(scores):
    n = len(ROWS)
    found = metrics.accuracy_at_budget(scores, (0, 1, 77, n, 10 * n), (0.1,)).collect()
    for row in found:
        escalated = row["escalated"]
        kept = ordered(ROWS)[: n - escalated]
        assert row["accuracy"] == pytest.approx((sum(map(right, kept)) + escalated) / n)
    assert {r["budget"]: r["escalated"] for r in found}[0.1] == n // 10


def test_call_reduction(scores):
    positives = sum(r[1] for r in ROWS)
    for row in metrics.call_reduction_at_fnr(scores, (0.0, 0.05, 0.3)).collect():
        allowed = [
            t
            for t in {r[2] for r in ROWS}
            if sum(r[1] for r in ROWS if r[2] < t) <= row["alpha"] * positives
        ]
        assert row["threshold"] == max(allowed)
        below = sum(r[2] < max(allowed) for r in ROWS)
        assert row["reduction"] == pytest.approx(below / len(ROWS))


def test_calibrated_band_escalates_what_it_counts(scores):
    for row in metrics.calibrate_band(scores, (0, 1, 50, 200, 10**6)).collect():
        inside = [r for r in ROWS if row["reject"] < r[2] < row["accept"]]
        assert len(inside) == row["escalations"] <= row["budget"]
        # One confidence level more would pass the budget.
        rest = [abs(r[2] - 0.5) for r in ROWS if r not in inside]
        if rest:
            level = sum(c <= min(rest) for c in rest)
            assert len(inside) + level > row["budget"]


def test_cascade_bounds_are_inclusive(spark):
    rows = [("a", 1, 0.2), ("b", 1, 0.8), ("c", 1, 0.5), ("d", 0, 0.9)]
    table = spark.createDataFrame(rows, "id string, label int, score double")
    narrow, wide = cascade.cascade_summary(table).collect()
    assert (narrow["escalations"], narrow["final_accuracy"]) == (1, 0.5)
    assert (wide["escalations"], wide["final_accuracy"]) == (3, 0.75)
    zones = {r["id"]: r["zone"] for r in cascade.route(table, 0.2, 0.8).collect()}
    assert zones == {"a": "reject", "b": "accept", "c": "escalate", "d": "accept"}


def test_evaluation_agrees_with_its_parts(scores):
    whole = evaluate_proxy(scores).first()
    assert whole["proxy_accuracy"] == metrics.proxy_accuracy(scores).first()[0]
    assert whole["aurac"] == pytest.approx(metrics.aurac(scores).first()[0])
    narrow, wide = cascade.cascade_summary(scores).collect()
    assert whole["band_02_escalations"] == narrow["escalations"]
    assert whole["band_01_final_accuracy"] == pytest.approx(wide["final_accuracy"])


def test_reports(scores):
    zones = cascade.zone_report(scores, 0.2, 0.8).collect()
    assert sum(z["mass"] for z in zones) == pytest.approx(1.0)
    separation = metrics.score_separation(scores).first()[0]
    pos = [r[2] for r in ROWS if r[1]]
    neg = [r[2] for r in ROWS if not r[1]]
    assert separation == pytest.approx(sum(pos) / len(pos) - sum(neg) / len(neg))
    certain = metrics.certainty_mass(scores).first()[0]
    assert certain == pytest.approx(sum(abs(r[2] - 0.5) >= 0.2 for r in ROWS) / len(ROWS))
    report = metrics.confusion_report(
        scores.withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    ).first()
    assert report["tp"] + report["fn"] == len(pos) and report["fp"] + report["tn"] == len(neg)


def test_seed_average(spark):
    rows = [("c1", "a", 1, 0.5), ("c1", "a", 2, 0.7), ("c1", "b", 1, 0.6), ("c1", "b", 2, 0.6)]
    rows += [("c2", "a", 1, 0.1), ("c2", "b", 1, 0.2)]
    table = spark.createDataFrame(rows, "cell string, setting string, seed int, m double")
    ranked, wins = metrics.seed_average(table, ["cell"], ["setting"], "m")
    best = {(r["cell"], r["setting"]): r["rank"] for r in ranked.collect()}
    assert best[("c2", "b")] == 1 and best[("c2", "a")] == 2
    assert sum(r["wins"] for r in wins.collect()) >= 2


def test_total_calls(spark):
    table = spark.createDataFrame([(300, 150)], "escalations long, labels long")
    row = cascade.total_calls(table).first()
    assert row["total_calls"] == 450
    assert (row["hosted_seconds"], row["server_seconds"]) == (6.0, 1.8)
    assert row["inprocess_seconds"] == 0.25
