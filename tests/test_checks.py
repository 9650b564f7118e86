import math

import pytest

from semproxy.operators.checks import (
    candidate_violations,
    example_violations,
    label_violations,
    require_valid_candidates,
    require_valid_examples,
    require_valid_labels,
    selection_violations,
)
from tests.conftest import CANDIDATES, EXAMPLES


def candidates(spark, rows):
    return spark.createDataFrame(rows, CANDIDATES)


def test_clean_candidates(spark):
    rows = [("10", "a", [1.0, 2.0]), ("2", None, [0.0, 1.0])]
    assert require_valid_candidates(candidates(spark, rows))["n_rows"] == 2


@pytest.mark.parametrize(
    "row",
    [
        (None, "a", [1.0, 2.0]),
        ("b", "a", None),
        ("b", "a", [1.0, None]),
        ("b", "a", []),
        ("b", "a", [1.0]),
        ("a", "a", [1.0, 2.0]),
    ],
)
def test_bad_candidates(spark, row):
    table = candidates(spark, [("a", "a", [1.0, 2.0]), row])
    with pytest.raises(ValueError):
        require_valid_candidates(table)


def test_empty_candidates(spark):
    counts = candidate_violations(candidates(spark, [])).first()
    assert counts["n_rows"] == 0 and counts["min_width"] is None
    assert require_valid_candidates(candidates(spark, []))["n_rows"] == 0


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [("a", [1.0], 2)],
        [("a", [1.0], None)],
        [("a", [math.nan], 1)],
        [("a", [math.inf], 1)],
        [("a", [None], 1)],
        [("a", None, 1)],
        [("a", [], 1)],
        [("a", [1.0], 1), ("b", [1.0, 2.0], 0)],
    ],
)
def test_bad_examples(spark, rows):
    counts = example_violations(spark.createDataFrame(rows, EXAMPLES)).first().asDict()
    with pytest.raises(ValueError):
        require_valid_examples(counts)


def test_selection_counts(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("a",)], "id string")
    row = selection_violations(ids, 2).first()
    assert (row["n_rows"], row["duplicate_id"], row["over_budget"]) == (3, 1, 1)


def test_labels(spark):
    selected = spark.createDataFrame([("a",), ("b",)], "id string")

    def labeled(rows):
        return spark.createDataFrame(rows, "id string, label int")

    assert require_valid_labels(labeled([("b", 0), ("a", 1)]), selected, 2) == 2
    for rows in ([("a", 1)], [("a", 1), ("b", 0), ("c", 0)], [("a", 1), ("a", 1), ("b", 0)]):
        with pytest.raises(ValueError):
            require_valid_labels(labeled(rows), selected, 2)
    with pytest.raises(ValueError):
        require_valid_labels(labeled([("a", 1), ("b", None)]), selected, 2)
    with pytest.raises(ValueError):
        require_valid_labels(labeled([("a", 1), ("b", 1)]), selected, 1)
    twice = selected.unionByName(selected)
    with pytest.raises(ValueError):
        require_valid_labels(labeled([("a", 1), ("b", 1)]), twice, 4)
    none = label_violations(labeled([]), selected.limit(0)).first()
    assert none["selected"] == 0 and none["returned"] == 0
