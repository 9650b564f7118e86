"""Every query against DuckDB on the small tables."""

import glob
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

import __spark_entry__ as entry
from semproxy.operators import training
from semproxy.operators.propagation import ClusterPropagation

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


@pytest.fixture(scope="module")
def results(spark, request):
    """Schema and rows of every selected query; small jobs leave room to run some at once."""

    def run(name):
        frame = QUERIES[name](spark, SF_DIR)
        return frame.dtypes, frame.collect()

    names = [
        item.callspec.params["name"]
        for item in request.session.items
        if item.function is test_query
    ]
    pool = ThreadPoolExecutor(6)
    yield {name: pool.submit(run, name) for name in names}
    pool.shutdown(cancel_futures=True)


def normal(value):
    return "0.0" if value == 0 and isinstance(value, float) else repr(value)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def said(rows):
    return sorted([normal(r[c]) for c in sorted(r.asDict())] for r in rows)


def expected(database, name):
    """Types and rows of the oracle, in the order of column names."""
    answer = database.execute(ORACLES[name])
    columns = [c[0] for c in answer.description]
    kinds = {c[0]: str(c[1]) for c in answer.description}
    rows = [[normal(v) for _, v in sorted(zip(columns, r), key=lambda p: p[0])] for r in answer.fetchall()]
    return kinds, sorted(rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(results, database, name):
    types, rows = results[name].result()
    assert rows
    if name not in ORACLES:
        return
    kinds, values = expected(database, name)
    assert {n: TYPES[t] for n, t in types} == kinds
    assert said(rows) == values


def first_model(models, weighted=False):
    return models.limit(1)


@pytest.mark.parametrize(
    "name, place, broken",
    [
        ("gc2", (ClusterPropagation, "build"), lambda self, direct, pool, partition: direct),
        ("lc2", (ClusterPropagation, "build"), lambda self, direct, pool, partition: direct),
        ("lc3", (training, "average_models"), first_model),
        ("lc4", (training, "average_models"), first_model),
        ("federated_train", (training, "average_models"), first_model),
    ],
)
def test_oracles_notice_a_broken_step(spark, database, monkeypatch, name, place, broken):
    """Labels not spread, or models not averaged, give other rows than the oracle."""
    monkeypatch.setattr(*place, broken)
    assert said(QUERIES[name](spark, SF_DIR).collect()) != expected(database, name)[1]


def test_entry(spark):
    assert entry.entry(spark).count() == 2
