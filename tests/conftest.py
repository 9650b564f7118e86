import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__  # noqa: E402, F401


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("semproxy-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


CANDIDATES = "id string, text string, embedding array<float>"
EXAMPLES = "id string, embedding array<float>, label int"


@pytest.fixture(scope="session")
def blobs(spark):
    """300 rows around (+-1, +-1): the label is the sign of the first value; shard = row % 3."""
    import random

    rng = random.Random(5)
    rows = []
    for i in range(300):
        x, y = rng.choice((-1, 1)), rng.choice((-1, 1))
        vector = [x + rng.gauss(0, 0.3), y + rng.gauss(0, 0.3)]
        rows.append((f"r{i}", f"text {i}", vector, int(vector[0] > 0), i % 3))
    return spark.createDataFrame(rows, f"{CANDIDATES}, label int, shard int").cache()
