"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A hinted broadcast side never takes more than this; wider inputs are joined by shuffle.
BROADCAST_BYTES = 64 * 1024 * 1024

# Bytes of an id with its overhead; what a broadcast of selected ids is reckoned with.
ID_BYTES = 100

# Bytes of training rows per partition of a fit.
FIT_BYTES = 64 * 1024 * 1024


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a temporary one only for a local master without one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="semproxy-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the written rows."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder once and go on from the written rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, *metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` with aggregates that the next action on it computes on its way."""
    observation = Observation()
    return df.observe(observation, *metrics), observation


def drop_written(df: DataFrame) -> None:
    """Delete the files of a :func:`written` table that nothing reads any more."""
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if folder.rsplit(":", 1)[-1].lstrip("/") in path:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def is_small(rows: int, row_bytes: int = ID_BYTES) -> bool:
    return rows * row_bytes <= BROADCAST_BYTES


def small(df: DataFrame, rows: int, row_bytes: int = ID_BYTES) -> DataFrame:
    """Hint a broadcast when ``rows``, an upper bound of ``df``, times their width is small."""
    return F.broadcast(df) if is_small(rows, row_bytes) else df


# Tables written by bucketed(), by the plans that read them.
BUCKETED = "semproxy_bucketed_"


def bucketed(df: DataFrame, by: str) -> DataFrame:
    """Write ``df`` to the shared folder once, one file per bucket of ``by`` and sorted there, so
    that later joins on ``by`` shuffle only their other side."""
    spark = df.sparkSession
    name = f"{BUCKETED}{uuid.uuid4().hex}"
    count = shuffle_partitions(spark)
    placed = df.repartition(count, by).sortWithinPartitions(by)
    path = f"{checkpoint_dir(spark)}/{name}"
    placed.write.bucketBy(count, by).sortBy(by).format("parquet").option("path", path).saveAsTable(name)
    return spark.table(name)


def is_bucketed(df: DataFrame) -> bool:
    """Whether ``df`` is a table of :func:`bucketed`, perhaps with columns left out."""
    return BUCKETED in df._jdf.queryExecution().analyzed().toString()


def drop_bucketed(df: DataFrame) -> None:
    """Forget a table of :func:`bucketed` and delete its files."""
    spark = df.sparkSession
    plan = df._jdf.queryExecution().analyzed().toString()
    found = plan.index(BUCKETED)
    name = plan[found : found + len(BUCKETED) + 32]
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/{name}")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
