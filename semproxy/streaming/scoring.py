"""The cascade's stateless half over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from semproxy.functions.scoring import ProxyModel
from semproxy.operators.cascade import route, score_rows


def route_stream(
    stream: DataFrame, model: ProxyModel, reject: float = 0.2, accept: float = 0.8
) -> DataFrame:
    """Streaming rows with ``score`` and ``zone``; no state, so no watermark is needed."""
    if not stream.isStreaming:
        raise ValueError("route_stream needs a streaming DataFrame")
    return route(score_rows(stream, model), reject, accept)


def score_new_files(
    spark: SparkSession,
    source: str,
    schema: StructType,
    sink: str,
    checkpoint: str,
    model: ProxyModel,
    reject: float = 0.2,
    accept: float = 0.8,
    files_per_batch: int = 1000,
) -> DataFrame:
    """Score and route what has come into the ``source`` folder since the last run with this
    ``checkpoint``, then stop; returns all rows of the ``sink``.

    The checkpoint remembers the files read, the sink the batches written, so that every row is scored once
    whether runs follow each other or are cut off and started again. Batches hold a bounded number of
    files, so a run that finds many of them ends batch by batch."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    routed = route_stream(stream, model, reject, accept)
    run = (
        routed.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(routed.schema).parquet(sink)
