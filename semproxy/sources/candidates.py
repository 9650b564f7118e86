"""Reading candidate tables, labeled CSV files and embeddings; writing typed examples."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semproxy.config import DatasetSpec
from semproxy.operators.checks import require_valid_candidates
from semproxy.operators.labeling import fetch_by_ids
from semproxy.operators.prefix import running_totals
from semproxy.operators.topk import place_of_share, top_k
from semproxy.session import cut_lineage
from semproxy.sources.quoted_lines import file_order, read_records

# The sentiment words of the labeled CSV files.
SENTIMENT_LABELS = {"POSITIVE": 1, "NEGATIVE": 0}

# Values may span lines; a quote inside a quoted value is doubled.
CSV_OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true"}


def load_candidates(
    table: DataFrame, spec: DatasetSpec = DatasetSpec(), keep: tuple[str, ...] = ()
) -> DataFrame:
    """``(id, text, embedding)`` under standard names and types, plus the ``keep`` columns."""
    return table.select(
        F.col(spec.id_col).cast("string").alias("id"),
        F.col(spec.text_col).cast("string").alias("text"),
        F.col(spec.embedding_col).cast("array<float>").alias("embedding"),
        *keep,
    )


# Selections of at most so many ids are filtered by value, which the scan can push down.
PUSHED_IDS = 10_000


def selected_ids(
    table: DataFrame, ids: DataFrame, at_most: int, spec: DatasetSpec = DatasetSpec()
) -> list[str] | None:
    """The ids of a small selection, None where there may be many or their type has no literals."""
    kind = table.schema[spec.id_col].dataType
    if at_most > PUSHED_IDS or not isinstance(kind, (T.StringType, T.IntegralType)):
        return None
    return [row["id"] for row in ids.select("id").collect()]


def fetch_candidates(
    table: DataFrame,
    ids: DataFrame,
    at_most: int,
    spec: DatasetSpec = DatasetSpec(),
    keep: tuple[str, ...] = (),
    values: list[str] | None = None,
) -> DataFrame:
    """:func:`load_candidates` of the selected ids; ``at_most`` bounds them.

    The ``values`` of a small selection (see :func:`selected_ids`) become a filter on the id column
    in its own type, so that the scan skips row groups and decodes the texts of few others; a larger
    one is joined."""
    if values is None:
        values = selected_ids(table, ids, at_most, spec)
    if values is None:
        return fetch_by_ids(load_candidates(table, spec, keep), ids.select("id"), at_most)
    if not isinstance(table.schema[spec.id_col].dataType, T.StringType):
        values = [int(value) for value in values]
    return load_candidates(table.where(F.col(spec.id_col).isin(values)), spec, keep)


def load_embeddings_only(
    table: DataFrame, spec: DatasetSpec = DatasetSpec(), keep: tuple[str, ...] = ()
) -> DataFrame:
    """The pruned pool: ids and embeddings, so that the text column is never read."""
    return table.select(
        F.col(spec.id_col).cast("string").alias("id"),
        F.col(spec.embedding_col).cast("array<float>").alias("embedding"),
        *keep,
    )


def sentiment_label(sentiment: Column) -> Column:
    """Sentiment word to 0/1; any other value is an error."""
    label = F.when(F.lit(False), F.lit(None).cast("int"))
    for word, value in SENTIMENT_LABELS.items():
        label = label.when(sentiment == word, value)
    message = F.concat(F.lit("unknown sentiment: "), F.coalesce(sentiment, F.lit("NULL")))
    return label.otherwise(F.raise_error(message).cast("int"))


def read_labeled_csv(
    spark: SparkSession,
    path: str,
    text_col: str = "reviewText",
    sentiment_col: str = "scoreSentiment",
    multi_line: bool = False,
) -> DataFrame:
    """``(row_index, text, label)`` with 0-based positions in file order.

    Files are read in blocks by many tasks, also where quoted values span lines (see
    :mod:`semproxy.sources.quoted_lines`); quotes stand around whole values and are doubled inside.
    Every file has the same header line. ``multi_line`` is for files with quotes inside unquoted
    values: Spark's own reader then makes a file one task, whatever its size.
    """
    if multi_line:
        return _read_whole_files(spark, path, text_col, sentiment_col)
    records = read_records(spark, path)
    columns, found = [], records.where("number = 0").select("file", "text").groupBy("text").agg(F.min("file").alias("file"))
    heads = found.orderBy("file").limit(2).collect()
    if len(heads) > 1:
        raise ValueError(f"{heads[1]['file']} has another header than {heads[0]['file']}")
    if heads:
        columns = next(csv.reader([heads[0]["text"].removeprefix("\ufeff")]))
    for name in (text_col, sentiment_col):
        if name not in columns:
            raise ValueError(f"no column {name!r} at {path}")
    schema = ", ".join("`" + name.replace("`", "``") + "` string" for name in columns)
    values = F.from_csv("text", schema, CSV_OPTIONS)
    rows = records.where("number > 0").select("row_index", values.alias("v"))
    return rows.select(
        "row_index", F.col(f"v.`{text_col}`").alias("text"), sentiment_label(F.col(f"v.`{sentiment_col}`")).alias("label")
    )


def _read_whole_files(spark: SparkSession, path: str, text_col: str, sentiment_col: str) -> DataFrame:
    """The rows by Spark's multi-line reader. The parsed rows are written once, so that positions
    and rows see the same numbering; files are numbered by a prefix sum over their row counts."""
    reader = spark.read.option("header", True).option("enforceSchema", False).options(**CSV_OPTIONS)
    columns = reader.csv(path).columns
    schema = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    parsed = cut_lineage(
        reader.schema(schema)
        .csv(path)
        .select(
            F.col("_metadata.file_path").alias("_file"),
            F.monotonically_increasing_id().alias("_row"),
            F.col(text_col).alias("text"),
            sentiment_label(F.col(sentiment_col)).alias("label"),
        )
    )
    files = parsed.groupBy("_file").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    files = running_totals(files, file_order(F.col("_file")), ["_rows"])
    start = F.col("run__rows") - F.col("_rows")
    return parsed.join(files.select("_file", "_first", start.alias("_start")), "_file").select(
        (F.col("_start") + F.col("_row") - F.col("_first")).alias("row_index"), "text", "label"
    )


def attach_embeddings(
    embeddings: DataFrame,
    labeled: DataFrame,
    position: str = "position",
    maximum_rows: int | None = None,
) -> DataFrame:
    """Labeled candidates for the first ``maximum_rows`` embeddings by ``position``.

    ``embeddings`` holds ``(position, row_index, embedding)``. An embedding without a labeled
    row is an error. The id is the decimal row index.
    """
    chosen = embeddings
    if maximum_rows is not None:
        low, high = embeddings.agg(F.min(position), F.max(position)).first()
        place = place_of_share(F.col(position), low or 0, (high or 0) + 1)
        chosen = top_k(embeddings, [F.col(position).asc()], maximum_rows, place)
    missing = F.raise_error(
        F.concat(F.lit("no labeled row with index "), F.col("row_index").cast("string"))
    )
    return chosen.join(labeled.withColumn("_found", F.lit(True)), "row_index", "left").select(
        F.when(F.col("_found"), F.col("row_index").cast("string"))
        .otherwise(missing.cast("string"))
        .alias("id"),
        "text",
        "embedding",
        "label",
        position,
    )


def write_examples(df: DataFrame, path: str) -> DataFrame:
    """Check and write a typed example table; returns the written table."""
    require_valid_candidates(df, unique_ids=True, text_required=True)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
