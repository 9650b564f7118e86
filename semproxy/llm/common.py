"""Helpers the document operators share: scratch tables, column names, words of a text."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semproxy.session import scratch_path

# Fixed byte classes: the white space that ends plain words, and the folding of index words.
WHITE_SPACE = bytes([0x20, *range(0x09, 0x0E)])
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20
    for b in range(256)
)

# The same two kinds of words as patterns.
PLAIN_WORD = r"[^\x20\x09-\x0D]+"
INDEX_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# A hinted broadcast side is measured first and never larger than this.
BROADCAST_BYTES = 32 * 1024 * 1024


def plain_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space (``bytes.split`` knows exactly these six bytes)."""
    return text.split()


def index_words(text: bytes) -> list[bytes]:
    """Lower-cased words of letters, digits and everything beyond ASCII."""
    return text.translate(FOLD).split()


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and go on from the written rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, row_bytes: int) -> DataFrame:
    """Hint a broadcast of a written table when its counted rows are small enough.

    Above the bound there is no hint and the join shuffles both sides."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def bytes_of(value: Column, kind: T.DataType) -> Column:
    """Bytes a value takes, with 16 for every string, array and struct; NULL takes 16."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        found = F.octet_length(value) + 16
    elif isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            sizes = F.transform(value, lambda x: bytes_of(x, kind.elementType).cast("long"))
            found = F.aggregate(sizes, F.lit(16).cast("long"), lambda total, x: total + x)
        else:
            found = F.size(value) * 8 + 16
    elif isinstance(kind, T.StructType):
        found = sum((bytes_of(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    else:
        found = F.lit(8)
    return F.coalesce(found, F.lit(16)).cast("long")


def weighed(df: DataFrame) -> DataFrame:
    """Hint a broadcast of a written table when its true bytes, arrays and all, are few enough.

    Above the bound there is no hint and the join shuffles both sides."""
    sizes = [bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    taken = df.agg(F.sum(sum(sizes, F.lit(16).cast("long")))).first()[0] or 0
    return F.broadcast(df) if taken <= BROADCAST_BYTES else df


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Column names like ``names`` that do not clash with the ``taken`` ones in any case."""
    used = {name.lower() for name in taken}
    found = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        found.append(name)
    return found


def quoted(names: Iterable[str]) -> list[Column]:
    """Columns by their whole names, with dots and other signs in them."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in names]


def text_bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
