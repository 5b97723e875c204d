"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemion.sources.staging import discard, setting, shared_dir, stage

__all__ = ["LOWER_BYTES", "SALTS", "UPPER", "bucket_of_id", "discard", "hashed_sample", "lower_ascii", "packed", "read", "salt", "schema", "setting", "shared_dir", "small_batches", "stage"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: bytes.translate table that lower-cases A-Z only; safe on UTF-8, whose other letters have no byte below 0x80.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Rows whose texts a worker handles at once.
ROWS = 512
#: Salts that spread the rows of one hot key.
SALTS = 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def packed(df: DataFrame) -> Column:
    """All columns of df as one."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def salt(c: Column, n: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def bucket_of_id(c: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id is in bucket 0."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(0))


def hashed_sample(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """About `rows` rows of df, at most twice as many: those whose hashed id is below a threshold set by the number of rows.

    Nothing is sorted or gathered to choose them. Meant for fitting models on a bounded sample.
    """
    n = df.count()
    if n <= rows:
        return df
    share = rows / n
    return df.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).limit(2 * rows)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so what is made of their texts at once is bounded. Workers outlive their tasks: freed memory goes back at the end."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()


def schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)
