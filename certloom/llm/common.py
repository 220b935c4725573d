"""Shared helpers of the training-data operators: row identity, checkpoints, checked broadcasts."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df: later reads survive lost executors and see one fixed set of rows.

    The folder is the session's spark.checkpoint.dir. Only a local master without that setting
    gets a temporary one.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def packed(df: DataFrame) -> Column:
    """All columns of df as one struct, so that working columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def text_hash(text: Column) -> Column:
    """With doc_id, the identity of a row: rows equal in both get equal results."""
    return F.xxhash64(text)


def hash128(value: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes; a collision of both is not expected below 10^15 values."""
    return F.xxhash64(value), F.xxhash64(F.lit(0x5851F42D), value)


def checked_broadcast(df: DataFrame, rows: int, most_rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound, else df as it is."""
    return F.broadcast(df) if rows <= most_rows else df


def skew_join(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str, total: int, most_hot: int = 2000) -> DataFrame:
    """rows joined with keyed (one row for each value of on), however many rows share a value.

    weight: keyed's column with a value's number of rows; total: that of all rows. Values with more
    than a share of 1 / most_hot are most_hot at most, so they are broadcast; the others are shuffled.
    """
    bound = max(1, total // most_hot)
    hot, rest = keyed.where(F.col(weight) > bound), keyed.where(F.col(weight) <= bound)
    common = rows.join(F.broadcast(hot), on)
    return common.unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds): the UTF-8 bytes of a column of texts or binaries end to end, nulls as empty."""
    raw = column.cast(pa.large_binary()).fill_null(b"")
    if not len(raw):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    return np.frombuffer(raw.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def byte_chars(text: Column) -> Column:
    """The UTF-8 bytes of text, one Latin-1 character a byte."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def ascii_fold(text: Column) -> Column:
    """A form of text that is equal for two texts if and only if they are after A-Z becomes a-z.

    lower() also folds letters outside ASCII. On the bytes as Latin-1 characters it moves lead
    bytes C3-DE to E3-FE; the number of continuation bytes that follow still tells the
    two-byte characters from longer ones, so different texts stay different.
    """
    return F.lower(byte_chars(text))
