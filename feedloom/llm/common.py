"""Shared pieces of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.session import scratch_path, ship_package

#: Rows up to which a side that was counted is broadcast; beyond it Spark shuffles.
BROADCAST_ROWS = 20_000
#: The same for a column of ids alone (8 bytes each).
IDS = 200_000
#: Bits of a membership bitmap: 1 MB, whatever the number of keys.
BITMAP_BITS = 1 << 23


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table by Spark's own reader (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared checkpoint folder; the table read back and its path."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def table(df: DataFrame) -> DataFrame:
    return written(df)[0]


def forget(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that no later plan reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when a count of the (already written) table is within ``rows``."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def bitmap_of(hashes: DataFrame, col: str) -> np.ndarray:
    """Membership bitmap of the 64-bit hashes in ``col``.

    Its size is fixed (BITMAP_BITS), so it may go to every task whatever the
    number of hashes: a full bitmap only lets more rows through to the exact
    join that always follows.
    """
    words = BITMAP_BITS // 64
    rows = (hashes.where(F.col(col).isNotNull())
            .groupBy(F.expr(f"cast(shiftrightunsigned({col}, 6) & {words - 1} as int)").alias("w"))
            .agg(F.expr(f"bit_or(shiftleft(1L, cast({col} & 63 as int)))").alias("bits")).toArrow())
    out = np.zeros(words, np.int64)
    out[rows["w"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    h = hashes.view(np.uint64) if hashes.dtype != np.uint64 else hashes
    word = bitmap[((h >> np.uint64(6)) & np.uint64(len(bitmap) - 1)).astype(np.int64)]
    return ((word >> (h & np.uint64(63))) & np.uint64(1)).astype(bool)


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str],
                most: int | None = None) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``keys`` of a partition sorted by them, run by run.

    With ``most`` a long run comes in several pieces of at least that many
    rows; the caller recognises them by the equal key.
    """
    held: list[pa.RecordBatch] = []

    def key_of(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(batch.schema.get_field_index(k))[i].as_py() for k in keys)

    def cuts(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and (key_of(held[-1], held[-1].num_rows - 1) != key_of(batch, 0)
                     or most and sum(b.num_rows for b in held) >= most):
            yield pa.Table.from_batches(held)
            held = []
        at = 0
        for c in cuts(batch).tolist():
            held.append(batch.slice(at, c - at))
            yield pa.Table.from_batches(held)
            held, at = [], c
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)
