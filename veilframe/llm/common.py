"""What the operators share: bounded Arrow batches, bit sets, column access, and tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.session import prepare
from veilframe.session import shared_dir as checkpoint_dir
from veilframe.session import written as write_table

__all__ = ["CHUNK_CHARS", "bit_set", "checkpoint_dir", "col", "lowest", "pieces", "prepare", "read_documents", "release_memory", "slices", "spread_join", "write_table"]

#: Characters of text that one Python step works on at a time.
CHUNK_CHARS = 1 << 20


def col(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pieces(texts: list, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of a list of strings that hold about limit characters each; a longer string is alone."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def slices(batch: pa.RecordBatch, column: int, limit: int = 4 * CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch whose values of a string or binary column hold about limit bytes each."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    yield batch.slice(start)


def lowest(hashed: Column, share: float) -> Column:
    """Whether a 64-bit hash is in the lowest share of all: about that share of the keys, the same ones each time.

    A sample of n rows is taken from a share a little larger, so that no task sends n rows of its own to be ranked.
    """
    return F.lit(True) if share >= 1 else hashed < int(-(2.0**63) + share * 2.0**64)


def release_memory() -> None:
    """Gives freed memory back to the system: a Python worker lives on, beside others, when its task is over."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: Rows of a key from which a join deals them to several tasks, and how many such keys are told apart at most: with
#: more, each of the others has less than this share of all rows.
HOT, MOST_HOT = 512, 1 << 16


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], counted: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row for each of keys; keys that many rows of left have are dealt by a salt.

    The salt comes from the columns of by. right's row of such a key is repeated for each salt. counted has the rows
    of left to be counted by keys (left itself, unless it costs too much to be made twice).
    """
    counts = (left if counted is None else counted).groupBy(*keys).agg(F.count("*").alias("rows_of_key")).where(F.col("rows_of_key") > HOT)
    hot = counts.orderBy(F.desc("rows_of_key"), *keys).limit(MOST_HOT).toArrow()  # MOST_HOT bounds it
    if not hot.num_rows:
        return left.join(right, keys, how)
    salts = left.sparkSession.createDataFrame(hot).select(*keys, F.ceil(F.col("rows_of_key") / HOT).cast("int").alias("salts"))
    salted = left.join(F.broadcast(salts), keys, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    repeated = right.join(F.broadcast(salts), keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return salted.join(repeated, [*keys, "salt"], how).drop("salt")


def bit_set(places: DataFrame, bits: int) -> np.ndarray:
    """2 ** bits bits as bytes, lowest first, with those of places (at, from 0) set: bounded whatever the input."""
    size = 1 << 15  # of the maps that Spark builds
    rows = places.groupBy(F.shiftright("at", 15).alias("k")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(size - 1).cast("long")).alias("m")).collect()
    out = np.zeros(max(1 << bits, size) // 8, np.uint8)
    for r in rows:
        out[r.k * size // 8 : (r.k + 1) * size // 8] = np.frombuffer(bytes(r.m), np.uint8)
    return out
