"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A key's hash seeds a linear congruential sequence of jumps; the last jump below the shard count is the
shard. No ring table is kept, and one more shard takes rows only into itself, an even share of each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import col, write_table

#: Fixed values of the published algorithm.
MULTIPLIER = 2862933555777941757
INCREMENT = 1
SCALE = float(1 << 31)
#: Chunks of a shard at least, and the rows of a chunk from which there are more.
LEAST_CHUNKS, CHUNK_ROWS = 64, 1 << 20


def jump_hash(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard numbers of 64-bit keys, all at once: each round moves the keys that still jump."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    state = np.asarray(keys).astype(np.uint64, copy=True)
    shard = np.zeros(len(state), dtype=np.int64)
    alive = np.arange(len(state))
    while len(alive):
        state[alive] = state[alive] * np.uint64(MULTIPLIER) + np.uint64(INCREMENT)
        step = SCALE / ((state[alive] >> np.uint64(33)).astype(np.float64) + 1.0)
        to = ((shard[alive] + 1).astype(np.float64) * step).astype(np.int64)
        on = to < n_shards
        alive = alive[on]
        shard[alive] = to[on]
    return shard.astype(np.int32)


def assign_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", chunks: int = LEAST_CHUNKS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row for each row of docs.

    The shard depends on the key and n_shards alone. size is the text's UTF-8 bytes plus 16. Slots number a
    shard's rows from 0 without gaps: rows are numbered within chunks of a shard, and a chunk starts where the
    ones before it end, so that no task sorts a whole shard and a repeated key is spread over the chunks. A chunk has
    about chunk_rows rows at most, so there are more than chunks of them where there are more rows.

    A null text has no bytes (size 16, CRC of nothing: 0); a null key hashes like any other value. Repeated rows
    each get a slot of their own. Other columns are ignored.
    """
    spark = docs.sparkSession

    @F.pandas_udf("shard int, grown_shard int")
    def place(key: pd.Series) -> pd.DataFrame:
        hashed = key.to_numpy(dtype=np.int64).view(np.uint64)
        return pd.DataFrame({"shard": jump_hash(hashed, n_shards), "grown_shard": jump_hash(hashed, n_shards + 1)})

    body = F.coalesce(col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(
        col(id_col).alias("doc_id"),
        (F.octet_length(body) + F.lit(16)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.monotonically_increasing_id().alias("rid"),
        F.xxhash64(col(id_col)).alias("key"),
    )
    placed = rows.withColumn("p", place("key")).select("doc_id", "size", "text_crc32", "rid", F.col("p.shard").alias("shard"), F.col("p.grown_shard").alias("grown_shard"))
    placed = write_table(placed, "shards")
    chunks = max(chunks, -(-placed.count() // (n_shards * chunk_rows)))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "rid"), F.lit(chunks)).cast("int"))
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "chunk").orderBy("doc_id", "rid")
    # starts has a row for each chunk: 2560 at 40 shards, or one for each chunk_rows rows
    numbered = placed.withColumn("at", F.row_number().over(within) - 1).join(F.broadcast(starts), ["shard", "chunk"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("at")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, n_shards: int, id_col: str = "doc_id", files_per_shard: int = 1) -> None:
    """Writes docs as Parquet, a folder shard=K for each shard, files_per_shard files in each."""

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(key.to_numpy(dtype=np.int64).view(np.uint64), n_shards))

    kept = docs.drop("shard") if "shard" in docs.columns else docs
    out = kept.withColumn("shard", place(F.xxhash64(col(id_col))))
    salt = F.pmod(F.xxhash64(col(id_col), F.lit("file")), F.lit(files_per_shard))
    out.repartition(n_shards * files_per_shard, "shard", salt).write.partitionBy("shard").parquet(path)
