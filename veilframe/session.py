"""The session: importable workers, the shared folder, options."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and all of it runs on this machine.
LOCAL_SHARED = "/tmp/checkpoints"
_WRITTEN: list[str] = []


@dataclass(frozen=True)
class Options:
    """What a run may set: a mapping's session and salt, terms to leave alone, the least confidence, passthrough."""

    session: str = "default"
    salt: str = ""
    whitelist: tuple[str, ...] = field(default_factory=tuple)
    least_confidence: float = 0.0
    passthrough: bool = False


#: Rows and bytes of the Arrow batches that go to Python workers: what a worker and its executor hold at a time.
BATCH_ROWS, BATCH_BYTES = 4000, "8m"


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches, and lets Python workers on this machine import the package from where the driver has it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if (root := str(Path(__file__).resolve().parents[1])) not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without spark.checkpoint.dir there is one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or LOCAL_SHARED).rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which clean() deletes."""
    path = f"{shared_dir(spark)}/veilframe/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


#: Bytes of a scan up to which its rows are dealt to all cores, however few row groups it has.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small scan dealt to all cores: a file of one row group would else be the work of one. Larger ones stay."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Deletes the intermediate tables, archives and stream folders of this process, once no frame needs them any more."""
    n = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
