"""Durable tables: lineage is cut by files in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables that materialise() wrote in this driver and nobody deleted.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; an own one only where none is set and there is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), "boleflow-checkpoints")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage: write a table in the shared folder and read it back.

    A lost executor then costs a re-read, never a recomputation of what went before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> set[str]:
    return set(_WRITTEN)


def sweep(spark: SparkSession, before: set[str], keep: list[DataFrame]) -> None:
    """Deletes the tables that were written since written() said before, but for those of keep."""
    kept = {os.path.basename(os.path.dirname(f)) for t in keep for f in t.inputFiles()}
    for path in [p for p in _WRITTEN if p not in before and os.path.basename(p) not in kept]:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN[:] = [p for p in _WRITTEN if os.path.basename(p) != os.path.basename(path)]


def discard(table: DataFrame) -> None:
    """Deletes the files of a table that materialise() wrote and that nothing reads any more."""
    spark = table.sparkSession
    for f in {os.path.dirname(f) for f in table.inputFiles()}:
        if os.path.basename(f).startswith("table-"):
            _delete(spark, f)
