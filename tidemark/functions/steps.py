"""Intermediate results in the folder that the cluster shares: lineage is cut, and lost executors lose nothing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares: spark.checkpoint.dir. Where that is unset, a new local one for a local master, as in tests; on a
    cluster, whose executors have folders of their own, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.step_path = path
    if _steps is not None:
        _steps.append(out)
    return out


_steps: list[DataFrame] | None = None  #: within settled(): what was materialized since it began


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """materialize(make()), without the steps that it took to make it."""
    global _steps
    outer, _steps = _steps, []
    try:
        out = materialize(make())
    finally:
        made, _steps = _steps, outer
    for step in made[:-1]:
        discard(step)
    if _steps is not None:
        _steps.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Deletes the folder of a materialize()d df that nothing needs any more, if it is still there."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.step_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
