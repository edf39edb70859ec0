"""Tables written to the shared folder: cut lineage that outlives executors."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of the open ``scratch`` blocks, the innermost last.
_open: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where it is unset, one machine (a local master, as in tests) gets a fresh
    folder; on a cluster that is an error, as executors would write to disks of
    their own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: tables between steps need a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{shared_dir(spark)}/quillstone-{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clean_up(spark: SparkSession) -> None:
    """Deletes every table that this application wrote in between; call it when no result is read any more."""
    remove(spark, run_dir(spark))


@contextmanager
def scratch(spark: SparkSession):
    """Tables written in the block go at its end: what is wanted of them must have been written elsewhere."""
    path = f"{run_dir(spark)}/scratch-{uuid.uuid4().hex}"
    _open.append(path)
    try:
        yield
    finally:
        _open.remove(path)
        remove(spark, path)


def table_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    return f"{_open[-1] if _open and not lasting else run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives
    lost executors, and gives the planner the table's true size.  A ``lasting``
    table outlives the ``scratch`` block."""
    spark = df.sparkSession
    path = table_path(spark, name, lasting)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
