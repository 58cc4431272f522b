"""Session helpers: shared working folder, materialised intermediates."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex[:12]
_used: dict[str, SparkSession] = {}


def work_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    It is the cluster's ``spark.checkpoint.dir``.  Only a local master may go without that setting;
    there a temporary folder of this machine serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.gettempdir()
    path = f"{base.rstrip('/')}/trellis-{_RUN}"
    if path not in _used:
        _used[path] = spark
        atexit.register(_remove, path, spark)
    return path


def _remove(path: str, spark: SparkSession) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:
        pass


_paths: dict[int, tuple[DataFrame, str]] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives a lost executor."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:10]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (out, path)
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once what was made of it is written itself; other frames are left alone."""
    _, path = _paths.pop(id(df), (None, None))
    if path is not None:
        _remove(path, df.sparkSession)
