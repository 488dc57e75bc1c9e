"""The shared folder for checkpoints, stream state and tables between stages.

On a cluster the folder is the one named in ``spark.checkpoint.dir``; all executors see it, so work survives the loss of any of them.
Only a local session without that setting gets a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_paths: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one for a local master without it; an error for a cluster without it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return f"file://{_local[app]}"


def new_path(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that nothing else uses. A local one is removed when the driver's Python ends, any by clean()."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _paths.setdefault(spark.sparkContext.applicationId, []).append(path)
    if path.startswith("file:"):
        atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
    return path


def clean(spark: SparkSession) -> int:
    """Delete what this application has written below the shared folder, on any file system; for long sessions, once no frame that reads it is needed. Returns the number of paths."""
    paths = _paths.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: partitions and the order within them stay as they are, the lineage ends here."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(f"{shared_dir(df.sparkSession)}/rdd")
    return df.checkpoint(eager=True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
