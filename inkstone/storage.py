"""Tables that a plan uses more than once, in the folder that driver and executors share.

The folder is spark.checkpoint.dir. What is written there survives lost
executors, so they cost a stage and not a run; it is deleted when given up, or
when the driver exits.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What this process wrote, by path.
_owned: dict[str, tuple[object, object]] = {}


def _own(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    _owned[path] = (jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset and driver and executors are one process, as in tests, an own folder; on a
    cluster that is an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if not folder:
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="inkstone-")
    if not current.isDefined():
        sc.setCheckpointDir(folder)
        _own(spark, sc._jsc.sc().getCheckpointDir().get())  # the context's own subfolder
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, written to the shared folder and cut from its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _drop_owned() -> None:
    for fs, path in _owned.values():
        try:
            fs.delete(path, True)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            pass


atexit.register(_drop_owned)


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing stands at; what is written there is deleted when the driver exits."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _own(spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed Parquet table in the shared folder, read back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_written_to"] = path
    return out


def given_up(table: DataFrame) -> None:
    """Deletes a table of ``written`` that no later step reads; other tables are left alone."""
    path = table.__dict__.get("_written_to")
    if path in _owned:
        fs, jpath = _owned.pop(path)
        fs.delete(jpath, True)


#: Bytes that one core reads as one task.
_TASK_BYTES = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as there are cores, where its input is so small that its files may give fewer (a table of
    one row group is one task); else unchanged. For narrow work that is dear for each row."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * _TASK_BYTES else df
