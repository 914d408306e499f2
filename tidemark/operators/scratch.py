"""Tables written once in the folder that driver and executors share, so that later steps read them instead of computing them again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where that is unset and Spark runs in one process (tests)."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = context._jsc.sc().getCheckpointDir()
        folder = folder.get() if folder.isDefined() else None
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors and driver need a shared folder")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Rows of a file: a task reads 32 files at most by Spark's defaults (128 MB, each file opened counting as 4), so its rows
#: are bounded however well they compress.
FILE_ROWS = 50_000
#: Bytes of generated code that the JVM still compiles; a wide projection over them would be interpreted row by row.
CODE_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """df written and read back: it is computed once, its lineage is cut, and a lost executor loses nothing of it.
    batch_rows: at most so many rows go to a Python worker in one Arrow batch (None: as the session has it)."""
    path = scratch_path(df.sparkSession, name)
    conf, own = df.sparkSession.conf, dict([CODE_LIMIT])
    if batch_rows:
        own["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(batch_rows)
    before = {key: conf.get(key) for key in own}
    for key, value in own.items():
        conf.set(key, value)
    try:
        df.write.option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    finally:
        for key, value in before.items():
            conf.set(key, value)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; results that still read them become unreadable."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the folder that written() made for df; nothing may read it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if f"/tidemark/{spark.sparkContext.applicationId}/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
