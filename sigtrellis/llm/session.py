"""Session settings that the operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of text that a Python worker gets at once.
BATCH = 1_000
#: Bytes, as stored, for each part of a table that is known to be small.
PART = 1 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where it is unset and the master is local, so that there is one machine, one beside the warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")
    return context.getCheckpointDir()


def short_batches(spark: SparkSession) -> None:
    """Lets 1,000 rows at most go to a Python worker at once, unless the session asks for fewer.

    Texts are long: Spark's default of 10,000 rows holds tens of MB several times over in each worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))


def parts(*tables: DataFrame) -> int:
    """Parts that are enough for a table about as large as these, which ``table`` wrote: one for each core at least, and one for each ``PART`` bytes.

    Without Hadoop's native library, an executor starts several processes for each file that it writes to a local
    path, to set permissions; until such a process runs chmod, its memory is that of the executor and counts twice.
    """
    size = 0
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.path)
        size += path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-size // PART))


def table(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, and any executor may read it again.

    The shuffle files that made it go as soon as it is written, for nothing reads them any more.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf, clean = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(clean, "false")
    conf.set(clean, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(clean, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``table`` wrote and nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
