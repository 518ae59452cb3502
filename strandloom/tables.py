"""Tables that operators with rounds keep in between, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a local session gets a new one; on a cluster it has to be set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_MADE: set[str] = set()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that isn't in use, below a folder of this application that goes when the session's JVM ends."""
    own = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    if own not in _MADE:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _MADE.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str = "round") -> DataFrame:
    """`df` as Parquet in the shared folder, read again: cuts lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables that `kept` wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for p in folders:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of input files for each task of `by_size`, and the most tasks.
TASK_BYTES, MOST_TASKS = 8 << 20, 50_000


def by_size(df: DataFrame, *keys: str | Column, of: DataFrame | None = None) -> DataFrame:
    """`df` dealt by keys to a task for each TASK_BYTES of the files that `of` (else `df`) is read from, so that a task's
    memory doesn't grow with them. Small tables take the session's partitions."""
    leaves = (of or df)._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    n = min(sum(x for x in sizes if x < 1 << 60) // TASK_BYTES, MOST_TASKS)  # more stands for unknown
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df.repartition(*keys)
