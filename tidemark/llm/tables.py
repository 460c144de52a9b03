"""Tables that outlive a lost executor: written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a measured side may be broadcast; beyond either, the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20
#: Narrow rows that a task takes where their number is known.
TASK_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset and the session runs in one process."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


def saved(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df, computed once and kept as Parquet in the shared folder; rows, where they are known, set the number of tasks and files."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(1 + rows // TASK_ROWS)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_in = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete saved tables that nothing will read again."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.saved_in)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished queries, which it does when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def small(df: DataFrame, row_bytes: int | Column) -> DataFrame:
    """A saved table with the broadcast hint if its rows and the sum of row_bytes stay under the bounds, else as it is; a Column measures rows that hold arrays."""
    if isinstance(row_bytes, int):
        n = df.count()
        size = n * row_bytes
    else:
        n, size = df.agg(F.count("*"), F.coalesce(F.sum(row_bytes), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def fresh(name: str, df: DataFrame) -> str:
    """A column name that df has not, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
