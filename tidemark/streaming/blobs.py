"""A store of recordings kept for inspection, as the sink of a stream: quotas, shared blobs and their references.

The state after micro-batch n is a table of its own under the store, made from the state after n - 1 and the batch alone. So a batch that comes again, after a failure or a restart, writes the
same table in the same place, and nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import folds as D

ENTRIES = "history_id string, status string, blob_id string, size_bytes bigint, filename string"
#: Bytes of one file and of all.
MOST_ONE, MOST_ALL = 1 << 30, 10 << 30


def entries(spark: SparkSession, store: str, batch_id: int) -> DataFrame:
    """history_id, status (available, file_too_large or storage_quota), blob_id, size_bytes, filename after a batch; before the first one there are none."""
    if batch_id < 0:
        return spark.createDataFrame([], ENTRIES)
    return spark.read.schema(ENTRIES).parquet(f"{store}/batch={batch_id}")


def after(state: DataFrame, events: DataFrame, most_one: int = MOST_ONE, most_all: int = MOST_ALL) -> DataFrame:
    """The entries after events (seq, kind, history_id, of, size_bytes, filename): purges first, then captures in order, then retries.

    A capture of an entry that has a blob changes nothing, and of several captures of one entry the first counts; a file above most_one, or for which there is no room, is turned away. A
    retry shares the blob of the entry `of`, if that has one. A blob's room is free when no entry refers to it any more.
    """
    gone = events.where("kind = 'purge'").select("history_id").distinct()
    left = state.join(gone, "history_id", "left_anti")
    used = left.where("blob_id is not null").groupBy("blob_id").agg(F.min("size_bytes").alias("size_bytes")).agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    have = left.where("blob_id is not null").select("history_id")
    first = F.min(F.struct("seq", "size_bytes", "filename")).alias("c")
    new = events.where("kind = 'capture'").groupBy("history_id").agg(first).join(have, "history_id", "left_anti").select(F.lit(0).alias("all"), "history_id", "c.*")
    fits = F.col("size_bytes") <= most_one
    if used + (new.where(fits).agg(F.sum("size_bytes")).first()[0] or 0) <= most_all:
        taken = new.withColumn("admitted", fits)
    else:  # room is shared by all, so captures stream through one fold, a micro-batch of them
        taken = new.join(D.quota(new, ["all"], "seq", "size_bytes", most_one, most_all - used), ["all", "seq"])
    blob = F.when(F.col("admitted"), F.sha2(F.concat_ws(":", "history_id", "seq"), 256))
    status = F.when(F.col("admitted"), "available").when(F.col("size_bytes") > most_one, "file_too_large").otherwise("storage_quota")
    taken = taken.select("history_id", status.alias("status"), blob.alias("blob_id"), "size_bytes", "filename")
    now = left.join(taken.select("history_id"), "history_id", "left_anti").unionByName(taken)
    again = events.where("kind = 'retry'").groupBy("history_id").agg(F.min(F.struct("seq", "of")).alias("r")).select("history_id", "r.of")
    shared = again.join(now.where("blob_id is not null").withColumnRenamed("history_id", "of"), "of").drop("of").join(now.where("blob_id is not null").select("history_id"), "history_id", "left_anti")
    return now.join(shared.select("history_id"), "history_id", "left_anti").unionByName(shared)


def sink(store: str, most_one: int = MOST_ONE, most_all: int = MOST_ALL) -> Callable[[DataFrame, int], None]:
    """A function for writeStream.foreachBatch. The store is a folder that driver and executors share."""

    def write(batch: DataFrame, batch_id: int) -> None:
        state = entries(batch.sparkSession, store, batch_id - 1)
        after(state, batch, most_one, most_all).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return write


def blobs(state: DataFrame) -> DataFrame:
    """blob_id, size_bytes, references of the blobs that entries refer to; what is not among them may be deleted."""
    return state.where("blob_id is not null").groupBy("blob_id").agg(F.min("size_bytes").alias("size_bytes"), F.count("*").alias("references"))


def public(history: DataFrame, state: DataFrame) -> DataFrame:
    """history with has_blob, url and blob_status: entries without a blob say why, those that never had one say nothing."""
    h = history.join(state.select("history_id", "status", "blob_id"), "history_id", "left")
    has = F.col("blob_id").isNotNull()
    return h.select(*history.columns, has.alias("has_blob"), F.when(has, F.concat(F.lit("/history/"), F.col("history_id"), F.lit("/audio"))).alias("url"), F.col("status").alias("blob_status"))
