"""Incoming reports as a stream: stored, analysed anew, alerted once (ST1-ST8).

Each micro-batch is merged into the stored reports (messages delivered again are
left out), the analysis runs over all of them as a batch job, and alerts whose key
was never seen are emitted. All state is tables in a shared folder, so a restarted
query goes on where it stopped, and a batch that runs again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

from ..operators import delivery, feeds
from ..operators.late_events import CUT_OFF_S


#: What is kept of every message met, beside its batch.
_IDENTITY = [StructField("message", StringType()), StructField("sender", StringType()), StructField("sent", LongType()), StructField("received_at", TimestampType())]


def _stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A state table, empty before its first batch."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def take_batch(batch: DataFrame, number: int, state: str, analyse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One micro-batch: store its new messages, analyse all reports, return the fresh alerts.

    ``analyse`` gives alerts (key, kind, title, rank) of reports. Batch 0 only seeds
    the seen keys. Rows are written under the batch's number, so a repeated batch
    replaces its own rows.
    """
    spark = batch.sparkSession
    numbered = lambda fields: StructType([*fields, StructField("batch", IntegerType())])
    known = lambda name, fields: _stored(spark, f"{state}/{name}", numbered(fields))
    fields, keys = batch.schema.fields, [StructField("key", StringType())]
    earlier = known("reports", fields).filter(F.col("batch") < number)
    fresh = batch.dropDuplicates(["file"]).join(earlier.select("file").distinct(), "file", "left_anti")
    # Copies that were left out told their message too, so identities are kept beside the reports.
    told = known("messages", _IDENTITY)
    delivery.identities(fresh).drop("batch").write.mode("overwrite").parquet(f"{state}/messages/batch={number}")
    before = told.filter(F.col("batch") < number).unionByName(delivery.identities(earlier, F.col("batch")))
    kept = fresh.join(delivery.new_messages(fresh, before).select("file"), "file", "left_semi")
    kept.write.mode("overwrite").parquet(f"{state}/reports/batch={number}")
    everything = known("reports", fields).filter(F.col("batch") <= number).drop("batch")
    now = analyse(everything)
    new = feeds.unseen(now, known("seen", keys).filter(F.col("batch") < number))
    new.select("key").distinct().write.mode("overwrite").parquet(f"{state}/seen/batch={number}")
    written = known("seen", keys).filter(F.col("batch") == number).select("key")
    return now.join(written, "key", "left_semi") if number else now.limit(0)


def run(stream: DataFrame, state: str, checkpoint: str, analyse: Callable[[DataFrame], DataFrame], emit: Callable[[DataFrame, int], None], every: str = "1500 milliseconds") -> StreamingQuery:
    """The stream through ``take_batch``; a burst of arrivals within the interval is one recompute."""
    return (
        stream.writeStream.foreachBatch(lambda batch, number: emit(take_batch(batch, number, state, analyse), number))
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .start()
    )


def changes(log: DataFrame) -> DataFrame:
    """The files that stand after a log of (file, op, seq, text): the last create or modify, unless deleted since."""
    last = log.groupBy("file").agg(F.max_by(F.struct("op", "text"), "seq").alias("c"))
    return last.filter(F.col("c.op") != "delete").select("file", "c.text")


def hourly(stream: DataFrame) -> DataFrame:
    """Counts per event hour with the batch operator's cut-off as watermark; an addition, the reference has no windows."""
    return stream.withWatermark("at", f"{CUT_OFF_S} seconds").groupBy(F.window("at", "1 hour")).agg(F.count(F.lit(1)).alias("n"))


