"""Incremental flows: daily budget, first-come accumulation, expiring sessions, metric log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from terazi.sources.sinks import absent_only


def daily_spending(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Calls and spending of each day; rows later than the watermark belong to a closed day and are
    dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day").alias("gun")).agg(F.count("*").alias("istek"), F.sum("value").alias("tutar")).select(F.col("gun.start").alias("gun"), "istek", "tutar")


def first_seen(decisions: DataFrame, key: str, time: str, late: str = "7 days") -> DataFrame:
    """Each key once; its state goes when the watermark has passed."""
    return decisions.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def _there(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def accumulate(stream: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Appends what the table at ``path`` lacks by key. A batch that is run again adds nothing, since
    its keys are there by then."""

    def add(batch: DataFrame, _: int) -> None:
        old = batch.sparkSession.read.parquet(path) if _there(batch.sparkSession, path) else batch.limit(0)
        absent_only(old, batch, key).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, key: str, gap: str = "1 hour", late: str = "1 minute") -> DataFrame:
    """``key, bas, son, n``: runs of events of a key with no gap as long as ``gap``. In a stream a
    session is given out, and its state goes, once the watermark has passed its end."""
    timed = events.select(F.col(key), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    grouped = timed.groupBy(key, F.session_window("ts", gap).alias("_s")).agg(F.count("*").alias("n"), F.max("ts").alias("son"))
    return grouped.select(key, F.col("_s.start").alias("bas"), "son", "n")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drives a stream over what is there and gives the result, which is written beside the checkpoint;
    a batch that runs again overwrites its own rows. In complete mode the last batch is the result."""
    rows, last = f"{checkpoint.rstrip('/')}-{name}", []

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/{number}")
        last.append(number)

    stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    if not last:
        return spark.createDataFrame([], stream.schema)
    reader = spark.read.schema(stream.schema).option("recursiveFileLookup", "true")
    return reader.parquet(f"{rows}/{last[-1]}" if mode == "complete" else rows)


def append_metrics(stream: DataFrame, path: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Writes a stream of metric rows to Parquet, exactly once."""
    rows = shape(stream) if shape else stream
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
