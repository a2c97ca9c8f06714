"""The same questions over the event stream: usage sums, latest status, counters, deadlines, windows.

The streams read parquet folders; with ``availableNow`` a run ends when what is there has been read, so a stream's
final state can be held against the batch operator.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from patchlake.functions import columns as C
from patchlake.operators import events as batch
from patchlake.session import shared_folder


def read(spark: SparkSession, path: str) -> DataFrame:
    """Stream of a parquet file or folder of workflow events, each event_no once, in whatever order the files are read.

    Without a watermark no row is late; the numbers seen are kept as state for the whole replay.
    """
    return _files(spark, path).withColumn("received_at", F.col("received_at").cast("timestamp")).dropDuplicates(["event_no"])


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Stream of finding events: every finding once, whole rows delivered again count once."""
    return _files(spark, path).withColumn("category", C.category()).dropDuplicates()


def _files(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    folder, name = (path, "*.parquet") if os.path.isdir(path) else os.path.split(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 64).parquet(folder)


def run(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run until all input is read and return the last row of every key.

    In update mode every batch adds the rows that it changed to a table in the shared folder, so neither the state nor
    the result meets on the driver; reading it back, the newest batch of a key counts.
    """
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    written: list[int] = []

    def each(rows: DataFrame, number: int) -> None:
        written.append(number)
        rows.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/rows/_batch_dir={number}")

    q = stream.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.read.schema(f"{stream.schema.toDDL()}, _batch bigint").option("recursiveFileLookup", "true").parquet(f"{root}/rows") if written else spark.createDataFrame([], stream.schema).withColumn("_batch", F.lit(0))
    rest = [c for c in stream.columns if c not in keys]
    return found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_last")).select(*keys, "_last.*")


def usage_totals(stream: DataFrame) -> DataFrame:
    u = stream.where("kind = 'usage'").withColumn("u", F.from_json("payload", batch.USAGE))
    return u.groupBy("review_id").agg(F.sum(F.coalesce("u.input_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("u.calls", F.lit(0))).alias("calls"), F.count("*").alias("usages"))


def latest_status(stream: DataFrame) -> DataFrame:
    e = stream.where(F.col("stage") != "")
    return e.groupBy("review_id", "stage").agg(F.max_by("kind", F.struct("event_ts", "event_no")).alias("status"), F.max("event_ts").alias("at"))


def kind_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("kind").count().withColumnRenamed("count", "n")


def severity_counts(stream: DataFrame) -> DataFrame:
    """The live counter of findings by severity."""
    return stream.groupBy("severity").agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, width: str = "1 day") -> DataFrame:
    """Events of each kind by day of event time; an extension over the batch operators."""
    return stream.groupBy(F.window("event_ts", width).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "kind", "n")


def fan_out(stream: DataFrame, *sinks) -> None:
    """Every batch to every sink; a sink that fails is passed over, as an event sink must not stop a review."""

    def each(batch_rows: DataFrame, number: int) -> None:
        batch_rows.persist()
        for sink in sinks:
            try:
                sink(batch_rows, number)
            except Exception:  # noqa: BLE001, S112 - by contract
                continue
        batch_rows.unpersist()

    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    q.awaitTermination()
