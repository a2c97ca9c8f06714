"""Workflow events in batch: deliveries, running usage, latest status, durations and deadlines, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

USAGE = "input_tokens bigint, calls bigint"
DONE = ("stage_done", "stage_failed", "stage_skipped")


def delivered(events: DataFrame) -> DataFrame:
    """Each event_no once: the delivery that came first."""
    w = Window.partitionBy("event_no").orderBy("received_at")
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def usage(events: DataFrame) -> DataFrame:
    """Usage events with their counts read from the payload and running sums per review."""
    u = events.where("kind = 'usage'").withColumn("u", F.from_json("payload", USAGE)).select("review_id", "event_no", "stage", "event_ts", F.coalesce("u.input_tokens", F.lit(0)).alias("input_tokens"), F.coalesce("u.calls", F.lit(0)).alias("calls"))
    w = Window.partitionBy("review_id").orderBy("event_ts", "event_no").rowsBetween(Window.unboundedPreceding, 0)
    return u.withColumn("tokens_so_far", F.sum("input_tokens").over(w)).withColumn("calls_so_far", F.sum("calls").over(w))


def usage_totals(events: DataFrame) -> DataFrame:
    return usage(events).groupBy("review_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("calls").alias("calls"), F.count("*").alias("usages"))


def latest_status(events: DataFrame) -> DataFrame:
    """Last event of every review's stage."""
    e = events.where(F.col("stage") != "")
    return e.groupBy("review_id", "stage").agg(F.max_by("kind", F.struct("event_ts", "event_no")).alias("status"), F.max("event_ts").alias("at"))


def stage_durations(events: DataFrame, budget_seconds: float = 300.0) -> DataFrame:
    """Stage runs from their start to their end, with whether they passed the budget; an open stage has no end."""
    e = events.where((F.col("stage") != "") & F.col("kind").isin("stage_start", *DONE))
    d = e.groupBy("review_id", "stage").agg(F.min(F.when(F.col("kind") == "stage_start", F.col("event_ts"))).alias("begun"), F.max(F.when(F.col("kind").isin(*DONE), F.col("event_ts"))).alias("ended"))
    seconds = F.round(F.expr("timestampdiff(MICROSECOND, begun, ended)") / 1e6, 3)
    return d.withColumn("seconds", seconds).withColumn("over_budget", F.col("seconds") > budget_seconds)


def capped_history(events: DataFrame, keep: int = 1000) -> DataFrame:
    """The last ``keep`` finished reviews, newest first: what a capped history file would hold."""
    done = events.where("kind = 'finish'").groupBy("review_id").agg(F.max("event_ts").alias("finished"))
    return done.orderBy(F.desc("finished"), "review_id").limit(keep)


def stage_versions(events: DataFrame, stages: tuple[str, ...], key: str = "model") -> DataFrame:
    """review_id, versions: for each of the listed stages the last value that its events name under ``key``, as stage=value."""
    named = events.where(F.col("stage").isin(*stages)).withColumn("_v", F.try_element_at("meta", F.lit(key))).where("_v is not null")
    last = named.groupBy("review_id", "stage").agg(F.max_by("_v", F.struct("event_ts", "event_no")).alias("v"))
    return last.groupBy("review_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "stage", "v"))), ",").alias("versions"))


def stage_stats(events: DataFrame) -> DataFrame:
    return events.where(F.col("stage") != "").groupBy("stage").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("stage_start", *DONE, "usage")],
        F.round(F.avg(F.when(F.col("kind") == "stage_done", F.col("stage_seconds"))), 3).alias("mean_seconds"),
        F.max("stage_seconds").alias("max_seconds"),
    )
