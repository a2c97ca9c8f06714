"""Evaluation against gold entries: matching, scores, metrics, regression between two sets of metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from patchlake.functions import columns as C

# fixed values: words that do not count as gold keywords
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "if", "in", "on", "of", "to", "for", "with", "is", "are", "was", "were", "be", "been", "this", "that", "these",
    "those", "it", "its", "not", "when", "while", "as", "at", "by", "from", "can", "will", "should", "may", "would", "could", "there", "their", "then",
)
LOWER_IS_BETTER = ("false_positive_rate", "mean_latency_s", "mean_cost_usd", "total_tokens")
METRICS = ("precision", "recall", "f1", "false_positive_rate", "bug_detection_rate", "severity_accuracy", "completion_rate", "mean_latency_s", "mean_cost_usd", "total_tokens")
TOLERANCE = 0.02


def gold_tokens(*texts: Column) -> Column:
    return F.array_except(C.identifier_tokens(F.concat_ws(" ", *texts)), F.array(*[F.lit(w) for w in STOP_WORDS]))


def matches(entries: DataFrame, predictions: DataFrame) -> DataFrame:
    """predictions (entry_id, pred, file_path, text, severity) with ``matched`` against their entry's gold.

    A finding matches when the entry names no files, or the finding's file, or a file of its directory (not the root),
    and at least one gold keyword is in its text.  An entry without keywords (negative) matches nothing.
    """
    gold = entries.select("entry_id", "affected_files", F.col("severity").alias("gold_severity"), gold_tokens(F.col("bug_description"), F.col("bug_fix")).alias("gold"))
    p = predictions.withColumn("tokens", C.identifier_tokens(F.col("text"))).join(gold, "entry_id")
    folder = C.directory(F.col("file_path"))
    near = (F.size("affected_files") == 0) | F.array_contains("affected_files", F.col("file_path")) | ((folder != "") & F.array_contains(F.transform("affected_files", C.directory), folder))
    return p.withColumn("matched", near & (C.overlap(F.col("tokens"), F.col("gold")) >= 1)).withColumn("negative", F.size("gold") == 0)


def entry_scores(matched: DataFrame) -> DataFrame:
    return matched.groupBy("entry_id").agg(
        F.count_if("matched").alias("true_positives"),
        F.count_if(~F.col("matched")).alias("false_positives"),
        F.bool_or("matched").alias("detected"),
        (~F.bool_or("matched") & ~F.first("negative")).alias("missed_gold"),
        F.bool_or(F.col("matched") & (F.col("severity") == F.col("gold_severity"))).alias("severity_correct"),
    )


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), digits)


def mean(c: str) -> Column:
    """Mean of latency or cost, independent of the order of rows; null and NaN do not count."""
    exact = F.when(~F.isnan(c), F.col(c)).cast("decimal(28,9)")
    return F.sum(exact).cast("double") / F.count(exact)


def system_metrics(scores: DataFrame, by: tuple[str, ...] = ("system",)) -> DataFrame:
    """Sums and ratios per system; staged rounding; a zero denominator gives null."""
    s = scores.groupBy(*by).agg(
        F.sum("true_positives").alias("tp"),
        F.sum("false_positives").alias("fp"),
        F.count_if(F.col("missed_gold") & F.col("success")).alias("fn"),
        F.count_if("detected").alias("found"),
        F.count_if(F.col("detected") | F.col("missed_gold")).alias("positives"),
        F.count_if("severity_correct").alias("right_severity"),
        F.count_if("success").alias("done"),
        F.count("*").alias("entries"),
        mean("latency_seconds").alias("latency"),
        mean("cost_usd").alias("cost"),
        F.sum("tokens").alias("total_tokens"),
    )
    s = s.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return s.select(
        *by, "entries", "tp", "fp", "fn", "precision", "recall",
        F.round(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), 4).alias("f1"),
        ratio(F.col("fp"), F.col("tp") + F.col("fp")).alias("false_positive_rate"),
        ratio(F.col("found"), F.col("positives")).alias("bug_detection_rate"),
        ratio(F.col("right_severity"), F.col("found")).alias("severity_accuracy"),
        ratio(F.col("done"), F.col("entries")).alias("completion_rate"),
        F.round("latency", 3).alias("mean_latency_s"), F.round("cost", 6).alias("mean_cost_usd"), "total_tokens",
    )


def unpivoted(metrics: DataFrame, name: str) -> DataFrame:
    wide = metrics.select("system", *[F.col(m).cast("double").alias(m) for m in METRICS])
    return wide.unpivot("system", list(METRICS), "metric", name)


def compare(baseline: DataFrame, candidate: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """system, metric, baseline, candidate, delta, regressed, label; metrics that the baseline lacks are left out.

    A system on one side only is told by ``label`` missing or extra; a metric that the candidate lacks is regressed.
    """
    b, c = unpivoted(baseline, "baseline"), unpivoted(candidate, "candidate")
    both = b.withColumn("in_b", F.lit(True)).join(c.withColumn("in_c", F.lit(True)), ["system", "metric"], "full_outer").where(F.col("baseline").isNotNull() | F.col("in_b").isNull())
    both = both.withColumn("delta", F.round(F.col("candidate") - F.col("baseline"), 6))
    worse = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("delta")).otherwise(-F.col("delta"))
    label = (
        F.when(F.col("in_c").isNull(), "missing").when(F.col("in_b").isNull(), "extra").when(F.col("candidate").isNull(), "regressed")
        .when(worse > tolerance, "regressed").when(worse < 0, "improved").when(F.col("delta") == 0, "unchanged").otherwise("tolerated")
    )
    return both.withColumn("label", label).select("system", "metric", "baseline", "candidate", "delta", (F.col("label") == "regressed").alias("regressed"), "label")


def table_rows(metrics: DataFrame) -> DataFrame:
    """One text row of ten columns per system, a dash for what is null."""
    cell = lambda c: F.coalesce(F.col(c).cast("decimal(20,4)").cast("string"), F.lit("-"))
    return metrics.select("system", F.concat_ws(" | ", "system", *[cell(m) for m in METRICS[:9]]).alias("row"))


def leaks(entries: DataFrame) -> DataFrame:
    """Whether a run over these entries is allowed: none may be of the training split."""
    return entries.agg(F.count("*").alias("entries"), F.count_if(~F.col("hold_out")).alias("not_held_out"), (F.count_if(~F.col("hold_out")) == 0).alias("allowed"))
