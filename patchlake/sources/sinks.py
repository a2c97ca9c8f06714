"""Writers: review documents as JSON, SARIF and markdown, publishable comments, JSONL, capped histories."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from patchlake.functions import columns as C

PUBLISHED, BODY = 20, 65_000
REDACTED_KEYS = r"(?i)(key|token|secret|password|authorization|cookie)"


def json_documents(findings: DataFrame) -> DataFrame:
    """review_id, document: the findings of a review as one JSON object."""
    item = F.struct("ord", "category", "severity", "confidence", "title", "file_path", "start_line", "evidence_status")
    return findings.groupBy("review_id").agg(F.array_sort(F.collect_list(item)).alias("findings")).select("review_id", F.to_json(F.struct("review_id", "findings")).alias("document"))


def rule_name() -> Column:
    return F.coalesce(F.nullif(F.col("rule_id"), F.lit("")), F.concat_ws("/", "category", F.substring("title", 1, 40)))


def sarif(findings: DataFrame) -> DataFrame:
    """review_id, document: SARIF 2.1.0, a rule described by its first finding."""
    f = findings.withColumn("_rule", rule_name()).withColumn("_level", C.lookup(F.col("severity"), C.SARIF_LEVEL, "note"))
    rules = f.groupBy("review_id", "_rule").agg(F.min("ord").alias("at"), F.min_by("title", "ord").alias("title")).groupBy("review_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "_rule", "title"))), lambda x: F.struct(x["_rule"].alias("id"), F.struct(x["title"].alias("text")).alias("shortDescription"))).alias("rules"))
    region = F.when(F.col("start_line").isNotNull(), F.struct(F.col("start_line").alias("startLine"), F.coalesce("end_line", "start_line").alias("endLine")))
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    logical = F.transform(F.slice("related_files", 1, 5), lambda p: F.struct(p.alias("fullyQualifiedName")))
    result = F.struct("ord", F.col("_rule").alias("ruleId"), F.col("_level").alias("level"), F.struct(F.col("description").alias("text")).alias("message"), F.array(place).alias("locations"), logical.alias("logicalLocations"))
    results = f.groupBy("review_id").agg(F.transform(F.array_sort(F.collect_list(result)), lambda x: x.dropFields("ord")).alias("results"))
    run = F.struct(F.struct(F.struct(F.lit("patchlake").alias("name"), F.col("rules")).alias("driver")).alias("tool"), F.col("results"))
    return results.join(rules, "review_id").select("review_id", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("document"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """review_id, level, results: how many results a SARIF document has of each level."""
    return findings.groupBy("review_id", C.lookup(F.col("severity"), C.SARIF_LEVEL, "note").alias("level")).agg(F.count("*").alias("results"), F.countDistinct(rule_name()).alias("rules"))


def markdown(findings: DataFrame) -> DataFrame:
    """review_id, document: most severe first, within a severity the least confident first."""
    line = F.concat(F.lit("- ["), "severity", F.lit("] "), "title", F.lit(" ("), "file_path", F.lit(":"), F.coalesce(F.col("start_line").cast("string"), F.lit("-")), F.lit(")"))
    item = F.struct((-C.severity_rank()).alias("down"), "confidence", "ord", line.alias("line"))
    return findings.groupBy("review_id").agg(F.concat(F.lit("# Review "), F.first("review_id"), F.lit("\n"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]), "\n")).alias("document"))


def comments(ranked: DataFrame) -> DataFrame:
    """What is published: of the first PUBLISHED findings those with a file and a line, bodies cut."""
    body = F.concat_ws("\n\n", F.col("title"), F.col("description"), F.col("recommendation"))
    return ranked.where((F.col("rank") <= PUBLISHED) & (F.col("file_path") != "") & F.col("start_line").isNotNull()).select("review_id", "rank", F.col("file_path").alias("path"), F.col("start_line").alias("line"), F.substring(body, 1, BODY).alias("body"))


def redacted(meta: Column) -> Column:
    """Map with the values of telling keys replaced."""
    return F.transform_values(meta, lambda k, v: F.when(k.rlike(REDACTED_KEYS), F.lit("***")).otherwise(v))


def redacted_json(c: Column) -> Column:
    """JSON text with the values of telling keys replaced at every depth; what is no JSON stays as it is."""

    @F.pandas_udf("string")
    def clean(values: pd.Series) -> pd.Series:
        telling = re.compile(REDACTED_KEYS[4:], re.I)

        def walk(x: object) -> object:
            if isinstance(x, dict):
                return {k: "***" if telling.search(k) else walk(v) for k, v in x.items()}
            return [walk(v) for v in x] if isinstance(x, list) else x

        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(walk(json.loads(t)), ensure_ascii=False)
            except ValueError:
                return t

        return values.map(one)

    return clean(c)


FORMATS = {"markdown": lambda f: markdown(f), "json": lambda f: json_documents(f), "sarif": lambda f: sarif(f)}


def documents(findings: DataFrame, fmt: str) -> DataFrame:
    """review_id, document in the format asked for."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}, one of {', '.join(FORMATS)}")
    return FORMATS[fmt](findings)


def export(findings: DataFrame, fmt: str, path: str) -> None:
    """The documents of all reviews as text, a folder per review."""
    documents(findings, fmt).write.mode("errorifexists").partitionBy("review_id").text(path)


def save_dataset(entries: DataFrame, path: str) -> None:
    """A benchmark dataset as JSON lines (``.jsonl``), else as one document {"entries": [..]}: one row, so for small sets."""
    if path.endswith(".jsonl"):
        entries.write.mode("errorifexists").json(path)
    else:
        one = entries.agg(F.array_sort(F.collect_list(F.struct("entry_id", *[c for c in entries.columns if c != "entry_id"])), lambda a, b: F.when(a["entry_id"] < b["entry_id"], -1).when(a["entry_id"] > b["entry_id"], 1).otherwise(0)).alias("entries"))
        one.select(F.to_json(F.struct("entries"))).coalesce(1).write.mode("errorifexists").text(path)


def append_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def experiment(metrics: DataFrame, path: str) -> None:
    """Metrics, latencies, costs and a summary of a run (a row per system) in a folder that must not exist yet."""
    line = F.concat_ws(" | ", "system", *[F.concat(F.lit(m + " "), F.coalesce(F.col(m).cast("string"), F.lit("-"))) for m in ("precision", "recall", "f1")])
    parts = {"metrics": metrics, "latency": metrics.select("system", "mean_latency_s"), "cost": metrics.select("system", "mean_cost_usd", "total_tokens"), "summary": metrics.select(line.alias("value"))}
    for name, rows in parts.items():
        writer = rows.coalesce(1).write.mode("errorifexists")  # a row per system
        writer.text(f"{path}/{name}") if name == "summary" else writer.json(f"{path}/{name}")


def capped(history: DataFrame, new: DataFrame, keep: int = 1000) -> DataFrame:
    """History with new rows (ts, ...), the last ``keep`` by time."""
    return history.unionByName(new).orderBy(F.desc("ts")).limit(keep)


def diff_text(lines: DataFrame, key: str = "entry_id") -> DataFrame:
    """Body of a patch from numbered lines."""
    sign = C.lookup(F.col("kind"), {"added": "+", "removed": "-"}, " ")
    return lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(sign, "text").alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def first_rows(rows: DataFrame, by: str, order: list[Column | str], n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
