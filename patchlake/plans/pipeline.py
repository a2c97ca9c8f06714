"""The review as one plan: producers of findings, verification, correlation, dismissals, selection, counts.

A producer is a function from the lines of changes to findings and is registered by its check; the deterministic ones
stand here, a provider's answers come in as a table of recorded outputs (``scripted``).  The plan is lazy from the diffs
to the ranked findings, but for the facts of the snapshots, and shuffles by entry and file only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from patchlake.functions import columns as C, rules, text
from patchlake.operators import code, diffs, findings as fi, retrieval as rt
from patchlake.session import checkpoint
from patchlake.sources import sinks

Producer = Callable[[DataFrame, DataFrame], DataFrame]
PRODUCERS: dict[str, Producer] = {}
FINDING = ("entry_id", "category", "severity", "confidence", "title", "description", "file_path", "start_line", "rule_id")
#: severity of a rule hit by category; anything else is low
RULE_SEVERITY = {"security": "high", "data_integrity": "high", "authorization": "high", "privacy": "medium", "concurrency": "medium", "error_handling": "medium", "correctness": "medium", "reliability": "medium"}


def producer(name: str) -> Callable[[Producer], Producer]:
    def register(f: Producer) -> Producer:
        PRODUCERS[name] = f
        return f

    return register


@producer("rules")
def rule_findings(lines: DataFrame, found: DataFrame) -> DataFrame:
    """A finding for every added line and rule it meets."""
    hits = rules.rule_hits(lines.where("kind = 'added'").select("entry_id", F.col("path").alias("file_path"), F.col("new_line").alias("start_line"), "text"))
    return hits.select("entry_id", "category", C.lookup(F.col("category"), RULE_SEVERITY, "low").alias("severity"), F.lit(0.8).alias("confidence"), F.concat_ws(" ", F.lit("Rule"), "rule_id").alias("title"), F.trim("text").alias("description"), "file_path", "start_line", "rule_id")


@producer("dead_code")
def dead_code_findings(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Imports, locals and statements that a change leaves without use."""
    dead = code.dead_code(lines, found)
    said = C.lookup(F.col("rule_id"), {"unused-import": "Unused import:", "unused-local": "Unused local:", "unreachable": "Unreachable statement in"}, "")
    return dead.select("entry_id", F.lit("dead_code").alias("category"), F.lit("low").alias("severity"), "confidence", F.concat_ws(" ", said, "name").alias("title"), F.col("name").alias("description"), F.col("path").alias("file_path"), F.col("line").alias("start_line"), "rule_id")


@producer("taint")
def taint_findings(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Flows from a source to a sink on added lines."""
    flows = found.where("fact = 'taint'").select("entry_id", F.col("path").alias("file_path"), F.col("line").alias("start_line"), "name", "detail")
    added = lines.where("kind = 'added'").select("entry_id", F.col("path").alias("file_path"), F.col("new_line").alias("start_line")).distinct()
    met = sinks.first_rows(flows.join(added, ["entry_id", "file_path", "start_line"]).withColumn("_k", F.concat_ws(" ", "entry_id", "file_path", "start_line")), "_k", ["name", "detail"], 4)
    return met.select("entry_id", F.lit("security").alias("category"), F.lit("high").alias("severity"), F.lit(0.8).alias("confidence"), F.concat_ws(" ", F.lit("Unchecked input reaches"), "name").alias("title"), F.col("detail").alias("description"), "file_path", "start_line", F.concat(F.lit("taint-"), "name").alias("rule_id"))


def enabled(findings: DataFrame, switches: dict[str, bool]) -> DataFrame:
    """Findings of the checks that are switched on; a check without a switch is on."""
    return findings.where(C.lookup(F.col("category"), switches, True)) if switches else findings


def models(categories: DataFrame, default: str, overrides: dict[str, str]) -> DataFrame:
    """category, model: the model that answers for each category."""
    return categories.select("category", C.lookup(F.col("category"), overrides, default).alias("model") if overrides else F.lit(default).alias("model"))


def retried(attempts: DataFrame, key: list[str], order: list[str], most: int = 3, final: tuple[str, ...] = ("auth",)) -> DataFrame:
    """key, tries, outcome, error: what a call comes to that is tried up to ``most`` times, in the recorded order.

    ``attempts`` has success and error.  The first success ends it, and so does a ``final`` error, which no retry mends.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    rows = attempts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    ends = F.col("success") | F.coalesce(F.col("error").isin(*final), F.lit(False)) if final else F.col("success")
    last = rows.groupBy(*key).agg(F.coalesce(F.min(F.when(ends, F.col("_n"))), F.max("_n")).alias("tries"), F.collect_list(F.struct("_n", "success", "error")).alias("_rows"))
    hit = F.filter("_rows", lambda x: x["_n"] == F.col("tries"))[0]
    return last.select(*key, "tries", F.when(hit["success"], "answered").otherwise("failed").alias("outcome"), F.when(~hit["success"], hit["error"]).alias("error"))


def scripted(answers: DataFrame) -> Producer:
    """Producer over recorded provider outputs (entry_id, output): prose around a JSON object with findings.

    An output without usable JSON gives no findings; of several rows of an entry (column ``attempt``, where there is one)
    the first usable counts, so a repair is asked for only where it is needed.
    """
    schema = "findings array<struct<category: string, severity: string, confidence: double, title: string, description: string, file_path: string, start_line: int>>"

    def produce(lines: DataFrame, found: DataFrame) -> DataFrame:
        parsed = answers.withColumn("f", F.from_json(text.extract_json(F.col("output")), schema)["findings"]).where("f is not null")
        if "attempt" in answers.columns:
            parsed = parsed.groupBy("entry_id").agg(F.min_by("f", "attempt").alias("f"))
        rows = parsed.select("entry_id", F.explode("f").alias("f")).select("entry_id", "f.*").withColumn("category", C.category())
        return rows.join(lines.select("entry_id").distinct(), "entry_id", "left_semi").select(*FINDING[:-1], F.lit(None).cast("string").alias("rule_id"))

    return produce


def cached(requests: DataFrame, cache: DataFrame, call: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(answers of all requests, rows to add to the cache): only requests whose key is not cached are made, each once."""
    hit = requests.join(cache, "key")
    new = call(requests.join(cache, "key", "left_anti").dropDuplicates(["key"]).select("key", "prompt"))
    answered = requests.join(new.select("key", "answer"), "key")
    return hit.select("entry_id", "answer").unionByName(answered.select("entry_id", "answer")), new.select("key", "answer")


def reviewed(entries: DataFrame, producers: dict[str, Producer] | None = None, dismissals: DataFrame | None = None, least: float = 0.6, strictness: str = "balanced", switches: dict[str, bool] | None = None, verified: bool = True) -> DataFrame:
    """Ranked findings of every entry's diff, of the checks that ``switches`` leave on; without verification as produced."""
    files, placed = checkpoint(diffs.files(entries)), checkpoint(diffs.placed(entries))  # every producer and the verifier read them
    snapshot = entries.select("entry_id", F.explode("base_files").alias("path", "content"))
    facts = checkpoint(code.facts(snapshot))
    facts = checkpoint(code.cross_file_taint(snapshot, facts))
    made = None
    for f in (producers or PRODUCERS).values():
        part = f(placed, facts).select(*FINDING)
        made = part if made is None else made.unionByName(part)
    order = Window.partitionBy("entry_id").orderBy("file_path", "start_line", "category", "title", "description")
    found = enabled(made, switches or {}).withColumn("ord", F.row_number().over(order).cast("bigint"))
    hits = found.where("rule_id is not null").select("entry_id", F.col("file_path").alias("path"), F.col("start_line").alias("line"), "category", "rule_id")
    if not verified:
        return fi.rank(fi.dedupe(found.withColumnRenamed("entry_id", "review_id").withColumns({"verification_status": F.lit("unverified"), "evidence_status": F.lit("insufficient_evidence")})))
    status = code.verify(found, placed, files, snapshot.select("entry_id", "path"), hits, found=facts).select("entry_id", "ord", "evidence_status")
    f = found.join(status, ["entry_id", "ord"]).withColumnRenamed("entry_id", "review_id").withColumn("verification_status", C.lookup(F.col("evidence_status"), C.STATUS_OF_EVIDENCE, "unverified"))
    if dismissals is not None:
        repositories = entries.select(F.col("entry_id").alias("review_id"), "repository")
        f = rt.not_dismissed(f.join(repositories, "review_id"), dismissals).drop("repository")
    return fi.rank(fi.keep(fi.dedupe(f), least, strictness))


def baselines(entries: DataFrame, answers: DataFrame | None = None) -> dict[str, Callable[[], DataFrame]]:
    """name -> ranked findings of what the whole workflow is held against, and of the workflow itself.

    ``rules`` takes the line rules as they hit, ``single-pass`` a provider's recorded answer as it came, ``static`` all
    deterministic producers without verification; ``workflow`` verifies, filters and correlates.
    """
    own = {"scripted": scripted(answers)} if answers is not None else {}
    made = {"rules": lambda: reviewed(entries, {"rules": PRODUCERS["rules"]}, verified=False), "static": lambda: reviewed(entries, verified=False), "workflow": lambda: reviewed(entries, PRODUCERS | own)}
    return made | ({"single-pass": lambda: reviewed(entries, own, verified=False)} if own else {})
