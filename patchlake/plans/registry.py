"""Queries of the review engine's own operators; their oracle SQL is in ``oracles``.

Every query runs over its whole tables.  Operator names of program analysis begin with ``code_``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from patchlake.functions import columns as C, rules, text
from patchlake.operators import code, diffs, evaluation as ev, events, findings as fi, retrieval as rt
from patchlake.plans import fixtures, pipeline
from patchlake.sources import readers, sinks
from patchlake.session import checkpoint, table
from patchlake.streaming import events as stream

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
IGNORED = ("*/ledger.*", "tests/*", "*.md")
LIMITS = {"critical": 0, "high": 2, "medium": 4}


def query(f: Callable) -> Callable:
    Q[f.__name__] = f
    return f


def _findings(spark: SparkSession, d: str) -> DataFrame:
    return fi.delivered(table(spark, d, "findings"))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark_entries")


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Snapshot files: entry_id, path, content."""
    return _entries(spark, d).select("entry_id", F.explode("base_files").alias("path", "content"))


# --- findings ---------------------------------------------------------------------------------------------------------


@query
def r1_rank_findings(spark, d):
    kept = fi.keep(fi.dedupe(_findings(spark, d))).withColumn("severity", C.stabilised_severity())
    return fi.rank(kept).select("review_id", "rank", "ord", "category", "severity", "confidence", "file_path", "start_line")


@query
def g1_dedupe_findings(spark, d):
    return fi.dedupe(_findings(spark, d)).select("review_id", "file_path", "category", "start_line", "ord", "first_ord", "severity", "confidence")


@query
def g2_merge_groups(spark, d):
    """Strictly higher confidence wins a key, else the first."""
    f = _findings(spark, d)
    return f.groupBy("review_id", "file_path", "category", "start_line").agg(F.max_by("ord", F.struct("confidence", -F.col("ord"))).alias("ord"), F.max("confidence").alias("confidence"))


@query
def f1_filter_findings(spark, d):
    return fi.keep(_findings(spark, d), 0.7, "lenient").select("review_id", "ord", "confidence", "evidence_status")


@query
def f3_ignored_files(spark, d):
    return fi.ignored(_findings(spark, d), IGNORED).select("review_id", "ord", "file_path")


@query
def f10_severity_gate(spark, d):
    return fi.gate(_findings(spark, d), "critical")


@query
def f11_count_gate(spark, d):
    return fi.count_gate(_findings(spark, d), LIMITS)


@query
def f12_gate_level(spark, d):
    """Gate level of each repository: the least severe level of which some review of it has a finding."""
    config = _findings(spark, d).groupBy(F.col("repository").alias("config_id"), "severity").agg(F.count("*").alias("most"))
    return fi.gate_level(config)


@query
def g3_clusters(spark, d):
    return fi.clusters(_findings(spark, d))


@query
def g4_severity_counts(spark, d):
    return fi.severity_counts(_findings(spark, d))


@query
def g17_verification_summary(spark, d):
    return fi.verification_summary(_findings(spark, d))


@query
def g18_action_counts(spark, d):
    """Findings by what a triage would do with them: their evidence status, per category."""
    return _findings(spark, d).groupBy("category", "evidence_status").agg(F.count("*").alias("n"))


@query
def g19_cross_tab(spark, d):
    return fi.cross_tab(_findings(spark, d))


@query
def j4_interactions(spark, d):
    return fi.interactions(_findings(spark, d))


@query
def j6_selections(spark, d):
    f = _findings(spark, d)
    chosen = f.where("rule_id is not null").select("review_id", F.col("ord").alias("sel"), "file_path", "start_line", "category", "title")
    return fi.selections(chosen, f.where("rule_id is null"))


@query
def j7_unmentioned(spark, d):
    f = _findings(spark, d)
    return fi.unmentioned(f, f.where("evidence_status = 'confirmed'")).select("review_id", "ord", "file_path", "category", "start_line")


@query
def j8_not_dismissed(spark, d):
    k = rt.knowledge(table(spark, d, "documents")).where("kind = 'dismissed'").withColumn("source_file", F.regexp_extract("content", r"([\w/]+\.(?:py|js|go|java))", 1))
    return rt.not_dismissed(_findings(spark, d), k).select("review_id", "ord")


@query
def u1_correlated(spark, d):
    """Findings with their interactions appended, clustered again; counts per review."""
    f = _findings(spark, d)
    made = fi.interactions(f).select("review_id", (F.lit(1 << 40) + F.row_number().over(Window.partitionBy("review_id").orderBy("rule_id", "file_path", "start_line"))).cast("bigint").alias("ord"), "category", C.lookup(F.col("severity_rank"), {v: k for k, v in C.SEVERITY_RANK.items()}, "info").alias("severity"), "confidence", F.col("rule_id").alias("title"), F.col("rule_id").alias("description"), "file_path", "start_line")
    every = f.select(*made.columns).unionByName(made)
    return fi.clusters(every).groupBy("review_id").agg(F.count("*").alias("findings"), F.countDistinct("cluster", "canonical").alias("clusters"))


@query
def x9_derived_severity(spark, d):
    return _findings(spark, d).select("review_id", "ord", C.stabilised_severity().alias("severity"))


@query
def x11_status_maps(spark, d):
    f = _findings(spark, d)
    return f.groupBy("verification_status", "evidence_status", C.lookup(F.col("evidence_status"), C.STATUS_OF_EVIDENCE, "unverified").alias("status_of_evidence")).agg(F.count("*").alias("n"))


@query
def x17_finding_ids(spark, d):
    return _findings(spark, d).select("review_id", "ord", fi.finding_id().alias("finding_id"))


@query
def k1_json_documents(spark, d):
    found = F.from_json("document", "findings array<struct<ord: bigint, title: string, file_path: string, severity: string, start_line: int>>")["findings"]
    line = lambda x: F.concat_ws("|", x["title"], x["file_path"], x["severity"], F.coalesce(x["start_line"], F.lit(0)).cast("string"))
    return sinks.json_documents(_findings(spark, d)).select("review_id", found.alias("f")).select("review_id", F.size("f").alias("findings"), F.col("f")[0]["ord"].alias("first_ord"), F.md5(F.array_join(F.array_sort(F.transform("f", line)), "\n")).alias("digest"))


@query
def k2_sarif(spark, d):
    s = sinks.sarif(_findings(spark, d))
    run = F.from_json("document", "version string, runs array<struct<tool: struct<driver: struct<rules: array<struct<id: string>>>>, results: array<struct<ruleId: string, level: string>>>>")
    return s.select("review_id", run.alias("r")).select("review_id", F.col("r.version").alias("version"), F.size(F.col("r.runs")[0]["results"]).alias("results"), F.size(F.col("r.runs")[0]["tool"]["driver"]["rules"]).alias("rules"), F.md5(F.array_join(F.array_sort(F.transform(F.col("r.runs")[0]["results"], lambda x: F.concat_ws("|", x["ruleId"], x["level"]))), "\n")).alias("digest"))


@query
def k2_sarif_levels(spark, d):
    return sinks.sarif_results(_findings(spark, d))


@query
def k3_markdown(spark, d):
    return sinks.markdown(_findings(spark, d))


@query
def k5_comments(spark, d):
    return sinks.comments(fi.rank(_findings(spark, d))).select("review_id", "rank", "path", "line", F.md5("body").alias("digest"))


@query
def k11_redacted_meta(spark, d):
    e = events.delivered(table(spark, d, "workflow_events"))
    return e.select("event_no", F.explode(sinks.redacted(F.col("meta"))).alias("key", "value")).groupBy("key", "value").agg(F.count("*").alias("n"))


# --- diffs ------------------------------------------------------------------------------------------------------------


@query
def d1_diff_files(spark, d):
    return diffs.files(_entries(spark, d))


@query
def d2_numbered_lines(spark, d):
    return diffs.numbered(_entries(spark, d)).select("entry_id", "pos", "kind", "text", "old_line", "new_line")


@query
def d3_hunks(spark, d):
    return diffs.hunks(_entries(spark, d)).drop("note")


@query
def d4_added_removed(spark, d):
    return diffs.numbered(_entries(spark, d)).where("kind <> 'context'").groupBy("entry_id", "kind").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("n_chars"))


@query
def d5_changed_lines(spark, d):
    return diffs.numbered(_entries(spark, d)).where("kind = 'added'").select("entry_id", "file_idx", "new_line")


@query
def d6_changed_ranges(spark, d):
    return diffs.changed_ranges(diffs.numbered(_entries(spark, d)))


@query
def d7_languages(spark, d):
    return diffs.files(_entries(spark, d)).groupBy("language", "status").agg(F.count("*").alias("files"), F.sum("added").alias("added"))


@query
def d8_to_text(spark, d):
    return diffs.to_text(_entries(spark, d)).select("entry_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query
def d9_focused_files(spark, d):
    lines = diffs.numbered(_entries(spark, d))
    hits = rules.rule_hits(diffs.added_texts(lines))
    return diffs.focused(lines, hits).groupBy("category").agg(F.count("*").alias("files"), F.countDistinct("entry_id").alias("entries"))


@query
def d9_plain_focused_files(spark, d):
    """The same for the rules that SQL can check, file by file and cut to 400 characters of added text per category."""
    lines = diffs.numbered(_entries(spark, d))
    texts = diffs.added_texts(lines)
    kept = diffs.focused(lines, rules.rule_hits(texts, rules=[r for r in rules.RULES if "(?!" not in r[3]]))
    sizes = lines.select("entry_id", "file_idx").distinct().join(texts.select("entry_id", "file_idx", F.length("text").alias("n")), ["entry_id", "file_idx"], "left").select("entry_id", "file_idx", F.coalesce("n", F.lit(0)).alias("chars"))
    return diffs.limited(kept, sizes, 400).groupBy("category").agg(F.count("*").alias("files"), F.sum("chars").alias("chars"))


@query
def d10_reversed(spark, d):
    return diffs.reversed_lines(diffs.numbered(_entries(spark, d))).groupBy("kind").agg(F.count("*").alias("lines"), F.sum("old_line").alias("old_sum"), F.sum("new_line").alias("new_sum"))


@query
def d11_embedded_patches(spark, d):
    """Recommendations that carry a patch, and where it begins."""
    return fi.embedded_patches(_findings(spark, d)).select("review_id", "ord", "patch")


def _sizes(spark, d):
    lines = diffs.numbered(_entries(spark, d)).groupBy("entry_id", "file_idx").agg(F.sum(F.length("text") + 1).alias("chars"))
    return diffs.files(_entries(spark, d)).join(lines, ["entry_id", "file_idx"]).select("entry_id", "file_idx", "path", F.greatest(F.lit(1), F.floor(F.col("chars") / 4)).alias("tokens"))


@query
def w3_budget_groups(spark, d):
    return diffs.budget_groups(_sizes(spark, d), 120)


@query
def g14_group_descriptions(spark, d):
    return diffs.group_descriptions(diffs.budget_groups(_sizes(spark, d), 120))


@query
def f2_rule_hits(spark, d):
    lines = diffs.numbered(_entries(spark, d)).where("kind = 'added'")
    return rules.rule_hits(lines.select("entry_id", "pos", "text")).groupBy("category", "rule_id").agg(F.count("*").alias("lines"), F.countDistinct("entry_id").alias("entries"))


@query
def f2_plain_rule_hits(spark, d):
    """The same for the rules without lookahead, which SQL can check."""
    lines = diffs.numbered(_entries(spark, d)).where("kind = 'added'")
    plain = [r for r in rules.RULES if "(?!" not in r[3]]
    return rules.rule_hits(lines.select("entry_id", "pos", "text"), rules=plain).groupBy("category", "rule_id").agg(F.count("*").alias("lines"), F.countDistinct("entry_id").alias("entries"))


# --- evaluation -------------------------------------------------------------------------------------------------------


def _scores(spark, d):
    return table(spark, d, "entry_scores").dropDuplicates(["score_id"]).withColumn("system", F.lower(F.trim("system"))).where("system is not null")


@query
def g6_system_metrics(spark, d):
    return ev.system_metrics(_scores(spark, d))


def _halves(spark, d):
    s = _scores(spark, d)
    return tuple(ev.system_metrics(s.where(c)) for c in ("scored_at < timestamp'2025-04-01'", "scored_at >= timestamp'2025-04-01'"))


@query
def j12_regressions(spark, d):
    return ev.compare(*_halves(spark, d))


@query
def u4_system_differences(spark, d):
    """Systems that only one of two runs has."""
    s = _scores(spark, d).select("run_id", "system").distinct()
    a, b = (s.where(F.col("run_id").endswith(x)).select("system").distinct() for x in ("-0", "-1"))
    return a.join(b, "system", "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, "system", "left_anti").withColumn("side", F.lit("extra")))


@query
def k12_result_rows(spark, d):
    return ev.table_rows(ev.system_metrics(_scores(spark, d)))


def _predictions(spark, d):
    """One prediction per file of an entry's diff, saying what the fix says."""
    e = _entries(spark, d).select("entry_id", F.col("bug_fix").alias("text"), F.lower("severity").alias("severity"))
    return diffs.files(_entries(spark, d)).select("entry_id", F.col("file_idx").alias("pred"), F.col("path").alias("file_path")).join(e, "entry_id")


@query
def j9_gold_matches(spark, d):
    return ev.matches(_entries(spark, d), _predictions(spark, d)).select("entry_id", "pred", "matched", "negative")


@query
def g5_entry_scores(spark, d):
    return ev.entry_scores(ev.matches(_entries(spark, d), _predictions(spark, d)))


@query
def f8_leakage_guard(spark, d):
    return ev.leaks(_entries(spark, d))


@query
def j11_entries_by_system(spark, d):
    """Runs asked of every system: each held-out entry by each system, with how many scores there are."""
    held = _entries(spark, d).where("hold_out").select("entry_id")
    s = _scores(spark, d)
    systems = s.select("system").distinct()
    n = s.groupBy("entry_id", "system").agg(F.count("*").alias("scores"))
    asked = held.join(F.broadcast(systems) if systems.limit(1001).count() <= 1000 else systems)  # what is asked for is every pair
    return asked.join(n, ["entry_id", "system"], "left").select("entry_id", "system", F.coalesce("scores", F.lit(0)).alias("scores"))


# --- text and retrieval -----------------------------------------------------------------------------------------------


def _documents(spark, d):
    return table(spark, d, "documents")


@query
def x1_identifier_tokens(spark, d):
    return _documents(spark, d).select("doc_id", F.md5(F.array_join(F.sort_array(C.identifier_tokens(F.col("text"))), " ")).alias("tokens"))


@query
def x4_token_estimate(spark, d):
    return _documents(spark, d).where("text is not null").select("doc_id", C.token_estimate(F.col("text")).alias("tokens"))


@query
def g12_document_frequency(spark, d):
    return rt.document_frequency(rt.terms(_documents(spark, d)))


@query
def g13_term_counts(spark, d):
    return rt.terms(_documents(spark, d))


@query
def x5_idf(spark, d):
    docs = _documents(spark, d)
    return rt.document_frequency(rt.terms(docs)).select("token", F.round(rt.idf(F.lit(docs.count()), F.col("df")), 6).alias("idf"))


@query
def x6_hashed_features(spark, d):
    return rt.document_frequency(rt.terms(_documents(spark, d))).select("token", C.hashed_index(F.col("token"), rt.DIMENSION).alias("idx"), C.hashed_sign(F.col("token")).alias("sign"))


@query
def x7_tfidf_vectors(spark, d):
    return rt.weighted(_documents(spark, d)).groupBy("doc_id").agg(F.count("*").alias("features"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.round(F.sum(F.abs("weight")), 4).alias("l1"), F.round(F.sum("weight"), 4).alias("total"), F.round(F.sum(F.col("weight") * F.col("idx") / 1024), 4).alias("moment"))


@query
def x18_slugs(spark, d):
    return _entries(spark, d).select("entry_id", C.slug(F.col("repository")).alias("slug"))


@query
def x20_directories(spark, d):
    return _findings(spark, d).select("review_id", "ord", C.directory(F.col("file_path")).alias("directory"))


@query
def x21_query_text(spark, d):
    """Knowledge query of an entry: description and added lines, cut."""
    added = diffs.numbered(_entries(spark, d)).where("kind = 'added'").groupBy("entry_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("added"))
    return _entries(spark, d).join(added, "entry_id", "left").select("entry_id", F.md5(F.substring(F.concat_ws("\n", "bug_description", "added"), 1, 8000)).alias("digest"))


@query
def x24_import_names(spark, d):
    """Names that added import lines of Python, JavaScript and TypeScript bind."""
    a = diffs.numbered(_entries(spark, d)).where("kind = 'added'")
    return a.select("entry_id", "pos", F.explode(code.imported_names(F.col("text"))).alias("name"))


@query
def r2_nearest_vectors(spark, d):
    v = table(spark, d, "embeddings")
    return rt.nearest(v, v.where("vec_id % 50 = 0")).select("query_id", "rank", "vec_id", "score")


@query
def w4_budget_prefix(spark, d):
    rows = _documents(spark, d).where("text is not null")
    return rt.prefix_budget(rows, "repository", ["doc_id"], F.length("text"), 24_000, bin=rt.bin_of("doc_id")).select("repository", "doc_id", "used")


@query
def s7_budget_overshoot(spark, d):
    rows = _documents(spark, d).where("text is not null and trim(text) <> ''")
    return rt.prefix_budget(rows, "repository", ["doc_id"], F.length("text"), 24_000, overshoot=True, bin=rt.bin_of("doc_id")).select("repository", "doc_id", "used")


@query
def s12_sections(spark, d):
    return rt.sections(_documents(spark, d)).select("doc_id", "section", "title", F.md5("content").alias("digest"))


@query
def s11_knowledge_scope(spark, d):
    """Entries that a repository sees: its own and the global ones."""
    k = rt.knowledge(_documents(spark, d))
    return k.groupBy("repository", "kind").agg(F.count("*").alias("entries"))


@query
def x12_content_ids(spark, d):
    return rt.knowledge(_documents(spark, d)).select("doc_id", "content_id")


@query
def k8_add_new(spark, d):
    k = rt.knowledge(_documents(spark, d))
    return rt.add_new(k.where("kind = 'rule'"), k.where("kind <> 'rule'")).select("doc_id", "kind")


@query
def g16_captured(spark, d):
    k = rt.knowledge(_documents(spark, d))
    return rt.add_new(k.where("kind = 'rule'"), k.where("kind <> 'rule'")).groupBy("kind").agg(F.count("*").alias("added"))


@query
def r4_knowledge_search(spark, d):
    """The four best entries for every document whose id is divisible by 50, asked by its title."""
    k = rt.knowledge(table(spark, d, "documents"))
    q = k.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"), "repository", "category")
    return rt.search(k, q)


@query
def x16_rendered(spark, d):
    k = rt.knowledge(_documents(spark, d)).where("kind = 'rule'")
    return rt.rendered(k, "repository", ["doc_id"], bin=rt.bin_of("doc_id")).select("repository", F.md5("block").alias("digest"))


# --- events -----------------------------------------------------------------------------------------------------------


def _events(spark, d):
    return events.delivered(table(spark, d, "workflow_events"))


@query
def g9_usage_totals(spark, d):
    return events.usage_totals(_events(spark, d))


@query
def w10_running_usage(spark, d):
    return events.usage(_events(spark, d)).select("review_id", "event_no", "tokens_so_far", "calls_so_far")


@query
def g10_latest_status(spark, d):
    return events.latest_status(_events(spark, d))


@query
def e4_stage_deadlines(spark, d):
    return events.stage_durations(_events(spark, d), 20.0).select("review_id", "stage", "seconds", "over_budget")


@query
def w8_history_tail(spark, d):
    return events.capped_history(_events(spark, d))


@query
def e1_stage_stats(spark, d):
    return events.stage_stats(_events(spark, d))


@query
def e2_stream_usage(spark, d):
    return stream.run(stream.usage_totals(stream.read(spark, f"{d}/workflow_events.parquet")), ["review_id"])


@query
def e3_stream_status(spark, d):
    return stream.run(stream.latest_status(stream.read(spark, f"{d}/workflow_events.parquet")), ["review_id", "stage"])


@query
def e6_stream_counts(spark, d):
    return stream.run(stream.kind_counts(stream.read(spark, f"{d}/workflow_events.parquet")), ["kind"])


@query
def e6_stream_severities(spark, d):
    return stream.run(stream.severity_counts(stream.read_findings(spark, f"{d}/findings.parquet")), ["severity"])


@query
def e7_stream_daily_counts(spark, d):
    return stream.run(stream.windowed_counts(stream.read(spark, f"{d}/workflow_events.parquet")), ["day", "kind"])


# --- smaller operators ------------------------------------------------------------------------------------------------


@query
def f5_applicable_entries(spark, d):
    """Whether a check that needs a description applies."""
    return _entries(spark, d).select("entry_id", (F.trim(F.coalesce("bug_description", F.lit(""))) != "").alias("applicable"))


@query
def f6_sane_checks(spark, d):
    """Categories that a review's findings ask for, as far as they are checks; correctness where none is."""
    asked = _findings(spark, d).groupBy("review_id").agg(F.collect_set("category").alias("asked"))
    known = F.array_sort(F.array_intersect("asked", F.array(*[F.lit(c) for c in C.CHECKS])))
    return asked.select("review_id", F.array_join(F.when(F.size(known) > 0, known).otherwise(F.array(F.lit("correctness"))), ",").alias("checks"))


@query
def f7_applicable_knowledge(spark, d):
    """Entries that apply to each repository: its own and those of none."""
    k = rt.knowledge(table(spark, d, "documents")).groupBy("repository").agg(F.count("*").alias("n"))
    everywhere = k.agg(F.coalesce(F.max(F.when(F.col("repository") == "", F.col("n"))), F.lit(0)).alias("n_global"))  # one row
    return k.where("repository <> ''").join(F.broadcast(everywhere)).select("repository", (F.col("n") + F.col("n_global")).alias("entries"))


@query
def f13_listing(spark, d):
    return rt.knowledge(table(spark, d, "documents")).groupBy("kind", "category").agg(F.count("*").alias("entries"), F.min("doc_id").alias("first"))


@query
def g11_merged_summaries(spark, d):
    """What the summaries of a repository's changes come to: how many and how long, the first and the last fix in order, languages together."""
    e = _entries(spark, d)
    said = F.col("bug_fix") != ""
    return e.groupBy("repository").agg(
        F.count("*").alias("changes"), F.count_if(said).alias("purposes"), F.coalesce(F.sum(F.when(said, F.length("bug_fix"))), F.lit(0)).alias("n_chars"),
        F.min_by(F.when(said, F.col("bug_fix")), F.when(said, F.col("entry_id"))).alias("first_fix"), F.max_by(F.when(said, F.col("bug_fix")), F.when(said, F.col("entry_id"))).alias("last_fix"),
        F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"),
    )


@query
def g15_costs(spark, d):
    """Cost of the usage of each review at given prices."""
    u = events.usage_totals(_events(spark, d))
    return u.select("review_id", text.cost(F.col("input_tokens"), F.lit(0), F.lit(3.0), F.lit(15.0)).alias("cost"))


@query
def s16_file_history(spark, d):
    """The five last entries that touched each file of a repository."""
    e = _entries(spark, d).select("entry_id", "repository", F.explode(F.array_distinct("affected_files")).alias("path"))
    return sinks.first_rows(e.withColumn("k", F.concat_ws(" ", "repository", "path")), "k", [F.desc("entry_id")], 5).drop("k")


@query
def s3_repository_names(spark, d):
    return table(spark, d, "repo_links").select("link_id", diffs.repository_name("old_repository").alias("name"))


@query
def u3_ordered_union(spark, d):
    """Changed files first, then the snapshot's, each once in that order."""
    e = _entries(spark, d)
    a = e.select("entry_id", F.posexplode("affected_files").alias("ord", "path"))
    b = e.select("entry_id", F.explode(F.map_keys("base_files")).alias("path")).withColumn("ord", F.lit(1_000_000))
    first = a.unionByName(b.select("entry_id", "ord", "path")).groupBy("entry_id", "path").agg(F.min("ord").alias("ord"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("entry_id").orderBy("ord", "path"))).select("entry_id", "path", "place")


@query
def u6_task_order(spark, d):
    """Findings of two tasks behind one another: first the confirmed, then the others, each in arrival order."""
    f = _findings(spark, d)
    both = f.where("evidence_status = 'confirmed'").withColumn("task", F.lit(0)).unionByName(f.where("evidence_status <> 'confirmed'").withColumn("task", F.lit(1)))
    return both.select("review_id", "ord", F.row_number().over(Window.partitionBy("review_id").orderBy("task", "ord")).alias("place"))


@query
def w5_inflated_budget(spark, d):
    """Budget that counts a file before testing it, so it stays used up after the first that does not fit."""
    rows = table(spark, d, "documents").where("text is not null").select("repository", "doc_id", F.length("text").alias("size"))
    taken = rt.prefix_budget(rows, "repository", ["doc_id"], F.col("size"), 24_000, bin=rt.bin_of("doc_id")).groupBy("repository").agg(F.count("*").alias("taken"))
    return rows.groupBy("repository").agg(F.sum("size").alias("used")).join(taken, "repository", "left").select("repository", F.coalesce("taken", F.lit(0)).alias("taken"), "used")


@query
def x13_cache_keys(spark, d):
    e = _entries(spark, d)
    return e.select("entry_id", text.cache_key(model=F.lit("scripted"), prompt=F.col("commit_sha"), temperature=F.lit("0"), parent=F.col("parent_commit")).alias("key"))


@query
def x14_extracted_json(spark, d):
    """JSON found again in prose around the events' payloads."""
    e = _events(spark, d).where("payload is not null")
    return e.select("event_no", F.md5(text.extract_json(F.concat(F.lit("Result {so far}: "), "payload", F.lit(" - done")))).alias("digest"))


@query
def x15_filled_template(spark, d):
    return _entries(spark, d).select("entry_id", text.filled("Review of $REPOSITORY in $LANGUAGE.", REPOSITORY=F.col("repository"), LANGUAGE=F.col("language")).alias("prompt"))


@query
def x19_retry_schedule(spark, d):
    return text.retry_schedule(_scores(spark, d).where("not success").select("score_id")).select("score_id", "attempt", "wait")


@query
def x22_knowledge_of_findings(spark, d):
    """Confirmed findings as knowledge entries."""
    f = _findings(spark, d).where("evidence_status = 'confirmed'")
    content = F.concat_ws("\n", "description", F.concat(F.lit("Evidence: "), "evidence"), F.concat(F.lit("Recommendation: "), "recommendation"))
    return f.select("review_id", "ord", C.content_id(F.lit("finding"), F.col("title"), content, F.col("repository"), F.col("category")).alias("content_id"))


@query
def j14_callers_digest(spark, d):
    """At most six call sites of at most twelve symbols of at most twenty changed files of each entry, as text."""
    changed = sinks.first_rows(_entries(spark, d).select("entry_id", F.posexplode("affected_files").alias("at", "path")).groupBy("entry_id", "path").agg(F.min("at").alias("at")), "entry_id", ["at", "path"], 20)
    found = checkpoint(code.facts(_files(spark, d)))
    names = found.where("fact in ('function', 'async')").join(changed, ["entry_id", "path"]).groupBy("entry_id", "path", "at", "name").agg(F.min("line").alias("line"))
    names = sinks.first_rows(names.withColumn("k", F.concat_ws(" ", "entry_id", "path")), "k", ["line", "name"], 12).drop("k").select("entry_id", "name").distinct()
    calls = code.callers(found).join(names, ["entry_id", "name"])
    sites = sinks.first_rows(calls.withColumn("k", F.concat_ws(" ", "entry_id", "name")), "k", ["path", "line"], 6)
    return sites.groupBy("entry_id", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda x: F.concat_ws(":", x["path"], x["line"].cast("string"))), ", ").alias("sites"))


@query
def review_pipeline(spark, d):
    """The whole review of every entry: counts of kept findings by category and severity."""
    return pipeline.reviewed(_entries(spark, d)).groupBy("category", "severity", "evidence_status").agg(F.count("*").alias("findings"), F.countDistinct("review_id").alias("reviews"))


# --- program analysis -------------------------------------------------------------------------------------------------


@query
def code_facts(spark, d):
    return code.facts(_files(spark, d)).groupBy("fact").agg(F.count("*").alias("n"), F.countDistinct("entry_id", "path").alias("files"))


@query
def code_definitions(spark, d):
    return code.facts(_files(spark, d)).where("fact in ('function', 'async', 'class', 'variable')").select("entry_id", "path", "fact", "name", "line")


@query
def code_unused_imports(spark, d):
    return code.unused_imports(code.facts(_files(spark, d)))


@query
def code_callers(spark, d):
    return code.callers(code.facts(_files(spark, d)))


@query
def code_taint(spark, d):
    files_ = _files(spark, d)
    return code.cross_file_taint(files_, checkpoint(code.facts(files_))).where("fact = 'taint'").select("entry_id", "path", F.col("name").alias("kind"), "line", F.col("detail").alias("chain"))


@query
def code_flaws(spark, d):
    kinds = ("mutable-default", "dangerous-call", "sql-construction", "bare-except", "swallowed-except", "blocking-in-async", "unreachable", "unused-local", "unchecked-index")
    return code.facts(_files(spark, d)).where(F.col("fact").isin(*kinds)).select("entry_id", "path", F.col("fact").alias("rule_id"), "line")


@query
def f9_contradictions(spark, d):
    """Bug descriptions that name nothing their entry's snapshot has."""
    text_ = _entries(spark, d).select("entry_id", F.lit(0).alias("ord"), F.lit("").alias("title"), F.col("bug_description").alias("description"))
    return code.contradictions(text_, code.facts(_files(spark, d))).select("entry_id")


@query
def j13_unreferenced_imports(spark, d):
    """Imports of a snapshot that no other of its lines names."""
    files_ = _files(spark, d)
    names = code.facts(files_).where("fact = 'import'").select("entry_id", "path", "line", "name").distinct()
    lines = files_.select("entry_id", "path", F.posexplode(F.split("content", "\n")).alias("at", "text")).select("entry_id", "path", (F.col("at") + 1).alias("line"), "text")
    return code.unreferenced(names, lines)


@query
def code_signature_changes(spark, d):
    e = _entries(spark, d)
    return code.signature_changes(diffs.placed(e))


@query
def code_chunks(spark, d):
    return code.chunks(_files(spark, d)).groupBy("entry_id", "path").agg(F.count("*").alias("chunks"), F.max("last_line").alias("last_line"))


@query
def code_snapshot_budget(spark, d):
    return code.bounded_snapshot(_files(spark, d), 4000).select("entry_id", "path", "used")


@query
def code_verified(spark, d):
    """Verification of one finding per entry and touched file, at its first added line."""
    e = _entries(spark, d)
    files_, placed = checkpoint(diffs.files(e)), checkpoint(diffs.placed(e).where("kind <> 'context'"))  # read several times
    first = placed.where("kind = 'added'").groupBy("entry_id", "path").agg(F.min("new_line").alias("start_line"))
    text = e.select("entry_id", C.category().alias("category"), F.col("bug_fix").alias("title"), F.col("bug_description").alias("description"))
    found = files_.select("entry_id", F.col("file_idx").alias("ord"), "path").distinct().join(first, ["entry_id", "path"], "left").join(text, "entry_id").withColumnRenamed("path", "file_path")
    hits = rules.rule_hits(placed.where("kind = 'added'").select("entry_id", "path", F.col("new_line").alias("line"), "text")).select("entry_id", "path", "line", "category", "rule_id")
    return code.verify(found, placed, files_, _files(spark, d).select("entry_id", "path"), hits, found=checkpoint(code.facts(_files(spark, d)))).groupBy("method", "evidence_status").agg(F.count("*").alias("n"))


@query
def code_retrieved(spark, d):
    """The six chunks of each entry's snapshot that are nearest to its description."""
    questions = _entries(spark, d).where("trim(coalesce(bug_description, '')) <> ''").select("entry_id", F.col("bug_description").alias("text"))
    return rt.retrieve(rt.index(code.chunks(_files(spark, d))), questions)


@query
def code_dead(spark, d):
    """Imports, locals and statements that each entry's change leaves without use."""
    e = _entries(spark, d)
    lines = diffs.placed(e)
    return code.dead_code(lines, checkpoint(code.facts(_files(spark, d)))).select("entry_id", "path", "line", "rule_id", "name")


@query
def j3_line_texts(spark, d):
    """Text of line 12 of every snapshot file: as the diff shows it, else as the snapshot has it."""
    e = _entries(spark, d)
    lines = diffs.placed(e)
    files_ = _files(spark, d)
    return code.line_text(files_.select("entry_id", "path", F.lit(12).alias("line")), lines, files_).where("text is not null").select("entry_id", "path", F.md5("text").alias("digest"))


@query
def s6_commit_files(spark, d):
    return diffs.commit_files(_entries(spark, d)).select("entry_id", F.md5("files").alias("digest"))


@query
def s7_snapshots(spark, d):
    """Files of each entry as a bounded fetch takes them: changed ones first, three at most, begun within 1,500 characters."""
    changed = _entries(spark, d).select("entry_id", F.posexplode("affected_files").alias("ord", "path"))
    return rt.snapshot(_files(spark, d), changed, 1500, most=3)


@query
def s9_merged_pages(spark, d):
    """Pages of a listing, here the sorted paths of each snapshot in threes, put together again."""
    paths = _entries(spark, d).select("entry_id", F.posexplode(F.array_sort(F.map_keys("base_files"))).alias("at", "path"))
    pages = paths.groupBy("entry_id", (F.floor(F.col("at") / 3) + 1).alias("page")).agg(F.array_sort(F.collect_list(F.struct("at", "path"))).alias("x")).select("entry_id", "page", F.transform("x", lambda v: v["path"]).alias("items"))
    return readers.merged_pages(pages, "entry_id").select("entry_id", "place", "item")


@query
def s15_imported(spark, d):
    """Entries again from instances as an importer records them."""
    e = _entries(spark, d).select(F.col("entry_id").alias("instance_id"), F.col("repository").alias("repo"), F.col("parent_commit").alias("base_commit"), F.col("bug_description").alias("problem_statement"), F.col("diff").alias("patch"), F.col("base_files").alias("snapshot"))
    return diffs.imported(e).select("entry_id", "repository", "language", F.size("affected_files").alias("files"), F.size(F.map_keys("base_files")).alias("held"))


@query
def f4_enabled_findings(spark, d):
    """Findings that are left when two checks are switched off."""
    return pipeline.enabled(_findings(spark, d), {"testing": False, "i18n": False, "security": True}).select("review_id", "ord", "category")


@query
def z9_models(spark, d):
    """The model that answers for each category, with two overridden."""
    return pipeline.models(_findings(spark, d).select("category").distinct(), "small", {"security": "large", "concurrency": "large"})


@query
def z8_retried(spark, d):
    """What each entry's runs of a system come to as tries of one call: three at most, none after an exhausted budget."""
    return pipeline.retried(_scores(spark, d), ["entry_id", "system"], ["scored_at", "score_id"], 3, ("budget_exceeded",))


@query
def k4_exports(spark, d):
    """Documents of each format."""
    f = _findings(spark, d)
    made = None
    for fmt in sinks.FORMATS:
        part = sinks.documents(f, fmt).groupBy(F.lit(fmt).alias("format")).agg(F.count("*").alias("documents"), F.count_if(F.col("document") != "").alias("filled"))
        made = part if made is None else made.unionByName(part)
    return made


@query
def k8_removed(spark, d):
    """Entries that stay when the first entry of each category is removed."""
    k = rt.knowledge(_documents(spark, d))
    gone = k.groupBy("category").agg(F.min_by("content_id", "doc_id").alias("content_id"))
    return rt.removed(k, gone)[0].groupBy("kind").agg(F.count("*").alias("entries"), F.max("doc_id").alias("last"))


@query
def k11_redacted_payloads(spark, d):
    """Payloads with telling keys replaced at every depth (token counts are such keys)."""
    e = _events(spark, d).where("payload is not null")
    clean = e.select("event_no", sinks.redacted_json(F.concat(F.lit('{"run": {"items": ['), "payload", F.lit(']}, "api_key": {"deep": 1}}'))).alias("p"))
    at = lambda p: F.get_json_object("p", p)
    return clean.select("event_no", at("$.run.items[0].input_tokens").alias("input_tokens"), at("$.run.items[0].calls").alias("calls"), at("$.api_key").alias("api_key"))


@query
def g17_stage_versions(spark, d):
    """The model that each stage of a review used last, for the listed stages."""
    return events.stage_versions(_events(spark, d), ("planner", "aggregator", "verifier", "checks"))


@query
def x15_sections(spark, d):
    """A section of each document by its heading's name."""
    t = F.concat(F.lit("## Task\nReview "), F.coalesce("repository", F.lit("")), F.lit("\n## Rules\n"), F.coalesce("kind", F.lit("")), F.lit("\n\n"), F.lit("## End\n"))
    return _documents(spark, d).select("doc_id", text.section(t, "Task").alias("task"), text.section(t, "Rules").alias("rules"), text.section(t, "Absent").alias("absent"))


@query
def x18_experiment_slugs(spark, d):
    return _entries(spark, d).select("entry_id", C.experiment_slug(F.col("repository")).alias("slug"))


@query
def x22_dismissals(spark, d):
    return rt.dismissal(_findings(spark, d).where("evidence_status = 'rejected'")).select("review_id", "ord", "title", "content_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return Q | fixtures.QUERIES


def oracle_sql() -> dict[str, str]:
    from patchlake.plans.oracles import SQL

    return SQL | fixtures.SQL
