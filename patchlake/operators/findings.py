"""Findings of reviews: deduplicate, filter, rank, cluster, relate, gate, summarise.

Input rows: (review_id, ord, ...) of ``findings``; a row delivered twice counts once.  Nothing compares rows of two
reviews, so every shuffle is on review_id with a finer key where there is one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from patchlake.functions import columns as C

# fixed values: which categories together make a finding of their own, and its title
INTERACTIONS = (
    ("security", "performance"),
    ("concurrency", "data_integrity"),
    ("api_contract", "regression"),
    ("performance", "reliability"),
    ("compatibility", "data_integrity"),
    ("dependencies", "security"),
)
STRICTNESS = {"strict": ("confirmed",), "balanced": ("confirmed", "strongly_supported"), "lenient": ("confirmed", "strongly_supported", "insufficient_evidence")}
#: identifiers of these lengths and more are compared in titles
NEAR_LINES, NEAR_INTERACTION, SHARED_TOKENS = 3, 5, 2


def delivered(findings: DataFrame) -> DataFrame:
    """Each (review_id, ord) once, category normalised."""
    return findings.dropDuplicates(["review_id", "ord"]).withColumn("category", C.category())


def dedupe(findings: DataFrame) -> DataFrame:
    """Best of each (review, file, category, line): confidence, severity, first; ``first_ord`` keeps the key's place."""
    key = ["review_id", "file_path", "category", "start_line"]
    best = Window.partitionBy(*key).orderBy(F.desc("confidence"), F.desc(C.severity_rank()), "ord")
    return findings.withColumn("_n", F.row_number().over(best)).withColumn("first_ord", F.min("ord").over(Window.partitionBy(*key))).where("_n = 1").drop("_n")


def keep(findings: DataFrame, least: float = 0.6, strictness: str = "balanced") -> DataFrame:
    return findings.where((F.col("confidence") >= least - 1e-9) & F.col("evidence_status").isin(*STRICTNESS.get(strictness, STRICTNESS["balanced"])))


def rank(findings: DataFrame) -> DataFrame:
    order = Window.partitionBy("review_id").orderBy(F.desc(C.severity_rank()), F.desc("confidence"), F.desc(C.status_rank()), "ord")
    return findings.withColumn("rank", F.row_number().over(order))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("review_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in C.SEVERITY_RANK])


def interactions(findings: DataFrame) -> DataFrame:
    """Pairs of the related categories in one file within NEAR_INTERACTION lines (or without a line), as new findings."""
    pairs = findings.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(INTERACTIONS)], "pair int, category_a string, category_b string")
    f = findings.where(C.evidence_rank() >= 2).select("review_id", "ord", "category", "file_path", "start_line", "confidence", C.severity_rank().alias("sev"))
    first = F.broadcast(pairs).join(f.withColumnRenamed("category", "category_a"), "category_a").select("pair", "category_a", "category_b", "review_id", "file_path", F.col("ord").alias("ord_a"), F.col("start_line").alias("line_a"), F.col("confidence").alias("conf_a"), F.col("sev").alias("sev_a"))
    second = f.select("review_id", "file_path", F.col("category").alias("category_b"), F.col("ord").alias("ord_b"), F.col("start_line").alias("line_b"), F.col("confidence").alias("conf_b"), F.col("sev").alias("sev_b"))
    near = F.col("line_a").isNull() | F.col("line_b").isNull() | (F.abs(F.col("line_a") - F.col("line_b")) <= NEAR_INTERACTION)
    met = first.join(second, ["review_id", "file_path", "category_b"]).where(near).withColumn("start_line", F.coalesce("line_a", "line_b"))
    once = Window.partitionBy("review_id", "pair", "file_path", "start_line").orderBy("ord_a", "ord_b")
    made = met.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    return made.select("review_id", F.translate(F.concat(F.lit("interaction:"), "category_a", F.lit("-"), "category_b"), "_", "-").alias("rule_id"), F.col("category_a").alias("category"), F.col("category_b").alias("related"), "file_path", "start_line", F.greatest("sev_a", "sev_b").alias("severity_rank"), F.least("conf_a", "conf_b").alias("confidence"), "ord_a", "ord_b")


def clusters(findings: DataFrame) -> DataFrame:
    """First-fit clusters of one file: members join the first cluster whose first member is near and shares title tokens.

    The order in a file is line, falling severity, arrival; a file's findings meet in one task, which is as far as the
    rule looks.  Result: review_id, ord of every finding, cluster (ord of its first member), canonical ord, related
    categories.
    """
    rows = findings.select("review_id", "file_path", "ord", F.coalesce("start_line", F.lit(0)).alias("at"), F.col("start_line").isNull().alias("free"), C.severity_rank().alias("sev"), "confidence", "category", C.identifier_tokens(F.concat_ws(" ", "title", "description")).alias("tokens"))

    names = ["review_id", "ord", "cluster", "canonical", "related"]

    def fitted(review: str, items: list[tuple]) -> Iterator[tuple]:
        """items: (ord, at, free, sev, confidence, category, tokens) of one file in order."""
        groups: list[tuple[int, bool, set, list[tuple]]] = []
        for x in items:
            at, free, toks = x[1], x[2], set(x[6])
            for at0, free0, toks0, members in groups:
                if (free or free0 or abs(at - at0) <= NEAR_LINES) and len(toks & toks0) >= SHARED_TOKENS:
                    members.append(x)
                    break
            else:
                groups.append((at, free, toks, [x]))
        for *_, members in groups:
            best = max(members, key=lambda x: (x[3], x[4]))  # the first of the best
            related = sorted({x[5] for x in members} - {best[5]})
            for x in members:
                yield review, x[0], members[0][0], best[0], related

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, items = None, []
        for b in batches:
            out: list[tuple] = []
            for review, path, *x in zip(*(b[c] for c in ("review_id", "file_path", "ord", "at", "free", "sev", "confidence", "category", "tokens"))):
                if (review, path) != key:
                    out += fitted(key[0], items) if key else ()
                    key, items = (review, path), []
                items.append(tuple(x))
            yield pd.DataFrame(out, columns=names)
        if key:
            yield pd.DataFrame(list(fitted(key[0], items)), columns=names)

    placed = rows.repartition("review_id", "file_path").sortWithinPartitions("review_id", "file_path", "at", F.desc("sev"), "ord")
    return placed.mapInPandas(fit, "review_id string, ord bigint, cluster bigint, canonical bigint, related array<string>")


def unmentioned(findings: DataFrame, selected: DataFrame) -> DataFrame:
    """Candidates that the selection does not name (null lines equal) and that are at least strongly inferred."""
    key = ["review_id", "file_path", "category", "start_line"]
    s = selected.select(*[F.col(k).alias("s_" + k) for k in key]).distinct()
    same = None
    for k in key:
        c = F.col(k).eqNullSafe(F.col("s_" + k))
        same = c if same is None else same & c
    return findings.where(C.status_rank() >= 2).join(s, same, "left_anti")


def selections(chosen: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each chosen (review_id, sel, file_path, start_line, category, title): the candidate it means.

    First by line or category in the file, in arrival order; else by two shared title tokens.
    """
    c = candidates.select("review_id", "file_path", F.col("ord").alias("candidate"), F.col("start_line").alias("c_line"), F.col("category").alias("c_category"), C.identifier_tokens(F.col("title")).alias("c_tokens"))
    s = chosen.withColumn("tokens", C.identifier_tokens(F.col("title")))
    direct = F.coalesce(F.col("start_line") == F.col("c_line"), F.lit(False)) | (F.col("category") == F.col("c_category"))
    near = C.overlap(F.col("tokens"), F.col("c_tokens")) >= SHARED_TOKENS
    met = s.join(c, ["review_id", "file_path"]).where(direct | near).withColumn("way", F.when(direct, 0).otherwise(1))
    return met.groupBy("review_id", "sel").agg(F.min_by("candidate", F.struct("way", "candidate")).alias("candidate"), F.min("way").alias("way"))


def ignored(findings: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """Without findings in files that match one of the shell patterns."""
    out = findings
    for p in patterns:
        out = out.where(~F.col("file_path").rlike(C.glob_regex(p)))
    return out


def gate(findings: DataFrame, fail_on: str = "high") -> DataFrame:
    """review_id, failed, worst: whether some finding is at least as severe, and the first of the worst."""
    worst = F.max_by("severity", F.struct(C.severity_rank(), -F.col("ord")))
    return findings.groupBy("review_id").agg((F.max(C.severity_rank()) >= C.SEVERITY_RANK[fail_on]).alias("failed"), worst.alias("worst"))


def count_gate(findings: DataFrame, limits: dict[str, int]) -> DataFrame:
    """review_id, severity, n, most: every severity of which a review has more than its limit."""
    lim = findings.sparkSession.createDataFrame(list(limits.items()), "severity string, most bigint")
    return findings.groupBy("review_id", "severity").agg(F.count("*").alias("n")).join(F.broadcast(lim), "severity").where("n > most").select("review_id", "severity", "n", "most")


def gate_level(config: DataFrame) -> DataFrame:
    """(config_id, severity, most) rows to the least severe level that has a limit."""
    return config.where("most is not null").groupBy("config_id").agg(F.min_by("severity", C.severity_rank()).alias("level"))


def cross_tab(findings: DataFrame) -> DataFrame:
    """Every check with its counts by severity, zeros kept; unknown categories with their total only."""
    checks = findings.sparkSession.createDataFrame([(c,) for c in C.CHECKS], "category string")
    n = findings.groupBy("category").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in C.SEVERITY_RANK], F.count("*").alias("total"))
    known = F.broadcast(checks).join(n, "category", "left")
    known = known.select("category", *[F.coalesce(s, F.lit(0)).alias(s) for s in (*C.SEVERITY_RANK, "total")])
    other = n.where(~F.col("category").isin(*C.CHECKS)).select("category", *[F.lit(None).cast("bigint").alias(s) for s in C.SEVERITY_RANK], "total")
    return known.unionByName(other)


def verification_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("review_id").agg(
        *[F.count_if(F.col("evidence_status") == s).alias(s) for s in C.EVIDENCE_RANK],
        (F.floor(F.sum(F.round(F.col("confidence") * 1e6).cast("bigint")) / F.count("confidence")) / 1e6).alias("mean_confidence"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
    )


def finding_id() -> Column:
    return F.concat_ws(":", F.col("file_path"), F.coalesce(F.col("start_line").cast("string"), F.lit("None")), F.col("category"))


def embedded_patches(findings: DataFrame) -> DataFrame:
    """Findings whose recommendation carries a patch, with it: from its first header to a fence, a blank line or the end."""
    return findings.withColumn("patch", F.regexp_extract(F.coalesce("recommendation", F.lit("")), r"(?s)(diff --git .*?)(?:```|\n\n|$)", 1)).where("patch <> ''")
