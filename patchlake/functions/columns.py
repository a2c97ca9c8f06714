"""Column expressions shared by the operators: ranks, status maps, tokens, identifiers, severity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# fixed values: ranks and levels of the review model
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
EVIDENCE_RANK = {"confirmed": 3, "strongly_supported": 2, "insufficient_evidence": 1, "rejected": 0}
STATUS_RANK = {"verified": 3, "strongly_inferred": 2, "potential": 1, "unverified": 0}
STATUS_OF_EVIDENCE = {"confirmed": "verified", "strongly_supported": "strongly_inferred", "insufficient_evidence": "potential", "rejected": "unverified"}
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
SEVERITY_WEIGHTS = {"impact_factor": 0.4, "likelihood": 0.25, "blast_radius": 0.2, "exploitability": 0.15}
SEVERITY_CUTS = ((0.82, "critical"), (0.6, "high"), (0.38, "medium"), (0.2, "low"))
CHECKS = (
    "correctness", "security", "error_handling", "testing", "regression", "performance", "maintainability", "observability", "data_integrity", "accessibility", "concurrency",
    "dependencies", "privacy", "i18n", "api_contract", "requirement_alignment", "authorization", "reliability", "architecture", "compatibility", "configuration", "resource_lifecycle", "dead_code",
)
EXTENSION_LANGUAGE = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp",
    "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "kt": "kotlin", "swift": "swift", "sh": "shell", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml", "md": "markdown", "sql": "sql",
}


def lookup(c: Column, table: dict, default: object = None) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(default))


def severity_rank(c: str = "severity") -> Column:
    return lookup(F.col(c), SEVERITY_RANK, 0)


def evidence_rank(c: str = "evidence_status") -> Column:
    return lookup(F.col(c), EVIDENCE_RANK, 0)


def status_rank(c: str = "verification_status") -> Column:
    return lookup(F.col(c), STATUS_RANK, 0)


def category(c: str = "category") -> Column:
    """Trimmed, lower case, general where empty."""
    bare = F.lower(F.regexp_replace(F.col(c), r"^\s+|\s+$", ""))
    return F.when(F.col(c).isNull() | (bare == ""), F.lit("general")).otherwise(bare)


def identifier_tokens(c: Column) -> Column:
    """Distinct identifiers of three characters and more in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[A-Za-z_][\p{L}\p{N}_]{2,}"), F.lit(0)), F.lower))


def word_tokens(c: Column) -> Column:
    """Identifiers and whole numbers in lower case, with repetitions."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[A-Za-z_][\p{L}\p{N}_]*|(?<![\p{L}\p{N}_])\p{Nd}+(?![\p{L}\p{N}_])"), F.lit(0)), F.lower)


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("bigint")


def experiment_slug(c: Column) -> Column:
    """A name for a folder: lower case, runs of other signs to one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_.\-]", "_")


def directory(c: Column) -> Column:
    return F.regexp_extract(c, r"^(.*)/", 1)


def extension_language(path: Column) -> Column:
    return lookup(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)), EXTENSION_LANGUAGE, "unknown")


def content_id(*fields: Column) -> Column:
    """First 16 hex digits of the sha256 of the fields joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *[F.coalesce(f, F.lit("")) for f in fields]), 256), 1, 16)


def hashed_index(token: Column, dim: int) -> Column:
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % dim).cast("int")


def hashed_sign(token: Column) -> Column:
    return F.when(F.conv(F.substring(F.md5(token), 9, 2), 16, 10).cast("int") % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))


def derived_severity() -> Column:
    """Weighted factors against the cuts."""
    score = reduce(lambda a, b: a + b, [F.lit(w) * F.col(c) for c, w in SEVERITY_WEIGHTS.items()])
    out = F.when(score >= SEVERITY_CUTS[0][0], SEVERITY_CUTS[0][1])
    for cut, name in SEVERITY_CUTS[1:]:
        out = out.when(score >= cut, name)
    return out.otherwise("info")


def stabilised_severity() -> Column:
    """The derived severity where some factor is decided, else the one given."""
    decided = reduce(lambda a, b: a | b, [(F.col(c) <= 0.15) | (F.col(c) >= 0.85) for c in SEVERITY_WEIGHTS])
    return F.when(decided, derived_severity()).otherwise(F.col("severity"))


def dot(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    pair = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pair, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """A zero norm counts as 1."""
    norm = lambda v: F.coalesce(F.nullif(F.sqrt(dot(v, v)), F.lit(0.0)), F.lit(1.0))
    return dot(a, b) / (norm(a) * norm(b))


def glob_regex(pattern: str) -> str:
    """Shell pattern in which * crosses slashes, as a regular expression over the whole path."""
    import fnmatch

    return "^" + fnmatch.translate(pattern).replace("(?s:", "(?:").replace(r")\Z", ")$").replace(r")\z", ")$")
