from itertools import product

from pyspark.sql import functions as F

from patchlake.functions import columns as C
from patchlake.operators import findings as fi

SCHEMA = "review_id string, ord bigint, category string, severity string, confidence double, title string, description string, file_path string, start_line int, verification_status string, evidence_status string, rule_id string, repository string"


def make(spark, rows):
    base = {"review_id": "r", "category": "security", "severity": "high", "confidence": 0.9, "title": "query builder leaks", "description": "user value reaches query builder", "file_path": "db.py", "start_line": 11, "verification_status": "verified", "evidence_status": "confirmed", "rule_id": None, "repository": ""}
    names = [x.strip().split()[0] for x in SCHEMA.split(",")]
    return spark.createDataFrame([tuple((base | {"ord": i} | r)[n] for n in names) for i, r in enumerate(rows)], SCHEMA)


def test_dedupe_takes_confidence_then_severity_then_order(spark):
    f = make(spark, [{"confidence": 0.5}, {"confidence": 0.9, "severity": "low"}, {"confidence": 0.9, "severity": "high"}, {"confidence": 0.9, "severity": "high"}])
    assert [(r.ord, r.first_ord) for r in fi.dedupe(f).collect()] == [(2, 0)]


def test_dedupe_meets_null_lines(spark):
    f = make(spark, [{"start_line": None}, {"start_line": None, "confidence": 1.0}, {"start_line": 1}])
    assert sorted(r.ord for r in fi.dedupe(f).collect()) == [1, 2]


def test_filter_by_strictness_and_confidence(spark):
    f = make(spark, [{"evidence_status": e, "confidence": c} for e, c in product(C.EVIDENCE_RANK, (0.59, 0.6))])
    assert fi.keep(f, 0.6, "strict").count() == 1
    assert fi.keep(f, 0.6, "balanced").count() == 2
    assert fi.keep(f, 0.6, "lenient").count() == 3
    assert fi.keep(f, 0.6, "unknown").count() == 2


def test_rank_is_stable(spark):
    f = make(spark, [{"severity": "low"}, {}, {}, {"confidence": 0.95}])
    assert [r.ord for r in fi.rank(f).orderBy("rank").collect()] == [3, 1, 2, 0]


def test_interactions_need_pair_file_and_near_lines(spark):
    rows = [{"category": "security", "start_line": 10, "confidence": 0.7}, {"category": "performance", "start_line": 15, "severity": "critical"}, {"category": "performance", "start_line": 16}, {"category": "performance", "file_path": "x.py", "start_line": 10}]
    got = fi.interactions(make(spark, rows)).collect()
    assert [(r.rule_id, r.severity_rank, r.confidence, r.ord_a, r.ord_b) for r in got] == [("interaction:security-performance", 4, 0.7, 0, 1)]
    free = fi.interactions(make(spark, [{"category": "concurrency", "start_line": None}, {"category": "data_integrity", "start_line": 500}])).collect()
    assert len(free) == 1 and free[0].start_line == 500
    weak = fi.interactions(make(spark, [{"category": "security", "evidence_status": "insufficient_evidence"}, {"category": "performance"}]))
    assert weak.count() == 0


def test_first_fit_clusters_compare_with_the_first_member(spark):
    # a~b and b~c, but a and c are too far apart: c begins a cluster of its own
    f = make(spark, [{"start_line": 10, "category": "security"}, {"start_line": 13, "category": "performance", "severity": "critical"}, {"start_line": 16, "category": "testing"}])
    got = {r.ord: (r.cluster, r.canonical, r.related) for r in fi.clusters(f).collect()}
    assert got == {0: (0, 1, ["security"]), 1: (0, 1, ["security"]), 2: (2, 2, [])}


def test_clusters_do_not_depend_on_partitions(spark):
    f = make(spark, [{"start_line": i % 7, "title": f"value {w} builder", "description": w} for i, w in enumerate(["alpha", "beta"] * 10)])
    key = lambda d: sorted((r.ord, r.cluster, r.canonical) for r in fi.clusters(d).collect())
    assert key(f) == key(f.repartition(7)) == key(f.coalesce(1))


def test_unmentioned_compares_null_lines(spark):
    f = make(spark, [{"start_line": None}, {"start_line": 3}, {"start_line": 4, "verification_status": "potential"}])
    assert [r.ord for r in fi.unmentioned(f, f.where("ord = 0")).collect()] == [1]


def test_selection_prefers_place_over_words(spark):
    c = make(spark, [{"title": "cache key missing", "start_line": 90, "category": "testing"}, {"start_line": 11, "category": "i18n", "title": "other"}])
    chosen = spark.createDataFrame([("r", 5, "db.py", 11, "privacy", "cache key wrong"), ("r", 6, "db.py", 1, "privacy", "cache key wrong"), ("r", 7, "db.py", 1, "privacy", "nothing alike")], "review_id string, sel bigint, file_path string, start_line int, category string, title string")
    assert {r.sel: r.candidate for r in fi.selections(chosen, c).collect()} == {5: 1, 6: 0}


def test_gates(spark):
    f = make(spark, [{"severity": "medium"}, {"severity": "high"}, {"severity": "high"}])
    g = fi.gate(f, "high").first()
    assert g.failed and g.worst == "high"
    assert not fi.gate(f, "critical").first().failed
    assert [(r.severity, r.n) for r in fi.count_gate(f, {"high": 1, "medium": 1}).collect()] == [("high", 2)]


def test_ignored_star_crosses_directories(spark):
    f = make(spark, [{"file_path": p} for p in ("a/b/test_x.py", "test_x.py", "src/app.py")])
    assert sorted(r.file_path for r in fi.ignored(f, ("**/test_*.py",)).collect()) == ["src/app.py", "test_x.py"]


def test_severity_from_factors(spark):
    rows = [("medium", 1.0, 1.0, 1.0, 1.0), ("medium", 0.5, 0.5, 0.5, 0.5), ("high", 0.1, 0.1, 0.1, 0.1)]
    d = spark.createDataFrame(rows, "severity string, impact_factor double, likelihood double, blast_radius double, exploitability double")
    assert [r[0] for r in d.select(C.stabilised_severity()).collect()] == ["critical", "medium", "info"]


def test_empty_table(spark):
    f = make(spark, [])
    for g in (fi.dedupe(f), fi.keep(f), fi.rank(f), fi.interactions(f), fi.clusters(f), fi.severity_counts(f), fi.gate(f)):
        assert g.count() == 0
    assert fi.cross_tab(f).where(F.col("total") == 0).count() == len(C.CHECKS)
