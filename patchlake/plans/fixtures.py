"""Operators over small stated cases, for what the tables hold no case of or SQL cannot ask; the answers are in ``SQL``.

Every query runs over its whole fixture.  The answers were recorded from a run and then read against their cases, which found
one fault (flows through functions of other files), mended before they were recorded again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from patchlake.operators import code, diffs, findings as fi, retrieval as rt

APP = '''import os
import json
from helpers import clean_path, run_query, forward
LIMIT = 10
class Store(Base):
    pass
def read(path, mode=[]):
    key = os.environ["KEY"]
    home = os.getenv("HOME")
    left = 1
    return open(path)
async def poll():
    time.sleep(1)
@app.get("/items")
def items(request):
    name = request
    cursor.execute(f"select {name}")
    run_query(name)
    safe = clean_path(name)
    os.remove(safe)
    other = forward(name)
    os.remove(other)
    return eval("1")
    print(name)
def test_read():
    try:
        read("x")
    except:
        pass
def walk(rows, more):
    for i in range(3):
        use(rows[i])
    for j in range(len(more)):
        use(more[j])
'''
HELPERS = '''def run_query(text):
    db.execute(text)
def clean_path(p):
    return "/fixed"
def forward(p):
    q = p
    return q
def run_query(text):
    return text
'''
FILES = "entry_id string, path string, content string"
CHUNKED = {
    "a.py": "class A:\n    pass\ndef f(x):\n    return x\n", "a.js": "class B {\n}\nconst g = (x) => {\n  return x;\n};\n", "a.ts": "export interface Shape {\n  size: number;\n}\nexport enum Kind {\n  One,\n}\n", "a.go": "type T struct {\n}\nfunc (t T) Run() {\n}\n",
    "A.java": "public class J {\n    public int get(int x) {\n        return x;\n    }\n}\n", "a.rs": "pub struct R {\n}\nfn build() {\n}\n", "a.rb": "module M\n  def go\n    1\n  end\nend\n", "a.sh": "start() {\n  echo 1\n}\n", "a.c": "int add(int a, int b)\n{\n  return a + b;\n}\n",
    "a.cpp": "namespace ns {\n}\nclass K {\n};\n", "a.kt": "data class P(val x: Int) {\n}\nfun main() {\n}\n", "a.swift": "struct S {\n}\npublic func draw() {\n}\n",
}
IMPORTS = ("import os, sys as system", "from a.b import c, d as e", "import React, { useState, useRef as ref } from 'react';", "import * as fs from 'fs'", "const { join, sep: mark } = require('path')", "let net = require('net')", "x = 1")
DIFF = """diff --git a/app.py b/app.py
--- a/app.py
+++ b/app.py
@@ -1,3 +1,5 @@
 def total(rows):
-    return sum(rows)
+    import helpers
+    value = run_query(rows)
+    return eval(value)
 END = 1
"""


def _files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("e", "app.py", APP), ("e", "helpers.py", HELPERS), ("e", "broken.py", "def ("), ("e", "empty.py", ""), ("e", "notes.txt", "def x(): pass"), ("e", "none.py", None)], FILES)


def _lines(spark: SparkSession, diff: str = DIFF) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = spark.createDataFrame([("e", diff)], "entry_id string, diff string")
    files = diffs.files(e)
    return e, files, diffs.numbered(e).join(files.select("entry_id", "file_idx", "path"), ["entry_id", "file_idx"])


def fx_definitions(spark: SparkSession, d: str) -> DataFrame:
    """Definitions, imports, environment reads, routes and tests."""
    kinds = ("import", "function", "async", "class", "variable", "env", "route", "test")
    return code.facts(_files(spark)).where(F.col("fact").isin(*kinds)).select("path", "fact", "name", "line", "detail")


def fx_flaws(spark: SparkSession, d: str) -> DataFrame:
    """P9 to P14 and what dead code is made of, with the line of each."""
    kinds = ("mutable-default", "dangerous-call", "sql-construction", "bare-except", "swallowed-except", "blocking-in-async", "unreachable", "unused-local", "unchecked-index")
    return code.facts(_files(spark)).where(F.col("fact").isin(*kinds)).select("path", F.col("fact").alias("rule_id"), "name", "line")


def fx_taint(spark: SparkSession, d: str) -> DataFrame:
    """Flows within a file, through functions of another file, and none through what returns something else."""
    files = _files(spark)
    return code.cross_file_taint(files, code.facts(files)).where("fact = 'taint'").select("path", F.col("name").alias("kind"), "line", F.col("detail").alias("chain"))


def fx_callers(spark: SparkSession, d: str) -> DataFrame:
    """Call sites of what the snapshot defines."""
    return code.callers(code.facts(_files(spark))).select("name", "path", "line")


def fx_enclosing(spark: SparkSession, d: str) -> DataFrame:
    """The innermost function of a line."""
    lines = spark.createDataFrame([("e", "app.py", 8), ("e", "app.py", 17), ("e", "app.py", 4)], "entry_id string, path string, line int")
    return code.enclosing(code.facts(_files(spark)), lines).select("path", "line", "function")


def fx_dead_code(spark: SparkSession, d: str) -> DataFrame:
    """Only what the change touches."""
    _, _, lines = _lines(spark)
    held = "def total(rows):\n    import helpers\n    value = run_query(rows)\n    return eval(value)\n    late = 1\ndef other():\n    kept = 1\n"
    found = code.facts(spark.createDataFrame([("e", "app.py", held)], FILES))
    return code.dead_code(lines, found).select("path", "line", "rule_id", "name")


def fx_signature_changes(spark: SparkSession, d: str) -> DataFrame:
    """P15."""
    diff = "--- a/m.py\n+++ b/m.py\n@@ -1,4 +1,4 @@\n-def f(a):\n+def f(a, b):\n     pass\n-def g(a):\n+def g(a):\n"
    return code.signature_changes(_lines(spark, diff)[2]).select("path", "name", "line")


def fx_verifier(spark: SparkSession, d: str) -> DataFrame:
    """Every outcome of the decision, J1 to J3 with it."""
    _, files, lines = _lines(spark)
    rows = [
        (1, "helpers.py", 1, "security", "x", ""), (2, "absent.py", 1, "security", "x", ""), (3, "app.py", None, "security", "x", ""), (4, "app.py", 99, "security", "x", ""), (5, "app.py", 4, "security", "rule", ""),
        (6, "app.py", 4, "testing", "the eval call", ""), (7, "app.py", 3, "testing", "zzz_unknown qqq_nothing", ""), (8, "app.py", 3, "testing", "a b", ""), (9, "app.py", 4, "correctness", "zzz_unknown", ""),
    ]
    found = spark.createDataFrame([("e", *r) for r in rows], "entry_id string, ord bigint, file_path string, start_line int, category string, title string, description string")
    held = "def total(rows):\n    import helpers\n    value = run_query(rows)\n    return eval(value)\n"
    facts = code.facts(spark.createDataFrame([("e", "app.py", held)], FILES))
    hits = spark.createDataFrame([("e", "app.py", 4, "security", "eval-exec")], "entry_id string, path string, line int, category string, rule_id string")
    snapshot = spark.createDataFrame([("e", "app.py"), ("e", "helpers.py")], "entry_id string, path string")
    return code.verify(found, lines, files, snapshot, hits, found=facts).select("ord", "method", "evidence_status", F.coalesce("rules", F.lit("")).alias("rules"))


def fx_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of twelve languages."""
    files = spark.createDataFrame([("e", p, t) for p, t in CHUNKED.items()], FILES)
    return code.chunks(files).select("path", "kind", "symbol", "first_line")


def fx_retrieved(spark: SparkSession, d: str) -> DataFrame:
    """P25: the nearest chunk of the question's own snapshot."""
    files = spark.createDataFrame([("e", "a.py", "def parse_header(line):\n    return line\n"), ("e", "b.py", "def write_footer(page):\n    return page\n"), ("o", "c.py", "def parse_header(line):\n    return line\n")], FILES)
    asked = spark.createDataFrame([("e", "where is parse_header of a line"), ("o", "nothing alike here")], "entry_id string, text string")
    return rt.retrieve(rt.index(code.chunks(files)), asked, 1).select("entry_id", "path", "first_line")


def fx_import_names(spark: SparkSession, d: str) -> DataFrame:
    """What import lines of three languages bind."""
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(IMPORTS)], "n int, text string")
    return lines.select("n", F.explode(code.imported_names(F.col("text"))).alias("name"))


def fx_system_differences(spark: SparkSession, d: str) -> DataFrame:
    """U4: systems of one run only."""
    s = spark.createDataFrame([("r-0", "a"), ("r-0", "b"), ("r-1", "b"), ("r-1", "c")], "run_id string, system string")
    a, b = (s.where(F.col("run_id").endswith(x)).select("system").distinct() for x in ("-0", "-1"))
    return a.join(b, "system", "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, "system", "left_anti").withColumn("side", F.lit("extra")))


def fx_embedded_patches(spark: SparkSession, d: str) -> DataFrame:
    """Patches within recommendations."""
    f = spark.createDataFrame([(1, "Try this:\n```diff\ndiff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n```\nDone."), (2, "No patch."), (3, None)], "ord bigint, recommendation string")
    return fi.embedded_patches(f).select("ord", F.length("patch").alias("n_chars"))


def _inline(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Findings of one review: ord, category, severity, confidence, title, file_path, start_line, evidence_status."""
    f = spark.createDataFrame(rows, "ord bigint, category string, severity string, confidence double, title string, file_path string, start_line int, evidence_status string")
    return f.withColumns({"review_id": F.lit("r"), "description": F.col("title"), "verification_status": F.lit("verified"), "related_files": F.array().cast("array<string>")})


def fx_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Findings near one another that share words fall together, in whatever order they come."""
    rows = [(1, "security", "high", 0.9, "unsafe query built", "a.py", 10, "confirmed"), (2, "correctness", "low", 0.5, "unsafe query built here", "a.py", 12, "confirmed"), (3, "testing", "low", 0.5, "nothing alike", "b.py", 1, "confirmed")]
    return fi.clusters(_inline(spark, rows)).groupBy("cluster").agg(F.count("*").alias("n"), F.min("ord").alias("first")).select("n", "first")


def fx_interactions(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of related categories near one another in a file, by evidence strong enough."""
    a, b = fi.INTERACTIONS[0]
    rows = [
        (1, a, "high", 0.9, "x", "a.py", 10, "confirmed"), (2, b, "low", 0.7, "y", "a.py", 10 + fi.NEAR_INTERACTION, "strongly_supported"), (3, b, "low", 0.7, "y", "a.py", 11 + fi.NEAR_INTERACTION, "confirmed"),
        (4, a, "low", 0.5, "x", "b.py", 1, "confirmed"), (5, b, "info", 0.6, "y", "b.py", None, "confirmed"), (6, a, "low", 0.5, "x", "c.py", 1, "rejected"), (7, b, "low", 0.5, "x", "c.py", 1, "confirmed"),
    ]
    return fi.interactions(_inline(spark, rows)).select("file_path", "start_line", "severity_rank", "confidence", "ord_a", "ord_b")


def fx_selections(spark: SparkSession, d: str) -> DataFrame:
    """What a selection means, by line or category first, else by shared words."""
    candidates = _inline(spark, [(1, "security", "low", 0.5, "query built from input", "a.py", 3, "confirmed"), (2, "testing", "low", 0.5, "missing test case", "a.py", 9, "confirmed"), (3, "testing", "low", 0.5, "same line", "a.py", 3, "confirmed")])
    chosen = spark.createDataFrame([("r", 10, "a.py", 3, "privacy", "other"), ("r", 11, "a.py", 50, "privacy", "query built wrongly"), ("r", 12, "a.py", 50, "testing", "query built wrongly"), ("r", 13, "z.py", 3, "testing", "missing test case")], "review_id string, sel bigint, file_path string, start_line int, category string, title string")
    return fi.selections(chosen, candidates).select("sel", "candidate", "way")


QUERIES = {k: f for k, f in globals().items() if k.startswith("fx_")}
SQL = {
    "fx_definitions": (
        "SELECT * FROM (VALUES ('app.py', 'async', 'poll', 12, ''), ('app.py', 'class', 'Store', 5, 'Base'), ('app.py', 'env', 'HOME', 9, 'os.getenv'), ('app.py', 'env', 'KEY', 8, 'os.environ[]'), ("
        "'app.py', 'function', 'items', 15, 'request'), ('app.py', 'function', 'read', 7, 'path,mode'), ('app.py', 'function', 'test_read', 25, ''), ('app.py', 'function', 'walk', 30, 'rows,more'), ("
        "'app.py', 'import', 'clean_path', 3, 'helpers.clean_path'), ('app.py', 'import', 'forward', 3, 'helpers.forward'), ('app.py', 'import', 'json', 2, 'json'), ('app.py', 'import', 'os', 1, 'os'), ("
        "'app.py', 'import', 'run_query', 3, 'helpers.run_query'), ('app.py', 'route', 'items', 15, 'GET /items'), ('app.py', 'test', 'test_read', 25, ''), ('app.py', 'variable', 'LIMIT', 4, ''), ("
        "'helpers.py', 'function', 'clean_path', 3, 'p'), ('helpers.py', 'function', 'forward', 5, 'p'), ('helpers.py', 'function', 'run_query', 1, 'text'), ("
        "'helpers.py', 'function', 'run_query', 8, 'text')) v(path, fact, name, line, detail)"
    ),
    "fx_flaws": (
        "SELECT * FROM (VALUES ('app.py', 'bare-except', '', 28), ('app.py', 'blocking-in-async', 'time.sleep', 13), ('app.py', 'dangerous-call', 'eval', 23), ('app.py', 'mutable-default', 'read', 7), ("
        "'app.py', 'sql-construction', 'cursor.execute', 17), ('app.py', 'swallowed-except', '', 28), ('app.py', 'unchecked-index', 'rows', 32), ('app.py', 'unreachable', 'items', 24), ("
        "'app.py', 'unused-local', 'home', 9), ('app.py', 'unused-local', 'key', 8), ('app.py', 'unused-local', 'left', 10)) v(path, rule_id, name, line)"
    ),
    "fx_taint": (
        "SELECT * FROM (VALUES ('app.py', 'fs', 22, 'request > name > forward() > other > os.remove'), ('app.py', 'sql', 17, 'request > name > cursor.execute'), ("
        "'app.py', 'sql', 18, 'request > name > run_query()')) v(path, kind, line, chain)"
    ),
    "fx_callers": (
        "SELECT * FROM (VALUES ('clean_path', 'app.py', 19), ('forward', 'app.py', 21), ('read', 'app.py', 27), ('run_query', 'app.py', 18)) v(name, path, line)"
    ),
    "fx_enclosing": (
        "SELECT * FROM (VALUES ('app.py', 17, 'items'), ('app.py', 8, 'read')) v(path, line, function)"
    ),
    "fx_dead_code": (
        "SELECT * FROM (VALUES ('app.py', 2, 'unused-import', 'helpers'), ('app.py', 5, 'unused-local', 'late')) v(path, line, rule_id, name)"
    ),
    "fx_signature_changes": (
        "SELECT * FROM (VALUES ('m.py', 'f', 1)) v(path, name, line)"
    ),
    "fx_verifier": (
        "SELECT * FROM (VALUES (1, 'file-exists-outside-diff', 'insufficient_evidence', ''), (2, 'file-not-in-diff', 'rejected', ''), (3, 'no-line-reference', 'insufficient_evidence', ''), ("
        "4, 'line-outside-hunks', 'rejected', ''), (5, 'deterministic-rule-match', 'confirmed', 'dangerous-call,eval-exec'), (6, 'changed-line-and-identifier-overlap', 'strongly_supported', ''), ("
        "7, 'contradicts-repository', 'rejected', ''), (8, 'line-inside-changed-hunk', 'strongly_supported', ''), ("
        "9, 'deterministic-rule-match', 'confirmed', 'dangerous-call')) v(ord, method, evidence_status, rules)"
    ),
    "fx_chunks": (
        "SELECT * FROM (VALUES ('A.java', 'class', 'J', 1), ('a.c', 'function', 'add', 1), ('a.cpp', 'class', 'K', 3), ('a.cpp', 'namespace', 'ns', 1), ('a.go', 'function', 'Run', 3), ("
        "'a.go', 'type', 'T', 1), ('a.js', 'class', 'B', 1), ('a.js', 'function', 'g', 3), ('a.kt', 'class', 'P', 1), ('a.kt', 'function', 'main', 3), ('a.py', 'class', 'A', 1), ('a.py', 'function', 'f', 3), ("
        "'a.rb', 'method', 'go', 2), ('a.rb', 'module', 'M', 1), ('a.rs', 'function', 'build', 3), ('a.rs', 'struct', 'R', 1), ('a.sh', 'function', 'start', 1), ('a.swift', 'function', 'draw', 3), ("
        "'a.swift', 'type', 'S', 1), ('a.ts', 'enum', 'Kind', 4), ('a.ts', 'interface', 'Shape', 1)) v(path, kind, symbol, first_line)"
    ),
    "fx_retrieved": (
        "SELECT * FROM (VALUES ('e', 'a.py', 1)) v(entry_id, path, first_line)"
    ),
    "fx_import_names": (
        "SELECT * FROM (VALUES (0, 'os'), (0, 'system'), (1, 'c'), (1, 'e'), (2, 'React'), (2, 'ref'), (2, 'useState'), (3, 'fs'), (4, 'join'), (4, 'mark'), (5, 'net')) v(n, name)"
    ),
    "fx_system_differences": (
        "SELECT * FROM (VALUES ('a', 'missing'), ('c', 'extra')) v(system, side)"
    ),
    "fx_embedded_patches": (
        "SELECT * FROM (VALUES (1, 53)) v(ord, n_chars)"
    ),
    "fx_clusters": (
        "SELECT * FROM (VALUES (1, 3), (2, 1)) v(n, first)"
    ),
    "fx_interactions": (
        "SELECT * FROM (VALUES ('a.py', 10, 3, 0.7, 1, 2), ('b.py', 1, 1, 0.5, 4, 5)) v(file_path, start_line, severity_rank, confidence, ord_a, ord_b)"
    ),
    "fx_selections": (
        "SELECT * FROM (VALUES (10, 1, 0), (11, 1, 1), (12, 2, 0)) v(sel, candidate, way)"
    ),
}
