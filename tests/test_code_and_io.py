import json
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from patchlake.functions import columns as C
from patchlake.operators import code, evaluation as ev, retrieval
from patchlake.plans import pipeline
from patchlake.sources import readers, sinks
from patchlake.sources.local_git import LocalGit

SOURCE = '''
import os
import json, sys
from a import b as c

@app.get("/items")
def items(q, limit=[]):
    name = q
    db.execute("select " + name)
    safe = int(q)
    db.execute(safe)
    db.execute("select ?", (name,))
    unused = 1
    return os.getenv("HOME_DIR")
    print("never")

async def wait():
    time.sleep(1)
    try:
        run(os.environ["TOKEN"])
    except:
        pass

def run(cmd):
    os.system(cmd)

def outer(request):
    run(request)
'''


def facts():
    return {(f, n, d if f in ("route", "taint") else "") for f, n, _, d in code.facts_of(SOURCE)}


def test_facts_of_a_file():
    got = facts()
    for want in [("import", "os", ""), ("import", "sys", ""), ("import", "c", ""), ("route", "items", "GET /items"), ("mutable-default", "items", ""), ("env", "HOME_DIR", ""), ("env", "TOKEN", ""), ("blocking-in-async", "time.sleep", ""), ("bare-except", "", ""), ("swallowed-except", "", ""), ("unreachable", "items", ""), ("unused-local", "unused", ""), ("dangerous-call", "os.system", ""), ("sql-construction", "db.execute", "")]:
        assert want in got, want


def test_taint_follows_assignments_and_calls_and_stops_at_sanitizers():
    chains = {(k, d) for f, k, _, d in code.facts_of(SOURCE) if f == "taint"}
    assert ("sql", "q > name > db.execute") in chains
    assert ("shell", "request > run()") in chains
    assert not any("safe" in d for _, d in chains)
    assert sum(k == "sql" for k, _ in chains) == 1


def test_unparsable_files_are_skipped(spark):
    files = spark.createDataFrame([("e", "a.py", "def f(:"), ("e", "b.py", None), ("e", "c.txt", "x"), ("e", "d.py", "import os\nprint(os)\nimport sys")], "entry_id string, path string, content string")
    found = code.facts(files)
    assert {r.path for r in found.collect()} == {"d.py"}
    assert [r.name for r in code.unused_imports(found).collect()] == ["sys"]


def test_callers_and_enclosing(spark):
    files = spark.createDataFrame([("e", "a.py", "def f():\n    def g():\n        f()\n    g()\n"), ("e", "b.py", "f()\n")], "entry_id string, path string, content string")
    found = code.facts(files)
    assert {(r.name, r.path, r.line) for r in code.callers(found).collect()} == {("f", "a.py", 3), ("f", "b.py", 1), ("g", "a.py", 4)}
    lines = spark.createDataFrame([("e", "a.py", 3), ("e", "a.py", 4)], "entry_id string, path string, line int")
    assert {r.line: r.function for r in code.enclosing(found, lines).collect()} == {3: "g", 4: "f"}


def test_loop_indexes_contradictions_words_and_signatures(spark):
    src = "for i in range(len(a)):\n    a[i] = b[i]\n"
    assert [(n, line) for f, n, line, _ in code.facts_of(src) if f == "unchecked-index"] == [("b", 2)]
    files = spark.createDataFrame([("e", "a.py", "def total(rows):\n    return rows\n")], "entry_id string, path string, content string")
    f = spark.createDataFrame([("e", 0, "total is wrong", ""), ("e", 1, "subtotal is wrong", ""), ("other", 0, "subtotal", "")], "entry_id string, ord int, title string, description string")
    assert [(r.entry_id, r.ord) for r in code.contradictions(f, code.facts(files)).collect()] == [("e", 1)]
    names = spark.createDataFrame([("e", "a.py", 1, "os"), ("e", "a.py", 2, "re")], "entry_id string, path string, line int, name string")
    lines = spark.createDataFrame([("e", "a.py", 1, "import os"), ("e", "a.py", 2, "import re"), ("e", "b.py", 1, "re.sub(oss)")], "entry_id string, path string, line int, text string")
    assert [r.name for r in code.unreferenced(names, lines).collect()] == ["os"]
    d = spark.createDataFrame([("e", "a.py", "removed", None, "def f(a):"), ("e", "a.py", "added", 3, "def f(a, b):"), ("e", "a.py", "added", 9, "def g(a):")], "entry_id string, path string, kind string, new_line int, text string")
    assert [(r.name, r.line) for r in code.signature_changes(d).collect()] == [("f", 3)]


def test_chunks_are_anchored_at_symbols():
    text = "import os\n\nclass A:\n    def f(self):\n        return 1\n\ndef g():\n    return 2\n"
    assert [(c[0], c[1], c[2]) for c in code.chunk("a.py", text, "python")] == [("A", "class", 3), ("f", "function", 4), ("g", "function", 7)]
    js = "function a() {\n  b();\n}\n"
    assert [(c[0], c[2], c[3]) for c in code.chunk("a.js", js, "javascript")] == [("a", 1, 3)]
    wide = code.chunk("x.c", "line of text\n" * 500, "c")
    assert len(wide) > 3 and all(len(c[4]) <= 1500 for c in wide) and wide[1][2] < wide[0][3] + 1


def test_verifier_table(spark):
    lines = spark.createDataFrame([("e", "a.py", 5, "value = eval(token)", "added", 0)], "entry_id string, path string, new_line int, text string, kind string, pos int")
    files = spark.createDataFrame([("e", "a.py")], "entry_id string, path string")
    snapshot = spark.createDataFrame([("e", "z.py")], "entry_id string, path string")
    hits = spark.createDataFrame([("e", "a.py", 5, "security", "eval-exec")], "entry_id string, path string, line int, category string, rule_id string")
    rows = [(0, "z.py", 1, "security", "x"), (1, "nope.py", 1, "security", "x"), (2, "a.py", None, "security", "x"), (3, "a.py", 9, "security", "x"), (4, "a.py", 5, "security", "x"), (5, "a.py", 5, "testing", "value is wrong"), (6, "a.py", 5, "testing", "else")]
    f = spark.createDataFrame([("e", *r, "") for r in rows], "entry_id string, ord int, file_path string, start_line int, category string, title string, description string")
    got = {r.ord: (r.method, r.evidence_status) for r in code.verify(f, lines, files, snapshot, hits).collect()}
    assert [got[i][1] for i in range(7)] == ["insufficient_evidence", "rejected", "insufficient_evidence", "rejected", "confirmed", "strongly_supported", "strongly_supported"]
    assert got[5][0] == "changed-line-and-identifier-overlap" and got[6][0] == "line-inside-changed-hunk"


def test_verifier_reads_flaws_taint_and_contradictions(spark):
    text = "import pickle\ndef handle(request):\n    cursor.execute(request.args)\n    try:\n        run(1)\n    except ValueError:\n        pass\n"
    found = code.facts(spark.createDataFrame([("e", "a.py", text)], "entry_id string, path string, content string"))
    lines = spark.createDataFrame([("e", "a.py", i + 1, x, "added", i) for i, x in enumerate(text.split("\n"))], "entry_id string, path string, new_line int, text string, kind string, pos int")
    files = spark.createDataFrame([("e", "a.py")], "entry_id string, path string")
    none = spark.createDataFrame([], "entry_id string, path string, line int, category string, rule_id string")
    rows = [(0, 3, "testing", "zzz"), (1, 6, "error_handling", "zzz"), (2, 6, "testing", "zzz"), (3, 5, "testing", "run"), (4, 2, "testing", "pickle"), (5, 1, "dead_code", "zzz")]
    f = spark.createDataFrame([("e", o, "a.py", n, c, t, "") for o, n, c, t in rows], "entry_id string, ord int, file_path string, start_line int, category string, title string, description string")
    got = {r.ord: (r.method, r.rules) for r in code.verify(f, lines, files, files, none, found=found).collect()}
    assert got == {0: ("deterministic-rule-match", "taint-sql"), 1: ("deterministic-rule-match", "swallowed-except"), 2: ("contradicts-repository", None), 3: ("changed-line-and-identifier-overlap", None), 4: ("line-inside-changed-hunk", None), 5: ("deterministic-rule-match", "unused-import")}


def test_gold_matching(spark):
    e = spark.createDataFrame([("p", ["src/a.py"], "high", "overflow in counter", ""), ("n", [], "", "", "")], "entry_id string, affected_files array<string>, severity string, bug_description string, bug_fix string")
    p = spark.createDataFrame([("p", 0, "src/a.py", "counter is off", "high"), ("p", 1, "src/b.py", "counter is off", "low"), ("p", 2, "b.py", "counter is off", "low"), ("p", 3, "src/a.py", "nothing shared", "low"), ("n", 0, "x.py", "counter", "low")], "entry_id string, pred int, file_path string, text string, severity string")
    m = ev.matches(e, p)
    assert {(r.entry_id, r.pred) for r in m.where("matched").collect()} == {("p", 0), ("p", 1)}
    s = {r.entry_id: r for r in ev.entry_scores(m).collect()}
    assert (s["p"].true_positives, s["p"].false_positives, s["p"].severity_correct) == (2, 2, True)
    assert not s["n"].missed_gold


def test_regression_labels(spark):
    base = {"precision": 0.5, "recall": 0.5, "f1": 0.5, "false_positive_rate": 0.1, "bug_detection_rate": None, "severity_accuracy": 0.5, "completion_rate": 1.0, "mean_latency_s": 1.0, "mean_cost_usd": 0.1, "total_tokens": 10.0}
    schema = "system string, " + ", ".join(f"{m} double" for m in ev.METRICS)
    frame = lambda **systems: spark.createDataFrame([(s, *[(base | x)[m] for m in ev.METRICS]) for s, x in systems.items()], schema)
    got = {(r.system, r.metric): r.label for r in ev.compare(frame(a={}, b={}), frame(a={"precision": 0.48, "recall": 0.47, "f1": 0.6, "mean_latency_s": 1.5, "severity_accuracy": None}, c={})).collect()}
    assert got["a", "precision"] == "tolerated" and got["a", "recall"] == "regressed" and got["a", "f1"] == "improved"
    assert got["a", "mean_latency_s"] == "regressed" and got["a", "severity_accuracy"] == "regressed" and got["a", "total_tokens"] == "unchanged"
    assert ("a", "bug_detection_rate") not in got and got["b", "f1"] == "missing" and got["c", "f1"] == "extra"


def test_benchmark_reader(spark, tmp_path):
    row = {"entry_id": "a", "repository": "r", "diff": "x", "base_files": {"p": "c"}, "affected_files": ["p"]}
    (tmp_path / "d.json").write_text(json.dumps({"entries": [row, row | {"entry_id": "b", "hold_out": False, "bug_description": "d"}]}))
    assert {(r.entry_id, r.hold_out) for r in readers.benchmark(spark, str(tmp_path / "d.json")).collect()} == {("a", True), ("b", False)}
    (tmp_path / "l.json").write_text(json.dumps([row]))
    assert readers.benchmark(spark, str(tmp_path / "l.json")).first().base_files == {"p": "c"}
    (tmp_path / "d.jsonl").write_text(json.dumps(row) + "\n" + json.dumps(row) + "\n")
    with pytest.raises(Exception, match="repeated"):
        readers.benchmark(spark, str(tmp_path / "d.jsonl")).collect()


def test_lines_metrics_history_folder(spark, tmp_path):
    (tmp_path / "k.jsonl").write_text('{"kind":"rule","title":"t","repository":"a/b"}\n{"kind":"doc","title":"g"}\n{"kind":"doc","title":"o","repository":"c/d"}\nbroken\n{"kind":"doc","title":"late"}\n')
    assert {r.title for r in readers.knowledge(spark, str(tmp_path / "k.jsonl"), "a/b").collect()} == {"t", "g"}
    (tmp_path / "m.json").write_text('{"s": {"f1": 0.5, "recall": null, "system": "s"}}')
    assert {(r.metric, r.value) for r in readers.metrics(spark, str(tmp_path / "m.json")).collect()} == {("f1", 0.5), ("recall", None)}
    (tmp_path / "h.jsonl").write_text('{"ts":"2"}\nno\n{"ts":"1"}\n{"ts":"3"}\n')
    assert [r.ts for r in readers.history(spark, str(tmp_path / "h.jsonl"), 2).collect()] == ["3", "1"]
    d = tmp_path / "repo"
    (d / ".git").mkdir(parents=True)
    for n, t in (("a.py", "1"), ("b.bin", "2"), (".git/c.py", "3"), ("Makefile", "4"), ("z.py", "5" * 100)):
        (d / n).write_text(t)
    assert sorted(r.path for r in readers.folder(spark, str(d), total_bytes=50).collect()) == ["Makefile", "a.py"]


def test_git_source(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@e", *a], check=True, capture_output=True)
    git("init", "-q")
    git("remote", "add", "origin", "git@host:own/name.git")
    (tmp_path / "a.txt").write_text("1\n")
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "a.txt").write_text("2\n")
    git("commit", "-qam", "two")
    spark.dataSource.register(LocalGit)
    clean = spark.read.format("local_git").option("paths", str(tmp_path)).load().first()
    assert clean.repository == "own/name" and clean.base == "HEAD~1" and "+2" in clean.diff
    (tmp_path / "a.txt").write_text("3\n")
    assert "+3" in spark.read.format("local_git").option("paths", str(tmp_path)).load().first().diff


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("2", 1)], "ts string, n int")
    sinks.append_lines(rows, str(tmp_path / "l"))
    sinks.append_lines(rows, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 2
    more = spark.createDataFrame([("3", 2), ("1", 3)], "ts string, n int")
    assert [r.ts for r in sinks.capped(rows, more, 2).collect()] == ["3", "2"]
    m = spark.createDataFrame([({"api_key": "v", "name": "n"},)], "meta map<string,string>")
    assert m.select(sinks.redacted(m["meta"])).first()[0] == {"api_key": "***", "name": "n"}


def test_formats_datasets_and_experiments(spark, tmp_path):
    f = spark.createDataFrame([("r1", 1, "security", "high", 0.9, "t", "a.py", 3, "confirmed")], "review_id string, ord bigint, category string, severity string, confidence double, title string, file_path string, start_line int, evidence_status string")
    f = f.withColumns({"end_line": F.lit(None).cast("int"), "description": F.lit("d"), "rule_id": F.lit(None).cast("string"), "related_files": F.array().cast("array<string>")})
    for fmt, part in (("markdown", "# Review r1"), ("json", '"review_id":"r1"'), ("sarif", '"2.1.0"')):
        sinks.export(f, fmt, str(tmp_path / fmt))
        assert part in " ".join(r.value for r in spark.read.text(str(tmp_path / fmt)).collect())
    with pytest.raises(ValueError, match="unknown format"):
        sinks.documents(f, "pdf")
    e = spark.createDataFrame([("b", "x"), ("a", "y")], "entry_id string, bug_description string")
    for name in ("set.json", "set.jsonl"):
        sinks.save_dataset(e, str(tmp_path / name))
        back = readers.benchmark(spark, str(tmp_path / name))
        assert {(r.entry_id, r.bug_description, r.hold_out) for r in back.collect()} == {("a", "y", True), ("b", "x", True)}
    m = spark.createDataFrame([("s", 0.5, 0.25, None, 1.5, 0.1, 10)], "system string, precision double, recall double, f1 double, mean_latency_s double, mean_cost_usd double, total_tokens bigint")
    sinks.experiment(m, str(tmp_path / "run"))
    assert spark.read.text(str(tmp_path / "run/summary")).first().value == "s | precision 0.5 | recall 0.25 | f1 -"
    assert spark.read.json(str(tmp_path / "run/cost")).first().total_tokens == 10
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.experiment(m, str(tmp_path / "run"))


def test_nested_secrets_pages_and_last_lines(spark, tmp_path):
    d = spark.createDataFrame([('{"a": [{"api_key": "x", "n": 1}], "token": {"deep": 2}}',), ("no json",), (None,)], "j string")
    assert [r.c for r in d.select(sinks.redacted_json(F.col("j")).alias("c")).collect()] == ['{"a": [{"api_key": "***", "n": 1}], "token": "***"}', "no json", None]
    pages = spark.createDataFrame([("l", 2, ["c"]), ("l", 1, ["a", "b"])], "listing string, page int, items array<string>")
    assert [r.item for r in readers.merged_pages(pages).orderBy("place").collect()] == ["a", "b", "c"]
    for bad in (pages.where("page = 2"), spark.createDataFrame([("l", i, ["x"]) for i in range(1, 43)], pages.schema)):
        with pytest.raises(Exception, match="incomplete or too long"):
            readers.merged_pages(bad).collect()
    (tmp_path / "h.jsonl").write_text("".join(f'{{"ts": "{9 - i}"}}\n' for i in range(6)) + "broken\n")
    assert [r.ts for r in readers.history(spark, str(tmp_path / "h.jsonl"), 3).collect()] == ["4", "5"]


def test_budget_by_bins_equals_one_window(spark):
    rows = spark.createDataFrame([("ab"[i % 2], i, (i * 7) % 13 + 1) for i in range(300)], "by string, id bigint, size int")
    for overshoot in (False, True):
        for budget in (0, 5, 100, 10_000):
            one, two = (retrieval.prefix_budget(rows, "by", ["id"], F.col("size"), budget, overshoot, bin=b) for b in (None, retrieval.bin_of("id", 10)))
            assert {tuple(r) for r in one.collect()} == {tuple(r) for r in two.collect()}


def test_retrieval_equals_brute_force(spark):
    import math
    from collections import Counter

    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    chunks = [("ab"[i % 2], f"p{i}", i, " ".join(rng.choices(words, k=12))) for i in range(30)]
    asked = [("a", " ".join(rng.choices(words, k=6))), ("b", "w1 w2 w3"), ("c", "w1")]
    d = spark.createDataFrame(chunks, "entry_id string, path string, first_line int, text string")
    hashed = {r.w: (r.i, r.s) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", C.hashed_index(F.col("w"), retrieval.DIMENSION).alias("i"), C.hashed_sign(F.col("w")).alias("s")).collect()}

    def vector(text):
        v = Counter()
        for w in text.split():
            v[hashed[w][0]] += hashed[w][1]
        n = math.sqrt(sum(x * x for x in v.values()))
        return {i: x / n for i, x in v.items() if x}

    want = set()
    for e, q in asked:
        qv = vector(q)
        scored = [(round(sum(x * qv.get(i, 0) for i, x in vector(t).items()), 6), p, n) for o, p, n, t in chunks if o == e and vector(t).keys() & qv.keys()]
        want |= {(e, i + 1, p, n, s) for i, (s, p, n) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1], x[2]))[:6])}
    got = retrieval.retrieve(retrieval.index(d), spark.createDataFrame(asked, "entry_id string, text string"))
    assert {tuple(r) for r in got.collect()} == want


def test_retries_switches_models_and_baselines(spark):
    rows = [("a", 1, False, "timeout"), ("a", 2, True, None), ("b", 1, False, "auth"), ("b", 2, True, None), ("c", 1, False, "x"), ("c", 2, False, "y"), ("c", 3, False, "z"), ("c", 4, True, None)]
    d = spark.createDataFrame(rows, "k string, at int, success boolean, error string")
    assert {tuple(r) for r in pipeline.retried(d, ["k"], ["at"]).collect()} == {("a", 2, "answered", None), ("b", 1, "failed", "auth"), ("c", 3, "failed", "z")}
    f = spark.createDataFrame([("security",), ("testing",)], "category string")
    assert [r.category for r in pipeline.enabled(f, {"testing": False}).collect()] == ["security"] and pipeline.enabled(f, {}).count() == 2
    assert {tuple(r) for r in pipeline.models(f, "m", {"security": "big"}).collect()} == {("security", "big"), ("testing", "m")}
    diff = "--- a/app.py\n+++ b/app.py\n@@ -1 +1,2 @@\n def f():\n+    return eval(x)\n"
    e = spark.createDataFrame([("e", "o/r", diff, {"app.py": "def f():\n    return eval(x)\n"})], "entry_id string, repository string, diff string, base_files map<string,string>")
    answers = spark.createDataFrame([("e", 1, "sorry"), ("e", 2, '{"findings": [{"category": "Testing", "severity": "low", "confidence": 0.9, "title": "no test", "description": "", "file_path": "app.py", "start_line": 2}]}'), ("e", 3, '{"findings": []}')], "entry_id string, attempt int, output string")
    made = {n: b().collect() for n, b in pipeline.baselines(e, answers).items()}
    assert set(made) == {"rules", "static", "workflow", "single-pass"}
    assert [r.category for r in made["single-pass"]] == ["testing"] and {r.evidence_status for r in made["rules"]} == {"insufficient_evidence"}
    assert any(r.rule_id == "eval-exec" and r.evidence_status == "confirmed" for r in made["workflow"])
