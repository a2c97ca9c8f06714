from hypothesis import HealthCheck, given, settings, strategies as st

from patchlake.functions import rules
from patchlake.operators import diffs, retrieval as rt

ONE = "diff --git a/db.py b/db.py\n--- a/db.py\n+++ b/db.py\n@@ -10,4 +10,4 @@ def f\n x\n-old1\n-old2\n+new1\n+new2\n y\n"


def entries(spark, *texts):
    return spark.createDataFrame([(f"e{i}", t) for i, t in enumerate(texts)], "entry_id string, diff string")


def test_line_numbers(spark):
    rows = [(r.kind, r.text, r.old_line, r.new_line) for r in diffs.numbered(entries(spark, ONE)).orderBy("pos").collect()]
    assert rows == [("context", "x", 10, 10), ("removed", "old1", 11, None), ("removed", "old2", 12, None), ("added", "new1", None, 11), ("added", "new2", None, 12), ("context", "y", 13, 13)]


def test_headers_within_a_hunk_are_lines(spark):
    d = "--- a/x.sql\n+++ b/x.sql\n@@ -1,2 +1,2 @@\n--- drop\n+++ add\n same\n"
    got = diffs.numbered(entries(spark, d)).orderBy("pos").collect()
    assert [(r.kind, r.text) for r in got] == [("removed", "-- drop"), ("added", "++ add"), ("context", "same")]
    assert diffs.files(entries(spark, d)).count() == 1


def test_file_status(spark):
    d = (
        "diff --git a/n.py b/n.py\nnew file mode 100644\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +1 @@\n+a\n"
        "diff --git a/o.py b/o.py\ndeleted file mode 100644\n--- a/o.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-a\n"
        "diff --git a/p.py b/q.py\nsimilarity index 90%\nrename from p.py\nrename to q.py\n--- a/p.py\n+++ b/q.py\n@@ -1 +1 @@\n-a\n+b\n"
    )
    got = [(r.path, r.old_path, r.status) for r in diffs.files(entries(spark, d)).orderBy("file_idx").collect()]
    assert got == [("n.py", None, "added"), ("o.py", "o.py", "deleted"), ("q.py", "p.py", "renamed")]


def test_missing_counts_are_one(spark):
    h = diffs.hunks(entries(spark, "--- a/x\n+++ b/x\n@@ -3 +4,2 @@ note\n-a\n+b\n+c\n")).first()
    assert (h.old_start, h.old_count, h.new_start, h.new_count, h.note) == (3, 1, 4, 2, "note")


def test_ranges_are_islands(spark):
    d = "--- a/x\n+++ b/x\n@@ -1,2 +10,5 @@\n+a\n+b\n c\n+d\n e\n"
    assert sorted((r.first_line, r.last_line) for r in diffs.changed_ranges(diffs.numbered(entries(spark, d))).collect()) == [(10, 11), (13, 13)]


def test_blank_and_null_diffs_give_no_rows(spark):
    assert diffs.marked(entries(spark, "", "  \n", None)).count() == 0


def test_groups_reset_and_let_the_oversized_stand_alone(spark):
    s = spark.createDataFrame([("e", i, f"f{i}", t) for i, t in enumerate([50, 60, 500, 10, 20])], "entry_id string, file_idx int, path string, tokens int")
    assert [(r.grp, r.path) for r in diffs.budget_groups(s, 100).orderBy("file_idx").collect()] == [(0, "f0"), (1, "f1"), (2, "f2"), (3, "f3"), (3, "f4")]


def test_reversing_twice_is_nothing(spark):
    n = diffs.numbered(entries(spark, ONE))
    key = lambda d: sorted((r.pos, r.kind, r.old_line or 0, r.new_line or 0) for r in d.collect())
    assert key(diffs.reversed_lines(diffs.reversed_lines(n))) == key(n)


BODY = st.lists(st.tuples(st.sampled_from("+- "), st.text("ab{}", max_size=4)), min_size=1, max_size=8)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(BODY, min_size=1, max_size=3))
def test_text_of_parsed_is_the_text(spark, bodies):
    text = ""
    for i, body in enumerate(bodies):
        old, new = sum(s != "+" for s, _ in body), sum(s != "-" for s, _ in body)
        text += f"diff --git a/f{i} b/f{i}\n--- a/f{i}\n+++ b/f{i}\n@@ -1,{old} +1,{new} @@\n" + "".join(f"{s}{t}\n" for s, t in body)
    e = entries(spark, text)
    assert diffs.to_text(e).first().text + "\n" == text
    assert diffs.numbered(e).count() == sum(map(len, bodies))


def test_rules_hit_and_miss(spark):
    lines = {
        "sql-f-string": ("cursor.execute(f'select {x}')", "cursor.execute(q, (x,))"),
        "eval-exec": ("eval(text)", "evaluate(text)"),
        "yaml-load": ("yaml.load(body)", "yaml.load(body, Loader=SafeLoader)"),
        "bare-except": ("    except:", "    except ValueError:"),
        "mutable-default": ("def f(a, b=[]):", "def f(a, b=None):"),
        "todo-fixme": ("# todo later", "# done"),
        "img-without-alt": ("<img src='x'>", "<img src='x' alt='y'>"),
        "shared-counter": ("    total += 1", "    total += 2"),
        "npm-wildcard": ("\"left\": \"*\"", "\"left\": \"1.2\""),
        "env-var-read": ("os.getenv['HOME_DIR']", "getenv(x)"),
        "hardcoded-secret": ("password = 'abcdefgh1'", "password = read()"),
    }
    d = spark.createDataFrame([(r, k, t) for r, (h, m) in lines.items() for k, t in (("hit", h), ("miss", m))], "rule string, kind string, text string")
    got = {(r.rule, r.kind) for r in rules.rule_hits(d).where("rule = rule_id").collect()}
    assert got == {(r, "hit") for r in lines}
    assert len(rules.RULES) == 93


def test_sections_and_budget(spark):
    docs = spark.createDataFrame([(1, "lost\n# One\ntext\n## Two\n\n# Three\nmore"), (2, None), (3, "")], "doc_id bigint, text string")
    assert [(r.section, r.title) for r in rt.sections(docs).orderBy("section").collect()] == [(1, "One"), (3, "Three")]
    rows = spark.createDataFrame([("a", i, n) for i, n in enumerate([5, 5, 5])], "g string, i int, n int")
    assert rt.prefix_budget(rows, "g", ["i"], rows["n"], 10).count() == 2
    assert rt.prefix_budget(rows, "g", ["i"], rows["n"], 6, overshoot=True).count() == 2
