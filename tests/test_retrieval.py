"""Knowledge search and dismissals against brute force, and what they make no rows for."""

import random

from patchlake.operators import retrieval

COMMON = [f"c{i}" for i in range(6)]  # words that most texts hold


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_equals_brute_force_in_blocks(spark):
    rng = random.Random(3)
    words = lambda n: list(dict.fromkeys(rng.choices(COMMON, k=4) + [f"w{rng.randrange(60)}" for _ in range(n)]))
    scope = lambda: (rng.choice([None, "", "", "a/b", "c/d"]), rng.choice([None, "", "x", "y"]))
    entries = [(i, *scope(), " ".join(words(2)), " ".join(words(rng.randrange(9)))) for i in range(300)] + [(300, "", "x", "", None)]
    asked = [(1000 + i, *scope(), " ".join(words(rng.randrange(8)))) for i in range(40)] + [(1040, "", "x", "nowhere"), (1041, "a/b", "x", None), (1042, "", "x", " ".join(f"w{i}" for i in range(60)) + " c0" * 9 + " ".join(f" v{i}" for i in range(300)))]
    want = set()
    for qid, repository, category, text in asked:
        q = set((text or "").split())
        scored = []
        for d, r, c, title, content in entries:
            n = len(q & set(f"{title or ''} {content or ''}".split()))
            if n and (not r or r == repository):
                scored.append((-(n + 2 * (bool(category) and c == category)), d))
        want |= {(qid, d, -s, i + 1) for i, (s, d) in enumerate(sorted(scored)[:4])}
    e = spark.createDataFrame(entries, "doc_id bigint, repository string, category string, title string, content string")
    q = spark.createDataFrame(asked, "query_id bigint, repository string, category string, query string")
    for block in ({}, {"block": 16}):
        got = retrieval.search(e, q, **block)
        assert {tuple(r) for r in got.collect()} == want
    assert "Join" not in plan(got)  # a shared word made a row for each pair of texts that hold it
    assert retrieval.search(e.limit(0), q).count() == retrieval.search(e, q.limit(0)).count() == 0


def test_dismissals_equal_brute_force_in_blocks(spark):
    rng = random.Random(5)
    words = lambda n: [*rng.choices(COMMON, k=2), *(f"w{rng.randrange(400):03}" for _ in range(n))]
    words_of = lambda *texts: {w.lower() for t in texts if t for w in t.split() if len(w) > 2}
    scope = lambda: (rng.choice([None, "", "a/b", "a/b", "c/d"]), rng.choice([None, "", "x", "y"]))
    common = " ".join(f"{c}_all" for c in COMMON[:2])  # two words that all texts hold, one less than suppress
    findings = [(f"r{i % 7}", i if i % 10 else None, *scope(), rng.choice([None, "", "p.py", "q.py", f"f{i}.py"]), common, " ".join(words(rng.randrange(5)))) for i in range(300)]
    dismissals = [(*scope(), rng.choice([None, "", "", "", "", "", "p.py"] if i < 8 else [None, ""]), common.upper() if i % 3 else None, " ".join(words(rng.randrange(12)))) for i in range(60)]
    dismissals += dismissals[:5] + [("", "", "", "", None), ("c/d", "x", "", None, " ".join(f"w{i:03}" for i in range(0, 400, 2)))]
    want = []
    for f in findings:
        _, _, repository, category, path, title, text = f
        tokens = words_of(title, text)
        if not any((not r or r == repository) and (not c or c == category) and (s and s == path or len(tokens & words_of(t, x)) >= 3) for r, c, s, t, x in dismissals):
            want.append(f)
    assert 20 < len(want) < 280
    f = spark.createDataFrame(findings, "review_id string, ord bigint, repository string, category string, file_path string, title string, description string")
    d = spark.createDataFrame(dismissals, "repository string, category string, source_file string, title string, content string")
    for by in ({}, {"first": 1, "block": 16}, {"first": 0, "block": 50}):
        got = retrieval.not_dismissed(f, d, **by)
        assert got.columns == f.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert all("_row" in x for x in plan(got).split("\n") if "Join" in x)  # a shared identifier made a row for each pair of texts that hold it
    assert retrieval.not_dismissed(f, d.limit(0)).count() == 300 and retrieval.not_dismissed(f.limit(0), d).count() == 0
