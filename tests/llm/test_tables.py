"""Splits and mixtures, and the operators on empty, null and repeated rows."""

import random

import pytest

from patchlake.llm import credentials as K, mixture as M, overlap as O, pieces as P, splits as S, syntax as X
from patchlake.llm.places import places

ENTRY = "entry_id string, repository string, hold_out boolean, language string, diff string, base_files map<string,string>, label string, _key string"


def entries(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], ENTRY)


@pytest.mark.parametrize(
    "spelling, key",
    [
        ("Own/Name", "own/name"), (" own/name \t", "own/name"), ("https://h.example/Own/name.git", "own/name"), ("git@h.example:own/name.git", "own/name"), ("ssh://git@code.invalid:2222/own/NAME.git", "own/name"),
        ("http://www.h.example/own/name/tree/main", "own/name"), ("h.example/own/name/", "own/name"), ("own/name.js", "own/name.js"), ("own/name.gitops", "own/name.gitops"), ("own/name.git/", "own/name"), ("", None), ("name", None), (None, None), ("/", None),
    ],
)
def test_repository_spellings(spark, spelling, key):
    d = spark.createDataFrame([(spelling,)], "r string")
    assert d.select(S.repository_key("r")).first()[0] == key


def union_find(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


def test_families_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [(f"m{rng.randrange(60):03}", f"m{rng.randrange(60):03}") for _ in range(40)]
    links = spark.createDataFrame([(f"{a} {b}", x) for a, b in edges for x in (a, b)] * 2, "record string, entity string")
    assert {r.entity: r.label for r in S.families(links).collect()} == union_find(edges)


def test_groups_across_spellings_and_missing_repositories(spark):
    e = entries(spark, [("1", "https://h.x/B/b.git", True, "py", "", {}), ("2", "c/c", False, None, None, None), ("3", None, None, None, None, None), ("4", "d/d", True, "go", "", {}), ("4", "d/d", True, "go", "", {})])
    links = spark.createDataFrame([(1, "b/b", "a/a"), (2, "A/a/", "c/c"), (3, None, "x/x"), (4, "z/z", "z/z")], "link_id bigint, old_repository string, new_repository string")
    got = {r.entry_id: r.group_id for r in S.grouped(e, links).collect()}
    assert got == {"1": "a/a", "2": "a/a", "3": "?/3", "4": "d/d"}
    assert {r.split for r in S.split(e, links).collect()} <= set(S.SHARES)
    assert S.split(e.where("false"), links).count() == 0
    assert S.grouped(e, links.where("false")).count() == 5


def test_assignment_follows_shares_and_labels():
    rng = random.Random(1)
    groups = [(f"g{i}", {"t": rng.randrange(1, 9), "f": rng.randrange(1, 9)}) for i in range(300)] + [("big", {"t": 300, "f": 300})]
    chosen = S.assign(groups, S.SHARES)
    total = sum(sum(c.values()) for _, c in groups)
    for name, share in S.SHARES.items():
        own = [c for g, c in groups if chosen[g] == name]
        n = sum(sum(c.values()) for c in own)
        assert abs(n / total - share) < 0.005
        assert abs(sum(c["t"] for c in own) / n - 0.5) < 0.05


def documents(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, source string, lang string, category string, bin string, weight int")


def test_mixture_reaches_shares_under_caps(spark):
    rng = random.Random(2)
    rows = [(i, "word " * rng.randrange(1, 40), rng.choice("aaab"), rng.choice(["en", "EN", None]), rng.choice(["x", None])) for i in range(400)] + [(900, None, "a", None, None), (901, "", "b", None, None), (902, "only", None, None, None), (903, "text", "untargeted", None, None)]
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.4, 2), ("absent", 0.1, 9)], "source string, target_share double, max_repeats int")
    used, report, marginals = M.mixture(documents(spark, rows), targets)
    got = {r.source: r for r in report.collect()}
    assert abs(got["a"].actual_share - 5 / 9) < 0.01 and abs(got["b"].actual_share - 4 / 9) < 0.01 and got["absent"].actual_share == 0
    docs = used.collect()
    assert max(r.repeats for r in docs if r.source == "a") <= 3 and max(r.repeats for r in docs if r.source == "b") <= 2
    assert not {r.doc_id for r in docs} & {900, 901, 902, 903} and len({r.doc_id for r in docs}) == len(docs)
    shares = {(r.dimension, r.value): r for r in marginals.collect()}
    assert {d for d, _ in shares} == {"language", "topic"} and set(v for d, v in shares if d == "language") == {"en", "und"}
    assert all(abs(r.actual_share - r.corpus_share) < 0.03 for r in shares.values())  # raked to the documents' own shares
    # the source that is shortest of its share is used up to its cap
    assert {r.repeats for r in docs if r.source == "b"} == {2}


def test_mixture_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 3)], "source string, target_share double, max_repeats int")
    used, report, marginals = M.mixture(documents(spark, []), targets)
    assert used.count() == 0 and report.first().actual_share == 0 and marginals.count() == 0


def test_raking_reaches_all_marginals_and_stops():
    import pandas as pd

    rng = random.Random(3)
    cells = pd.DataFrame([(s, l, t, rng.randrange(100, 900)) for s in "abc" for l in ("en", "de") for t in "xyz"], columns=["source", "language", "topic", "tokens"])
    asked = {"a": (0.5, 50), "b": (0.3, 50), "c": (0.2, 50)}
    w = M.rake(cells, asked)
    got = cells.assign(t=w * cells["tokens"])
    total = got["t"].sum()
    for s, (share, _) in asked.items():
        assert abs(got.loc[got["source"] == s, "t"].sum() / total - share) < 1e-4
    for c in ("language", "topic"):
        wanted = cells.groupby(c)["tokens"].sum() / cells["tokens"].sum()
        assert (abs(got.groupby(c)["t"].sum() / total - wanted) < 1e-4).all()
    assert (abs(M.rake(cells, asked, 5000) - w) < 1e-9).all()


def test_rare_topics_are_raked_as_one(spark, monkeypatch):
    monkeypatch.setattr(M, "TOPICS", 2)
    rows = [(i, "word " * 5, "a", "en", "xxxyyz"[i % 6]) for i in range(60)]
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    used, _, marginals = M.mixture(documents(spark, rows), targets)
    assert used.count() == 60 and {r.value for r in marginals.where("dimension = 'topic'").collect()} == {"x", "y", "other topics"}


def test_text_operators_on_null_empty_and_repeated_rows(spark):
    token = "api_key = 'ghp_" + "a1B2c3D4e5F6g7H8i9J0" + "'\n"
    e = entries(spark, [("1", "a/b", True, "py", token + "x" * 2000, {"app.py": "def f(:\n", "ok.py": "x = 1\n", "t.txt": token}), ("2", None, None, None, None, None), ("3", "a/b", True, "py", "", {}), (None, "a/b", True, "py", token, {"z.json": "{"})])
    e = e.unionByName(e)
    both = places(e)
    assert {(r.entry_id, r.place, r.line_no) for r in K.credentials(both).collect()} == {("1", "diff", 1), ("1", "t.txt", 1), (None, "diff", 1)}
    assert K.credentials(both).count() == 3
    assert {(r.entry_id, r.place) for r in P.pieces(both).collect()} == {("1", "diff")}
    bad = X.checked(places(e, diff=False)).where("edit_cost > 0").select("entry_id", "path").distinct()
    assert {tuple(r) for r in bad.collect()} == {("1", "app.py"), (None, "z.json")}
    none = e.where("false")
    assert K.credentials(places(none)).count() == P.pieces(places(none)).count() == X.checked(places(none)).count() == O.covered_pairs(none).count() == 0
