"""Queries for training data against their SQL, and those without SQL for their promises on the smallest tables."""

import pytest

from patchlake.llm import registry

from compare import check, connection

FOLDER = "/root/testdata/sf0.001"
Q, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    check(spark, con, FOLDER, name, Q[name], SQL[name])


COLUMNS = {"p2_found": ["entry_id", "place", "line_no"], "p3_found": ["entry_id", "group_id"], "p4_found": ["entry_id", "place"], "p5_found": ["entry_id", "path"], "p6_found": ["entry_id", "path"], "p7_found": ["entry_a", "entry_b"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_a", "doc_b"]}


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_query_runs_without_repetition(spark, name):
    out = Q[name](spark, FOLDER)
    rows = out.collect()
    if name in COLUMNS:
        assert out.columns == COLUMNS[name]
        if name != "p8_ids":
            assert len(rows) == len(set(rows))


def test_splits_keep_families_and_shares(spark):
    rows = Q["p3_splits"](spark, "/root/testdata/sf0.01").collect()
    split = {}
    for r in rows:
        assert split.setdefault(r.group_id, r.split) == r.split
    n = len(rows)
    assert n == 500 and len({r.entry_id for r in rows}) == n
    for name, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert abs(sum(r.split == name for r in rows) / n - share) < 0.03
