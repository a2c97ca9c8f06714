import datetime

import numpy as np
from hypothesis import given, settings, strategies as st

from patchlake.llm import percentiles as P


def true_error(values, v, q):
    x = np.sort(values)
    rank = max(1, int(np.ceil(q * len(x))))
    return max(0, np.searchsorted(x, v, "left") + 1 - rank, rank - np.searchsorted(x, v, "right"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.floats(-5, 5), st.sampled_from([0.0, 1.0, float("inf"), -1.0])), max_size=300), min_size=1, max_size=6), st.sampled_from([0.0, 0.01, 0.1]))
def test_merged_error_is_bounded_and_told(parts, epsilon):
    every = np.array([x for p in parts for x in p])
    s = P.merge([P.leaf(np.array(p), epsilon) and P.compress(*P.leaf(np.array(p), epsilon)[:3], epsilon) for p in parts], epsilon)
    if not len(every):
        assert P.query(*s, 0.5) == (None, None)
        return
    assert s[1][-1] == len(every)
    for q in (0.0, 0.5, 0.9, 0.99, 1.0):
        v, error = P.query(*s, q)
        assert true_error(every, v, q) <= error <= np.ceil(2 * epsilon * len(every)) + 1


def test_summaries_stay_small():
    v, lo, hi = P.leaf(np.random.default_rng(0).normal(size=200_000), 0.001)
    assert len(v) < 2100 and P.query(v, lo, hi, 0.5)[1] <= 200


def table(spark, rows):
    t = datetime.datetime(2025, 1, 1)
    return spark.createDataFrame([(i, s, l, c, d, "x") for i, (s, l, c, d) in enumerate(rows)], "score_id bigint, system string, latency_seconds double, cost_usd double, scored_at timestamp_ntz, n string") if rows else spark.createDataFrame([], "score_id bigint, system string, latency_seconds double, cost_usd double, scored_at timestamp_ntz, n string"), t


def test_nulls_nan_repeats_and_clashing_columns(spark):
    t = datetime.datetime(2025, 1, 1)
    scores, _ = table(spark, [("A ", 1.0, None, t), ("a", float("nan"), -2.0, t), (None, 3.0, 1.0, None), ("a", 5.0, 7.0, t)])
    scores = scores.unionByName(scores.where("score_id = 0"))
    found = P.summaries(scores)
    days = {(r.system, r.day, r.metric): r for r in P.percentiles(P.combine(found, ["system", "day", "metric"], 0.001), "day").collect()}
    a = days["a", t.date(), "latency_seconds"]
    assert (a.n, a.n_null, a.n_nan, a.p50, a.p99) == (2, 0, 1, 1.0, 5.0)
    b = days["a", t.date(), "cost_usd"]
    assert (b.n, b.n_null, b.p50) == (2, 1, -2.0)
    assert days[None, None, "latency_seconds"].p50 == 3.0
    total = {(r.system, r.metric): r.n for r in P.percentiles(P.combine(found, ["system", "metric"], 0.001), "all").collect()}
    assert total["a", "latency_seconds"] == 2 and total[None, "cost_usd"] == 1


def test_empty_table(spark):
    scores, _ = table(spark, [])
    assert P.percentiles(P.combine(P.summaries(scores), ["system", "metric"], 0.001), "all").count() == 0


def test_rows_without_id_each_count(spark):
    s = spark.createDataFrame([(None, "a", 1.0, 1.0, None)] * 3, "score_id bigint, system string, latency_seconds double, cost_usd double, scored_at timestamp_ntz")
    assert {r.n for r in P.percentiles(P.combine(P.summaries(s), ["system", "metric"], 0.001), "all").collect()} == {3}


def test_hot_group_is_cut_and_rows_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(P, "LEAF_ROWS", 500)
    monkeypatch.setattr(P, "FAN", 3)
    rng = np.random.default_rng(4)
    t = datetime.datetime(2025, 1, 1)
    rows = [("hot" if i % 3 else f"s{i % 4}", float(x), float(y), t + datetime.timedelta(days=int(i % 40 if i % 3 else 0))) for i, (x, y) in enumerate(zip(rng.normal(size=9000), rng.integers(0, 5, 9000)))]
    rows += [("hot", float(x), 1.0, t) for x in rng.normal(size=3000)]
    scores, _ = table(spark, rows)
    got = []
    for layout in (scores, scores.repartition(7, "n", "score_id")):
        leaves = P.summaries(layout, 0.005)
        assert leaves.where("parts > 1").count() > 4
        days = P.combine(leaves, ["system", "day", "metric"], 0.005)
        every = P.percentiles(days, "day").unionByName(P.percentiles(P.combine(days, ["system", "metric"], 0.01), "all"))
        got.append({tuple(r) for r in every.collect()})
    assert got[0] == got[1]
    values = np.array([l for s, l, _, _ in rows if s == "hot"])
    (r,) = [x for x in got[0] if x[0] == "all" and x[1] == "hot" and x[3] == "latency_seconds"]
    assert r[4] == len(values) and r[-1] <= 0.02 * len(values)
    for q, v in zip(P.QUANTILES, r[7:11]):
        assert true_error(values, v, q) <= r[-1]


def test_merged_summaries_are_compressed():
    rng = np.random.default_rng(1)
    m = P.Merger(0.004)
    for _ in range(300):
        m.add(P.leaf(rng.normal(size=1000), 0.001))
    v, lo, hi = m.result()
    assert lo[-1] == 300_000 and len(v) < 1100 and max(P.query(v, lo, hi, q)[1] for q in P.QUANTILES) <= 0.005 * 300_000
    assert all((x == y).all() for x, y in zip(P.unpacked(*P.packed(v, lo, hi)), (v, lo, hi)))
