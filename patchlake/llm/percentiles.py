"""Problem 1: percentiles per group within a stated rank error, from deterministic mergeable summaries.

A summary of n values is a sorted list of rank-interval tuples (v, lo, hi): at least ``lo`` of the values are <= v and at
most ``hi`` are < v.  The rows of a system and day meet in one leaf (of several, by a hash of score_id, where a count
found more than ``LEAF_ROWS`` of them), so a leaf is as large as its group.  Every level compresses by its part of the
permitted uncertainty: the leaves, the merge of a day's leaves, the merge of ``BLOCK_DAYS`` days, the merge of all; a
summary then has at most 2 / epsilon tuples however many values it stands for.  Within a level at most ``FAN`` summaries
are held: so many are merged to one of the next rank, which is compressed by half of what the rank before was allowed.
Merged summaries add the bounds of their parts, so the error that was accumulated is read off the tuples and returned as
``rank_error``.  Leaves, levels and their order depend on keys alone, so the rows do not depend on partitions.

Nulls and NaN are counted but have no rank; negative and infinite values are values.  ``system`` is compared trimmed and
in lower case; a null system is a group of its own, and so is a null day.  A ``score_id`` delivered again for the same
system and day counts once (with its least values, should they differ), rows without score_id each count.  An empty
table gives no rows; a group without values gives null percentiles.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from patchlake.session import BROADCAST_ROWS, checkpoint, ship, table

QUANTILES = (0.5, 0.9, 0.95, 0.99)
METRICS = ("latency_seconds", "cost_usd")
EPSILON = 0.002
LEAF_ROWS = 400_000  # rows of a group from which it has several leaves
BLOCK_DAYS = 16
FAN = 64  # summaries that are held at once
_SCHEMA = "system string, day date, metric string, part bigint, parts bigint, n bigint, n_null bigint, n_nan bigint, v binary, lo binary, hi binary"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def packed(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Tuples as bytes: values, steps of lo, and lo - hi; the latter two are mostly ones and shrink to little."""
    return v.astype("<f8").tobytes(), zlib.compress(np.diff(lo, prepend=0).astype("<i8").tobytes(), 1), zlib.compress((lo - hi).astype("<i8").tobytes(), 1)


def unpacked(v: bytes, lo: bytes, hi: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    upper = np.frombuffer(zlib.decompress(lo), "<i8").cumsum()
    return np.frombuffer(v, "<f8"), upper, upper - np.frombuffer(zlib.decompress(hi), "<i8")


def leaf(values: np.ndarray, epsilon: float) -> tuple:
    """Summary of unsorted values without NaN."""
    v, counts = np.unique(values, return_counts=True)
    lo = np.cumsum(counts)
    return compress(v, lo, lo - counts, epsilon)


def compress(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, epsilon: float) -> tuple:
    """Keep the first and last tuple of every rank bucket, so neighbours stay within 2 * epsilon * n ranks."""
    n = int(lo[-1]) if len(lo) else 0
    width = int(epsilon * n)
    if width < 2 or len(v) < 3:
        return v, lo, hi
    bucket = lo // width
    edge = np.flatnonzero(bucket[1:] != bucket[:-1])
    keep = np.unique(np.concatenate([[0, len(v) - 1], edge, edge + 1]))
    return v[keep], lo[keep], hi[keep]


def merge(parts: list[tuple], epsilon: float) -> tuple:
    parts = [p for p in parts if len(p[0])]
    if not parts:
        return np.array([]), np.array([], np.int64), np.array([], np.int64)
    if len(parts) == 1:
        return compress(*parts[0], epsilon)
    v = np.unique(np.concatenate([p[0] for p in parts]))
    lo, hi = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
    for pv, plo, phi in parts:
        below = np.searchsorted(pv, v, "right")  # tuples <= v
        lo += np.concatenate([[0], plo])[below]
        above = np.searchsorted(pv, v, "left")  # first tuple >= v
        hi += np.concatenate([phi, [plo[-1]]])[above]
    return compress(v, lo, hi, epsilon)


def query(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: float) -> tuple[float | None, int | None]:
    """The stored value of least possible rank error for quantile q, and that error in ranks."""
    if not len(v):
        return None, None
    rank = max(1, int(np.ceil(q * int(lo[-1]))))
    error = np.maximum(0, np.maximum(hi + 1 - rank, rank - lo))
    i = int(np.argmin(error))
    return float(v[i]), int(error[i])


class Merger:
    """Summaries of one key, in their order: ``FAN`` of a rank become one of the next, compressed by half as much."""

    def __init__(self, epsilon: float):
        self.epsilon, self.ranks = epsilon, [[]]

    def add(self, summary: tuple) -> None:
        rank = 0
        self.ranks[0].append(summary)
        while len(self.ranks[rank]) == FAN:
            whole = merge(self.ranks[rank], self.epsilon / 4 / 2**rank)
            self.ranks[rank] = []
            rank += 1
            if rank == len(self.ranks):
                self.ranks.append([])
            self.ranks[rank].append(whole)

    def result(self) -> tuple:
        return merge([x for r in self.ranks for x in r], self.epsilon / 2)


def _same(b: pd.DataFrame, columns: list[str]) -> np.ndarray:
    """Whether each row but the first has the keys of the row before, nulls being equal."""
    out = np.ones(len(b) - 1, bool)
    for c in columns:
        x = b[c]
        null = x.isna().to_numpy()
        y = x.to_numpy()
        out &= (null[1:] & null[:-1]) | ((y[1:] == y[:-1]) & ~null[1:] & ~null[:-1])
    return out


def _key(row: pd.Series) -> tuple:
    return (row["system"] if isinstance(row["system"], str) else None, None if pd.isna(row["day"]) else row["day"])


def delivered(scores: DataFrame) -> DataFrame:
    """Each score_id of a system and day once, with its least values; rows without one each count."""
    rows = scores.select(F.lower(F.trim("system")).alias("system"), F.to_date("scored_at").alias("day"), "score_id", *METRICS)
    known = rows.where("score_id is not null").groupBy("system", "day", "score_id").agg(*[F.min(m).alias(m) for m in METRICS])
    return known.unionByName(rows.where("score_id is null"))


def summaries(scores: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """One compressed summary per leaf (system, day, part) and metric."""
    ship(scores.sparkSession)
    rows = scores.select(F.lower(F.trim("system")).alias("system"), F.to_date("scored_at").alias("day"), "score_id", *METRICS)
    hot = rows.groupBy("system", "day").agg(F.ceil(F.count("*") / LEAF_ROWS).alias("parts")).where("parts > 1").select(F.col("system").alias("h_system"), F.col("day").alias("h_day"), "parts")
    small = hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    cut = rows.join(F.broadcast(hot) if small else hot, F.col("system").eqNullSafe(F.col("h_system")) & F.col("day").eqNullSafe(F.col("h_day")), "left").drop("h_system", "h_day").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumn("part", F.pmod(F.when(F.col("score_id").isNull(), F.xxhash64(*METRICS)).otherwise(F.xxhash64("score_id")), F.col("parts")))
    for m in METRICS:
        cut = cut.withColumn(m + "_null", F.col(m).isNull())
    leaves = cut.repartition("system", "day", "part").sortWithinPartitions("system", "day", "part", "score_id", *METRICS)

    def rows_of(group: pd.DataFrame) -> list:
        ids = group["score_id"]
        once = group[~_repeated(ids)]
        system, day = _key(group.iloc[0])
        out = []
        for metric in METRICS:
            x = once[metric].to_numpy(np.float64)
            missing = once[metric + "_null"].to_numpy(bool)
            nan = np.isnan(x) & ~missing
            out.append((system, day, metric, int(group["part"].iloc[0]), int(group["parts"].iloc[0]), int(len(x) - missing.sum() - nan.sum()), int(missing.sum()), int(nan.sum()), *packed(*leaf(x[~missing & ~nan], epsilon))))
        return out

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            keys = ["system", "day", "part"]
            cuts = [0, *(np.flatnonzero(~_same(b, keys)) + 1), len(b)]
            out = []
            for x, y in zip(cuts, cuts[1:]):
                piece = b.iloc[x:y]
                if held and x == 0 and not _same(pd.concat([held[-1].iloc[-1:], piece.iloc[:1]]), keys)[0] or held and x:
                    out += rows_of(pd.concat(held) if len(held) > 1 else held[0])
                    held = []
                held.append(piece)
            if out:
                yield pd.DataFrame(out, columns=_NAMES)
        if held:
            yield pd.DataFrame(rows_of(pd.concat(held) if len(held) > 1 else held[0]), columns=_NAMES)

    return leaves.mapInPandas(build, _SCHEMA)


def _repeated(ids: pd.Series) -> np.ndarray:
    """Of sorted ids, those equal to the one before; a null id is equal to none."""
    out = np.zeros(len(ids), bool)
    x = ids.to_numpy()
    out[1:] = (x[1:] == x[:-1]) & ids.notna().to_numpy()[1:]
    return out


def _level(found: DataFrame, by: list, epsilon: float) -> DataFrame:
    """One summary per key ``by``, its parts merged in the order of day and part as the sorted rows stream by."""

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, counts, held = None, [0, 0, 0], Merger(epsilon)

        def row() -> list:
            return [*key, 1, *counts, *packed(*held.result())]

        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                k = (r.system if isinstance(r.system, str) else None, None if pd.isna(r.k_day) else r.k_day, r.metric, int(r.k_part))
                if k != key:
                    if key is not None:
                        out.append(row())
                    key, counts, held = k, [0, 0, 0], Merger(epsilon)
                counts = [counts[0] + r.n, counts[1] + r.n_null, counts[2] + r.n_nan]
                held.add(unpacked(r.v, r.lo, r.hi))
            if out:
                yield pd.DataFrame(out, columns=_NAMES)
        if key is not None:
            yield pd.DataFrame([row()], columns=_NAMES)

    return found.repartition("system", "metric", *by).sortWithinPartitions("system", "k_day", "metric", "k_part", "day", "part").mapInPandas(merged, _SCHEMA)


def combine(found: DataFrame, keys: list[str], epsilon: float) -> DataFrame:
    """Merge summaries that share ``keys``; a day that is no key becomes null.

    By day, only groups of several leaves move.  Over days, ``BLOCK_DAYS`` of them are merged first, so what meets in a
    last task is bounded by the number of blocks over epsilon, not by the values.
    """
    if "day" in keys:
        whole = found.where("parts = 1")
        return whole.unionByName(_level(found.where("parts > 1").withColumns({"k_day": F.col("day"), "k_part": F.lit(0)}), ["k_day"], epsilon))
    block = F.coalesce(F.floor(F.unix_date("day") / BLOCK_DAYS), F.lit(-1))
    none = F.lit(None).cast("date")
    blocks = _level(found.withColumns({"k_day": none, "k_part": block}), ["k_part"], epsilon / 2)
    return _level(blocks.withColumns({"k_day": none, "k_part": F.lit(0)}), [], epsilon / 2)


def percentiles(found: DataFrame, scope: str, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    names = [f"p{round(q * 100)}" for q in quantiles]
    schema = "scope string, system string, day date, metric string, n bigint, n_null bigint, n_nan bigint, " + ", ".join(f"{c} double" for c in names) + ", rank_error bigint"

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [[query(*s, q) for q in quantiles] for s in map(unpacked, b["v"], b["lo"], b["hi"])]
            out = b[["system", "day", "metric", "n", "n_null", "n_nan"]].copy()
            out.insert(0, "scope", scope)
            for i, c in enumerate(names):
                out[c] = [g[i][0] for g in got]
            out["rank_error"] = pd.array([None if g[0][1] is None else max(e for _, e in g) for g in got], dtype="Int64")
            yield out

    return found.mapInPandas(fn, schema)


def p1_percentiles(spark: SparkSession, sf_dir: str, epsilon: float = EPSILON) -> DataFrame:
    """Per system and day (scope day), and per system over all days (scope all), built from the same day summaries."""
    leaves = checkpoint(summaries(table(spark, sf_dir, "entry_scores"), epsilon / 4))
    days = combine(leaves, ["system", "day", "metric"], epsilon / 4)
    return percentiles(days, "day").unionByName(percentiles(combine(days, ["system", "metric"], epsilon / 2), "all"))


def p1_within_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """system, metric, n, within_bound: whether the true rank of each whole-period percentile is within its rank_error, and that within epsilon."""
    total = p1_percentiles(spark, sf_dir).where("scope = 'all'")
    names = [f"p{round(q * 100)}" for q in QUANTILES]
    scores = delivered(table(spark, sf_dir, "entry_scores")).select("system", F.explode(F.create_map(*[x for m in METRICS for x in (F.lit(m), F.col(m))])).alias("metric", "x"))
    scores = scores.where(F.col("x").isNotNull() & ~F.isnan("x")).withColumn("system", F.coalesce("system", F.lit("")))
    joined = scores.join(F.broadcast(total.withColumn("system", F.coalesce("system", F.lit("")))), ["system", "metric"])  # a few rows: one per system and metric
    counts = joined.groupBy("system", "metric").agg(
        F.first("n").alias("n"), F.count("x").alias("rows"), F.first("rank_error").alias("rank_error"),
        *[F.count_if(F.col("x") <= F.col(c)).alias(c + "_le") for c in names],
        *[F.count_if(F.col("x") < F.col(c)).alias(c + "_lt") for c in names],
    )
    ok = (F.col("n") == F.col("rows")) & (F.col("rank_error") <= F.ceil(F.lit(EPSILON) * F.col("n")))
    for q, c in zip(QUANTILES, names):
        rank = F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n")))
        ok = ok & (F.greatest(F.col(c + "_lt") + 1 - rank, rank - F.col(c + "_le")) <= F.col("rank_error"))
    return counts.select("system", "metric", "n", ok.alias("within_bound"))


SQL = {
    "p1_within_bound": """
        WITH s AS (SELECT score_id, any_value(coalesce(lower(trim(system)), '')) AS system, any_value(latency_seconds) AS l, any_value(cost_usd) AS c FROM entry_scores GROUP BY score_id),
        u AS (SELECT system, 'latency_seconds' AS metric, l AS x FROM s UNION ALL SELECT system, 'cost_usd', c FROM s)
        SELECT system, metric, count(*) AS n, TRUE AS within_bound FROM u WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY 1, 2""",
}
