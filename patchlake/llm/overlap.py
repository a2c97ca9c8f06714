"""Problem 7: evaluation records whose change also stands, exactly or lightly edited, in a training record.

A diff is read as the text of its body lines' tokens, each token with its line's sign (indentation, spacing and quote
style do not count, headers and hunk positions are left out).  Equal texts form a class, of which one representative
goes on.  The suffixes of all representatives make a partitioned suffix array: they are sorted by the hash of their
first ``FIRST`` tokens, and a block of equal ones is an interval whose suffixes have at least that common prefix.  It is
a sparse array: of every ``GAP`` suffixes in a row the one of least hash is taken, so every span of ``FIRST + GAP - 1``
tokens that two records share has a suffix that both took, and a taken suffix stands for the tokens up to the next one.

A pair is a candidate if its shared suffixes stand for ``NEAR`` of the tokens of both.  Blocks are opened only by a
record's rarer suffixes, all but the most common ones that stand for ``COMMON`` of its tokens; a candidate then shares
rarer suffixes for ``NEAR - COMMON`` in both, so the merged blocks decide and no block or partner is capped.  For
candidates the common prefixes of cross-record neighbours are followed over the whole records: all spans of at least
``span`` tokens are merged into the coverage of each record, by one rule at every size (``same_change``).

A diff without tokens is in no pair.  Null diffs count as empty, a null hold_out as neither split.  Copies within one
split are no pair.  Repeated entry_ids give a pair once.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from patchlake.llm.splits import repository_key
from patchlake.session import checkpoint, spread, table

FIRST, GAP = 5, 5  # tokens that a block has in common; suffixes in a row of which one is taken
COMMON, NEAR = 0.25, 0.3  # of a record's tokens: left to its most common suffixes; shared for a candidate
LONG, MOST = 10, 0.55  # shared spans of so many tokens cover so much of both records, all tokens and the changed ones
SHORT, ALMOST = 5, 0.85  # or shorter spans cover almost all of both
WHOLE, PART = 0.9, 0.35  # or long spans cover the one record, and so much of the other, which adds to it
BLOCK = 5000  # suffixes of a role that meet in one task
VOCABULARY = 500_000  # hashes of tokens a task keeps before it starts anew
_TOKEN = re.compile(r"\w+|[^\w\s]")
_HEADER = ("diff --git ", "index ", "new file mode", "deleted file mode", "old mode", "new mode", "similarity index", "dissimilarity index", "rename from", "rename to", "copy from", "copy to", "Binary files", "\\ No newline")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def body(diff: str | None) -> list[tuple[str, str]]:
    """(sign, line) of the body lines; a header is only read as one where a header can stand."""
    out, old, new = [], 0, 0
    for line in (diff or "").split("\n"):
        line = line.rstrip("\r")
        if line.startswith("@@"):
            m = re.match(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@", line)
            old, new = (int(m.group(1) or 1), int(m.group(2) or 1)) if m else (0, 0)
            continue
        sign = line[:1]
        if line.startswith(_HEADER) or (old <= 0 or new <= 0) and line.startswith(("--- ", "+++ ")):
            continue
        if sign == "-":
            old -= 1
        elif sign == "+":
            new -= 1
        else:
            old, new = old - 1, new - 1
        out.append((sign, line[1:]) if sign in ("+", "-") else ("", line[1:] if sign == " " else line))
    return out


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big")


class Reader:
    """Diffs as arrays of token hashes, kept per word."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], int] = {}

    def tokens(self, diff: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each signed token, and whether it stands on a changed line."""
        if len(self.known) > VOCABULARY:
            self.known.clear()
        known, out, changed = self.known, [], []
        for sign, line in body(diff):
            words = _TOKEN.findall(line.replace("'", '"').replace("`", '"'))
            for w in words:
                h = known.get((sign, w))
                if h is None:
                    h = known[sign, w] = _digest((sign + "\0" + w).encode("utf-8", "surrogatepass"))
                out.append(h)
            changed += [sign != ""] * len(words)
        return np.array(out, np.uint64), np.array(changed, bool)


def windows(tokens: np.ndarray, size: int) -> np.ndarray:
    """Hash of the first ``size`` tokens of each suffix that has so many; a shorter text has one, of all it holds."""
    size = min(size, len(tokens))
    h = np.zeros(len(tokens) - size + 1 if size else 0, np.uint64)
    for i in range(size):
        h = h * _MIX + tokens[i : len(tokens) - size + 1 + i]
        h ^= h >> _SHIFT
    return h


def suffixes(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the suffixes taken, each once, and the number of tokens they stand for."""
    h = windows(tokens, FIRST)
    if len(h) <= GAP:
        at = np.array([int(h.argmin())])
    else:
        at = np.unique(np.lib.stride_tricks.sliding_window_view(h, GAP).argmin(1) + np.arange(len(h) - GAP + 1))
    stands = np.diff(np.append(at, len(tokens)))
    stands[0] += at[0]
    names, where = np.unique(h[at], return_inverse=True)
    return names.view(np.int64), np.bincount(where, stands).astype(np.int32)


def records(entries: DataFrame) -> DataFrame:
    """entry_id, hold_out, key, n, syms, weights: one row per entry with tokens."""

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = Reader()
        for b in batches:
            rows = []
            for e, h, d in zip(b["entry_id"], b["hold_out"], b["diff"]):
                tokens, _ = read.tokens(d)
                if len(tokens):
                    rows.append((e, bool(h), int(np.uint64(_digest(tokens.tobytes())).view(np.int64)), len(tokens), *suffixes(tokens)))
            yield pd.DataFrame(rows, columns=["entry_id", "hold_out", "key", "n", "syms", "weights"])

    return spread(entries.where("hold_out is not null").select("entry_id", "hold_out", "diff")).mapInPandas(fn, "entry_id string, hold_out boolean, key bigint, n int, syms array<bigint>, weights array<int>")


def _met(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The cross-split pairs of whole blocks, of records whose lengths allow ``NEAR``."""
    names = b[["sym", "i", "j"]].to_numpy()
    block = np.concatenate([[0], (names[1:] != names[:-1]).any(1).cumsum()]) if len(b) else np.zeros(0, np.int64)
    role, n, key, w = (b[c].to_numpy() for c in ("role", "n", "key", "w"))
    h, t = np.flatnonzero(role), np.flatnonzero(~role)
    place = (block << 32) + n  # of the trained rows by block and length
    t = t[np.argsort(place[t], kind="stable")]
    low = np.searchsorted(place[t], (block[h] << 32) + np.ceil(NEAR * n[h]).astype(np.int64))
    high = np.searchsorted(place[t], (block[h] << 32) + (n[h] / NEAR).astype(np.int64), "right")
    ends = np.cumsum(high - low)
    at = 0
    while at < len(h):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 500_000, "right")))
        size = (high - low)[at:to]
        x = np.repeat(h[at:to], size)
        y = t[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[at:to], size)]
        other = key[x] != key[y]
        x, y = x[other], y[other]
        yield pd.DataFrame({"held": key[x], "trained": key[y], "n_held": n[x], "n_trained": n[y], "w_held": w[x], "w_trained": w[y]})
        at = to


def _meetings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows of blocks as they stream by; the last block of a batch waits for its rest."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        names = b[["sym", "i", "j"]].to_numpy()
        cut = np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1
        starts = not held or (held[-1][["sym", "i", "j"]].iloc[-1].to_numpy() != names[0]).any()
        if starts or len(cut):
            first = 0 if starts else int(cut[0])
            if held or first:
                yield from _met(pd.concat([*held, b.iloc[:first]], ignore_index=True))
            last = int(cut[-1]) if len(cut) else 0
            if last > first:
                yield from _met(b.iloc[first:last])
            held = [b.iloc[max(first, last) :]]
        else:
            held.append(b)
    if held:
        yield from _met(pd.concat(held, ignore_index=True))


def candidates(reps: DataFrame) -> DataFrame:
    """held, trained: keys of representatives (key, n, syms, weights, held, trained) whose shared suffixes may stand for NEAR of both."""
    every = reps.select("key", "n", "held", "trained", F.explode(F.arrays_zip("syms", "weights")).alias("x")).select("key", "n", "held", "trained", F.col("x.syms").alias("sym"), F.col("x.weights").alias("w"))
    counts = every.groupBy("sym").agg(F.count("*").alias("df"), F.count_if("held").alias("h"), F.count_if("trained").alias("t")).where("df > 1 and h > 0 and t > 0")
    known = every.join(counts, "sym")
    common_first = Window.partitionBy("key").orderBy(F.desc("df"), "sym").rowsBetween(Window.unboundedPreceding, 0)
    seeds = known.withColumn("common", F.sum("w").over(common_first)).where(F.col("common") >= COMMON * F.col("n"))
    # a hot block is cut into a grid of cells, each met by one task
    rows, across = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("h", "t"))
    own = lambda n: F.array(F.pmod(F.xxhash64("key"), n).cast("int"))
    all_of = lambda n: F.sequence(F.lit(0), n - 1)
    roles = seeds.withColumn("role", F.explode(F.array_compact(F.array(F.when(F.col("held"), F.lit(True)), F.when(F.col("trained"), F.lit(False))))))
    grid = roles.withColumn("i", F.explode(F.when(F.col("role"), own(rows)).otherwise(all_of(rows)))).withColumn("j", F.explode(F.when(F.col("role"), all_of(across)).otherwise(own(across))))
    blocks = grid.select("sym", "i", "j", "role", "key", "n", "w").repartition("sym", "i", "j").sortWithinPartitions("sym", "i", "j")
    met = blocks.mapInPandas(_meetings, "held bigint, trained bigint, n_held int, n_trained int, w_held int, w_trained int")
    merged = met.groupBy("held", "trained").agg(F.first("n_held").alias("n_held"), F.first("n_trained").alias("n_trained"), F.sum("w_held").alias("w_held"), F.sum("w_trained").alias("w_trained"))
    return merged.where((F.col("w_held") >= (NEAR - COMMON) * F.col("n_held")) & (F.col("w_trained") >= (NEAR - COMMON) * F.col("n_trained"))).select("held", "trained")


def coverage(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], span: int) -> tuple[float, float, float, float]:
    """Part of the tokens of a and of b, and of their changed tokens, in shared spans of at least ``span`` tokens.

    A suffix lies in such a span if its first tokens are those of a suffix of the other record, and the spans of all
    such suffixes, merged, are the shared spans in their whole length.
    """
    size = min(span, len(a[0]), len(b[0]))
    x, y = windows(a[0], size), windows(b[0], size)

    def parts(own: np.ndarray, other: np.ndarray, changed: np.ndarray) -> tuple[float, float]:
        at = np.flatnonzero(np.isin(own, other))
        depth = np.zeros(len(changed) + 1, np.int64)
        np.add.at(depth, at, 1)
        np.add.at(depth, at + size, -1)
        covered = np.cumsum(depth)[:-1] > 0
        return float(covered.mean()), float(covered[changed].mean()) if changed.any() else 1.0

    (p, r), (q, s) = parts(x, y, a[1]), parts(y, x, b[1])
    return p, q, r, s


def same_change(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[bool, float, float]:
    """Whether the coverage says so, and the coverage of either record by long spans (else by short ones)."""
    if a[1].any() != b[1].any():
        return False, 0.0, 0.0
    p, q, r, s = coverage(a, b, LONG)
    if min(p, q, r, s) >= MOST or max(min(p, r), min(q, s)) >= WHOLE and min(p, q) >= PART:
        return True, p, q
    short = coverage(a, b, SHORT)
    return (True, *short[:2]) if min(short) >= ALMOST else (False, p, q)


def covered_pairs(entries: DataFrame) -> DataFrame:
    """entry_a < entry_b: one of either split, the same change; coverage_a and coverage_b by spans of the other."""
    recs = checkpoint(records(entries))
    reps = checkpoint(recs.groupBy("key").agg(F.first("n").alias("n"), F.first("syms").alias("syms"), F.first("weights").alias("weights"), F.max("hold_out").alias("held"), (~F.min("hold_out")).alias("trained"), F.min("entry_id").alias("entry_id")))
    pairs = checkpoint(candidates(reps))
    texts = entries.select("entry_id", "diff").dropDuplicates(["entry_id"])
    sides = pairs.select("held", "trained", F.explode(F.array(F.struct(F.lit(True).alias("role"), F.col("held").alias("key")), F.struct(F.lit(False).alias("role"), F.col("trained").alias("key")))).alias("s")).select("held", "trained", "s.role", "s.key")
    shown = sides.join(reps.select("key", "entry_id"), "key").join(texts, "entry_id")
    both = shown.groupBy("held", "trained").agg(F.max(F.when(F.col("role"), F.col("diff"))).alias("left"), F.max(F.when(~F.col("role"), F.col("diff"))).alias("right"))

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = Reader()
        for b in batches:
            rows = []
            for h, t, x, y in zip(b["held"], b["trained"], b["left"], b["right"]):
                same, p, q = same_change(read.tokens(x), read.tokens(y))
                if same:
                    rows.append((h, t, p, q))
            yield pd.DataFrame(rows, columns=["held", "trained", "c_held", "c_trained"])

    near = both.mapInPandas(fn, "held bigint, trained bigint, c_held double, c_trained double")
    equal = reps.where("held and trained").select(F.col("key").alias("held"), F.col("key").alias("trained"), F.lit(1.0).alias("c_held"), F.lit(1.0).alias("c_trained"))
    members = recs.select("entry_id", "hold_out", "key")
    h = members.where("hold_out").select(F.col("key").alias("held"), F.col("entry_id").alias("h"))
    t = members.where("not hold_out").select(F.col("key").alias("trained"), F.col("entry_id").alias("t"))
    out = near.unionByName(equal).join(h, "held").join(t, "trained").where("h <> t")
    first = F.col("h") < F.col("t")
    named = out.select(F.least("h", "t").alias("entry_a"), F.greatest("h", "t").alias("entry_b"), F.when(first, F.col("c_held")).otherwise(F.col("c_trained")).alias("coverage_a"), F.when(first, F.col("c_trained")).otherwise(F.col("c_held")).alias("coverage_b"))
    return named.groupBy("entry_a", "entry_b").agg(F.max("coverage_a").alias("coverage_a"), F.max("coverage_b").alias("coverage_b"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covered_pairs(table(spark, sf_dir, "benchmark_entries")).select("entry_a", "entry_b")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split, repository, entries that overlap with the other split, their pairs, and the mean coverage of the entries in them."""
    entries = table(spark, sf_dir, "benchmark_entries").select("entry_id", "hold_out", repository_key("repository").alias("repository"))
    pairs = covered_pairs(table(spark, sf_dir, "benchmark_entries"))
    both = pairs.select(F.explode(F.array(*[F.struct(F.col("entry_" + x).alias("entry_id"), F.col("coverage_" + x).alias("coverage")) for x in "ab"])).alias("e")).select("e.*")
    split = F.when(F.col("hold_out"), "evaluation").otherwise("training").alias("split")
    return both.join(entries, "entry_id").groupBy(split, "repository").agg(F.countDistinct("entry_id").alias("entries"), F.count("*").alias("pairs"), F.round(F.avg("coverage"), 4).alias("coverage"))


def p7_equal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The found pairs whose diffs are the same text: what a plain join on the text gives must be among them, and is all of these."""
    texts = table(spark, sf_dir, "benchmark_entries").select("entry_id", F.xxhash64("diff").alias("hash"), F.length("diff").alias("size"))
    a, b = (texts.select(F.col("entry_id").alias("entry_" + x), F.col("hash").alias("hash_" + x), F.col("size").alias("size_" + x)) for x in "ab")
    pairs = p7_found(spark, sf_dir).join(a, "entry_a").join(b, "entry_b")
    return pairs.where("hash_a = hash_b and size_a = size_b").select("entry_a", "entry_b")


SQL = {
    "p7_equal_pairs": """
        SELECT DISTINCT least(a.entry_id, b.entry_id) AS entry_a, greatest(a.entry_id, b.entry_id) AS entry_b FROM benchmark_entries a JOIN benchmark_entries b ON a.diff = b.diff AND a.hold_out AND NOT b.hold_out
        WHERE regexp_matches(a.diff, '@@ -[0-9]')""",
}
