"""Unified diffs as tables: files, hunks, numbered lines, ranges, groups, and back to text.

The lines of a diff are in one row, so they are read there in one Arrow pass, without a shuffle of text; only counts per
file and runs of lines meet by key.  A header is read as one only where a header can stand (before the first hunk of a
file, or where ``---``, ``+++`` and ``@@`` follow one another), so removed lines that begin with ``-- `` stay lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from patchlake.functions import columns as C
from patchlake.session import ship, spread

_GIT_HEADER = ("diff --git ", "index ", "new file mode", "deleted file mode", "old mode", "new mode", "similarity index", "dissimilarity index", "rename from", "rename to", "copy from", "copy to", "Binary files")
_HUNK = re.compile(r"@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@")
_LINE = "pos int, line string, file_idx bigint, hunk_idx bigint, role string, old_line int, new_line int, path string"
ROWS = 50_000  # of lines that leave the pass together


def read_lines(diff: str) -> Iterator[tuple]:
    """(pos, line, file_idx, hunk_idx, role, old_line, new_line, path) of a diff; hunk_idx is 0 and path none in headers."""
    rows = [x.removesuffix("\r") for x in diff.removesuffix("\n").split("\n")]
    n, file, hunk, old, new, path = len(rows), 0, 0, 0, 0, None
    names: dict[str, str] = {}
    for pos, line in enumerate(rows):
        if line.startswith("diff --git ") or line.startswith("--- ") and pos + 2 < n and rows[pos + 1].startswith("+++ ") and rows[pos + 2].startswith("@@ -") and not (pos and rows[pos - 1].startswith(_GIT_HEADER)):
            file, hunk, names = file + 1, 0, {}
        m = _HUNK.match(line) if file else None
        if m:
            if not hunk:
                path = _path(names)
            hunk, old, new = hunk + 1, int(m.group(1)), int(m.group(2))
            yield pos, line, file, hunk, "hunk", None, None, path
        elif not hunk:
            if line.startswith(("--- ", "+++ ")):
                names[line[:3]] = line[4:].split("\t")[0].removeprefix("a/" if line[0] == "-" else "b/")
            elif line.startswith("diff --git ") and (g := re.search(r" b/(.+)$", line)):
                names["git"] = g.group(1)
            yield pos, line, file, hunk, "header", None, None, None
        elif line[:1] == "+":
            yield pos, line, file, hunk, "added", None, new, path
            new += 1
        elif line[:1] == "-":
            yield pos, line, file, hunk, "removed", old, None, path
            old += 1
        elif line[:1] == "\\":
            yield pos, line, file, hunk, "marker", None, None, path
        else:
            yield pos, line, file, hunk, "context", old, new, path
            old, new = old + 1, new + 1


def _path(names: dict[str, str]) -> str | None:
    """The path after the change, of a deleted file the one before."""
    real = {k: v for k, v in names.items() if v != "/dev/null"}
    return real.get("+++", (real.get("git") if "+++" not in names else None) or real.get("---"))


def marked(entries: DataFrame, key: str = "entry_id", text: str = "diff") -> DataFrame:
    """Lines with file_idx, hunk_idx (0 in headers), their role and numbers; a final line end opens no further line,
    carriage returns at line ends go, blank texts have no lines."""
    ship(entries.sparkSession)
    rows = entries.where(F.col(text).rlike(r"\S")).select(F.col(key), F.col(text).alias("_text"))
    names = [key, *(x.split()[0] for x in _LINE.split(", "))]

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame() -> pd.DataFrame:
            return pd.DataFrame(out, columns=names).astype({"old_line": "Int64", "new_line": "Int64"})

        for b in batches:
            out: list[tuple] = []
            for k, t in zip(b[key], b["_text"]):
                for row in read_lines(t):
                    out.append((k, *row))
                    if len(out) >= ROWS:
                        yield frame()
                        out = []
            if out:
                yield frame()

    return spread(rows).mapInPandas(fn, StructType([rows.schema[key], *StructType.fromDDL(_LINE)]))


def files(entries: DataFrame, key: str = "entry_id", text: str = "diff") -> DataFrame:
    """key, file_idx, path, old_path, status, language, hunks, added, removed."""
    m = marked(entries, key, text).where("file_idx > 0")
    head = F.col("role") == "header"
    path = lambda prefix, side: F.max(F.when(head & F.col("line").startswith(prefix), F.regexp_replace(F.split(F.expr("substring(line, 5)"), "\t")[0], f"^{side}/", "")))
    f = m.groupBy(key, "file_idx").agg(
        path("--- ", "a").alias("_old"),
        path("+++ ", "b").alias("_new"),
        F.max(F.when(head & F.col("line").startswith("diff --git "), F.regexp_extract("line", r" b/(.+)$", 1))).alias("_git"),
        F.max(F.when(head & F.col("line").startswith("rename from "), F.expr("substring(line, 13)"))).alias("_from"),
        F.bool_or(head & F.col("line").startswith("new file mode")).alias("_is_new"),
        F.bool_or(head & F.col("line").startswith("deleted file mode")).alias("_is_deleted"),
        F.max("hunk_idx").alias("hunks"),
        F.count_if(F.col("role") == "added").alias("added"),
        F.count_if(F.col("role") == "removed").alias("removed"),
    )
    real = lambda c: F.when(F.col(c) != "/dev/null", F.col(c))
    new, old = F.coalesce(real("_new"), F.when(F.col("_new").isNull(), F.col("_git")), real("_old")), F.coalesce(F.col("_from"), real("_old"))
    status = F.when(F.col("_is_new") | (F.col("_old") == "/dev/null"), "added").when(F.col("_is_deleted") | (F.col("_new") == "/dev/null"), "deleted").when(F.col("_from").isNotNull(), "renamed").otherwise("modified")
    return f.select(key, "file_idx", new.alias("path"), old.alias("old_path"), status.alias("status"), C.extension_language(new).alias("language"), "hunks", "added", "removed")


def numbered(entries: DataFrame, key: str = "entry_id", text: str = "diff") -> DataFrame:
    """key, file_idx, hunk_idx, pos, kind, text, old_line, new_line: the central table of changed and context lines."""
    return placed(entries, key, text).drop("path")


def placed(entries: DataFrame, key: str = "entry_id", text: str = "diff") -> DataFrame:
    """Numbered lines with the path of their file."""
    body = F.when(F.substring("line", 1, 1).isin("+", "-", " "), F.expr("substring(line, 2)")).otherwise(F.col("line"))
    return marked(entries, key, text).where("role in ('added', 'removed', 'context')").select(key, "file_idx", "hunk_idx", "pos", F.col("role").alias("kind"), body.alias("text"), "old_line", "new_line", "path")


def hunks(entries: DataFrame, key: str = "entry_id", text: str = "diff") -> DataFrame:
    """Hunk headers: starts and counts, a missing count is 1."""
    h = marked(entries, key, text).where("role = 'hunk'")
    part = lambda g: F.regexp_extract("line", r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@ ?(.*)$", g)
    count = lambda g: F.coalesce(F.nullif(part(g), F.lit("")).cast("int"), F.lit(1))
    return h.select(key, "file_idx", "hunk_idx", part(1).cast("int").alias("old_start"), count(2).alias("old_count"), part(3).cast("int").alias("new_start"), count(4).alias("new_count"), part(5).alias("note"))


def changed_ranges(lines: DataFrame, key: str = "entry_id") -> DataFrame:
    """Runs of consecutive added lines per hunk."""
    hunk = [key, "file_idx", "hunk_idx"]
    island = F.col("new_line") - F.row_number().over(Window.partitionBy(*hunk).orderBy("new_line"))
    return lines.where("kind = 'added'").withColumn("_island", island).groupBy(*hunk, "_island").agg(F.min("new_line").alias("first_line"), F.max("new_line").alias("last_line")).drop("_island")


def to_text(entries: DataFrame, key: str = "entry_id", text: str = "diff") -> DataFrame:
    """The diff again from its lines: headers, hunks and signs in their order."""
    rows = marked(entries, key, text).where("file_idx > 0")
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))


def reversed_lines(lines: DataFrame) -> DataFrame:
    """The patch that takes the change back: added and removed change places, and so do line numbers."""
    kind = F.when(F.col("kind") == "added", "removed").when(F.col("kind") == "removed", "added").otherwise(F.col("kind"))
    return lines.withColumn("kind", kind).withColumnsRenamed({"old_line": "_o", "new_line": "old_line"}).withColumnRenamed("_o", "new_line")


def budget_groups(sizes: DataFrame, budget: int = 14_000, key: str = "entry_id") -> DataFrame:
    """Files in order, a new group where the next would pass the token budget; an oversized file stands alone.

    ``sizes``: key, file_idx, path, tokens.  The fold runs over one diff's files.
    """
    files_ = F.array_sort(F.collect_list(F.struct("file_idx", "path", F.col("tokens").cast("bigint").alias("tokens"))))
    start = F.struct(F.array().cast("array<struct<grp:int,file_idx:bigint,path:string,tokens:bigint>>").alias("out"), F.lit(0).alias("grp"), F.lit(0).cast("bigint").alias("used"))

    def step(acc, f):
        fresh = (acc["used"] > 0) & (acc["used"] + f["tokens"] > budget)
        grp = F.when(fresh, acc["grp"] + 1).otherwise(acc["grp"])
        return F.struct(F.array_append(acc["out"], F.struct(grp.alias("grp"), f["file_idx"].cast("bigint").alias("file_idx"), f["path"].alias("path"), f["tokens"].alias("tokens"))).alias("out"), grp.alias("grp"), F.when(fresh, f["tokens"]).otherwise(acc["used"] + f["tokens"]).alias("used"))

    folded = sizes.groupBy(key).agg(F.aggregate(files_, start, step)["out"].alias("g"))
    return folded.select(key, F.explode("g").alias("g")).select(key, F.col("g.grp").alias("grp"), F.col("g.file_idx").alias("file_idx"), F.col("g.path").alias("path"), F.col("g.tokens").alias("tokens"))


def group_descriptions(groups: DataFrame, key: str = "entry_id") -> DataFrame:
    return groups.groupBy(key, "grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_idx", "path"))), lambda x: x["path"]), ", ").alias("files"), F.sum("tokens").alias("tokens"))


def added_texts(lines: DataFrame, key: str = "entry_id") -> DataFrame:
    """key, file_idx, text: the added lines of each file joined, so rules that go over a line end can meet them."""
    rows = lines.where("kind = 'added'").groupBy(key, "file_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("x"))
    return rows.select(key, "file_idx", F.array_join(F.transform("x", lambda v: v["text"]), "\n").alias("text"))


def limited(kept: DataFrame, sizes: DataFrame, max_chars: int, key: str = "entry_id") -> DataFrame:
    """Of the files kept for a category (key, category, file_idx) those whose texts, in order, stay within ``max_chars``; the
    first always stays, to be cut.  ``sizes``: key, file_idx, chars."""
    w = Window.partitionBy(key, "category").orderBy("file_idx")
    used = kept.join(sizes, [key, "file_idx"]).withColumn("_used", F.sum("chars").over(w)).withColumn("_n", F.row_number().over(w))
    return used.where((F.col("_used") <= max_chars) | (F.col("_n") == 1)).select(key, "category", "file_idx", F.least("chars", F.lit(max_chars)).alias("chars"))


def focused(lines: DataFrame, hits: DataFrame, key: str = "entry_id") -> DataFrame:
    """key, category, file_idx: files whose added text meets a category's rules, or all files where none does."""
    every = lines.select(key, "file_idx").distinct()
    met = hits.select(key, "category", "file_idx").distinct()  # hits of rules in a file's joined added text
    categories = F.broadcast(hits.sparkSession.createDataFrame([(c,) for c in C.CHECKS], "category string"))
    some = met.groupBy(key, "category").agg(F.lit(True).alias("some"))
    return every.join(categories).join(some, [key, "category"], "left").join(met.withColumn("met", F.lit(True)), [key, "category", "file_idx"], "left").where("some is null or met").select(key, "category", "file_idx")


def commit_files(entries: DataFrame, key: str = "entry_id", text: str = "diff") -> DataFrame:
    """key, files: the changed paths of a commit in the order of its diff, each once."""
    f = files(entries, key, text).where("path is not null").groupBy(key, "path").agg(F.min("file_idx").alias("at"))
    return f.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "path"))), lambda x: x["path"]), "\n").alias("files"))


def imported(instances: DataFrame) -> DataFrame:
    """Benchmark entries of recorded instances (instance_id, repo, base_commit, patch, problem_statement, snapshot map):
    touched files and language come from the parsed patch; an instance whose patch has no file gives no entry."""
    rows = instances.select(F.col("instance_id").alias("entry_id"), F.col("repo").alias("repository"), F.col("base_commit").alias("parent_commit"), F.col("problem_statement").alias("bug_description"), F.col("patch").alias("diff"), F.col("snapshot").alias("base_files"))
    touched = files(rows).where("path is not null").groupBy("entry_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("file_idx", "path"))), lambda x: x["path"]).alias("affected_files"), F.min_by("language", "file_idx").alias("language"))
    return rows.join(touched, "entry_id").withColumn("hold_out", F.lit(True)).withColumn("base_files", F.map_filter("base_files", lambda p, _: F.array_contains("affected_files", p)))


def repository_name(remote: str = "remote") -> Column:
    """owner/name of a remote address."""
    return F.regexp_extract(remote, r"[/:]([^/:]+/[^/]+?)(?:\.git)?/?$", 1)
