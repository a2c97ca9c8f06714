"""Problem 4: pieces of at most ``limit`` characters, cut at natural boundaries, with overlap.

A text is read as a tree by the strength of the boundary before each line: file header, hunk, heading, unindented line
after a blank one, blank line, list item or tag, then lines by indentation; below a line come statement ends, words and
at last single characters (never between a letter and its combining mark or inside \\r\\n).  Sibling subtrees are merged
bottom-up while they fit; only an oversized node is descended into.  What is then left of neighbouring subtrees is
joined while it fits, so a piece may begin within one subtree and end within the next; cuts stay where the tree had
them.  Cores have ``limit - overlap`` characters at most, the first one too.  Each piece but the first repeats the end of the one
before, up to ``overlap`` characters, from a line start when there is one.

Pieces concatenated without their overlaps give the text back.  Null and texts within the limit give no row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from patchlake.llm.places import places
from patchlake.session import spread, table

LIMIT, OVERLAP = 1500, 200
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r|\Z)")
_HEAD = re.compile(r"(#{1,6})\s|<h([1-6])\b", re.I)
_ITEM = re.compile(r"\s*(?:[-*+•]\s|\d+[.)]\s|</?(?:p|li|ul|ol|div|section|article|table|tr)\b)", re.I)
_INSIDE = (re.compile(r"(?<=[;}])"), re.compile(r"(?<=[,.!?])(?=\s|\S)"), re.compile(r"(?<=\s)(?=\S)"))


def lines(text: str) -> list[str]:
    """Lines with their ends."""
    return text.splitlines(keepends=True) if not _ODD_ENDS.search(text) else [x for x in _LINE.findall(text) if x]


_ODD_ENDS = re.compile("[\x0b\x0c\x1c\x1d\x1e\x85  ]")


def ranks(rows: list[str], diff: bool) -> list[int]:
    """Depth of the boundary before each line: small is strong."""
    out, blank, header = [], True, False
    for row in rows:
        body = row
        if diff:
            if row.startswith("diff --git ") or (row.startswith(("--- ", "Index: ")) and not header):
                out.append(0)
                header, blank = True, True
                continue
            if row.startswith("@@"):
                out.append(1)
                header, blank = False, True
                continue
            if header:
                out.append(9)  # stays with its header
                continue
            body = row[1:]
        bare = body.lstrip(" \t")
        if not bare.strip():
            out.append(7)
            blank = True
            continue
        if not diff and (h := _HEAD.match(body)):
            out.append(len(h.group(1) or "#" * int(h.group(2))) - 1 if body[0] != "#" or body[1:2] in "# " and not body.startswith("#!") else 3)
        else:
            indent = len(body.expandtabs(4)) - len(body.expandtabs(4).lstrip())
            level = 2 + min(indent // 2, 6)
            out.append(level if blank else 4 + level - (1 if _ITEM.match(body) else 0))
        blank = False
    return out


def _break(line: str, limit: int) -> list[str]:
    """A line over the limit: at statement ends, else after punctuation, else at words, else anywhere."""
    parts = [line]
    for cut in _INSIDE:
        if all(len(p) <= limit for p in parts):
            return parts
        parts = [q for p in parts for q in (_greedy([x for x in cut.split(p) if x], limit) if len(p) > limit else [p])]
    out = []
    for p in parts:
        while len(p) > limit:
            k = limit
            while k > limit // 2 and (unicodedata.combining(p[k]) or p[k] in "‍️" or p[k - 1] == "‍" or p[k - 1 : k + 1] == "\r\n"):
                k -= 1
            out.append(p[:k])
            p = p[k:]
        out.append(p)
    return out


def _greedy(units: list[str], limit: int) -> list[str]:
    out, held, size = [], [], 0
    for u in units:
        if held and size + len(u) > limit:
            out.append("".join(held))
            held, size = [], 0
        held.append(u)
        size += len(u)
    return out + (["".join(held)] if held else [])


def pack(rows: list[str], depth: list[int], limit: int) -> list[str]:
    """Cores of at most ``limit`` characters."""
    starts = [0]
    for r in rows:
        starts.append(starts[-1] + len(r))
    out: list[tuple[int, int]] = []  # line ranges; a long line alone
    stack = [(0, len(rows))]
    while stack:
        a, b = stack.pop()
        if starts[b] - starts[a] <= limit or b - a == 1:
            out.append((a, b))
            continue
        least = min(depth[a + 1 : b])
        cuts = [a, *(i for i in range(a + 1, b) if depth[i] == least), b]
        merged, at = [], a
        for i, j in zip(cuts, cuts[1:]):  # siblings are merged while they fit
            if i > at and starts[j] - starts[at] > limit:
                merged.append((at, i))
                at = i
        merged.append((at, b))
        stack += reversed(merged)
    joined: list[tuple[int, int]] = []
    for a, b in out:  # what is left of neighbouring subtrees
        if joined and starts[b] - starts[joined[-1][0]] <= limit:
            joined[-1] = (joined[-1][0], b)
        else:
            joined.append((a, b))
    cores: list[str] = []
    for a, b in joined:
        core = "".join(rows[a:b])
        cores += _break(core, limit) if len(core) > limit else [core]
    return cores


def cut(text: str, diff: bool = False, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start of the core, length of the overlap before it, piece)."""
    rows = lines(text)
    out, at, before = [], 0, ""
    for core in pack(rows, ranks(rows, diff), limit - overlap):
        repeat = before[-overlap:] if overlap else ""
        if len(before) > overlap and (k := repeat.find("\n") + 1) and k < len(repeat):
            repeat = repeat[k:]
        while repeat and (unicodedata.combining(repeat[0]) or repeat[0] in "‍️\n"):
            repeat = repeat[1:]
        out.append((at, len(repeat), repeat + core))
        at += len(core)
        before = core
    return out


def pieces(texts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """entry_id, place, piece_no, start, overlap, piece for every text of more than ``limit`` characters."""

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(e, p, k, *x) for e, p, t in zip(b["entry_id"], b["place"], b["text"]) for k, x in enumerate(cut(t, p == "diff", limit, overlap))]
            yield pd.DataFrame(rows, columns=["entry_id", "place", "piece_no", "start", "overlap", "piece"])

    return spread(texts.where(F.length("text") > limit)).mapInPandas(fn, "entry_id string, place string, piece_no int, start bigint, overlap int, piece string")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces(places(table(spark, sf_dir, "benchmark_entries")))
    return found.where("piece_no = 0").select("entry_id", "place").distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(places(table(spark, sf_dir, "benchmark_entries")))


def p4_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry_id, place, n_chars: characters covered by the pieces without their overlaps, for the check against the texts."""
    found = pieces(places(table(spark, sf_dir, "benchmark_entries")))
    return found.groupBy("entry_id", "place").agg(F.sum(F.length("piece") - F.col("overlap")).alias("n_chars"), F.max(F.length("piece")).alias("longest")).select("entry_id", "place", "n_chars", (F.col("longest") <= LIMIT).alias("within_limit"))


_TEXTS = """
    SELECT entry_id, 'diff' AS place, diff AS text FROM benchmark_entries
    UNION ALL SELECT entry_id, e.key, e.value FROM (SELECT entry_id, unnest(map_entries(base_files)) AS e FROM benchmark_entries)"""

SQL = {
    "p4_found": f"SELECT DISTINCT entry_id, place FROM ({_TEXTS}) WHERE length(text) > {LIMIT}",
    "p4_covered": f"SELECT entry_id, place, sum(length(text)) AS n_chars, TRUE AS within_limit FROM ({_TEXTS}) WHERE length(text) > {LIMIT} GROUP BY 1, 2",
}
