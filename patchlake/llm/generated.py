"""Problem 5: generated, minified, vendored and data files among the files of a diff.

Attribute files (.gitattributes of the snapshot or added by the diff) declare paths as generated or vendored, or take
that back; within a file the last matching line wins, and a file in a deeper directory wins over one above it.  Paths
that no attribute file speaks of fall under the equivalent patterns mined from the corpus: of every file that is declared
or shows evidence in its lines the name, the extensions, the words at its ends and the directories are counted, and a
pattern with ``SUPPORT`` files nearly all of which (``PRECISION``) are such files holds for the others too.  Then come the
conventional patterns (DEFAULTS, in the syntax of attribute files), then the file's own lines.  Evidence is a generator's
or upstream's mark in a comment anywhere in the lines shown, minified lines, or lines of mere data.

An entry without a diff, with a diff without files, and deleted files give no row; a path touched twice gives one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from patchlake.session import BROADCAST_ROWS, checkpoint, spread, table

# fixed values: conventional names of generated and vendored files, as an attribute file; external and deps are taken for
# vendored only at the root and for the copies in a folder of their own there, one per package
DEFAULTS = """
Cargo.lock generated
poetry.lock generated
uv.lock generated
yarn.lock generated
Gemfile.lock generated
composer.lock generated
Pipfile.lock generated
flake.lock generated
package-lock.json generated
npm-shrinkwrap.json generated
pnpm-lock.yaml generated
go.sum generated
*.min.js generated
*.min.css generated
*.js.map generated
*.css.map generated
*.snap generated
*_pb2.py generated
*_pb2.pyi generated
*_pb2_grpc.py generated
*.pb.go generated
*.pb.cc generated
*.pb.h generated
*_pb.js generated
*.g.dart generated
*.designer.cs generated
zz_generated*.go generated
vendor/** vendored
_vendor/** vendored
vendored/** vendored
third_party/** vendored
third-party/** vendored
thirdparty/** vendored
node_modules/** vendored
bower_components/** vendored
/external/*/** vendored
/deps/*/** vendored
*-[0-9]*.[0-9]*.[0-9]*.js vendored
*-[0-9]*.[0-9]*.[0-9]*.css vendored
"""
#: A mined pattern needs so many files, and so large a part of them with evidence.
SUPPORT, PRECISION = 20, 0.95

_MARK = re.compile(
    r"\s*(?:(?://+|#+|/\*+!?|\*|<!--|--|;+|%+|\"\"\")\W{0,4}(?:"
    r"code generated\b|auto-?generated\b|<auto-generated>|@generated\b|generated (?:by|from|code|file|with)\b|"
    r"this (?:file|code|module) (?:is|was|has been) (?:automatically |auto-?)?generated\b|automatically generated\b|"
    r"(?:please )?do not (?:edit|modify)\b|machine[- ](?:written|generated)\b|"
    r"(?:automatisch )?(?:erzeugt|generiert) (?:durch|von|mit)\b|g[eé]n[eé]r[eé] (?:par|automatiquement)\b|generado (?:por|autom)|"
    r"parser tables; regenerate\b)|@Generated\b)",
    re.I,
)
_UPSTREAM = re.compile(r"\s*(?://+|#+|/\*+!?|\*).{0,80}?(?:\bcopied (?:unchanged |verbatim )?from (?:the )?(?:upstream|http)|\bvendored from\b|\bupstream: ?https?://|\bimported unchanged from\b)", re.I)
_TAKEN_BACK = re.compile(r"used to be|no longer|kept by hand|by hand since|hand[- ](?:written|maintained|edited)|was once", re.I)
_DATA = re.compile(r"\s*(?:[\[({]?\s*(?:0x[0-9a-f]+|-?\d{1,3}|-?\d*\.\d+(?:e[+-]?\d+)?)(?:\s*,\s*(?:0x[0-9a-f]+|-?\d{1,3}|-?\d*\.\d+(?:e[+-]?\d+)?))+\s*[\])}]?\s*,?|INSERT INTO \S+ .*VALUES\s*\(.*\)[;,]?|\(.*\),|[A-Za-z0-9+/]{60,}={0,2})\s*", re.I)
_HEX = re.compile(r"\s*(?:0x[0-9a-f]{1,4}\s*,\s*){3,}", re.I)
_SECTION = re.compile(r"(?:^diff --git [^\n]*\n(?:(?!diff --git |--- |@@)[^\n]*\n)*)?^--- [^\n]*\n\+\+\+ ([^\n]*)", re.M)
_PACKED = re.compile(r"\.(?:m?[jt]sx?|cjs|css|html?|svg|json|vue|php)$", re.I)


def files(diff: str) -> list[tuple[str, list[str]]]:
    """(path after the change, lines of its hunks with their sign); deleted files are left out."""
    heads = [m for m in _SECTION.finditer(diff)]
    out = []
    for m, after in zip(heads, [*heads[1:], None]):
        path = m.group(1).split("\t")[0].rstrip("\r ")
        if path == "/dev/null":
            continue
        if path.startswith('"') and path.endswith('"'):
            path = path[1:-1]
        body = diff[m.end() : after.start() if after else len(diff)].split("\n")[1:]
        out.append((path[2:] if path.startswith("b/") else path, [x.rstrip("\r") for x in body if not x.startswith("@@")]))
    return out


def evidence(path: str, body: list[str]) -> str | None:
    """What the visible lines show: generated, vendored, minified, data or None."""
    shown = [x[1:] if x[:1] in ("+", " ") else x for x in body if x[:1] not in ("-", "\\")]  # stray lines lack a sign
    for x in shown:
        if (m := _MARK.match(x) or _UPSTREAM.match(x)) and not _TAKEN_BACK.search(x, 0, m.end() + 200):
            return "vendored" if m.re is _UPSTREAM else "generated"
    size = sum(map(len, shown)) or 1
    wide = sum(len(x) for x in shown if len(x) > 250)
    if wide > 0.8 * size and _PACKED.search(path):
        longest = max(shown, key=len)
        if longest.count(" ") < 0.12 * len(longest):
            return "minified"
    full = [x for x in shown if x.strip()]
    if len(full) >= 4:
        data = [x for x in full if _DATA.fullmatch(x)]
        if len(data) >= 0.8 * len(full) and not any("BEGIN" in x for x in full) and (sum(bool(_HEX.match(x)) for x in data) + sum("INSERT" in x.upper() or len(x) >= 60 for x in data) >= 0.5 * len(data)):
            return "data"
    return None


def glob(pattern: str) -> str:
    """Regular expression of an attribute pattern, relative to the attribute file's directory."""
    anchored = "/" in pattern.rstrip("/") and not pattern.startswith("**/")
    p = pattern.strip("/")
    if p.endswith("/**") and "/" not in p[:-3]:
        anchored = pattern.startswith("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and (j := p.find("]", i + 2)) > 0:
            out, i = out + "[" + p[i + 1 : j].replace("\\", r"\\").replace("!", "^", p[i + 1] == "!") + "]", j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("" if anchored else "(?:.*/)?") + out + ("(?:/.*)?" if pattern.endswith("/") else "")


def rules(text: str, directory: str = "") -> list[tuple[str, re.Pattern, str, bool]]:
    """(directory, pattern, kind, set or taken back) in the order of the file."""
    out = []
    for line in text.splitlines():
        parts = line.split()
        if len(parts) < 2 or parts[0].startswith("#"):
            continue
        for a in parts[1:]:
            off, name = a.startswith(("-", "!")), a.lstrip("-!")
            name, _, value = name.removeprefix("linguist-").partition("=")
            if name in ("generated", "vendored"):
                out.append((directory, re.compile(glob(parts[0])), name, not off and value.lower() not in ("false", "0", "no")))
    return out


_DEFAULT_RULES = rules(DEFAULTS)


def declared(path: str, found: list[tuple[str, re.Pattern, str, bool]]) -> str | bool | None:
    """Kind that the attribute rules set for the path, False where they only take back, None where they are silent."""
    said: dict[str, tuple[int, bool]] = {}
    for directory, pattern, kind, on in found:
        if directory and not path.startswith(directory + "/"):
            continue
        if pattern.fullmatch(path[len(directory) + 1 :] if directory else path) and len(directory) >= said.get(kind, (-1, False))[0]:
            said[kind] = (len(directory), on)
    return next((k for k, (_, on) in said.items() if on), False) if said else None


def candidates(path: str) -> list[str]:
    """Patterns of which the path is an instance: by word and extension, by leading word, by extension chain, by directory."""
    *dirs, name = path.split("/")
    stem, dot, ext = name.partition(".")
    out = {f"dir:{d}/" for d in dirs} | {name}
    if dot and "." in ext:
        out.add(f"*.{ext}")
    words = re.split(r"[_-]", stem)
    if dot and len(words) > 1:
        out |= {f"*_{words[-1]}.{ext}", f"{words[0]}_*.{ext}"}
    if (m := re.search(r"[a-z0-9]([A-Z][a-z]+)$", stem)) and dot:
        out.add(f"*{m.group(1)}.{ext}")
    return sorted(out)


def examined(entries: DataFrame) -> DataFrame:
    """entry_id, path, declared (kind, or none where taken back), shown (kind by its lines), usual (kind by DEFAULTS), like."""

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for entry, diff, attributes in zip(b["entry_id"], b["diff"], b["attributes"]):
                touched = files(diff)
                own = [(p.rpartition("/")[0], t) for p, t in (attributes if attributes is not None else [])]
                own += [(p.rpartition("/")[0], "\n".join(x[1:] for x in body if x[:1] in "+ ")) for p, body in touched if p.rpartition("/")[2] == ".gitattributes"]
                found = [r for d, t in sorted(own, key=lambda x: len(x[0])) for r in rules(t or "", d)]
                for path, body in touched:
                    said = declared(path, found) if found else None
                    rows.append((entry, path, "none" if said is False else said, evidence(path, body), declared(path, _DEFAULT_RULES) or None, candidates(path)))
            yield pd.DataFrame(rows, columns=["entry_id", "path", "declared", "shown", "usual", "like"])

    attributes = F.transform(F.filter(F.coalesce(F.map_entries("base_files"), F.array().cast("array<struct<key:string,value:string>>")), lambda e: e["key"].rlike(r"(^|/)\.gitattributes$")), lambda e: F.array(e["key"], e["value"]))
    return spread(entries.where("diff is not null").select("entry_id", "diff", attributes.alias("attributes"))).mapInPandas(fn, "entry_id string, path string, declared string, shown string, usual string, like array<string>")


def mined(found: DataFrame) -> DataFrame:
    """pattern, kind, n, part: patterns whose files are declared or show evidence but for ``1 - PRECISION`` of them."""
    label = F.coalesce("declared", "shown")
    known = found.select(F.explode("like").alias("pattern"), F.when(label != "none", label).alias("kind")).groupBy("pattern", "kind").agg(F.count("*").alias("n"))
    sizes = known.groupBy("pattern").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("kind").isNotNull(), F.col("n"))).alias("hits"), F.max_by("kind", F.struct(F.when(F.col("kind").isNotNull(), F.col("n")).alias("n"), "kind")).alias("kind"))
    return sizes.where(F.col("n") >= SUPPORT).withColumn("part", F.col("hits") / F.col("n")).where(F.col("part") >= PRECISION).select("pattern", "kind", "n", F.round("part", 6).alias("part"))


def classified(entries: DataFrame) -> DataFrame:
    """entry_id, path, kind, basis for every file of every diff; kind null for hand-written files."""
    found = checkpoint(examined(entries))
    patterns = checkpoint(mined(found))
    small = patterns.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    silent = found.where("declared is null").select("entry_id", "path", F.explode("like").alias("pattern"))
    like = silent.join(F.broadcast(patterns) if small else patterns, "pattern").select("entry_id", "path", F.struct("part", "n", F.col("kind").alias("mined")).alias("by"))
    each = found.select("entry_id", "path", "declared", "shown", "usual", F.lit(None).cast("struct<part:double,n:bigint,mined:string>").alias("by")).unionByName(like, allowMissingColumns=True)
    whole = each.groupBy("entry_id", "path").agg(F.max("declared").alias("declared"), F.max("by")["mined"].alias("mined"), F.max("usual").alias("usual"), F.max("shown").alias("shown"))
    kind = F.coalesce("declared", "mined", "usual", "shown")
    basis = F.when(F.col("declared").isNotNull(), "attributes").when(F.col("mined").isNotNull(), "mined").when(F.col("usual").isNotNull(), "pattern").when(F.col("shown").isNotNull(), "content")
    return whole.select("entry_id", "path", F.when(kind != "none", kind).alias("kind"), basis.alias("basis"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "benchmark_entries")).where("kind is not null").select("entry_id", "path")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, basis, files; hand-written files under kind null."""
    return classified(table(spark, sf_dir, "benchmark_entries")).groupBy("kind", "basis").agg(F.count("*").alias("files"))


def p5_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pattern, kind, n, part: the patterns mined from the corpus, with their support and precision."""
    return mined(examined(table(spark, sf_dir, "benchmark_entries")))
