"""Facts of Python files (definitions, references, environment reads, routes, flaws, taint), and symbol-anchored chunks.

One pass per file in Arrow batches emits typed facts; questions over several files are joins on these facts.  A file
that does not parse gives no facts.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from patchlake.functions import columns as C
from patchlake.session import spread

MAX_CHARS = 1_000_000
FACTS = "entry_id string, path string, fact string, name string, line int, detail string"

# fixed values: where data comes from, where it must not go unchecked, and what makes it safe
SOURCES = frozenset("request req params query_params query body json_body headers cookies form files environ os.environ argv sys.argv message msg payload event record user_input input_data user username".split())
SENSITIVE = frozenset("password passwd pwd api_key apikey secret token access_token refresh_token ssn credit_card authorization auth_header cookie".split())
SOURCE_PARAMETERS = frozenset("request req params query body payload event message data input_data args".split())
SINKS = {
    "sql": "db.execute db.executemany db.raw_sql cursor.execute conn.execute session.execute",
    "shell": "os.system os.popen subprocess.call subprocess.run subprocess.Popen os.spawn",
    "fs": "os.remove os.unlink os.rename shutil.copy shutil.move shutil.rmtree os.path.join",
    "http": "requests.get requests.post requests.put requests.delete httpx.get httpx.post httpx.put httpx.delete urlopen",
    "deserialize": "pickle.loads yaml.load marshal.loads",
}
BARE_SINKS = {"eval": "shell", "exec": "shell", "compile": "shell", "open": "fs", "redirect": "http"}
SANITIZERS = frozenset("strip replace lower upper escape quote quote_plus urlencode html.escape clean int float json.dumps uuid getattr".split())
HTTP_METHODS = frozenset("get post put delete patch route".split())
STOP_WORDS = (
    "the", "and", "this", "that", "with", "from", "line", "should", "does", "when", "into", "using", "after", "before", "their", "there", "these", "those", "would", "could", "might", "must", "will", "have", "been", "being",
)
BLOCKING = ("time.sleep", "requests.", "urllib.", "socket.", "subprocess.")
SYMBOLS = {
    "python": [("class", r"^\s*class\s+(\w+)"), ("function", r"^\s*(?:async\s+)?def\s+(\w+)")],
    "javascript": [("class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("function", r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[^=]+?)\s*=>")],
    "go": [("function", r"^func\s+\([^)]*\)\s+(\w+)"), ("function", r"^func\s+(\w+)"), ("type", r"^type\s+(\w+)")],
    "java": [("class", r"^\s*(?:public|protected|private)?\s*(?:abstract\s+|final\s+|static\s+)*class\s+(\w+)"), ("interface", r"^\s*(?:public\s+)?interface\s+(\w+)"), ("method", r"^\s*(?:public|protected|private|static|final|synchronized|abstract|\w+\[\]|\w+)\s+(\w+)\s*\([^;{]*\)\s*(?:throws\s+[\w, ]+)?\{")],
    "rust": [("function", r"^(?:pub(?:\([^)]*\))?\s+)?fn\s+(\w+)"), ("struct", r"^(?:pub\s+)?struct\s+(\w+)"), ("enum", r"^(?:pub\s+)?enum\s+(\w+)"), ("trait", r"^(?:pub\s+)?trait\s+(\w+)")],
    "ruby": [("class", r"^\s*class\s+(\w+)"), ("module", r"^\s*module\s+(\w+)"), ("method", r"^\s*def\s+(\w+)")],
    "shell": [("function", r"^\s*(?:function\s+)?(\w+)\s*\(\)\s*\{")],
    "typescript": [
        ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("type", r"^\s*(?:export\s+)?type\s+(\w+)[^=]*="), ("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(\w+)"),
        ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("function", r"^\s*(?:export\s+)?const\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"),
    ],
    "c": [("struct", r"^(?:typedef\s+)?(?:struct|union|enum)\s+(\w+)\s*\{?\s*$"), ("function", r"^(?!\s|#|return\b|else\b|if\b|for\b|while\b|switch\b)[\w\s*]+?\b(\w+)\s*\([^;]*$")],
    "cpp": [("class", r"^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct)\s+(\w+)[^;]*$"), ("namespace", r"^\s*namespace\s+(\w+)"), ("function", r"^(?!\s|#|return\b|else\b|if\b|for\b|while\b|switch\b)[\w\s*&:<>,~]+?\b([\w~]+)\s*\([^;]*$")],
    "kotlin": [("class", r"^\s*(?:(?:public|private|internal|open|abstract|sealed|data|enum)\s+)*(?:class|object|interface)\s+(\w+)"), ("function", r"^\s*(?:(?:public|private|internal|protected|override|open|suspend|inline)\s+)*fun\s+(?:<[^>]+>\s*)?(?:\w+\.)?(\w+)")],
    "swift": [("type", r"^\s*(?:(?:public|private|internal|open|final|fileprivate)\s+)*(?:class|struct|enum|protocol|extension|actor)\s+(\w+)"), ("function", r"^\s*(?:(?:public|private|internal|open|static|class|override|mutating|fileprivate)\s+)*func\s+(\w+)")],
}
_BROAD = ("correctness", "maintainability", "data_integrity", "security", "performance", "reliability", "resource_lifecycle")
_HANDLING = ("error_handling", "observability", "reliability")
#: categories of findings that a flaw of the syntax tree on their line confirms
FLAW_CATEGORIES = {
    "mutable-default": _BROAD, "sql-construction": _BROAD, "unchecked-index": _BROAD, "dangerous-call": _BROAD, "bare-except": _HANDLING, "swallowed-except": _HANDLING,
    "blocking-in-async": ("performance", "reliability", "compatibility"), "signature-change": ("api_contract",), "unused-import": ("dead_code", "api_contract", "maintainability"),
}
_SINK_OF = {name: kind for kind, names in SINKS.items() for name in names.split()}


def dotted(node: ast.AST) -> str:
    """a.b.c of names and attributes, '' of anything else."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ""


def facts_of(text: str) -> list[tuple[str, str, int, str]]:
    """(fact, name, line, detail) of one file."""
    tree = ast.parse(text)
    out: list[tuple[str, str, int, str]] = []
    handlers: set[ast.AST] = set()
    for node in ast.walk(tree):
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            module = "" if isinstance(node, ast.Import) else node.module or ""
            for a in node.names:
                bound = a.asname or (a.name.split(".")[0] if isinstance(node, ast.Import) else a.name)
                out.append(("import", bound, node.lineno, f"{module}.{a.name}".strip(".")))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            args = node.args
            out.append(("async" if isinstance(node, ast.AsyncFunctionDef) else "function", node.name, node.lineno, ",".join(x.arg for x in [*args.posonlyargs, *args.args, *args.kwonlyargs])))
            out.append(("span", node.name, node.lineno, str(node.end_lineno)))
            for default in [*args.defaults, *args.kw_defaults]:
                if isinstance(default, (ast.List, ast.Dict, ast.Set)):
                    out.append(("mutable-default", node.name, node.lineno, ""))
            for deco in node.decorator_list:
                if isinstance(deco, ast.Call) and isinstance(deco.func, ast.Attribute) and deco.func.attr in HTTP_METHODS:
                    handlers.add(node)
                    route = deco.args[0].value if deco.args and isinstance(deco.args[0], ast.Constant) else ""
                    out.append(("route", node.name, node.lineno, f"{deco.func.attr.upper()} {route}"))
            if isinstance(node, ast.AsyncFunctionDef):
                for call in ast.walk(node):
                    if isinstance(call, ast.Call) and dotted(call.func).startswith(BLOCKING):
                        out.append(("blocking-in-async", dotted(call.func), call.lineno, node.name))
            _function_flaws(node, out)
        elif isinstance(node, ast.ClassDef):
            out.append(("class", node.name, node.lineno, ",".join(dotted(b) for b in node.bases)))
        elif isinstance(node, ast.Call):
            name = dotted(node.func)
            if name:
                out.append(("call", name.rpartition(".")[2], node.lineno, name.rpartition(".")[0]))
            if name in ("os.getenv", "os.environ.get") and node.args and isinstance(node.args[0], ast.Constant):
                out.append(("env", str(node.args[0].value), node.lineno, name))
            if name in ("eval", "exec", "os.system", "os.popen", "pickle.loads") or name.startswith("subprocess.") and any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in node.keywords):
                out.append(("dangerous-call", name, node.lineno, ""))
            if name.endswith("execute") and node.args and _built(node.args[0]):
                out.append(("sql-construction", name, node.lineno, ""))
        elif isinstance(node, ast.Subscript) and dotted(node.value) == "os.environ" and isinstance(node.slice, ast.Constant):
            out.append(("env", str(node.slice.value), node.lineno, "os.environ[]"))
        elif isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load):
            out.append(("load", node.id, node.lineno, ""))
        elif isinstance(node, ast.ExceptHandler):
            if node.type is None:
                out.append(("bare-except", "", node.lineno, ""))
            if all(isinstance(s, (ast.Pass, ast.Continue, ast.Break)) or isinstance(s, ast.Return) and s.value is None for s in node.body):
                out.append(("swallowed-except", dotted(node.type) if node.type else "", node.lineno, ""))
        elif isinstance(node, ast.For):
            _loop_indexes(node, out)
    for s in tree.body:
        for t in s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AnnAssign) else []:
            if isinstance(t, ast.Name):
                out.append(("variable", t.id, s.lineno, ""))
    out += [("summary", name, 0, json.dumps(s)) for name, s in summaries(tree).items()]
    if re.search(r"(?:^|\n)\s*(?:async\s+)?def test_", text):
        out += [("test", n.name, n.lineno, "") for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name.startswith("test_")]
    out += taint(tree, handlers)
    return out


def _loop_indexes(node: ast.For, out: list) -> None:
    """Subscripts by the loop's variable of something whose length the range does not ask for."""
    if not (isinstance(node.target, ast.Name) and isinstance(node.iter, ast.Call) and dotted(node.iter.func) == "range"):
        return
    bounded = {dotted(c.args[0]) for a in node.iter.args for c in ast.walk(a) if isinstance(c, ast.Call) and dotted(c.func) == "len" and c.args}
    for n in ast.walk(ast.Module(body=node.body, type_ignores=[])):
        if isinstance(n, ast.Subscript) and any(isinstance(x, ast.Name) and x.id == node.target.id for x in ast.walk(n.slice)) and (name := dotted(n.value)) and name not in bounded:
            out.append(("unchecked-index", name, n.lineno, node.target.id))


def _built(node: ast.AST) -> bool:
    return isinstance(node, ast.JoinedStr) and any(isinstance(v, ast.FormattedValue) for v in node.values) or isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Mod))


def _function_flaws(node: ast.AST, out: list) -> None:
    """Locals that are written and never read, and statements after one that leaves the block."""
    stored: dict[str, int] = {}
    read: set[str] = set()
    for n in ast.walk(node):
        if isinstance(n, ast.Name):
            if isinstance(n.ctx, ast.Store):
                stored.setdefault(n.id, n.lineno)
            else:
                read.add(n.id)
        elif isinstance(n, (ast.Global, ast.Nonlocal)):
            read.update(n.names)
        for field in ("body", "orelse", "finalbody"):
            block = getattr(n, field, None)
            if isinstance(block, list):
                for a, b in zip(block, block[1:]):
                    if isinstance(a, (ast.Return, ast.Raise, ast.Continue, ast.Break)):
                        out.append(("unreachable", node.name, b.lineno, ""))
                        break
    out.extend(("unused-local", k, line, node.name) for k, line in stored.items() if k not in read and not k.startswith("_"))


def _summary(fn: ast.AST, known: dict[str, dict]) -> dict:
    """Kinds of sink that each parameter reaches, through functions known so far too, and the parameters that are returned."""
    names = [a.arg for a in [*fn.args.posonlyargs, *fn.args.args]]
    held: dict[str, set[int]] = {n: {i} for i, n in enumerate(names)}  # locals by the parameters in them

    def parameters(node: ast.AST) -> set[int]:
        return set().union(*(held.get(n.id, ()) for n in ast.walk(node) if isinstance(n, ast.Name)))

    for n in ast.walk(fn):
        if isinstance(n, ast.Assign) and not (isinstance(n.value, ast.Call) and dotted(n.value.func) in SANITIZERS) and (found := parameters(n.value)):
            for t in n.targets:
                if isinstance(t, ast.Name):
                    held[t.id] = held.get(t.id, set()) | found
    sinks: dict[int, set[str]] = {}
    returned: set[int] = set()
    for n in ast.walk(fn):
        if isinstance(n, ast.Call):
            name = dotted(n.func)
            kind = _sink(name)
            if kind and not _parameterized(kind, n):
                for i in parameters(ast.Tuple(elts=[*n.args, *[k.value for k in n.keywords]], ctx=ast.Load())):
                    sinks.setdefault(i, set()).add(kind)
            for at, kinds in known.get(name, {}).get("sinks", {}).items():
                if at < len(n.args):
                    for i in parameters(n.args[at]):
                        sinks.setdefault(i, set()).update(kinds)
        elif isinstance(n, ast.Return) and n.value is not None and not (isinstance(n.value, ast.Call) and dotted(n.value.func) in SANITIZERS):
            returned |= parameters(n.value)
    return {"sinks": {i: sorted(k) for i, k in sorted(sinks.items())}, "returns": sorted(returned)}


def summaries(tree: ast.AST, outside: dict[str, dict] | None = None) -> dict[str, dict]:
    """name -> summary of the functions of a file, the last first, so what a function calls further down is known; of a
    name the first definition counts, and a file's own before those from ``outside``."""
    known = dict(outside or {})
    for f in reversed([n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]):
        known[f.name] = _summary(f, known)
    return known


def _parameterized(kind: str, call: ast.Call) -> bool:
    return kind == "sql" and (len(call.args) >= 2 or any(k.arg in ("params", "parameters") for k in call.keywords))


def _sink(name: str) -> str:
    if name in BARE_SINKS:
        return BARE_SINKS[name]
    return next((k for s, k in _SINK_OF.items() if name == s or name.endswith("." + s)), "")


def route_handlers(tree: ast.AST) -> set:
    return {n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and any(isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in HTTP_METHODS for d in n.decorator_list)}


def taint(tree: ast.AST, handlers: set, outside: dict[str, dict] | None = None) -> list[tuple[str, str, int, str]]:
    """("taint", kind of sink, line, chain of names) for what a source reaches without a sanitizer, through calls of
    functions that are summarised too; what such a function does not return is not tainted by its arguments."""
    out: list[tuple[str, str, int, str]] = []
    functions = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    known = summaries(tree, outside)

    def dirty(node: ast.AST, env: dict[str, str]) -> str:
        """Chain by which the expression is tainted, '' if it is clean."""
        if isinstance(node, ast.Name):
            return env.get(node.id, node.id if node.id in SOURCES else "")
        if isinstance(node, ast.Attribute):
            name = dotted(node)
            return name if name in SOURCES else dirty(node.value, env)
        if isinstance(node, ast.Call):
            name = dotted(node.func)
            if name in SANITIZERS:
                return ""
            if name in known:
                return next((f"{c} > {name}()" for i in known[name]["returns"] if i < len(node.args) and (c := dirty(node.args[i], env))), "")
            return next((c for a in [*node.args, *[k.value for k in node.keywords]] if (c := dirty(a, env))), "") or dirty(node.func, env)
        return next((c for n in ast.iter_child_nodes(node) if (c := dirty(n, env))), "")

    def visit(body: list, env: dict[str, str]) -> None:
        for s in body:
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            for field in ("test", "iter", "value"):
                if isinstance(part := getattr(s, field, None), ast.AST):
                    calls(part, env)
            if isinstance(s, ast.Assign):
                chain = dirty(s.value, env)
                for t in s.targets:
                    for n in ast.walk(t):
                        if isinstance(n, ast.Name):
                            if chain:
                                env[n.id] = f"{chain} > {n.id}"
                            else:
                                env.pop(n.id, None)
            if isinstance(s, ast.AugAssign) and isinstance(s.target, ast.Name) and (chain := dirty(s.value, env)):
                env[s.target.id] = f"{chain} > {s.target.id}"
            if isinstance(s, (ast.For, ast.AsyncFor)) and (chain := dirty(s.iter, env)):
                for n in ast.walk(s.target):
                    if isinstance(n, ast.Name):
                        env[n.id] = f"{chain} > {n.id}"
            for field in ("body", "orelse", "finalbody"):
                visit(getattr(s, field, []) or [], env)
            for h in getattr(s, "handlers", []):
                visit(h.body, env)

    def calls(node: ast.AST, env: dict[str, str]) -> None:
        for call in ast.walk(node):
            if not isinstance(call, ast.Call):
                continue
            name = dotted(call.func)
            kind = _sink(name)
            if kind and not _parameterized(kind, call):
                if chain := next((c for a in [*call.args, *[k.value for k in call.keywords]] if (c := dirty(a, env))), ""):
                    out.append(("taint", kind, call.lineno, f"{chain} > {name}"))
            for i, kinds in known.get(name, {}).get("sinks", {}).items():
                if i < len(call.args) and (chain := dirty(call.args[i], env)):
                    out.extend(("taint", k, call.lineno, f"{chain} > {name}()") for k in sorted(kinds))
            if re.search(r"(?:^|\.)(?:log|logger|logging)\.\w+$", name) and any(isinstance(n, ast.Name) and n.id in SENSITIVE for a in call.args for n in ast.walk(a)):
                out.append(("taint", "log", call.lineno, name))

    for f in functions:
        arguments = [a.arg for a in [*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs]]
        visit(f.body, {a: a for a in arguments if f in handlers or a in SOURCE_PARAMETERS})
    visit([s for s in getattr(tree, "body", [])], {})
    return out


def facts(files: DataFrame) -> DataFrame:
    """entry_id, path, fact, name, line, detail of the Python files among (entry_id, path, content)."""

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for e, p, t in zip(b["entry_id"], b["path"], b["content"]):
                try:
                    rows += [(e, p, *x) for x in facts_of(t)]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FACTS.split(", ")])

    python = files.where(F.col("path").endswith(".py") & F.col("content").isNotNull() & (F.length("content") <= MAX_CHARS))
    return spread(python.select("entry_id", "path", "content")).mapInPandas(fn, FACTS)


def cross_file_taint(files: DataFrame, found: DataFrame) -> DataFrame:
    """Facts with taint through functions of other files of the snapshot: the first definition of a name, by path, counts.

    Only files that call a function which another file of their snapshot summarises are parsed again; their flows are then
    those of the second pass, which knows what such a function returns.
    """
    made = found.where("fact = 'summary'").groupBy("entry_id", "name").agg(F.min_by(F.struct("path", "detail"), "path").alias("s")).select("entry_id", "name", F.col("s.path").alias("def_path"), F.col("s.detail").alias("detail"))
    calls = found.where("fact = 'call'").select("entry_id", "path", "name").distinct()
    needed = calls.join(made, ["entry_id", "name"]).where("path <> def_path").groupBy("entry_id", "path").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", "detail")))).alias("outside"))

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for e, p, t, o in zip(b["entry_id"], b["path"], b["content"], b["outside"]):
                outside = {n: {"sinks": {int(i): k for i, k in s["sinks"].items()}, "returns": s["returns"]} for n, s in ((n, json.loads(d)) for n, d in json.loads(o).items())}
                try:
                    tree = ast.parse(t)
                    rows += [(e, p, *x) for x in taint(tree, route_handlers(tree), outside)]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FACTS.split(", ")])

    again = files.join(needed, ["entry_id", "path"]).select("entry_id", "path", "content", "outside").mapInPandas(fn, FACTS)
    kept = found.where("fact = 'taint'").join(needed.select("entry_id", "path"), ["entry_id", "path"], "left_anti").select(*found.columns)
    return found.where("fact <> 'taint'").unionByName(kept).unionByName(again.distinct())


def imported_names(text: Column) -> Column:
    """Names that an import line of Python, JavaScript or TypeScript binds; none for other lines."""
    part = lambda rx: F.nullif(F.regexp_extract(text, rx, 1), F.lit(""))
    python = F.coalesce(part(r"^\s*from\s+\S+\s+import\s+\(?([\w ,.]+)\)?\s*(?:#.*)?$"), part(r"^\s*import\s+([\w ,.]+?)\s*(?:#.*)?$"))
    script = F.coalesce(part(r"^\s*import\s+(?:type\s+)?([^'\"]+?)\s+from\s+['\"]"), part(r"^\s*(?:const|let|var)\s+(\{[^}]*\}|\w+)\s*=\s*require\("))
    names = lambda clause, rename: F.transform(F.split(clause, ","), lambda p: F.regexp_extract(F.trim(F.regexp_replace(p, rename, "")), r"^([A-Za-z_$][\w$]*)", 1))
    found = F.when(script.isNotNull(), names(F.translate(script, "{}", "  "), r"^.*(?:\bas\s|:)")).when(python.isNotNull(), names(python, r"^.* as "))
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda n: n != "")


def unused_imports(found: DataFrame) -> DataFrame:
    """Imports whose name is loaded nowhere in the snapshot."""
    used = found.where("fact in ('load', 'call')").select("entry_id", "name").distinct()
    return found.where("fact = 'import' and name <> '*'").join(used, ["entry_id", "name"], "left_anti").select("entry_id", "path", "name", "line")


def contradictions(findings: DataFrame, found: DataFrame) -> DataFrame:
    """(entry_id, ord) of findings that name identifiers of which the snapshot defines or uses none.

    Snapshots without any fact contradict nothing.  Identifiers have three characters or more and are no stop words.
    """
    named = findings.select("entry_id", "ord", F.explode(F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "title", "description"), F.lit(r"[A-Za-z_][\p{L}\p{N}_]{2,}"), F.lit(0)))).alias("name")).where(~F.col("name").isin(*STOP_WORDS))
    known = found.where("name <> ''").select("entry_id", "name").distinct()
    indexed = known.select("entry_id").distinct()
    met = named.join(known.withColumn("known", F.lit(1)), ["entry_id", "name"], "left").groupBy("entry_id", "ord").agg(F.count("known").alias("n"))
    return met.where("n = 0").join(indexed, "entry_id", "left_semi").select("entry_id", "ord")


def unreferenced(names: DataFrame, lines: DataFrame) -> DataFrame:
    """(entry_id, path, line, name) whose name no other line of the snapshot has as a whole word.

    All lines are cut to words once, instead of searching every name in every file.
    """
    words = lines.select("entry_id", F.col("path").alias("at_path"), F.col("line").alias("at_line"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("name"))
    met = names.join(words, ["entry_id", "name"]).where("path <> at_path or line <> at_line").select("entry_id", "path", "line", "name").distinct()
    return names.join(met, ["entry_id", "path", "line", "name"], "left_anti")


def signature_changes(lines: DataFrame) -> DataFrame:
    """Functions of which a diff removes a definition and adds one with other parameters, per file (lines with path)."""
    rx = r"^\s*(?:async\s+)?def\s+(\w+)\s*\((.*)$"
    d = lines.where("kind <> 'context'").select("entry_id", "path", "kind", "new_line", F.regexp_extract("text", rx, 1).alias("name"), F.regexp_extract("text", rx, 2).alias("rest")).where("name <> ''")
    old = d.where("kind = 'removed'").select("entry_id", "path", "name", F.col("rest").alias("old_rest"))
    new = d.where("kind = 'added'").select("entry_id", "path", "name", F.col("rest").alias("new_rest"), F.col("new_line").alias("line"))
    return old.join(new, ["entry_id", "path", "name"]).where("old_rest <> new_rest").select("entry_id", "path", "name", "line").distinct()


def callers(found: DataFrame) -> DataFrame:
    """Call sites of the functions that a snapshot defines, without the definitions' own lines."""
    defs = found.where("fact in ('function', 'async')").select("entry_id", "name", F.col("path").alias("def_path"), F.col("line").alias("def_line"))
    calls = found.where("fact = 'call'").select("entry_id", "name", "path", "line").distinct()
    return calls.join(defs, ["entry_id", "name"]).where("path <> def_path or line <> def_line").select("entry_id", "name", "path", "line").distinct()


def enclosing(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Innermost function of each (entry_id, path, line)."""
    spans = found.where("fact = 'span'").select("entry_id", "path", F.col("name").alias("function"), F.col("line").alias("first"), F.col("detail").cast("int").alias("last"))
    met = lines.join(spans, ["entry_id", "path"]).where("line between first and last")
    return met.groupBy("entry_id", "path", "line").agg(F.max_by("function", "first").alias("function"))


def chunk(path: str, text: str, language: str, most: int = 1500, overlap: int = 200) -> list[tuple[str, str, int, int, str]]:
    """(symbol, kind, first line, last line, text): one chunk per symbol, windows of lines where there is none or it is too long."""
    rows = text.split("\n")
    starts: list[tuple[int, str, str]] = []
    for i, row in enumerate(rows):
        for kind, rx in SYMBOLS.get(language, []):
            if m := re.match(rx, row):
                starts.append((i, m.group(1), kind))
                break
    spans: list[tuple[str, str, int, int]] = []
    for i, name, kind in starts:
        if language in ("python", "ruby"):
            indent = len(rows[i]) - len(rows[i].lstrip())
            end = next((j for j in range(i + 1, len(rows)) if rows[j].strip() and len(rows[j]) - len(rows[j].lstrip()) <= indent), len(rows)) - 1
        else:
            depth, opened, end = 0, False, min(len(rows) - 1, i + 40)
            for j in range(i, len(rows)):
                depth += rows[j].count("{") - rows[j].count("}")
                opened = opened or "{" in rows[j]
                if opened and depth <= 0:
                    end = j
                    break
        spans.append((name, kind, i, end))
    if not spans:
        spans = [(path, "file", 0, len(rows) - 1)]
    out, seen = [], set()
    for name, kind, a, b in spans:
        i = a
        while i <= b:
            j, size = i, 0
            while j <= b and (size == 0 or size + len(rows[j]) + 1 <= most):
                size += len(rows[j]) + 1
                j += 1
            if (i, j) not in seen and any(r.strip() for r in rows[i:j]):
                seen.add((i, j))
                out.append((name, kind, i + 1, j, "\n".join(rows[i:j])))
            if j > b:
                break
            i = max(i + 1, j - overlap // 20)
    return out


def chunks(files: DataFrame) -> DataFrame:
    """Chunks of (entry_id, path, content) in every language the catalogue of symbols knows; others in line windows."""
    schema = "entry_id string, path string, symbol string, kind string, first_line int, last_line int, text string"

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(e, p, *c) for e, p, t, lang in zip(b["entry_id"], b["path"], b["content"], b["language"]) for c in chunk(p, t, lang)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return spread(files.where("content is not null").select("entry_id", "path", "content", C.extension_language(F.col("path")).alias("language"))).mapInPandas(fn, schema)


def flaws(found: DataFrame, lines: DataFrame) -> DataFrame:
    """(entry_id, path, line, category, rule_id) of the flaws of facts, and of the signatures that numbered diff lines change."""
    named = found.select("entry_id", "path", "line", F.col("fact").alias("rule_id"))
    named = named.unionByName(unused_imports(found).select("entry_id", "path", "line", F.lit("unused-import").alias("rule_id")))
    named = named.unionByName(signature_changes(lines).select("entry_id", "path", "line", F.lit("signature-change").alias("rule_id")))
    categories = F.create_map(*[x for k, v in FLAW_CATEGORIES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return named.where(F.col("rule_id").isin(*FLAW_CATEGORIES)).select("entry_id", "path", "line", F.explode(categories[F.col("rule_id")]).alias("category"), "rule_id").distinct()


def line_text(places: DataFrame, lines: DataFrame, files: DataFrame) -> DataFrame:
    """The places (entry_id, path, line) with their text: the first diff line of that new number, else the snapshot's line."""
    shown = lines.where("new_line is not null").groupBy("entry_id", "path", F.col("new_line").alias("line")).agg(F.min_by("text", "pos").alias("shown"))
    held = files.join(places.select("entry_id", "path", "line").distinct(), ["entry_id", "path"]).select("entry_id", "path", "line", F.get(F.split("content", r"\r\n|\n|\r", -1), F.col("line") - 1).alias("held"))
    return places.join(shown, ["entry_id", "path", "line"], "left").join(held, ["entry_id", "path", "line"], "left").withColumn("text", F.coalesce("shown", "held")).drop("shown", "held")


def dead_code(lines: DataFrame, found: DataFrame) -> DataFrame:
    """entry_id, path, line, rule_id, name, confidence: imports added and named nowhere else, locals of touched functions
    that are never read, and statements on changed lines that nothing reaches.

    An import counts as used if any other shown line of the diff, or any reference of the snapshot in any file, names it.
    """
    added = lines.where("kind = 'added'")
    imports = added.select("entry_id", "path", F.col("new_line").alias("line"), F.explode(imported_names(F.col("text"))).alias("name"))
    words = lines.where("kind <> 'removed'").select("entry_id", F.col("path").alias("at_path"), F.col("new_line").alias("at_line"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0)))).alias("name"))
    shown = imports.join(words, ["entry_id", "name"]).where("path <> at_path or line <> at_line").select("entry_id", "path", "line", "name").distinct()
    held = found.where("fact in ('load', 'call')").select("entry_id", "name").distinct()
    unused = imports.join(shown, ["entry_id", "path", "line", "name"], "left_anti").join(held, ["entry_id", "name"], "left_anti")
    touched = added.select("entry_id", "path", "new_line").distinct()
    spans = found.where("fact = 'span'").select("entry_id", "path", F.col("name").alias("function"), F.col("line").alias("first"), F.col("detail").cast("int").alias("last"))
    functions = spans.join(touched, ["entry_id", "path"]).where("new_line between first and last").select("entry_id", "path", "function", "first", "last").distinct()
    local = found.where("fact = 'unused-local'").withColumnRenamed("detail", "function").join(functions, ["entry_id", "path", "function"]).where("line between first and last")
    gone = found.where("fact = 'unreachable'").join(touched.withColumnRenamed("new_line", "line"), ["entry_id", "path", "line"])
    row = lambda df, rule, sure: df.select("entry_id", "path", "line", F.lit(rule).alias("rule_id"), "name", F.lit(sure).alias("confidence"))
    return row(unused, "unused-import", 0.8).unionByName(row(local, "unused-local", 0.85)).unionByName(row(gone, "unreachable", 0.85)).distinct()


def verify(findings: DataFrame, lines: DataFrame, file_rows: DataFrame, snapshot: DataFrame, evidence: DataFrame, key: str = "entry_id", found: DataFrame | None = None) -> DataFrame:
    """Evidence status of findings (key, ord, file_path, start_line, title, description, category).

    ``lines`` are numbered diff lines with path, ``file_rows`` diff files, ``snapshot`` (key, path), ``evidence``
    (key, path, line, category, rule_id) the deterministic hits, ``found`` the facts of the snapshot (with key entry_id):
    flaws of a finding's category and taint on its line confirm it too, and what names nothing of the snapshot and has
    no hit and no overlap is rejected.  The first condition that holds decides.
    """
    tainted, contradicted = None, None
    if found is not None:
        evidence = evidence.select(key, "path", "line", "category", "rule_id").unionByName(flaws(found, lines))
        tainted = found.where("fact = 'taint'").groupBy(key, "path", "line").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("taint-"), "name"))), ",").alias("flows"))
        contradicted = contradictions(findings, found).withColumn("contradicted", F.lit(True))
    f = findings.select(key, "ord", F.col("file_path").alias("path"), F.col("start_line").alias("line"), "category", C.identifier_tokens(F.concat_ws(" ", "title", "description")).alias("tokens"))
    touched = file_rows.select(key, "path").distinct().withColumn("in_diff", F.lit(True))
    known = snapshot.select(key, "path").distinct().withColumn("in_snapshot", F.lit(True))
    changed = lines.where("kind = 'added'").groupBy(key, "path", F.col("new_line").alias("line")).agg(F.min_by("text", "pos").alias("text"))
    hit = evidence.groupBy(key, "path", "line", "category").agg(F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"))
    j = f.join(touched, [key, "path"], "left").join(known, [key, "path"], "left").join(changed, [key, "path", "line"], "left").join(hit, [key, "path", "line", "category"], "left")
    if found is not None:
        j = j.join(tainted, [key, "path", "line"], "left").join(contradicted, [key, "ord"], "left").withColumn("rules", F.when(F.col("rules").isNotNull() | F.col("flows").isNotNull(), F.concat_ws(",", "rules", "flows")))
    else:
        j = j.withColumn("contradicted", F.lit(None).cast("boolean"))
    shared = C.overlap(F.col("tokens"), C.identifier_tokens(F.col("text"))) >= 1
    method = (
        F.when(F.col("in_diff").isNull() & F.col("in_snapshot").isNotNull(), "file-exists-outside-diff").when(F.col("in_diff").isNull(), "file-not-in-diff").when(F.col("line").isNull(), "no-line-reference")
        .when(F.col("text").isNull(), "line-outside-hunks").when(F.col("rules").isNotNull(), "deterministic-rule-match").when(shared, "changed-line-and-identifier-overlap").when(F.col("contradicted"), "contradicts-repository").otherwise("line-inside-changed-hunk")
    )
    status = C.lookup(method, {"file-exists-outside-diff": "insufficient_evidence", "file-not-in-diff": "rejected", "no-line-reference": "insufficient_evidence", "line-outside-hunks": "rejected", "contradicts-repository": "rejected", "deterministic-rule-match": "confirmed"}, "strongly_supported")
    return j.select(key, "ord", "path", "line", method.alias("method"), status.alias("evidence_status"), "rules")


def bounded_snapshot(files: DataFrame, budget: int = 2_000_000, most: int = 4000, key: str = "entry_id") -> DataFrame:
    """Files in path order: none over MAX_CHARS, at most ``most``, cut before the budget of characters is passed."""
    w = Window.partitionBy(key).orderBy("path")
    rows = files.where(F.length("content") <= MAX_CHARS).withColumn("n", F.row_number().over(w)).withColumn("used", F.sum(F.length("content")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("n") <= most) & (F.col("used") <= budget)).drop("n")
