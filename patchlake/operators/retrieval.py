"""Text retrieval: term statistics, hashed TF-IDF vectors, cosine top-k, budgets, sections, knowledge search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from patchlake.functions import columns as C
from patchlake.session import checkpoint

DIMENSION = 1024
TOP_K = 6


def terms(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, token, tf."""
    return documents.select(key, F.explode(C.word_tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("token").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def weighted(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, idx, weight: signed feature hashing of tf * idf, divided by the norm of the weights before they collide."""
    tf = terms(documents, key, text)
    n = documents.count()  # one number, from the files' footers
    df = document_frequency(tf).select("token", idf(F.lit(n), F.col("df")).alias("idf"), C.hashed_index(F.col("token"), DIMENSION).alias("idx"), C.hashed_sign(F.col("token")).alias("sign"))  # once per token
    w = tf.join(df, "token").withColumn("w", F.col("tf") * F.col("idf"))
    v = w.select(key, "idx", (F.col("w") * F.col("sign")).alias("w"), (F.col("w") * F.col("w")).alias("_sq"))
    v = v.repartition(key).groupBy(key, "idx").agg(F.sum("w").alias("w"), F.sum("_sq").alias("_sq"))  # one shuffle by document for both sums
    return v.select(key, "idx", (F.col("w") / F.sqrt(F.sum("_sq").over(Window.partitionBy(key)))).alias("weight"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, block: int = 1000) -> DataFrame:
    """query_id, vec_id, score, rank: a stated set of queries against every vector, in blocks.

    Vectors and queries come in blocks of at most ``block`` rows (vec_id is unique, and a query's id is one of the stated
    part of them); a block of vectors meets a block of queries in one matrix product, which keeps k per query, and ties, so
    a query shuffles k rows per block of vectors.
    """
    packed = lambda df, at, name: df.where("embedding is not null").groupBy(at.alias(name)).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias(name + "_rows"))
    some = packed(vectors.select("vec_id", "embedding"), F.floor(F.col("vec_id") / block), "chunk").select(F.col("chunk_rows.vec_id").alias("ids"), F.col("chunk_rows.embedding").alias("vs"))
    asked = packed(queries.select("vec_id", "embedding"), F.floor(F.col("vec_id") / (50 * block)), "ask").select(F.col("ask_rows.vec_id").alias("qids"), F.col("ask_rows.embedding").alias("qs"))

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, vs, qids, qs in zip(b["ids"], b["vs"], b["qids"], b["qs"]):
                v, q, ids = np.array([*vs], np.float64), np.array([*qs], np.float64), np.asarray(ids)
                norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
                scores = np.divide(q @ v.T, norms, out=np.zeros_like(norms), where=norms > 0)
                scores[np.asarray(qids)[:, None] == ids[None, :]] = -np.inf
                least = np.partition(scores, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))] - 2e-4  # those that rounding may bring up too
                at = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
                yield pd.DataFrame({"query_id": np.asarray(qids)[at[0]], "vec_id": ids[at[1]], "score": scores[at]})

    met = some.join(F.broadcast(asked) if queries.limit(block + 1).count() <= block else asked)  # stated queries against all rows
    found = met.mapInPandas(fn, "query_id bigint, vec_id bigint, score double").withColumn("score", F.round("score", 4))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")


def bin_of(column: str, width: int = 1000) -> Column:
    """A coarse bin of an integer column, in its order."""
    return F.floor(F.col(column) / width)


def prefix_budget(rows: DataFrame, by: str, order: list[str], size: Column, budget: int, overshoot: bool = False, bin: Column | None = None) -> DataFrame:
    """Rows in order up to the budget: all that fit in it together, or all that begin before it is used up.

    With ``bin``, a function of the order that never falls, sums of the bins come first: a bin that begins beyond the
    budget is dropped before any row is sorted, and a hot group is spread over its bins.
    """
    if bin is None:
        w = Window.partitionBy(by).orderBy(*order)
        used = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1 if overshoot else 0))
        return rows.withColumn("used", F.coalesce(used, F.lit(0))).where(F.col("used") < budget if overshoot else F.col("used") <= budget)
    sized = rows.withColumn("_bin", bin).withColumn("_size", size)
    sums = sized.groupBy(F.col(by).alias("_by"), F.col("_bin").alias("_b")).agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy("_by").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    begun = sums.withColumn("_begun", F.coalesce(F.sum("_sum").over(before), F.lit(0))).where(F.col("_begun") <= budget).drop("_sum")
    near = sized.join(begun, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_bin") == F.col("_b")))
    within = Window.partitionBy(by, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if overshoot else 0)
    used = near.withColumn("used", F.col("_begun") + F.coalesce(F.sum("_size").over(within), F.lit(0)))
    return used.where(F.col("used") < budget if overshoot else F.col("used") <= budget).select(*rows.columns, "used")


def snapshot(files: DataFrame, changed: DataFrame, budget: int, most: int = 60, key: str = "entry_id") -> DataFrame:
    """key, path, place, used: files of a snapshot as they are fetched, changed ones first in their order, then by path.

    ``files`` are (key, path, content), ``changed`` (key, ord, path).  Blank files are skipped, at most ``most`` taken, and
    the last one taken is that which begins before the budget of characters is used up.
    """
    first = changed.groupBy(key, "path").agg(F.min("ord").alias("_ord"))
    rows = files.where(F.trim(F.coalesce("content", F.lit(""))) != "").select(key, "path", F.length("content").alias("_size")).join(first, [key, "path"], "left")
    w = Window.partitionBy(key).orderBy(F.col("_ord").asc_nulls_last(), "path")
    rows = rows.withColumn("place", F.row_number().over(w)).withColumn("used", F.coalesce(F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.where((F.col("place") <= most) & (F.col("used") < budget)).select(key, "path", "place", "used")


#: how texts become vectors: (rows, key, text) -> key, idx, weight
Embedder = Callable[[DataFrame, str, str], DataFrame]


def hashed_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, idx, weight: signed hashed term counts of unit length; needs no corpus, so new texts can be embedded alone."""
    tf = terms(rows, key, text)
    v = tf.select(key, C.hashed_index(F.col("token"), DIMENSION).alias("idx"), (F.col("tf") * C.hashed_sign(F.col("token"))).alias("w")).repartition(key).groupBy(key, "idx").agg(F.sum("w").alias("w"))
    return v.where("w <> 0").select(key, "idx", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))).alias("weight"))


EMBEDDERS: dict[str, Embedder] = {"hashed-counts": hashed_counts, "tf-idf": weighted}


def index(chunks: DataFrame, embedder: str = "hashed-counts", scope: str = "entry_id") -> DataFrame:
    """scope, path, first_line, chunk, idx, weight: the chunks of (scope, path, first_line, text) embedded.  Spark feeds the
    embedder in Arrow or row batches of its own, so there is no batch size here."""
    named = chunks.withColumn("chunk", F.sha2(F.concat_ws("\0", scope, "path", F.col("first_line").cast("string"), "text"), 256)).dropDuplicates(["chunk"])
    vectors = EMBEDDERS[embedder](named.select("chunk", "text"), "chunk", "text")
    return vectors.join(named.select("chunk", scope, "path", "first_line"), "chunk").select(scope, "path", "first_line", "chunk", "idx", "weight")


def retrieve(indexed: DataFrame, questions: DataFrame, k: int = TOP_K, embedder: str = "hashed-counts", scope: str = "entry_id") -> DataFrame:
    """scope, rank, path, first_line, score: the ``k`` chunks of each question's own scope (scope, text) with the highest
    cosine; only chunks that share a feature with the question are met."""
    asked = EMBEDDERS[embedder](questions.select(scope, "text"), scope, "text").select(scope, "idx", F.col("weight").alias("_q"))
    met = indexed.join(asked, [scope, "idx"]).groupBy(scope, "chunk").agg(F.first("path").alias("path"), F.first("first_line").alias("first_line"), F.round(F.sum(F.col("weight") * F.col("_q")), 6).alias("score"))
    best = Window.partitionBy(scope).orderBy(F.desc("score"), "path", "first_line", "chunk")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(scope, "rank", "path", "first_line", "score")


def removed(store: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries that stay, entries that go) when those with the content ids ``ids`` are removed."""
    return store.join(ids.select("content_id"), "content_id", "left_anti"), store.join(ids.select("content_id").distinct(), "content_id", "left_semi")


def dismissal(findings: DataFrame) -> DataFrame:
    """Findings as entries that dismiss their like: review_id, ord, kind, title, content, repository, category, source_file, content_id."""
    title, content = F.concat(F.lit("Dismissed: "), F.col("title")), F.concat_ws("\n", "description", F.concat(F.lit("File: "), "file_path"))
    return findings.select("review_id", "ord", F.lit("dismissed").alias("kind"), title.alias("title"), content.alias("content"), "repository", "category", F.col("file_path").alias("source_file"), C.content_id(F.lit("dismissed"), title, content, F.col("repository"), F.col("category")).alias("content_id"))


def sections(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, section, title, content: one row per markdown heading with text under it; what precedes the first is dropped."""
    rows = documents.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, r"\r\n|\n|\r", -1)).alias("pos", "line"))
    heading = F.col("line").rlike(r"^#{1,6} +\S")
    rows = rows.withColumn("section", F.sum(heading.cast("int")).over(Window.partitionBy(key).orderBy("pos"))).where("section > 0").withColumn("_h", heading)
    s = rows.groupBy(key, "section").agg(F.max(F.when(F.col("_h"), F.regexp_replace("line", r"^#{1,6} +|\s+$", ""))).alias("title"), F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")).alias("content"))
    return s.where("content <> ''")


def search(entries: DataFrame, queries: DataFrame, k: int = 4, block: int = 16_384) -> DataFrame:
    """query_id, doc_id, score, rank by shared tokens, two more where the category is the query's; nothing without overlap.

    Entries without a repository, or of the query's, take part; doc_id and query_id are unique.  Some ``block`` entries by
    hash meet as many queries, where shared tokens are counted over columns of entries, and a query keeps its ``k`` best of
    the block: a word that most texts hold makes no row for each pair of them.
    """
    words = lambda c: F.array_join(F.array_distinct(C.word_tokens(c)), " ").alias("words")
    scope = [F.coalesce("repository", F.lit("")).alias("repository"), F.coalesce("category", F.lit("")).alias("category")]
    e = entries.select("doc_id", *scope, words(F.concat_ws(" ", "title", "content")))
    q = queries.select("query_id", *scope, words(F.col("query")))

    def fn(es: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        return _best_shared(es, qs, k)

    met = _in_blocks(e, q, ["doc_id"], ["query_id"], _blocks(entries, block), _blocks(queries, block), fn, "query_id bigint, doc_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def _blocks(df: DataFrame, block: int) -> int:
    return max(1, -(-df.count() // block))


def _in_blocks(a: DataFrame, b: DataFrame, a_id: list[str], b_id: list[str], a_blocks: int, b_blocks: int, fn: Callable, schema: str) -> DataFrame:
    """``fn`` of every block of ``a`` with every block of ``b``; blocks are by hash of the ids."""
    mine = lambda c, n, name: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int").alias(name)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    a = a.select("*", mine(a_id, a_blocks, "_a")).select("*", every(b_blocks, "_b"))
    b = b.select("*", mine(b_id, b_blocks, "_b")).select("*", every(a_blocks, "_a"))
    return a.groupBy("_a", "_b").cogroup(b.groupBy("_a", "_b")).applyInPandas(fn, schema)


def _holders(words: pd.Series, vocabulary: dict[str, int]) -> tuple[list[np.ndarray], dict[int, np.ndarray]]:
    """Rows that hold each word of the vocabulary, and a column of 0 and 1 for those that many rows hold."""
    n = len(words)
    held = [[i for t in x.split() if (i := vocabulary.get(t)) is not None] for x in words]
    rows, tokens = np.repeat(np.arange(n), [len(x) for x in held]), np.fromiter((i for x in held for i in x), np.int64)
    ends = np.cumsum(np.bincount(tokens, minlength=len(vocabulary)))
    holders = np.split(rows[np.argsort(tokens, kind="stable")], ends[:-1]) if vocabulary else []
    columns = {}
    for i, x in enumerate(holders):
        if len(x) > n // 64:
            columns[i] = np.zeros(n, np.uint8)
            columns[i][x] = 1
    return holders, columns


def _shared(of: list[int], n: int, spans: list[tuple[int, int]], holders: list[np.ndarray], columns: dict[int, np.ndarray]) -> np.ndarray:
    """How many of the words each row of the spans holds, in a type that takes two more."""
    shared = np.zeros(n, np.uint8 if len(of) <= 253 else np.int32)
    for i in of:
        if (column := columns.get(i)) is not None:
            for a, b in spans:
                shared[a:b] += column[a:b]
        else:
            shared[holders[i]] += 1
    return shared


def _spans(keys: list) -> dict:
    """From and to of each key in sorted keys."""
    starts = [i for i, x in enumerate(keys) if not i or x != keys[i - 1]]
    return {keys[a]: (a, b) for a, b in zip(starts, [*starts[1:], len(keys)])}


def _best_shared(e: pd.DataFrame, q: pd.DataFrame, k: int) -> pd.DataFrame:
    """query_id, doc_id, score: the ``k`` best of these entries for each of these queries."""
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    if len(e) and len(q):
        vocabulary: dict[str, int] = {}
        asked = [[vocabulary.setdefault(t, len(vocabulary)) for t in x.split()] for x in q["words"]]
        e = e.sort_values(["repository", "doc_id"])  # those of no repository first
        ids, n = e["doc_id"].to_numpy(), len(e)
        holders, columns = _holders(e["words"], vocabulary)
        alike = {c: np.flatnonzero(x) for c in set(q["category"]) if c and (x := (e["category"] == c).to_numpy()).any()}
        span = _spans(e["repository"].tolist())
        for query_id, own, category, of in zip(q["query_id"], q["repository"], q["category"], asked):
            spans = [span[x] for x in dict.fromkeys(("", own)) if x in span]
            if not of or not spans:
                continue
            shared = _shared(of, n, spans, holders, columns)
            if (same := alike.get(category)) is not None:
                x = shared[same]
                shared[same] = x + 2 * (x > 0)
            at = []
            for a, b in spans:
                score = shared[a:b]
                least = int(score.max())
                while least > 1 and np.count_nonzero(score >= least) < k:
                    least -= 1
                if least:
                    at += [a + np.flatnonzero(score > least), a + np.flatnonzero(score == least)[:k]]
            if at:
                at = np.concatenate(at)
                at = at[np.lexsort((ids[at], -shared[at].astype(np.int64)))[:k]]
                found.append((query_id, ids[at], shared[at]))
    if not found:
        return pd.DataFrame({"query_id": [], "doc_id": [], "score": []}, dtype="int64")
    by, docs, scores = zip(*found)
    return pd.DataFrame({"query_id": np.repeat(np.array(by, np.int64), [len(x) for x in docs]), "doc_id": np.concatenate(docs), "score": np.concatenate(scores).astype(np.int64)})


def knowledge(documents: DataFrame) -> DataFrame:
    """Documents as knowledge entries: title is the first line, the rest content, with the content id."""
    text = F.coalesce("text", F.lit(""))
    title, content = F.regexp_extract(text, r"^([^\r\n]*)", 1), F.coalesce("text", F.lit(""))
    e = documents.select("doc_id", "kind", title.alias("title"), content.alias("content"), "repository", F.coalesce("category", F.lit("")).alias("category"), F.coalesce("source", F.lit("")).alias("source"), "created_at")
    return e.withColumn("content_id", C.content_id(F.col("kind"), F.col("title"), F.col("content"), F.col("repository"), F.col("category")))


def add_new(store: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries whose content id is not yet in the store, each once (the first by doc_id)."""
    first = Window.partitionBy("content_id").orderBy("doc_id")
    return entries.join(store.select("content_id"), "content_id", "left_anti").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def not_dismissed(findings: DataFrame, dismissals: DataFrame, least: int = 3, block: int = 16_384, first: int = 64) -> DataFrame:
    """Findings that no dismissal of their repository (or of none) suppresses: same category or none, and same file or ``least`` shared identifiers.

    The ``first`` longest texts of each category that hold for all repositories (2,048 at most, of 8,192 characters at most)
    are broadcast and suppress what they can, each finding until one does. What is left is kept and meets all dismissals in
    blocks, where shared identifiers are counted over columns of dismissals: a common one makes no row for each pair.
    """
    f = findings.withColumn("_tokens", C.identifier_tokens(F.concat_ws(" ", "title", "description")))
    scope = [F.coalesce("repository", F.lit("")).alias("d_repository"), F.coalesce("category", F.lit("")).alias("d_category"), F.coalesce("source_file", F.lit("")).alias("source_file")]
    d = dismissals.select(*scope, C.identifier_tokens(F.concat_ws(" ", "title", "content")).alias("d_tokens")).withColumn("words", F.array_join("d_tokens", " "))
    by_length = Window.partitionBy("d_category").orderBy(F.desc(F.length("words")), "words")
    long = d.where((F.col("d_repository") == "") & (F.length("words") <= 8192)).select("d_category", "d_tokens", F.row_number().over(by_length).alias("_n")).where(F.col("_n") <= first).orderBy("_n", "d_category").limit(2048)
    long = checkpoint(long.select("d_category", "d_tokens"))
    enough = F.size(F.array_intersect("d_tokens", "_tokens")) >= least
    rest = f.join(F.broadcast(long.where("d_category = ''")), enough, "left_anti")
    rest = rest.join(F.broadcast(long.where("d_category <> ''")), (F.col("category") == F.col("d_category")) & enough, "left_anti")
    rest = checkpoint(rest.withColumn("_row", F.monotonically_increasing_id()))
    asked = rest.select("_row", F.coalesce("repository", F.lit("")).alias("repository"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("file_path", F.lit("")).alias("file_path"), F.array_join("_tokens", " ").alias("words"))

    def fn(fs: pd.DataFrame, ds: pd.DataFrame) -> pd.DataFrame:
        return _suppressed(fs, ds, least)

    d = d.drop("d_tokens").distinct()
    gone = _in_blocks(asked, d, ["_row"], d.columns, _blocks(rest, block), _blocks(dismissals, block), fn, "_row bigint")
    return rest.join(gone.distinct(), "_row", "left_anti").select(*findings.columns)


def _suppressed(f: pd.DataFrame, d: pd.DataFrame, least: int) -> pd.DataFrame:
    """_row of these findings that one of these dismissals suppresses."""
    found = []
    if len(f) and len(d):
        vocabulary: dict[str, int] = {}
        asked = [[vocabulary.setdefault(t, len(vocabulary)) for t in x.split()] for x in f["words"]]
        d = d.sort_values(["d_repository", "d_category"])
        holders, columns = _holders(d["words"], vocabulary)
        span = _spans([*zip(d["d_repository"], d["d_category"])])
        files = {x for x in zip(d["d_repository"], d["d_category"], d["source_file"]) if x[2]}
        for row, repository, category, path, of in zip(f["_row"], f["repository"], f["category"], f["file_path"], asked):
            seen = [(r, c) for r in dict.fromkeys(("", repository)) for c in dict.fromkeys(("", category)) if (r, c) in span]
            if any((*x, path) in files for x in seen):
                found.append(row)
            elif seen and len(of) >= least:
                spans = [span[x] for x in seen]
                shared = _shared(of, len(d), spans, holders, columns)
                if any(shared[a:b].max() >= least for a, b in spans):
                    found.append(row)
    return pd.DataFrame({"_row": np.array(found, np.int64)})


def rendered(entries: DataFrame, by: str, order: list[str], snippet: int = 200, block: int = 1200, bin: Column | None = None) -> DataFrame:
    """Entries of a group as one block: a line each with a cut snippet, the block cut as well.

    Only lines that begin within the block, and one more, are collected: no group is larger than a block.
    """
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n)), F.lit("..."))).otherwise(c)
    line = F.concat(F.lit("- ["), F.col("kind"), F.lit("] "), F.col("title"), F.lit(": "), cut(F.regexp_replace("content", r"\s+", " "), snippet))
    lines = prefix_budget(entries.withColumn("line", line), by, order, F.length("line") + 1, block + 2, overshoot=True, bin=bin)
    rows = lines.select(by, F.struct(*order, "line").alias("x"))
    return rows.groupBy(by).agg(cut(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n"), block).alias("block"))
