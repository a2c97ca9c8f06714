"""Problem 9: a mixture in which each source has its target share of the tokens.

Documents are counted in tokens and summed to cells of source, language and topic.  Iterative proportional fitting
rakes the cells' repeat weights to the source targets and to the language and topic shares of the targeted documents,
under each source's cap of repeats; sources come last, so their shares hold.  The rounds end when no weight changes by
more than ``TOLERANCE`` of itself.  Topics beyond the ``TOPICS`` with the most tokens are raked as one, so the cells that
reach the driver are bounded by the sources with a target, the languages of two letters and ``TOPICS``.  The mixture is as large as the source that
is shortest of its share allows.  Each document gets the whole part of its weight, and one more by sequential Poisson
sampling with the fractional part as probability (order: a hash of doc_id over that probability), cut where the source
has reached its tokens; a cut needs no order over a whole source, only within one of many bins.

Sources without a target, and null sources, take no part.  A target without tokens keeps share 0; the other targets are
scaled up to 1 and ``target_share`` still shows what was asked.  Null or empty texts have 0 tokens and are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from patchlake.llm.encode import TOKENIZER_DIR, encoder
from patchlake.session import checkpoint, spread, table

BINS = 1024
ROUNDS, TOLERANCE = 1000, 1e-6
TOPICS = 1000
#: fixed values: other forms of the codes of the languages that are mostly met
LANGUAGES = {"eng": "en", "english": "en", "fra": "fr", "fre": "fr", "french": "fr", "deu": "de", "ger": "de", "german": "de", "spa": "es", "spanish": "es"}


def sized(documents: DataFrame, directory: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, source, language, topic, tokens."""

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(directory, name)
        for b in batches:
            yield b.drop(columns="text").assign(tokens=[len(enc.ids(t)) for t in b["text"]])

    word = F.regexp_extract(F.lower(F.trim("lang")), "^[a-z]+", 0)
    lang = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), word), F.when(F.length(word) == 2, word), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("string"), "source", F.when(lang != "", lang).otherwise("und").alias("language"), F.coalesce(F.lower(F.trim("category")), F.lit("none")).alias("topic"), F.coalesce("text", F.lit("")).alias("text"))
    return spread(docs).mapInPandas(fn, "doc_id string, source string, language string, topic string, tokens bigint").withColumn("doc_id", F.col("doc_id").cast("bigint"))


def rake(cells: pd.DataFrame, targets: dict[str, tuple[float, int]], rounds: int = ROUNDS) -> np.ndarray:
    """Expected repeats of a document of each cell (columns source, language, topic, tokens)."""
    tokens = cells["tokens"].to_numpy(float)
    cap = cells["source"].map(lambda s: targets[s][1]).to_numpy(float)
    have = cells.groupby("source")["tokens"].sum()
    asked = {s: targets[s][0] for s in have.index if have[s] > 0 and targets[s][0] > 0}
    scale = sum(asked.values())
    size = min((have[s] * targets[s][1] * scale / a for s, a in asked.items()), default=0.0)
    want = {s: size * a / scale for s, a in asked.items()}
    weight = np.ones(len(cells))
    margins = [(cells[c].to_numpy(), {k: float(v) / max(1.0, tokens.sum()) * size for k, v in cells.groupby(c)["tokens"].sum().items()}) for c in ("language", "topic")]
    codes = {i: (np.unique(k, return_inverse=True), w) for i, (k, w) in enumerate([*margins, (cells["source"].to_numpy(), want)])}
    for _ in range(rounds):
        before = weight
        for i in (0, 1, 2):
            (keys, code), wanted = codes[i]
            goal = np.array([wanted.get(k, 0.0) for k in keys])
            for _ in range(20 if i == 2 else 1):  # under the cap, what capped cells lack goes to the others of the source
                now = np.bincount(code, weight * tokens, len(keys))
                weight = np.minimum(cap, weight * np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[code])
        if (np.abs(weight - before) <= TOLERANCE * np.maximum(before, TOLERANCE)).all():
            break
    return weight


def mixture(documents: DataFrame, targets: DataFrame, directory: str = TOKENIZER_DIR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, source, tokens, repeats of the documents used; the report per target source; that per language and topic."""
    spark = documents.sparkSession
    asked = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.where("source is not null").collect()}  # one row per source
    docs = checkpoint(sized(documents.where(F.col("source").isin(list(asked)) & F.col("text").isNotNull()), directory).where("tokens > 0"))
    large = docs.groupBy("topic").agg(F.sum("tokens").alias("tokens")).orderBy(F.desc("tokens"), "topic").limit(TOPICS).select("topic", F.col("topic").alias("_large"))
    docs = docs.join(F.broadcast(large), "topic", "left").withColumn("topic", F.coalesce("_large", F.lit("other topics"))).drop("_large")
    cells = docs.groupBy("source", "language", "topic").agg(F.sum("tokens").alias("tokens")).toPandas()  # by dimensions, not by documents
    weights = spark.createDataFrame(cells.assign(weight=rake(cells, asked) if len(cells) else []), "source string, language string, topic string, tokens bigint, weight double").drop("tokens")
    hashed = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))
    w = docs.join(F.broadcast(weights), ["source", "language", "topic"]).withColumn("whole", F.floor(F.col("weight") + 1e-9)).withColumn("part", F.greatest(F.lit(0.0), F.col("weight") - F.col("whole")))
    w = w.withColumn("order", F.when(F.col("part") > 1e-9, hashed / F.col("part")))
    w = w.withColumn("bin", F.least(F.lit(BINS - 1), F.floor(F.lit(float(BINS)) * F.col("order") / (1 + F.col("order")))))
    bins = w.groupBy("source", "bin").agg(F.sum(F.when(F.col("order").isNotNull(), F.col("tokens"))).alias("tokens"), F.sum(F.col("weight") * F.col("tokens")).alias("want"), F.sum(F.col("whole") * F.col("tokens")).alias("base"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("source")
    edges = bins.select("source", "bin", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("ahead"), (F.sum("want").over(over) - F.sum("base").over(over)).alias("room"))
    within = Window.partitionBy("source", "bin").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = w.where("order is not null").join(F.broadcast(edges.where("bin is not null")), ["source", "bin"])  # at most BINS rows per target source
    extra = placed.withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("tokens").over(within), F.lit(0))).withColumn("extra", (F.col("ahead") + F.col("tokens") / 2 <= F.col("room")).cast("int"))
    chosen = extra.select("doc_id", "source", "language", "topic", "tokens", (F.col("whole") + F.col("extra")).alias("repeats")).unionByName(w.where("order is null").select("doc_id", "source", "language", "topic", "tokens", F.col("whole").alias("repeats")))
    used = checkpoint(chosen.where("repeats > 0").withColumn("repeats", F.col("repeats").cast("int")))
    per = used.groupBy("source").agg(F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    report = targets.where("source is not null").join(F.broadcast(per), "source", "left").withColumn("size", F.sum("tokens").over(Window.partitionBy()))  # one row per source
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    whole, taken = F.sum("tokens").over(Window.partitionBy("dimension")), F.sum("taken").over(Window.partitionBy("dimension"))
    counts = docs.join(used.select("doc_id", (F.col("tokens") * F.col("repeats")).alias("taken")), "doc_id", "left").select("tokens", F.coalesce("taken", F.lit(0)).alias("taken"), F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("language", "topic")])).alias("x"))
    marginals = counts.groupBy("x.dimension", "x.value").agg(F.sum("tokens").alias("tokens"), F.sum("taken").alias("taken")).select("dimension", "value", F.col("taken").alias("tokens"), F.round(F.col("tokens") / whole, 6).alias("corpus_share"), F.round(F.col("taken") / taken, 6).alias("actual_share"))
    named = used.select("doc_id", "source", "tokens", "repeats")
    return named, report.select("source", "target_share", "max_repeats", zero("documents"), zero("most_repeats"), zero("tokens"), F.round(F.coalesce(F.col("tokens") / F.col("size"), F.lit(0.0)), 6).alias("actual_share")), marginals


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dimension (language or topic), value, tokens in the mixture, share of it, and the share in the targeted documents that was raked to."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[2]


def p9_within_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, share_held, repeats_held: whether the tokens of each source with documents are within its largest document of the target."""
    used, report, _ = mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    most = used.groupBy("source").agg(F.max("tokens").alias("largest"))
    r = report.join(F.broadcast(most), "source")  # one row per source
    size, asked = F.sum("tokens").over(Window.partitionBy()), F.sum("target_share").over(Window.partitionBy())
    return r.select("source", (F.abs(F.col("tokens") - size * F.col("target_share") / asked) <= F.col("largest") + 1).alias("share_held"), (F.col("most_repeats") <= F.col("max_repeats")).alias("repeats_held"))


SQL = {
    "p9_within_targets": """
        SELECT source, TRUE AS share_held, TRUE AS repeats_held FROM mix_targets
        WHERE target_share > 0 AND source IN (SELECT source FROM documents WHERE coalesce(text, '') <> '')""",
}
