"""Readers: benchmark datasets, knowledge and history lines, metric documents, snapshots of folders, diffs on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

ENTRY = "entry_id string, repository string, commit string, parent_commit string, bug_description string, bug_fix string, hold_out boolean, diff string, affected_files array<string>, base_files map<string,string>, language string, category string, severity string"
KNOWLEDGE = "kind string, title string, content string, repository string, category string, source_file string, source string, tags array<string>, created_at string"
#: fixed values: endings of the files that a folder snapshot takes, besides names without one
SNAPSHOT_ENDINGS = ("py", "js", "jsx", "ts", "tsx", "go", "rs", "java", "c", "h", "cpp", "hpp", "cs", "rb", "php", "kt", "swift", "sh", "sql", "yaml", "yml", "json", "toml", "md", "txt", "cfg", "ini")


def benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSONL file, or of a JSON document that is a list or holds one under ``entries``; ids must be unique."""
    if path.endswith(".jsonl"):
        entries = spark.read.schema(ENTRY).option("mode", "FAILFAST").json(path)
    else:
        text = spark.read.text(path, wholetext=True)
        as_object = F.from_json("value", f"entries array<struct<{_struct(ENTRY)}>>")["entries"]
        as_list = F.from_json("value", f"array<struct<{_struct(ENTRY)}>>")
        entries = text.select(F.explode(F.when(F.ltrim(F.col("value")).startswith("["), as_list).otherwise(as_object)).alias("e")).select("e.*")
    entries = entries.withColumn("hold_out", F.coalesce("hold_out", F.lit(True)))
    ids = Window.partitionBy("entry_id")
    bad = (F.count("*").over(ids) > 1) | (~F.col("hold_out") & (F.trim(F.coalesce("bug_description", F.lit(""))) == ""))
    return entries.withColumn("_ok", F.when(bad, F.raise_error(F.concat(F.lit("entry repeated or without description: "), "entry_id"))).otherwise(F.lit(True))).where("_ok").drop("_ok")


def _struct(schema: str) -> str:
    return ", ".join(f"{c.split(' ', 1)[0]}: {c.split(' ', 1)[1]}" for c in schema.split(", "))


def knowledge(spark: SparkSession, path: str, repository: str | None = None) -> DataFrame:
    """Knowledge lines; a corrupt line ends the reading of its file, what stands before it is kept; with a repository its own and the global ones.

    The files are split by lines; where a file's first corrupt line stands is one number per file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") * F.lit(1 << 20) + F.monotonically_increasing_id() % (1 << 33)).alias("at")).where(F.trim("value") != "")
    parsed = lines.withColumn("_r", F.from_json("value", KNOWLEDGE + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})).withColumn("_stop", F.col("_r._bad").isNotNull())
    stops = parsed.where("_stop").groupBy("file").agg(F.min("at").alias("_end"))
    rows = parsed.join(stops, "file", "left").where("_end is null or at < _end").select("_r.*").drop("_bad")
    return rows if repository is None else rows.where((F.coalesce("repository", F.lit("")) == "") | (F.col("repository") == repository))


def merged_pages(pages: DataFrame, key: str = "listing", most: int = 40) -> DataFrame:
    """Items of recorded pages (key, page, items array, next) in order: key, place, item.  A listing of more than ``most``
    pages, or with a page missing before one that is there, is an error, as a listing cut short would pass for a whole one."""
    counts = Window.partitionBy(key)
    bad = (F.max("page").over(counts) > most) | (F.count("*").over(counts) != F.max("page").over(counts))
    checked = pages.withColumn("_ok", F.when(bad, F.raise_error(F.concat(F.lit("listing incomplete or too long: "), F.col(key).cast("string")))).otherwise(F.lit(True))).where("_ok")
    items = checked.select(key, "page", F.posexplode("items").alias("at", "item"))
    return items.select(key, F.row_number().over(Window.partitionBy(key).orderBy("page", "at")).alias("place"), "item")


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """system, metric, value of a document {system: {metric: number}}."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, map<string, string>>")).alias("system", "m"))
    return rows.select("system", F.explode("m").alias("metric", "value")).where("metric <> 'system'").select("system", "metric", F.expr("try_cast(value as double)").alias("value"))


def history(spark: SparkSession, path: str, limit: int = 1000) -> DataFrame:
    """Of the last ``limit`` lines of a history file those that are JSON, newest first: lines are appended, so the last stand at its end."""
    rows = spark.read.text(path).select("value", F.get_json_object("value", "$.ts").alias("ts"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    last = rows.orderBy(F.desc("_file"), F.desc("_block"), F.desc("_at")).limit(limit)
    return last.where(F.get_json_object("value", "$").isNotNull()).select("value", "ts")


def folder(spark: SparkSession, path: str, file_bytes: int = 1_000_000, total_bytes: int = 2_000_000) -> DataFrame:
    """path, content of a folder in path order: no dot paths, known endings, small files, cut before the total is passed."""
    root = path.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.regexp_replace(F.col("path"), "^.*?" + root.replace("\\", "\\\\") + "/", "")
    every = files.select(name.alias("path"), "length", "content")
    rows = every.select("path", "length").where(~F.col("path").rlike(r"(^|/)\.") & (F.col("path").rlike(r"\.(" + "|".join(SNAPSHOT_ENDINGS) + ")$") | ~F.col("path").rlike(r"\.[^/]*$")) & (F.col("length") <= file_bytes))
    used = F.sum("length").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, 0))  # over names and sizes only
    taken = rows.withColumn("used", used).where(F.col("used") <= total_bytes).select("path")
    return every.join(taken, "path", "left_semi").select("path", F.decode("content", "UTF-8").alias("content"))


def diffs(spark: SparkSession, path: str) -> DataFrame:
    """entry_id (file name), diff of a folder of patch files."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("entry_id"), F.col("value").alias("diff"))
