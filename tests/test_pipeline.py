import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from patchlake.functions import text
from patchlake.plans import pipeline
from patchlake.streaming import events as stream

DIFF = "diff --git a/db.py b/db.py\n--- a/db.py\n+++ b/db.py\n@@ -1,2 +1,5 @@\n x = 1\n+import json\n+import os\n+cursor.execute(f'select {os.name}')\n+except:\n"


def entries(spark):
    rows = [("e", "own/name", DIFF, {"db.py": "x = 1\n"}), ("docs", "own/name", "--- a/r.md\n+++ b/r.md\n@@ -1 +1,2 @@\n a\n+more words here\n", {}), ("none", "own/name", "", None)]
    return spark.createDataFrame(rows, "entry_id string, repository string, diff string, base_files map<string,string>")


def test_review_finds_confirms_and_ranks(spark):
    got = pipeline.reviewed(entries(spark)).orderBy("review_id", "rank").collect()
    assert {(r.rule_id, r.start_line) for r in got if r.review_id == "e"} >= {("sql-concat", 4), ("bare-except", 5)}
    assert all(r.evidence_status == "confirmed" for r in got if r.rule_id) and got[0].severity == "high"
    assert not [r for r in got if r.review_id == "none"]
    dead = pipeline.reviewed(entries(spark), {"dead_code": pipeline.PRODUCERS["dead_code"]}).collect()
    assert [(r.rule_id, r.start_line) for r in dead] == [("unused-import", 2)]
    assert not [r for r in got if r.review_id == "docs" and r.category == "security"]


def test_dismissals_suppress(spark):
    d = spark.createDataFrame([("own/name", "error_handling", "db.py", "t", "c")], "repository string, category string, source_file string, title string, content string")
    left = pipeline.reviewed(entries(spark), dismissals=d)
    assert left.where("category = 'error_handling'").count() == 0 and left.count() > 0


def test_scripted_provider_with_prose_bad_json_and_repair(spark):
    finding = '{"findings": [{"category": " Security ", "severity": "high", "confidence": 0.9, "title": "cursor query", "description": "os name", "file_path": "db.py", "start_line": 4}]}'
    answers = spark.createDataFrame([("e", "no json at all"), ("e", "Here:\n```json\n" + finding + "\n```"), ("docs", "{broken")], "entry_id string, output string")
    got = pipeline.reviewed(entries(spark), {"provider": pipeline.scripted(answers)}).collect()
    assert [(r.review_id, r.category, r.evidence_status) for r in got] == [("e", "security", "strongly_supported")]


def test_cache_answers_what_it_knows(spark):
    req = spark.createDataFrame([("a", "k1", "p"), ("b", "k2", "q"), ("c", "k2", "q")], "entry_id string, key string, prompt string")
    cache = spark.createDataFrame([("k1", "old")], "key string, answer string")
    out, new = pipeline.cached(req, cache, lambda d: d.withColumn("answer", F.upper("prompt")))
    assert {(r.entry_id, r.answer) for r in out.collect()} == {("a", "old"), ("b", "Q"), ("c", "Q")} and new.count() == 1


@pytest.mark.parametrize("value, want", [("x [1, 2] y", "[1, 2]"), ('a {b} {"c": 1} d', '{"c": 1}'), ("```json\n{\"a\": [1]}\n``` {\"z\": 2}", '{"a": [1]}'), ("nothing", None), (None, None)])
def test_json_out_of_prose(spark, value, want):
    d = spark.createDataFrame([(value,)], "v string")
    assert d.select(text.extract_json(F.col("v"))).first()[0] == want


def test_templates_and_schedule(spark):
    d = spark.createDataFrame([("a", None)], "x string, y string")
    assert d.select(text.filled("$X-$Y.", X=F.col("x"), Y=F.col("y"))).first()[0] == "a-."
    with pytest.raises(KeyError):
        text.filled("$MISSING")
    assert [round(r.wait, 1) for r in text.retry_schedule(d, 3).orderBy("attempt").collect()] == [2.0, 4.1, 8.2]


def test_sinks_may_fail(spark):
    seen = []
    source = stream.read(spark, "/root/testdata/sf0.001/workflow_events.parquet")
    stream.fan_out(source, lambda d, n: 1 / 0, lambda d, n: seen.append(d.count()))
    assert sum(seen) == spark.read.parquet("/root/testdata/sf0.001/workflow_events.parquet").select("event_no").distinct().count()


def test_streams_keep_old_rows_of_later_batches(spark, tmp_path):
    """Files of three batches, the newest first; Spark drops late rows from the third batch on."""
    for i in range(135):
        row = pd.DataFrame({"event_no": [i], "kind": ["usage"], "received_at": [pd.Timestamp("2026-06-01") - pd.Timedelta(days=i)]})
        row.to_parquet(tmp_path / f"{i:03}.parquet", coerce_timestamps="us")
        os.utime(tmp_path / f"{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    got = stream.run(stream.kind_counts(stream.read(spark, str(tmp_path))), ["kind"]).collect()
    assert [(r.kind, r.n) for r in got] == [("usage", 135)]


def test_stream_without_rows_has_no_result(spark, tmp_path):
    spark.createDataFrame([], "event_no bigint, review_id string, kind string, stage string, payload string, event_ts timestamp, received_at timestamp").write.parquet(str(tmp_path / "e"))
    assert stream.run(stream.kind_counts(stream.read(spark, str(tmp_path / "e"))), ["kind"]).collect() == []
