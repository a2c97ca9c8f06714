"""Texts of benchmark entries: the diff and every base file, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def places(entries: DataFrame, diff: bool = True, files: bool = True) -> DataFrame:
    """entry_id, place, text; ``place`` is the word diff or the key of base_files.  Null texts and null maps give no row."""
    own = F.array(F.struct(F.lit("diff").alias("key"), F.col("diff").alias("value")))
    maps = F.coalesce(F.map_entries("base_files"), F.array().cast("array<struct<key:string,value:string>>"))
    every = F.concat(own, maps) if diff and files else own if diff else maps
    e = entries.select("entry_id", F.explode(every).alias("e"))
    return e.select("entry_id", F.col("e.key").alias("place"), F.col("e.value").alias("text")).where("text is not null")
