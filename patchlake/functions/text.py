"""Text functions of the provider side: cache keys, JSON out of prose, templates, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def cache_key(**fields: Column) -> Column:
    """sha256 of a canonical JSON object: keys in order, values as JSON strings, nulls as null."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(v.cast("string"), r"\\", r"\\\\"), '"', r'\\"'), F.lit('"')), F.lit("null"))) for k, v in sorted(fields.items())]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def extract_json(text: Column) -> Column:
    """The first JSON object or array of a text that parses, fences left aside; null without one."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    tails = F.transform(F.regexp_extract_all(body, F.lit(r"(?s)(?=([{\[].*))"), F.lit(1)), lambda t: F.coalesce(F.nullif(F.regexp_extract(t, r"(?s)^(\{.*\})", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"(?s)^(\[.*\])", 1), F.lit(""))))
    return F.get(F.filter(tails, lambda t: t.isNotNull() & F.get_json_object(t, "$").isNotNull()), F.lit(0))


def filled(template: str, **values: Column) -> Column:
    """A template with $NAME filled in; a name without value is an error."""
    import re

    missing = sorted(set(re.findall(r"\$([A-Z][A-Z0-9_]*)", template)) - set(values))
    if missing:
        raise KeyError(f"template names without value: {missing}")
    parts, at = [], 0
    for m in re.finditer(r"\$([A-Z][A-Z0-9_]*)", template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(values[m.group(1)].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def section(template: Column | str, name: str) -> Column:
    """The text of a template under the heading ``## name``, up to the next heading of that level; '' without one."""
    t = F.lit(template) if isinstance(template, str) else template
    return F.regexp_replace(F.regexp_extract(t, rf"(?s)(?:^|\n)## {name}[ \t]*\n(.*?)(?=\n## |$)", 1), r"^\s+|\s+$", "")


def retry_schedule(df: DataFrame, attempts: int = 3, backoff: float = 2.0) -> DataFrame:
    """Rows times attempts with the seconds to wait before each further one."""
    return df.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1)))).withColumn("wait", F.lit(backoff) * F.pow(F.lit(2.0), F.col("attempt")) + 0.1 * F.col("attempt"))


def cost(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column) -> Column:
    """Prices are per million tokens, given by the caller."""
    return F.round(input_tokens / 1e6 * input_price + output_tokens / 1e6 * output_price, 6)
