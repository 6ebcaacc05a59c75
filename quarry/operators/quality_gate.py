"""Document quality rules: text health, routing, post-parse gates, heading levels, argument summaries."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Parts of field names whose values are never shown.
SENSITIVE = ("password", "token", "secret", "api_key", "authorization", "connection", "database_url", "sql")

# Names whose fields a review never shows, and the texts it hides.
PRIVATE = ("authorization", "api_key", "password", "secret", "tenant_id", "user_id", "owner_user_id", "acl", "roles", "market_scopes", "storage_key", "path", "local_path", "sql", "exception", "stack",
           "reasoning", "reasoning_content", "trusted_user_fixture_id", "acl_fixture_id", "version_fixture_id")
SUSPICIOUS = re.compile(
    r"(?i)(?:\bsk-[\w-]+|\bBearer\s+\S+|[A-Z]:[\\/]|"
    r"/(?:home|Users|tmp|etc|var)/|\b(?:SELECT\s+.+?\s+FROM|INSERT\s+INTO|DELETE\s+FROM)\b|"
    r"[\"']?(?:tenant_id|user_id|api_key|password|authorization|reasoning_content|acl)[\"']?\s*[:=])"
)
# What a line is by its form.
FIELD_LABEL = r"(?i)(?:number|identifier|reference|code|date|country|category|brand|model|type)\z"
SECTION = r"(?i)^(?:part|annex|chapter|section)\s+[A-Za-z0-9]"
CURRENCY = r"(?i)^(?:approximately\s+)?(?:EUR|USD|GBP|CNY|JPY|€|\$|£|¥)\s*\d[\d.,]*(?:\s+(?:billion|million|thousand))?(?:\s+per\s+\w+)?\z"
REFERENCE_CODE = r"(?i)^[A-Z]?\d+(?:[/_-]\d+){1,}[A-Z]?\z"
OUTLINE = r"^(?:(?:\d{1,4}(?:\.\d{1,4})*)[.)、:]?|[A-Za-z][.)、]|[（(]?[一二三四五六七八九十]+[)）.、])\s*\z"
NUMBERED = r"^(?:(?:\d{1,4}(?:\.\d{1,4})*)[.)、:]|[A-Za-z][.)、]|[（(]?[一二三四五六七八九十]+[)）.、])\s+"
LINE_KINDS = {"currency": CURRENCY, "reference_code": REFERENCE_CODE, "outline": OUTLINE, "label": FIELD_LABEL, "section": SECTION, "numbered": NUMBERED, "heading": r"^[^.!?]{1,30}\z"}


def text_health(df: DataFrame, text: str, least: int = 20, share: float = 0.9) -> DataFrame:
    """status healthy, suspect or unusable, with reasons; valid characters are letters, numbers and punctuation."""
    solid = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s", "")
    rows = df.withColumn("total", F.length(solid)).withColumn("valid", F.length(F.regexp_replace(solid, r"[^\p{L}\p{N}\p{P}]", "")))
    ratio = F.round(F.col("valid") / F.nullif(F.col("total"), F.lit(0)), 6)
    low, odd = F.col("total") < least, ratio < share
    weak = F.array_compact(F.array(F.when(low, "native_text_character_count_low"), F.when(odd, "native_valid_character_ratio_low")))
    reasons = F.when(F.col("total") == 0, F.array(F.lit("native_text_empty"))).when(F.col("valid") == 0, F.array(F.lit("native_text_no_valid_characters"))).when(low | odd, weak).otherwise(F.array(F.lit("native_text_readable")))
    status = F.when((F.col("total") == 0) | (F.col("valid") == 0), "unusable").when(low | odd, "suspect").otherwise("healthy")
    return rows.withColumn("status", status).withColumn("reasons", reasons)


def route(extension: Column, health: Column, complex_: Column) -> Column:
    return F.when(extension.isin("csv", "docx"), "native").when(extension == "pdf", F.when(health == "healthy", "native").otherwise("enhanced")).otherwise(F.when(complex_, "hybrid").otherwise("native"))


def two_columns(blocks: DataFrame, page: str, centre: str) -> DataFrame:
    """A page is set in two columns if at least three block centres lie left of 42 % and three within 55-85 %."""
    c = F.col(centre)
    return blocks.groupBy(page).agg(((F.count_if(c < 0.42) >= 3) & (F.count_if(c.between(0.55, 0.85)) >= 3)).alias("two_columns"))


def retention_status(native: Column, final: Column, least: float = 0.7) -> Column:
    """Rejected if less than `least` of the native characters is left; exactly that much passes."""
    return F.when((native > 0) & (F.round(final / native, 6) < least), "rejected").otherwise("accepted")


def line_kind(line: Column) -> Column:
    """The first kind in `LINE_KINDS` whose form the trimmed line has; currency and reference codes are data, never headings."""
    line, kind = F.trim(F.regexp_replace(line, r"\s+", " ")), F
    for name, form in LINE_KINDS.items():
        kind = kind.when(line.rlike(form), name)
    return kind.otherwise("text")


def heading_levels(blocks: DataFrame, document: str, order: str, size: str, weight: Column, most: int = 6, limit: int = 100) -> DataFrame:
    """Blocks set well above the body size, with a level by distinct size, the first `limit` of each document.

    The body size is that of most text; of equal weights the smaller.
    """
    sizes = blocks.groupBy(document, size).agg(F.sum(weight).alias("_w"))
    body = sizes.groupBy(document).agg(F.max_by(size, F.struct("_w", -F.col(size))).alias("_body"))
    large = blocks.join(body, document).filter(F.col(size) >= F.greatest(F.col("_body") + 1, F.col("_body") * 1.2))
    large = large.withColumn("level", F.least(F.lit(most), F.dense_rank().over(Window.partitionBy(document).orderBy(F.desc(size)))))
    return large.withColumn("_r", F.row_number().over(Window.partitionBy(document).orderBy(order))).filter(F.col("_r") <= limit).drop("_r", "_body")


def shortened(value: object, most: int) -> str:
    text = str(value)
    return text if len(text) <= most else text[: most - 3] + "..."


def shown_fields(fields: dict, most: int, depth: int) -> dict:
    """The first `most` fields by name, sensitive ones hidden, and how many were left out."""
    names = sorted(fields)
    out = {shortened(k, 100): "[REDACTED]" if any(s in shortened(k, 100).lower().replace("-", "_") for s in SENSITIVE) else shown_value(fields[k], depth) for k in names[:most]}
    return out if len(names) <= most else out | {"_truncated_fields": len(names) - most}


def shown_value(value: object, depth: int) -> object:
    """Two levels of structure, ten entries of each, texts up to 200 characters."""
    if depth > 1:
        return "[TRUNCATED]"
    if isinstance(value, dict):
        return shown_fields(value, 10, depth + 1)
    if isinstance(value, list):
        return [shown_value(v, depth + 1) for v in value[:10]] + ["[TRUNCATED]"] * (len(value) > 10)
    return shortened(value, 200) if isinstance(value, str) else value


def summarize_arguments(arguments: Column) -> Column:
    """A JSON object as bounded JSON: at most 20 fields in order, see `shown_fields`; {} for what is no object."""

    def run(rows: pa.Array) -> pa.Array:
        out = []
        for text in rows.to_pylist():
            try:
                fields = json.loads(text or "{}")
            except ValueError:
                fields = {}
            out.append(json.dumps(shown_fields(fields if isinstance(fields, dict) else {}, 20, 0), sort_keys=True, ensure_ascii=False))
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(arguments)


def review_value(text: str | None) -> str | None:
    """JSON without private fields at any depth and with suspicious texts hidden; what is no JSON counts as one text."""

    def shown(value: object) -> object:
        if isinstance(value, list):
            return [shown(v) for v in value]
        return "[REDACTED]" if isinstance(value, str) and SUSPICIOUS.search(value) else value

    if text is None:
        return None
    try:  # the hook meets inner objects first, so a field's value is an object already cleared or a plain one
        value = json.loads(text, object_pairs_hook=lambda pairs: {k: shown(v) for k, v in pairs if k.lower() not in PRIVATE})
    except ValueError:
        value = text
    return json.dumps(shown(value), sort_keys=True, ensure_ascii=False)


def review_values(values: Column) -> Column:
    return F.arrow_udf(lambda rows: pa.array([review_value(v) for v in rows.to_pylist()], pa.string()), "string")(values)


def page_regressions(native: DataFrame, final: DataFrame, keys: list[str], least: int = 10, baseline: int = 50) -> DataFrame:
    """Pages that had at least `baseline` characters and keep fewer than `least`."""
    joined = native.withColumnRenamed("characters", "before").join(final.withColumnRenamed("characters", "after"), keys, "left")
    return joined.filter((F.col("before") >= baseline) & (F.coalesce("after", F.lit(0)) < least))


