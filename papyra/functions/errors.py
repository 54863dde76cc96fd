"""Classification of error messages by ordered patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra import fixed
from papyra.functions.lookup import look_up


def retry_class(message: Column) -> Column:
    return F.when(message.rlike(f"(?i){fixed.RETRYABLE}"), "retryable").otherwise("permanent")


def retry_after_ms(message: Column) -> Column:
    """Milliseconds a message asks to wait: more than 0 and under 300 seconds, else null."""
    found = F.coalesce(F.nullif(F.regexp_extract(message, r"(?i)retry.?after:?\s*(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(message, r"(?i)wait\s+(\d+)\s*(?:s|sec)", 1), F.lit("")))
    n = F.expr("cast(null as bigint)") if message is None else F.try_to_number(found, F.lit("999999999")).cast("bigint")
    return F.when((n > 0) & (n < 300), n * 1000)


def error_class(message: Column) -> Column:
    """category, retryable, status and retry_after_ms of a message; unknown where no pattern fits."""
    category, retryable, status = F, F, F
    for pattern, name, again, code in fixed.ERROR_CATEGORIES:
        hit = message.rlike(f"(?i){pattern}")
        if name == "auth":
            number = F.nullif(F.regexp_extract(message, r"\b(401|403)\b", 1), F.lit("")).cast("int")
        elif name == "dependency":
            number = F.nullif(F.regexp_extract(message, r"\b(502|503|504)\b", 1), F.lit("")).cast("int")
        elif name == "validation":
            number = F.when(message.rlike(r"(?i)\b400\b|bad.?request"), 400)
        else:
            number = F.lit(code).cast("int")
        category, retryable, status = category.when(hit, name), retryable.when(hit, again), status.when(hit, number)
    wait = F.nullif(F.regexp_extract(message, r"(?i)retry.?after[:\s]+(\d+)", 1), F.lit("")).cast("bigint") * 1000
    category = category.otherwise("unknown")
    return F.struct(category.alias("category"), retryable.otherwise(False).alias("retryable"), status.alias("status"), F.when(category == "rate_limit", wait).alias("retry_after_ms"))


def api_error_class(message: Column) -> Column:
    out = F
    for pattern, code in fixed.API_ERRORS:
        out = out.when(message.rlike(f"(?i){pattern}"), code)
    return out.otherwise("API_ERROR")


def injection_flags(output: Column, canary: Column | None = None) -> Column:
    """Flags of an output that looks steered by injected instructions; several may repeat a label."""
    flags = [F.when(output.rlike(f"(?i){pattern}"), label) for pattern, label in fixed.INJECTIONS]
    if canary is not None:
        flags.insert(0, F.when((F.length(canary) > 0) & F.contains(output, canary), "canary-leaked"))
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def wrap_phase(phase: Column, message: Column) -> Column:
    return F.struct(
        F.coalesce(look_up(fixed.PHASE_ERROR, phase), F.lit("PipelineError")).alias("error_class"),
        F.lower(message).rlike("abort|cancel").alias("aborted"),
        phase.isin("analyze", "extract", "render").alias("recoverable"),
    )


def pairs_of(attributes: Column) -> Column:
    """Attributes as sorted key=value texts; those without a value are left out."""
    kept = F.map_entries(F.map_filter(attributes, lambda k, v: v.isNotNull()))
    return F.sort_array(F.transform(kept, lambda e: F.concat_ws("=", e["key"], e["value"])))


def redacted(attrs: Column) -> Column:
    """A record (map of path to text) without the paths that may hold a secret or a person."""
    last = lambda k: F.substring_index(k, ".", -1)
    return F.map_filter(attrs, lambda k, v: ~(last(k).isin(*fixed.SECRET_NAMES) & (F.length(k) - F.length(F.replace(k, F.lit("."), F.lit(""))) <= 1)) & ~k.isin(*fixed.SECRET_PATHS))
