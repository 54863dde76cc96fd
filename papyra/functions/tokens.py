"""Token estimates, budgets and costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra import fixed
from papyra.functions.text import cjk_count, is_cjk_heavy


def ceil_long(x: Column) -> Column:
    return F.ceil(x).cast("bigint")


def text_tokens(text: Column) -> Column:
    return F.coalesce(ceil_long(F.length(text) / F.lit(fixed.CHARS_PER_TOKEN)), F.lit(0))


def estimate_tokens(text: Column, family: str = "claude") -> Column:
    """Latin and CJK characters have their own ratio; an empty text has no token."""
    latin, cjk = fixed.FAMILY_RATIO[family]
    n = cjk_count(text)
    return F.when(F.length(text) > 0, ceil_long((F.length(text) - n) / F.lit(latin) + n / F.lit(cjk)) + 1).otherwise(F.lit(0))


def count_tokens(text: Column, encoding: Column) -> Column:
    """By the encoding of a model: estimates of its family; without one the general estimate."""
    return F.when(encoding == "claude", estimate_tokens(text, "claude")).when(encoding == "gemini", estimate_tokens(text, "gemini")).otherwise(text_tokens(text))


def word_tokens(text: Column) -> Column:
    """The counter of tests and of offline use: words."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def image_tokens(width: Column, height: Column) -> Column:
    edge = F.greatest(width, height)
    return F.when((width <= 0) | (height <= 0) | edge.isNull(), 0).when(edge <= 512, 85).when(edge <= 768, 170).otherwise(680)


def max_output_tokens(tokens: Column, text: Column, model_max: Column) -> Column:
    factor = F.when(is_cjk_heavy(text), 3.0).otherwise(1.5)
    return F.greatest(F.lit(fixed.DEFAULT_MAX_OUTPUT).cast("bigint"), F.least(ceil_long(tokens * factor), model_max))


def call_cost(input_tokens: Column, output_tokens: Column, image_tokens_: Column, price: dict[str, Column]) -> Column:
    million = F.lit(1_000_000.0)
    image = F.when(price["image"].isNotNull(), image_tokens_ / million * price["image"]).otherwise(0.0)
    return input_tokens / million * price["input"] + output_tokens / million * price["output"] + image


def entry_cost(tokens: Column, price: Column) -> Column:
    """Cost of a call by token usage (input, output, cached, reasoning): cached input at a tenth, reasoning as output."""
    million = F.lit(1_000_000.0)
    cached, reasoning = F.nullif(tokens["cached"], F.lit(0)), F.nullif(tokens["reasoning"], F.lit(0))
    c = cached / million * price["input"] * 0.1
    r = reasoning / million * price["output"]
    i = (tokens["input"] - F.coalesce(cached, F.lit(0))) / million * price["input"]
    o = (tokens["output"] - F.coalesce(reasoning, F.lit(0))) / million * price["output"]
    return F.struct((i + o + F.coalesce(c, F.lit(0.0)) + F.coalesce(r, F.lit(0.0))).alias("total"), i.alias("input"), o.alias("output"), c.alias("cached"), r.alias("reasoning"))


def thinking_budget(levels: Column, effort: Column, max_output: Column) -> Column:
    ratio = F.array_position(levels, effort) / F.size(levels)
    return F.greatest(F.lit(1024).cast("bigint"), F.floor(max_output * ratio * 0.8).cast("bigint"))


def retry_delay(attempt: Column, retry_after: Column, initial: int = 1000, multiplier: int = 2, most: int = 30000) -> Column:
    """Milliseconds before another attempt, without the random part."""
    return F.least(F.coalesce(retry_after.cast("double"), F.lit(float(initial)) * F.pow(F.lit(float(multiplier)), attempt)), F.lit(float(most)))


def complexity_level(score: Column) -> Column:
    return F.when(score < 20, "low").when(score < 50, "medium").when(score < 80, "high").otherwise("very_high")


def condense_target(max_chars: Column, max_tokens: Column, ratio: Column, tokens: Column) -> Column:
    return F.coalesce(ceil_long(max_chars / F.lit(fixed.CONDENSE_CHARS_PER_TOKEN)), max_tokens.cast("bigint"), ceil_long(tokens * ratio))


def chunk_budget(window: Column, max_output: Column, override: Column | None = None) -> Column:
    """An override as large as the window is an error: null."""
    auto = F.greatest(F.floor(window * 0.5 - 500).cast("bigint"), max_output.cast("bigint"))
    return auto if override is None else F.when(override.isNull(), auto).when(override < window, override)


def prompt_level(target: Column, tokens: Column) -> Column:
    share = target / tokens
    return F.when(share < 0.1, "high").when(share < 0.5, "medium").otherwise("low")
