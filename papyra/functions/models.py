"""Model registry: lookups against a small dimension table (models: ordinal, provider, id, aliases, ...).

Joins carry no hint: Spark broadcasts the registry while its measured size is below the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra import fixed


def first_by_id(models: DataFrame) -> DataFrame:
    """One row for each model id: the first in the registry's order, whatever its provider."""
    return models.groupBy("id").agg(F.min_by(F.struct(*models.columns), "ordinal").alias("m")).select("m.*")


def aliases(models: DataFrame) -> DataFrame:
    """provider, alias, id; an alias that two models share names the first."""
    x = models.select("provider", F.explode("aliases").alias("alias"), "id", "ordinal")
    return x.groupBy("provider", "alias").agg(F.min_by("id", "ordinal").alias("id"))


def resolve_alias(calls: DataFrame, models: DataFrame, provider: str = "provider", model: str = "model") -> DataFrame:
    """calls with model_id: what the alias stands for with that provider, else the name itself."""
    a = aliases(models).select(F.col("provider").alias("__p"), F.col("alias").alias("__a"), F.col("id").alias("__id"))
    return calls.join(a, (F.lower(F.trim(calls[provider])) == F.col("__p")) & (calls[model] == F.col("__a")), "left").withColumn("model_id", F.coalesce("__id", model)).drop("__p", "__a", "__id")


def resolve_specs(specs: DataFrame, models: DataFrame, spec: str = "spec", default_provider: str | None = None) -> DataFrame:
    """specs with provider, model_id, effort, encoding, context_window, max_output_tokens, price and error.

    A spec is model, provider:model or provider:model:effort. error is null or one of
    INVALID_FORMAT, UNKNOWN_PROVIDER, MISSING_MODEL, EFFORT_NOT_SUPPORTED, INVALID_EFFORT.
    """
    part = F.split(F.trim(F.col(spec)), ":")
    x = specs.withColumn("__part", part).withColumn("__n", F.size("__part"))
    x = x.withColumn("provider", F.when(F.col("__n") == 1, F.lit(default_provider).cast("string")).otherwise(F.col("__part")[0]))
    x = x.withColumn("__model", F.when(F.col("__n") == 1, F.col("__part")[0]).otherwise(F.get("__part", F.lit(1)))).withColumn("__effort", F.nullif(F.get("__part", F.lit(2)), F.lit("")))
    known = models.select(F.col("provider").alias("__provider")).distinct()
    x = x.join(known, x["provider"] == F.col("__provider"), "left")
    x = resolve_alias(x, models, "provider", "__model")
    m = first_by_id(models).select(F.col("id").alias("__id"), "encoding", "context_window", "max_output_tokens", F.col("pricing").alias("__price"), F.col("capabilities.reasoning").alias("__reasoning"))
    x = x.join(m, x["model_id"] == F.col("__id"), "left")
    error = (
        F.when((F.col("__n") > 3) | ((F.col("__n") == 1) & F.col("provider").isNull()), "INVALID_FORMAT")
        .when(F.col("__provider").isNull(), "UNKNOWN_PROVIDER")
        .when(F.coalesce(F.length("__model"), F.lit(0)) == 0, "MISSING_MODEL")
        .when(F.col("__effort").isNotNull() & F.col("__reasoning").isNull(), "EFFORT_NOT_SUPPORTED")
        .when(F.col("__effort").isNotNull() & ~F.array_contains("__reasoning.levels", F.col("__effort")), "INVALID_EFFORT")
    )
    ok = error.isNull()
    price = F.struct(*[F.coalesce(F.col(f"__price.{k}"), F.when(F.col("__price").isNull(), F.lit(v))).alias(k) for k, v in fixed.DEFAULT_PRICE.items()])
    return x.select(
        *specs.columns, error.alias("error"), F.when(ok, F.col("provider")).alias("provider"), F.when(ok, F.col("model_id")).alias("model_id"),
        F.when(ok, F.coalesce("__effort", F.col("__reasoning.default"))).alias("effort"), F.when(ok, F.coalesce("encoding", F.lit(fixed.DEFAULT_ENCODING))).alias("encoding"),
        F.when(ok, F.coalesce("context_window", F.lit(fixed.DEFAULT_WINDOW).cast("bigint"))).alias("context_window"), F.when(ok, F.coalesce("max_output_tokens", F.lit(fixed.DEFAULT_MAX_OUTPUT).cast("bigint"))).alias("max_output_tokens"),
        F.when(ok, price).alias("price"),
    )


def vision_provider(model: Column) -> Column:
    out = F
    for prefix, provider in fixed.MODEL_PREFIX:
        out = out.when(F.startswith(model, F.lit(prefix)), provider)
    return out.otherwise("unknown")


def provider_options(provider: Column, effort: Column, levels: Column, max_output: Column) -> Column:
    """JSON of provider-specific options for a reasoning effort; null without one."""
    from papyra.functions.tokens import thinking_budget

    budget = thinking_budget(levels, effort, max_output)
    return (
        F.when(effort.isNull() | (effort == "none"), F.lit(None).cast("string"))
        .when(provider.isin("openai", "azure"), F.to_json(F.struct(F.struct(effort.alias("reasoningEffort")).alias("openai"))))
        .when(provider == "anthropic", F.to_json(F.struct(F.struct(F.struct(F.lit("enabled").alias("type"), budget.alias("budgetTokens")).alias("thinking")).alias("anthropic"))))
        .when(provider == "google", F.to_json(F.struct(F.struct(F.struct(F.upper(effort).alias("thinkingLevel")).alias("thinkingConfig")).alias("google"))))
    )


def provider_priority(provider: Column) -> Column:
    return F.array_position(F.array(*[F.lit(p) for p in fixed.PROVIDER_ORDER]), provider)
