"""Queries over the journal and the model registry: costs, errors, safety, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra import fixed
from papyra.functions import errors as er
from papyra.functions import models as md
from papyra.functions import prompts as pr
from papyra.functions import tokens as tk
from papyra.functions.lookup import document_type, get_extension
from papyra.plans.lookups import _DOCTYPE, _EXT
from papyra.plans.registry import Catalog, sql_case

catalog = Catalog()


def _q(s: str) -> str:
    return s.replace("'", "''").replace("\n", "' || chr(10) || '")


# --- errors and safety ---------------------------------------------------------------------------


@catalog.add("retry_class", f"SELECT id, CASE WHEN regexp_matches(error, '(?i){fixed.RETRYABLE}') THEN 'retryable' ELSE 'permanent' END AS class FROM journal WHERE error IS NOT NULL")
def retry_class(t):
    return t.journal.where("error is not null").select("id", er.retry_class(F.col("error")).alias("class"))


_WAIT = r"CAST(coalesce(nullif(regexp_extract(error, '(?i)retry.?after:?\s*(\d+)', 1), ''), nullif(regexp_extract(error, '(?i)wait\s+(\d+)\s*(?:s|sec)', 1), '')) AS BIGINT)"


@catalog.add("retry_after", f"SELECT id, CASE WHEN n > 0 AND n < 300 THEN n * 1000 END AS wait_ms FROM (SELECT id, {_WAIT} AS n FROM journal WHERE error IS NOT NULL)")
def retry_after(t):
    return t.journal.where("error is not null").select("id", er.retry_after_ms(F.col("error")).alias("wait_ms"))


def _ladder(pick) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(error, '(?i){p}') THEN {pick(name, again, code)}" for p, name, again, code in fixed.ERROR_CATEGORIES)


def _status(name, _, code):
    if name == "auth":
        return r"CAST(nullif(regexp_extract(error, '\b(401|403)\b', 1), '') AS INT)"
    if name == "dependency":
        return r"CAST(nullif(regexp_extract(error, '\b(502|503|504)\b', 1), '') AS INT)"
    if name == "validation":
        return r"CASE WHEN regexp_matches(error, '(?i)\b400\b|bad.?request') THEN 400 END"
    return "NULL" if code is None else str(code)


_CATEGORY = _ladder(lambda n, a, c: f"'{n}'") + " ELSE 'unknown' END"


@catalog.add("error_class", f"SELECT id, {_CATEGORY} AS category, {_ladder(lambda n, a, c: str(a).lower())} ELSE false END AS retryable, {_ladder(_status)} END AS status, CASE WHEN {_CATEGORY} = 'rate_limit' THEN CAST(nullif(regexp_extract(error, '(?i)retry.?after[:\\s]+(\\d+)', 1), '') AS BIGINT) * 1000 END AS retry_after_ms FROM journal WHERE error IS NOT NULL")
def error_class(t):
    return t.journal.where("error is not null").select("id", er.error_class(F.col("error")).alias("e")).select("id", "e.*")


@catalog.add("api_error_class", "SELECT id, CASE " + " ".join(f"WHEN regexp_matches(error, '(?i){p}') THEN '{c}'" for p, c in fixed.API_ERRORS) + " ELSE 'API_ERROR' END AS code FROM journal WHERE error IS NOT NULL")
def api_error_class(t):
    return t.journal.where("error is not null").select("id", er.api_error_class(F.col("error")).alias("code"))


@catalog.add("validate_output", "SELECT id, list_filter([" + "CASE WHEN contains(output, 'canary-7f3') THEN 'canary-leaked' END, " + ", ".join(f"CASE WHEN regexp_matches(output, '(?i){p}') THEN '{label}' END" for p, label in fixed.INJECTIONS) + "], lambda x: x IS NOT NULL) AS flags FROM journal WHERE output IS NOT NULL")
def validate_output(t):
    return t.journal.where("output is not null").select("id", er.injection_flags(F.col("output"), F.lit("canary-7f3")).alias("flags"))


@catalog.add("error_attrs", f"SELECT id, list_sort(list_filter(['category=' || {_CATEGORY}, 'message=' || substring(error, 1, 1024), 'model=' || model], lambda e: e IS NOT NULL)) AS attrs FROM journal WHERE error IS NOT NULL")
def error_attrs(t):
    attrs = er.pairs_of(F.create_map(F.lit("category"), er.error_class(F.col("error"))["category"], F.lit("message"), F.substring("error", 1, 1024), F.lit("model"), F.col("model")))
    return t.journal.where("error is not null").select("id", attrs.alias("attrs"))


@catalog.add("retry_delay", f"SELECT id, retries, least(coalesce(CAST(w AS DOUBLE), 1000.0::DOUBLE * pow(2.0, retries)), 30000.0) AS delay_ms FROM (SELECT id, retries, CASE WHEN n > 0 AND n < 300 THEN n * 1000 END AS w FROM (SELECT id, retries, {_WAIT} AS n FROM journal))")
def retry_delay(t):
    return t.journal.select("id", "retries", tk.retry_delay(F.col("retries"), er.retry_after_ms(F.col("error"))).alias("delay_ms"))


# --- models ------------------------------------------------------------------------------------


@catalog.add("registry_lookup", "SELECT id, provider, encoding, context_window FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS r FROM models) WHERE r = 1")
def registry_lookup(t):
    return md.first_by_id(t.models).select("id", "provider", "encoding", "context_window")


_ALIASES = "(SELECT provider, alias, arg_min(id, ordinal) AS id FROM (SELECT provider, unnest(aliases) AS alias, id, ordinal FROM models) GROUP BY 1, 2)"


@catalog.add("alias_lookup", f"SELECT j.id, j.model, coalesce(a.id, j.model) AS model_id FROM journal j LEFT JOIN {_ALIASES} a ON lower(trim(j.provider)) = a.provider AND j.model = a.alias")
def alias_lookup(t):
    return md.resolve_alias(t.journal.select("id", "provider", "model"), t.models).select("id", "model", "model_id")


_SPECS = "(SELECT DISTINCT provider || ':' || model || CASE WHEN retries > 0 THEN ':high' ELSE '' END AS spec FROM journal UNION SELECT DISTINCT model FROM journal UNION SELECT DISTINCT provider || ':' FROM journal)"


def _specs(t):
    j = t.journal
    one = j.select(F.concat("provider", F.lit(":"), "model", F.when(F.col("retries") > 0, ":high").otherwise("")).alias("spec"))
    return one.union(j.select(F.col("model").alias("spec"))).union(j.select(F.concat("provider", F.lit(":")).alias("spec"))).distinct()


@catalog.add("resolve_model", f"""
    WITH p AS (SELECT spec, string_split(trim(spec), ':') AS part FROM {_SPECS} WHERE spec IS NOT NULL),
    q AS (SELECT spec, len(part) AS n, CASE WHEN len(part) > 1 THEN part[1] END AS provider, CASE WHEN len(part) = 1 THEN part[1] ELSE part[2] END AS name, nullif(part[3], '') AS effort FROM p),
    a AS (SELECT q.*, coalesce(al.id, q.name) AS model_id, k.provider IS NOT NULL AS known FROM q LEFT JOIN {_ALIASES} al ON lower(trim(q.provider)) = al.provider AND q.name = al.alias LEFT JOIN (SELECT DISTINCT provider FROM models) k ON q.provider = k.provider),
    m AS (SELECT a.*, r.encoding, r.context_window, r.max_output_tokens, r.capabilities.reasoning AS reasoning FROM a LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS r FROM models) WHERE r = 1) r ON a.model_id = r.id),
    e AS (SELECT *, CASE WHEN n > 3 OR (n = 1 AND provider IS NULL) THEN 'INVALID_FORMAT' WHEN NOT known THEN 'UNKNOWN_PROVIDER' WHEN coalesce(length(name), 0) = 0 THEN 'MISSING_MODEL'
        WHEN effort IS NOT NULL AND reasoning IS NULL THEN 'EFFORT_NOT_SUPPORTED' WHEN effort IS NOT NULL AND NOT list_contains(reasoning.levels, effort) THEN 'INVALID_EFFORT' END AS error FROM m)
    SELECT spec, error, CASE WHEN error IS NULL THEN provider END AS provider, CASE WHEN error IS NULL THEN model_id END AS model_id, CASE WHEN error IS NULL THEN coalesce(effort, reasoning."default") END AS effort,
        CASE WHEN error IS NULL THEN coalesce(encoding, 'o200k_base') END AS encoding, CASE WHEN error IS NULL THEN coalesce(context_window, 128000) END AS context_window, CASE WHEN error IS NULL THEN coalesce(max_output_tokens, 8192) END AS max_output_tokens FROM e""")
def resolve_model(t):
    return md.resolve_specs(_specs(t).where("spec is not null"), t.models).drop("price")


@catalog.add("models_by_provider", "SELECT provider, list(id ORDER BY ordinal) AS ids, count(*) FILTER (pricing.input = 0 AND pricing.output = 0) AS free FROM models GROUP BY provider")
def models_by_provider(t):
    ids = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "id"))), lambda x: x["id"])
    return t.models.groupBy("provider").agg(ids.alias("ids"), F.count_if((F.col("pricing.input") == 0) & (F.col("pricing.output") == 0)).alias("free"))


@catalog.add("flat_models", "SELECT m.ordinal, m.provider || ':' || m.id AS spec, coalesce(m.capabilities.vision, false) AS vision, m.pricing.input AS price FROM models m")
def flat_models(t):
    return t.models.select("ordinal", F.concat("provider", F.lit(":"), "id").alias("spec"), F.coalesce("capabilities.vision", F.lit(False)).alias("vision"), F.col("pricing.input").alias("price"))


@catalog.add("provider_detect", "SELECT arg_min(provider, p) AS provider FROM (SELECT lower(trim(provider)) AS provider, min(ordinal) AS p FROM models GROUP BY 1)")
def provider_detect(t):
    return t.models.groupBy(F.lower(F.trim("provider")).alias("provider")).agg(F.min("ordinal").alias("p")).agg(F.min_by("provider", "p").alias("provider"))


@catalog.add("context_window", f"SELECT j.id, coalesce(m.context_window, 128000) AS context_window, coalesce(m.max_output_tokens, 8192) AS max_output FROM journal j LEFT JOIN models m ON j.model = m.id")
def context_window(t):
    m = md.first_by_id(t.models).select(F.col("id").alias("model"), "context_window", "max_output_tokens")
    return t.journal.select("id", "model").join(m, "model", "left").select("id", F.coalesce("context_window", F.lit(fixed.DEFAULT_WINDOW).cast("bigint")).alias("context_window"), F.coalesce("max_output_tokens", F.lit(fixed.DEFAULT_MAX_OUTPUT).cast("bigint")).alias("max_output"))


@catalog.add("default_encoding", "SELECT provider, coalesce(arg_min(encoding, ordinal), 'o200k_base') AS encoding FROM models GROUP BY provider")
def default_encoding(t):
    return t.models.groupBy("provider").agg(F.coalesce(F.min_by("encoding", "ordinal"), F.lit(fixed.DEFAULT_ENCODING)).alias("encoding"))


@catalog.add("default_pricing", "SELECT id, coalesce(pricing.input, 1.0) AS input, coalesce(pricing.output, 4.0) AS output, coalesce(pricing.image, 0.5) AS image FROM models")
def default_pricing(t):
    return t.models.select("id", *[F.coalesce(f"pricing.{k}", F.lit(v)).alias(k) for k, v in fixed.DEFAULT_PRICE.items()])


@catalog.add("vision_pricing", "SELECT DISTINCT model, CASE " + " ".join(f"WHEN starts_with(model, '{p}') THEN '{x}'" for p, x in fixed.MODEL_PREFIX) + " ELSE 'unknown' END AS provider FROM (SELECT model FROM journal UNION SELECT 'gpt-' || model FROM journal UNION SELECT 'llama-' || model FROM journal)")
def vision_pricing(t):
    j = t.journal.select("model")
    x = j.union(j.select(F.concat(F.lit("gpt-"), "model"))).union(j.select(F.concat(F.lit("llama-"), "model"))).distinct()
    return x.select("model", md.vision_provider(F.col("model")).alias("provider"))


_LEVEL = "list_position(capabilities.reasoning.levels, capabilities.reasoning.\"default\")"
_BUDGET = f"greatest(1024, CAST(floor(max_output_tokens * ({_LEVEL}::DOUBLE / len(capabilities.reasoning.levels)) * 0.8::DOUBLE) AS BIGINT))"


@catalog.add("thinking_budget", f"SELECT id, {_BUDGET} AS budget FROM models WHERE capabilities.reasoning IS NOT NULL")
def thinking_budget(t):
    r = F.col("capabilities.reasoning")
    return t.models.where(r.isNotNull()).select("id", tk.thinking_budget(r["levels"], r["default"], F.col("max_output_tokens")).alias("budget"))


@catalog.add("provider_options", f"""SELECT p, id, CASE WHEN e IS NULL OR e = 'none' THEN NULL WHEN p IN ('openai', 'azure') THEN '{{"openai":{{"reasoningEffort":"' || e || '"}}}}'
    WHEN p = 'anthropic' THEN '{{"anthropic":{{"thinking":{{"type":"enabled","budgetTokens":' || b || '}}}}}}' WHEN p = 'google' THEN '{{"google":{{"thinkingConfig":{{"thinkingLevel":"' || upper(e) || '"}}}}}}' END AS options
    FROM (SELECT unnest(['openai', 'azure', 'anthropic', 'google', 'ollama']) AS p, id, capabilities.reasoning."default" AS e, {_BUDGET} AS b FROM models)""")
def provider_options(t):
    x = t.models.withColumn("p", F.explode(F.array(*[F.lit(p) for p in fixed.PROVIDER_ORDER])))
    r = F.col("capabilities.reasoning")
    return x.select("p", "id", md.provider_options(F.col("p"), r["default"], r["levels"], F.col("max_output_tokens")).alias("options"))


@catalog.add("build_config", "SELECT j.id, coalesce(m.provider, lower(trim(j.provider))) AS provider, j.model, 60000 AS timeout_ms, 3 AS max_retries, CASE WHEN m.id IS NULL THEN 'UNKNOWN_MODEL' END AS error FROM journal j LEFT JOIN models m ON j.model = m.id")
def build_config(t):
    m = md.first_by_id(t.models).select(F.col("id").alias("__id"), F.col("provider").alias("__p"))
    j = t.journal.select("id", "provider", "model")
    return j.join(m, j["model"] == m["__id"], "left").select("id", F.coalesce("__p", F.lower(F.trim("provider"))).alias("provider"), "model", F.lit(60000).alias("timeout_ms"), F.lit(3).alias("max_retries"), F.when(F.col("__id").isNull(), "UNKNOWN_MODEL").alias("error"))


# --- usage and cost ----------------------------------------------------------------------------

_COST = """round((tokens.input - coalesce(nullif(tokens.cached, 0), 0)) / 1000000.0::DOUBLE * pi, 9) AS input_cost, round((tokens.output - coalesce(nullif(tokens.reasoning, 0), 0)) / 1000000.0::DOUBLE * po, 9) AS output_cost,
    round(nullif(tokens.cached, 0) / 1000000.0::DOUBLE * pi * 0.1, 9) AS cached_cost, round(nullif(tokens.reasoning, 0) / 1000000.0::DOUBLE * po, 9) AS reasoning_cost"""


@catalog.add("entry_cost", f"SELECT id, {_COST} FROM (SELECT j.id, j.tokens, coalesce(m.pricing.input, 1.0) AS pi, coalesce(m.pricing.output, 4.0) AS po FROM (SELECT j.id, j.tokens, coalesce(a.id, j.model) AS model FROM journal j LEFT JOIN {_ALIASES} a ON lower(trim(j.provider)) = a.provider AND j.model = a.alias) j LEFT JOIN models m ON j.model = m.id)")
def entry_cost(t):
    j = md.resolve_alias(t.journal.select("id", "provider", "model", "tokens"), t.models)
    m = md.first_by_id(t.models).select(F.col("id").alias("model_id"), F.col("pricing").alias("price"))
    price = F.struct(F.coalesce("price.input", F.lit(1.0)).alias("input"), F.coalesce("price.output", F.lit(4.0)).alias("output"))
    c = tk.entry_cost(F.col("tokens"), price)
    return j.join(m, "model_id", "left").select("id", *[F.round(c[k], 9).alias(f"{k}_cost") for k in ("input", "output", "cached", "reasoning")])


_PRICED = f"(SELECT j.*, coalesce(m.pricing.input, 1.0) AS pi, coalesce(m.pricing.output, 4.0) AS po, m.pricing.image AS pm, coalesce(m.capabilities.vision, false) AS vision, coalesce(m.capabilities.pdf_input, false) AS pdf_input FROM (SELECT j.*, coalesce(a.id, j.model) AS model_id FROM journal j LEFT JOIN {_ALIASES} a ON lower(trim(j.provider)) = a.provider AND j.model = a.alias) j LEFT JOIN models m ON j.model_id = m.id)"


def _priced(t, *columns):
    """Calls with the registry's model: its price (or the default one) and what it can do."""
    j = md.resolve_alias(t.journal.select("id", "provider", "model", *columns), t.models)
    m = md.first_by_id(t.models).select(F.col("id").alias("model_id"), "pricing", F.coalesce("capabilities.vision", F.lit(False)).alias("vision"), F.coalesce("capabilities.pdf_input", F.lit(False)).alias("pdf_input"))
    return j.join(m, "model_id", "left").fillna(False, ["vision", "pdf_input"])


@catalog.add("call_cost", f"SELECT id, round(tokens.input / 1000000.0::DOUBLE * pi + tokens.output / 1000000.0::DOUBLE * po + CASE WHEN pm IS NOT NULL THEN 85 / 1000000.0::DOUBLE * pm ELSE 0.0 END, 9) AS cost FROM {_PRICED} WHERE tokens.input IS NOT NULL AND tokens.output IS NOT NULL")
def call_cost(t):
    """A call with one small image, at its model's price; the image costs only where the model has a price for it."""
    price = {"input": F.coalesce("pricing.input", F.lit(1.0)), "output": F.coalesce("pricing.output", F.lit(4.0)), "image": F.col("pricing.image")}
    return _priced(t, "tokens").where("tokens.input is not null and tokens.output is not null").select("id", F.round(tk.call_cost(F.col("tokens.input"), F.col("tokens.output"), tk.image_tokens(F.lit(500), F.lit(300)), price), 9).alias("cost"))


_ONCE = "(SELECT DISTINCT ON (id) * FROM journal)"


@catalog.add("usage_rollup", f"SELECT experiment, count(*) AS calls, sum(tokens.input) AS input, sum(tokens.output) AS output, sum(tokens.cached) AS cached, sum(tokens.reasoning) AS reasoning, round(CAST(sum(CAST(cost.total AS DECIMAL(18,10))) AS DOUBLE), 4) AS cost FROM {_ONCE} GROUP BY experiment")
def usage_rollup(t):
    j = t.journal
    return j.groupBy("experiment").agg(F.count("*").alias("calls"), *[F.sum(f"tokens.{k}").alias(k) for k in ("input", "output", "cached", "reasoning")], F.round(F.sum(F.col("cost.total").cast("decimal(18,10)")).cast("double"), 4).alias("cost"))


@catalog.add("usage_accumulator", f"SELECT id, experiment, sum(coalesce(tokens.output, 0)) OVER (PARTITION BY experiment ORDER BY ts, id) AS running FROM {_ONCE}")
def usage_accumulator(t):
    """Running output tokens of each experiment: sums by hour first, whose running sums are the offsets of the rows within."""
    from pyspark.sql import Window

    j = t.journal.select("id", "experiment", "ts", F.coalesce("tokens.output", F.lit(0)).alias("n"), F.date_trunc("hour", "ts").alias("hour"))
    hours = j.groupBy("experiment", "hour").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("experiment").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hours.select("experiment", "hour", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("experiment", "hour").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = j.select("id", "experiment", "hour", F.sum("n").over(within).alias("n")).alias("r")
    offsets = offsets.alias("o")
    same = F.col("r.experiment").eqNullSafe(F.col("o.experiment")) & F.col("r.hour").eqNullSafe(F.col("o.hour"))
    return rows.join(offsets, same).select("r.id", "r.experiment", (F.col("r.n") + F.col("before")).alias("running"))


@catalog.add("usage_normalise", "SELECT id, tokens.input AS input, tokens.output AS output, CASE WHEN tokens.cached > 0 THEN tokens.cached END AS cached, greatest(0, tokens.input - coalesce(CASE WHEN tokens.cached > 0 THEN tokens.cached END, 0)) AS uncached, CASE WHEN tokens.reasoning > 0 THEN tokens.reasoning END AS reasoning, tokens.output - coalesce(tokens.reasoning, 0) AS text FROM journal")
def usage_normalise(t):
    cached, reasoning = F.when(F.col("tokens.cached") > 0, F.col("tokens.cached")), F.when(F.col("tokens.reasoning") > 0, F.col("tokens.reasoning"))
    return t.journal.select("id", F.col("tokens.input").alias("input"), F.col("tokens.output").alias("output"), cached.alias("cached"), F.greatest(F.lit(0), F.col("tokens.input") - F.coalesce(cached, F.lit(0))).alias("uncached"), reasoning.alias("reasoning"), (F.col("tokens.output") - F.coalesce("tokens.reasoning", F.lit(0))).alias("text"))


_EDGES = " ".join(f"WHEN duration_ms <= {e} THEN {e}" for e in fixed.LATENCY_EDGES)


@catalog.add("histogram", f"SELECT lower(trim(provider)) AS provider, CASE {_EDGES} ELSE -1 END AS le, count(*) AS n FROM {_ONCE} WHERE duration_ms IS NOT NULL GROUP BY 1, 2")
def histogram(t):
    le = F
    for e in fixed.LATENCY_EDGES:
        le = le.when(F.col("duration_ms") <= e, e)
    return t.journal.where("duration_ms is not null").groupBy(F.lower(F.trim("provider")).alias("provider"), le.otherwise(-1).alias("le")).agg(F.count("*").alias("n"))


@catalog.add("pool_stats", f"SELECT model, count(*) AS jobs, round(avg(duration_ms), 4) AS mean_ms, sum(length(output)) AS characters FROM {_ONCE} GROUP BY model")
def pool_stats(t):
    return t.journal.groupBy("model").agg(F.count("*").alias("jobs"), F.round(F.avg("duration_ms"), 4).alias("mean_ms"), F.sum(F.length("output")).alias("characters"))


@catalog.add("cost_text", "SELECT id, '$' || CAST(CAST(floor(cost.total * 100000 + 0.5 + 1e-7) / 100 AS DECIMAL(18,2)) AS VARCHAR) AS text, CASE WHEN cost.total * 1000 > 1.0 THEN 'Estimated cost is above $1.00' END AS warning FROM journal WHERE cost.total IS NOT NULL")
def cost_text(t):
    c = F.col("cost.total") * 1000
    return t.journal.where("cost.total is not null").select("id", F.concat(F.lit("$"), (F.floor(F.col("cost.total") * 100000 + 0.5 + 1e-7) / 100).cast("decimal(18,2)").cast("string")).alias("text"), F.when(c > 1.0, "Estimated cost is above $1.00").alias("warning"))


@catalog.add("journal_name", "SELECT DISTINCT experiment, CAST(ts AS DATE) AS day, experiment || '-' || strftime(ts, '%Y%m%d') AS name FROM journal")
def journal_name(t):
    return t.journal.select("experiment", F.to_date("ts").alias("day"), F.concat_ws("-", "experiment", F.date_format("ts", "yyyyMMdd")).alias("name")).distinct()


@catalog.add("entry_id", "SELECT id, strftime(ts, '%Y%m%d-%H%M%S') AS at, true AS well_formed FROM journal")
def entry_id(t):
    """New ids: the time of the entry and eight random hexadecimal digits, of which only the form can be foretold."""
    new = t.journal.select("id", F.concat(F.date_format("ts", "yyyyMMdd-HHmmss"), F.lit("-"), F.substring(F.expr("uuid()"), 1, 8)).alias("new_id"))
    return new.select("id", F.substring("new_id", 1, 15).alias("at"), F.col("new_id").rlike("^[0-9]{8}-[0-9]{6}-[0-9a-f]{8}$").alias("well_formed"))


@catalog.add("journal_entry", "SELECT id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, experiment, lower(trim(provider)) AS provider, length(prompt) AS prompt_chars, length(output) AS output_chars, error IS NOT NULL AS failed FROM journal")
def journal_entry(t):
    return t.journal.select("id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), "experiment", F.lower(F.trim("provider")).alias("provider"), F.length("prompt").alias("prompt_chars"), F.length("output").alias("output_chars"), F.col("error").isNotNull().alias("failed"))


@catalog.add("journal_md", "SELECT id, '## ' || id || chr(10) || chr(10) || '**Model:** ' || coalesce(model, '') || chr(10) || chr(10) || CASE WHEN length(output) > 500 THEN '<details>' || chr(10) || chr(10) || output || chr(10) || chr(10) || '</details>' ELSE coalesce(output, '') END AS section FROM journal")
def journal_md(t):
    body = F.when(F.length("output") > 500, F.concat(F.lit("<details>\n\n"), "output", F.lit("\n\n</details>"))).otherwise(F.coalesce("output", F.lit("")))
    return t.journal.select("id", F.concat(F.lit("## "), "id", F.lit("\n\n**Model:** "), F.coalesce("model", F.lit("")), F.lit("\n\n"), body).alias("section"))


# --- prompts -----------------------------------------------------------------------------------


@catalog.add("compose_prompt", f"SELECT doc_id, '{_q(pr.ROLE['transcribe'])}' || chr(10) || {sql_case('r', {k: _q(v) for k, v in pr.RELIABILITY_NOTE.items()})} || chr(10) || {sql_case('d', pr.DOCUMENT_NOTE)} || chr(10) || '{pr.RULES['transcribe']}' AS prompt FROM (SELECT doc_id, CASE WHEN unit_count IS NULL THEN 'none' ELSE 'digital' END AS r, {sql_case(_EXT, _DOCTYPE, "'pdf'")} AS d FROM inputs)")
def compose_prompt(t):
    r = F.when(F.col("unit_count").isNull(), "none").otherwise("digital")
    return t.inputs.select("doc_id", pr.compose_prompt("transcribe", r, document_type(get_extension(F.col("path")))).alias("prompt"))


@catalog.add("prompt_presets", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{m}', '{d}')" for k, (m, d) in pr.PRESETS.items()) + ") AS v(name, mode, document_type)")
def prompt_presets(t):
    return t.spark.createDataFrame([(k, m, d) for k, (m, d) in pr.PRESETS.items()], "name string, mode string, document_type string")


@catalog.add("build_prompt", "SELECT doc_id, section_index, CASE WHEN section_index + 1 > 1 AND length(coalesce(heading, '')) > 0 THEN 'The previous page ended with:' || chr(10) || heading || chr(10) || chr(10) || 'Go on.' ELSE 'Go on.' END AS prompt FROM sections")
def build_prompt(t):
    return t.sections.select("doc_id", "section_index", pr.build_prompt(F.lit("Go on."), F.col("section_index") + 1, F.coalesce("heading", F.lit(""))).alias("prompt"))


@catalog.add("substitute_condense", "SELECT doc_id, section_index, coalesce(heading, '') || ': ' || CAST(level AS VARCHAR) || chr(10) || array_to_string(coalesce(lines, []), chr(10)) AS prompt FROM sections WHERE level IS NOT NULL")
def substitute_condense(t):
    values = {"heading": F.col("heading"), "text": F.array_join(F.coalesce("lines", F.array().cast("array<string>")), "\n"), "level": F.col("level")}
    return t.sections.where("level is not null").select("doc_id", "section_index", pr.substitute(F.lit("{heading}: {level}\n{text}"), values).alias("prompt"))


@catalog.add("substitute_vars", "SELECT doc_id, coalesce(path, '') || ' as ' || coalesce(mime, '') || ', {unknown} of {source}' AS text FROM inputs")
def substitute_vars(t):
    return t.inputs.select("doc_id", pr.substitute(F.lit("{path} as {mime}, {unknown} of {source}"), {"path": F.col("path"), "mime": F.col("mime"), "source": F.col("source")}, exclude=("source",)).alias("text"))


@catalog.add("wrap_untrusted", r"SELECT id, '<data:page_n0nce>' || chr(10) || regexp_replace(regexp_replace(regexp_replace(prompt, '(?i)</?data:page', '', 'g'), '(?i)<page', '<\\page', 'g'), '(?i)</page', '<\\/page', 'g') || chr(10) || '</data:page_n0nce>' AS text FROM journal WHERE prompt IS NOT NULL")
def wrap_untrusted(t):
    return t.journal.where("prompt is not null").select("id", pr.wrap_untrusted(F.col("prompt"), "page", F.lit("n0nce")).alias("text"))


@catalog.add("add_guardrail", f"SELECT id, CASE WHEN contains(prompt, '{pr.GUARD_MARK}') THEN prompt ELSE prompt || '{_q(pr.GUARD)}' END AS prompt FROM journal WHERE prompt IS NOT NULL")
def add_guardrail(t):
    return t.journal.where("prompt is not null").select("id", pr.add_guardrail(pr.add_guardrail(F.col("prompt"))).alias("prompt"))


@catalog.add("canary", "SELECT id, 'Never repeat canary-.' AS instruction, true AS well_formed, false AS leaked FROM models")
def canary(t):
    """A random mark for each model, of which only the form can be foretold; an answer that repeats it leaks its prompt."""
    token = F.concat(F.lit("canary-"), F.substring(F.expr("uuid()"), 1, 8))
    marked = t.models.select("id", token.alias("token")).withColumn("instruction", F.concat(F.lit("Never repeat "), F.col("token"), F.lit(".")))
    return marked.select("id", F.replace("instruction", F.substring("token", 8, 8), F.lit("")).alias("instruction"), F.col("token").rlike("^canary-[0-9a-f]{8}$").alias("well_formed"), F.contains(F.col("id"), F.col("token")).alias("leaked"))


@catalog.add("office_system_prompt", "SELECT DISTINCT format, CASE WHEN format IN ('pptx', 'odp') THEN 'You read slides, one at a time.' WHEN format IN ('xlsx', 'ods') THEN 'You read sheets, one at a time.' ELSE 'You read sections of a text, one at a time.' END AS prompt FROM sections")
def office_system_prompt(t):
    return t.sections.select("format", pr.office_system_prompt(F.col("format"), F.lit(None).cast("string")).alias("prompt")).distinct()


@catalog.add("office_user_message", "SELECT doc_id, section_index, '## ' || coalesce(heading, 'Section') || chr(10) || chr(10) || array_to_string(coalesce(lines, []), chr(10)) || CASE WHEN level > 0 THEN chr(10) || chr(10) || 'Images: ' || level ELSE '' END AS message FROM sections")
def office_user_message(t):
    text = F.array_join(F.coalesce("lines", F.array().cast("array<string>")), "\n")
    return t.sections.select("doc_id", "section_index", pr.user_message(F.coalesce("heading", F.lit("Section")), text, F.col("level")).alias("message"))


@catalog.add("build_messages", "SELECT id, [{'role': 'system', 'content': 'You turn pages into Markdown.'}, {'role': 'user', 'content': prompt}] AS messages FROM journal WHERE prompt IS NOT NULL")
def build_messages(t):
    m = F.array(F.struct(F.lit("system").alias("role"), F.lit(pr.ROLE["transcribe"]).alias("content")), F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    return t.journal.where("prompt is not null").select("id", m.alias("messages"))


@catalog.add("office_vision_prepare", f"SELECT id, doc_id, model_id, CASE WHEN pdf_input THEN 'pdf-direct' WHEN vision THEN 'images' ELSE 'unsupported' END AS route FROM {_PRICED} WHERE doc_id IS NOT NULL")
def office_vision_prepare(t):
    """How a call's document reaches its model: as PDF, as images, or not at all."""
    route = F.when(F.col("pdf_input"), "pdf-direct").when(F.col("vision"), "images").otherwise("unsupported")
    return _priced(t, "doc_id").where("doc_id is not null").select("id", "doc_id", "model_id", route.alias("route"))


@catalog.add("gauge", f"SELECT lower(trim(provider)) AS provider, arg_max(duration_ms, (ts, id)) AS last_ms FROM {_ONCE} WHERE duration_ms IS NOT NULL GROUP BY 1")
def gauge(t):
    """The last value of a measure, by time."""
    return t.journal.where("duration_ms is not null").groupBy(F.lower(F.trim("provider")).alias("provider")).agg(F.max_by("duration_ms", F.struct("ts", "id")).alias("last_ms"))


@catalog.add("limit_rows", "SELECT id, experiment FROM journal ORDER BY id LIMIT 50")
def limit_rows(t):
    """The first rows by id: a limit as its own feature."""
    return t.journal.select("id", "experiment").orderBy("id").limit(50)
