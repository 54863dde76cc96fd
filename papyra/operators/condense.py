"""Map-reduce condensation of texts through an injected model client.

A client is a function of (system prompt, user prompt) that returns text; it must be picklable, as it runs
on executors. Documents that have reached their target leave the loop; each round is written to the
checkpoint folder, so that a lost executor does not bill earlier calls again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.operators import chunk as ch
from papyra.session import cut_lineage

Client = Callable[[str, str], str]
MAX_ROUNDS = 10
SYSTEM = "You shorten texts and keep facts, names and numbers."
MAP_PROMPT = "Shorten this part to about {target} characters.\n\n{text}"
REDUCE_PROMPT = "Join and shorten these summaries to about {target} characters.\n\n{text}"


def half_the_words(system: str, user: str) -> str:
    """Stand-in for a model: the first half of the words of the text, rounded up."""
    words = user.split("\n\n", 1)[-1].split()
    return " ".join(words[: (len(words) + 1) // 2])


def _call(client: Client, template: str) -> Callable:
    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, target in batches:
            yield pd.Series([client(SYSTEM, template.replace("{target}", str(int(n))).replace("{text}", t)) for t, n in zip(text, target)])

    return run


def _shorten(df: DataFrame, client: Client, template: str, budget: int, strategy: str, count: ch.Counter) -> DataFrame:
    """key, target, text shortened chunk by chunk, and the number of calls."""
    cut = df.select("key", "target", ch.chunks_column("text", budget, strategy, 0, count).alias("cs"))
    parts = cut.select("key", "target", F.size("cs").alias("n"), F.posexplode("cs").alias("i", "c"))
    share = F.ceil(F.col("target") / F.col("n") * F.lit(3.0)).cast("int")
    done = parts.select("key", "target", "i", _call(client, template)(F.col("c.text"), share).alias("t"))
    return done.groupBy("key", "target").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), "\n\n").alias("text"), F.count("*").alias("calls"))


def condense(texts: DataFrame, target: Column, client: Client = half_the_words, budget: int = 2000, strategy: str = "heading", count: ch.Counter = ch.count_words, max_rounds: int = MAX_ROUNDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, text, chars_in, chars_out, ratio, calls, rounds, passthrough for every text.

    Texts that fit the target (tokens) pass through unchanged. Others are mapped chunk by chunk and
    then reduced for at most max_rounds rounds, until they fit or stop shrinking. Blank and null
    texts pass through; the ratio of an empty text is 1.
    """
    counted = F.pandas_udf(lambda s: s.map(lambda x: count(x) if isinstance(x, str) else 0), "int")
    base = texts.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("source"), target.cast("int").alias("target")).withColumn("tokens", counted("source"))
    base = cut_lineage(base)
    through = base.where("tokens <= target").select("key", F.col("source").alias("text"), F.lit(0).cast("bigint").alias("calls"), F.lit(0).alias("rounds"), F.lit(True).alias("passthrough"))
    todo = base.where("tokens > target").select("key", "target", F.col("source").alias("text"))
    state = cut_lineage(_shorten(todo, client, MAP_PROMPT, budget, strategy, count).withColumn("tokens", counted("text")))
    finished: list[DataFrame] = []
    for round_ in range(max_rounds + 1):
        ready = (F.col("tokens") <= F.col("target")) | (F.lit(round_ == max_rounds))
        finished.append(state.where(ready).select("key", "text", "calls", F.lit(round_).alias("rounds")))
        open_ = state.where(~ready)
        if round_ == max_rounds or open_.isEmpty():
            break
        before = open_.select("key", F.col("tokens").alias("was"), F.col("calls").alias("calls_before"))
        shorter = _shorten(open_.select("key", "target", "text"), client, REDUCE_PROMPT, budget, "paragraph", count).withColumn("tokens", counted("text"))
        shorter = cut_lineage(shorter.join(before, "key").withColumn("calls", F.col("calls") + F.col("calls_before")))
        stuck = shorter.where("tokens >= was")
        finished.append(stuck.select("key", "text", "calls", F.lit(round_ + 1).alias("rounds")))
        state = shorter.where("tokens < was").select("key", "target", "text", "calls", "tokens")
    done = finished[0]
    for d in finished[1:]:
        done = done.unionByName(d)
    out = through.unionByName(done.withColumn("passthrough", F.lit(False)))
    return out.join(base.select("key", F.length("source").alias("chars_in")), "key").select(
        F.col("key").alias(key), "text", "chars_in", F.length("text").alias("chars_out"), F.when(F.col("chars_in") == 0, 1.0).otherwise(F.round(F.length("text") / F.col("chars_in"), 6)).alias("ratio"), "calls", "rounds", "passthrough"
    )
