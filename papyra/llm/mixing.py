"""Problem 8: mix sources to target weights.

Weights come from temperature mixing: token shares are raised to an exponent that is bisected until a
target entropy or the limit on repetition is met. Where target shares are given, the family of mixtures
leads from the natural shares (exponent 0) to the targets (exponent 1), and the largest exponent that the
repetition limits allow is taken: 1, so the targets themselves, unless a budget asks for more than they can
fill. Each source's documents are dealt in whole permutations (epochs), the last one cut at the budget.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm import tokens
from papyra.session import cut_lineage

#: Documents of a permutation are summed in so many blocks; only the block at the cut is read row by row.
BLOCKS = 1 << 14
#: Sources are few: their sizes are read by the driver.
SOURCES = 10_000


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to an exponent and normalised: 1 keeps them, 0 makes all equal."""
    x = {k: v**exponent for k, v in shares.items() if v > 0}
    total = sum(x.values())
    return {k: v / total for k, v in x.items()}


def bisect_exponent(ok, lo: float = 0.0, hi: float = 1.0, steps: int = 60) -> float:
    """The smallest exponent in [lo, hi] for which ok holds (ok must hold at hi and be monotone)."""
    if ok(lo):
        return lo
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if ok(mid) else (mid, hi)
    return hi


def temperature_weights(sizes: dict[str, int], target_entropy: float | None = None, budget: int | None = None, max_repeats: dict[str, int] | None = None) -> dict[str, float]:
    """Weights by one exponent for all sources: down to a target entropy, or as even as the repetition limits allow."""
    total = sum(sizes.values())
    shares = {k: n / total for k, n in sizes.items() if n > 0}
    if not shares:
        return {}
    if target_entropy is not None:
        return tempered(shares, bisect_exponent(lambda a: entropy(tempered(shares, a)) <= target_entropy))
    need, limit = budget or total, max_repeats or {}
    return tempered(shares, bisect_exponent(lambda a: all(w * need <= limit.get(k, 1) * sizes[k] for k, w in tempered(shares, a).items())))


@dataclass
class Mixture:
    """Tokens to draw from each source, and the exponent that gave them: what it met, and the entropy it has."""

    draw: dict[str, int]
    exponent: float
    met: str

    @property
    def entropy(self) -> float:
        total = sum(self.draw.values())
        return entropy({k: n / total for k, n in self.draw.items()}) if total else 0.0


def blend(sizes: dict[str, int], targets: dict[str, float] | None, max_repeats: dict[str, int], budget: int | None = None, target_entropy: float | None = None) -> Mixture:
    """The mixture of sources of these sizes.

    With targets: weights proportional to natural^(1 - b) target^b, for the largest exponent b in [0, 1] at
    which no source needs more than its repeats (failing even at 0, each source at its limit). Without a
    budget the total is the largest at which every source reaches its target share, where b is 1. A source
    without tokens gets none, and the others share its part. Without targets: natural shares to the
    power that meets target_entropy, or else the smallest that the repetition limits allow.
    """
    live = {k: n for k, n in sizes.items() if n > 0 and max_repeats.get(k, 1) > 0 and (targets is None or targets.get(k, 0) > 0)}
    if not live:
        return Mixture({}, 1.0, "nothing")
    caps = {k: n * max_repeats.get(k, 1) for k, n in live.items()}
    most = sum(caps.values())
    if targets is None:
        size = min(budget or sum(live.values()), most)
        w = temperature_weights(live, target_entropy, size, max_repeats)
        a, b = max(live, key=live.get), min(live, key=live.get)
        exponent = math.log(w[a] / w[b]) / math.log(live[a] / live[b]) if live[a] > live[b] else 1.0
        return Mixture({k: min(caps[k], round(x * size)) for k, x in w.items()}, exponent, "repetition limit" if target_entropy is None else "entropy")
    norm = sum(targets[k] for k in live)
    goal = {k: targets[k] / norm for k in live}
    feasible = min(caps[k] / goal[k] for k in live)
    size = min(feasible if budget is None else budget, most)
    natural = {k: caps[k] / most for k in live}

    def at(beta: float) -> dict[str, float]:
        x = {k: natural[k] ** (1 - beta) * goal[k] ** beta for k in live}
        total = sum(x.values())
        return {k: v / total for k, v in x.items()}

    beta = 1 - bisect_exponent(lambda b: all(w * size <= caps[k] * (1 + 1e-9) for k, w in at(1 - b).items()))
    return Mixture({k: min(caps[k], round(w * size)) for k, w in at(beta).items()}, beta, "targets" if beta == 1 else "repetition limit")


def mixture(sizes: dict[str, int], targets: dict[str, float], max_repeats: dict[str, int], budget: int | None = None) -> dict[str, int]:
    """Tokens to draw from each source (blend)."""
    return blend(sizes, targets, max_repeats, budget).draw


def source_name(source: Column) -> Column:
    """One spelling for each source: small letters, hyphens, no white space around it."""
    return F.translate(F.lower(F.trim(source)), "_ ", "--")


def mix(documents: DataFrame, targets: DataFrame | None, budget: int | None = None, seed: int = 0, vocabulary: str = tokens.VOCABULARY, text: str = "text", key: str = "doc_id", target_entropy: float | None = None, max_repeats: int = 4) -> DataFrame:
    """doc_id, source, epoch, n_tokens, order: the drawn set, one row for each use of a document (mix_and_plan)."""
    return mix_and_plan(documents, targets, budget, seed, vocabulary, text, key, target_entropy, max_repeats)[0]


def mix_and_plan(documents: DataFrame, targets: DataFrame | None, budget: int | None = None, seed: int = 0, vocabulary: str = tokens.VOCABULARY, text: str = "text", key: str = "doc_id", target_entropy: float | None = None, max_repeats: int = 4) -> tuple[DataFrame, Mixture]:
    """(doc_id, source, epoch, n_tokens, order: the drawn set, one row for each use of a document; its mixture).

    Sources are matched by source_name; documents of no named source and empty texts are not drawn.
    Epoch e of a source is one permutation of all its documents (by a hash of seed, epoch and key);
    only its last epoch is cut, at the first document that would exceed the source's tokens. order
    shuffles the whole set. Targets (source, target_share, max_repeats) are a small table; an empty one
    draws nothing. None instead of a table means temperature mixing of all sources, to target_entropy or as even as
    max_repeats allows; there may be at most SOURCES of them.
    """
    spark = documents.sparkSession
    empty = spark.createDataFrame([], f"{key} long, source string, epoch int, n_tokens long, order long")
    docs = documents.select(key, source_name(F.col("source")).alias("source"), F.col(text).alias("__text")).where("source is not null")
    goal = None
    if targets is not None:
        rows = targets.select(source_name(F.col("source")).alias("s"), F.col("target_share").alias("w"), F.coalesce("max_repeats", F.lit(1)).alias("m")).where("s is not null and w > 0").collect()
        goal = {r.s: (r.w, r.m) for r in rows}
        if not goal:
            return empty, Mixture({}, 1.0, "nothing")
        docs = docs.where(F.col("source").isin(*goal))
    docs = cut_lineage(docs.select(key, "source", F.coalesce(tokens.token_count("__text", vocabulary), F.lit(0)).alias("n_tokens")).where("n_tokens > 0"))
    sizes = {r.source: r.n for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("n")).limit(SOURCES + 1).collect()}
    if len(sizes) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources: name them in targets")
    made = blend(sizes, None if goal is None else {k: w for k, (w, _) in goal.items()}, {k: max_repeats for k in sizes} if goal is None else {k: m for k, (_, m) in goal.items()}, budget, target_entropy)
    draw = made.draw
    if not draw:
        return empty, made
    whole = {k: n // sizes[k] for k, n in draw.items()}
    rest = {k: n - whole[k] * sizes[k] for k, n in draw.items()}

    def by_source(table: dict[str, int]) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, int(v))]), F.col("source"))

    docs = docs.where(F.col("source").isin(*draw)).withColumn("__whole", by_source(whole)).withColumn("__rest", by_source(rest))
    full = docs.where("__whole > 0").select(key, "source", F.explode(F.sequence(F.lit(0), (F.col("__whole") - 1).cast("int"))).alias("epoch"), "n_tokens")
    # the cut epoch: blocks of the permutation are summed, whole blocks before the cut taken, one block read in order
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("__whole"), F.col(key)), F.lit(1 << 40))
    last = docs.where("__rest > 0").withColumn("__place", place).withColumn("__block", F.shiftright("__place", 40 - (BLOCKS.bit_length() - 1)))
    blocks = last.groupBy("source", "__block").agg(F.sum("n_tokens").alias("k"))
    running = blocks.withColumn("__before", F.coalesce(F.sum("k").over(Window.partitionBy("source").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("source", "__block", "__before", "k")
    last = last.join(running, ["source", "__block"])
    inside = last.where("__before + k <= __rest")
    at_cut = last.where("__before <= __rest and __before + k > __rest").withColumn("__sum", F.col("__before") + F.sum("n_tokens").over(Window.partitionBy("source", "__block").orderBy("__place", key).rowsBetween(Window.unboundedPreceding, 0))).where("__sum <= __rest")
    cut = [df.select(key, "source", F.col("__whole").cast("int").alias("epoch"), "n_tokens") for df in (inside, at_cut)]
    drawn = full.unionByName(cut[0]).unionByName(cut[1])
    return drawn.withColumn("order", F.xxhash64(F.lit(seed), "epoch", key)), made


def mix_report(drawn: DataFrame, targets: DataFrame, made: Mixture | None = None) -> DataFrame:
    """source, target_share, max_repeats, uses, tokens, actual_share, most_repeats; sources without a document included.

    made adds the exponent, what it met and the entropy of the mixture.
    """
    goal = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").distinct()
    got = drawn.groupBy("source").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("tokens"), (F.max("epoch") + 1).alias("most_repeats"))
    g = goal.join(got, "source", "left").withColumns({"uses": F.coalesce("uses", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0)), "most_repeats": F.coalesce("most_repeats", F.lit(0))})
    # one row for each source of the targets, which is a small table
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    g = g.withColumn("actual_share", F.round(F.col("tokens") / F.nullif(total, F.lit(0)), 6))
    return g if made is None else g.withColumns({"exponent": F.lit(float(made.exponent)), "met": F.lit(made.met), "entropy": F.lit(round(made.entropy, 6))})
