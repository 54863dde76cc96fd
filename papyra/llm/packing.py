"""Problem 7: fill containers of fixed capacity with items of varying length.

The plan is made on the histogram of lengths, which the capacity bounds: combinations of few lengths
that fill a window below the capacity get repeat counts by non-negative least squares, rounded down;
what they leave is packed greedily, pattern by pattern, each repeated until one of its lengths is
used up. Items are then dealt to the plan's slots by their rank among items of the same length.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm import tokens
from papyra.session import cut_lineage

#: Combinations hold at most DEPTH lengths and leave at most this part of the capacity unused.
DEPTH = 3
WINDOW = 0.004
#: Combinations tried for each longest length, and sweeps of the solver.
PER_LENGTH = 12
SWEEPS = 60
#: Ranks are counted in parts of each length of about so many items, so that a frequent length is no hot group.
PART_ITEMS = 50_000

PIECE = "array<struct<piece_index:int,start_token:long,end_token:long>>"


@dataclass
class Pattern:
    """So many containers, each with these (length, how often)."""

    times: int
    items: list[tuple[int, int]]


def combinations(counts: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Tuples of at most DEPTH present lengths, longest first, that fill the window below the capacity."""
    lengths = sorted(counts)
    slack = max(1, int(capacity * WINDOW))
    found: list[tuple[int, ...]] = []
    for a in reversed(lengths):
        if a * DEPTH < capacity - slack:
            break
        mine: list[tuple[int, ...]] = [(a,)] if a >= capacity - slack else []
        rest = capacity - a
        lo, hi = bisect.bisect_left(lengths, rest - slack), bisect.bisect_right(lengths, min(a, rest))
        mine += [(a, b) for b in lengths[max(lo, hi - PER_LENGTH) : hi]]
        # of three: the most frequent seconds, each with the thirds that fill best
        seconds = [b for b in lengths[: bisect.bisect_right(lengths, min(a, rest - 1))] if 2 * b >= rest - slack]
        for b in sorted(seconds, key=lambda x: (-counts[x], -x))[:PER_LENGTH]:
            left = rest - b
            lo, hi = bisect.bisect_left(lengths, left - slack), bisect.bisect_right(lengths, min(b, left))
            mine += [(a, b, c) for c in lengths[max(lo, hi - 2) : hi] if c > 0]
        found += sorted(mine, key=lambda t: (capacity - sum(t), len(t), t))[: 2 * PER_LENGTH]
    return found


def repeat_counts(counts: dict[int, int], columns: list[tuple[int, ...]]) -> np.ndarray:
    """Non-negative least squares by coordinate descent: how often each combination should be used."""
    use = [Counter(c) for c in columns]
    residual = {n: float(k) for n, k in counts.items()}
    x = np.zeros(len(columns))
    norm = [sum(m * m for m in u.values()) for u in use]
    for _ in range(SWEEPS):
        moved = 0.0
        for j, u in enumerate(use):
            step = max(-x[j], sum(m * residual[n] for n, m in u.items()) / norm[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for n, m in u.items():
                    residual[n] -= m * step
        if moved < 0.05:
            break
    return x


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that use every item once (lengths 1 to capacity). Their number is bounded by the lengths."""
    left = {n: k for n, k in counts.items() if 0 < n <= capacity and k > 0}
    out: list[Pattern] = []
    columns = combinations(left, capacity)
    if columns:
        x = repeat_counts(left, columns)
        for j in np.argsort([capacity - sum(c) for c in columns], kind="stable"):
            u = Counter(columns[j])
            times = min(int(x[j]), *(left.get(n, 0) // m for n, m in u.items()))
            if times > 0:
                out.append(Pattern(times, sorted(u.items(), reverse=True)))
                for n, m in u.items():
                    left[n] -= m * times
    lengths = sorted(n for n, k in left.items() if k > 0)
    while lengths:
        room, taken, hi = capacity, Counter(), len(lengths)
        while room > 0:
            i = bisect.bisect_right(lengths, room, 0, hi) - 1
            if i < 0:
                break
            n = lengths[i]
            # the last places go to the two lengths that fill them best, if nothing longer could follow
            if pair := _last_pair(lengths, left, taken, room, hi):
                taken.update(pair)
                break
            m = min(room // n, left[n] - taken[n])
            taken[n] += m
            room -= n * m
            hi = i
        times = min(left[n] // m for n, m in taken.items() if m)
        out.append(Pattern(times, sorted((n, m) for n, m in taken.items() if m)[::-1]))
        for n, m in taken.items():
            left[n] -= m * times
            if not left[n]:
                del lengths[bisect.bisect_left(lengths, n)]
    return out


def _last_pair(lengths: list[int], left: dict[int, int], taken: Counter[int], room: int, hi: int) -> tuple[int, int] | None:
    """Two lengths that fill the room exactly, searched among the longest that fit, once three more would not fit well."""
    at = bisect.bisect_right(lengths, room, 0, hi) - 1
    for k in range(at, max(-1, at - 64), -1):
        a = lengths[k]
        if left[a] - taken[a] < 1:
            continue
        b = room - a
        if b > a or b < 1:
            continue
        j = bisect.bisect_left(lengths, b)
        if j < len(lengths) and lengths[j] == b and left[b] - taken[b] - (a == b) >= 1:
            return a, b
    return None


def pieces_of(documents: DataFrame, text: str, key: str, capacity: int, size: str) -> DataFrame:
    """key, piece_index, start_token, end_token: a text is split only where it exceeds the capacity alone."""
    n = F.greatest(F.lit(1), F.ceil(F.col(size) / F.lit(capacity)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("piece_index"), (i.cast("long") * capacity).alias("start_token"), F.least(F.col(size).cast("long"), (i.cast("long") + 1) * capacity).alias("end_token")))
    return documents.select(key, F.explode(cut).alias("p")).select(key, "p.*")


def pack(items: DataFrame, key: list[str], size: str, capacity: int) -> DataFrame:
    """items with container (bigint) and position (int): items of up to capacity, each in exactly one container.

    Items of size 0 or null take no space: their container and position are null. Equal sizes are
    interchangeable and dealt in the order of a hash of their key. An item above the capacity is
    refused: split it first. Columns named container or position are replaced.
    """
    base = items.drop("container", "position").withColumn("__n", F.coalesce(F.col(size).cast("long"), F.lit(0)))
    histogram = {int(r["__n"]): r["k"] for r in base.where("__n > 0").groupBy("__n").agg(F.count("*").alias("k")).where(F.col("__n") <= capacity).toLocalIterator()}
    if base.where(F.col("__n") > capacity).limit(1).count():
        raise ValueError("an item exceeds the capacity")
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter[int] = Counter()
    first = 0
    for p in plan(histogram, capacity):
        position = 0
        for n, m in p.items:
            slots.setdefault(n, []).append((used[n], first, m, position))
            used[n] += m * p.times
            position += m
        first += p.times
    shared = items.sparkSession.sparkContext.broadcast({n: np.array(v, dtype=np.int64) for n, v in slots.items()})

    @F.pandas_udf("struct<container:long,position:int>")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for sizes, ranks in batches:
            container, position = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int32)
            n, at = sizes.to_numpy(), ranks.to_numpy()
            order = np.argsort(n, kind="stable")
            edges = np.flatnonzero(np.diff(n[order], prepend=-1))
            for mine in np.split(order, edges[1:]) if len(order) else []:
                s = shared.value[int(n[mine[0]])]
                i = np.searchsorted(s[:, 0], at[mine], side="right") - 1
                step = at[mine] - s[i, 0]
                container[mine] = s[i, 1] + step // s[i, 2]
                position[mine] = s[i, 3] + step % s[i, 2]
            yield pd.DataFrame({"container": container, "position": position})

    # rank among equal lengths, counted within parts and offset by the parts before
    parts = max(16, max(histogram.values(), default=0) // PART_ITEMS)
    parted = base.where("__n > 0").withColumn("__part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))
    sums = parted.groupBy("__n", "__part").agg(F.count("*").alias("k"))
    before = sums.select("__n", "__part", F.coalesce(F.sum("k").over(Window.partitionBy("__n").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    ranked = parted.withColumn("__rank", F.row_number().over(Window.partitionBy("__n", "__part").orderBy(F.xxhash64(*key), *key)) - 1).join(before, ["__n", "__part"])
    placed = ranked.withColumn("__p", place("__n", F.col("__rank") + F.col("__before"))).select(*base.columns[:-1], "__p.container", "__p.position")
    none = base.where("__n = 0").select(*base.columns[:-1], F.lit(None).cast("long").alias("container"), F.lit(None).cast("int").alias("position"))
    return placed.unionByName(none)


def pack_documents(documents: DataFrame, packs: DataFrame, vocabulary: str = tokens.VOCABULARY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """pack_name, container, position, doc_id, piece_index, start_token, end_token, n_tokens for every pack.

    packs: pack_name, capacity_tokens (a small table, read by the driver; rows without a positive
    capacity are left out). Null texts count as empty.
    """
    sized = cut_lineage(documents.select(key, F.coalesce(tokens.token_count(text, vocabulary), F.lit(0)).alias("__size")))
    out: DataFrame | None = None
    for r in packs.where("capacity_tokens > 0").select("pack_name", "capacity_tokens").distinct().orderBy("pack_name").collect():
        items = pieces_of(sized, text, key, r.capacity_tokens, "__size").withColumn("n_tokens", F.col("end_token") - F.col("start_token"))
        packed = pack(items, [key, "piece_index"], "n_tokens", r.capacity_tokens).select(F.lit(r.pack_name).alias("pack_name"), "container", "position", key, "piece_index", "start_token", "end_token", "n_tokens")
        out = packed if out is None else out.unionByName(packed)
    return out if out is not None else documents.sparkSession.createDataFrame([], f"pack_name string, container long, position int, {key} long, piece_index int, start_token long, end_token long, n_tokens long")


def pack_report(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """pack_name, capacity_tokens, containers, tokens, utilisation, fullest and emptiest fill."""
    fills = packed.where("container is not null").groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("fill"))
    g = fills.groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("fill").alias("tokens"), F.max("fill").alias("max_fill"), F.min("fill").alias("min_fill"))
    return g.join(packs.select("pack_name", "capacity_tokens").distinct(), "pack_name").withColumn("utilisation", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
