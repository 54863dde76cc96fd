"""Reports of one row for each document or source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra import fixed
from papyra.functions import classify as cl
from papyra.functions import text as tx
from papyra.functions import tokens as tk
from papyra.operators import runs as op

#: Units of a source are numbered within parts of so many documents, so that no source is one task's work.
PART = 1000


def _in_parts(documents: DataFrame) -> DataFrame:
    """The documents with the one spelling of their source's name and the number of their part of it."""
    name = F.translate(F.lower(F.trim("source")), "_ ", "--")
    return documents.withColumn("source", F.when(F.length(name) > 0, name).otherwise("none")).withColumn("number", F.floor(F.col("doc_id") / PART))


def documents_as_units(documents: DataFrame) -> DataFrame:
    """Documents as units of their source: doc_id is a part of a source, unit_index the place within it."""
    part = F.concat_ws("#", "source", F.col("number").cast("string"))
    chars = tx.char_count(F.col("text"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("doc_id")) - 1
    return _in_parts(documents).withColumn("part", part).select(F.col("part").alias("doc_id"), "source", "number", place.cast("int").alias("unit_index"), cl.classify_office(chars, F.lit(0)).alias("kind"), chars.alias("char_count"), F.col("lang").alias("language"), tk.text_tokens(F.col("text")).alias("tokens"))


def _part_runs(documents: DataFrame) -> DataFrame:
    """The runs within each part of a source, with the sums over their units."""
    units = documents_as_units(documents)
    ocr = (F.col("kind") == "image-only") | ((F.col("kind") == "unknown") & (F.col("char_count") < fixed.HYBRID_CHARS)) | ((F.col("kind") == "mixed") & (F.col("char_count") < 100))
    carry = {
        "n": F.count("*"), "chars": F.sum("char_count"), "tokens": F.sum("tokens"), "images": F.count_if(F.col("kind").isin("image-only", "mixed")), "ocr": F.count_if(ocr),
        "lang": F.first("language"), "start": F.min("unit_index"), "source": F.first("source"), "number": F.first("number"),
    }
    return op.build_runs(units, op.run_key(F.col("kind"), F.col("language")), carry=carry)


def _known_lang() -> Column:
    return F.when(F.col("lang") != "und", F.col("lang"))


def _report(by_lang: DataFrame, key: str) -> DataFrame:
    """One row for each key from its sums by language; start is the place of a language's first unit."""
    g = by_lang.groupBy(key).agg(
        F.sum("n").alias("unit_count"), F.sum("runs").alias("run_count"), F.sum("chars").alias("characters"), F.sum("tokens").alias("tokens"), F.sum("images").alias("images"), F.sum("ocr").alias("ocr"),
        F.coalesce(F.max_by("lang", F.when(F.col("lang").isNotNull(), F.struct("n", (-F.col("start")).alias("s")))), F.lit("und")).alias("dominant_language"),
    )
    points = 2.0 * F.col("unit_count") + F.col("characters") / 1000.0 + 5.0 * F.col("images") + F.when(F.col("ocr") > 0, 20.0).otherwise(0.0)
    score = F.least(F.lit(100), F.floor(points + 0.5)).cast("int")
    cost = F.col("tokens") / 1e6 * fixed.DEFAULT_PRICE["input"] + F.col("tokens") / 1e6 * fixed.DEFAULT_PRICE["output"]
    return g.select(key, "unit_count", "run_count", "characters", "tokens", score.alias("score"), tk.complexity_level(score).alias("level"), "dominant_language", F.round(cost, 6).alias("cost"))


def source_report(documents: DataFrame) -> DataFrame:
    """Units, runs, complexity, language, tokens and cost of every source, one row each.

    Parts are only a first aggregation. Each keeps the sums by language and the keys of its first and last
    run; the parts before it give its offset, and a run that goes on from the part before is counted there.
    """
    sums = ("n", "chars", "tokens", "images", "ocr")
    by_lang = _part_runs(documents).groupBy("source", "number", _known_lang().alias("lang")).agg(
        *[F.sum(k).alias(k) for k in sums], F.count("*").alias("runs"), F.min("start").alias("start"), F.min_by("run_key", "run_index").alias("first_key"), F.max_by("run_key", "run_index").alias("last_key"), F.max("run_index").alias("last_run"),
    )
    by_part = by_lang.groupBy("source", "number").agg(
        F.collect_list(F.struct("lang", *sums, "runs", "start")).alias("langs"), F.sum("n").alias("units"), F.min_by("first_key", "start").alias("first_key"), F.max_by("last_key", "last_run").alias("last_key"),
    )
    # windows over one row for each part of a source
    order = Window.partitionBy("source").orderBy("number")
    offset = F.coalesce(F.sum("units").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    goes_on = F.coalesce((F.lag("last_key").over(order) == F.col("first_key")).cast("int"), F.lit(0))
    placed = by_part.select("source", "langs", offset.alias("offset"), goes_on.alias("goes_on")).select("source", "offset", "goes_on", F.posexplode("langs").alias("i", "x"))
    # a part's first run is counted off once, at whichever language stands first
    runs = F.col("x.runs") - F.when(F.col("i") == 0, F.col("goes_on")).otherwise(0)
    merged = placed.select("source", *[f"x.{k}" for k in ("lang", *sums)], runs.alias("runs"), (F.col("offset") + F.col("x.start")).alias("start"))
    return _report(merged.groupBy("source", "lang").agg(*[F.sum(k).alias(k) for k in (*sums, "runs")], F.min("start").alias("start")), "source")
