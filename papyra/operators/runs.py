"""Runs: maximal groups of consecutive like units, and what is summed over them.

All of it is one window over (document, unit) and one aggregate on the same keys, so that a single
exchange by document and unit order serves both; the aggregate on (document, run) is reduced map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra import fixed


def first_delivery(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: a redelivered row has the same content."""
    return df.dropDuplicates(keys)


def run_key(*parts: Column, separator: str = "|") -> Column:
    """Parts joined by the separator; a null part is the empty text, so that it isn't skipped."""
    return F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def build_runs(units: DataFrame, key: Column, doc: str = "doc_id", index: str = "unit_index", carry: dict[str, Column] | None = None) -> DataFrame:
    """doc, run_index, run_key, unit_indices and carried aggregates of every run.

    Units of equal key in a row are one run. A null key is a run of its own, named unit-i, and ends
    the run before it. Documents without units have no run. Repeated unit indices are kept in
    the order the index gives; ties among them are broken by the key.
    """
    order = Window.partitionBy(doc).orderBy(index, "__key")
    keyed = units.withColumn("__key", key)
    same = F.lag("__key").over(order).eqNullSafe(F.col("__key")) & F.col("__key").isNotNull()
    marked = keyed.withColumn("__new", F.when(same, 0).otherwise(1)).withColumn("run_index", (F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    extra = [c.alias(name) for name, c in (carry or {}).items()]
    return marked.groupBy(doc, "run_index").agg(
        F.coalesce(F.min("__key"), F.concat(F.lit("unit-"), F.min(index).cast("string"))).alias("run_key"),
        F.sort_array(F.collect_list(index)).alias("unit_indices"),
        *extra,
    )


def merge_runs_by_kind(runs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row for each document and kind: all its units, the language of its first run, by first appearance."""
    g = runs.groupBy(doc, "kind").agg(F.min("run_index").alias("first_run"), F.sort_array(F.flatten(F.collect_list("unit_indices"))).alias("unit_indices"), F.min_by("language", "run_index").alias("language"))
    return g.withColumn("position", (F.row_number().over(Window.partitionBy(doc).orderBy("first_run")) - 1).cast("int")).drop("first_run")


def run_stats(runs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Totals and, for each of the six kinds, runs and units (0 where there are none)."""
    counts = []
    for k in fixed.KINDS:
        name = k.replace("-", "_")
        counts += [F.count_if(F.col("kind") == k).alias(f"{name}_runs"), F.coalesce(F.sum(F.when(F.col("kind") == k, F.size("unit_indices"))), F.lit(0)).alias(f"{name}_units")]
    return runs.groupBy(doc).agg(F.count("*").alias("runs"), F.sum(F.size("unit_indices")).alias("units"), *counts)


def dominant_language(units: DataFrame, language: str = "language", doc: str = "doc_id", index: str = "unit_index") -> DataFrame:
    """doc, dominant_language: the language of most units, und and null left aside; the earlier wins a tie; none: und."""
    known = F.when(F.col(language) != "und", F.col(language))
    by = units.groupBy(doc, known.alias("lang")).agg(F.count("*").alias("n"), F.min(index).alias("first"))
    best = F.max_by("lang", F.when(F.col("lang").isNotNull(), F.struct("n", (-F.col("first")).alias("first"))))
    return by.groupBy(doc).agg(F.coalesce(best, F.lit("und")).alias("dominant_language"))


def complexity(units: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, pages, characters, images, has_ocr, has_mixed, has_tabular, score, level."""
    kind, chars = F.col("kind"), F.col("char_count")
    ocr = (kind == "image-only") | ((kind == "unknown") & (chars < fixed.HYBRID_CHARS)) | ((kind == "mixed") & (chars < 100))
    g = units.groupBy(doc).agg(
        F.count("*").alias("pages"), F.sum("char_count").alias("characters"), F.count_if(kind.isin("image-only", "mixed")).alias("images"),
        F.bool_or(F.coalesce(ocr, F.lit(False))).alias("has_ocr"), F.bool_or(kind == "mixed").alias("has_mixed"), F.bool_or(kind == "tabular").alias("has_tabular"),
    )
    points = 2.0 * F.col("pages") + F.col("characters") / F.lit(1000.0) + 5.0 * F.col("images") + F.when(F.col("has_ocr"), 20.0).otherwise(0.0) + F.when(F.col("has_mixed"), 10.0).otherwise(0.0) + F.when(F.col("has_tabular"), 5.0).otherwise(0.0)
    from papyra.functions.tokens import complexity_level

    return g.withColumn("score", F.least(F.lit(100), F.floor(points + 0.5)).cast("int")).withColumn("level", complexity_level(F.col("score")))


def concat_units(units: DataFrame, text: str = "text", separator: str = "\n\n", doc: str = "doc_id", index: str = "unit_index") -> DataFrame:
    """doc, text, unit_count: the units' texts in order, blank ones left out.

    The text of a document is one value by its nature: a document must fit into one row.
    """
    return units.groupBy(doc).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.length(F.regexp_replace(text, fixed.WS, "")) > 0, F.struct(index, text)))), lambda x: x[text]), separator).alias("text"), F.count("*").alias("unit_count"))
