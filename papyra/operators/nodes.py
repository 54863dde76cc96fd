"""Office documents as flattened nodes: (doc_id, unit_index, node_id, parent_id, preorder, depth, type, text).

Spark has no recursive type, so a tree is rows with the position of each node in a walk from the root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.text import trim_ws

SCHEMA = "doc_id long, unit_index int, node_id int, parent_id int, preorder int, depth int, type string, text string"


def section_nodes(sections: DataFrame) -> DataFrame:
    """Nodes of sections: a section node, its heading, and a paragraph for each line (a note below '[Speaker Notes]')."""
    s = sections.dropDuplicates(["doc_id", "section_index"])
    lines = F.transform(F.coalesce("lines", F.array().cast("array<string>")), lambda x: F.struct(F.when(F.startswith(x, F.lit("[Image")), "image").when(F.startswith(x, F.lit("[Speaker")), "note").otherwise("paragraph").alias("type"), x.alias("text")))
    head = F.when(F.length("heading") > 0, F.array(F.struct(F.lit("heading").alias("type"), F.col("heading").alias("text")))).otherwise(F.expr("cast(array() as array<struct<type:string,text:string>>)"))
    root = F.array(F.struct(F.lit("section").alias("type"), F.lit(None).cast("string").alias("text")))
    flat = s.select("doc_id", F.col("section_index").alias("unit_index"), F.posexplode(F.concat(root, head, lines)).alias("preorder", "n"))
    return flat.select("doc_id", "unit_index", F.col("preorder").alias("node_id"), F.when(F.col("preorder") > 0, 0).alias("parent_id"), "preorder", F.when(F.col("preorder") > 0, 1).otherwise(0).alias("depth"), "n.type", "n.text")


def find_nodes(nodes: DataFrame, type_: str) -> DataFrame:
    return nodes.where(F.col("type") == type_)


def nodes_text(nodes: DataFrame, separator: str = "\n", notes: bool = False) -> DataFrame:
    """doc_id, unit_index, text: trimmed, non-empty texts in walking order; leaves of type text are skipped."""
    kept = nodes.where((F.col("type") == "note") if notes else ~F.col("type").isin("text", "note")).withColumn("text", trim_ws(F.col("text")))
    pairs = F.sort_array(F.collect_list(F.when(F.length("text") > 0, F.struct("preorder", "text"))))
    return kept.groupBy("doc_id", "unit_index").agg(F.array_join(F.transform(pairs, lambda x: x["text"]), separator).alias("text"))


def split_at_headings(nodes: DataFrame) -> DataFrame:
    """Nodes with section_id: a heading begins a section; what comes before the first is section 0."""
    w = Window.partitionBy("doc_id").orderBy("unit_index", "preorder").rowsBetween(Window.unboundedPreceding, 0)
    return nodes.withColumn("section_id", F.sum(F.when(F.col("type") == "heading", 1).otherwise(0)).over(w).cast("int"))


def analyze_units(nodes: DataFrame) -> DataFrame:
    """doc_id, unit_index, char_count, image_count, has_notes, heading, kind of every unit."""
    from papyra.functions.classify import classify_office
    from papyra.functions.text import char_count

    g = nodes.groupBy("doc_id", "unit_index").agg(
        F.sum(F.when(~F.col("type").isin("text", "note", "image"), char_count(F.col("text"))).otherwise(0)).alias("char_count"),
        F.count_if(F.col("type") == "image").alias("image_count"), F.bool_or(F.col("type") == "note").alias("has_notes"),
        F.min_by("text", F.when(F.col("type") == "heading", F.col("preorder"))).alias("heading"),
    )
    return g.withColumn("kind", classify_office(F.col("char_count"), F.col("image_count")))
