"""The pN_ queries over a directory of tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from papyra.llm import encoding, languages, mixing, ocr, packing, pairs, split, subjects, truncation
from papyra.ship import ship


def _p1_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split.split_sections(spark.read.parquet(f"{d}/sections.parquet"), spark.read.parquet(f"{d}/chunk_budgets.parquet"))
    return pieces.where("piece_index > 0").select("doc_id", "section_index").distinct()


def _p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_sections(spark.read.parquet(f"{d}/sections.parquet"), spark.read.parquet(f"{d}/chunk_budgets.parquet"))


def _p2_found(spark: SparkSession, d: str) -> DataFrame:
    judged = truncation.judge_tails(truncation.entries_of(spark.read.parquet(f"{d}/journal.parquet")), keep_whole=False)
    return judged.where("truncated").select("id")


def _p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(spark.read.parquet(f"{d}/journal.parquet"), spark.read.parquet(f"{d}/models.parquet"))


def _p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.find_defects(spark.read.parquet(f"{d}/journal.parquet"), spark.read.parquet(f"{d}/pdf_pages.parquet"))


def _p4_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.find_mislabelled(spark.read.parquet(f"{d}/pdf_pages.parquet"))


def _p4_pages(spark: SparkSession, d: str) -> DataFrame:
    found = languages.page_languages(spark.read.parquet(f"{d}/pdf_pages.parquet"))
    return found.select("doc_id", "page_index", "language", "label_lang", "language_found.lang", "language_found.confidence", "language_found.segments").dropDuplicates(["doc_id", "page_index"])


def _p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _p5_repaired(spark, d).select("rec_table", "doc_id", "rec_index")


def _p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return encoding.find_garbled(spark.read.parquet(f"{d}/pdf_pages.parquet"), spark.read.parquet(f"{d}/runs.parquet"))


def _p6_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr.find_noise(spark.read.parquet(f"{d}/ocr_pages.parquet"), spark.read.parquet(f"{d}/ocr_docs.parquet"))


def _p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    return ocr.repair_pages(spark.read.parquet(f"{d}/ocr_pages.parquet"), spark.read.parquet(f"{d}/ocr_docs.parquet"))


def _p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/pack_sizes.parquet"))


def _p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_report(_p7_packed(spark, d), spark.read.parquet(f"{d}/pack_sizes.parquet"))


def _p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/mix_targets.parquet"))


def _p8_report(spark: SparkSession, d: str) -> DataFrame:
    targets = spark.read.parquet(f"{d}/mix_targets.parquet")
    drawn, made = mixing.mix_and_plan(spark.read.parquet(f"{d}/documents.parquet"), targets)
    return mixing.mix_report(drawn, targets, made)


def _p8_natural(spark: SparkSession, d: str) -> DataFrame:
    """Without targets: token shares of all sources to the smallest exponent that four repeats allow."""
    drawn, made = mixing.mix_and_plan(spark.read.parquet(f"{d}/documents.parquet"), None)
    g = drawn.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), (F.max("epoch") + 1).alias("most_repeats"))
    return g.withColumns({"exponent": F.lit(float(made.exponent)), "met": F.lit(made.met), "entropy": F.lit(made.entropy)})


def _p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """source, target_share, met: whether the drawn set reaches the target within a percentage point."""
    report = _p8_report(spark, d)
    return report.where("target_share > 0").select("source", "target_share", (F.abs(F.col("actual_share") - F.col("target_share")) < 0.01).alias("met"))


def _p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _p9_shares(spark, d).select("doc_id", "subject")


def _p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(*[spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "doc_labels", "subjects")])


def _p9_composition(spark: SparkSession, d: str) -> DataFrame:
    return _p9_shares(spark, d).groupBy("subject").agg(F.count("*").alias("documents"), F.round(F.sum("share"), 4).alias("weight"))


_BUILD: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": _p1_found,
    "p1_pieces": _p1_pieces,
    "p2_found": _p2_found,
    "p2_rates": _p2_rates,
    "p3_found": _p3_found,
    "p4_found": _p4_found,
    "p4_pages": _p4_pages,
    "p5_found": _p5_found,
    "p5_repaired": _p5_repaired,
    "p6_found": _p6_found,
    "p6_repaired": _p6_repaired,
    "p7_packed": _p7_packed,
    "p7_report": _p7_report,
    "p8_mix": _p8_mix,
    "p8_report": _p8_report,
    "p8_natural": _p8_natural,
    "p8_shares": _p8_shares,
    "p9_found": _p9_found,
    "p9_shares": _p9_shares,
    "p9_composition": _p9_composition,
}



def _shipped(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        ship(spark)
        return build(spark, d)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _shipped(v) for k, v in _BUILD.items()}

SQL: dict[str, str] = {
    "p1_found": """
        with t as (
            select doc_id, section_index, lower(trim(format)) as format,
                coalesce(length(nullif(heading, '')), 0) as h, nullif(heading, '') is not null as has_heading,
                coalesce(len(lines), 0) as n, coalesce(list_sum(list_transform(lines, lambda x: coalesce(length(x), 0))), 0) as chars
            from sections)
        select distinct doc_id, section_index
        from t join (select distinct on (lower(trim(format))) lower(trim(format)) as format, max_chars from chunk_budgets) b using (format)
        where h + chars + n - 1 + (case when has_heading then 1 else 0 end) > max_chars""",
    "p8_shares": """
        select distinct translate(lower(trim(source)), '_ ', '--') as source, target_share, true as met
        from mix_targets where source is not null and target_share > 0""",
}
