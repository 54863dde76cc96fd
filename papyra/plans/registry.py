"""Registration of queries: a DataFrame builder and the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from papyra.ship import ship


#: Keys of the tables whose rows can be delivered again, with the same content: such a row counts once, in every query.
KEYS = {
    "inputs": ["doc_id"], "pdf_pages": ["doc_id", "page_index"], "runs": ["doc_id", "run_index"], "ocr_pages": ["doc_id", "page_index"],
    "ocr_docs": ["doc_id"], "sections": ["doc_id", "section_index"], "journal": ["id"],
}
_TABLE = re.compile(rf"\b(FROM|JOIN)\s+({'|'.join(KEYS)})\b")


def once_in_sql(sql: str) -> str:
    """The SQL with every delivered table read once for each key."""
    return _TABLE.sub(lambda m: f"{m.group(1)} (SELECT DISTINCT ON ({', '.join(KEYS[m.group(2)])}) * FROM {m.group(2)})", sql)


class Tables:
    """Tables of a directory as attributes, each row once."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.directory}/{name}.parquet")
        return df.dropDuplicates(KEYS[name]) if name in KEYS else df


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(build: Callable[[Tables], DataFrame]):
            def run(spark: SparkSession, d: str) -> DataFrame:
                ship(spark)
                return build(Tables(spark, d))

            self.queries[name] = run
            if sql is not None:
                self.sql[name] = once_in_sql(sql)
            return build

        return register


def sql_case(x: str, table: dict[str, str], otherwise: str = "NULL") -> str:
    """A lookup as a CASE expression of ANSI SQL."""
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {otherwise} END"
