"""Files and URLs as DataFrames of path, content and error."""

from __future__ import annotations

import urllib.request
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra import fixed
from papyra.functions.lookup import get_extension, look_up

TIMEOUT_S = 30


def read_files(spark: SparkSession, path: str, glob: str | None = None, largest: int | None = None) -> DataFrame:
    """path, modificationTime, length, content of the files under path; the size filter is pushed to the listing. Files of no bytes give no row."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return df.where(F.col("length") <= largest) if largest is not None else df


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, largest=fixed.MAX_IMAGE_BYTES)


def read_new(spark: SparkSession, path: str, done: DataFrame | None = None, extensions: tuple[str, ...] = tuple(fixed.EXTENSION_FORMAT)) -> DataFrame:
    """Files of known extension that have no output yet (done: path)."""
    df = read_files(spark, path).where(get_extension(F.col("path")).isin(*extensions))
    return df.join(done.select("path"), "path", "left_anti") if done is not None else df


def from_bytes(spark: SparkSession, items: list[tuple[str, bytes]]) -> DataFrame:
    return spark.createDataFrame([(p, bytearray(b)) for p, b in items], "path string, content binary")


def fetch(urls: DataFrame, column: str = "path", timeout: int = TIMEOUT_S, largest: int = 500_000_000) -> DataFrame:
    """path, content, mime, final_url, error: one GET for each URL on the executors; failures are rows, not exceptions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url in b[column]:
                try:
                    with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
                        body = r.read(largest + 1)
                        rows.append((url, body, r.headers.get_content_type(), r.geturl(), None) if len(body) <= largest else (url, None, None, r.geturl(), "too large"))
                except Exception as e:
                    rows.append((url, None, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["path", "content", "mime", "final_url", "error"])

    return urls.select(column).mapInPandas(run, "path string, content binary, mime string, final_url string, error string")


def route(fetched: DataFrame) -> DataFrame:
    """fetched with format: by the type the server named, else by first bytes, else by the final URL's ending; null for a failure or none of them."""
    mime = F.lower(F.trim(F.substring_index("mime", ";", 1)))
    named = look_up(fixed.MIME_FORMAT, mime)
    head = F.upper(F.hex(F.substring("content", 1, 8)))
    magic = reduce(lambda otherwise, kv: F.when(head.startswith(kv[0]), kv[1]).otherwise(otherwise), reversed(fixed.MAGIC), F.lit(None).cast("string"))
    ending = look_up(fixed.EXTENSION_FORMAT, get_extension(F.substring_index("final_url", "?", 1)))
    return fetched.withColumn("format", F.when(F.col("error").isNull(), F.coalesce(named, magic, ending)))


def put(spark: SparkSession, path: str, content: bytes) -> str:
    """Write a small file to any file system that Spark knows; its path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(content))
    out.close()
    return path


def first_registry(spark: SparkSession, candidates: list[str | None]) -> DataFrame:
    """Models of the first file of the candidates that is named and there; none: an error."""
    for path in candidates:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path) if path else None
        if at is not None and at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return load_registry(spark, path)
    raise FileNotFoundError("no model registry: " + ", ".join(str(c) for c in candidates if c))


def registry_problem() -> Column:
    """What is wrong with a model of a registry, or null."""
    price = F.least(F.coalesce("pricing.input", F.lit(0.0)), F.coalesce("pricing.output", F.lit(0.0)), F.coalesce("pricing.image", F.lit(0.0)))
    return (
        F.when(F.length(F.coalesce(F.trim("id"), F.lit(""))) == 0, "model without id")
        .when(F.col("pricing").isNull() | F.col("pricing.input").isNull() | F.col("pricing.output").isNull(), "model without price")
        .when(price < 0, "negative price")
        .when(F.coalesce("context_window", F.lit(1)) <= 0, "context window is not positive")
    )


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """Models of a JSON registry file, with their provider and their place in the file."""
    schema = "providers array<struct<id:string,models:array<struct<id:string,aliases:array<string>,encoding:string,contextWindow:bigint,maxOutputTokens:bigint,pricing:struct<input:double,output:double,image:double>>>>>"
    p = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.posexplode("providers").alias("i", "p"))
    m = p.select("i", F.col("p.id").alias("provider"), F.posexplode("p.models").alias("j", "m"))
    return m.select((F.col("i") * 10000 + F.col("j")).cast("int").alias("ordinal"), "provider", "m.id", "m.aliases", "m.encoding", F.col("m.contextWindow").alias("context_window"), F.col("m.maxOutputTokens").alias("max_output_tokens"), "m.pricing")
