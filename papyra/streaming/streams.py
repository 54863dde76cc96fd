"""Streaming twins: files or rows that arrive over time, with state kept by document."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from papyra.session import ensure_checkpoint_dir

Client = Callable[[str, str], str]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def read_table_stream(spark: SparkSession, directory: str, table: str, files_per_batch: int = 4) -> DataFrame:
    """A parquet table as a stream of its files: table.parquet is a file or a folder of files."""
    path = f"{directory}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(directory) if os.path.isfile(path) else reader.parquet(path)


def run_available(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Everything there is by now, through the stream: batches are written below the shared folder and read back.

    A batch that is run again after a failure overwrites its own folder, so rows come once.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/n={number:09d}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("n")


def usage(entries: DataFrame) -> DataFrame:
    """Calls and tokens of each experiment, in update mode: every batch gives the changed sums.

    An entry delivered again, however late, counts once: its id stays in the state.
    """
    return entries.dropDuplicates(["id"]).groupBy("experiment").agg(F.count("*").alias("calls"), F.sum("tokens.input").alias("input"), F.sum("tokens.output").alias("output"))


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key."""
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in updates.columns if c not in keys]), "batch").alias("u")).select(*keys, "u.*").drop("batch")


def continuity(pages: DataFrame, client: Client, tail: int = 200) -> DataFrame:
    """doc_id, page_index, context, output of each page: the end of a document's last output feeds its next page.

    State is one text of at most tail characters for each document, and the pages it has had: a page
    delivered again gives no second row. Within a batch pages go in order; a page that arrives after its
    successors is given the state as it is then.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        context, had = state.get if state.exists else ("", [])
        rows, had = [], list(had)
        b = pd.concat(list(batches)).drop_duplicates("page_index")
        for p in b[~b["page_index"].isin(had)].sort_values("page_index", kind="stable").itertuples():
            text = p.text if isinstance(p.text, str) else ""
            out = client(context, text)
            rows.append((key[0], p.page_index, context, out))
            context = out[-tail:]
            had.append(int(p.page_index))
        state.update((context, had))
        yield pd.DataFrame(rows, columns=["doc_id", "page_index", "context", "output"])

    return pages.select("doc_id", "page_index", "text").groupBy("doc_id").applyInPandasWithState(step, "doc_id long, page_index int, context string, output string", "context string, had array<int>", "append", GroupStateTimeout.NoTimeout)


def continuity_batch(pages: DataFrame, client: Client, tail: int = 200) -> DataFrame:
    """The same over a table: one document is one task's sequence, documents run side by side."""

    def step(b: pd.DataFrame) -> pd.DataFrame:
        context, rows = "", []
        for p in b.sort_values("page_index", kind="stable").itertuples():
            text = p.text if isinstance(p.text, str) else ""
            out = client(context, text)
            rows.append((p.doc_id, p.page_index, context, out))
            context = out[-tail:]
        return pd.DataFrame(rows, columns=["doc_id", "page_index", "context", "output"])

    return pages.select("doc_id", "page_index", "text").groupBy("doc_id").applyInPandas(step, "doc_id long, page_index int, context string, output string")


def page_events(pages: DataFrame, abort: bool = True) -> DataFrame:
    """Events of reading pages as rows: start, content, done; or start and error, which ends the document where abort is set."""
    kinds = F.when(F.col("text").isNull(), F.array(F.lit("unit-start"), F.lit("error"))).otherwise(F.array(F.lit("unit-start"), F.lit("content"), F.lit("unit-done")))
    if abort:
        # the first failed page of each document: one row for each that fails
        failed = pages.where("text is null").groupBy("doc_id").agg(F.min("page_index").alias("__failed"))
        pages = pages.join(failed, "doc_id", "left").where("__failed is null or page_index <= __failed")
    return pages.select("doc_id", "page_index", "text", F.posexplode(kinds).alias("step", "event_type")).select("doc_id", "page_index", "step", "event_type", F.when(F.col("event_type") == "content", F.length("text")).alias("chars"))
