"""The worker as a stream: JSON lines of documents in, candidates out; bad lines become error rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import resolved, texts_at

SCHEMA = "path string, text string, stem string, id string"


def parse_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, text, path, error) of lines (value); blank lines go."""
    v = F.col("value")
    obj = F.from_json(v, SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.where(F.trim(v) != "").select(obj.alias("o"), v)
    bad = F.col("o").isNull() | F.col("o._bad").isNotNull() | (F.col("o.text").isNull() & F.col("o.path").isNull())
    stem = F.regexp_replace(F.regexp_extract(F.coalesce("o.path", F.lit("")), r"([^/\\]+)$", 1), r"\.[^.]*$", "")
    name = F.coalesce(F.col("o.id"), F.col("o.stem"), F.when(stem != "", stem), F.sha2(v, 256))
    return rows.select(name.alias("doc_id"), F.col("o.text").alias("text"), F.col("o.path").alias("path"), F.when(bad, "not a document line").alias("error"))


def read_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    return parse_lines(spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path))


def with_texts(batch: DataFrame, base: str = "") -> DataFrame:
    """(doc_id, text, error): lines that give a path instead of a text get the file's; a path without
    a file is an error of its line."""
    given = batch.where("path IS NULL OR text IS NOT NULL OR error IS NOT NULL").select("doc_id", "text", "error")
    rows = batch.where("path IS NOT NULL AND text IS NULL AND error IS NULL").withColumn("file", resolved(F.col("path"), base))
    read = rows.join(texts_at(batch.sparkSession, rows, base).withColumnRenamed("text", "found"), "file", "left")
    missing = F.when(F.col("found").isNull(), F.concat(F.lit("no file "), F.col("path")))
    return given.unionByName(read.select("doc_id", F.col("found").alias("text"), missing.alias("error")))


def run_worker(stream: DataFrame, out: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], available_now: bool = True, base: str = ""):
    """Process each micro-batch and write results and errors; the batch number is part of the path,
    so a batch that is run again replaces its own output."""

    def handle(batch: DataFrame, number: int) -> None:
        batch = with_texts(batch, base)
        batch.where("error IS NOT NULL").select("doc_id", "error").write.mode("overwrite").parquet(f"{out}/errors/batch={number}")
        process(batch.where("error IS NULL").select("doc_id", "text")).write.mode("overwrite").parquet(f"{out}/results/batch={number}")

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
