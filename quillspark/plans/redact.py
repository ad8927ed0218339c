"""Redaction from the command line: a file, a folder or standard input.

    spark-submit quillspark/plans/redact.py INPUT [--output FOLDER] [--mode clinical|strict] [--report]

INPUT is a path Spark can read, or - for standard input.  With an output folder texts go to
FOLDER/redacted and the report of spans to FOLDER/report; without one a single text is printed.
The exit code is 2 if something identifying is left in a text, else 0.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.anonymize import anonymize
from quillspark.sources.files import write_csv


def texts(spark: SparkSession, source: str, stdin=None) -> DataFrame:
    """(doc_id, text): the whole texts of .md and .txt files, or of standard input; a byte-order
    mark is no part of a text."""
    if source == "-":
        return spark.createDataFrame([("stdin", (stdin or sys.stdin).read())], "doc_id string, text string")
    reader = spark.read.option("recursiveFileLookup", "true")
    if not source.lower().endswith((".md", ".txt")):
        reader = reader.option("pathGlobFilter", "*.{md,txt}")
    raw = reader.text(source, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("doc_id"), F.regexp_replace("value", r"^\ufeff", "").alias("text"))


def main(args: list[str] | None = None, spark: SparkSession | None = None, stdin=None, stdout=None) -> int:
    parser = argparse.ArgumentParser(description="Replaces what identifies people in texts.")
    parser.add_argument("input")
    parser.add_argument("--output")
    parser.add_argument("--mode", choices=("clinical", "strict"), default="clinical")
    parser.add_argument("--report", action="store_true", help="print the counts by kind as JSON")
    a = parser.parse_args(args)
    spark, stdout = spark or SparkSession.builder.getOrCreate(), stdout or sys.stdout
    done = anonymize(texts(spark, a.input, stdin), a.mode)
    if a.output:
        done.write.mode("overwrite").parquet(f"{a.output}/redacted")
        done = spark.read.parquet(f"{a.output}/redacted")
        write_csv(done.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", "s.kind", "s.source", "s.confidence"), f"{a.output}/report")
    else:
        one = done.select("redacted").take(2)
        if len(one) > 1:
            parser.error("several texts need --output")
        stdout.write("".join(r.redacted for r in one))
    if a.report:
        found = done.select(F.explode("counts").alias("kind", "n")).groupBy("kind").agg(F.sum("n").alias("n"))
        stdout.write(json.dumps({r.kind: r.n for r in found.orderBy("kind").collect()}, ensure_ascii=False) + "\n")
    return 2 if done.where(~F.col("safe")).take(1) else 0


if __name__ == "__main__":
    sys.exit(main())
