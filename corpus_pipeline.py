"""A corpus pipeline of five stages over `documents`; part of the subpackage quillspark.llm.

Each stage reads what its predecessor kept, as Parquet, and hands on the columns of documents;
the last one returns packed pieces.  Each row gets its own decision: rows that share a doc_id
with others, or have none, are told apart by their texts, and of rows equal in both one stays.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import exact, jaccard, packing, substrings, toxicity
from quillspark.llm.common import read_table, shared_folder


#: Names of columns that only live within a stage.
SHARED, SHA, ROW, NO_TEXT, ID, LOST = "_shared", "_sha", "_row", "_no_text", "_id", "_lost"
#: Keys from here on are not doc_ids but hashes of row contents.
OWN = 2**62
#: As many shared ids are sent to all tasks.
MANY = 10_000


def _shared_ids(docs: DataFrame) -> DataFrame | None:
    """(doc_id) that several rows have, null included; None where there are none."""
    found = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    n = len(found.take(MANY + 1))
    return None if not n else F.broadcast(found) if n <= MANY else found


def _marked(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """docs and whether a row's doc_id is that of others too."""
    ids = shared.select(F.col("doc_id").alias(LOST), F.lit(True).alias(SHARED))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids[LOST]), "left").drop(LOST).withColumn(SHARED, F.coalesce(SHARED, F.lit(False)))


def _one_each(docs: DataFrame, shared: DataFrame | None, key: str) -> DataFrame:
    """docs with one of the rows that are equal in doc_id and key; only shared ids have such rows."""
    if shared is None:
        return docs
    rows = _marked(docs, shared)
    return rows.where(~F.col(SHARED)).unionByName(rows.where(SHARED).dropDuplicates(["doc_id", key])).drop(SHARED)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go."""
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id stays, and one row of it."""
    found = exact.exact_duplicates(docs)
    lost = found.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias(ID), F.col("text_sha256").alias(LOST)).distinct()
    rows = docs.withColumn(SHA, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    out = rows.join(lost, rows["doc_id"].eqNullSafe(lost[ID]) & (rows[SHA] == lost[LOST]), "left_anti")
    return _one_each(out, _shared_ids(docs), SHA).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the one whose
    doc_id names the component stays.  Rows of a shared, missing or very large id count as
    documents of their own, later than all others."""
    shared = _shared_ids(docs)
    marked = docs.withColumn(SHARED, F.lit(False)) if shared is None else _marked(docs, shared)
    own = F.col(SHARED) | F.col("doc_id").isNull() | ~F.col("doc_id").between(0, OWN - 1)
    of_text = F.xxhash64("doc_id", "text").bitwiseAND(F.lit(OWN - 1)) + F.lit(OWN)
    rows = marked.withColumn(ID, F.when(own, of_text).otherwise(F.col("doc_id").cast("long")))
    found = jaccard.jaccard_components(rows, n=5, threshold=0.8, id_col=ID)
    lost = found.where("doc_id <> component_id").select(F.col("doc_id").alias(ID)).distinct()
    return _one_each(rows.drop(SHARED).join(lost, ID, "left_anti"), shared, ID).select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a window of 20 words that starts earlier as well leave the text; texts
    without such words stay as they are.  No document is dropped."""
    others = [F.col(c) for c in docs.columns if c != "text"]
    rows = docs.select("doc_id", "text", F.struct(*others, F.col("text").isNull().alias(NO_TEXT)).alias(ROW))
    out = substrings.remove_repeats(rows, window=20, with_text=True, carry=ROW)
    cut, own = F.col("kept_text").isNotNull(), F.col(ROW)
    new = {
        "text": F.when(cut, F.col("kept_text")).when(~own[NO_TEXT], F.col("text")),
        "n_chars": F.when(cut, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"]),
    }
    return out.select(*[(new[c] if c in new else own[c]).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and the sequences that they fill."""
    return packing.digests(packing.packed(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: Toxicity scores and sum-of-squares packing cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result but the last is written to the shared folder and
    reread, and goes when the next one has been written."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    written: list[str] = []
    for k, (name, stage) in enumerate(STAGES[:-1]):
        written.append(f"{folder}/{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(written[-1])
        docs = spark.read.parquet(written[-1])
        if k:
            _remove(spark, written[-2])
    return STAGES[-1][1](spark, docs, sf_dir)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
