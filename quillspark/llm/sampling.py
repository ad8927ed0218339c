"""A bounded sample of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exact_columns


def labelled_sample(labels: DataFrame, label: str, held_out, rows: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) of at most about `rows` labelled documents that aren't held out, chosen by
    a hash of the id: every id is as likely as any other, and the choice is repeatable.  Null
    ids and labels other than 0 and 1 are left out; of several labels of an id the largest counts."""
    two = exact_columns(labels, id_col, label).toDF("doc_id", "label")
    known = two.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.where(~held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(20)), F.lit(1 << 20))
    n = known.count()
    return known if n <= rows else known.where(place < (rows << 20) // n)


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """docs with their label, of the sampled ids only; the sample is small by its bound."""
    return docs.join(F.broadcast(sample), "doc_id")
