"""Evaluation against references, between runs, and presence baselines; all relational.

Records are long tables: (doc_id, field, value), with the missing value as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import MISSING
from .spread import by_key


def unpivoted(wide: DataFrame, fields, id_col: str = "doc_id") -> DataFrame:
    """A wide record as (doc_id, field, value)."""
    return wide.select(F.col(id_col).alias("doc_id"), *[F.col(f"`{f}`").cast("string").alias(f) for f in fields]).unpivot("doc_id", list(fields), "field", "value")


def paired(predicted: DataFrame, gold: DataFrame, how: str = "inner") -> DataFrame:
    g = gold.select("doc_id", "field", F.coalesce("value", F.lit(MISSING)).alias("gold"))
    p = predicted.select("doc_id", "field", F.coalesce("value", F.lit(MISSING)).alias("predicted"))
    return g.join(p, ["doc_id", "field"], how)


def exact_match(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(field, correct, n, accuracy) by field, and __ALL__."""
    hit = F.count_if(F.col("gold") == F.col("predicted"))
    rolled = paired(predicted, gold).rollup("field").agg(hit.alias("correct"), F.count("*").alias("n"))
    return rolled.select(F.coalesce("field", F.lit("__ALL__")).alias("field"), "correct", "n", F.round(F.col("correct") / F.col("n"), 6).alias("accuracy"))


def file_match(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id, accuracy): the share of equal fields."""
    return paired(predicted, gold).groupBy("doc_id").agg(F.round(F.avg((F.col("gold") == F.col("predicted")).cast("double")), 6).alias("accuracy"))


def ratio(a: Column, b: Column, otherwise: float) -> Column:
    return F.when(b == 0, otherwise).otherwise(a / b)


def presence_scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Precision, recall and F1 of whether a field has a value at all."""
    p, g = F.col("predicted") != MISSING, F.col("gold") != MISSING
    n = paired(predicted, gold).groupBy("field").agg(F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0)
    f1 = ratio(2 * precision * recall, precision + recall, 0.0)
    return n.select("field", "tp", "fp", "fn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def mismatches(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """What differs from the reference; documents without a prediction are one row each."""
    dealt = lambda df, *keys: by_key(df, *keys, each=1 << 19)  # noqa: E731  a record of a few bytes is a row a field
    known = dealt(predicted.select("doc_id"), "doc_id").distinct().withColumn("present", F.lit(True))
    rows = dealt(paired(dealt(predicted, "doc_id", "field"), dealt(gold, "doc_id", "field"), "left"), "doc_id").join(known, "doc_id", "left")
    wrong = rows.where(F.col("present") & ~F.col("gold").eqNullSafe(F.col("predicted"))).select("doc_id", "field", "gold", "predicted")
    lost = dealt(gold.select("doc_id"), "doc_id").distinct().join(known, "doc_id", "left_anti").select("doc_id", F.lit("__MISSING_FILE__").alias("field"), F.lit(None).cast("string").alias("gold"), F.lit(None).cast("string").alias("predicted"))
    return wrong.unionByName(lost)


def pairwise_agreement(runs: DataFrame) -> DataFrame:
    """runs (run, doc_id, field, value): agreement of every two runs on their common documents, by
    field and __ALL__."""
    a = runs.select(F.col("run").alias("left"), "doc_id", "field", F.col("value").alias("x"))
    b = runs.select(F.col("run").alias("right"), "doc_id", "field", F.col("value").alias("y"))
    both = a.join(b, ["doc_id", "field"]).where("left < right")
    same = F.count_if(F.col("x").eqNullSafe(F.col("y")))
    out = both.groupingSets([["left", "right", "field"], ["left", "right"]], "left", "right", "field").agg(same.alias("same"), F.count("*").alias("n"))
    return out.select("left", "right", F.coalesce("field", F.lit("__ALL__")).alias("field"), "n", F.round(F.col("same") / F.col("n"), 6).alias("agreement"))


def run_accuracy(runs: DataFrame, gold: DataFrame) -> DataFrame:
    """Exact match with the reference, of every run, by field and __ALL__."""
    both = runs.join(gold.select("doc_id", "field", F.col("value").alias("gold")), ["doc_id", "field"])
    out = both.groupingSets([["run", "field"], ["run"]], "run", "field").agg(F.count_if(F.col("value").eqNullSafe(F.col("gold"))).alias("correct"), F.count("*").alias("n"))
    return out.select("run", F.coalesce("field", F.lit("__ALL__")).alias("field"), "n", F.round(F.col("correct") / F.col("n"), 6).alias("accuracy"))


def presence_baseline(decisions: DataFrame) -> DataFrame:
    """(field, n_docs, presence_rate, direct_rate): decisions (doc_id, field, value, selected_source)."""
    have = F.col("value") != MISSING
    return decisions.groupBy("field").agg(
        F.count("*").alias("n_docs"),
        F.round(F.avg(have.cast("double")), 6).alias("presence_rate"),
        F.round(F.avg((have & F.col("selected_source").isNotNull()).cast("double")), 6).alias("direct_rate"),
    )


def present_fields(decisions: DataFrame) -> DataFrame:
    """One row: mean, least and most fields present in a document."""
    n = decisions.groupBy("doc_id").agg(F.count_if(F.col("value") != MISSING).alias("n"))
    return n.agg(F.round(F.avg("n"), 6).alias("mean_present"), F.min("n").alias("min_present"), F.max("n").alias("max_present"))


def chat_rows(docs: DataFrame, gold: DataFrame, groups: DataFrame, system: str = "Return the requested fields as JSON.") -> tuple[DataFrame, DataFrame]:
    """Training chats, one a document and group of fields, and the documents skipped for want of
    labels.  groups: (field, grp)."""
    rows = gold.join(F.broadcast(groups), "field").groupBy("doc_id", "grp").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value"))))).alias("answer"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    chats = docs.join(rows, "doc_id").select("doc_id", "grp", F.to_json(F.struct(F.array(message("system", F.lit(system)), message("user", F.concat(F.lit("group: "), F.col("grp"), F.lit("\n"), F.col("text"))), message("assistant", F.col("answer"))).alias("messages"))).alias("chat"))
    return chats, docs.join(gold, "doc_id", "left_anti").select("doc_id")
