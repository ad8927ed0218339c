"""Which fields of which documents go to which provider: comparisons, policies and shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import BINARY, MISSING

SEVERITY = {"uncertain": 0, "api_always": 1, "both_always": 2}
BONUS = {"api_always": 0.015, "both_always": 0.025}
PROBE = {"strategy": "probe_compare", "api_mode": "all", "local_mode": "disagreement", "fallback_local_if_api_unavailable": True}


def severity(mode: Column) -> Column:
    return F.when(mode == "both_always", 2).when(mode == "api_always", 1).otherwise(0)


def uncertain(decisions: DataFrame, threshold: float = 0.88, sections: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """(doc_id, field) in conflict, without a source, or below the threshold.

    With sections (doc_id, name) and sources (field, name): fields that have no candidate are only
    asked for where one of their sections is there; `episode` is always.
    """
    some = decisions.where(F.col("conflict") | F.col("selected_source").isNull() | (F.col("score") < threshold))
    if sections is None or sources is None:
        return some.select("doc_id", "field")
    empty = F.col("selected_source").isNull() & (F.col("evidence") == "") & (F.col("label") == "suspicious")
    known = some.where(~empty).select("doc_id", "field")
    lost = some.where(empty).select("doc_id", "field")
    anywhere = lost.join(F.broadcast(sources.where("name = 'episode'").select("field").distinct()), "field", "left_semi").select("doc_id", "field")
    there = lost.join(F.broadcast(sources), "field").join(sections.select("doc_id", "name").distinct(), ["doc_id", "name"], "left_semi").select("doc_id", "field").distinct()
    return known.unionByName(anywhere.unionByName(there).distinct())


def compared(candidates: DataFrame) -> DataFrame:
    """(doc_id, field, event, ...): how rules and API agree on values that are valid and direct.

    candidates: (doc_id, field, value, source, format_ok, evidence_ok, absence)."""
    usable = (F.col("value") != MISSING) & ~F.col("absence") & F.col("format_ok") & F.col("evidence_ok")
    rules, api = F.col("source").isin("regex", "typo_regex"), F.col("source") == "api"
    values = lambda side: F.array_sort(F.collect_set(F.when(side & usable, F.col("value"))))
    raw = lambda side: F.count_if(side & (F.col("value") != MISSING))
    g = candidates.groupBy("doc_id", "field").agg(
        values(rules).alias("rv"), values(api).alias("av"), raw(rules).alias("rules_raw"), F.count_if(rules & usable).alias("rules_valid"), raw(api).alias("api_raw"), F.count_if(api & usable).alias("api_valid")
    )
    r, a = F.size("rv") > 0, F.size("av") > 0
    event = F.when(r & a & (F.col("rv") == F.col("av")), "agree").when(r & a, "semantic_conflict").when(a, "regex_coverage_gap").when(r, "api_coverage_gap").otherwise("both_missing")
    return g.select("doc_id", "field", event.alias("event"), F.array_join("rv", "|").alias("rules_values"), F.array_join("av", "|").alias("api_values"), "rules_raw", "rules_valid", "api_raw", "api_valid")


def disagreements(events: DataFrame) -> DataFrame:
    return events.where(F.col("event").isin("regex_coverage_gap", "api_coverage_gap", "semantic_conflict")).select("doc_id", "field")


def probe_policy(events: DataFrame, least_global: int = 3, least_cluster: int = 1, gap: float = 0.30, conflict: float = 0.20, cluster_gap: float = 0.50, cluster_conflict: float = 0.50) -> DataFrame:
    """(scope, cluster, field, mode, reason, observations and rates) from probes' events
    (doc_id, cluster, field, event): both levels in one pass of grouping sets."""
    count = lambda e: F.count_if(F.col("event") == e)
    g = events.groupingSets([["field"], ["cluster", "field"]], "cluster", "field").agg(
        F.grouping("cluster").alias("whole"), F.count("*").alias("observations"), count("agree").alias("agree"), count("regex_coverage_gap").alias("gap"), count("semantic_conflict").alias("conflict"), count("api_coverage_gap").alias("api_gap")
    )
    whole, n = F.col("whole") == 1, F.col("observations")
    rate = lambda c: F.round(F.col(c) / n, 4)
    mode = F.when(F.col("conflict") / n >= F.when(whole, conflict).otherwise(cluster_conflict), "both_always").when(F.col("gap") / n >= F.when(whole, gap).otherwise(cluster_gap), "api_always")
    reason = F.when(F.col("mode") == "both_always", "probe_semantic_conflict").otherwise("probe_regex_coverage_gap")
    out = g.withColumn("mode", mode).where(F.col("mode").isNotNull() & (n >= F.when(whole, least_global).otherwise(least_cluster)))
    reason = F.when(whole, reason).otherwise(F.concat(F.lit("cluster_"), F.col("cluster").cast("string"), F.lit(":"), reason))
    return out.select(
        F.when(whole, "global").otherwise("cluster").alias("scope"), "cluster", "field", "mode", reason.alias("reason"), "observations",
        rate("agree").alias("agreement_rate"), rate("gap").alias("regex_gap_rate"), rate("conflict").alias("semantic_conflict_rate"), rate("api_gap").alias("api_gap_rate"),
    )


def coverage_shift(decisions: DataFrame, baseline: DataFrame, least_docs: int = 5, least_base: float = 0.25, drop: float = 0.20) -> DataFrame:
    """(field, train_presence, batch_presence, drop, flagged): decisions against baseline (field,
    presence_rate); coded fields are always there and left out; small batches give no rows."""
    have = decisions.where(~F.col("field").isin(*BINARY, "ca_fact"))
    now = have.groupBy("field").agg(F.avg((F.col("value") != MISSING).cast("double")).alias("now"), F.countDistinct("doc_id").alias("n")).where(F.col("n") >= least_docs)
    both = now.join(F.broadcast(baseline), "field")
    less = F.col("presence_rate") - F.col("now")
    flagged = (F.col("presence_rate") >= least_base) & (less >= drop)
    return both.select("field", F.round("presence_rate", 4).alias("train_presence"), F.round("now", 4).alias("batch_presence"), F.round(less, 4).alias("drop"), flagged.alias("flagged"))


def with_shift(policy: DataFrame, shift: DataFrame) -> DataFrame:
    """The probes' policy joined with fields whose coverage fell: those at least go to the API."""
    fallen = shift.where("flagged").select("field", F.lit("api_always").alias("shift_mode"))
    whole = policy.where("scope = 'global'").join(fallen, "field", "full")
    mode = F.when(severity(F.col("mode")) >= severity(F.col("shift_mode")), F.col("mode")).otherwise(F.col("shift_mode"))
    reasons = F.array_compact(F.array(F.when(F.col("shift_mode").isNotNull(), "batch_regex_coverage_shift"), F.col("reason")))
    out = whole.select(F.lit("global").alias("scope"), F.lit(None).cast("int").alias("cluster"), "field", F.when(F.col("mode").isNull(), F.col("shift_mode")).when(F.col("shift_mode").isNull(), F.col("mode")).otherwise(mode).alias("mode"), reasons.alias("reasons"))
    return out.unionByName(policy.where("scope = 'cluster'").select("scope", F.col("cluster").cast("int").alias("cluster"), "field", "mode", F.array("reason").alias("reasons")))


def policy_lookup(docs: DataFrame, policy: DataFrame) -> DataFrame:
    """(doc_id, field, mode, reasons, api_always, local_always, local_on_disagreement, llm_bonus).

    docs (doc_id, cluster); policy (scope, cluster, field, mode, reasons).  A cluster's policy wins
    over the global one where it is at least as severe."""
    g = policy.where("scope = 'global'").select("field", F.col("mode").alias("gm"), F.col("reasons").alias("gr"))
    k = policy.where("scope = 'cluster'").select("cluster", "field", F.col("mode").alias("cm"), F.col("reasons").alias("cr"))
    fields = g.select("field").union(k.select("field")).distinct()
    every = docs.select("doc_id", "cluster").join(F.broadcast(fields)).join(F.broadcast(g), "field", "left").join(F.broadcast(k), ["cluster", "field"], "left")
    every = every.where(F.col("gm").isNotNull() | F.col("cm").isNotNull())
    mode = F.when(severity(F.coalesce("cm", F.lit("uncertain"))) >= severity(F.coalesce("gm", F.lit("uncertain"))), F.coalesce("cm", "gm")).otherwise(F.col("gm"))
    none = F.array().cast("array<string>")
    out = every.withColumn("mode", mode).withColumn("reasons", F.array_distinct(F.concat(F.coalesce("gr", none), F.coalesce("cr", none))))
    bonus = F.when(F.col("mode") == "api_always", BONUS["api_always"]).when(F.col("mode") == "both_always", BONUS["both_always"]).otherwise(0.0)
    return out.select("doc_id", "field", "mode", "reasons", F.col("mode").isin("api_always", "both_always").alias("api_always"), (F.col("mode") == "both_always").alias("local_always"), (F.col("mode") == "api_always").alias("local_on_disagreement"), bonus.alias("llm_bonus"))


def processing_order(docs: DataFrame, probes: DataFrame) -> DataFrame:
    """(doc_id, is_probe, place): probes first, in their order, then the rest by id.

    probes: (doc_id, probe_order), a bounded number."""
    d = docs.select("doc_id").distinct().join(F.broadcast(probes), "doc_id", "left")
    is_probe = F.col("probe_order").isNotNull()
    place = F.when(is_probe, F.col("probe_order")).otherwise(1_000_000)
    return d.select("doc_id", is_probe.alias("is_probe"), place.alias("stage"))


def requested(asked: DataFrame, policy: DataFrame, provider: str) -> DataFrame:
    """(doc_id, field) for a provider: what its policy always wants, and what is uncertain; once each."""
    always = policy.where(F.col("api_always" if provider == "api" else "local_always")).select("doc_id", "field")
    return always.unionByName(asked.select("doc_id", "field")).distinct()


def first_value(candidates: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id", "field").orderBy(F.desc("confidence"), "ord")
    return candidates.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
