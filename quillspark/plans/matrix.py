"""Several configurations over the same documents, compared with each other and with a reference."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import run_dir_name
from ..operators import evaluate as E
from ..sources.files import secret
from . import pipeline as P

#: Kinds of runs and the providers that each asks.
ASKS = {"local": ("local",), "api": ("api",), "hybrid": ("api", "local")}


@dataclass
class Matrix:
    records: DataFrame  # run, doc_id, field, value
    summary: DataFrame  # run, kind, documents, mean_quality_score
    agreement: DataFrame
    accuracy: DataFrame | None = None


def checked_runs(runs: list[dict], env=None) -> list[dict]:
    """The runs that are enabled; one that could not be made raises before any is started."""
    kept = [r for r in runs if r.get("enabled", True)]
    if not kept:
        raise ValueError("no run is enabled")
    for r in kept:
        if r.get("kind") not in ASKS:
            raise ValueError(f"no such kind of run: {r.get('kind')!r}")
        if "api" in ASKS[r["kind"]] and not (r.get("base_url") and r.get("model") and secret(r, env)):
            raise ValueError(f"run {r.get('name')!r}: an API needs base_url, model and a key")
    return kept


def run_names(spark, runs: list[dict]) -> list[str]:
    """A folder's name for each run: its kind, its name and, where it has one model, that; a name
    that came before gets a number."""
    rows = [(k, r["kind"], str(r.get("name", "run")), "" if r["kind"] == "hybrid" else str(r.get("model_alias" if r["kind"] == "local" else "model", r.get("model", "model")))) for k, r in enumerate(runs)]
    named = spark.createDataFrame(rows, "k int, kind string, name string, model string").select("k", run_dir_name("kind", "name", "model").alias("run"))
    names: list[str] = []
    for r in sorted(named.collect()):
        same = sum(n == r.run or n.startswith(f"{r.run}~") for n in names)
        names.append(f"{r.run}~{same + 1}" if same else r.run)
    return names


def run_matrix(docs: DataFrame, runs: list[dict], provider: Callable[[dict, str], Callable[[str, str], str]], out: str, gold: DataFrame | None = None, env=None) -> Matrix:
    """Each run over all documents, on its own: a provider that its kind does not name is not asked.

    `provider(run, "api" or "local")` makes what answers.  api_mode and local_mode of a run are all
    (the default) or uncertain.  Records and scores are written to `out`, a folder a run, and compared
    as read from there, so providers are asked once.  No documents: empty tables."""
    runs = checked_runs(runs, env)
    spark, names = docs.sparkSession, run_names(docs.sparkSession, runs)
    for name, run in zip(names, runs, strict=True):
        asks = {a: provider(run, a) for a in ASKS[run["kind"]]}
        modes = {a: run.get(f"{a}_mode", "all") for a in asks}
        done = P.run(docs, **asks, modes=modes, threshold=float(run.get("uncertain_score_below", 0.88)))
        done.decisions.select("doc_id", "field", "value").write.mode("overwrite").parquet(f"{out}/records/run={name}")
        done.files.select("doc_id", "file_score").withColumn("kind", F.lit(run["kind"])).write.mode("overwrite").parquet(f"{out}/scores/run={name}")

    def written(kind: str) -> DataFrame:
        parts = [spark.read.parquet(f"{out}/{kind}/run={n}").withColumn("run", F.lit(n)) for n in names]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole

    records = written("records").select("run", "doc_id", "field", "value")
    summary = written("scores").groupBy("run", "kind").agg(F.count("*").alias("documents"), F.round(F.avg("file_score"), 6).alias("mean_quality_score"))
    return Matrix(records, summary, E.pairwise_agreement(records), None if gold is None else E.run_accuracy(records, gold))
