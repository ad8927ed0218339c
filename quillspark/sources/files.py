"""Document sources, configuration, references, and sinks.

Everything is read and written by Spark, so paths may lie in any store that Spark reads.
"""

from __future__ import annotations

import io
import json
import os
import re
import tempfile
import tomllib
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import FIELDS, GROUPS, MISSING

GLOB = "*.{md,txt,MD,TXT,Md,Txt}"


def _named(df: DataFrame) -> DataFrame:
    name = F.col("path_name")
    return df.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"), F.col("value").alias("text"), F.col("path"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"))


def folder(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(doc_id, text, path, stem) of all .md and .txt files; a byte-order mark goes."""
    raw = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", GLOB).text(path, wholetext=True)
    raw = raw.select(F.regexp_replace("value", "^﻿", "").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("path_name"))
    return _named(raw)


def single(spark: SparkSession, path: str) -> DataFrame:
    """One file, as it is."""
    raw = spark.read.text(path, wholetext=True)
    return _named(raw.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("path_name")))


def manifest_rows(lines: DataFrame) -> DataFrame:
    """(path, doc_id, output) of manifest lines (value): JSON objects, JSON strings or bare paths."""
    v = F.trim("value")
    obj = F.from_json(v, "path string, id string, document_id string, output string")
    text = F.when(v.startswith('"'), F.get_json_object(F.concat(F.lit('{"x":'), v, F.lit("}")), "$.x"))
    path = F.when(v.startswith("{"), obj.path).otherwise(F.coalesce(text, v))
    stem = F.regexp_replace(F.regexp_extract(F.col("path"), r"([^/\\]+)$", 1), r"\.[^.]*$", "")
    out = lines.where(v != "").select(path.alias("path"), F.when(v.startswith("{"), F.coalesce(obj.id, obj.document_id)).alias("id"), F.when(v.startswith("{"), obj.output).alias("output"))
    return out.where("path IS NOT NULL AND path <> ''").select("path", F.coalesce("id", stem).alias("doc_id"), "output")


def resolved(path: Column, base: str) -> Column:
    """A listed path as an absolute one without a scheme; relative paths are below the base."""
    home = re.sub(r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", "", base).rstrip("/")
    plain = F.replace(F.regexp_replace(path, r"^[a-z][a-z0-9+.-]+:(//[^/]*)?", ""), F.lit("\\"), F.lit("/"))
    whole = F.when(plain.startswith("/"), plain).otherwise(F.concat(F.lit(home + "/"), plain))
    return F.regexp_replace(F.regexp_replace(whole, r"/(?:\./)+", "/"), "/+", "/")


def texts_at(spark: SparkSession, paths: DataFrame, base: str, most: int = 100_000) -> DataFrame:
    """(file, text): the files that are listed in paths (file), whatever they are called.  The list is
    as large as a driver's batch; longer ones are read as the folder below the base."""
    listed = [r.file for r in paths.select("file").distinct().limit(most + 1).collect()]
    scheme = m[0] if (m := re.match(r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", base)) else ""
    if len(listed) > most:
        raw = spark.read.option("recursiveFileLookup", "true").text(base, wholetext=True)
    else:
        there = [scheme + f for f in listed if _exists(spark, scheme + f)]
        if not there:
            return spark.createDataFrame([], "file string, text string")
        raw = spark.read.text(there, wholetext=True)
    place = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return raw.select(F.regexp_replace(place, r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", "").alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("text"))


def _exists(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(sc._jsc.hadoopConfiguration()).exists(target)


def manifest(spark: SparkSession, path: str, base: str) -> DataFrame:
    """(doc_id, text, path, output): the documents that a manifest lists, by absolute paths or relative
    to a folder; each line is one document, and files that are not there have a null text."""
    rows = manifest_rows(spark.read.text(path)).withColumn("file", resolved(F.col("path"), base))
    return rows.join(texts_at(spark, rows, base), "file", "left").select("doc_id", "text", "path", "output")


def expand_environment(value, env=None):
    """${NAME} in every text of a nested configuration; unknown names are empty."""
    env = os.environ if env is None else env
    if isinstance(value, dict):
        return {k: expand_environment(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expand_environment(v, env) for v in value]
    return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], ""), value) if isinstance(value, str) else value


def load_config(path: str, env=None) -> dict:
    with open(path, "rb") as f:
        return expand_environment(tomllib.load(f) if path.endswith(".toml") else json.load(f), env)


def secret(config: dict, env=None) -> str:
    """The environment's key, if its variable is named and set, before the configured one."""
    env = os.environ if env is None else env
    return env.get(config.get("api_key_env", ""), "") or str(config.get("api_key", ""))


def preset(config: dict) -> dict:
    """Settings of the chosen model: a preset's, overridden by the explicit ones."""
    chosen = dict(config.get("presets", {}).get(config.get("model", ""), {}))
    return chosen | {k: v for k, v in config.items() if k != "presets" and not (k == "model" and chosen.get("path"))}


def record_schema() -> str:
    return ", ".join(f"`{g}` struct<{', '.join(f'`{n}`: string' for n in names.split())}>" for g, names in GROUPS.items())


def _long(df: DataFrame) -> DataFrame:
    parts = [F.struct(F.lit(n).alias("field"), F.coalesce(F.col(f"r.`{g}`.`{n}`"), F.lit(MISSING)).alias("value")) for g, names in GROUPS.items() for n in names.split()]
    return df.select("doc_id", F.explode(F.array(*parts)).alias("x")).select("doc_id", "x.*")


def gold_files(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, field, value) of nested reference files; one in result/ goes before one in the root."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True)
    raw = raw.select("value", F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("doc_id"), F.col("_metadata.file_path").contains("/result/").cast("int").alias("first"))
    best = raw.groupBy("doc_id").agg(F.max_by("value", "first").alias("value"))
    return _long(best.select("doc_id", F.from_json("value", record_schema()).alias("r")))


def gold_aggregate(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, field, value) of one file {name: nested record}."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string, struct<{record_schema().replace('` struct', '`: struct')}>>")).alias("doc_id", "r"))
    return _long(raw)


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """(field, presence_rate); a file that is missing or no JSON gives no rows."""
    try:
        raw = spark.read.text(path, wholetext=True)
        return raw.select(F.explode(F.from_json(F.get_json_object("value", "$.presence_rate"), "map<string,double>")).alias("field", "presence_rate"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "field string, presence_rate double")


#: Folders of the three files of a document, and what follows its name.
ARTEFACTS = {"result": "", "score": "_score", "context": "_context"}


def write_records(records: DataFrame, out: str, kind: str) -> DataFrame:
    """result/{stem}.json, score/{stem}_score.json or context/{stem}_context.json of rows (doc_id, json),
    UTF-8 as it is.  A file a document is an export for people: the driver writes them one after another
    as partitions arrive, holding one partition.  Returns (doc_id, path)."""
    spark = records.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = f"{out.rstrip('/')}/{kind}"
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(conf)
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(folder))
    done = []
    for r in records.select(F.col("doc_id").cast("string").alias("doc_id"), "json").toLocalIterator():
        path = f"{folder}/{r.doc_id}{ARTEFACTS[kind]}.json"
        stream = fs.create(jvm.org.apache.hadoop.fs.Path(path), True)
        stream.write(bytearray((r.json or "").encode()))
        stream.close()
        done.append((r.doc_id, path))
    return spark.createDataFrame(done, "doc_id string, path string")


def export_zip(spark: SparkSession, out: str, target: str) -> int:
    """The final records of a folder, without scores and contexts, as one archive; how many there are."""
    sc = spark.sparkContext
    raw = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").format("binaryFile").load(out)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = raw.select(name.alias("name"), "content").where(~name.rlike(r"_(?:score|context)\.json$")).orderBy("name")
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
        names = [z.writestr(r.name, bytes(r.content)) or r.name for r in rows.toLocalIterator()]
    path = sc._jvm.org.apache.hadoop.fs.Path(target)
    stream = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    stream.write(bytearray(body.getvalue()))
    stream.close()
    return len(names)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Where it is unset a local session gets one of its own; a
    cluster's machines would not share that, so there it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def run_summary(items: DataFrame) -> DataFrame:
    """(status, n) over items (doc_id, error), and a total."""
    return items.withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("error")).rollup("status").agg(F.count("*").alias("n")).select(F.coalesce("status", F.lit("__ALL__")).alias("status"), "n")


def exit_code(items: DataFrame) -> int:
    return 2 if items.where("error IS NOT NULL").take(1) else 0


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header that begins with a byte-order mark, so that spreadsheets read UTF-8."""
    first, *rest = df.columns
    df.select(F.col(f"`{first}`").alias("\ufeff" + first), *[F.col(f"`{c}`") for c in rest]).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def save_state(df: DataFrame, path: str) -> str:
    """A batch's state: a new version beside the old ones, then the name of the version in a pointer
    that is made in one step, so a reader sees the old state or the new one.  Returns the
    version's folder."""
    sc = df.sparkSession.sparkContext
    at = lambda p: sc._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(sc._jsc.hadoopConfiguration())
    old = [int(s.getPath().getName()[1:]) for s in fs.globStatus(at(path.rstrip("/") + "/v[0-9]*")) or []]
    version = f"{path.rstrip('/')}/v{max(old, default=0) + 1}"
    df.write.parquet(version)
    pointer = at(f"{path.rstrip('/')}/current-{version.rsplit('v', 1)[1].zfill(12)}")
    fs.create(pointer, False).close()  # one atomic step; the largest pointer counts
    for k in sorted(old)[:-1]:
        fs.delete(at(f"{path.rstrip('/')}/current-{str(k).zfill(12)}"), False)
        fs.delete(at(f"{path.rstrip('/')}/v{k}"), True)
    return version


def load_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The state that the largest pointer names; None before the first one."""
    sc = spark.sparkContext
    root = sc._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/current-*")
    names = [s.getPath().getName() for s in root.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(root) or []]
    return spark.read.parquet(f"{path.rstrip('/')}/v{int(max(names).split('-')[1])}") if names else None


def fields_of(record: dict) -> dict[str, str]:
    """A nested record of one document as a flat one, every field a text."""
    return {n: str((record.get(g) or {}).get(n, MISSING)) for g, names in GROUPS.items() for n in names.split()} if isinstance(record, dict) else dict.fromkeys(FIELDS, MISSING)


def write_cluster_report(clusters: DataFrame, frequency: DataFrame, top_terms: DataFrame, out: str) -> None:
    """Three CSV folders for people: clusters (file, cluster, cluster_probability), document_frequency,
    most frequent terms first, and cluster_top_terms with the rank of a term in its cluster."""
    write_csv(clusters.select(F.col("doc_id").alias("file"), "cluster", F.round("probability", 6).alias("cluster_probability")), f"{out}/clusters")
    write_csv(frequency.orderBy(F.desc("df"), "term"), f"{out}/document_frequency")
    write_csv(top_terms.orderBy("cluster", "rank"), f"{out}/cluster_top_terms")
