"""Routing with providers that fail, switches, run matrices, records for display, neighbours, reports."""

import io
import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import labels
from quillspark.functions.catalog import CLINICAL_WEIGHTS, FIELDS, MISSING
from quillspark.operators import providers
from quillspark.operators import similarity as S
from quillspark.plans import matrix, pipeline, redact
from quillspark.sources import files

TEXT = "Диагноз: гипертоническая болезнь.\nЛабораторные данные: гемоглобин 130 г/л, креатинин 99 мкмоль/л."


def scripted(log, hb="130"):
    """A provider that writes down what it is asked, and says of hb what it was told to; it runs on workers."""
    path = str(log)

    def answer(system, user):
        asked = json.loads(user.split("\n")[1].removeprefix("FORM "))
        with open(path, "a") as f:
            f.write(" ".join(asked) + "\n")
        if hb is None:
            raise OSError("down")
        return json.dumps({f: {"value": hb, "evidence": "гемоглобин 130"} if f == "hb" else {"value": MISSING, "evidence": ""} for f in asked}, ensure_ascii=False)

    return answer


def asked_of(log):
    return log.read_text().split() if log.exists() else []


def test_fallback(spark, tmp_path):
    docs = spark.createDataFrame([("a", TEXT)], "doc_id string, text string")
    policy = spark.createDataFrame([("a", "hb", True, False, True, 0.0)], "doc_id string, field string, api_always boolean, local_always boolean, local_on_disagreement boolean, llm_bonus double")
    modes = {"api": "disabled", "local": "disabled"}

    def locally(name, **more):
        out = pipeline.run(docs, local=scripted(tmp_path / name), modes=modes, **more)
        return asked_of(tmp_path / name), [r.provider for r in out.errors.collect()]

    assert locally("none", policy=policy) == (["hb"], [])
    assert locally("off", policy=policy, fall_back=False) == ([], [])
    assert locally("down", policy=policy, api=scripted(tmp_path / "api1", None)) == (["hb"], ["api"])
    assert locally("agrees", policy=policy, api=scripted(tmp_path / "api2")) == ([], [])
    assert asked_of(tmp_path / "api2") == ["hb"]
    asked, failed = locally("probe", probes=docs, api=scripted(tmp_path / "api3", None))
    assert failed == ["api"] and asked and len(set(asked)) == len(asked) < len(FIELDS)


def test_switches():
    config = {"pipeline": {"use_api": True, "use_local": True}, "api": {"enabled": True, "base_url": "u", "model": "m", "api_key_env": "K"}, "models": {"local_backend": "b"}}
    assert providers.usable(config, {"K": "x"}) == {"api": True, "local": True}
    assert providers.usable(config, {}) == {"api": False, "local": True}
    assert providers.usable(config, {"K": providers.NO_KEY, "LOCAL_LLM_ENABLED": " Off "}) == {"api": False, "local": False}
    assert providers.usable({}, {"LLM_API_ENABLED": "1"}) == {"api": False, "local": False}

    def make(name, settings):
        if name == "local":
            raise RuntimeError("no model")
        return settings["model"]

    assert providers.configured(config, make, {"K": "x"}) == ({"api": "m"}, [("local", "RuntimeError('no model')")])


def test_run_matrix(spark, tmp_path):
    docs = spark.createDataFrame([("a", TEXT)], "doc_id string, text string")
    api = {"kind": "api", "name": "far", "base_url": "u", "model": "m/1", "api_key": "k"}
    runs = [{"kind": "local", "name": "near", "model_alias": "small", "local_mode": "uncertain"}, api, {**api, "kind": "hybrid"}, {"kind": "?", "enabled": False}]
    assert matrix.run_names(spark, runs[:3] + [api]) == ["local__near__small", "api__far__m_1", "hybrid__far", "api__far__m_1~2"]
    gold = spark.createDataFrame([("a", "hb", "130"), ("a", "crea", "1")], "doc_id string, field string, value string")
    got = matrix.run_matrix(docs, runs, lambda run, p: scripted(tmp_path / f"{run['kind']}-{p}"), str(tmp_path / "out"), gold)
    assert {(r.run, r.documents) for r in got.summary.collect()} == {("local__near__small", 1), ("api__far__m_1", 1), ("hybrid__far", 1)}
    assert len(asked_of(tmp_path / "api-api")) == len(FIELDS) and asked_of(tmp_path / "api-local") == []
    assert got.agreement.where("field = '__ALL__'").count() == 3
    assert {r.accuracy for r in got.accuracy.where("field = 'hb'").collect()} == {1.0} and {r.accuracy for r in got.accuracy.where("field = 'crea'").collect()} == {0.0}
    for bad in ([], [{"kind": "?"}], [{**api, "api_key": ""}]):
        with pytest.raises(ValueError):
            matrix.checked_runs(bad, {})
    assert matrix.run_matrix(docs.limit(0), [runs[0]], lambda run, p: scripted(tmp_path / "x"), str(tmp_path / "none")).records.count() == 0


def test_history(spark):
    assert set(labels.DESCRIPTIONS) == set(FIELDS)
    rows = spark.createDataFrame([(1, "killip", "2"), (1, "dm", "1"), (1, "hb", None), (1, "type_acs", "НЕ указано"), (1, "no_such", "x"), (1, "admission_date", "01.02.2020")], "doc_id long, field string, value string")
    got = {r.path.split(".")[1]: r for r in labels.history(rows).collect()}
    assert set(got) == {"killip", "dm", "hb", "type_acs", "admission_date"}
    assert (got["killip"].value, got["dm"].value, got["hb"].value, got["type_acs"].value) == ("2 класс", "да", MISSING, MISSING)
    assert got["dm"].label == "Диабет" and got["dm"].title == "Диагноз" and got["hb"].raw_value is None
    shown = json.loads(labels.history_json(rows).first().json)
    assert [s["title"] for s in shown] == ["Даты эпизода", "Диагноз", "Лабораторные данные"]
    assert [f["path"].split(".")[1] for f in shown[1]["fields"]] == ["dm", "killip", "type_acs"]
    assert labels.history_json(rows.limit(0)).count() == 0


def test_neighbours_are_those_of_all_pairs(spark):
    w, names, top = CLINICAL_WEIGHTS, list(CLINICAL_WEIGHTS), 4
    docs = {}
    for i in range(90):
        k = 7 if i % 3 == 0 else i * 2654435761 % 1000  # a third are copies of one record
        docs[i] = {f: str((k >> n) % (3 if n < 3 else 2)) for n, f in enumerate(names) if (k * 31 + n * 17) % 5}
    docs[90] = {"dm": "1"}
    want = {}
    for i, a in docs.items():
        near = []
        for j, b in docs.items():
            shared = round(sum(w[f] for f in a if f in b), 6)
            if i != j and shared >= 3.0 and (like := round(sum(w[f] for f in a if a[f] == b.get(f)) / shared, 6)) >= 0.72:
                near.append((-like, j, shared))
        want |= {(i, r): (j, -like, shared) for r, (like, j, shared) in enumerate(sorted(near)[:top], 1)}
    rows = spark.createDataFrame([(i, f, v) for i, d in docs.items() for f, v in d.items()], "doc_id long, field string, value string")
    got = S.clinical_neighbours(rows.union(rows.limit(5)), top=top).collect()
    assert len(got) == len(want) > 200 and {(r.doc_id, r.rank): (r.neighbour, r.similarity, r.shared_weight) for r in got} == want
    assert S.clinical_neighbours(rows.limit(0)).count() == 0


def test_cluster_report(spark, tmp_path):
    c = spark.createDataFrame([("a", 0, 1.0), ("b", -1, 0.0)], "doc_id string, cluster int, probability double")
    f = spark.createDataFrame([("x", 1, 0.5), ("y", 2, 1.0)], "term string, df long, share double")
    t = spark.createDataFrame([(0, 1, "y", 0.3)], "cluster int, rank int, term string, mean_w double")
    files.write_cluster_report(c, f, t, str(tmp_path))
    read = lambda name: "".join(p.read_text("utf-8") for p in sorted((tmp_path / name).glob("part-*.csv")) if p.stat().st_size)
    assert "file,cluster,cluster_probability" in read("clusters") and "a,0,1.0" in read("clusters")
    assert read("document_frequency").index("y,2") < read("document_frequency").index("x,1") and "0,1,y,0.3" in read("cluster_top_terms")


def test_redaction_from_the_command_line(spark, tmp_path):
    out = io.StringIO()
    assert redact.main(["-", "--report"], spark, io.StringIO("write to a.b@example.org"), out) == 0
    assert "<EMAIL_1>" in out.getvalue() and "example.org" not in out.getvalue()
    for name, text in (("a.md", "﻿mail x@example.org"), ("b.txt", "nothing"), ("c.csv", "q@example.org")):
        (tmp_path / name).write_text(text, "utf-8")
    assert redact.main([str(tmp_path), "--output", str(tmp_path / "out")], spark) == 0
    got = spark.read.parquet(str(tmp_path / "out/redacted")).select(F.col("redacted")).collect()
    assert sorted(r.redacted for r in got) == ["mail <EMAIL_1>", "nothing"]
