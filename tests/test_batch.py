import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions.catalog import MISSING
from quillspark.operators import anonymize, evaluate, routing, typo
from quillspark.operators import similarity as S
from quillspark.sources import files
from quillspark.streaming.worker import parse_lines, read_stream, run_worker


def test_density_clusters():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (20, 2)) for c in (0, 5, 10)] + [[[100.0, 100.0]]])
    labels, member = S.density_clusters(x)
    assert labels[-1] == -1 and len(set(labels[:60])) == 3 and all(len(set(labels[k:k + 20])) == 1 for k in (0, 20, 40))
    assert ((member >= 0) & (member <= 1)).all()
    assert set(S.density_clusters(x[:3])[0]) == {-1}


def test_probes_are_unique():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(12, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = S.select_probes(list(range(12)), v, list(range(12)), [0] * 5 + [1] * 5 + [-1] * 2, [1.0] * 12)
    assert len({i for i, _ in got}) == 5 and [r for _, r in got][:2] == ["medoid", "medoid"]
    assert S.select_probes([], v[:0], [], [], []) == []


def test_svd_separates(spark):
    texts = spark.createDataFrame([(i, ("red apple fruit " if i % 2 else "blue car road ") * (1 + i % 3)) for i in range(10)], "doc_id long, text string")
    w = S.tfidf(S.term_counts(texts), texts.agg(F.count("*").alias("n")))
    rows = {r.doc_id: np.array(r.vector) for r in S.svd_vectors(w).collect()}
    assert rows[1] @ rows[3] > 0.9 and abs(rows[0] @ rows[1]) < 0.05


def test_priors_leave_the_document_out(spark):
    v = spark.createDataFrame([(1, "f", "a"), (2, "f", "a"), (3, "f", "b")], "doc_id long, field string, value string")
    c = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, -1)], "doc_id long, cluster int")
    near = spark.createDataFrame([], "doc_id long, neighbour long, similarity double")
    got = {(r.doc_id, r.value): r.support for r in S.peer_priors(v, c, near).collect()}
    assert got == {(1, "a"): 0.5, (1, "b"): 0.5, (2, "a"): 0.5, (2, "b"): 0.5, (3, "a"): 1.0}


def test_anonymize(spark):
    text = "ФИО: Иванов Иван Иванович, тел. +7 (912) 345-67-89, a.b@c.ru, возраст: 54 года.\nБолеет 10 лет."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in anonymize.anonymize(docs).collect()}
    assert "Иванов" not in got[1].redacted and "<EMAIL_1>" in got[1].redacted and "10 лет" in got[1].redacted and got[1].safe
    assert got[2].redacted == got[3].redacted == "" and got[2].counts == {}
    spans = [anonymize.Span(0, 5, "A"), anonymize.Span(1, 3, "B"), anonymize.Span(4, 9, "B", "x"), anonymize.Span(9, 10, "A")]
    assert [(s.start, s.end, s.kind) for s in anonymize.merge(spans)] == [(0, 9, "PII"), (9, 10, "A")]
    assert anonymize.redact("abc", []) == ("abc", {})


def test_policy(spark):
    rows = [(i, 1, "hb", "semantic_conflict") for i in range(3)] + [(i, 1, "hf", "agree") for i in range(3)]
    p = routing.probe_policy(spark.createDataFrame(rows, "doc_id long, cluster int, field string, event string"))
    assert {(r.scope, r.field, r["mode"]) for r in p.collect()} == {("global", "hb", "both_always"), ("cluster", "hb", "both_always")}
    shift = spark.createDataFrame([("hf", True), ("hb", True)], "field string, flagged boolean")
    merged = {(r.scope, r.field): (r["mode"], r.reasons) for r in routing.with_shift(p, shift).collect()}
    assert merged[("global", "hf")] == ("api_always", ["batch_regex_coverage_shift"]) and merged[("global", "hb")][0] == "both_always"


def test_presence_scores_defaults(spark):
    t = lambda rows: spark.createDataFrame(rows, "doc_id long, field string, value string")
    r = evaluate.presence_scores(t([(1, "f", MISSING)]), t([(1, "f", MISSING)])).first()
    assert (r.precision, r.recall, r.f1) == (1.0, 1.0, 1.0)
    chats, skipped = evaluate.chat_rows(spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string"), t([(1, "f", "v")]), spark.createDataFrame([("f", "g")], "field string, grp string"))
    assert chats.count() == 1 and [x.doc_id for x in skipped.collect()] == [2]


def test_folder_and_manifest(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.md").write_text("﻿текст\nвторой", encoding="utf-8")
    (tmp_path / "in/sub/b.TXT").write_text("b", encoding="utf-8")
    (tmp_path / "in/c.pdf").write_text("c")
    got = {r.doc_id: r.text for r in files.folder(spark, str(tmp_path / "in")).collect()}
    assert got == {"a": "текст\nвторой", "b": "b"}
    (tmp_path / "m.jsonl").write_text('{"path": "a.md", "id": "first"}\n"sub/b.TXT"\n\nmissing.md\n')
    rows = {r.doc_id: r.text for r in files.manifest(spark, str(tmp_path / "m.jsonl"), str(tmp_path / "in")).collect()}
    assert rows == {"first": "текст\nвторой", "b": "b", "missing": None}


def test_manifest_of_equal_names(spark, tmp_path):
    for k in "pq":
        (tmp_path / k).mkdir()
        (tmp_path / k / "same.md").write_text(k)
    (tmp_path / "q/other name+.dat").write_text("x")
    lines = ['{"path": "p/same.md", "id": "one"}', '{"path": "q/./same.md", "id": "two"}', str(tmp_path / "q/other name+.dat")]
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    rows = sorted((r.doc_id, r.text) for r in files.manifest(spark, str(tmp_path / "m.jsonl"), str(tmp_path)).collect())
    assert rows == [("one", "p"), ("other name+", "x"), ("two", "q")]


def test_artefacts_and_archive(spark, tmp_path):
    import zipfile

    rows = spark.createDataFrame([("a", '{"x": "ё"}'), ("b", "{}")], "doc_id string, json string")
    for kind in files.ARTEFACTS:
        files.write_records(rows, str(tmp_path / "out"), kind)
    assert (tmp_path / "out/result/a.json").read_text(encoding="utf-8") == '{"x": "ё"}'
    assert (tmp_path / "out/score/b_score.json").exists() and (tmp_path / "out/context/a_context.json").exists()
    assert files.export_zip(spark, str(tmp_path / "out"), str(tmp_path / "all.zip")) == 2
    assert sorted(zipfile.ZipFile(tmp_path / "all.zip").namelist()) == ["a.json", "b.json"]
    files.write_csv(rows, str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("part-*")).read_bytes().startswith(b"\xef\xbb\xbfdoc_id")


def test_config_and_state(spark, tmp_path):
    assert files.expand_environment({"a": ["${X}-${Y}"]}, {"X": "1"}) == {"a": ["1-"]}
    assert files.secret({"api_key_env": "K", "api_key": "c"}, {"K": "e"}) == "e" and files.secret({"api_key": "c"}, {}) == "c"
    path = str(tmp_path / "state")
    for n in (1, 2):
        files.save_state(spark.range(n), path)
        assert files.load_state(spark, path).count() == n
    assert files.load_state(spark, str(tmp_path / "nothing")) is None
    assert files.baseline(spark, str(tmp_path / "none.json")).count() == 0
    items = spark.createDataFrame([("a", None), ("b", "x")], "doc_id string, error string")
    assert {(r.status, r.n) for r in files.run_summary(items).collect()} == {("ok", 1), ("error", 1), ("__ALL__", 2)} and files.exit_code(items) == 2


def test_worker_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "y.md").write_text("from a file")
    (tmp_path / "in/1.jsonl").write_text('{"text": "a b", "stem": "x"}\nnonsense\n\n{"path": "%s"}\n{"path": "/none/z.md"}\n' % (tmp_path / "y.md"))
    bad = parse_lines(spark.read.text(str(tmp_path / "in"))).collect()
    assert {(r.doc_id, r.error is None) for r in bad if r.error is None} == {("x", True), ("y", True), ("z", True)} and len(bad) == 4
    q = run_worker(read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), lambda d: d.withColumn("n", F.length("text")))
    q.awaitTermination(60)
    assert {(r.doc_id, r.n) for r in spark.read.parquet(str(tmp_path / "out/results")).collect()} == {("x", 3), ("y", 11)}
    assert sorted(r.error for r in spark.read.parquet(str(tmp_path / "out/errors")).collect()) == ["no file /none/z.md", "not a document line"]


def test_typo_blocking(spark):
    words = spark.createDataFrame([("бисопроллол",), ("стена",)], "word string")
    lex = spark.createDataFrame([(w,) for w in typo.LEXICON], "entry string")
    assert [(r.word, r.entry) for r in typo.blocked_pairs(words, lex).collect()] == [("бисопроллол", "бисопролол")]
    assert typo.corrected("бисопроллол") == "бисопролол" and typo.corrected("бисопролол") is None


def test_registry():
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 40


@pytest.mark.parametrize("text", ["", None])
def test_similarity_of_nothing(spark, text):
    t = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert S.document_frequency(t).count() == 0
