"""The decomposition against a whole one, and documents without a term."""

import numpy as np

from quillspark.operators import similarity as S
from quillspark.plans import registry


def exact(weights, most):
    terms = {t: k for k, t in enumerate(sorted({r.term for r in weights}))}
    ids = {d: k for k, d in enumerate(sorted({r.doc_id for r in weights}))}
    a = np.zeros((len(ids), len(terms)))
    for r in weights:
        a[ids[r.doc_id], terms[r.term]] = r.w
    v = np.linalg.svd(a, full_matrices=False)[2][:most].T
    x = a @ v
    return ids, x / np.linalg.norm(x, axis=1, keepdims=True)


def test_many_terms_by_steps(spark):
    r = np.random.default_rng(5)
    topics = r.integers(0, 900, (8, 40))
    texts = [" ".join(f"t{x}" for x in np.concatenate([r.choice(topics[i % 8], 25), r.integers(0, 900, 15)])) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    w = S.tfidf(S.term_counts(docs, ngrams=1), spark.createDataFrame([(300,)], "n long"), max_features=10_000).cache()
    assert w.select("term").distinct().count() > S.SMALL_GRAM
    got = {x.doc_id: np.array(x.vector) for x in S.svd_vectors(w, most=8).collect()}
    ids, want = exact(w.collect(), 8)
    mine = np.array([got[d] for d in ids])
    assert mine.shape == want.shape and np.abs(mine @ mine.T - want @ want.T).max() < 1e-6


def test_documents_without_a_term(spark):
    docs = spark.createDataFrame([(1, "red apple"), (2, "red apple pie"), (3, "blue car"), (4, "blue car pie"), (5, ""), (6, None), (None, "x")], "doc_id long, text string")
    w = S.tfidf(S.term_counts(docs), spark.createDataFrame([(7,)], "n long"))
    got = {r.doc_id: r.vector for r in S.svd_vectors(w, ids=docs.select("doc_id")).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, None} and len({len(v) for v in got.values()}) == 1
    assert all(not any(got[d]) for d in (5, 6, None)) and all(abs(np.linalg.norm(got[d]) - 1) < 1e-9 for d in (1, 2, 3, 4))
    none = {r.doc_id: r.vector for r in S.svd_vectors(w.limit(0), ids=docs.select("doc_id")).collect()}
    assert set(none) == set(got) and not any(x for v in none.values() for x in v)


def test_query_has_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = registry.queries()["svd_vectors"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count() and {len(r.vector) for r in rows} == {30}


def test_runs_of_words_are_made_without_a_shuffle_of_words(spark):
    """words were sorted by document and place to pair them; now a text's runs come from its own row."""
    docs = spark.createDataFrame([(1, "red the apple pie red apple"), (2, "pie"), (3, ""), (4, None)], "doc_id long, text string")
    stop = spark.createDataFrame([("the",)], "term string")
    got = S.term_counts(docs, stop, ngrams=3)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    want = {"red": 2, "apple": 2, "pie": 1, "red apple": 2, "apple pie": 1, "pie red": 1, "red apple pie": 1, "apple pie red": 1, "pie red apple": 1}
    assert {(r.doc_id, r.term): r.tf for r in got.collect()} == {(1, t): n for t, n in want.items()} | {(2, "pie"): 1}
