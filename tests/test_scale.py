"""What a task gets does not grow with the tables."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import anonymize, segment, similarity, spread
from quillspark.plans import planted

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("texts", [planted.identities, planted.letters])
def test_texts_of_a_small_table_are_dealt_over_all_cores(spark, texts):
    """a file of one part was one task for all texts."""
    sizes = texts(spark, SMALL).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= spark.sparkContext.defaultParallelism


def test_tasks_follow_the_bytes_that_are_read(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    n = spread.input_bytes(orders)
    assert n > 0 and spread.input_bytes(orders.unionByName(orders)) == 2 * n
    assert spread.by_key(orders, "o_orderkey", each=n // 9).rdd.getNumPartitions() >= 9
    assert spread.by_key(orders, "o_orderkey") is orders


def test_islands_of_rows_are_those_of_a_text(spark):
    """the merge as windows; the column of arrays held all spans of thousands of groups in Python."""
    rng = np.random.default_rng(3)
    rows = [(int(g), int(a), int(a + n), "XYZ"[k]) for g, a, n, k in zip(rng.integers(0, 5, 400), rng.integers(0, 300, 400), rng.integers(1, 12, 400), rng.integers(0, 3, 400), strict=True)]
    got = anonymize.merged_kinds(spark.createDataFrame(rows, "doc_id long, start int, end int, kind string"))
    assert "Python" not in plan(got) and "Pandas" not in plan(got)
    want = [(g, s.start, s.end, s.kind) for g in range(5) for s in anonymize.merge(anonymize.Span(a, b, k) for i, a, b, k in rows if i == g)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, each", [("merged_spans", 4), ("span_islands", 4), ("file_scores", 4), ("anti_missing_gold", 0.5)])
def test_shuffles_follow_the_input(spark, monkeypatch, name, each):
    """F6, F14, F15, F16: a fixed number of shuffle partitions made each of them grow with the tables."""
    monkeypatch.setattr(spread, "input_bytes", lambda df: 40 * int(each * (1 << 20)))
    dealt = set(re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\)", plan(planted.queries()[name](spark, SMALL))))
    assert "40" in dealt and (name == "file_scores" or dealt == {"40"})


def test_density_clusters_by_blocks(spark):
    """a batch beyond the limit was refused.  By pairs of blocks it has the clusters of one task, copies included."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.4, (60, 3)) for c in (0, 4, 8)] + [rng.uniform(-3, 11, (20, 3))])
    whole = np.unique(rng.integers(0, 60, (150, 2)), axis=0).astype(float)  # whole numbers: the distances of one task are exact
    whole = np.concatenate([whole, whole[:40], whole[:40], whole[:40]])
    for some in (x, whole):
        v = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(some)], "doc_id long, vector array<double>")
        got = {r.doc_id: r for r in similarity.clustered(v, limit=10, block=50).collect()}
        labels, member = similarity.density_clusters(some)
        assert len(got) == len(some)
        if some is x:
            assert [got[k].cluster for k in range(len(x))] == labels.tolist() and len(set(labels)) > 2
            assert np.allclose([got[k].probability for k in range(len(x))], member, atol=1e-6)
    d = np.sort(np.sqrt(((whole[:, None] - whole) ** 2).sum(2)), 1)[:, 2]
    points, copies = np.unique(whole, axis=0, return_counts=True)
    core = similarity._cores(points, copies, np.arange(len(points)), 2, width=16)
    assert np.allclose([core[(points == p).all(1)][0] for p in whole], d)


def test_sentences_are_made_a_slice_at_a_time(spark, monkeypatch):
    """the sentences of a whole batch of texts were Python's objects at once."""
    texts = ["One. Two!  Three?\n\nfour", None, "", "  \n ", "Один. Два"] * 100
    most = []
    monkeypatch.setattr(segment, "_spans", lambda some, f=segment._spans: most.append(len(some)) or f(some))
    want = [[(a, b, t[a:b]) for a, b in segment.sentences(t)] if t else [] for t in texts]
    made = segment.sentence_spans("t")
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", made.alias("s")).collect()
    assert [[tuple(x) for x in r.s] for r in sorted(got, key=lambda r: r.k)] == want
    whole = pa.concat_arrays([segment._spans(pa.array(texts[at:at + segment.SLICE])) for at in range(0, len(texts), segment.SLICE)])
    assert [[tuple(x.values()) for x in row] for row in whole.to_pylist()] == want and max(most) <= segment.SLICE
