"""The pipeline's stages on rows that share an id, or have none."""

from collections import Counter

import corpus_pipeline as p
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspark.llm import toxicity
from quillspark.llm.common import checkpointed

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


def prose(seed, n=60):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n))


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.fixture(scope="module")
def stage():
    return dict(p.STAGES)


def test_repeated_row_through_all_stages(spark, stage):
    a, b = prose(1), prose(2)
    docs = table(spark, [(3, a), (3, a), (4, b), (None, None), (None, "")])
    kept = stage["exact_dedup"](spark, docs, SF)
    got = rows_of(kept)
    assert got[3, a] == got[4, b] == 1 and len(kept.collect()) == 3
    for name in ("toxicity", "exact_dedup", "ngram_jaccard_join", "substring_dedup"):
        docs = checkpointed(stage[name](spark, docs, SF))
    got = rows_of(docs)
    assert got[3, a] == got[4, b] == 1 and sum(got.values()) == 3
    pieces = stage["packing"](spark, docs, SF).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r.length for r in pieces if r.doc_id == 3) == len(t.encode(a, add_special_tokens=False).ids) + 1


def test_passages_row_by_row(spark, stage):
    a, b = prose(3), prose(4)
    docs = table(spark, [(3, a), (3, a), (5, b), (5, "short"), (6, None), (7, "")])
    out = stage["substring_dedup"](spark, docs, SF)
    assert out.columns == docs.columns
    assert rows_of(out) == Counter([(3, a), (3, ""), (5, b), (5, "short"), (6, None), (7, "")])
    assert {(r.doc_id, r.text): r.n_chars for r in out.collect()} == {(3, a): len(a), (3, ""): 0, (5, b): len(b), (5, "short"): 5, (6, None): None, (7, ""): 0}


def test_rows_of_one_id_are_decided_apart(spark, stage):
    a, b, c = prose(5), prose(6), prose(7)
    near = b.replace(b.split()[30], "other", 1)
    rows = [(5, a), (9, a), (5, b), (None, c), (2, c), (None, "lone words"), (None, None)]
    assert rows_of(stage["exact_dedup"](spark, table(spark, rows), SF)) == Counter([(9, a), (5, b), (2, c), (None, "lone words"), (None, None)])
    rows = [(5, a), (5, b), (8, near), (None, near + " more"), (None, c), (-4, "x"), (2**62 + 9, "y")]
    got = rows_of(stage["ngram_jaccard_join"](spark, table(spark, rows), SF))
    assert got == Counter([(5, a), (8, near), (None, c), (-4, "x"), (2**62 + 9, "y")])
    rows = [(5, a), (5, b), (9, f"{b} end"), (None, a)]
    assert rows_of(stage["substring_dedup"](spark, table(spark, rows), SF)) == Counter([(5, a), (5, b), (9, "end"), (None, "")])


def test_toxic_rows_go_alone(spark, stage):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.toxicity_scores(docs, labels).join(docs.select("doc_id", "text"), "doc_id")
    bad, good = (scored.where(f"predicted = {k}").orderBy("doc_id").first().text for k in (1, 0))
    extra = table(spark, [(10**9, bad), (10**9, good), (None, bad), (None, good), (None, None)])
    out = stage["toxicity"](spark, docs.unionByName(extra.select([extra[f.name].cast(f.dataType) for f in docs.schema])), sf)
    new = rows_of(out.where(f"doc_id IS NULL OR doc_id = {10**9}"))
    assert new == Counter([(10**9, good), (None, good), (None, None)]) and out.columns == docs.columns
