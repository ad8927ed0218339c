"""Language identification as mixture inference over n-gram likelihoods.

Each language is a distribution over hashed byte trigrams, counted over all training
documents.  A document is a mixture of languages: expectation-maximisation estimates the
proportions, and the set of languages with the best likelihood, less a penalty for each language
more, is chosen.  One language is compared with what any mixture could reach (a bound from the
concavity of the likelihood); only where a further one may pay are all pairs tried, and larger sets
grow from the best pair a language at a time, as long as the bound leaves room.  The prediction is the
language with the largest proportion in that set, the score its proportion.

Defined results: null text, or text without a letter, is `und` with score 0.  Documents
without a lang, or with a null doc_id's remainder 0, teach nothing.  With nothing learned, every
document is `und`.  Equal proportions: the language that sorts first.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, exact_columns

BINS = 1 << 15
ROUNDS = 12
#: What a further language must add to the log-likelihood, times half the log of the n-grams.
PENALTY = 4.0
_SPACES = bytes(range(65)) + bytes(range(91, 97)) + bytes(range(123, 128))
_CLEAN = bytes.maketrans(_SPACES + bytes(range(65, 91)), b" " * len(_SPACES) + bytes(range(97, 123)))
_LETTER = re.compile(r"[^\W\d_]")


def bins_of(text: bytes) -> np.ndarray:
    """Bins of the byte trigrams of a text, except those without a letter.  Texts that are joined by
    two blanks have the bins of each, so counts do not depend on how texts are batched."""
    b = np.frombuffer(b"  " + text.translate(_CLEAN) + b"  ", np.uint8)
    blank = b == 32
    b = b.astype(np.uint32)
    code = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    few = blank[:-2].astype(np.uint8) + blank[1:-1] + blank[2:] < 3
    return (code[few] * np.uint32(2654435761)) >> np.uint32(32 - 15)


def _count(batches):
    """Trigram counts by language: one vector a language and task."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        by: dict[str, list] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            for k in range(0, len(texts), 64):
                found = np.bincount(bins_of(b"  ".join(texts[k:k + 64])), minlength=BINS)
                sums[lang] = sums[lang] + found if lang in sums else found
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())], names=["lang", "vec"])


def _sum(table: pa.Table) -> pa.Table:
    vectors = [np.frombuffer(v, "<i8") for v in table.column("vec").to_pylist()]
    return pa.table({"lang": table.column("lang").slice(0, 1), "vec": pa.array([sum(vectors[1:], vectors[0]).tobytes()], pa.binary())})


def learn(docs: DataFrame, held_out, id_col: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages and their distributions over the bins, from all documents that aren't held out."""
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out).select("lang", "text")
    rows = train.mapInArrow(_count, "lang string, vec binary").groupBy("lang").applyInArrow(_sum, "lang string, vec binary").collect()
    langs = sorted(rows, key=lambda r: r.lang)
    counts = np.array([np.frombuffer(r.vec, "<i8") for r in langs], float).reshape(len(langs), BINS) + 0.05
    return [r.lang for r in langs], counts / counts.sum(1, keepdims=True)


def proportions(p: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """EM over the mixture weights; p: languages by distinct n-grams. Also the log-likelihood."""
    w, n = start, counts.sum()
    for _ in range(rounds):
        joint = w[:, None] * p
        whole = joint.sum(0)
        w = joint @ (counts / whole) / n
    return w, float(counts @ np.log(w @ p))


def most(p: np.ndarray, counts: np.ndarray, w: np.ndarray, like: float) -> float:
    """What the log-likelihood of no mixture exceeds: it is concave, and its slope towards one language
    at w is the mean of that language's likelihood ratios."""
    n = counts.sum()
    return like + n * float(np.log((p @ (counts / (w @ p)) / n).max()))


def mixture(p: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Proportions of all languages in a document: zero outside the chosen set."""
    at, counts = np.unique(bins, return_counts=True)
    q, m, out = p[:, at], len(p), np.zeros(len(p))
    price = PENALTY * np.log(len(bins) + 1) / 2  # of each language after the first
    singles = np.log(q) @ counts
    first = int(np.argmax(singles))
    best, chosen = float(singles[first]), ((first,), np.ones(1))
    w, like = proportions(q, counts, np.full(m, 1 / m), 3)
    bound = most(q, counts, w, like)
    if m > 1 and bound - price > best:
        w, like = proportions(q, counts, w)
        bound = min(bound, most(q, counts, w, like))
    tried = combinations(range(m), 2)
    for k in range(2, m + 1):
        if bound - price * (k - 1) <= best:
            break
        top = None
        for some in tried:
            part = q[list(some)]
            v, like = proportions(part, counts, np.full(k, 1 / k))
            if top is None or like > top[0]:
                top = (like, some, v)
        if top[0] - price * (k - 1) > best:
            best, chosen = top[0] - price * (k - 1), top[1:]
        tried = [(*top[1], j) for j in range(m) if j not in top[1]]
    out[list(chosen[0])] = chosen[1]
    return out


def identify(docs: DataFrame, held_out=None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, mixture) where mixture has the chosen languages'
    proportions as `lang:share`.  Learns from the documents that aren't held out."""
    texts = exact_columns(docs, id_col, "text", "lang").toDF("doc_id", "text", "lang")
    held = held_out if held_out is not None else F.pmod(crc_of_id(), F.lit(5)) == 0
    langs, p = learn(texts, held)

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column("text").cast(pa.binary()).to_pylist():
                bins = bins_of(t) if t and langs and _LETTER.search(t.decode("utf-8", "replace")) else ()
                if not len(bins):
                    out.append(("und", 0.0, ""))
                    continue
                w = mixture(p, bins)
                k = int(np.argmax(w))
                out.append((langs[k], float(min(1.0, w[k])), ",".join(f"{langs[i]}:{w[i]:.3f}" for i in np.flatnonzero(w))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *(pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.float64(), pa.string())))], names=["doc_id", "held_out", "lang_pred", "score", "mixture"])

    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, mixture string")
