"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins at quantiles of the sample.  Shallow trees over the bins
of one feature at a time are boosted in cycles, so that what a feature contributes is a lookup
table; then the pairs of features that explain most of what is left get tables over two
coarser binnings, boosted alike.  A score is the logistic of a sum of table entries.

Defined results: null text is the empty text, scored like any other.  Without labelled rows of
both classes every score is the share of label 1 in the sample (0.5 without any).  Repeated
rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, id_and_text
from .sampling import labelled_sample, sampled_texts

#: The most labelled rows that the model is fitted on.
SAMPLE_ROWS = 20_000
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "letters", "digits", "upper", "blanks", "marks", "symbols", "high_bytes",
    "bars", "bangs", "stops", "commas", "distinct_words", "top_word", "short_words", "log_lines", "line_words", "same_lines", "entropy", "shouted", "mixed",
)
_CLASS = np.zeros((8, 256), np.float32)
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" \t\n\r\v\f", b".,;:!?'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~", bytes(range(128, 256)), b"|")):
    _CLASS[_k, list(_bytes)] = 1


def features_of(text: bytes) -> list[float]:
    n = max(1, len(text))
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters, digits, upper, blanks, marks, symbols, high, bars = (_CLASS @ hist).tolist()
    words = text.split()
    w = max(1, len(words))
    counts = Counter(words)
    lines = text.split(b"\n")
    filled = hist[hist > 0] / n
    edges = [x[-1:] for x in words]
    shouted = sum(map(bytes.isupper, words))
    mixed = w - sum(map(bytes.isalpha, words)) if words else 0
    return [
        np.log1p(len(text)), np.log1p(len(words)), n / w, letters / n, digits / n, upper / max(1.0, letters), blanks / n, marks / n, symbols / n, high / n,
        bars / w, hist[33] / w, edges.count(b".") / w, hist[44] / w, len(counts) / w, max(counts.values(), default=0) / w, sum(len(x) <= 3 for x in words) / w, np.log1p(len(lines)),
        w / len(lines), 1 - len(set(lines)) / len(lines), float(-(filled * np.log2(filled)).sum()), shouted / w, mixed / w,
    ]


@dataclass
class AdditiveModel:
    base: float
    edges: list  # cut points of each feature
    tables: list  # a value for each bin of each feature
    coarse: list  # fewer cut points, for the pairs
    pairs: list  # (i, j, table over coarse bins)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (cuts, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, k], "right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(x: np.ndarray, n: int) -> np.ndarray:
    q = np.unique(np.quantile(x, np.linspace(0, 1, n + 1)[1:-1], method="higher"))
    return q[q > x.min()] if len(x) else q


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float) -> np.ndarray:
    """Newton steps of a tree over ordered bins: g, h are sums of gradient and curvature a bin."""
    whole = g.sum() / (h.sum() + 1.0)
    if depth == 0 or len(g) < 2:
        return np.full(len(g), whole)
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    rg, rh = g.sum() - cg, h.sum() - ch
    gain = np.where((ch >= least) & (rh >= least), cg**2 / (ch + 1.0) + rg**2 / (rh + 1.0), -np.inf)
    k = int(np.argmax(gain)) + 1
    if not np.isfinite(gain[k - 1]):
        return np.full(len(g), whole)
    return np.concatenate([_tree(g[:k], h[:k], depth - 1, least), _tree(g[k:], h[k:], depth - 1, least)])


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse: int = 8, cycles: int = 120, pair_cycles: int = 40, pairs: int = 8, rate: float = 0.15, least: float = 2.0) -> AdditiveModel:
    n, m = x.shape if x.size else (len(y), len(FEATURES))
    share = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.5
    model = AdditiveModel(float(np.log(share / (1 - share))), [np.empty(0)] * m, [np.zeros(1)] * m, [np.empty(0)] * m, [])
    if len(np.unique(y)) < 2:
        return model
    model.edges = [_cuts(x[:, k], bins) for k in range(m)]
    model.coarse = [_cuts(x[:, k], coarse) for k in range(m)]
    fine = [np.searchsorted(model.edges[k], x[:, k], "right") for k in range(m)]
    wide = [np.searchsorted(model.coarse[k], x[:, k], "right") for k in range(m)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(n, model.base)
    chance = lambda: 1 / (1 + np.exp(-total))
    for _ in range(cycles):
        for k in range(m):
            if len(model.tables[k]) == 1:
                continue
            p = chance()
            size = len(model.tables[k])
            step = rate * _tree(np.bincount(fine[k], y - p, size), np.bincount(fine[k], p * (1 - p), size), 2, least)
            model.tables[k] += step
            total += step[fine[k]]
    p = chance()
    found = []
    for i in range(m):
        for j in range(i + 1, m):
            size = (len(model.coarse[i]) + 1) * (len(model.coarse[j]) + 1)
            cell = wide[i] * (len(model.coarse[j]) + 1) + wide[j]
            g, h = np.bincount(cell, y - p, size), np.bincount(cell, p * (1 - p), size)
            found.append((float((g**2 / (h + least)).sum()), i, j, cell))
    found.sort(key=lambda f: (-f[0], f[1], f[2]))
    found = found[:pairs]
    tables = [np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for _, i, j, _ in found]
    for _ in range(pair_cycles):
        for (_, _, _, cell), table in zip(found, tables, strict=True):
            p = chance()
            g = np.bincount(cell, y - p, table.size).reshape(table.shape)
            h = np.bincount(cell, p * (1 - p), table.size).reshape(table.shape)
            # a tree of two levels: the best cut along one side, then along the other on both halves
            if table.shape[0] > 1:
                cg, ch = np.cumsum(g.sum(1))[:-1], np.cumsum(h.sum(1))[:-1]
                cut = int(np.argmax(cg**2 / (ch + 1) + (g.sum() - cg) ** 2 / (h.sum() - ch + 1))) + 1
            else:
                cut = 1
            step = np.zeros(table.shape)
            for half in (slice(0, cut), slice(cut, None)):
                step[half] = _tree(g[half].sum(0), h[half].sum(0), 1, least)
            table += rate * step
            total += rate * step.ravel()[cell]
    model.pairs = [(i, j, t) for (_, i, j, _), t in zip(found, tables, strict=True)]
    return model


def _features(batches):
    for batch in batches:
        x = [features_of(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])


def train(docs: DataFrame, labels: DataFrame, held_out, label: str = "quality", rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    """Fits on the features of a bounded, hashed sample of labelled rows."""
    texts = sampled_texts(id_and_text(docs, id_col, text_col), labelled_sample(labels, label, held_out, rows))
    got = texts.select("label", "text").mapInArrow(_features, "label int, x array<double>").collect()
    got.sort(key=lambda r: (r.label, r.x))
    return fit(np.array([r.x for r in got]), np.array([r.label for r in got], float))


def quality_scores(docs: DataFrame, labels: DataFrame, held_out=None, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    held = held_out if held_out is not None else F.pmod(crc_of_id(), F.lit(3)) == 1
    model = train(docs, labels, held, label, id_col=id_col, text_col=text_col)

    def run(batches):
        for batch in batches:
            x = np.array([features_of(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]).reshape(batch.num_rows, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    texts = id_and_text(docs, id_col, text_col).withColumn("held_out", held)
    return texts.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
