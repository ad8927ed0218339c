"""Scores of the learned operators against slow versions written from their definitions."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from quillspark.llm import langid, quality, toxicity

SF = "/root/testdata/sf0.001"


# --- toxicity --------------------------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1:] == b[k + 1:] or a[k:] == b[k + 1:] or a[k + 1:] == b[k:]


def slow_match(word, entries, own):
    if any(word.startswith(t) if stem else word == t for t, stem in entries):
        return 1
    return 2 if word not in own and any(len(t) >= toxicity.FUZZY and one_edit(t, word) for t, _ in entries) else 0


def slow_features(text, entries, own):
    low = text.lower()
    spans = [(m.start(), m.group(0)) for m in re.finditer(r"\w+", low)]
    marks = [i for i, c in enumerate(low) if c in "\"“”„«»"]
    exact = misspelled = quoted = aimed = 0
    for i, (at, word) in enumerate(spans):
        c = slow_match(word, entries, own)
        if not c:
            continue
        a, b = max(0, i - toxicity.WINDOW), min(len(spans) - 1, i + toxicity.WINDOW)
        near = [w for _, w in spans[a:b + 1]]
        odd = len([m for m in marks if m < at]) % 2 == 1
        close = any(spans[a][0] <= m < at for m in marks) and any(at < m <= spans[b][0] + 40 for m in marks)
        if close and (odd or set(near) & toxicity.REPORTING):
            quoted += 1
        else:
            aimed += bool(set(near) & toxicity.AIMING)
            exact += c == 1
            misspelled += c == 2
    return [math.log1p(exact), math.log1p(misspelled), math.log1p(quoted), math.log1p(aimed), min(1.0, 20 * exact / max(1, len(spans))), float(exact > 0)] if any(slow_match(w, entries, own) for _, w in spans) else [0.0] * 6


def test_toxicity_features():
    r = random.Random(2)
    entries = [("idiot", False), ("moro", True), ("trash", False), ("worthless", False), ("clow", True)]
    own = frozenset({"idiom", "crash"})
    words = ["idiot", "idiots", "idot", "idiom", "crash", "tresh", "trash", "moron", "moro", "maro", "worthles", "worthlessly", "clown", "you", "said", "the", "a", "x" * 30, '"', "«", "»", "“", "”", "wort"]
    matcher = toxicity.Matcher(entries, own)
    for _ in range(600):
        t = "".join(w + r.choice([" ", " ", ", ", "\n", ""]) for w in r.choices(words, k=r.randint(0, 60)))
        assert toxicity.features_of(t, matcher) == slow_features(t, entries, own), t
    long = 'idiot "' * 20_000
    assert toxicity.features_of(long, matcher)[2] > 0


def test_toxicity_scores(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = "crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 5 = 0"
    from pyspark.sql import functions as F

    (entries, own), w = toxicity.train(docs, labels, F.expr(held))
    odd = spark.createDataFrame([(10**7, None, 1.0), (10**7, "you idiot", 2.0), (10**7, "you idiot", 2.0), (None, "", 3.0)], "doc_id long, text string, score double")
    some = docs.select("doc_id", "text").where("doc_id % 5 = 0").unionByName(odd.select("doc_id", "text"))
    got = Counter((r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in toxicity.toxicity_scores(some.withColumn("score", F.lit("x")), labels.limit(0)).collect())
    assert len({s for _, _, s, _ in got}) == 1  # nothing learned: one score
    scored = Counter()
    for r in some.collect():
        z = w[0] + float(np.dot(w[1:], slow_features(r.text or "", entries, own)))
        s = 1 / (1 + math.exp(-min(30, max(-30, z))))
        scored[r.doc_id, zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0, round(s, 9), int(s >= 0.5)] += 1
    matcher = toxicity.Matcher(entries, own)
    made = Counter()
    rows = some.collect()
    for r, s in zip(rows, toxicity._scores([x.text or "" for x in rows], matcher, w), strict=True):
        made[r.doc_id, zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0, round(float(s), 9), int(s >= 0.5)] += 1
    assert made == scored


def test_fit_of_separable_classes():
    x = np.array([[0.0]] * 50 + [[1.0]] * 50)
    w = toxicity.fit(x, np.array([0.0] * 50 + [1.0] * 50))
    assert np.isfinite(w).all() and np.abs(w).max() < 50 and w[1] > 0


# --- quality ---------------------------------------------------------------------------------


def slow_quality(text):
    n, words = max(1, len(text)), text.split()
    w, lines, share = max(1, len(words)), text.split(b"\n"), Counter(text)
    of = lambda some: sum(share[b] for b in some)
    letters = [*range(65, 91), *range(97, 123)]
    entropy = -sum(c / n * math.log2(c / n) for c in share.values())
    return [
        math.log1p(len(text)), math.log1p(len(words)), n / w, of(letters) / n, of(range(48, 58)) / n, of(range(65, 91)) / max(1, of(letters)), of(b" \t\n\r\v\f") / n,
        of(set(b".,;:!?'\"()-")) / n, of(set(b"#$%&*+/<=>@[\\]^_`{|}~")) / n, of(range(128, 256)) / n, share[124] / w, share[33] / w, sum(x.endswith(b".") for x in words) / w, share[44] / w,
        len(set(words)) / w, max(Counter(words).values(), default=0) / w, sum(len(x) <= 3 for x in words) / w, math.log1p(len(lines)), w / len(lines), 1 - len(set(lines)) / len(lines), entropy,
        sum(x.isupper() for x in words) / w, sum(not x.isalpha() for x in words) / w,
    ]


def test_quality(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ["", " ", "é ÀB | |", "A" * 9000, "x\nx\nx", "UP low 1a !"]
    x = np.array([quality.features_of(t.encode()) for t in texts])
    assert np.allclose(x, [slow_quality(t.encode()) for t in texts], rtol=1e-6, atol=1e-9)
    y = np.array([len(t) % 3 == 0 for t in texts], float)
    m = quality.fit(x, y, cycles=15, pair_cycles=5)
    for row, s in zip(x, m.score(x), strict=True):
        z = m.base + sum(t[sum(c <= v for c in cuts)] for v, cuts, t in zip(row, m.edges, m.tables, strict=True))
        z += sum(t[sum(c <= row[i] for c in m.coarse[i]), sum(c <= row[j] for c in m.coarse[j])] for i, j, t in m.pairs)
        assert abs(s - 1 / (1 + math.exp(-z))) < 1e-9


# --- language --------------------------------------------------------------------------------


def slow_bins(text):
    clean = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text)
    padded = b"  " + clean + b"  "
    grams = [padded[i:i + 3] for i in range(len(padded) - 2)]
    return [(int.from_bytes(g, "little") * 2654435761 % 2**32) >> 17 for g in grams if g != b"   "]


def slow_em(p, counts, langs):
    w, n = {j: 1 / len(langs) for j in langs}, sum(counts.values())
    for _ in range(langid.ROUNDS):
        new = dict.fromkeys(langs, 0.0)
        for g, c in counts.items():
            whole = sum(w[j] * p[j][g] for j in langs)
            for j in langs:
                new[j] += c * w[j] * p[j][g] / whole
        w = {j: x / n for j, x in new.items()}
    return w, sum(c * math.log(sum(w[j] * p[j][g] for j in langs)) for g, c in counts.items())


def slow_mixture(p, bins):
    """Every set of languages is tried."""
    counts, best = Counter(bins), None
    for k in range(1, len(p) + 1):
        for langs in combinations(range(len(p)), k):
            w, like = slow_em(p, counts, langs)
            like -= langid.PENALTY * (k - 1) * math.log(len(bins) + 1) / 2
            if best is None or like > best[0] + 1e-9:
                best = like, w
    return best[1]


def test_language(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", F.lit("x").alias("lang_pred"))
    odd = spark.createDataFrame([(10**7, None, "en", "x"), (10**7, "the of", None, "x"), (10**7, "the of", None, "x"), (None, "der die das", None, "x"), (10**7 + 1, "123", "de", "x"), (10**7 + 2, "the house " * 20_000, None, "x")], docs.schema)
    rows = docs.unionByName(odd).collect()
    crc = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5
    counts = {}
    for r in rows:
        if r.text is not None and r.lang is not None and crc(r.doc_id):
            counts.setdefault(r.lang, Counter()).update(slow_bins(r.text.encode()))
    langs = sorted(counts)
    whole = {x: sum(c.values()) + 0.05 * langid.BINS for x, c in counts.items()}
    p = [[(counts[x][g] + 0.05) / whole[x] for g in range(langid.BINS)] for x in langs]
    want = Counter()
    for k, r in enumerate(rows):
        if k % 7 and r.doc_id is not None and r.doc_id < 10**7:
            continue
        if not r.text or not re.search(r"[^\W\d_]", r.text):
            want[r.doc_id, crc(r.doc_id) == 0, "und", 0.0] += 1
            continue
        w = slow_mixture(p, slow_bins(r.text.encode()))
        j = max(sorted(w), key=lambda j: w[j])
        want[r.doc_id, crc(r.doc_id) == 0, langs[j], round(min(1.0, w[j]), 6)] += 1
    got = langid.identify(docs.unionByName(odd)).collect()
    assert len(got) == len(rows)
    keys = {k[0] for k in want}
    assert Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in got if r.doc_id in keys) == want


@pytest.mark.parametrize("seed", range(3))
def test_mixtures(seed):
    r = np.random.default_rng(seed)
    p = r.dirichlet(np.full(40, 0.4), 4) * 0.95 + 0.05 / 40
    for _ in range(25):
        share = r.dirichlet(np.full(4, 0.3))
        bins = np.concatenate([r.choice(40, int(300 * s), p=p[j] / p[j].sum()) for j, s in enumerate(share)])
        want = slow_mixture(p.tolist(), bins.tolist())
        got = langid.mixture(p, bins)
        if len(want) < 3:  # larger sets grow from the best pair
            assert {int(j) for j in np.flatnonzero(got)} == set(want) and np.allclose([got[j] for j in want], list(want.values()))
