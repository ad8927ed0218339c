"""Each operator against a brute-force version, and its defined results on odd rows."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import bpe, components, exact, jaccard, langid, licenses, merkle, packing, quality, substrings, toxicity
from quillspark.llm.common import pack_sorted, unpack_sorted

SF = "/root/testdata/sf0.001"
BYTES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def frame(spark, texts, start=0):
    rows = [(i, t, f"x{i}", "c", 1) for i, t in enumerate(texts, start)]
    return spark.createDataFrame(rows, "doc_id long, text string, keep_id string, component_id string, block int")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 40
    base = [" ".join(r.choices(vocab, k=r.choice((0, 1, 2, 5, 30, 120, 300)))) for _ in range(60)]
    passage = " ".join(r.choices(vocab, k=60))
    out = base + base[:10]
    for t in base[10:40]:
        w = t.split()
        for _ in range(r.choice((0, 1, 3, 8))):
            if w:
                w[r.randrange(len(w))] = r.choice(vocab)
        out.append(" ".join(w))
    out += [f"{a} {passage}\n{b}" for a, b in zip(base[20:30], base[30:40], strict=True)]
    return [*out, "", None, "  \t\n", "A b C", "a B c", base[50].upper()]


ODD_TABLES = [[], [None], ["", "", None], ["x"], ["x", "x", "x"], ["é ß 中 \x1c \x85", "a" * 5000, "word " * 3000]]


def brute_components(texts, n, t):
    sets = []
    for x in texts:
        w = (x or "").encode().lower().split()
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(s), top(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("n", "t"), [(3, 0.9), (5, 0.8)])
def test_jaccard(spark, texts, n, t, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 4)  # so that groups are cut into tiles
    monkeypatch.setattr(jaccard, "SMALL", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, texts), n, t).collect()}
    assert got == brute_components(texts, n, t)


def test_jaccard_odd(spark):
    for some in ODD_TABLES[:5]:
        got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, some)).collect()}
        assert got == {i: c for i, (_, c) in brute_components(some, 5, 0.8).items()}
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in jaccard.jaccard_components(df).collect()), key=str) == [(1, 1), (1, 1), (None, None)]


def test_jaccard_rows_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 2)
    words = lambda p: " ".join(f"{p}{i}" for i in range(60))
    a, b, c = words("a"), words("b"), words("c")
    rows = [(1, a), (1, b), (2, b + " end"), (3, a + " end"), (3, c), (0, c + " end"), (7, b), (7, b), (None, b), (8, "lone")]
    want = Counter([(1, 1), (1, 1), (2, 1), (3, 1), (3, 0), (0, 0), (7, 1), (7, 1), (None, None), (8, 8)])
    for some in (rows, rows[::-1], rows[5:] + rows[:5]):
        got = jaccard.jaccard_components(spark.createDataFrame(some, "doc_id long, text string"), 5, 0.8).collect()
        assert Counter((r.doc_id, r.component_id) for r in got) == want


def test_jaccard_heavy_class(spark):
    """With joins that split the partition of a heavy key."""
    small = {"autoBroadcastJoinThreshold": "-1", "adaptive.advisoryPartitionSizeInBytes": "1k", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "adaptive.skewJoin.skewedPartitionFactor": "1.1"}
    for k, v in small.items():
        spark.conf.set(f"spark.sql.{k}", v)
    r = random.Random(5)
    base = [" ".join(r.choices("abcdefgh", k=50)) for _ in range(6)]
    some = base[:1] * 60 + base + [base[0] + " x"] * 30 + [base[1] + f" y{i}" for i in range(25)]
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_components(frame(spark, some), 3, 0.8).collect()}
    for k in small:
        spark.conf.unset(f"spark.sql.{k}")
    assert got == {i: c for i, (_, c) in brute_components(some, 3, 0.8).items()}


def test_links_and_bitmaps():
    r = np.random.default_rng(0)
    sets = []
    for _ in range(12):
        base = np.unique(r.integers(0, 2**63, r.integers(5, 900)).astype(np.uint64))
        for k in (0, 1, len(base) // 20, len(base) // 8):
            sets.append(np.unique(np.concatenate([base[k:], r.integers(0, 2**63, k).astype(np.uint64)])))
    sets.sort(key=len)
    sizes = np.array([len(s) for s in sets])
    maps = jaccard.Bitmaps([jaccard.bitmap(s).tobytes() for s in sets])
    want = {(i, j) for i in range(len(sets)) for j in range(i) if 10 * len(np.intersect1d(sets[i], sets[j])) >= 9 * len(np.union1d(sets[i], sets[j]))}
    for i, j in want:
        d = maps.differ(np.array([i]), np.array([j]))[0]
        assert d <= sizes[i] + sizes[j] - 2 * len(np.intersect1d(sets[i], sets[j]))
        assert set(jaccard.tile_keys(sets[i], 9, 10).tolist()) & set(jaccard.tile_keys(sets[j], 9, 10).tolist())
    found = jaccard.links_of(np.arange(len(sets)), sizes, maps, sets, 9, 10)
    assert {tuple(sorted(x, reverse=True)) for x in found} <= want


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(300, 300 + i) for i in range(1, 60)] + [(500 + i, 501 + i) for i in range(40)]
    up = {}
    for a, b in edges:
        up.setdefault(a, {a})
        up.setdefault(b, {b})
        if up[a] is not up[b]:
            both = up[a] | up[b]
            for x in both:
                up[x] = both
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: min(s) for x, s in up.items() if len(s) > 1}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("listed", [exact.LISTED, 0])
def test_exact(spark, texts, listed, monkeypatch):
    monkeypatch.setattr(exact, "LISTED", listed)  # 0: the routed texts pass a bitmap
    for some in (texts, *ODD_TABLES, ["copy"] * 400 + ["other"] * 3 + ["lone"]):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_duplicates(frame(spark, some)).collect()}
        groups = defaultdict(list)
        for i, t in enumerate(some):
            groups[t or ""].append(i)
        assert got == {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


def test_quotient_filter():
    r = np.random.default_rng(0)
    f = [r.integers(0, 2**12, 500).astype(np.uint64) << np.uint64(40) for _ in range(3)]
    parts = [exact.CountingQuotientFilter.from_bytes(exact.CountingQuotientFilter.of(x, 44).to_bytes()) for x in f]
    whole = parts[0].merged(*parts[1:])
    assert dict(zip(whole.fingerprints().tolist(), whole.counts.tolist(), strict=True)) == Counter(np.concatenate(f).tolist())


def brute_repeats(texts, n=20):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            x = tuple(w[k:k + n])
            if x in seen:
                gone[k:k + n] = [True] * n
            seen.add(x)
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


def test_repeats(spark, texts):
    for some in (texts, *ODD_TABLES):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(frame(spark, some)).collect()}
        assert got == brute_repeats(some)
    df = spark.createDataFrame([(None, "a " * 30), (5, "a " * 30)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(df).collect()} == {5: 29, None: 30}


def test_packed_numbers():
    r = np.random.default_rng(0)
    for x in ([], [0], [2**64 - 1], r.integers(0, 2**63, 1000), [5, 5, 7]):
        v = np.sort(np.array(x, np.uint64))
        assert (unpack_sorted(pack_sorted(v)) == v).all()


def test_merkle(spark, texts):
    for some in (texts, *ODD_TABLES):
        plain = [t or "" for t in some]
        got = {r.doc_id: r for r in merkle.fingerprints(frame(spark, some)).collect()}
        assert sorted(got) == list(range(len(some)))
        for i, t in enumerate(plain):
            after = plain[i - 1] if i else plain[-1]
            e = merkle.edited(t, after)
            r = got[i]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
            assert (r.fingerprint == r.edited_fingerprint) == (t == e) and (r.near_edited == 1) == (t == e) and (r.near_next == 1) == (t == after)
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            assert r.fingerprint == merkle.Tree.of(t).fingerprint()
    a, b = merkle.Tree.of("one\ntwo\nthree"), merkle.Tree.of("one\nTWO\nthree")
    assert a.differing(b) == [a.paragraphs[1][1:]] and a.differing(a) == [] and merkle.compared(a, b)[1] == [a.paragraphs[1][1:]]


def brute_compared(a, b):
    """Likeness and edits from plain lists of sections, lines and runs of words."""

    def parts(text):
        sections, number = [[]], 0
        for i, line in enumerate(lines := text.split("\n")):
            words, runs = line.split(" "), []
            if i == 0:
                runs, words = [(w,) for w in words[:8]], words[8:]
            runs += [tuple(words[k:k + 4]) for k in range(0, len(words), 4)]
            sections[-1].append((line, list(range(number, number + len(runs))), runs))
            number += len(runs)
            if (not line or len(sections[-1]) == 16) and i + 1 < len(lines):
                sections.append([])
        return sections, number

    def without(mine, theirs, key):
        left, out = [key(x) for x in theirs], []
        for x in mine:
            if key(x) in left:
                left.remove(key(x))
            else:
                out.append(x)
        return out

    (sa, na), (sb, nb) = parts(a), parts(b)
    if a == b:
        return 1.0, []
    by_lines = lambda s: [p[0] for p in s]
    pa_, pb = ([p for s in without(x, y, by_lines) for p in s] for x, y in ((sa, sb), (sb, sa)))
    la, lb = ([(k, r) for p in without(x, y, lambda p: p[0]) for k, r in zip(p[1], p[2], strict=True)] for x, y in ((pa_, pb), (pb, pa_)))
    gone = [k for k, _ in without(la, lb, lambda x: x[1])]
    return min(2 * (na - len(gone)), na + nb - 1) / (na + nb), gone


def test_merkle_likeness(spark, texts):
    r = random.Random(11)
    line = lambda: " ".join(r.choices("abcde", k=r.randint(0, 9)))
    some = [t or "" for t in texts[::3]] + ["\n".join(line() for _ in range(r.randint(1, 50))) for _ in range(40)]
    some += [t.replace("a", "b", 1) for t in some[-20:]]
    rows = {x.doc_id: x for x in merkle.fingerprints(frame(spark, some)).collect()}
    for i, t in enumerate(some):
        after = some[i - 1]
        near, gone = brute_compared(t, merkle.edited(t, after))
        assert abs(rows[i].near_edited - near) < 1e-12 and [k for x in rows[i].edits for k in range(x.first, x.end)] == gone
        assert abs(rows[i].near_next - brute_compared(t, after)[0]) < 1e-12


def test_blocks(spark, monkeypatch):
    from quillspark.llm import order

    monkeypatch.setattr(order, "TARGET", 20_000)
    spread = [(i, "x" * 84) for i in range(3000)] + [(2**60, "y")]
    one_id = [(7, f"text {i} " + "z" * 76) for i in range(3000)]
    no_id = [(None, f"text {i} " + "z" * 76) for i in range(3000)]
    for rows in (spread, one_id, no_id, [(1, "a" * 100_000)], [(1, "")], []):
        df, total = order.with_blocks(spark.createDataFrame(rows, "doc_id long, text string"), 2)
        got = df.select("doc_id", "hash", "block", F.length("text").alias("n")).collect()
        assert total == sum(len(t) + 16 for _, t in rows) and len(got) == len(rows)
        ranked = sorted(got, key=lambda x: (x.doc_id is None, x.doc_id or 0, x.hash))
        assert [x.block for x in ranked] == sorted(x.block for x in got)
        if len(rows) > 2:
            sizes = Counter()
            for x in got:
                sizes[x.block] += x.n + 16
            assert len(sizes) >= 10 and max(sizes.values()) < 3 * 20_000


@pytest.mark.parametrize("target", [200, 5_000])
def test_repeats_and_prints_over_many_blocks(spark, texts, target, monkeypatch):
    from quillspark.llm import order

    monkeypatch.setattr(order, "TARGET", target)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(frame(spark, texts)).collect()}
    assert got == brute_repeats(texts)
    rows = {r.doc_id: r for r in merkle.fingerprints(frame(spark, texts)).collect()}
    assert all(rows[i].edited_sha256 == hashlib.sha256(merkle.edited(t or "", texts[i - 1] or "").encode()).hexdigest() for i, t in enumerate(texts))
    odd = [(3, "a b"), (3, "a b"), (3, "c"), (None, "d"), (None, None)]
    assert Counter(r.doc_id for r in merkle.fingerprints(spark.createDataFrame(odd, "doc_id long, text string")).collect()) == Counter([3, 3, 3, None, None])


FUZZ = "abcdeXYZ'sStdréßÉçñΣσς0129²Ⅷ .,!?-_<|>\n\t\x1c\x1f\x85   　​İ́中文😀ﬁ"


@pytest.fixture(scope="module")
def strings(spark):
    r = random.Random(1)
    docs = [x.text for x in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    return ["".join(r.choices(FUZZ, k=r.randint(0, 40))) for _ in range(800)] + docs + ["a<|endoftext|>b<|startoftext|> <|x|>", "<|endoftext|>", "", "a" * 3000]


def test_bpe(spark, strings):
    t = Tokenizer.from_file(BYTES)
    rows = {r.doc_id: r for r in bpe.encoded(frame(spark, [*strings, None]), BYTES).collect()}
    for i, (s, e) in enumerate(zip(strings, t.encode_batch(strings, add_special_tokens=False), strict=True)):
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == e.ids and bytes(rows[i].decoded) == s.encode()
    assert len(rows[len(strings)].ids) == 0 and bpe.encoded(frame(spark, []), BYTES).count() == 0


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_remembered_chunks_survive_clashing_slots_and_clearing(strings, monkeypatch, path):
    """Few slots, so chunks take each other's place, and a memory that is cleared all the time."""
    monkeypatch.setattr(bpe, "SLOT_BITS", 4)
    monkeypatch.setattr(bpe, "CACHE", 50)
    with open(path, "rb") as f:
        e = bpe.Encoder(bpe.vocabulary_of(f.read()))
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    some = strings[:600] * 2
    for at in range(0, len(some), 7):
        part = some[at:at + 7]
        want = [x.ids for x in t.encode_batch(part, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(part)] == want


def test_transducer():
    words = {f"{a}{b}ing".encode(): bytes([i, 0, 0, 0]) * (i % 3) for i, (a, b) in enumerate((a, b) for a in "abcd" for b in "xyz")}
    t = bpe.Transducer(bpe.Transducer.build(words))
    assert t.look_up(list(words)) == list(words.values()) and t.look_up([b"", b"a", b"axin", b"axingx", b"q"]) == [None] * 5
    assert len(t.final) < 12  # endings are shared
    assert bpe.Transducer(bpe.Transducer.build({})).look_up([b"a"]) == [None]


def test_packing(spark, strings):
    t = Tokenizer.from_file(WORDS)
    some = [*strings, None, "word " * 6000]
    want = {i: [*e.ids, 1] for i, e in enumerate(t.encode_batch([s or "" for s in some], add_special_tokens=False))}
    rows = packing.packed(frame(spark, some), WORDS).collect()
    back, fill = defaultdict(list), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == len(back[r.doc_id]) and r.length == len(ids) and r.doc_tokens == len(want[r.doc_id])
        back[r.doc_id] += ids
        fill[r.sequence_id].append((r.offset, r.length))
    assert back == want
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0  # full, or a length that needs no padding
    assert packing.packed(frame(spark, []), WORDS).count() == 0


def test_sum_of_squares():
    r = random.Random(0)
    p, slow = packing.SumOfSquares(50), Counter()
    for i in range(400):
        n = r.randint(1, 49)
        best = min((sum(v * v for v in (slow + Counter({h + n: 1} if h + n < 50 else {}) - Counter({h: 1} if h else {})).values()), -h) for h in [0, *(h for h in slow if slow[h] and h + n <= 50)])
        full = p.place((i, 0, b"\0\0\0\0" * n, n))
        h = -best[1]
        slow = slow + Counter({h + n: 1} if h + n < 50 else {}) - Counter({h: 1} if h else {})
        assert (full is not None) == (h + n == 50) and {k: int(v) for k, v in enumerate(p.levels) if v} == {k: v for k, v in slow.items() if v}


def test_licenses(spark):
    some = [None, "", "cc by cc by", "ALL RIGHTS RESERVED. all-rights reserved", "x\nReleased under the MIT License.\ny", "This work is licensed under the GNU General Public License, version 3.", "released under mit", "ccby", "é cc–by"]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.license_scan(frame(spark, some)).collect()}
    assert got[0] == got[1] == (0, 0, None, None, "", "")
    assert got[2][:5] == (4, 2, 0, 2, "cc-by") and got[3][:5] == (6, 2, 0, 3, "reserved")
    assert got[4] == (7, 0, None, None, "", "mit") and got[5][4:] == ("gpl", "gpl,gpl-2.0,gpl-3.0") and got[6][5] == got[7][5] == "" and got[8][1] == 0
    assert licenses.license_scan(frame(spark, [])).count() == 0


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    odd = spark.createDataFrame([(1, None, "en"), (2, "123 !", None), (3, "the of and to in", "en"), (4, "a", None), (5, "der die das und", "de"), (None, "xyz", "en")], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in langid.identify(odd, F.lit(False)).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == "und" and rows[4].lang_pred in ("en", "de") and rows[5].lang_pred == "de"
    assert langid.identify(odd.limit(0)).count() == 0
    p = np.array([[0.7, 0.1, 0.1, 0.1], [0.1, 0.1, 0.1, 0.7]])
    w = langid.mixture(p, np.array([0] * 300 + [1] * 43 + [2] * 43 + [3] * 300))
    assert abs(w[0] - 0.5) < 0.05 and langid.mixture(p, np.array([0] * 100)).tolist() == [1.0, 0.0]


@pytest.mark.parametrize(("score", "label", "least"), [(toxicity.toxicity_scores, "toxic", 0.93), (quality.quality_scores, "quality", 0.97)])
def test_classifiers(spark, score, label, least):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = score(docs, labels).join(labels, "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] >= least
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "a" * 9000), (3, "a" * 9000)], "doc_id long, text string")
    rows = score(odd, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert score(odd, labels.limit(0)).count() == 5 and score(odd.limit(0), labels).count() == 0


def test_automaton():
    lex = toxicity.Lexicon([("worthless", False), ("scum", True), ("pathetic", False)])
    assert [lex.match(w) for w in ("worthless", "worthles", "wortthless", "worthlass", "orthless", "scummy", "scu", "scam", "worthl", "pathatic", "pathaticc")] == [1, 2, 2, 2, 2, 1, 0, 0, 0, 2, 0]

    def near(a, b):
        return a == b or any(b in ({a[:i] + a[i + 1:]} | {a[:i] + c + a[i + j:] for c in "abcdefgh" for j in (0, 1)}) for i in range(len(a) + 1))

    r = random.Random(0)
    words = ["".join(r.choices("abc", k=r.randint(1, 8))) for _ in range(3000)]
    entries = [w for w in words if len(w) >= 6][:20]
    lex = toxicity.Lexicon([(w, False) for w in entries])
    assert all((lex.match(w) > 0) == any(near(e, w) for e in entries) for w in words)


def test_context():
    m = toxicity.Matcher([("idiot", True)])
    plain, quoted = (toxicity.features_of(t, m) for t in ("what an idiot you are", 'she said "idiot" to him'))
    assert plain[0] > 0 and plain[3] > 0 and plain[2] == 0 and quoted[0] == 0 and quoted[2] > 0


def test_additive_model():
    r = np.random.default_rng(0)
    x = r.normal(size=(1500, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # an interaction only
    m = quality.fit(x, y, cycles=20)
    assert ((m.score(x) > 0.5) == y).mean() > 0.9 and {m.pairs[0][0], m.pairs[0][1]} == {0, 1}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(p.STAGES)
    kept = stage["exact_dedup"](spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() == docs.select("text").distinct().count()
    near = stage["ngram_jaccard_join"](spark, kept, SF)
    n = jaccard.jaccard_components(kept, 5, 0.8).select("component_id").distinct().count()
    assert near.count() == n and near.columns == docs.columns
    cut = {r.doc_id: r for r in stage["substring_dedup"](spark, near, SF).collect()}
    rows = sorted(near.collect(), key=lambda r: r.doc_id)
    want = brute_repeats([r.text for r in rows])
    for i, r in enumerate(rows):
        c = cut[r.doc_id]
        assert c.text == r.text if not want[i][1] else hashlib.sha256(c.text.encode()).hexdigest() == want[i][2]
    assert p.run(spark, SF).count() > 0 and [n for n, _ in p.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "substring_dedup", "packing"]
