"""Toxicity: Levenshtein automata over a lexicon trie, and the context of what they catch.

The lexicon is learned: prefixes and words whose document frequency in toxic rows of a bounded
sample is significantly above that in clean rows.  It is a trie whose entries are stems (any
ending) or whole words.  The Levenshtein automaton of one edit is intersected with the trie and
made deterministic as words are read: a state is a set of (trie node, edits), and a word
dies as soon as no entry can be met.  Entries of fewer than six letters allow no edit.

Each term caught is weighed by its context: windows of words around it tell whether it is quoted or
reported, or aimed at someone.  Counts of exact, misspelled, quoted and aimed terms are the
features of a logistic regression, fitted on the same sample.

Defined results: null or empty text has no terms and the score of a text without any.  Without
labelled rows of both classes the lexicon is empty and every score is the share of label 1 in the
sample (0 without any).  Repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, id_and_text, only
from .sampling import labelled_sample, sampled_texts

#: The most labelled rows that lexicon and weights are learned from.
SAMPLE_ROWS = 8_000
LEAST_DOCS, LEAST_G, PURITY = 5, 22.0, 0.9
#: Letters of the shortest and the longest stem (whole words have any length), and of the shortest entry that allows an edit.
STEM, LONGEST_STEM, FUZZY = 4, 14, 5
WINDOW = 8
CACHE = 200_000
_WORD = re.compile(r"\w+")
# Words that report speech, and words that aim at a reader, in four languages.
REPORTING = frozenset("said says wrote quote quoted quotes reported called word term sagte schrieb zitat wort dit écrit mot cité dijo escribió palabra cita".split())
AIMING = frozenset("you your yours u ur du dich dir dein ihr euch tu toi ton vous votre tú te tus usted ustedes vosotros".split())
_QUOTES = re.compile(r"[\"“”„«»]")


class Lexicon:
    """A trie of stems and words, read through a Levenshtein automaton of at most one edit."""

    def __init__(self, entries: list[tuple[str, bool]]):
        self.entries = entries
        self.children: list[dict[str, int]] = [{}]
        self.stem, self.word, self.edits = [False], [False], [0]
        for text, is_stem in entries:
            node, loose = 0, int(len(text) >= FUZZY)
            self.edits[0] = max(self.edits[0], loose)
            for c in text:
                if c not in self.children[node]:
                    self.children.append({})
                    self.stem.append(False)
                    self.word.append(False)
                    self.edits.append(0)
                    self.children[node][c] = len(self.children) - 1
                node = self.children[node][c]
                self.edits[node] = max(self.edits[node], loose)
            if is_stem:
                self.stem[node] = True
            else:
                self.word[node] = True
        self.fuzzy_end = [False] * len(self.children)
        for text, is_stem in entries:
            if len(text) >= FUZZY:
                node = 0
                for c in text:
                    node = self.children[node][c]
                self.fuzzy_end[node] = True
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[int] = []  # 0 none, 1 exact word, 2 misspelled word, 3 exact stem
        self.start = self.state(self.closed({(0, 0)}))

    def closed(self, places: set) -> frozenset:
        """With letters of the lexicon left out, for one edit."""
        out = set(places)
        for node, e in places:
            if e == 0:
                out |= {(n, 1) for n in self.children[node].values() if self.edits[n]}
        return frozenset(p for p in out if p[1] == 0 or (p[0], 0) not in out)

    def state(self, places: frozenset) -> int:
        if places not in self.numbers:
            self.numbers[places] = len(self.sets)
            self.sets.append(places)
            self.moves.append({})
            exact = any(self.word[n] for n, e in places if not e)
            stem = any(self.stem[n] for n, e in places if not e)
            near = any(self.fuzzy_end[n] for n, e in places if e)
            self.accepts.append(3 if stem else 1 if exact else 2 if near else 0)
        return self.numbers[places]

    def move(self, state: int, c: str) -> int:
        """The next state, -1 if no entry can be met any more; kept for the next word."""
        to: set = set()
        for node, e in self.sets[state]:
            if c in self.children[node]:
                n = self.children[node][c]
                if not e or self.edits[n]:
                    to.add((n, e))
            if e == 0 and self.edits[node]:
                to.add((node, 1))  # a letter too many
                to |= {(n, 1) for k, n in self.children[node].items() if k != c and self.edits[n]}
        found = self.state(self.closed(to)) if to else -1
        self.moves[state][c] = found
        return found

    def match(self, word: str) -> int:
        """0: no entry; 1: an entry or one with any ending; 2: an entry with one edit."""
        s, moves, accepts = self.start, self.moves, self.accepts
        for c in word:
            n = moves[s].get(c)
            s = self.move(s, c) if n is None else n
            if s < 0:
                return 0
            if accepts[s] == 3:
                return 1
        return min(accepts[s], 2)


class Matcher(dict):
    """word -> match, for a bounded number of words; words of their own are no misspellings."""

    def __init__(self, entries, own=frozenset()):
        super().__init__()
        self.lexicon, self.own = Lexicon(entries), own

    def __missing__(self, word):
        found = self.lexicon.match(word)
        if found == 2 and word in self.own:
            found = 0
        if len(self) >= CACHE:
            self.clear()
        self[word] = found
        return found


def features_of(text: str, matcher: Matcher) -> list[float]:
    """log counts of exact, misspelled, quoted and aimed terms, and the share of unquoted ones."""
    words = _WORD.findall(text.lower())
    codes = list(map(matcher.__getitem__, words))
    if not any(codes):
        return [0.0] * 6
    exact = misspelled = quoted = aimed = 0.0
    lower = text.lower()
    spans = [m.start() for m in _WORD.finditer(lower)]
    marks = [m.start() for m in _QUOTES.finditer(lower)]
    for i, c in enumerate(codes):
        if not c:
            continue
        near = words[max(0, i - WINDOW): i + WINDOW + 1]
        at = bisect_left(marks, spans[i])  # marks before the word
        before = at % 2
        opens = at > bisect_left(marks, spans[max(0, i - WINDOW)])
        close = opens and bisect_right(marks, spans[min(len(spans) - 1, i + WINDOW)] + 40) > bisect_right(marks, spans[i])
        is_quoted = bool(before and close) or (close and any(w in REPORTING for w in near))
        quoted += is_quoted
        aimed += any(w in AIMING for w in near) and not is_quoted
        if not is_quoted:
            exact += c == 1
            misspelled += c == 2
    n = max(1, len(words))
    return [math.log1p(exact), math.log1p(misspelled), math.log1p(quoted), math.log1p(aimed), min(1.0, 20 * exact / n), float(exact > 0)]


def _prefixes(batches):
    """Documents of either label that have a prefix (with the whole words marked by an end)."""
    clean: Counter = Counter()
    toxic: Counter = Counter()
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            words = set(_WORD.findall(text.lower()))
            found = {w[:k] for w in words for k in range(STEM, min(len(w), LONGEST_STEM) + 1)} | {w + "$" for w in words if FUZZY <= len(w)}
            (toxic if label else clean).update(found)
    names = list(toxic.keys() | clean.keys())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[w] for w in names], pa.int64()), pa.array([clean[w] for w in names], pa.int64())], names=["term", "toxic", "clean"])


def _entries(rows, n1: int, n0: int) -> list[tuple[str, bool]]:
    """The shortest pure stems, and whole words for the automaton's edits."""

    def weight(a, b):
        whole = (a + b) / (n1 + n0)
        return 2 * (a * math.log(a / (n1 * whole)) + (b * math.log(b / (n0 * whole)) if b else 0.0))

    good = {r.term: weight(r.toxic, r.clean) for r in rows if r.toxic / n1 > r.clean / n0 and r.toxic >= PURITY * (r.toxic + r.clean * n1 / n0 * 3)}
    good = {t: g for t, g in good.items() if g >= LEAST_G}
    out = []
    for t, g in good.items():
        if t.endswith("$"):
            out.append((g, t[:-1], False))
        elif not any(t[:k] in good for k in range(STEM, len(t))):
            out.append((g, t, True))
    out.sort(key=lambda x: (-x[0], x[1], x[2]))
    return [(t, s) for _, t, s in out]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Weights (constant first) of a ridge logistic regression, by Newton steps that are halved
    until the penalised likelihood grows, so that they end where classes are apart as well."""
    a = np.concatenate([np.ones((len(x), 1)), x], 1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w = np.zeros(a.shape[1])
    w[0] = math.log(share / (1 - share))
    keep = np.full(a.shape[1], ridge)
    keep[0] = 1e-3

    def loss(v):
        z = a @ v
        return float(np.logaddexp(0, z).sum() - y @ z + keep @ (v * v) / 2)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + np.diag(keep), a.T @ (y - p) - keep * w)
        size = 1.0
        while size > 1e-6 and not loss(w + size * step) < now:
            size /= 2
        if size <= 1e-6:
            break
        w = w + size * step
        now = loss(w)
        if np.abs(size * step).max() < 1e-9:
            break
    return w


def _own_words(batches, entries):
    """Words of documents that the automaton meets with one edit."""
    lexicon = Lexicon(entries)
    for batch in batches:
        words = {w for t in batch.column("text").to_pylist() for w in _WORD.findall(t.lower())}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(w for w in words if lexicon.match(w) == 2), pa.string())], names=["word"])


def train(docs: DataFrame, labels: DataFrame, held_out, label: str = "toxic", rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text"):
    """(matcher's entries and own words, weights) from a bounded, hashed sample of labelled rows."""
    sample = labelled_sample(labels, label, held_out, rows)
    n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return ([], frozenset()), np.array([math.log(1e-3 / (1 - 1e-3)) if not n1 else math.log((1 - 1e-3) / 1e-3), *[0.0] * 6])
    texts = sampled_texts(id_and_text(docs, id_col, text_col), sample).select("label", "text")
    counted = texts.mapInArrow(_prefixes, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    strong = counted.where((F.col("toxic") >= LEAST_DOCS) & (F.col("toxic") * n0 > 20 * F.col("clean") * n1))
    entries = _entries(strong.collect(), n1, n0)  # bounded by the sample
    clean = texts.where("label = 0").mapInArrow(lambda b: _own_words(b, entries), "word string").distinct()
    own = frozenset(r.word for r in clean.collect())  # bounded by the sample

    def features(batches):
        matcher = Matcher(entries, own)
        for batch in batches:
            x = [features_of(t, matcher) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])

    got = sorted(texts.mapInArrow(features, "label int, x array<double>").collect(), key=lambda r: (r.label, r.x))
    if not got:
        return (entries, own), np.array([math.log(n1 / n0), *[0.0] * 6])
    return (entries, own), fit(np.array([r.x for r in got]), np.array([r.label for r in got], float))


def _scores(texts: list, matcher: Matcher, weights: np.ndarray) -> np.ndarray:
    x = np.array([features_of(t, matcher) for t in texts]).reshape(len(texts), 6)
    return 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))


def without_toxic(docs: DataFrame, labels: DataFrame, held_out=None, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, whole and each by its own text, that toxicity_scores does not predict toxic."""
    held = held_out if held_out is not None else F.pmod(crc_of_id(), F.lit(5)) == 0
    lexicon, weights = train(docs, labels, held, label, id_col=id_col, text_col=text_col)
    place = docs.columns.index(text_col)

    def run(batches):
        only()
        matcher = Matcher(*lexicon)
        for batch in batches:
            s = _scores([t or "" for t in batch.column(place).to_pylist()], matcher, weights)
            yield batch.filter(pa.array(s < 0.5))

    return docs.mapInArrow(run, docs.schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out=None, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    held = held_out if held_out is not None else F.pmod(crc_of_id(), F.lit(5)) == 0
    lexicon, weights = train(docs, labels, held, label, id_col=id_col, text_col=text_col)

    def run(batches):
        only()
        matcher = Matcher(*lexicon)
        for batch in batches:
            s = _scores(batch.column("text").to_pylist(), matcher, weights)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    texts = id_and_text(docs, id_col, text_col).withColumn("held_out", held)
    return texts.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
