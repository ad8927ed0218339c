"""Byte-level BPE by a minimal acyclic transducer of frequent words, and exact merges.

The most frequent words of the corpus are compiled, with the ids that BPE gives them, into
a minimal acyclic automaton: equal suffixes are shared, and each arc carries the number of
words that sort before it, so the weights along a path number the word, and the number
addresses its ids.  The automaton is one flat file that workers map into memory.  Words it does
not hold are merged exactly, a whole batch of words at a time: in each round every word
merges all places of its lowest-ranked pair.

Defined results: null text is the empty text, which has no ids.  Special tokens in a text
become their own id.  Repeated rows are encoded alike; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import unicodedata
import uuid
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, only, remembers, shared_folder, slices

# The white space of Unicode, and the split patterns of the two vocabularies.
SPACE = "\t-\r \x85\xa0  -     　"
BYTE_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WORD_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
# Coarser, quicker: no piece of the patterns above crosses a chunk's end.
BYTE_CHUNKS = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WORD_CHUNKS = re.compile(rf"[^{SPACE}]+")

# Characters that some split at and others do not: controls, and separators beyond ASCII.
ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")

WORDS = 16_384
#: Chunks that a worker remembers, the bytes of them and their ids, and the bits of a slot's number.
CACHE, CACHE_BYTES, SLOT_BITS = 600_000, 64 << 20, 20
#: Chunks that a task counts.
COUNTED = 300_000
NO_PAIR = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(plain)))
    return [letters[b] for b in range(256)]


class PairTable:
    """(left, right) -> rank for arrays, and rank -> merged id: hash levels without collisions, each of
    which holds the pairs that met a taken place on the level above."""

    def __init__(self, left, right, merged):
        key = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
        self.levels, rest, bits = [], np.arange(len(key)), 18
        while len(rest):
            odd = np.uint64(0x9E3779B97F4A7C15 + 2 * 0x1234567 * len(self.levels))
            slot = (key[rest] * odd) >> np.uint64(64 - bits)
            _, first = np.unique(slot, return_index=True)
            keys = np.full(1 << bits, 2**64 - 1, np.uint64)
            at = np.zeros(1 << bits, np.int32)
            keys[slot[first]], at[slot[first]] = key[rest[first]], rest[first]
            self.levels.append((odd, np.uint64(64 - bits), keys, at))
            rest, bits = np.delete(rest, first), 14
        self.merged = merged.astype(np.int32)

    def find(self, left, right) -> np.ndarray:
        """The rank of each pair, NO_PAIR where it isn't one."""
        key = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
        out = np.full(len(key), NO_PAIR, np.int32)
        open_ = None
        for odd, shift, keys, at in self.levels:
            k = key if open_ is None else key[open_]
            slot = (k * odd) >> shift
            hit = keys[slot] == k
            if open_ is None:
                out[hit] = at[slot[hit]]
                open_ = np.flatnonzero(~hit)
            else:
                out[open_[hit]] = at[slot[hit]]
                open_ = open_[~hit]
        return out


class Vocabulary:
    """A tokenizer file with BPE merges over byte letters, with or without word ends."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        self.data, self.end = data, model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        letters = byte_letters()
        self.first = np.array([vocab.get(x, -1) for x in letters], np.int32)
        self.last = np.array([vocab.get(x + self.end, -1) for x in letters], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64)
        self.pairs = PairTable(ids[:, 0], ids[:, 1], ids[:, 2])
        of_letter = {x: bytes([b]) for b, x in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: b"".join(of_letter.get(c, c.encode()) for c in w) for w, i in vocab.items()}
        self.bytes_of |= {i: w.encode() for w, i in self.special.items()}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian uint32."""
        out = [b""] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        live = np.flatnonzero(size)
        if not len(live):
            return out
        raw = np.frombuffer(b"".join(words), np.uint8)
        size = size[live]
        word = np.repeat(np.arange(len(size), dtype=np.int32), size)
        last = np.zeros(len(raw), bool)
        last[np.cumsum(size) - 1] = True
        s = np.where(last, self.last[raw], self.first[raw])
        rank = np.full(len(s), NO_PAIR, np.int32)  # of the pair that begins here
        rank[:-1] = self.pairs.find(s[:-1], s[1:])
        rank[last] = NO_PAIR
        while len(live):
            starts = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, starts)
            done = least == NO_PAIR
            if done.any():
                ids = s.astype("<u4").tobytes()
                for w, a, b in zip(live[done].tolist(), (4 * starts[done]).tolist(), (4 * (starts + size)[done]).tolist(), strict=True):
                    out[w] = ids[a:b]
                stay = ~done[word]
                s, rank, last, word = s[stay], rank[stay], last[stay], (np.cumsum(~done, dtype=np.int32) - np.int32(1))[word[stay]]
                live, least, size = live[~done], least[~done], size[~done]
                if not len(live):
                    break
            here = rank == least[word]
            # of overlapping places (a a a) every second one, from the left
            double = here[1:] & here[:-1]
            if double.any():
                place = np.arange(len(s))
                run = place - np.maximum.accumulate(np.where(here & ~np.concatenate([[False], here[:-1]]), place, 0))
                here &= run % 2 == 0
            at = np.flatnonzero(here)
            s[at] = self.pairs.merged[rank[at]]
            last[at] = last[at + 1]
            keep = np.ones(len(s), bool)
            keep[at + 1] = False
            size = size - np.bincount(word[at], minlength=len(size))
            s, rank, last, word = s[keep], rank[keep], last[keep], word[keep]
            at -= np.arange(len(at))
            near = np.concatenate([at, at[at > 0] - 1])  # the pairs that a merge changed
            rank[near] = NO_PAIR
            near = near[~last[near]]
            rank[near] = self.pairs.find(s[near], s[near + 1])
        return out


class Transducer:
    """A minimal acyclic automaton over bytes whose path weights number its words."""

    MAGIC = b"madfa001"

    def __init__(self, data):
        n_arcs, n_states, n_words, n_ids = (int(x) for x in np.frombuffer(data, "<u8", 4, 8))
        at = 40
        self.keys = np.frombuffer(data, "<u8", n_arcs, at)
        self.targets = np.frombuffer(data, "<u4", n_arcs, at := at + 8 * n_arcs)
        self.weights = np.frombuffer(data, "<u4", n_arcs, at := at + 4 * n_arcs)
        self.final = np.frombuffer(data, np.uint8, n_states, at := at + 4 * n_arcs)
        self.offsets = np.frombuffer(data, "<u4", n_words + 1, at := at + n_states)
        self.ids = data[at + 4 * (n_words + 1): at + 4 * (n_words + 1) + 4 * n_ids]

    @classmethod
    def build(cls, entries: dict[bytes, bytes]) -> bytes:
        """File content for words and their ids (little-endian uint32)."""
        words = sorted(w for w in entries if w)
        arcs: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path = [0]  # states along the last word, not yet registered

        def settle(depth: int, word: bytes) -> None:
            while len(path) - 1 > depth:
                state = path.pop()
                key = (final[state], tuple(sorted(arcs[state].items())))
                arcs[path[-1]][word[len(path) - 1]] = register.setdefault(key, state)

        before = b""
        for w in words:
            common = len(os.path.commonprefix([before, w]))
            settle(common, before)
            for b in w[common:]:
                arcs.append({})
                final.append(False)
                arcs[path[-1]][b] = len(arcs) - 1
                path.append(len(arcs) - 1)
            final[path[-1]] = True
            before = w
        settle(0, before)
        count: dict[int, int] = {}
        order, todo = [], [(0, False)]
        while todo:  # states after all they lead to
            state, ready = todo.pop()
            if ready:
                count[state] = final[state] + sum(count[t] for t in arcs[state].values())
                order.append(state)
            elif state not in count:
                count[state] = -1
                todo.append((state, True))
                todo += [(t, False) for t in arcs[state].values() if t not in count]
        number = {s: i for i, s in enumerate(reversed(order))}
        keys, targets, weights = [], [], []
        for s in reversed(order):
            seen = int(final[s])
            for b in sorted(arcs[s]):
                keys.append(number[s] << 8 | b)
                targets.append(number[arcs[s][b]])
                weights.append(seen)
                seen += count[arcs[s][b]]
        ids = [entries[w] for w in words]
        offsets = np.cumsum([0, *(len(x) // 4 for x in ids)])
        head = np.array([len(keys), len(order), len(words), offsets[-1]], "<u8")
        flags = np.array([final[s] for s in reversed(order)], np.uint8)
        return b"".join([cls.MAGIC, head.tobytes(), np.array(keys, "<u8").tobytes(), np.array(targets, "<u4").tobytes(), np.array(weights, "<u4").tobytes(), flags.tobytes(), offsets.astype("<u4").tobytes(), *ids])

    def look_up(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of each word, None for those it does not hold; all words walk together."""
        out: list[bytes | None] = [None] * len(words)
        if not len(self.keys) or not words:
            return out
        size = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words) or b"\0", np.uint8).astype(np.uint64)
        start = np.cumsum(size) - size
        live = np.flatnonzero(size)
        state, number, depth = np.zeros(len(live), np.uint64), np.zeros(len(live), np.int64), 0
        while len(live):
            key = (state << np.uint64(8)) | raw[start[live] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            live, arc, number = live[ok], arc[ok], number[ok]
            state, number, depth = self.targets[arc].astype(np.uint64), number + self.weights[arc], depth + 1
            end = size[live] == depth
            for w, n, f in zip(live[end].tolist(), number[end].tolist(), self.final[state[end].astype(np.int64)].tolist(), strict=True):
                if f:
                    out[w] = bytes(self.ids[4 * int(self.offsets[n]): 4 * int(self.offsets[n + 1])])
            live, state, number = live[~end], state[~end], number[~end]
        return out


class Remembered:
    """chunk -> ids of the chunks met last, in two Arrow arrays: a chunk's hash names a slot, the slot an
    entry, and the entry counts if its chunk is the same."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.entry = np.full(1 << SLOT_BITS, -1, np.int32)
        self.chunks, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def find(self, chunks: pa.LargeStringArray, slots: np.ndarray) -> np.ndarray:
        """The entry of each chunk, -1 where there is none."""
        entry = self.entry[slots]
        tried = np.flatnonzero(entry >= 0)
        same = pc.equal(self.chunks.take(pa.array(entry[tried])), chunks.take(pa.array(tried)))
        entry[tried[~same.to_numpy(zero_copy_only=False)]] = -1
        return entry

    def add(self, chunks: pa.LargeStringArray, ids: pa.LargeBinaryArray, slots: np.ndarray) -> None:
        if len(self.chunks) > CACHE or self.chunks.nbytes + self.ids.nbytes > CACHE_BYTES:
            self.clear()
        self.entry[slots] = np.arange(len(self.chunks), len(self.chunks) + len(chunks), dtype=np.int32)
        self.chunks, self.ids = pa.concat_arrays([self.chunks, chunks]), pa.concat_arrays([self.ids, ids])


class Encoder:
    """Texts to ids: remembered chunks, then the automaton, then merges of a whole batch."""

    def __init__(self, vocabulary: Vocabulary, transducer: Transducer | None = None):
        self.vocabulary, self.transducer, self.known = vocabulary, transducer, Remembered()
        self.by_words = bool(vocabulary.end)
        self.chunks, self.pieces = (WORD_CHUNKS, WORD_PIECES) if self.by_words else (BYTE_CHUNKS, BYTE_PIECES)
        self.special = regex.compile("|".join(f"({regex.escape(x)})" for x in vocabulary.special)) if vocabulary.special else None

    def normal(self, text: str) -> str:
        if not self.by_words:
            return text
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)  # no final-sigma rule

    def found(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, by the automaton or by merges."""
        out = self.transducer.look_up([c.encode() for c in chunks]) if self.transducer else [None] * len(chunks)
        # letters alone, with or without the space before them, are one piece
        whole, rest = [], []
        for k, c in enumerate(chunks):
            if out[k] is None:
                (whole if c.isalpha() or (c[:1] == " " and c[1:].isalpha()) else rest).append(k)
        pieces = [self.pieces.findall(chunks[k]) for k in rest]
        number = {x: k for k, x in enumerate(dict.fromkeys(chain.from_iterable(pieces)))}
        ids = self.vocabulary.merge([x.encode() for x in chain((chunks[k] for k in whole), number)])
        for k, x in zip(whole, ids, strict=False):
            out[k] = x
        of_piece = dict(zip(number, ids[len(whole):], strict=True)).__getitem__
        for k, p in zip(rest, pieces, strict=True):
            out[k] = b"".join(map(of_piece, p))
        return out

    def ids_of(self, chunks: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of distinct chunks, remembered or found and remembered from then on."""
        listed = chunks.to_pylist()
        slots = np.fromiter(map(hash, listed), np.int64, len(listed)).view(np.uint64) >> np.uint64(64 - SLOT_BITS)
        entry = self.known.find(chunks, slots)
        old, new = np.flatnonzero(entry >= 0), np.flatnonzero(entry < 0)
        if not len(new):
            return self.known.ids.take(pa.array(entry))
        ids = pa.array(self.found([listed[k] for k in new.tolist()]), pa.large_binary())
        both = pa.concat_arrays([self.known.ids.take(pa.array(entry[old])), ids])
        self.known.add(chunks.take(pa.array(new)), ids, slots[new])
        return both.take(pa.array(np.argsort(np.concatenate([old, new]))))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian uint32."""
        # texts without odd characters are split, numbered and put together by Arrow
        odd = [k for k, t in enumerate(texts) if (self.by_words and ODD.search(t)) or ("<|" in t and self.special and self.special.search(t))]
        out: list = [None] * len(texts)
        for k, ids in zip(odd, self.encode_chunks([texts[k] for k in odd]), strict=True):
            out[k] = ids
        plain = [k for k, x in enumerate(out) if x is None]
        if self.by_words:
            words = pc.ascii_split_whitespace(pa.array([self.normal(texts[k]) for k in plain], pa.large_string()))
            ends, flat = words.offsets.to_numpy() - words.offsets[0].as_py(), words.flatten()
        else:
            lists = [self.chunks.findall(texts[k]) for k in plain]
            ends = np.cumsum([0, *map(len, lists)])
            flat = pa.array(chain.from_iterable(lists), pa.large_string())
        flat = flat.dictionary_encode()
        for k, ids in zip(plain, runs(self.ids_of(flat.dictionary).take(flat.indices), ends), strict=True):
            out[k] = ids
        return out

    def encode_chunks(self, texts: list[str]) -> list[bytes]:
        """Any texts, chunk by chunk; special tokens become their ids."""
        split = []
        for t in texts:
            if "<|" in t and self.special and self.special.search(t):
                parts, at = [], 0
                for m in self.special.finditer(t):
                    parts += [self.chunks.findall(self.normal(t[at:m.start()])), self.vocabulary.special[m[0]]]
                    at = m.end()
                split.append([*parts, self.chunks.findall(self.normal(t[at:]))])
            else:
                split.append(self.chunks.findall(self.normal(t)))
        plain = [x for s in split for x in ([s] if not s or isinstance(s[0], str) else [p for p in s if isinstance(p, list)])]
        distinct = list(dict.fromkeys(chain.from_iterable(plain)))
        get = dict(zip(distinct, self.ids_of(pa.array(distinct, pa.large_string())).to_pylist(), strict=True)).__getitem__
        return [b"".join(map(get, s)) if not s or isinstance(s[0], str) else b"".join(x.to_bytes(4, "little") if isinstance(x, int) else b"".join(map(get, x)) for x in s) for s in split]


def runs(values: pa.LargeBinaryArray, ends) -> list[bytes]:
    """Runs of consecutive values, each put together; ends: the values before each run, and all."""
    if not len(values):
        return [b""] * (len(ends) - 1)
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset: values.offset + len(values) + 1][ends].tolist()
    data = memoryview(values.buffers()[2] or b"")
    return [bytes(data[a:b]) for a, b in zip(at, at[1:], strict=False)]


_loaded: dict = {}
remembers("bpe", _loaded.clear)


def vocabulary_of(data: bytes) -> Vocabulary:
    """Parsed once a worker."""
    key = hashlib.sha1(data).hexdigest()
    if key not in _loaded:
        _loaded[key] = Vocabulary(data)
    return _loaded[key]


def mapped(name: str) -> Transducer:
    """The automaton file that the driver sent to the executors, mapped into memory."""
    if name not in _loaded:
        with open(SparkFiles.get(name), "rb") as f:
            _loaded[name] = Transducer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    return _loaded[name]


def send_file(spark, name: str, content: bytes) -> None:
    """Written to the shared folder, from where Spark gives each executor its copy."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(shared_folder(spark), name)
    stream = path.getFileSystem(conf).create(path, True)
    stream.write(bytearray(content))
    stream.close()
    spark.sparkContext.addFile(path.toString())


def frequent_chunks(texts: DataFrame, words: int = WORDS) -> list[str]:
    """The most frequent chunks of all texts. Each task sends its own most frequent ones, a bounded
    number; which words are compiled changes the speed, never a result."""

    def count(batches):
        c: Counter = Counter()
        for batch in slices(batches):
            for t in batch.column("text").to_pylist():
                c.update(BYTE_CHUNKS.findall(t))
            if len(c) > COUNTED:
                c = Counter({w: n for w, n in c.items() if n > 1}) if sum(n > 1 for n in c.values()) < COUNTED // 2 else Counter(dict(c.most_common(COUNTED // 2)))
        top = heapq.nsmallest(words, c.items(), key=lambda x: (-x[1], x[0]))
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    counted = texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counted.orderBy(F.desc("n"), "word").limit(words).collect()]


def encoded(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, decoded binary): ids as little-endian uint32, and the bytes they decode to."""
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col)
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    encoder = Encoder(vocabulary_of(data))
    common = frequent_chunks(texts)
    content = Transducer.build({w.encode(): ids for w, ids in zip(common, encoder.found(common), strict=True)})
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    send_file(spark, name, content)
    shared = spark.sparkContext.broadcast(data)  # the vocabulary file, of fixed size

    def run(batches):
        only("bpe")
        if (key := ("encoder", name)) not in _loaded:
            _loaded[key] = Encoder(vocabulary_of(shared.value), mapped(name))
        e = _loaded[key]
        tokens = pa.array([e.vocabulary.bytes_of.get(k, b"") for k in range(max(e.vocabulary.bytes_of) + 1)], pa.large_binary())
        for batch in slices(batches):
            ids = e.encode(batch.column("text").to_pylist())
            back = runs(tokens.take(pa.array(np.frombuffer(b"".join(ids), "<u4"))), np.cumsum([0, *(len(x) // 4 for x in ids)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], names=["doc_id", "ids", "decoded"])

    return texts.mapInArrow(run, "doc_id long, ids binary, decoded binary")
