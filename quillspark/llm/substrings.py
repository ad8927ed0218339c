"""Removal of repeated substrings of n words, found by fixed-block anchors.

Of each document the non-overlapping runs of b = (n+1)//2 words at multiples of b are
the reference blocks; any window of n words holds one of them whole.  Every rolling window
of b words probes the index, and a probe that meets a reference block elsewhere is a hit.  Hits are
extended: each n-word window that holds a hit is looked up by two independent 64-bit hashes of
all its words, and consecutive windows that were seen earlier join to maximal exact repeats.

Scale.  Texts are dealt once into blocks of consecutive doc_ids, of bounded bytes.  A block sends
its probes to hash ranges as sorted gaps of a few bytes, every distinct value once, so a passage
that is in all documents costs one entry a block; probes have more bits the more text there is, so
that chance hits stay rare at any size.  Since blocks are ordered, whether a window
starts earlier needs no address: the smallest block that has it comes first, and inside a
block it is known locally.  The answers are bit masks over the values sent.

Defined results: null or empty text has no words and nothing to remove.  Documents of fewer
than n words are untouched.  Rows that share a doc_id are ordered by the hash of their text.  A
null doc_id counts as later than all others.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .common import U64, WordHashes, id_and_text, mix, n_partitions, only, pack_sorted, remembers, unpack_sorted, windows
from .order import with_blocks

_HASHES = WordHashes()
remembers("substrings", _HASHES.clear)
#: The fewest bits of a probe, and how many there are beyond those that number all probes.  A chance
#: meeting only makes a window a candidate; windows are decided by 128 bits.
PROBE_BITS, SPARE_BITS = 40, 12


def probe_bits(total: int) -> int:
    """Bits of a probe for texts of so many bytes: chance hits stay below one in 2^SPARE_BITS."""
    return min(64, max(PROBE_BITS, (total // 4).bit_length() + SPARE_BITS))


class _Block:
    """The documents of one block in order, as one run of word hashes."""

    def __init__(self, table: pa.Table, n: int):
        only("substrings")
        ids, by = table.column("doc_id").to_pylist(), table.column("hash").to_pylist()
        texts = table.column("text").cast(pa.binary())
        self.order = order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, by[i]))
        self.ids, self.texts = [ids[i] for i in order], [texts[i] for i in order]
        hashes = [_HASHES.of(t.as_py().split()) for t in self.texts]
        self.sizes = np.array([len(h) for h in hashes], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.sizes)])
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, U64)
        self.place = np.arange(self.start[-1]) - np.repeat(self.start[:-1], self.sizes)
        self.left = np.repeat(self.sizes, self.sizes) - self.place  # words from here to the document's end
        self.long = np.repeat(self.sizes, self.sizes) >= n

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of the windows of n words that lie within one document."""
        h = windows(self.hashes, n)
        at = np.flatnonzero(self.left[: len(h)] >= n)
        return at, h[at]


def _probes(block: _Block, n: int, b: int, bits: int):
    """Distinct probe values of a block, in order, and of each window of b words: its start and its
    value's number; which values are anchors; which occur more than once."""
    at, h = block.runs(b)
    keep = block.long[at]
    at, h = at[keep], h[keep] >> U64(64 - bits)
    values, number, counts = np.unique(h, return_inverse=True, return_counts=True)
    anchor = np.zeros(len(values), bool)
    anchor[number[block.place[at] % b == 0]] = True
    return values, at, number, anchor, counts > 1


def _buckets(values: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    top = (values >> U64(bits - 32)) * U64(buckets) >> U64(32)
    return np.searchsorted(top, np.arange(buckets + 1, dtype=U64))


_SENT = "bucket int, block long, vals binary, anchor binary, multi binary"


def _batch(rows, types) -> pa.Table:
    names = [n for n, _ in types]
    return pa.table([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(types)], names=names)


def _send_probes(table: pa.Table, n: int, b: int, buckets: int, bits: int) -> pa.Table:
    block = _Block(table, n)
    number = table.column("block")[0].as_py()
    values, _, _, anchor, multi = _probes(block, n, b, bits)
    at = _buckets(values, bits, buckets)
    rows = [(k, number, pack_sorted(values[at[k]:at[k + 1]]), np.packbits(anchor[at[k]:at[k + 1]]).tobytes(), np.packbits(multi[at[k]:at[k + 1]]).tobytes()) for k in range(buckets) if at[k] < at[k + 1]]
    return _batch(rows, (("bucket", pa.int32()), ("block", pa.int64()), ("vals", pa.binary()), ("anchor", pa.binary()), ("multi", pa.binary())))


_ANSWER = "block long, bucket int, mask binary"


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _answer_probes(table: pa.Table) -> pa.Table:
    """Which values are anchors somewhere and occur more than once in all."""
    bucket = table.column("bucket")[0].as_py()
    sent = [(s, unpack_sorted(v), a, m) for s, v, a, m in zip(*(table.column(c).to_pylist() for c in ("block", "vals", "anchor", "multi")), strict=True)]
    every = np.concatenate([v for _, v, _, _ in sent])
    anchor = np.concatenate([_bits(a, len(v)) for _, v, a, _ in sent])
    multi = np.concatenate([_bits(m, len(v)) for _, v, _, m in sent])
    order = np.argsort(every, kind="stable")
    head = np.concatenate([[True], every[order][1:] != every[order][:-1]])
    group = np.empty(len(every), np.int64)
    group[order] = np.cumsum(head) - 1
    size = np.bincount(group)
    hit = (np.bincount(group, anchor) > 0) & ((size > 1) | (np.bincount(group, multi) > 0))
    hit, rows, at = hit[group], [], 0
    for s, v, _, _ in sent:
        mask = hit[at:at + len(v)]
        at += len(v)
        if mask.any():
            rows.append((s, bucket, np.packbits(mask).tobytes()))
    return _batch(rows, (("block", pa.int64()), ("bucket", pa.int32()), ("mask", pa.binary())))


def _hits(answers: pa.Table, at: np.ndarray, n: int) -> np.ndarray:
    """The masks of a block put together, one bit a value."""
    out = np.zeros(n, bool)
    for k, mask in zip(answers.column("bucket").to_pylist(), answers.column("mask").to_pylist(), strict=True):
        out[at[k]:at[k + 1]] = _bits(mask, at[k + 1] - at[k])
    return out


def _candidates(block: _Block, answers: pa.Table, n: int, b: int, buckets: int, bits: int):
    """Windows of n words that hold a hit: starts and both hashes."""
    values, at, number, _, _ = _probes(block, n, b, bits)
    hit = _hits(answers, _buckets(values, bits, buckets), len(values))[number]
    marks = np.zeros(len(block.hashes) + 1, np.int64)
    marks[at[hit] + 1] = 1
    marks = np.cumsum(marks)  # marks[i]: hits that start before word i
    start, h = block.runs(n)
    holds = marks[start + n - b + 1] > marks[start]
    start, h = start[holds], h[holds]
    return start, h, windows(mix(block.hashes ^ SECOND), n)[start] if len(start) else h


#: Makes the second hash of a window's words independent of the first.
SECOND = U64(0x5851F42D4C957F2D)


def _distinct(h: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of hashes: where each distinct pair comes first, in order, and the number of each pair."""
    order = np.lexsort((h2, h))
    head = np.ones(len(h), bool)
    head[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(head) - 1
    return order[head], number


def _send_windows(table: pa.Table, answers: pa.Table, n: int, b: int, buckets: int, bits: int) -> pa.Table:
    rows = []
    if table.num_rows:
        number = table.column("block")[0].as_py()
        _, h, h2 = _candidates(_Block(table, n), answers, n, b, buckets, bits)
        first, _ = _distinct(h, h2)
        values, second = h[first], h2[first].astype("<u8")
        at = _buckets(values, 64, buckets)
        rows = [(k, number, pack_sorted(values[at[k]:at[k + 1]]), second[at[k]:at[k + 1]].tobytes()) for k in range(buckets) if at[k] < at[k + 1]]
    return _batch(rows, (("bucket", pa.int32()), ("block", pa.int64()), ("vals", pa.binary()), ("second", pa.binary())))


def _answer_windows(table: pa.Table) -> pa.Table:
    """For each block, which of the windows it sent are in a smaller block as well."""
    bucket = table.column("bucket")[0].as_py()
    sent = sorted(zip(*(table.column(c).to_pylist() for c in ("block", "vals", "second")), strict=True), key=lambda x: x[0])
    values = [unpack_sorted(v) for _, v, _ in sent]
    first, _ = _distinct(np.concatenate(values), np.concatenate([np.frombuffer(x, "<u8") for _, _, x in sent]))  # in order of blocks
    later = np.ones(sum(map(len, values)), bool)
    later[first] = False
    rows, at = [], 0
    for (s, _, _), v in zip(sent, values, strict=True):
        mask = later[at:at + len(v)]
        at += len(v)
        if mask.any():
            rows.append((s, bucket, np.packbits(mask).tobytes()))
    return _batch(rows, (("block", pa.int64()), ("bucket", pa.int32()), ("mask", pa.binary())))


def _removed(table: pa.Table, answers: pa.Table, n: int, b: int, buckets: int, bits: int):
    """The block and a mask of its words that are covered by a window that starts earlier too."""
    block = _Block(table, n)
    kind = np.array(answers.column("kind").to_pylist(), np.int64)
    of = lambda k: answers.filter(pa.array(kind == k))
    start, h, h2 = _candidates(block, of(0), n, b, buckets, bits)
    first, number = _distinct(h, h2)
    earlier = _hits(of(1), _buckets(h[first], 64, buckets), len(first))[number]
    own_first = np.zeros(len(h), bool)
    own_first[first] = True
    covered = np.zeros(len(block.hashes) + 1, np.int64)
    repeat = start[earlier | ~own_first]
    np.add.at(covered, repeat, 1)
    np.add.at(covered, repeat + n, -1)
    return block, np.cumsum(covered[:-1]) > 0


def _kept(table: pa.Table, answers: pa.Table, n: int, b: int, buckets: int, bits: int, with_text: bool, carry: tuple[str, ...]) -> pa.Table:
    ids, words, removed, sha, texts, order = [], [], [], [], [], []
    if table.num_rows:
        block, gone = _removed(table, answers, n, b, buckets, bits)
        order = block.order
        for i, t in enumerate(block.texts):
            w = t.as_py().split()
            g = gone[block.start[i]:block.start[i + 1]]
            k = int(g.sum())
            text = b" ".join(w if not k else [x for x, y in zip(w, g.tolist(), strict=True) if not y])
            ids.append(block.ids[i])
            words.append(len(w))
            removed.append(k)
            sha.append(hashlib.sha256(text).hexdigest())
            texts.append(text.decode("utf-8", "replace") if with_text and k else None)
    out = {"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
    own = {c: table.column(c).take(pa.array(order, pa.int64())) for c in carry}
    return pa.table(out | ({"kept_text": pa.array(texts, pa.string())} if with_text else {}) | own)


def remove_repeats(docs: DataFrame, window: int = 20, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) and, with_text, kept_text: the remaining words
    joined by one space, null where nothing was removed.  With the name of a further column, each
    row also brings its own text and that column, as a doc_id alone may not tell rows apart."""
    buckets, b = n_partitions(docs.sparkSession), (window + 1) // 2
    more = () if carry is None else (carry,)
    texts = id_and_text(docs, id_col, text_col, *more)
    texts, total = with_blocks(texts, 2 * buckets)
    texts, bits = texts.repartition(buckets, "block"), probe_bits(total)

    sent = texts.groupBy("block").applyInArrow(lambda t: _send_probes(t, window, b, buckets, bits), _SENT)
    hits = sent.groupBy("bucket").applyInArrow(_answer_probes, _ANSWER)
    by_block = texts.groupBy("block")
    sent = by_block.cogroup(hits.groupBy("block")).applyInArrow(lambda t, a: _send_windows(t, a, window, b, buckets, bits), "bucket int, block long, vals binary, second binary")
    again = sent.groupBy("bucket").applyInArrow(_answer_windows, _ANSWER)
    answers = hits.withColumn("kind", F.lit(0)).unionByName(again.withColumn("kind", F.lit(1)))
    schema = StructType().add("doc_id", LongType()).add("n_words", LongType()).add("n_removed", LongType()).add("kept_sha256", StringType())
    schema = schema.add("kept_text", StringType()) if with_text else schema
    own = ("text", *more) if more else ()
    for c in own:
        schema = schema.add(c, texts.schema[c].dataType)
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(lambda t, a: _kept(t, a, window, b, buckets, bits, with_text, own), schema)
