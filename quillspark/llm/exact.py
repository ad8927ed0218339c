"""Exact deduplication with counting quotient filters and byte verification.

Every partition puts its 64-bit text fingerprints into a counting quotient filter: the
high bits (quotient) select a run, the low bits (remainder) are stored sorted within their
run, each with a count.  Filters of the same quotient range merge without loss by merging
their sorted remainders and adding counts.  Only fingerprints whose merged count exceeds
one are routed on: the texts behind them are grouped byte by byte, with partial aggregation
on the map side, so a text with any number of copies leaves each task once.  Other texts are not
moved: routed fingerprints are broadcast up to a counted bound, beyond it as a bitmap of fixed size
that lets some others through, which the groups sort out.  Groups come back to
their rows from a checkpoint by a plain join, of which Spark can split the partition of a large group.

Defined results: null text is the empty text, and empty texts are copies of each other.
Repeated rows are copies too; rows that share doc_id and text are all marked kept when that
doc_id is the largest.  A null doc_id is smaller than any other; a group of such rows only
has a null keep_id and the rows are kept.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import only_listed
from .common import U64, checkpointed, id_and_text, n_partitions


class CountingQuotientFilter:
    """Fingerprints of one quotient range as run lengths, sorted remainders and counts."""

    def __init__(self, quotients: np.ndarray, run_lengths: np.ndarray, remainders: np.ndarray, counts: np.ndarray, remainder_bits: int):
        self.quotients, self.run_lengths, self.remainders, self.counts, self.remainder_bits = quotients, run_lengths, remainders, counts, remainder_bits

    @classmethod
    def of(cls, fingerprints: np.ndarray, remainder_bits: int, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        order = np.argsort(fingerprints, kind="stable")
        f = fingerprints[order]
        c = np.ones(len(f), np.int64) if counts is None else counts[order]
        head = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])) if len(f) else np.empty(0, np.int64)
        f, c = f[head], np.add.reduceat(c, head) if len(head) else c
        q, r = f >> U64(remainder_bits), f & U64((1 << remainder_bits) - 1)
        quotients, lengths = np.unique(q, return_counts=True)
        return cls(quotients, lengths.astype(np.uint32), r, c, remainder_bits)

    def fingerprints(self) -> np.ndarray:
        return (np.repeat(self.quotients, self.run_lengths) << U64(self.remainder_bits)) | self.remainders

    def merged(self, *others: CountingQuotientFilter) -> CountingQuotientFilter:
        every = (self, *others)
        return self.of(np.concatenate([x.fingerprints() for x in every]), self.remainder_bits, np.concatenate([x.counts for x in every]))

    def to_bytes(self) -> bytes:
        width = (self.remainder_bits + 7) // 8
        body = np.ascontiguousarray(self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
        one = self.counts == 1
        parts = (np.array([len(self.quotients), len(self.remainders), self.remainder_bits], "<u8"), self.quotients.astype("<u8"), self.run_lengths.astype("<u4"), body, np.packbits(one), self.counts[~one].astype("<u8"))
        return b"".join(x.tobytes() for x in parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        nq, n, bits = (int(x) for x in np.frombuffer(data, "<u8", 3))
        width, at = (bits + 7) // 8, 24
        quotients = np.frombuffer(data, "<u8", nq, at)
        lengths = np.frombuffer(data, "<u4", nq, at := at + 8 * nq)
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = np.frombuffer(data, np.uint8, n * width, at := at + 4 * nq).reshape(n, width)
        one = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at := at + n * width), count=n).astype(bool)
        counts = np.ones(n, np.int64)
        counts[~one] = np.frombuffer(data, "<u8", int((~one).sum()), at + (n + 7) // 8)
        return cls(quotients, lengths, full.view("<u8").ravel(), counts, bits)


#: Quotients are numbered within 2^20 runs of the whole hash range.
REMAINDER_BITS = 44


#: Fingerprints that a task holds before its filters leave it, and those that are broadcast as they are.
HELD, LISTED = 1 << 22, 1_000_000


def _filters(batches, ranges):
    """The filters of a partition, one a range of quotients."""
    held: list[np.ndarray] = []

    def out():
        f = np.sort(np.concatenate(held))
        held.clear()
        part = ((f >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64)
        at = np.searchsorted(part, np.arange(ranges + 1))
        full = np.flatnonzero(np.diff(at))
        made = [CountingQuotientFilter.of(f[at[b]:at[b + 1]], REMAINDER_BITS).to_bytes() for b in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(made, pa.binary())], names=["part", "filter"])

    for batch in batches:
        held.append(batch.column("fp").to_numpy().view(U64))
        if sum(map(len, held)) >= HELD:
            yield out()
    if held:
        yield out()


def _repeated(table: pa.Table) -> pa.Table:
    first, *rest = (CountingQuotientFilter.from_bytes(x) for x in table.column("filter").to_pylist())
    whole = first.merged(*rest)
    return pa.table({"fp": whole.fingerprints()[whole.counts > 1].view(np.int64)})


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row a document."""
    ranges = n_partitions(docs.sparkSession)
    texts = id_and_text(docs, id_col, text_col)
    hashed = texts.select("doc_id", "text", F.xxhash64("text").alias("fp"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    filters = hashed.select("fp").mapInArrow(lambda b: _filters(b, ranges), "part int, filter binary")
    repeated = checkpointed(filters.groupBy("part").applyInArrow(_repeated, "fp long"))
    few = repeated.count() <= LISTED
    routed = hashed.join(F.broadcast(repeated), "fp", "left_semi") if few else only_listed(hashed, repeated, "fp")
    # byte verification: equal fingerprints are copies only where the whole texts are equal
    same = routed.groupBy("text_sha256", "text").agg(F.max("doc_id").alias("keep"), F.count("*").alias("size"))
    same = checkpointed(same.where("size > 1").select("text_sha256", "keep", F.col("size").alias("group_size")))
    out = hashed.select("doc_id", "text_sha256").join(same, "text_sha256", "left")
    return out.select(
        "doc_id",
        F.coalesce("keep", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep"), F.col("keep").isNull()).alias("kept"),
        "text_sha256",
    )
