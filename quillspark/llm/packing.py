"""Sum-of-squares online packing of token sequences into windows.

Documents arrive in the order of their partition.  Whole windows are cut off a long document
first; what remains goes to the fill level at which the sum of the squared numbers of partially
filled windows, kept in an array by level, becomes least.  When a partition ends, its partially
filled windows are joined: pieces of the emptiest are cut to fill the fullest, and the last
window is cut into lengths that are powers of two, which need no padding.

A partition is packed by one task in one pass and without a shuffle.  Partially filled windows are
held until they are full: the sum of squares keeps their number about even over the levels, but
no bound on it is proven, and in the worst case (all pieces over half a window) a task holds the
remainders of its partition's documents, four bytes a token.

Defined results: null text is the empty text, a document of its end id only.  Repeated rows are
documents of their own.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import Encoder, _loaded, vocabulary_of
from .common import id_and_text, only, slices

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Windows being filled; finished ones are lists of (doc, start, ids, doc_tokens)."""

    def __init__(self, size: int):
        self.size = size
        self.levels = np.zeros(size + 1, np.int64)  # partially filled windows by fill level
        self.open: dict[int, list[list]] = {}

    def place(self, piece: tuple) -> list | None:
        """Put a piece shorter than a window into one; the window if that fills it."""
        n = len(piece[2]) // 4
        # the change of the sum of squares for each level that can take the piece; level 0 is a new window
        from_, to = self.levels[: self.size - n + 1], self.levels[n:]
        change = 2 * (to - from_) + 2
        change[0] = 2 * to[0] + 1
        change[-1] = 1 - 2 * from_[-1]  # a full window counts no more
        usable = from_ > 0
        usable[0] = True
        change = np.where(usable, change, 2**62)
        level = len(change) - 1 - int(np.argmin(change[::-1]))  # of equals the fullest
        window = self.open[level].pop() if level else []
        if level:
            self.levels[level] -= 1
        window.append(piece)
        if level + n == self.size:
            return window
        self.levels[level + n] += 1
        self.open.setdefault(level + n, []).append(window)
        return None

    def close(self) -> list[list]:
        """All windows left, joined to full ones and then lengths that are powers of two."""
        rest = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open, self.levels[:] = {}, 0
        pieces = [p for w in rest for p in w]
        out, window, room = [], [], self.size
        left = sum(len(p[2]) // 4 for p in pieces)
        room = self.size if left >= self.size else 1 << max(0, left.bit_length() - 1)
        for doc, start, ids, tokens in pieces:
            while ids:
                part, ids = ids[: 4 * room], ids[4 * room:]
                window.append((doc, start, part, tokens))
                n = len(part) // 4
                start, room, left = start + n, room - n, left - n
                if not room:
                    out.append(window)
                    window = []
                    room = self.size if left >= self.size else 1 << max(0, left.bit_length() - 1)
        return out


def _pack(batches, encoder_of, size: int, end: bytes):
    only("bpe")
    encoder, packer = encoder_of(), SumOfSquares(size)
    number = TaskContext.get().partitionId() << 33 if TaskContext.get() else 0
    rows: list[tuple] = []

    def out(windows):
        nonlocal number
        for w in windows:
            offset = 0
            for doc, start, ids, tokens in w:
                rows.append((doc, start, len(ids) // 4, ids, tokens, number, offset))
                offset += len(ids) // 4
            number += 1

    def batch():
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        rows.clear()
        return made

    for b in slices(batches):
        for doc, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(b.column("text").to_pylist()), strict=True):
            ids += end
            tokens, start = len(ids) // 4, 0
            while tokens - start >= size:
                out([[(doc, start, ids[4 * start: 4 * (start + size)], tokens)]])
                start += size
            if start < tokens and (full := packer.place((doc, start, ids[4 * start:], tokens))):
                out([full])
        yield batch()
    out(packer.close())
    yield batch()


def packed(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset); ids are little-endian
    uint32.  The vocabulary file is read by the driver and sent to the workers."""
    with open(tokenizer_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def encoder():
        if (key := ("packing", hash(shared.value))) not in _loaded:
            _loaded[key] = Encoder(vocabulary_of(shared.value))
        return _loaded[key]

    return id_and_text(docs, id_col, text_col).mapInArrow(lambda b: _pack(b, encoder, size, end_id.to_bytes(4, "little")), SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 in place of the ids."""
    return pieces.selectExpr("doc_id", "start", "length", "crc32(ids) AS ids_crc32", "doc_tokens", "sequence_id", "offset")
