"""Document fingerprints: a Merkle tree over sections, paragraphs and short runs of words.

A paragraph is a line; a section ends at a blank line or after 16 paragraphs.  The leaves of a
paragraph are runs of four words (of the first paragraph, the first eight words are leaves of
their own, so that very short texts have branches too).  A paragraph's node hashes its bytes, a section's node
its paragraphs' nodes, the root the sections' nodes.  The fingerprint is the serialised tree.

Two trees are compared from the root: equal roots mean equal texts; sections that both have are
not entered, nor are paragraphs that both have below the sections that differ.  What the descent
reaches are the leaves of differing paragraphs: those without a partner are the edits, and the
likeness is the share of leaves that are below equal branches or have a partner.

A document and its successor in descending doc_id are brought together without a global
sort: texts are dealt once into blocks of consecutive ids, and the first text of each block
is dealt to the block before it as well.

Defined results: null text is the empty text, whose tree has one empty paragraph.  Rows of one
doc_id are ordered by the hash of their text; a null doc_id comes before all others in descending
order.  A table of one document has itself as the next one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, n_partitions
from .order import with_blocks

SECTION, RUN, SINGLES = 16, 4, 8
_leaf = xxhash.xxh32_intdigest


def _node(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


@dataclass
class Tree:
    root: bytes = b""
    sections: list[tuple[bytes, int, int]] = field(default_factory=list)  # node, first and end paragraph
    paragraphs: list[tuple[bytes, int, int]] = field(default_factory=list)  # node, first and end leaf
    leaves: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, text: str) -> Tree:
        t, leaves, paragraphs, sections, begin = cls(), [], [], [], 0
        lines = text.encode("utf-8", "surrogatepass").split(b"\n")
        for i, line in enumerate(lines):
            words, first = line.split(b" "), len(leaves)
            if not i:
                leaves += map(_leaf, words[:SINGLES])
                words = words[SINGLES:]
            leaves += [_leaf(b" ".join(words[k:k + RUN])) for k in range(0, len(words), RUN)]
            paragraphs.append((_node(line), first, len(leaves)))
            if i + 1 == len(lines) or not line or i + 1 - begin == SECTION:
                sections.append((_node(b"".join(p[0] for p in paragraphs[begin:])), begin, i + 1))
                begin = i + 1
        t.leaves, t.paragraphs, t.sections = leaves, paragraphs, sections
        t.root = hashlib.sha256(b"".join(s[0] for s in sections)).digest()
        return t

    def fingerprint(self) -> str:
        """root:section,section,...;each section is its node and its paragraphs' leaves."""
        leaves = np.array(self.leaves, ">u4").tobytes().hex()
        parts = []
        for node, a, b in self.sections:
            parts.append(node.hex()[:16] + "".join(f"/{leaves[8 * p[1]: 8 * p[2]]}" for p in self.paragraphs[a:b]))
        return self.root.hex() + ":" + ",".join(parts)

    def differing(self, other: Tree) -> list[tuple[int, int]]:
        """Leaf ranges of this tree's paragraphs that have no equal branch in the other one."""
        if self.root == other.root:
            return []
        nodes = Counter(node for node, _, _ in other.sections)
        own = [s for s in self.sections if not _taken(nodes, s[0])]
        nodes = Counter(node for node, _, _ in self.sections)
        open_ = [s for s in other.sections if not _taken(nodes, s[0])]
        lines = Counter(p[0] for _, a, b in open_ for p in other.paragraphs[a:b])
        return [(x, y) for _, a, b in own for node, x, y in self.paragraphs[a:b] if not _taken(lines, node)]


def _taken(counts: Counter, node: bytes) -> bool:
    """Whether a partner was left, which then is used up."""
    if counts[node]:
        counts[node] -= 1
        return True
    return False


def compared(a: Tree, b: Tree) -> tuple[float, list[tuple[int, int]]]:
    """Likeness of two trees (1 for equal roots only), and the ranges of a's leaves that b lacks."""
    if a.root == b.root:
        return 1.0, []
    reached, theirs = a.differing(b), Counter(x for u, v in b.differing(a) for x in b.leaves[u:v])
    edits, missing = [], 0
    for u, v in reached:
        for k in range(u, v):
            if theirs[a.leaves[k]]:
                theirs[a.leaves[k]] -= 1
                continue
            missing += 1
            if edits and edits[-1][1] == k and k > u:
                edits[-1] = (edits[-1][0], k + 1)
            else:
                edits.append((k, k + 1))
    most = len(a.leaves) + len(b.leaves) - 1  # different texts are less than 1
    return min(2 * (len(a.leaves) - missing), most) / (most + 1), edits


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as many first code points of the following one."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_leaves long, edits array<struct<first:int,end:int>>"


def _print_block(table: pa.Table) -> pa.Table:
    rows = zip(*(table.column(c).to_pylist() for c in ("doc_id", "hash", "text", "ahead")), strict=True)
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]), reverse=True)
    own, ahead = [r for r in rows if not r[3]], [r for r in rows if r[3]]
    texts = [r[2] for r in own] + [ahead[0][2] if ahead else (own[0][2] if own else "")]
    out: list[tuple] = []
    tree = Tree.of(texts[0])
    for i, (doc, _, text, _) in enumerate(own):
        after = Tree.of(texts[i + 1])
        changed = edited(text, texts[i + 1])
        other = Tree.of(changed)
        sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        near, edits = compared(tree, other)
        out.append((doc, len(text), sha, tree.fingerprint(), other.fingerprint(), near, compared(tree, after)[0], len(tree.leaves), [{"first": x, "end": y} for x, y in edits]))
        tree = after
    ranges = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), ranges)
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_leaves", "edits")
    return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_leaves,
    edits): edits are the ranges of leaves that the edited text lacks."""
    spark = docs.sparkSession
    parts = n_partitions(spark)
    texts, _ = with_blocks(id_and_text(docs, id_col, text_col), 4 * parts)
    # the first document of each block, in descending order: as many rows as blocks
    first = F.max(F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id"), F.col("hash"))).alias("x")
    heads = sorted(((r.block, r.x.doc_id, r.x.hash) for r in texts.groupBy("block").agg(first).collect()), key=lambda r: -r[0])
    heads = [(doc, h, heads[i - 1][0]) for i, (_, doc, h) in enumerate(heads)]
    ahead = F.broadcast(spark.createDataFrame(heads, "head long, head_hash long, target long"))
    second = texts.join(ahead, texts["doc_id"].eqNullSafe(ahead["head"]) & (texts["hash"] == ahead["head_hash"]))
    second = second.select("doc_id", "text", "hash", F.col("target").alias("block")).dropDuplicates(["block"]).withColumn("ahead", F.lit(True))
    both = texts.withColumn("ahead", F.lit(False)).unionByName(second).repartition(parts, "block")
    return both.groupBy("block").applyInArrow(_print_block, _SCHEMA)
