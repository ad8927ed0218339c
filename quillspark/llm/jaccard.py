"""N-gram Jaccard self-join: size-banded tiles with hashed bitmap signatures.

A document is the set of its distinct n-word shingles, as sorted 64-bit hashes.  Two sets
that meet the threshold num/den differ in at most d = (den-num)/(den+num) * (|A|+|B|)
shingles.  Sizes are dealt into bands; for the largest size of a band the hash space is cut
into k > d parts, so linked sets agree on at least k-d whole parts.  k is chosen so that
one of those parts holds shingles, several if it can be, and such parts are the tile keys: sets that
agree on a part are candidates, but each set leaves out the most frequent keys it can do without.  A bitmap signature holds the parity of the shingles that hash to
each bit; the bit count of two bitmaps' exclusive-or is a lower bound of the sets' difference, so
an upper bound of their overlap.  All pairs of a small bucket are tried; a bucket of more than
SMALL sets is compared in size-sorted tiles.  What bitmaps leave connected is a group, and inside
a group tiles compare bitmaps again, and survivors by exact intersection of the sorted arrays.

Scale.  Tile keys travel as packed, sorted arrays, one blob a batch and bucket; keys that are
common within a batch leave it as rows of their own.  Equal sets are one representative.  Buckets
and groups that are too large for one task are cut into blocks by size band, and each pair of
blocks whose sizes can meet is a tile of bounded size.  Within a tile a document that has
joined a component is compared no more, so thousands of near copies cost about one
comparison a member, and spanning links are all that leaves.

Identity.  What is compared are classes of equal sets, each a numbered node with its smallest
doc_id; texts come back by that doc_id and count only where their set is the class's own.  Classes
come back to their rows from a checkpoint by a plain join, of which Spark can split the partition
of a class with a large share of all rows.

Defined results: null or empty text, or text without words: empty set, linked with nothing
(component_id is its own doc_id).  Fewer than n words: the whole sequence is one shingle.
Rows are documents of their own, also where they share a doc_id: each gets the component of its own
text, whatever their order, and repeated rows the same one.  A null doc_id: the row is returned
with a null component_id and linked with nothing.  An empty table: no rows.
"""

from __future__ import annotations

import functools
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, WordHashes, checkpointed, id_and_text, mix, n_partitions, only, pack_sorted, remembers, slices, unpack_sorted, windows
from .bloom import only_listed
from .components import connected_components

RATIO = 1.25
#: Bits of a bitmap: a power of two of at least so many times the shingles in which linked sets of its
#: size may differ a set, counted for FEWEST shingles at least.  With fewer, sets that share next to
#: nothing pass in tiles of common keys, and groups grow with the square of the documents.
BITS = Fraction(57, 5)
FEWEST = 100
#: Documents and shingles in one block of a group that is cut into tiles.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 1_000_000
#: Sets of a bucket of which all pairs are tried.
SMALL = 16
#: Sets of a tile of which all bitmaps are compared at once.
FEW = 128
#: High bits of a tile key that are sent; a chance meeting only makes a candidate.
KEY_BITS = 48
#: The last of them tell a set's bands apart, as the band modulo BANDS.
BANDS = 4
_LOW = U64(64 - KEY_BITS)
_HASHES = WordHashes()
remembers("jaccard", _HASHES.clear)


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text, A-Z lower-cased."""
    words = text.lower().split()  # on bytes: exactly A-Z, and exactly 0x20 and 0x09-0x0D
    if not words:
        return np.empty(0, U64)
    h = _HASHES.of(words)
    return np.unique(windows(h, n)) if len(words) >= n else windows(h, len(words)) ^ U64(len(words))


@functools.cache
def bands(top: int) -> list[tuple[int, int]]:
    """Size bands (least, largest) up to a size, in geometric steps."""
    out, lo = [], 1
    while lo <= top:
        hi = max(lo, math.ceil(lo * RATIO) - 1)
        out.append((lo, hi))
        lo = hi + 1
    return out


@functools.lru_cache(100_000)
def parts_of(lo: int, hi: int, num: int, den: int) -> tuple[int, int]:
    """For a band: parts k, and the least shingles of a part that makes a key.  Of all choices with
    k <= 2d+3, the one with the thickest keys that nearly all sets have more than d of."""
    d = (den - num) * 2 * hi // (den + num)
    if d == 0:
        return 1, 1
    best = (2 * d + 3, 1)
    for least in range(1, 9):
        for spare in range(1, d + 3):
            k = d + 1 + spare
            lam = lo / k
            thin = k * math.exp(-lam) * sum(lam**i / math.factorial(i) for i in range(least))
            if thin + 3 * math.sqrt(thin) <= spare:
                best = (k, least)
                break
        else:
            break
    return best


def tile_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of a set: of its own band, and of each band that holds larger sets it can meet."""
    return keys_and_spare(s, num, den)[0]


def keys_and_spare(s: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set, and by band modulo BANDS how many of them it can do without: all sets linked with
    it share more of the band's keys.  A set of t thick parts that differs from
    others in d shingles at most shares t-d; only where that is none it sends thin and empty parts too,
    which very many sets share."""
    n, out = len(s), []
    spare = np.full(BANDS, 255)
    m = mix(s)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(m, dtype=U64)])
    for b, (lo, hi) in enumerate(bands(n * den // num)):
        if hi < n or lo * num > n * den:
            continue
        k, least = parts_of(lo, hi, num, den)
        differ = (den - num) * (n + min(hi, n * den // num)) // (den + num)
        cuts = (np.arange(1, k, dtype=np.float64) * (2.0**64 / k)).astype(U64)
        at = np.concatenate([[0], np.searchsorted(s, cuts), [n]])
        count = np.diff(at)
        key = mix(total[at[1:]] - total[at[:-1]] + mix(np.arange(k, dtype=U64) + U64(b << 32)) + count.astype(U64))
        key = ((key >> _LOW) & ~U64(BANDS - 1) | U64(b % BANDS)) << _LOW
        thick = count >= least
        more = int(thick.sum()) - differ - 1
        out.append(key[thick] if more >= 0 else key)
        spare[b % BANDS] = min(spare[b % BANDS], max(0, more))
    keys = np.concatenate(out) if out else np.empty(0, U64)
    return keys, spare if len(np.unique(keys)) == len(keys) else np.zeros_like(spare)


def bitmap(s: np.ndarray, num: int = 9, den: int = 10) -> np.ndarray:
    """Parities of the shingles that hash to each bit; the low bits of the hash count, so a bitmap
    folds to a smaller one by the exclusive-or of its halves."""
    n = max(64, 1 << (int(BITS * (den - num) * max(len(s), FEWEST) / (den + num)) - 1).bit_length())
    odd = np.bincount((mix(s) & U64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


class Bitmaps:
    """Bitmaps of several lengths, a matrix a length."""

    def __init__(self, data: list[bytes]):
        self.words = np.array([len(x) // 8 for x in data], np.int64)
        self.row = np.zeros(len(data), np.int64)
        self.of = {}
        for w in np.unique(self.words):
            own = np.flatnonzero(self.words == w)
            self.row[own] = np.arange(len(own))
            self.of[int(w)] = np.frombuffer(b"".join(data[i] for i in own), U64).reshape(-1, w)

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bits in which the bitmaps x[i] and y[i] differ, at the length of the shorter one."""
        out = np.zeros(len(x), np.int64)
        a, b = self.words[x], self.words[y]
        for u, v in {*zip(a.tolist(), b.tolist(), strict=True)}:
            at, least = np.flatnonzero((a == u) & (b == v)), min(u, v)
            one, two = self.of[u][self.row[x[at]]], self.of[v][self.row[y[at]]]
            out[at] = np.bitwise_count(folded(one, least) ^ folded(two, least)).sum(1, dtype=np.int64)
        return out


def _texts(batch: pa.RecordBatch, name: str = "text"):
    return batch.column(name).cast(pa.binary()).to_pylist()


#: What tells classes of equal sets apart: two sums of hashes and the size.
CLASS = ["f1", "f2", "n"]


def signature(s: np.ndarray) -> tuple[int, int, int]:
    """The class of a set, as signed 64-bit numbers."""
    sums = np.array([mix(s).sum(dtype=U64), mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64)], U64).view(np.int64)
    return int(sums[0]), int(sums[1]), len(s)


def _classes(batches, n, num, den):
    only("jaccard")
    for batch in slices(batches, 8_000_000):
        sets = [shingles(t, n) for t in _texts(batch)]
        signed = [pa.array(x, pa.int64()) for x in zip(*map(signature, sets), strict=True)] if sets else [pa.array([], pa.int64())] * 3
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *signed, pa.array([bitmap(s, num, den).tobytes() for s in sets], pa.binary())], names=["doc_id", *CLASS, "bits"])


def _split(keys: np.ndarray, ids: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: the pairs (larger, smaller id) of small buckets, and which entries are in
    large ones: of more than SMALL entries, or with a key that is hot elsewhere."""
    if not len(keys):
        return np.empty((0, 2), np.int64), np.empty(0, bool)
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    start, count = edge[:-1], np.diff(edge)
    large = (count > SMALL) | np.isin(keys[start], hot)
    pairs = [np.empty((0, 2), np.int64)]
    for c in range(2, SMALL + 1):
        rows = ids[start[(count == c) & ~large][:, None] + np.arange(c)]
        i, j = np.triu_indices(c, 1)
        pairs.append(np.stack([rows[:, j].ravel(), rows[:, i].ravel()], 1))
    pairs = np.concatenate(pairs)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0), np.repeat(large, count)


_BLOB = (("bucket", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("owner", pa.binary()), ("hot", pa.binary()), ("rows", pa.binary()), ("spare", pa.binary()))


def _keys(batches, n, num, den, buckets):
    """Blobs (bucket, sorted keys, sets, by the first sum of their class, and which of them owns each
    key, hot keys) and, apart, the entries of keys that are hot in this batch and the keys that sets can do without."""
    only("jaccard")
    for batch in slices(batches, 8_000_000):
        seen, ids, keys, owner, spare = set(), [], [], [], []
        for t in _texts(batch):
            s = shingles(t, n)
            same = signature(s)
            if not len(s) or same in seen:  # a copy is of the same class
                continue
            seen.add(same)
            k, more = keys_and_spare(s, num, den)
            k = np.unique(k >> _LOW)
            keys.append(k)
            spare.append(int(more @ (256 ** np.arange(BANDS))))
            owner.append(np.full(len(k), len(ids)))
            ids.append(same[0])
        if not keys:
            continue
        ids, keys, owner = np.array(ids, np.int64), np.concatenate(keys), np.concatenate(owner)
        order = np.lexsort((ids[owner], keys))
        keys, owner = keys[order], owner[order]
        _, apart = _split(keys, ids[owner], keys[:0])
        rows, hot = [], np.unique(keys[apart])
        some = np.stack([ids, np.array(spare, np.int64)], 1)
        rows.append((int(ids[0]) % buckets, None, None, None, None, None, some.astype("<i8").tobytes()))
        for k in range(0, int(apart.sum()), 1 << 16):
            some = np.stack([keys[apart][k:k + (1 << 16)].view(np.int64), ids[owner[apart][k:k + (1 << 16)]]], 1)
            rows.append((int(some[0, 1]) % buckets, None, None, None, None, some.astype("<i8").tobytes(), None))
        keys, owner = keys[~apart], owner[~apart]
        cut = lambda x: np.searchsorted(((x >> U64(KEY_BITS - 32)) * U64(buckets) >> U64(32)).astype(np.int64), np.arange(buckets + 1))
        at, ah = cut(keys), cut(hot)
        for b in np.flatnonzero(np.diff(at) + np.diff(ah)):
            docs, number = np.unique(owner[at[b]:at[b + 1]], return_inverse=True)
            kind = "<u2" if len(docs) < 1 << 16 else "<u4"
            rows.append((int(b), pack_sorted(keys[at[b]:at[b + 1]]), ids[docs].astype("<i8").tobytes(), number.astype(kind).tobytes(), pack_sorted(hot[ah[b]:ah[b + 1]]), None, None))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_BLOB)], names=[x for x, _ in _BLOB])


def _meet(table: pa.Table) -> pa.Table:
    """Of the blobs of a bucket: candidate pairs (u, v), entries (u, key) of large buckets, and (u, spare)."""
    only()
    spare = [np.empty((0, 2), np.int64)]
    keys, ids, hot, apart = [np.empty(0, U64)], [np.empty(0, np.int64)], [np.empty(0, U64)], [np.empty((0, 2), np.int64)]
    for k, docs, owner, h, rows, more in zip(*(table.column(c).to_pylist() for c in ("keys", "docs", "owner", "hot", "rows", "spare")), strict=True):
        if more is not None:
            spare.append(np.frombuffer(more, "<i8").reshape(-1, 2))
        elif rows is None:
            docs = np.frombuffer(docs, "<i8")
            keys.append(unpack_sorted(k))
            ids.append(docs[np.frombuffer(owner, "<u2" if len(docs) < 1 << 16 else "<u4")])
            hot.append(unpack_sorted(h))
        else:
            apart.append(np.frombuffer(rows, "<i8").reshape(-1, 2))
    keys, ids = np.concatenate(keys), np.concatenate(ids)
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    pairs, large = _split(keys, ids, np.unique(np.concatenate(hot)))
    apart = np.concatenate([*apart, np.stack([keys[large].view(np.int64), ids[large]], 1)])
    spare = np.concatenate(spare)
    none = lambda *some: pa.nulls(sum(map(len, some)), pa.int64())
    column = lambda *some: pa.chunked_array([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in some]).combine_chunks()
    return pa.table({
        "u": column(pairs[:, 0], apart[:, 1], spare[:, 0]),
        "v": column(pairs[:, 1], none(apart, spare)),
        "key": column(none(pairs), apart[:, 0], none(spare)),
        "spare": column(none(pairs, apart), spare[:, 1]),
    })


def _sets(batches, n):
    """Whole sets of the texts whose class is the node's; a doc_id may have other texts too."""
    only("jaccard")
    for batch in slices(batches, 8_000_000):
        sets = [shingles(t, n) for t in _texts(batch)]
        wanted = zip(*(batch.column(c).to_pylist() for c in CLASS), strict=True)
        own = [k for k, (s, w) in enumerate(zip(sets, wanted, strict=True)) if signature(s) == w]
        some = batch.take(pa.array(own, pa.int64())).select(["tile", "node", "n", "bits"])
        yield pa.RecordBatch.from_arrays([*some.columns, pa.array([sets[k].tobytes() for k in own], pa.binary())], names=["tile", "node", "n", "bits", "hashes"])


def _few_links(ids, sizes, bits, num: int, den: int) -> list[tuple[int, int]]:
    """Spanning links of what bitmaps allow, all pairs of a small tile at once."""
    n, out = len(ids), []
    i, j = np.triu_indices(n, 1)
    close = sizes[i] * den >= sizes[j] * num
    i, j = i[close], j[close]
    both = sizes[i] + sizes[j]
    ok = (both - bits.differ(i, j)) * (num + den) >= 2 * num * both
    meets = np.zeros((n, n), bool)
    meets[i[ok], j[ok]] = meets[j[ok], i[ok]] = True
    free = meets.any(1)
    while free.any():
        frontier = np.array([np.argmax(free)])
        free[frontier] = False
        while len(frontier):
            new = np.flatnonzero(meets[frontier].any(0) & free)
            free[new] = False
            out += zip(ids[new].tolist(), ids[frontier[meets[np.ix_(frontier, new)].argmax(0)]].tolist(), strict=True)
            frontier = new
    return out


def links_of(ids, sizes, bits, sets, num: int, den: int) -> list[tuple[int, int]]:
    """Spanning links of the components of a tile; without sets, of what bitmaps allow.  All sorted by size."""
    n, out = len(ids), []
    if sets is None and n <= FEW:
        return _few_links(ids, sizes, bits, num, den)
    free = np.arange(n)
    while len(free):
        frontier, free = [free[0]], free[1:]
        while frontier and len(free):
            x = frontier.pop()
            lo = np.searchsorted(sizes[free], -(-sizes[x] * num // den), "left")
            hi = np.searchsorted(sizes[free], sizes[x] * den // num, "right")
            near = free[lo:hi]
            if not len(near):
                continue
            both = sizes[near] + sizes[x]
            need = -(-both * num // (num + den))
            differ = bits.differ(near, np.full(len(near), x))
            near = near[(both - differ) // 2 >= need]
            if sets is None:
                hit = near.tolist()
            else:
                common = [len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for y in near]
                hit = [y for y, c in zip(near, common, strict=True) if den * c >= num * (sizes[x] + sizes[y] - c)]
            out += [(int(ids[y]), int(ids[x])) for y in hit]
            if hit:
                frontier += hit
                free = free[~np.isin(free, hit)]
    return out


def _link_tile(table: pa.Table, num: int, den: int) -> pa.Table:
    ids, sizes = table.column("node").to_numpy(), table.column("n").to_numpy()
    order = np.lexsort((ids, sizes))
    bits = table.column("bits").to_pylist()
    bits = Bitmaps([bits[i] for i in order])
    sets = None
    if "hashes" in table.column_names:
        sets = [np.frombuffer(x, U64) for x in table.column("hashes").to_pylist()]
        sets = [sets[i] for i in order]
    found = links_of(ids[order], sizes[order], bits, sets, num, den)
    return pa.table({"u": pa.array([x for x, _ in found], pa.int64()), "v": pa.array([y for _, y in found], pa.int64())})


def _allowed(batches, num: int, den: int):
    """The pairs whose bitmaps allow the overlap that a link needs."""
    only()
    for batch in batches:
        n = batch.num_rows
        size = [batch.column(c).to_numpy() for c in ("nu", "nv")]
        maps = Bitmaps(batch.column("bu").to_pylist() + batch.column("bv").to_pylist())
        both = size[0] + size[1]
        differ = maps.differ(np.arange(n), np.arange(n, 2 * n)) if n else both
        yield batch.select(["u", "v"]).filter(pa.array((both - differ) * (num + den) >= 2 * num * both))


def _link_tiles(batches, num: int, den: int):
    """Batches sorted by tile, tile after tile; only the rows of one tile are held."""
    only()
    held: list[pa.RecordBatch] = []

    def done():
        table = pa.Table.from_batches(held)
        held.clear()
        return _link_tile(table, num, den).to_batches()

    for batch in batches:
        tile = batch.column("tile").to_numpy()
        edges = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if held and held[0].column("tile")[0].as_py() != tile[a]:
                yield from done()
            held.append(batch.slice(a, b - a))
    if held:
        yield from done()


def linked(tiles: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """Spanning links (u, v) of all tiles; tiles have a bounded size, so dealing them by name is even."""
    dealt = tiles.repartition(parts, "tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(lambda b: _link_tiles(b, num, den), "u long, v long")


def tiled(grouped: DataFrame, num: int, den: int) -> DataFrame:
    """(grp, node, n) with `tile`, the names of all tiles a node is in: one for a group of at
    most one block; else its size band is cut into blocks, and it meets all blocks of its own band
    and of the two next to it."""
    step = max(math.log(den / num), 0.01) * 1.001  # a little wider: sizes that can link are at most one band apart
    grouped = grouped.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / step).cast("long"))
    per_band = grouped.groupBy("grp", "band").agg(F.count("*").alias("rows"), F.sum("n").alias("total"))
    whole = per_band.groupBy("grp").agg(F.sum("rows").alias("g_rows"), F.sum("total").alias("g_total"))
    large = whole.where((F.col("g_rows") > BLOCK_ROWS) | (F.col("g_total") > BLOCK_SHINGLES)).select("grp")
    cut = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("long")
    plan = per_band.join(large, "grp").select("grp", "band", cut.alias("cut"))
    up = plan.select("grp", (F.col("band") - 1).alias("band"), F.col("cut").alias("cut_up"))
    down = plan.select("grp", (F.col("band") + 1).alias("band"), F.col("cut").alias("cut_down"))
    plan = plan.join(up, ["grp", "band"], "left").join(down, ["grp", "band"], "left").na.fill(0, ["cut_up", "cut_down"])
    plan = checkpointed(plan)  # of large groups only
    placed = grouped.join(plan, ["grp", "band"], "left").withColumn("block", F.pmod(F.xxhash64("node"), F.col("cut")))
    name = lambda band, i, band2, j: F.xxhash64("grp", band, i, band2, j)
    none = F.array().cast("array<bigint>")
    up_to = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).otherwise(none)
    within = F.transform(up_to("cut"), lambda j: name(F.col("band"), F.least(j, F.col("block")), F.col("band"), F.greatest(j, F.col("block"))))
    with_up = F.transform(up_to("cut_up"), lambda j: name(F.col("band"), F.col("block"), F.col("band") + 1, j))
    with_down = F.transform(up_to("cut_down"), lambda j: name(F.col("band") - 1, j, F.col("band"), F.col("block")))
    tiles = F.when(F.col("cut").isNull(), F.array(F.xxhash64("grp"))).otherwise(F.concat(within, with_up, with_down))
    return placed.withColumn("tile", tiles).drop("band", "block", "cut", "cut_up", "cut_down")


def rarest(met: DataFrame) -> DataFrame:
    """(f1, grp): the entries of large buckets without those of the most frequent keys that a set can do
    without, and without keys that only one set is left of.  All sets order keys alike, so the rarest
    key that two linked sets share stays with both."""
    entries = checkpointed(met.where("key is not null").select(F.col("u").alias("f1"), F.col("key").alias("grp")).distinct())
    low, high = F.min("spare"), F.max("spare")  # they differ where sums of different sets are equal
    spare = met.where("spare is not null").groupBy(F.col("u").alias("f1")).agg(F.when(low == high, low).otherwise(0).alias("spare"))
    often = entries.groupBy("grp").agg(F.count("*").alias("often"))
    of_set = Window.partitionBy("f1", F.pmod("grp", F.lit(BANDS))).orderBy(F.desc("often"), "grp")
    ranked = entries.join(often, "grp").withColumn("at", F.row_number().over(of_set)).join(spare, "f1")
    kept = ranked.where(F.expr(f"at > (shiftright(spare, 8 * cast(pmod(grp, {BANDS}) as int)) & 255)")).select("f1", "grp")
    kept = checkpointed(kept)
    return kept.join(kept.groupBy("grp").agg(F.count("*").alias("rows")).where("rows > 1").select("grp"), "grp", "left_semi")


def jaccard_components(docs: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): linked are sets of n-word shingles whose Jaccard
    similarity is at least the threshold (a fraction with a small denominator)."""
    t = Fraction(threshold).limit_denominator(1000)
    num, den = t.numerator, t.denominator
    spark = docs.sparkSession
    buckets = n_partitions(spark)
    texts = id_and_text(docs, id_col, text_col)
    known = texts.where("doc_id is not null")

    sized = checkpointed(texts.mapInArrow(lambda b: _classes(b, n, num, den), "doc_id long, f1 long, f2 long, n long, bits binary"))
    classes = sized.where("doc_id is not null and n > 0").groupBy(*CLASS).agg(F.min("doc_id").alias("head"), F.count("*").alias("rows"), F.first("bits").alias("bits"))
    nodes = checkpointed(classes.withColumn("node", F.monotonically_increasing_id()))

    blobs = known.mapInArrow(lambda b: _keys(b, n, num, den, buckets), "bucket int, keys binary, docs binary, owner binary, hot binary, rows binary, spare binary")
    met = checkpointed(blobs.groupBy("bucket").applyInArrow(_meet, "u long, v long, key long, spare long"))

    # small buckets: pairs that the bitmaps' bound allows
    end = lambda c: nodes.select(F.col("f1").alias(c), F.col("node").alias(f"node_{c}"), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"b{c}"))
    pairs = met.where("v is not null").select("u", "v").distinct().join(end("u"), "u").join(end("v"), "v")
    pairs = pairs.drop("u", "v").withColumnsRenamed({"node_u": "u", "node_v": "v"})
    may_link = pairs.mapInArrow(lambda b: _allowed(b, num, den), "u long, v long")
    # large buckets: tiles of bitmaps
    shared = tiled(rarest(met).join(nodes.select("f1", "node", "n"), "f1").drop("f1"), num, den)
    shared = shared.select(F.explode("tile").alias("tile"), "node").join(nodes.select("node", "n", "bits"), "node")
    in_tiles = linked(shared, num, den, buckets)
    grouped = connected_components(may_link.unionByName(in_tiles))

    # groups: tiles of bitmaps and whole sets; a text that is there more than once is read once
    grouped = checkpointed(grouped.withColumnRenamed("component", "grp").join(nodes.select("node", "head", *CLASS), "node"))
    once = only_listed(known, grouped.select(F.col("head").alias("doc_id"))).distinct()
    once = once.join(tiled(grouped, num, den).withColumnRenamed("head", "doc_id").join(nodes.select("node", "bits"), "node"), "doc_id")
    sets = once.mapInArrow(lambda b: _sets(b, n), "tile array<long>, node long, n long, bits binary, hashes binary")
    links = linked(sets.withColumn("tile", F.explode("tile")), num, den, buckets)
    found = connected_components(links)

    # the smallest doc_id of each component, then of each class that is linked or has several rows
    members = found.join(nodes.select("node", "head"), "node")
    least = checkpointed(members.groupBy("component").agg(F.min("head").alias("least")))
    named = members.select("node", "component").join(least, "component")
    answer = nodes.drop("bits").join(named, "node", "left").where("rows > 1 or least is not null")
    answer = checkpointed(answer.select(*CLASS, F.coalesce("least", "head").alias("answer")))
    own = sized.drop("bits")
    out = own.where("doc_id is not null and n > 0").join(answer, CLASS, "left")
    alone = own.where("doc_id is null or n = 0").withColumn("answer", F.lit(None).cast("long"))
    return out.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("answer", "doc_id").alias("component_id"))
