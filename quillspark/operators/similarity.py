"""Batch similarity: term weights, vectors, clusters, neighbours, priors and consistency.

Counts, weights, neighbours, priors and scores are relational.  Two steps work on a batch as a whole,
as their definition asks: the decomposition (over a bounded vocabulary) and the density clustering
(one task up to CLUSTER_LIMIT documents; beyond that pairs of blocks over the cluster).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import CLINICAL_WEIGHTS, MASK_FIELDS, MISSING
from .spread import by_key

TOKEN = r"[a-zа-я]{2,}(?:-[a-zа-я]{2,})*"
#: Own choice: words that say nothing about a batch, and words that always stay.
STOPWORDS = frozenset("и в во на с со к ко по о об от до за из у для при как что это или а но the of and to in is was for on with as at by an be".split())
PROTECTED = frozenset("не нет без отсутствует отсутствуют острый острая хронический хроническая not no without".split())
CLUSTER_LIMIT = 5_000
#: Terms up to which all of the decomposition is found at once.
SMALL_GRAM = 512


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def document_frequency(texts: DataFrame, pattern: str = TOKEN) -> DataFrame:
    """(term, df, share): texts (doc_id, text) that hold a term, and their share."""
    n = texts.agg(F.count("*").alias("n"))
    counted = texts.select(F.explode(F.array_distinct(tokens(F.col("text"), pattern))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return counted.join(F.broadcast(n)).select("term", "df", F.round(F.col("df") / F.col("n"), 6).alias("share"))


def stopwords(frequency: DataFrame, share: float = 0.95, static=STOPWORDS, protected=PROTECTED) -> DataFrame:
    """(term): the fixed list and all terms that nearly every text has, without the protected ones."""
    fixed = frequency.sparkSession.createDataFrame([(w,) for w in sorted(static)], "term string")
    keep = frequency.sparkSession.createDataFrame([(w,) for w in sorted(protected)], "term string")
    return frequency.where(F.col("share") >= share).select("term").union(fixed).exceptAll(keep).distinct()


def term_counts(texts: DataFrame, stop: DataFrame | None = None, ngrams: int = 2, pattern: str = r"(?U)\b\w\w+\b") -> DataFrame:
    """(doc_id, term, tf) of words and, after stop words went, of runs of up to `ngrams` words.  Texts are dealt
    by document before they are taken apart, so their words are not moved; the stop words are read at once."""
    words = tokens(F.col("text"), pattern)
    if stop is not None:
        gone = [r.term for r in stop.collect()]
        words = F.filter(words, lambda w: ~w.isin(gone)) if gone else words
    rows = by_key(texts.select("doc_id", "text"), "doc_id", each=1 << 20).select("doc_id", words.alias("words"))
    some = F.col("words")

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(some) - (n - 1))
        return F.when(F.size(some) >= n, F.transform(starts, lambda k: F.concat_ws(" ", F.slice(some, k, n)))).otherwise(F.array().cast("array<string>"))

    return rows.select("doc_id", F.explode(F.concat(some, *map(runs, range(2, ngrams + 1)))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, n_docs: DataFrame, min_df: int = 2, max_share: float = 0.90, max_features: int | None = None) -> DataFrame:
    """(term, idf): smooth inverse document frequencies.  Terms in fewer than min_df texts, or in more than
    max_share of them, go; of the rest the most frequent stay."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).join(F.broadcast(n_docs))
    df = df.where((F.col("df") >= min_df) & (F.col("df") <= max_share * F.col("n")))
    if max_features:
        df = df.orderBy(F.desc("total"), "term").limit(max_features)
    return df.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weighted(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(doc_id, term, w): sublinear term frequency times idf, unit length."""
    w = counts.join(idf, "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return w.select("doc_id", "term", (F.col("w") / norm).alias("w"))


def tfidf(counts: DataFrame, n_docs: DataFrame, min_df: int = 2, max_share: float = 0.90, max_features: int | None = None) -> DataFrame:
    """(doc_id, term, w) of counts (doc_id, term, tf); n_docs: one row (n)."""
    idf = vocabulary(counts, n_docs, min_df, max_share, max_features)
    return weighted(counts, idf if max_features else idf.hint("shuffle_hash"))  # a hash of a part of the terms: counts need no sort


def cluster_top_terms(weights: DataFrame, clusters: DataFrame, top: int = 20) -> DataFrame:
    """(cluster, rank, term, mean_w): by mean weight over a cluster's documents; noise (-1) has none."""
    known = clusters.where("cluster >= 0")
    size = known.groupBy("cluster").agg(F.count("*").alias("size"))
    mean = weights.join(known, "doc_id").groupBy("cluster", "term").agg(F.sum("w").alias("s")).join(F.broadcast(size), "cluster")
    mean = mean.select("cluster", "term", F.round(F.col("s") / F.col("size"), 6).alias("mean_w")).where("mean_w > 0")
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("mean_w"), "term"))
    return mean.withColumn("rank", rank).where(F.col("rank") <= top).select("cluster", "rank", "term", "mean_w")


#: Documents of a slice of the sparse matrix.
SLICE = 128


def _sums(sizes: np.ndarray, k: np.ndarray, w: np.ndarray, q: np.ndarray, out: np.ndarray) -> None:
    """Add A' (A q) of a slice of sparse rows of A: so many places k and weights w a row."""
    w = w[:, None]
    along = np.add.reduceat(w * q[k], np.cumsum(sizes) - sizes, axis=0)
    order = np.argsort(k, kind="stable")
    terms, first = np.unique(k[order], return_index=True)
    out[terms] += np.add.reduceat((w * np.repeat(along, sizes, axis=0))[order], first, axis=0)


def _leading(times, m: int, most: int) -> np.ndarray:
    """The `most` leading eigenvectors of the m x m matrix behind `times`, by block Lanczos steps with
    full orthogonalisation until they are exact to a billionth of the largest value; at once for a few terms."""
    q = np.eye(m) if m <= SMALL_GRAM else np.linalg.qr(np.random.default_rng(42).normal(size=(m, 2 * most)))[0]
    basis, image = np.empty((m, 0)), np.empty((m, 0))
    while True:
        y = times(q)
        basis, image = np.concatenate([basis, q], 1), np.concatenate([image, y], 1)
        small = basis.T @ image
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1][:most], turns[:, ::-1][:, :most]
        found = basis @ turns
        off = np.linalg.norm(image @ turns - found * values, axis=0).max(initial=0.0)
        room = min(2 * most, m - basis.shape[1])
        if off <= 1e-9 * values.max(initial=0.0) or room <= 0:
            return found
        for _ in range(2):
            y = y - basis @ (basis.T @ y)
        q = np.linalg.qr(y)[0][:, :room]
        q = np.linalg.qr(q - basis @ (basis.T @ q))[0]


def svd_vectors(weights: DataFrame, most: int = 30, ids: DataFrame | None = None, terms: list[str] | None = None) -> DataFrame:
    """(doc_id, vector): truncated decomposition of the documents by terms, unit length.

    The vocabulary is bounded by tfidf's max_features.  The Gram matrix of the terms is never made: its
    products with a few columns are summed over the cluster, and only those are worked on by the driver.
    With ids (doc_id) each of them has a vector, of zeros where it has no term.  terms: all terms of the
    weights, if they are known.
    """
    if terms is None:
        terms = [r.term for r in weights.select("term").distinct().limit(10_001).collect()]
    if len(terms) > 10_000:
        raise ValueError("more terms than a decomposition takes; limit them with max_features")
    m = len(terms)
    spark = weights.sparkSession
    index = spark.createDataFrame(pd.DataFrame({"term": sorted(terms, key=lambda t: t.encode()), "k": np.arange(m, dtype=np.int32)}), "term string, k int")
    docs = weights.join(F.broadcast(index), "term").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("k", "w"))).alias("x"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sliced(batches):
        for pdf in batches:
            for at in range(0, len(pdf), SLICE):
                some = pdf.iloc[at:at + SLICE]
                sizes = np.array([len(k) for k in some["k"]], np.int32)
                k, w = np.concatenate(list(some["k"])).astype(np.int32), np.concatenate(list(some["w"])).astype(float)
                yield pd.DataFrame({"ids": [list(some["doc_id"])], "sizes": [sizes.tobytes()], "k": [k.tobytes()], "w": [w.tobytes()]})

    rows = docs.select("doc_id", F.transform("x", lambda x: x.k).alias("k"), F.transform("x", lambda x: x.w).alias("w")).mapInPandas(sliced, f"ids array<{kind}>, sizes binary, k binary, w binary").cache()
    read = lambda sizes, k, w: (np.frombuffer(sizes, np.int32), np.frombuffer(k, np.int32), np.frombuffer(w))

    def times(q: np.ndarray) -> np.ndarray:
        def products(batches):
            total = np.zeros_like(q)
            for pdf in batches:
                for one in zip(pdf["sizes"], pdf["k"], pdf["w"], strict=True):
                    _sums(*read(*one), q, total)
            for at in range(0, m, 512):
                yield pd.DataFrame({"at": [at], "x": [total[at:at + 512].tobytes()]})

        def added(pdf):
            return pd.DataFrame({"at": pdf["at"].iloc[:1], "x": [sum(np.frombuffer(x) for x in pdf["x"]).tobytes()]})

        few = rows.select("sizes", "k", "w").coalesce(2 * spark.sparkContext.defaultParallelism)  # each task sends a sum of all terms
        parts = few.mapInPandas(products, "at int, x binary").groupBy("at").applyInPandas(added, "at int, x binary").collect()
        return np.concatenate([np.frombuffer(r.x) for r in sorted(parts, key=lambda r: r["at"])]).reshape(q.shape)

    n = (ids.distinct() if ids is not None else rows.select(F.explode("ids"))).count()
    k = max(2, min(most, n - 1, m - 1))
    basis = _leading(times, m, k) if m else np.empty((0, k))
    basis = basis * np.where(basis[np.abs(basis).argmax(0), range(basis.shape[1])] < 0, -1, 1) if m else basis

    def project(batches):
        for pdf in batches:
            for i, *one in zip(pdf["ids"], pdf["sizes"], pdf["k"], pdf["w"], strict=True):
                sizes, k, w = read(*one)
                v = np.add.reduceat(w[:, None] * basis[k], np.cumsum(sizes) - sizes, axis=0)
                length = np.linalg.norm(v, axis=1, keepdims=True)
                yield pd.DataFrame({"doc_id": list(i), "vector": list(v / np.where(length > 0, length, 1.0))})

    out = rows.mapInPandas(project, f"doc_id {kind}, vector array<double>")
    if ids is None:
        return out
    every, own = ids.select("doc_id").distinct(), rows.select(F.explode("ids").alias("own"))
    rest = every.join(own, every["doc_id"].eqNullSafe(own["own"]), "left_anti")
    return out.unionByName(rest.withColumn("vector", F.array_repeat(F.lit(0.0), basis.shape[1])))


def density_clusters(x: np.ndarray, min_size: int = 5, min_samples: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Hierarchical density clustering: labels (-1 is noise) and membership.

    Mutual-reachability distances, their minimum spanning tree, the tree condensed by min_size, and
    the most stable of its clusters, never the root.  Equal distances keep the order of points.
    """
    n = len(x)
    if n < 2 * min_size:
        return np.full(n, -1), np.zeros(n)
    d = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T))
    core = np.sort(d, 1)[:, min(min_samples, n - 1)]
    d = np.maximum(d, np.maximum(core[:, None], core))
    edges, best, near = [], np.full(n, np.inf), np.zeros(n, int)
    todo, at = np.ones(n, bool), 0
    for _ in range(n - 1):
        todo[at] = False
        closer = todo & (d[at] < best)
        best[closer], near[closer] = d[at][closer], at
        at = int(np.argmin(np.where(todo, best, np.inf)))
        edges.append((float(best[at]), int(near[at]), at))
    edges.sort(key=lambda e: e[0])
    return _condensed(edges, [1] * n, core, min_size)


def _condensed(edges, copies: list[int], core: np.ndarray, min_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels and membership from a minimum spanning tree by rising distance, over points that stand for
    so many copies each; the copies of a point meet at its core distance."""
    n = len(copies)
    labels, member = np.full(n, -1), np.zeros(n)
    parent, size = list(range(2 * n)), [*copies, *[0] * n]
    density = lambda w: 1 / w if w > 0 else 1e12
    kids: dict[int, tuple[int, int, float]] = {}

    def top(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k, (w, a, b) in enumerate(edges, n):
        a, b = top(a), top(b)
        kids[k], parent[a], parent[b], size[k] = (a, b, w), k, k, size[a] + size[b]

    def leaves(k):
        out, stack = [], [k]
        while stack:
            y = stack.pop()
            if y < n:
                out.append(y)
            else:
                stack += kids[y][:2]
        return out

    # condensed tree: clusters are born at a density and lose points as it grows
    born, stability, falls, splits = {0: 0.0}, {0: 0.0}, {0: {}}, {0: []}
    stack = [(2 * n - 2, 0)]
    while stack:
        node, c = stack.pop()
        if node < n:
            lam = density(float(core[node]))
            falls[c][node] = lam
            stability[c] += (lam - born[c]) * size[node]
            continue
        a, b, w = kids[node]
        lam = density(w)
        big = [size[a] >= min_size, size[b] >= min_size]
        if all(big):
            stability[c] += (lam - born[c]) * size[node]
            for y in (a, b):
                new = len(born)
                born[new], stability[new], falls[new], splits[new] = lam, 0.0, {}, []
                splits[c].append(new)
                stack.append((y, new))
        else:
            for y, keeps in ((a, big[0]), (b, big[1])):
                if keeps:
                    stack.append((y, c))
                else:
                    for p in leaves(y):
                        falls[c][p] = lam
                        stability[c] += (lam - born[c]) * size[p]
    chosen, total = set(), {}
    for c in sorted(born, reverse=True):
        below = sum(total[k] for k in splits[c])
        if c and (not splits[c] or stability[c] >= below):
            chosen.add(c)
            total[c] = stability[c]
        else:
            total[c] = below
    wanted, todo_c, number = [], [0], 0
    while todo_c:
        c = todo_c.pop(0)
        if c in chosen:
            wanted.append(c)
        else:
            todo_c += splits[c]
    groups = []
    for c in wanted:
        points, stack_c = dict(falls[c]), list(splits[c])
        while stack_c:
            k = stack_c.pop()
            points |= falls[k]
            stack_c += splits[k]
        groups.append(points)
    for points in sorted(groups, key=lambda p: min(p)):
        most = max(points.values())
        for p, lam in points.items():
            labels[p], member[p] = number, min(1.0, lam / most)
        number += 1
    return labels, member


def _spanning(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, weight): a minimum spanning tree of mutual-reachability distances, a row of them at a time."""
    n, dims = x.shape
    cols, far, ids = np.ascontiguousarray(x.T[:, 1:]), core[1:].copy(), np.arange(1, n)
    best, near = np.full(n - 1, np.inf), np.zeros(n - 1, int)
    at, point, reach = 0, x[0], core[0]
    a, b, w = np.empty(n - 1, int), np.empty(n - 1, int), np.empty(n - 1)
    for step in range(n - 1):
        left = n - 1 - step
        d = np.zeros(left)
        for k in range(dims):
            t = cols[k, :left] - point[k]
            d += t * t
        d = np.maximum(np.maximum(np.sqrt(d), far[:left]), reach)
        closer = d < best[:left]
        best[:left][closer], near[:left][closer] = d[closer], at
        p, last = int(np.argmin(best[:left])), left - 1
        a[step], b[step], w[step] = near[p], ids[p], best[p]
        at, point, reach = int(ids[p]), cols[:, p].copy(), far[p]
        for column in (far, ids, best, near):
            column[p] = column[last]
        cols[:, p] = cols[:, last]
    return a, b, w


def _cores(x: np.ndarray, copies: np.ndarray, rows: np.ndarray, min_samples: int, width: int = 4096) -> np.ndarray:
    """The distance of each of the rows to its min_samples-th neighbour, copies counted, over slices of all points."""
    out = []
    for at in range(0, len(rows), 256):
        some = x[rows[at:at + 256]]
        dist, many = np.full((len(some), 0), np.inf), np.zeros((len(some), 0), np.int64)
        for lo in range(0, len(x), width):
            d = np.zeros((len(some), min(width, len(x) - lo)))
            for k in range(x.shape[1]):
                t = some[:, k, None] - x[lo:lo + width, k]
                d += t * t
            dist = np.concatenate([dist, d], 1)
            many = np.concatenate([many, np.broadcast_to(copies[lo:lo + width], d.shape)], 1)
            if dist.shape[1] > min_samples + 1:
                keep = np.argpartition(dist, min_samples, axis=1)[:, :min_samples + 1]
                dist, many = np.take_along_axis(dist, keep, 1), np.take_along_axis(many, keep, 1)
        order = np.argsort(dist, axis=1, kind="stable")
        enough = np.cumsum(np.take_along_axis(many, order, 1), 1) > min_samples
        out.append(np.sqrt(np.take_along_axis(np.take_along_axis(dist, order, 1), enough.argmax(1)[:, None], 1)[:, 0]))
    return np.concatenate(out) if out else np.empty(0)


def _forest(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges of a minimum spanning forest, by rising weight."""
    order = np.lexsort((b, a, w))
    parent, keep = list(range(n)), []
    for k, i, j in zip(order.tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        while parent[j] != j:
            parent[j] = parent[parent[j]]
            j = parent[j]
        if i != j:
            parent[i] = j
            keep.append(k)
    return a[keep], b[keep], w[keep]


def _clustered_by_blocks(vectors: DataFrame, min_size: int, min_samples: int, block: int) -> DataFrame:
    """The same clusters for batches of any size.  Equal vectors are one point; core distances are found by
    blocks of points, and the spanning tree is that of the trees of all pairs of blocks, which hold every
    pair of points.  A worker holds the points (a vector each) and one pair of blocks; the work is quadratic."""
    spark = vectors.sparkSession
    some = vectors.select("doc_id", F.col("vector").cast("array<double>").alias("vector"))
    points = some.groupBy("vector").agg(F.min("doc_id").alias("lead"), F.count("*").alias("copies")).orderBy("lead").toArrow()
    x, copies = np.array(points.column("vector").to_pylist(), float), points.column("copies").to_numpy()
    m = len(x)
    blocks = np.array_split(np.arange(m), -(-m // block))
    pairs = [(i, j) for i in range(len(blocks)) for j in range(i + 1, len(blocks))] or [(0, 0)]
    held = spark.sparkContext.broadcast((x, copies))
    tasks = lambda n: spark.range(0, n, 1, max(1, min(n, 2_000)))

    def cores(batches):
        for pdf in batches:
            for k in pdf["id"]:
                yield pd.DataFrame({"at": [k], "core": [_cores(*held.value, blocks[k], min_samples).tobytes()]})

    found = tasks(len(blocks)).mapInPandas(cores, "at long, core binary").collect()
    core = np.concatenate([np.frombuffer(r["core"]) for r in sorted(found, key=lambda r: r["at"])])
    reach = spark.sparkContext.broadcast(core)

    def trees(batches):
        for pdf in batches:
            for k in pdf["id"]:
                own = np.concatenate([blocks[b] for b in sorted(set(pairs[k]))])
                a, b, w = _spanning(held.value[0][own], reach.value[own])
                yield pd.DataFrame({"edges": [np.stack([own[a], own[b], w]).tobytes()]})

    def labelled(batches):
        tree, waiting = np.empty((3, 0)), []

        def fold():
            a, b, w = np.concatenate([tree, *waiting], 1)
            return np.stack(_forest(a.astype(int), b.astype(int), w, m))

        for pdf in batches:
            for blob in pdf["edges"]:
                waiting.append(np.frombuffer(blob).reshape(3, -1))
                if sum(e.shape[1] for e in waiting) > max(m, 500_000):
                    tree, waiting = fold(), []
        tree = fold()
        edges = zip(tree[2].tolist(), tree[0].astype(int).tolist(), tree[1].astype(int).tolist(), strict=True)
        labels, member = _condensed(edges, held.value[1].tolist(), reach.value, min_size)
        for at in range(0, m, 10_000):
            yield pd.DataFrame({"vector": list(held.value[0][at:at + 10_000]), "cluster": labels[at:at + 10_000], "probability": member[at:at + 10_000]})

    out = tasks(len(pairs)).mapInPandas(trees, "edges binary").repartition(1).mapInPandas(labelled, "vector array<double>, cluster int, probability double")
    return some.join(out, "vector").select("doc_id", "cluster", "probability")


def clustered(vectors: DataFrame, min_size: int = 5, min_samples: int = 2, limit: int = CLUSTER_LIMIT, block: int = 4_000) -> DataFrame:
    """(doc_id, cluster, probability) of a batch: in one task up to the limit, else by pairs of blocks."""
    n = vectors.count()
    size = min(max(2, min_size), max(2, n - 1))
    if n > limit:
        return _clustered_by_blocks(vectors, size, min_samples, block)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        labels, member = density_clusters(np.array(pdf["vector"].tolist()), size, min_samples)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "cluster": labels, "probability": member})

    kind = vectors.schema["doc_id"].dataType.simpleString()
    return vectors.withColumn("batch", F.lit(0)).groupBy("batch").applyInPandas(run, f"doc_id {kind}, cluster int, probability double")


def presence_masks(decisions: DataFrame, fields=MASK_FIELDS) -> DataFrame:
    """(doc_id, mask, present): one bit a field that has a value, in field order."""
    place = F.lit(0).cast("long")
    for k, f in enumerate(fields):
        place = F.when(F.col("field") == f, F.lit(1 << k).cast("long")).otherwise(place)
    have = F.col("value") != MISSING
    return decisions.groupBy("doc_id").agg(F.bit_or(F.when(have, place).otherwise(F.lit(0).cast("long"))).alias("mask"), F.count_if(have & F.col("field").isin(*fields)).alias("present"))


def mask_distance(a: Column, b: Column) -> Column:
    """Fields that only one of two masks has, of those that either has."""
    either = F.bit_count(a.bitwiseOR(b))
    return F.when(either == 0, 0.0).otherwise(F.bit_count(a.bitwiseXOR(b)) / either)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def semantic_distance(a: Column, b: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 - F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b)))) / 2))


def combined_distance(semantic: Column, mask: Column, semantic_weight: float = 0.65, mask_weight: float = 0.35) -> Column:
    whole = max(1e-9, semantic_weight + mask_weight)
    return semantic * (semantic_weight / whole) + mask * (mask_weight / whole)


def unit(vector: Column) -> Column:
    norm = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: F.when(norm == 0, 0.0).otherwise(x.cast("double") / norm))


def centroid_medoids(vectors: DataFrame) -> DataFrame:
    """(cluster, doc_id, mean_distance): the member with the least mean semantic distance to the others.

    Over unit vectors the distances of a member sum to a dot product with the sum of the cluster, so
    no pairs are made: one pass adds up a vector a cluster, one pass compares each member with it,
    and the least of a cluster is a partial aggregate.
    """
    dims = vectors.select("cluster", F.posexplode("vector").alias("k", "x"))
    sums = dims.groupBy("cluster", "k").agg(F.sum("x").alias("sx"), F.count("*").alias("size"))
    whole = sums.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("k", "sx"))).alias("parts"), F.max("size").alias("size"))
    whole = whole.select("cluster", F.transform("parts", lambda x: x.sx).alias("whole"), "size")
    both = vectors.join(whole, "cluster")
    own = dot(F.col("vector"), F.col("vector"))
    mean = F.round((F.col("size") - 1 - (dot(F.col("vector"), F.col("whole")) - own)) / 2 / F.greatest(F.lit(1), F.col("size") - 1), 6)
    best = both.select("cluster", F.struct(mean.alias("mean_distance"), "doc_id").alias("x")).groupBy("cluster").agg(F.min("x").alias("x"))
    return best.select("cluster", "x.doc_id", "x.mean_distance")


def confident(decisions: DataFrame, least: float = 0.90) -> DataFrame:
    """(doc_id, field, value): values that may speak for a document."""
    return decisions.where((F.col("value") != MISSING) & (F.col("score") >= least) & F.col("format_ok") & F.col("evidence_ok")).select("doc_id", "field", "value")


def _keys(weights: dict[str, float], least_matched: float) -> list[str]:
    """Fields of which a pair must share one to match by that much: the lightest ones go, as long as
    all of them together stay below it."""
    light, spare = set(), least_matched
    for f, w in sorted(weights.items(), key=lambda x: x[1]):
        spare -= w
        if spare <= 1e-6:
            break
        light.add(f)
    return [f for f in weights if f not in light]


def clinical_neighbours(values: DataFrame, weights=None, least_weight: float = 3.0, least: float = 0.72, top: int = 12) -> DataFrame:
    """(doc_id, rank, neighbour, similarity, shared_weight): by weighted agreement of shared fields;
    ties go to the smaller doc_id.  Of several values of a field the largest counts.

    Likeness depends on the values alone, so distinct records are paired, not documents: of the
    documents of a record no list needs more than the first top + 1.  Records meet on an equal value
    of a heavy field; the light ones cannot reach the least agreement by themselves.
    """
    weights = {f: float(w) for f, w in (weights or CLINICAL_WEIGHTS).items()}
    names = list(weights)
    keys = [names.index(f) for f in _keys(weights, least * least_weight)]
    docs = values.where(F.col("field").isin(*names)).groupBy("doc_id").agg(F.array(*[F.max(F.when(F.col("field") == f, F.col("value"))) for f in names]).alias("record"))
    first = F.row_number().over(Window.partitionBy("record").orderBy("doc_id"))
    records = docs.withColumn("place", first).where(F.col("place") <= top + 1).groupBy("record").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))

    met = records.select("record", "ids", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("record")[k].alias("value")) for k in keys])).alias("key")).where("key.value IS NOT NULL")
    a = met.select("key.k", "key.value", F.col("record").alias("x"), F.col("ids")[0].alias("i"))
    b = met.select("key.k", "key.value", F.col("record").alias("y"), "ids", F.col("ids")[0].alias("j"))
    x, y = F.col("x"), F.col("y")
    total = lambda hit: F.round(sum((F.when(hit(k), weights[f]).otherwise(0.0) for k, f in enumerate(names)), F.lit(0.0)), 6)
    matched, shared = total(lambda k: x[k] == y[k]), total(lambda k: x[k].isNotNull() & y[k].isNotNull())
    once = F.coalesce(*[F.when(x[k] == y[k], F.lit(k)) for k in keys]) == F.col("k")
    pairs = a.join(b, ["k", "value"]).where(once).select("x", "ids", shared.alias("shared_weight"), matched.alias("matched"))
    pairs = pairs.withColumn("similarity", F.round(F.col("matched") / F.col("shared_weight"), 6)).where((F.col("shared_weight") >= least_weight) & (F.col("similarity") >= least))

    rank = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("similarity"), "neighbour"))
    near = pairs.select("x", F.explode("ids").alias("neighbour"), "similarity", "shared_weight").withColumn("rank", rank).where(F.col("rank") <= top + 1)
    lists = near.groupBy(F.col("x").alias("record")).agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour", "similarity", "shared_weight"))).alias("near"))
    others = F.slice(F.filter("near", lambda n: n.neighbour != F.col("doc_id")), 1, top)
    rows = docs.join(lists, "record").select("doc_id", F.posexplode(others).alias("at", "n"))
    return rows.select("doc_id", (F.col("at") + 1).alias("rank"), "n.neighbour", "n.similarity", "n.shared_weight")


def peer_priors(values: DataFrame, clusters: DataFrame, neighbours: DataFrame, cluster_weight: float = 0.55, neighbour_weight: float = 0.45) -> DataFrame:
    """(doc_id, field, value, support): what a document's peers have, itself left out.

    The share of a value in the cluster without the document follows from the cluster's counts, so
    no cluster is joined with itself.
    """
    v = values.join(clusters.where("cluster >= 0").select("doc_id", "cluster"), "doc_id")
    by_value = v.groupBy("cluster", "field", "value").agg(F.count("*").alias("n"))
    by_field = by_value.groupBy("cluster", "field").agg(F.sum("n").alias("total"))
    own = v.select("doc_id", "cluster", "field", F.col("value").alias("own"))
    members = clusters.where("cluster >= 0").select("doc_id", "cluster")
    spread = members.join(by_value, "cluster").join(by_field, ["cluster", "field"]).join(own, ["doc_id", "cluster", "field"], "left")
    mine = F.col("own").isNotNull().cast("int")
    same = F.col("own").eqNullSafe(F.col("value")).cast("int")
    from_cluster = spread.where((F.col("total") > mine) & (F.col("n") > same)).select("doc_id", "field", "value", ((F.col("n") - same) / (F.col("total") - mine)).alias("pc"))
    near = neighbours.select("doc_id", "neighbour", "similarity").join(values.withColumnRenamed("doc_id", "neighbour"), "neighbour")
    weight = near.groupBy("doc_id", "field", "value").agg(F.sum("similarity").alias("s"))
    whole = F.sum("s").over(Window.partitionBy("doc_id", "field"))
    from_near = weight.withColumn("pn", F.col("s") / whole).select("doc_id", "field", "value", "pn")
    both = from_cluster.join(from_near, ["doc_id", "field", "value"], "full")
    per = Window.partitionBy("doc_id", "field")
    parts = F.when(F.max("pc").over(per).isNotNull(), cluster_weight).otherwise(0.0) + F.when(F.max("pn").over(per).isNotNull(), neighbour_weight).otherwise(0.0)
    support = (F.coalesce("pc", F.lit(0.0)) * cluster_weight + F.coalesce("pn", F.lit(0.0)) * neighbour_weight) / parts
    return both.select("doc_id", "field", "value", F.round(support, 6).alias("support"))


def presence_consistency(decisions: DataFrame, peers: DataFrame, fields=MASK_FIELDS) -> DataFrame:
    """(doc_id, peers, consistency): how far a document has the fields that its peers have.

    peers: (doc_id, peer).  Documents with fewer than two peers have no row.
    """
    have = decisions.where(F.col("field").isin(*fields)).select("doc_id", "field", (F.col("value") != MISSING).cast("double").alias("has"))
    n = peers.groupBy("doc_id").agg(F.count("*").alias("peers")).where("peers >= 2")
    of_peers = peers.join(n, "doc_id").join(have.toDF("peer", "field", "peer_has"), "peer").groupBy("doc_id", "field", "peers").agg(F.sum("peer_has").alias("s"))
    share = F.col("s") / F.col("peers")
    rows = of_peers.join(have, ["doc_id", "field"]).withColumn("p", F.when(F.col("has") > 0, share).otherwise(1 - share))
    return rows.groupBy("doc_id", "peers").agg(F.round(F.avg("p"), 4).alias("consistency"))


def cluster_consistency(decisions: DataFrame, clusters: DataFrame, fields=MASK_FIELDS) -> DataFrame:
    """The same with all other members of a document's cluster as peers, from the cluster's sums."""
    have = decisions.where(F.col("field").isin(*fields)).select("doc_id", "field", (F.col("value") != MISSING).cast("double").alias("has")).join(clusters.where("cluster >= 0").select("doc_id", "cluster"), "doc_id")
    per = have.groupBy("cluster", "field").agg(F.sum("has").alias("s"), F.count("*").alias("n"))
    share = (F.col("s") - F.col("has")) / (F.col("n") - 1)
    rows = have.join(per, ["cluster", "field"]).where("n >= 3").withColumn("p", F.when(F.col("has") > 0, share).otherwise(1 - share))
    return rows.groupBy("doc_id", (F.col("n") - 1).alias("peers")).agg(F.round(F.avg("p"), 4).alias("consistency"))


def adjusted_score(base: Column, cluster: Column, probability: Column, clinical: Column, weight: float = 0.025, reference: float = 0.85, low: float = -0.05, high: float = 0.0) -> Column:
    """A file's score moved by how consistent it is with its peers, within bounds."""

    def centred(x: Column) -> Column:
        up = F.least(F.lit(1.0), (x - reference) / (1 - reference))
        return F.when(x.isNull(), 0.0).when(x >= reference, up).otherwise(F.greatest(F.lit(-1.0), (x - reference) / reference))

    move = F.coalesce(weight * centred(cluster) * F.coalesce(probability, F.lit(0.0)), F.lit(0.0)) + F.coalesce(weight * centred(clinical), F.lit(0.0))
    move = F.least(F.lit(high), F.greatest(F.lit(low), move))
    moved = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), base + move)), 4)
    return F.when(cluster.isNull() & clinical.isNull(), base).otherwise(moved)


def select_probes(ids: list, vectors: np.ndarray, masks: list[int], labels: list[int], probability: list[float], budget: int = 5, semantic_weight: float = 0.65, mask_weight: float = 0.35, noise_template: float = 0.75, noise_distance: float = 0.90, template_shift: bool = True) -> list[tuple]:
    """(doc_id, role): medoids of the largest clusters, the document whose extraction differs most
    from its cluster, then the farthest from all chosen.  Works on a gathered batch."""
    n = len(ids)
    budget = min(n, max(0, budget))
    if not budget:
        return []
    bits = np.array([[m >> k & 1 for k in range(len(MASK_FIELDS))] for m in masks], bool)
    either = (bits[:, None] | bits).sum(2)
    by_mask = np.where(either > 0, (bits[:, None] ^ bits).sum(2) / np.maximum(either, 1), 0.0)
    whole = max(1e-9, semantic_weight + mask_weight)
    dist = semantic_weight / whole * np.clip((1 - np.clip(vectors @ vectors.T, -1, 1)) / 2, 0, 1) + mask_weight / whole * by_mask
    present, label = bits.sum(1), np.array(labels)
    clusters = sorted({c for c in labels if c >= 0}, key=lambda c: (-(label == c).sum(), c))
    chosen: list[tuple[int, str]] = []
    for c in clusters[: max(1, budget - min(2, budget - 1))]:
        own = np.flatnonzero(label == c)
        chosen.append((int(own[np.argmin(dist[np.ix_(own, own)].sum(1))]), "medoid"))
    taken = lambda: [k for k, _ in chosen]
    if template_shift and len(chosen) < budget:
        best = (-1.0, -1)
        for i in range(n):
            if i in taken():
                continue
            if label[i] >= 0:
                own = np.flatnonzero(label == label[i])
                usual = float(np.median(present[own]))
                lack = max(0.0, (usual - present[i]) / max(1.0, usual))
                reps = [k for k in taken() if label[k] == label[i]]
                novel = max(by_mask[i, k] for k in reps) if reps else by_mask[i, own].sum() / max(1, len(own) - 1)
                score = 0.55 * lack + 0.35 * novel + 0.10 * (1 - min(1.0, max(0.0, probability[i])))
            else:
                lack = max(0.0, 1 - present[i] / max(1.0, float(np.median(present)) or 1.0))
                novel = min((by_mask[i, k] for k in taken()), default=0.0)
                score = noise_template * (0.55 * lack + 0.35 * novel + 0.10)
            if score > best[0]:
                best = (score, i)
        if best[1] >= 0:
            chosen.append((best[1], "template_shift"))
    while len(chosen) < budget:
        rest = [i for i in range(n) if i not in taken()]
        if not chosen:
            pick = max(rest, key=lambda i: (dist[i].sum(), -i))
        else:
            pick = max(rest, key=lambda i: (dist[i, taken()].min() * (noise_distance if label[i] < 0 else 1.0), i))
        chosen.append((pick, "farthest"))
    return [(ids[k], role) for k, role in chosen]
