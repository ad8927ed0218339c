"""Blocks of consecutive rows of about equal bytes, without a global sort.

Rows are ordered by doc_id, null last; rows of one doc_id by the 64-bit hash of their text.  Cut points
come from a sample in which a row's chance grows with its bytes, so a block holds about
TARGET bytes at any size of the table, and one id with very many rows is cut like any other run.
Only a row that is there more than once, id and text, cannot be cut, and a text is never divided.
The driver holds a bounded number of keys a block.  The cuts change the blocks, never a result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of texts in a block, and the most keys sampled for one and for all of them.
TARGET, KEYS, ALL_KEYS = 32 << 20, 64, 1_000_000
_KEY = "struct<missing:int,id:bigint,hash:bigint>"


def ordered_key(id_col: str = "doc_id", text_col: str = "text"):
    return F.struct(F.col(id_col).isNull().cast("int").alias("missing"), F.coalesce(id_col, F.lit(0).cast("long")).alias("id"), F.xxhash64(text_col).alias("hash"))


def cut_points(df: DataFrame, least: int) -> tuple[list[tuple], int]:
    """The first keys of all blocks but the first, and the bytes of all texts; about `least` blocks
    or as many as TARGET asks for."""
    size = (F.octet_length("text") + 16).cast("long")
    total = df.agg(F.sum(size)).first()[0] or 0
    blocks = max(least, math.ceil(total / TARGET))
    each = max(1, total / (blocks * max(4, min(KEYS, ALL_KEYS // blocks))))
    rows = df.select(ordered_key().alias("key"), size.alias("size")).where(F.rand(7) < F.col("size") / each).collect()
    weights = sorted((tuple(r.key), max(r.size, each)) for r in rows)
    run, share, cuts = 0.0, sum(w for _, w in weights) / blocks, []
    for key, w in weights:
        if run >= share * (len(cuts) + 1) and (not cuts or key > cuts[-1]):
            cuts.append(key)
        run += w
    return cuts, total


def with_blocks(df: DataFrame, least: int) -> tuple[DataFrame, int]:
    """df (doc_id, text, …) with the columns hash and block (long, 0 and up), and the bytes of all texts."""
    cuts, total = cut_points(df, least)
    key = ordered_key()
    block = F.lit(0)
    if cuts:
        table = F.from_json(F.lit(json.dumps([dict(zip(("missing", "id", "hash"), c, strict=True)) for c in cuts])), f"array<{_KEY}>")
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
        # a binary search: as many cuts as are at or below the key
        block = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= key, at + step).otherwise(at))
    return df.withColumn("hash", F.xxhash64("text")).withColumn("block", block.cast("long")), total
