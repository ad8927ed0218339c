"""A filter of fixed size that keeps texts from being moved for a join they cannot meet.

The listed keys set bits of one bitmap of BITS bits, whatever their number; it is summed up by
Spark's bitmap aggregates and sent to the workers.  Rows whose bit is not set go before the
join.  The join itself decides: with very many keys the filter only lets more rows through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A bitmap of one megabyte, as pieces of the size that bitmap_construct_agg makes.
BITS, PIECE = 1 << 23, 32_768


def only_listed(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows whose key may be listed in ids (key); none that is listed is lost."""
    place = lambda: F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(BITS))
    marked = ids.where(F.col(key).isNotNull()).select(F.expr(f"pmod(xxhash64(cast({key} as bigint)), {BITS}) div {PIECE}").alias("piece"), (place() % PIECE).alias("bit"))
    bits = np.zeros(BITS, bool)
    for r in marked.groupBy("piece").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).collect():
        bits[r.piece * PIECE:(r.piece + 1) * PIECE] = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(bits))
    names = rows.columns

    def keep(batches):
        for batch in batches:
            at = batch.column("place").to_numpy()
            ok = shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
            yield batch.select(names).filter(pa.array(ok.astype(bool)))

    return rows.withColumn("place", place()).mapInArrow(keep, rows.schema)
