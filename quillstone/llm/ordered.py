"""Places of rows within their key, in a stated order, without one key's rows in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from quillstone.llm.common import bounded_batches, stored


def _places(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n = TaskContext.get().partitionId(), None, -1
        for b in batches:
            at = np.empty(b.num_rows, "i8")
            for i, k in enumerate(b.column(key).to_pylist()):
                n = n + 1 if k == held else 0
                held, at[i] = k, n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), pa.array(np.full(b.num_rows, part, "i4"))], [*b.schema.names, "_at", "_part"])

    return run


def numbered(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """rows with at (long): the place, from 0, of each row among those of its key (a string without nulls), in order.

    Rows are dealt out by ranges of (key, order) and numbered as they stream by; a key that begins in one range and
    goes on in the next has the rows before added. For that the driver reads one row per range. Rows with equal
    order take their places in any way. An empty table gives an empty table.
    """
    bounded_batches(rows.sparkSession)
    dealt = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    schema = StructType(list(rows.schema)).add("_at", LongType()).add("_part", IntegerType())
    placed = stored(dealt.mapInArrow(_places(key), schema), "places")
    ends = placed.groupBy("_part").agg(F.min(key).alias("first"), F.max(F.struct(F.col(key).alias("k"), "_at")).alias("last")).orderBy("_part").collect()
    before, held, n = [], None, 0
    for e in ends:
        at = n if e["first"] == held else 0
        if at:
            before.append((e["_part"], e["first"], at))
        n = e["last"]["_at"] + 1 + (at if e["first"] == e["last"]["k"] else 0)
        held = e["last"]["k"]
    more = rows.sparkSession.createDataFrame(before, "_part int, _key string, _before long")
    on = (placed["_part"] == more["_part"]) & (placed[key] == more["_key"])
    return placed.join(more.hint("broadcast"), on, "left").select(*[placed[c] for c in rows.columns], (placed["_at"] + F.coalesce("_before", F.lit(0))).alias("at"))
