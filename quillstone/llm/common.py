"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch, whichever comes first (a row that is longer stands alone).
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes, so that long texts do not fill a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset a local master takes a temporary folder, others fail."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        at = tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: the lineage is cut and the rows survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Ids (8 bytes each) that may be broadcast to pick rows of a table by.
BROADCAST_IDS = 200_000


def join_kind(ids: DataFrame) -> str:
    """Hint for a join with a stored table of ids: broadcast where they are few, else a sort-merge join."""
    return "broadcast" if ids.count() <= BROADCAST_IDS else "merge"


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without the rows whose key is in gone (one column); columns as they were, whatever their names."""
    name = f"gone_{uuid.uuid4().hex}"
    ids = stored(gone.toDF(name), "gone")
    return docs.join(ids.hint(join_kind(ids)), docs[key].eqNullSafe(ids[name]), "left_anti")


#: A key with more rows than both the first number and this share of all rows is dealt out over several tasks.
HOT_ROWS, HOT_SHARE = 500, 1000


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row per key, with the hot keys of left dealt out over several tasks.

    The rows of right that hot keys meet are repeated for each of them. Both tables should be stored: left is read
    once more for its hot keys, of which there are HOT_SHARE at most.
    """
    limit = max(HOT_ROWS, left.count() // HOT_SHARE)
    hot = left.where(F.col(key).isNotNull()).groupBy(key).agg((1 + F.count("*") / limit).cast("int").alias("_tasks")).where("_tasks > 1").collect()
    if not hot:
        return left.join(right.hint("merge"), key, how)
    spark = left.sparkSession
    tasks = spark.createDataFrame([(r[0], r[1]) for r in hot], left.select(F.col(key), F.lit(1).alias("_tasks")).schema)
    dealt = F.coalesce("_tasks", F.lit(1))
    rows = left.join(tasks.hint("broadcast"), key, "left").withColumn("_task", F.pmod(F.xxhash64(*[F.col(c) for c in left.columns if c != key]), dealt).cast("int")).drop("_tasks")
    met = right.join(tasks.hint("broadcast"), key, "left").withColumn("_task", F.explode(F.sequence(F.lit(0), dealt - 1))).drop("_tasks")
    return rows.join(met.hint("merge"), [key, "_task"], how).drop("_task")


def _released(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """fn, and at the end of its task free memory goes back to the system: workers live on and share theirs with the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.mapInArrow(_released(fn), schema)


def dataset_remainder(key: str, modulus: int):
    """crc32 of the key as text, modulo: the fixed split of labelled rows."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus
