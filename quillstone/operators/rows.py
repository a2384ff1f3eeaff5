"""Row order, sampling and record bookkeeping that stay distributed."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.sources.files import work_path


def hash_order(seed: str, *key: Column) -> Column:
    """A pseudo-random order that only depends on the seed and the key."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in key]))


def global_index(df: DataFrame, *order: Column, name: str = "index") -> DataFrame:
    """Position from 0 in the order, without a window over all rows.

    The rows, range-partitioned and sorted, are written once with their partition and place in it; the sizes of the
    partitions, one row each, give the offsets. Ties must be broken by order itself.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()  # the partition in the upper bits, the place in the lower 33
    path = work_path(df.sparkSession, "ordered")
    parts.withColumn("_n", number).write.parquet(path)
    local = df.sparkSession.read.schema(f"{parts.schema.toDDL()}, _n bigint").parquet(path)
    local = local.withColumn("_p", F.shiftright("_n", 33)).withColumn("_i", F.col("_n").bitwiseAND(F.lit(2**33 - 1)))
    sizes = local.groupBy("_p").agg(F.count("*").alias("_size"))
    before = sizes.select("_p", (F.sum("_size").over(Window.orderBy("_p")) - F.col("_size")).alias("_before"))
    # as many rows as partitions
    return local.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_i")).drop("_p", "_i", "_n", "_before")


def keyed_sample(df: DataFrame, n: int, seed: str, *key: Column) -> DataFrame:
    """n rows by hash order: a top-k, not a full sort, so n is a sample that one task can hold."""
    return df.orderBy(hash_order(seed, *key), *key).limit(n)


def mixed_sample(train: DataFrame, test: DataFrame, target: int, seed: str, key: str) -> DataFrame:
    """target rows split by the original ratio of train to test (rounded down for train), with their split."""
    n, m = train.count(), test.count()
    of_train = target * n // max(1, n + m)
    one = keyed_sample(train, min(n, of_train), seed, F.col(key)).withColumn("part", F.lit("train"))
    return one.unionByName(keyed_sample(test, min(m, target - of_train), seed, F.col(key)).withColumn("part", F.lit("test")))


def last_by(df: DataFrame, key: str, order: Column, columns: list[str]) -> DataFrame:
    """One row per key, the last in the order, as an aggregate that combines before the shuffle."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_r")).select(key, "_r.*")


def funnel(df: DataFrame, reason: Column) -> DataFrame:
    """(reason, n): rows by reason, ``ok`` where it is null."""
    return df.groupBy(F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def route_keywords(df: DataFrame, column: str, keywords: list[str]) -> DataFrame:
    """A row for each keyword that the column contains, whatever the case, as column route."""
    hits = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower(F.col(column)), k))
    return df.withColumn("route", F.explode(hits))


def mismatches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, n_left, n_right) of the keys that two tables do not hold equally often; empty where they are aligned."""
    n = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return n(left, "n_left").join(n(right, "n_right"), key, "full_outer").select(key, zero("n_left"), zero("n_right")).where("n_left != n_right")


def misplaced(left: DataFrame, right: DataFrame, key: str, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """(index, left, right): places, in the orders given, at which two tables do not hold the same key; null beyond the end of one."""
    side = lambda df, order, name: global_index(df, *order).select("index", F.col(key).alias(name))
    both = side(left, left_order, "left").join(side(right, right_order, "right").hint("merge"), "index", "full_outer")
    return both.where(~F.col("left").eqNullSafe(F.col("right")))


def joined_by_place(left: DataFrame, right: DataFrame, key: str, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Rows of two tables that stand at the same place, with the column index: both must hold the same key at every place.

    A table with as many rows of which two are exchanged is refused, and the first places that differ are told in the error.
    """
    wrong = misplaced(left, right, key, left_order, right_order).orderBy("index").limit(5).collect()
    if wrong:
        raise ValueError(f"the tables differ by place, at first at {[tuple(r) for r in wrong]}")
    return global_index(left, *left_order).join(global_index(right, *right_order).drop(key).hint("merge"), "index")


def joined_leniently(left: DataFrame, right: DataFrame, key: str, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """As many rows on both sides: rows that stand at the same place, whatever their keys (that of left stays); else rows with
    the same key. The column index holds the place in left, by which its order is kept. A key that right holds twice gives its last row.
    """
    one, other = global_index(left, *left_order), global_index(right, *right_order)
    if one.count() == other.count():
        return one.join(other.drop(key).hint("merge"), "index")
    rest = [c for c in right.columns if c != key]
    return one.join(last_by(other, key, F.col("index"), rest).hint("merge"), key)


def absent(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows with a key that is neither null nor empty and that known does not hold."""
    return df.where(F.coalesce(F.col(key), F.lit("")) != "").join(known.select(key).distinct().hint("merge"), key, "left_anti")


def remaining(df: DataFrame, key: str, *done: DataFrame) -> DataFrame:
    """Rows whose key is in none of the tables of what is done, whether well or not; rows without a key remain."""
    keys = functools.reduce(DataFrame.unionByName, [d.select(key) for d in done]).distinct()
    return df.join(keys.hint("merge"), key, "left_anti")


def in_all(listing: DataFrame, key: str, method: str, value: str, methods: list[str]) -> DataFrame:
    """(key, a column per method): the values of keys that every method has; of several values of a method the least."""
    wide = listing.where(F.col(key).isNotNull()).groupBy(key).pivot(method, methods).agg(F.min(value))
    return wide.dropna(subset=methods)


def numbered_outputs(lines: DataFrame, outputs: DataFrame, *order: Column, name: str = "%04d.png", column: str = "file") -> tuple[DataFrame, DataFrame]:
    """Lines with the output that their place from 0 names, and the lines whose output is not there: the work that remains."""
    named = global_index(lines, *order).withColumn(column, F.format_string(name, "index"))
    there = outputs.select(column).distinct().hint("merge")
    return named.join(there, column, "left_semi"), named.join(there, column, "left_anti")


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows with the column side: those that left holds more often than right (as often as it does), and the reverse."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def even_step(m: int, k: int, ranks: int, batch: int, steps: int = 1, whole_groups: bool = False) -> int:
    """m rounded up so that m groups of k fill the batches of all ranks evenly, in each of steps; with whole_groups the ranks get equally many groups."""
    per = ranks * batch
    step = per * steps // math.gcd(k, per)
    if whole_groups:
        step = math.lcm(step, ranks)
    return -(-m // step) * step


def shards(df: DataFrame, n: int, *order: Column, form: str = "contiguous") -> DataFrame:
    """df with the column shard, by the place in the order: ``contiguous`` (equal parts, the last one takes the remainder), ``balanced`` (the
    first parts have one more each) or ``strided`` (every n-th)."""
    placed = global_index(df, *order)
    total = F.broadcast(placed.agg(F.count("*").alias("_total")))  # one row
    at, size = F.col("index"), F.floor(F.col("_total") / n)
    more = F.col("_total") % n
    of = {
        "contiguous": F.least(F.floor(at / F.greatest(size, F.lit(1))), F.lit(n - 1)),
        "balanced": F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / F.greatest(size, F.lit(1)))),
        "strided": at % n,
    }
    return placed.join(total).withColumn("shard", of[form].cast("long")).drop("index", "_total")


def shuffled_batches(df: DataFrame, size: int, seed: str, *key: Column) -> DataFrame:
    """df with the column batch: rows in hash order by the seed, cut into batches of size."""
    keyed = df.withColumn("_h", hash_order(seed, *key))
    return global_index(keyed, F.col("_h"), *key).withColumn("batch", F.floor(F.col("index") / size).cast("long")).drop("_h", "index")


def repeat_manifest(prompts: DataFrame, key: str, m: int, k: int, ranks: int, batch: int, seed: str) -> DataFrame:
    """(key, copy, iteration, rank, slot): m prompts by hash order, k copies each, shuffled and dealt out.

    m as it is; even_step() gives one with which no iteration is short. Copies are m * k rows, whatever the size of prompts.
    """
    chosen = keyed_sample(prompts.select(key), m, seed, F.col(key))
    copies = chosen.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    placed = global_index(copies.withColumn("_h", hash_order(f"{seed}|deal", F.col(key), F.col("copy"))), F.col("_h"), F.col(key), F.col("copy"))
    at = F.col("index")
    return placed.select(key, "copy", F.floor(at / (ranks * batch)).alias("iteration"), F.floor(at % (ranks * batch) / batch).alias("rank"), (at % batch).alias("slot"))


def group_manifest(prompts: DataFrame, key: str, m: int, k: int, ranks: int, seed: str) -> DataFrame:
    """(key, copy, rank, slot): m prompts by hash order with all k copies of one on one rank, in shuffled order; m must divide by ranks."""
    if m % ranks:
        raise ValueError(f"{m} groups cannot be dealt evenly to {ranks} ranks")
    chosen = keyed_sample(prompts.select(key), m, seed, F.col(key))
    placed = global_index(chosen.withColumn("_h", hash_order(f"{seed}|deal", F.col(key))), F.col("_h"), F.col(key))
    per = m // ranks
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return copies.select(key, "copy", F.floor(F.col("index") / per).alias("rank"), (F.col("index") % per * k + F.col("copy")).alias("slot"))


def permuted(df: DataFrame, key: str, names: list[str], seed: str) -> DataFrame:
    """df with the column order: names in an order that only depends on seed and key."""
    one = F.array(*[F.struct(hash_order(seed, F.col(key), F.lit(n)).alias("h"), F.lit(n).alias("n")) for n in names])
    return df.withColumn("order", F.transform(F.array_sort(one), lambda s: s["n"]))
