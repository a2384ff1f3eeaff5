"""Hooks: rewards, aggregators and preprocessing steps that users supply, by name or as functions.

A pointwise reward gets Arrow batches as pandas frames, a groupwise one whole groups, gathered by Spark's shuffle.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Reward = Callable[[pd.DataFrame], pd.Series]
_REWARDS: dict[str, Callable] = {}


def register(name: str, fn: Callable) -> Callable:
    """Names a function; names are regarded without case."""
    _REWARDS[name.lower()] = fn
    return fn


def lookup(name: str) -> Callable:
    """A registered function, or what a dotted path leads to; an unknown name raises with the names there are."""
    if name.lower() in _REWARDS:
        return _REWARDS[name.lower()]
    module, dot, attribute = name.rpartition(".")
    if dot:
        try:
            return getattr(importlib.import_module(module), attribute)
        except (ImportError, AttributeError) as e:
            raise KeyError(f"{name!r} cannot be loaded; registered are {sorted(_REWARDS)}") from e
    raise KeyError(f"{name!r} is not registered; there are {sorted(_REWARDS)}")


def pointwise(df: DataFrame, fn: Reward, name: str = "reward") -> DataFrame:
    """df with a column of one value per row; fn gets a batch of rows and gives as many values."""
    schema = f"{df.schema.toDDL()}, `{name}` double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            values = fn(f)
            if len(values) != len(f):
                raise ValueError(f"{len(values)} values for {len(f)} rows")
            yield f.assign(**{name: pd.Series(values, index=f.index).astype("float64")})

    return df.mapInPandas(run, schema)


def groupwise(df: DataFrame, key: str, fn: Reward, name: str = "reward") -> DataFrame:
    """df with a column of values that fn gives for each whole group, aligned with its rows. A group must fit in a task."""
    schema = f"{df.schema.toDDL()}, `{name}` double"

    def run(f: pd.DataFrame) -> pd.DataFrame:
        values = fn(f)
        if len(values) != len(f):
            raise ValueError(f"{len(values)} values for {len(f)} rows")
        return f.assign(**{name: pd.Series(list(values), index=f.index, dtype="float64")})

    return df.groupBy(key).applyInPandas(run, schema)


def register_sql(spark: SparkSession, name: str, fn: Reward) -> None:
    """A reward of a batch of rows for SQL: ``name(struct(a, b))`` gives one double per row; the columns of the struct are those of the frame that fn gets."""

    def run(rows: pd.DataFrame) -> pd.Series:
        values = pd.Series(fn(rows), dtype="float64")
        if len(values) != len(rows):
            raise ValueError(f"{len(values)} values for {len(rows)} rows")
        return values

    spark.udf.register(name, F.pandas_udf(run, "double"))


def register_boxes_of(spark: SparkSession, name: str = "boxes_of") -> None:
    """The table function ``boxes_of(reply)`` for SQL: a row (place, label, x0, y0, x1, y1) per box of a JSON list.

    Items are boxes where they have box_2d with four numbers; place counts these from 0. Other items, other JSON and what is no JSON give no rows.
    It is an SQL function over variants, so that Catalyst inlines it.
    """
    corner = ", ".join(f"try_variant_get(b, '$.box_2d[{i}]', 'double')" for i in range(4))
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(reply STRING) RETURNS TABLE (place INT, label STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)
        RETURN SELECT pos, try_variant_get(b, '$.label', 'string'), {corner}
        FROM posexplode(filter(try_variant_get(try_parse_json(reply), '$', 'array<variant>'), b -> size(try_variant_get(b, '$.box_2d', 'array<double>')) = 4
            AND forall(try_variant_get(b, '$.box_2d', 'array<double>'), x -> x IS NOT NULL))) AS t(pos, b)""")


def aggregated(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What an aggregator makes of df; it must be a DataFrame."""
    out = fn(df)
    if not isinstance(out, DataFrame):
        raise TypeError("an aggregator gives a DataFrame")
    return out


def similarity_of(pairs: DataFrame, fn: Callable[[Column, Column], Column], a: str = "a", b: str = "b") -> DataFrame:
    """pairs with the column similarity by a function of two columns."""
    return pairs.withColumn("similarity", fn(F.col(a), F.col(b)))


def preprocessed(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch: int = 1000) -> DataFrame:
    """Rows through a batched step that gives the columns of schema; fn gets at most batch rows at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), batch):
                yield fn(f.iloc[i : i + batch].reset_index(drop=True))

    return df.mapInPandas(run, schema)
