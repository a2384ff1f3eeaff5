"""Projections of record tables: fields, splits, listings, layouts and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.rows import global_index


def project_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """The named columns in this order; absent ones are null."""
    return df.select(*[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields])


def split_on(df: DataFrame, column: str, token: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose column contains token, its case regarded, and all others (null ones too)."""
    has = F.coalesce(F.contains(F.col(column), F.lit(token)), F.lit(False))
    return df.where(has), df.where(~has)


def filter_existing(df: DataFrame, column: str, listing: DataFrame) -> DataFrame:
    """Rows whose path is in a listing of files (path)."""
    return df.join(listing.select(F.col("path").alias(column)).distinct().hint("merge"), column, "left_semi")


def offline_responses(df: DataFrame, source: str = "ann_response", least: int = 10) -> DataFrame:
    """df with the column response taken from source, where it is longer than least characters."""
    return df.withColumn("response", F.col(source)).where(F.length("response") > least)


def cap(df: DataFrame, start: int, n: int, *order: Column) -> DataFrame:
    """At most n rows from position start on, in the order; by positions, so that no task gathers them."""
    return global_index(df, *order, name="_at").where((F.col("_at") >= start) & (F.col("_at") < start + n)).drop("_at")


def ground_truth_layout(df: DataFrame) -> DataFrame:
    """gt_misalignment, gt_artifact and gt_boxes of records in the layout of two class lists or, where both are null, of one list.

    Class lists hold structs with box_2d; in the first layout gt_boxes is null, in the second the class lists are. Missing lists are empty.
    """
    none = F.array().cast("array<array<double>>")
    split = F.col("misalignment_boxes").isNotNull() | F.col("artifact_boxes").isNotNull()
    corners = lambda c: F.when(split, F.coalesce(F.transform(c, lambda b: b["box_2d"]), none))
    return df.withColumns({"gt_misalignment": corners(F.col("misalignment_boxes")), "gt_artifact": corners(F.col("artifact_boxes")), "gt_boxes": F.when(~split, F.coalesce(F.col("boxes"), none))})


def merged_sources(base: DataFrame, key: str, sources: list[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """base with columns of other tables by key, renamed as each source's map says; a key that a source lacks gives null."""
    for df, names in sources:
        base = base.join(df.select(key, *[F.col(a).alias(b) for a, b in names.items()]).hint("merge"), key, "left")
    return base


def padded(df: DataFrame, *columns: str) -> DataFrame:
    """Null lists as empty ones."""
    return df.withColumns({c: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)) for c in columns})


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join by key of two tables that must hold the same keys; if they do not, the keys that differ are told in the error."""
    from quillstone.operators.rows import mismatches

    wrong = mismatches(left, right, key).limit(5).collect()
    if wrong:
        raise ValueError(f"the tables do not hold the same keys, among others {[tuple(r) for r in wrong]}")
    return left.join(right.hint("merge"), key)


def metadata_map(df: DataFrame, known: list[str], name: str = "metadata") -> DataFrame:
    """df with the columns beside the known ones gathered in a map of texts; null values are left out."""
    rest = [c for c in df.columns if c not in known]
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in rest]) if rest else F.array().cast("array<struct<k:string,v:string>>")
    return df.select(*[c for c in df.columns if c in known], F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias(name))


def text_vectors(df: DataFrame, text: str, vectors: DataFrame, name: str) -> DataFrame:
    """df with the vector of a text (vectors: text, vector); each distinct text is looked up once, unknown ones are null."""
    met = df.select(F.col(text).alias("text")).distinct().join(vectors.hint("merge"), "text")
    return df.join(met.select(F.col("text").alias(text), F.col("vector").alias(name)).hint("merge"), text, "left")
