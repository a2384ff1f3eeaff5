"""File paths as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def generator_name(path: Column) -> Column:
    """The component after SDG unless it is ``dataset``; else empty."""
    name = F.regexp_extract(path, r"(?:^|/)SDG/([^/]+)/", 1)
    return F.when(name == "dataset", "").otherwise(name)


def exclusive_split(path: Column) -> Column:
    """test before train, else neither; missing without a path."""
    low = F.lower(path)
    return F.when(path.isNull() | (path == ""), "missing").when(low.contains("test"), "test").when(low.contains("train"), "train").otherwise("neither")


def remap_prefix(path: Column, ordered: list[tuple[str, str]]) -> Column:
    """The first prefix that fits is replaced."""
    out = path
    for old, new in reversed(ordered):
        out = F.when(path.startswith(old), F.concat(F.lit(new), F.substring(path, len(old) + 1, 2**31 - 1))).otherwise(out)
    return out


def unique_name(path: Column) -> Column:
    """parent2_parent1_stem; with fewer folders parent1_stem or the stem."""
    folders = F.filter(F.split(F.regexp_replace(path, r"/?[^/]*$", ""), "/"), lambda p: p != "")
    return F.concat_ws("_", F.slice(folders, F.greatest(F.size(folders) - 1, F.lit(1)), 2), stem(path))
