"""File sources and sinks: JSON lines, prompts, CSV, image headers, resumable appends, reports."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BAD = "_bad_line"


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir. Where it is unset a local master takes a temporary folder, others fail."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        at = tempfile.mkdtemp(prefix="quillstone-")
    return f"{at}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder once and read back, for what is read several times."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: StructType, bad: str = "drop") -> DataFrame:
    """JSON lines; blank lines are skipped. Bad lines ``fail``, are dropped (``drop``) or kept in the column _bad_line (``quarantine``)."""
    if bad == "fail":
        return spark.read.schema(schema).json(paths, mode="FAILFAST")
    if bad not in ("drop", "quarantine"):
        raise ValueError(f"bad is fail, drop or quarantine, not {bad}")
    lines = spark.read.text(paths).where(F.trim("value") != "")
    wide = StructType([*schema.fields, StructField(BAD, StringType())])
    read = lines.select(F.from_json("value", wide, {"columnNameOfCorruptRecord": BAD}).alias("r")).select("r.*")
    return read if bad == "quarantine" else read.where(F.col(BAD).isNull()).drop(BAD)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def read_prompts(spark: SparkSession, jsonl: str | None = None, txt: str | None = None) -> DataFrame:
    """Column prompt from JSON lines where given, else from the trimmed lines of a text that are not empty."""
    if jsonl:
        return spark.read.json(jsonl)
    if not txt:
        raise ValueError("neither JSON lines nor a text of prompts is given")
    return spark.read.text(txt).select(F.trim("value").alias("prompt")).where("prompt != ''")


def write_routed(df: DataFrame, route: Column, path: str) -> None:
    """One pass over df, one folder of JSON lines for each value of route."""
    df.withColumn("route", route).write.partitionBy("route").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def image_sizes(files: DataFrame) -> DataFrame:
    """(path, width, height) of PNG files (path, content) from their headers; null where the header is another or cut off."""
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("long")
    png = (F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A") & (F.octet_length("content") >= 24)
    return files.select("path", F.when(png, number(17)).alias("width"), F.when(png, number(21)).alias("height"))


def write_outcomes(df: DataFrame, ok: Column, path: str, attempt: str) -> None:
    """df in one pass to ``path``/attempt/part=ok and part=failed; rows where ok is null have failed. A repeated attempt replaces its folder."""
    part = F.when(F.coalesce(ok, F.lit(False)), "ok").otherwise("failed")
    df.withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(f"{path}/{attempt}")


def append_results(df: DataFrame, ok: Column, path: str, run: str) -> None:
    """Rows of one run appended to those of others: see write_outcomes; a run that is done again replaces its own rows only."""
    write_outcomes(df, ok, path, f"run={run}")


def read_outcomes(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """What write_outcomes has written, of all attempts: the columns of schema and part (ok or failed)."""
    fields = [f for f in schema.fields if f.name != "part"]
    return spark.read.schema(StructType([*fields, StructField("part", StringType())])).parquet(path).select(*[f.name for f in fields], "part")


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Each row (path, content) as a file of that relative path below root, a folder that all executors share; gives the paths written.

    Lazy: the files are there once the result has been read. An attempt that is repeated writes the same bytes again.
    """
    uri = root if "://" in root else "file://" + root.removeprefix("file:")

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(uri)
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                store.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{base}/{path}", compression=None) as out:
                    out.write(content)
            yield f[["path"]]

    return files.select("path", "content").mapInPandas(put, "path string")


def image_headers(spark: SparkSession, root: str) -> DataFrame:
    """(path, width, height) of all files below root, path being relative to it; null sizes where a file is no PNG or is cut off. Only 24 bytes of a file leave its scan."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.removeprefix("file:").split("://")[-1].strip("/")
    below = F.expr(f"substring(path, instr(path, '{base}/') + {len(base) + 1})")
    return image_sizes(read.select(below.alias("path"), F.substring("content", 1, 24).alias("content")))


def image_report(spark: SparkSession, listing: str, root: str, top: int = 20, field: str = "filename") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes of the images that a listing of JSON lines names, against the files below root: a row of figures, the commonest sizes, and a row per file.

    Figures: total (lines with a name), missing (no such file), errors (lines that are no JSON or name nothing, and files without a header that can be
    read), sizes (different ones). Blank lines are nothing. A name in several lines counts as often. Sizes: (width, height, n), the top commonest. Files:
    (path, n, missing, width, height). Lines are counted by name before they meet the files.
    """
    lines = spark.read.text(listing).where(F.trim("value") != "")
    named = lines.select(F.from_json("value", StructType([StructField(field, StringType())]))[field].alias("path"))
    counted = named.groupBy("path").agg(F.count("*").alias("n"))
    there = image_headers(spark, root).withColumn("there", F.lit(True))
    met = counted.join(there.hint("merge"), "path", "left").select("path", "n", F.col("there").isNull().alias("missing"), "width", "height")
    met = written(met, "image-report")
    of = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias
    unread = F.col("path").isNull() | (~F.col("missing") & F.col("width").isNull())
    figures = met.agg(of(F.col("path").isNotNull())("total"), of(F.col("path").isNotNull() & F.col("missing"))("missing"), of(unread)("errors"), F.count_distinct("width", "height").alias("sizes"))
    read = met.where("width is not null")
    sizes = read.groupBy("width", "height").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "width", "height").limit(top)
    return figures, sizes, met.where("path is not null")


def _json(c: Column) -> Column:
    """A value as JSON text; null as null."""
    text = F.to_json(F.array(c))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def nested_json(metrics: DataFrame) -> DataFrame:
    """One row (json): a table of metrics (path array<string>, value) as a tree of JSON objects, keys in their order.

    Level by level from the deepest, each by an aggregate that joins the children of a node; a path must not be the
    beginning of another. An empty table is an empty object.
    """
    spark, at = metrics.sparkSession, work_path(metrics.sparkSession, "metrics")
    metrics.select("path", _json(F.col("value")).alias("json")).write.parquet(at)
    rows = spark.read.schema("path array<string>, json string").parquet(at)
    depth = rows.agg(F.max(F.size("path"))).first()[0] or 0
    member = F.struct(F.element_at("path", -1).alias("k"), F.concat(_json(F.element_at("path", -1)), F.lit(":"), F.col("json")).alias("m"))
    for d in range(depth, 0, -1):
        inner = rows.where(F.size("path") == d).groupBy(F.slice("path", 1, d - 1).alias("path")).agg(F.array_sort(F.collect_list(member)).alias("m"))
        rows = rows.where(F.size("path") < d).unionByName(inner.select("path", F.concat(F.lit("{"), F.array_join(F.transform("m", lambda x: x["m"]), ","), F.lit("}")).alias("json")))
    return rows.agg(F.coalesce(F.max("json"), F.lit("{}")).alias("json"))


def flattened_json(trees: DataFrame, depth: int) -> DataFrame:
    """(path array<string>, value string) of the leaves of JSON objects (json), down to depth; deeper objects stay texts."""
    rows = trees.select(F.array().cast("array<string>").alias("path"), F.col("json").alias("value"))
    for _ in range(depth):
        inner = F.from_json("value", "map<string, string>")
        node = F.col("value").startswith("{")
        below = rows.where(node).select("path", F.explode(inner).alias("k", "value")).select(F.concat("path", F.array("k")).alias("path"), "value")
        rows = rows.where(~F.coalesce(node, F.lit(False))).unionByName(below)
    return rows


def write_report(metrics: DataFrame, worst: DataFrame, path: str) -> None:
    """Metrics (path array<string>, value) as one nested JSON text in ``path``/report, and the rows that fared worst as JSON lines in ``path``/worst."""
    nested_json(metrics).select(F.col("json").alias("value")).write.text(f"{path}/report")
    worst.write.json(f"{path}/worst")


def read_report(spark: SparkSession, path: str, worst: StructType, depth: int = 4) -> tuple[DataFrame, DataFrame]:
    """What write_report has written: (path, value) of the leaves, and the worst rows."""
    return flattened_json(spark.read.text(f"{path}/report").select(F.col("value").alias("json")), depth), spark.read.schema(worst).json(f"{path}/worst")


def read_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """JSON lines of several files or folders, columns by name; what a file lacks is null."""
    return union_by_name(*[spark.read.json(p) for p in paths])


def union_by_name(*tables: DataFrame) -> DataFrame:
    """All rows of tables, columns by name; what a table lacks is null."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_prompt_set(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """The prompts of a split: ``folder``/split.jsonl where it is there, else ``folder``/split.txt; an error where neither is."""
    for kind in ("jsonl", "txt"):
        path = f"{folder}/{split}.{kind}"
        if exists(spark, path):
            return read_prompts(spark, **{kind: path})
    raise FileNotFoundError(f"neither {split}.jsonl nor {split}.txt is in {folder}")
