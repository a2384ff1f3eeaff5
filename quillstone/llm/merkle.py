"""Merkle manifest of a dataset: ternary trees per source and over sources, kept as a postorder append log.

The leaves of a source are cut at multiples of 3^5. Each such aligned block is built by itself: a builder takes its
leaves in order and appends every node when it is complete, so that a node stands right behind its last child. The
roots of the blocks are the leaves of the next tier, until a source has one node; the subroots of the sources make a
tree in the same way. A source of any size is therefore built by many tasks of 243 rows at a time.

In a postorder log the place of a node needs no index: before leaf e stand e leaves, e // 3 nodes of level 1, e // 9 of
level 2 and so on, and the node of a level that ends with leaf e stands that many places behind it. Siblings are
read from these places when proofs are taken out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import map_arrow, stored
from quillstone.llm.ordered import numbered

#: Children of a node, and levels that one builder makes.
FAN, LEVELS = 3, 5
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Paths (about 2 KB each) that are broadcast to the blocks below them.
BROADCAST_PATHS = 4000
PATH = "array<struct<left: int, siblings: string>>"


def node(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def before(e: int) -> int:
    """Nodes that a log holds before leaf e is appended."""
    n = 0
    while e:
        n, e = n + e, e // FAN
    return n


def position(level: int, j: int, leaves: int) -> int:
    """Place of node j of a level in the postorder log of a tree with so many leaves."""
    return before(min((j + 1) * FAN**level, leaves) - 1) + level


def height(leaves: int) -> int:
    h = 0
    while leaves > 1:
        leaves, h = -(-leaves // FAN), h + 1
    return h


def append_log(leaves: list[str], top: int) -> list[tuple[int, int, str]]:
    """(level, number of its last leaf, digest) of all nodes up to level top in the order of completion; the last is the root."""
    log: list[tuple[int, int, str]] = []
    runs: list[list[str]] = [[] for _ in range(top)]

    def put(level: int, e: int, digest: str) -> None:
        log.append((level, e, digest))
        if level < top:
            runs[level].append(digest)
            if len(runs[level]) == FAN:
                close(level, e)

    def close(level: int, e: int) -> None:
        run, runs[level] = runs[level], []
        put(level + 1, e, node(run))

    for e, digest in enumerate(leaves):
        put(0, e, digest)
    for level in range(top):
        if runs[level]:
            close(level, len(leaves) - 1)
    return log


def siblings(log: list[str], i: int, leaves: int, top: int) -> list[tuple[int, str]]:
    """From leaf i up to the root: how many siblings stand left of the node, and the digests of all its siblings."""
    out = []
    for level in range(top):
        j, last = i // FAN**level, (leaves - 1) // FAN**level
        run = range(j - j % FAN, min(j - j % FAN + FAN - 1, last) + 1)
        out.append((j % FAN, "".join(log[position(level, k, leaves)] for k in run if k != j)))
    return out


def _part(c: str | Column) -> Column:
    s = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(text: str | Column = "text") -> Column:
    """Digest of a row: each field as its length in bytes, a colon and its value, or a dash where it is null."""
    return F.sha2(F.concat(*[_part(text if c == "text" else c) for c in FIELDS]), 256)


def _builder(tier: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []

        def segment(schema: pa.Schema) -> pa.RecordBatch:
            key, block = held
            digests, lasts = [r[1] for r in rows], [r[2] for r in rows]
            only = block == 0 and len(rows) < BLOCK
            log = append_log(digests, height(len(rows)) if only else LEVELS)
            places = [before(lasts[e]) + tier * LEVELS + level for level, e, _ in log]
            out = {"key": pa.array([key]), "block": pa.array([block], pa.int64()), "only": pa.array([only]), "last": pa.array([lasts[-1]], pa.int64()), "root": pa.array([log[-1][2]])}
            out |= {"nodes": pa.array([[d for _, _, d in log]]), "places": pa.array([places], pa.list_(pa.int64())), "levels": pa.array([[tier * LEVELS + x for x, _, _ in log]], pa.list_(pa.int32()))}
            out["items"] = pa.array([[r[0] for r in rows]], pa.list_(schema.field("item").type))
            return pa.RecordBatch.from_pydict(out)

        for b in batches:
            for key, at, item, digest, last in zip(*(b.column(c).to_pylist() for c in ("key", "at", "item", "digest", "last")), strict=True):
                if (key, at // BLOCK) != held:
                    if rows:
                        yield segment(b.schema)
                    held, rows = (key, at // BLOCK), []
                rows.append((item, digest, last))
            if rows:
                seen = b.schema
        if rows:
            yield segment(seen)

    return build


def _segments(rows: DataFrame, tier: int) -> DataFrame:
    """The logs of the aligned blocks of rows (key, at, item, digest, last): a row per block, nodes in the order of completion."""
    item = rows.schema["item"].dataType.simpleString()
    schema = f"key string, block long, only boolean, last long, root string, nodes array<string>, places array<long>, levels array<int>, items array<{item}>"
    block = F.floor(F.col("at") / BLOCK)
    dealt = rows.repartition("key", block).sortWithinPartitions("key", "at")
    return stored(map_arrow(dealt, _builder(tier), schema), "merkle-log")


def _tree(rows: DataFrame) -> list[DataFrame]:
    """Segments of all tiers above rows (key, at, item, digest)."""
    rows, tiers = rows.withColumn("last", F.col("at")), []
    while True:
        tiers.append(_segments(rows, len(tiers)))
        up = tiers[-1].where("not only")
        if up.isEmpty():
            return tiers
        rows = up.select("key", F.col("block").alias("at"), F.lit(None).cast("string").alias("item"), F.col("root").alias("digest"), "last")


def _roots(tiers: list[DataFrame]) -> DataFrame:
    """(key, digest, tier): the root of each key, and the tier that holds it."""
    out = [t.where("only").select("key", F.col("root").alias("digest"), F.lit(k).alias("tier")) for k, t in enumerate(tiers)]
    for more in out[1:]:
        out[0] = out[0].unionAll(more)
    return out[0]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pair = pa.list_(pa.struct([("left", pa.int32()), ("siblings", pa.string())]))
    for b in batches:
        for key, block, only, nodes, items, path, tag in zip(*(b.column(c).to_pylist() for c in ("key", "block", "only", "nodes", "items", "path", "tag")), strict=True):
            n = len(items)
            top = height(n) if only else LEVELS
            above = [(x["left"], x["siblings"]) for x in path or []]
            paths = [[{"left": k, "siblings": s} for k, s in siblings(nodes, i, n, top) + above] for i in range(n)]
            out = {"key": pa.array([key] * n), "at": pa.array(range(block * BLOCK, block * BLOCK + n), pa.int64()), "item": pa.array(items, b.schema.field("items").type.value_type)}
            out |= {"digest": pa.array([nodes[position(0, i, n)] for i in range(n)]), "path": pa.array(paths, pair), "tag": pa.array([tag] * n, pa.string())}
            yield pa.RecordBatch.from_pydict(out)


def _paths(tiers: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """(key, at, item, digest, path, tag) of the lowest rows: the siblings on the way up to the root.

    above (key, tier, path, tag) goes on from the root of each key, and its tag is passed down. Paths of higher
    tiers are joined to blocks, not to rows; a block is in one row of either side.
    """
    spark, higher = tiers[0].sparkSession, None
    for k in reversed(range(len(tiers))):
        met = spark.createDataFrame([], f"key string, block long, path {PATH}, tag string") if higher is None else higher.select("key", F.col("at").alias("block"), "path", "tag")
        if above is not None:
            met = met.unionAll(above.where(F.col("tier") == k).select("key", F.lit(0).cast("long"), "path", "tag"))
        if higher is not None or above is not None:
            met = stored(met, "merkle-paths")
        kind = "broadcast" if met.limit(BROADCAST_PATHS + 1).count() <= BROADCAST_PATHS else "merge"
        item = tiers[k].schema["items"].dataType.elementType.simpleString()
        rows = tiers[k].select("key", "block", "only", "nodes", "items").join(met.hint(kind), ["key", "block"], "left")
        higher = map_arrow(rows, _extract, f"key string, at long, item {item}, digest string, path {PATH}, tag string")
    return higher


@dataclass
class Manifest:
    """The logs of a dataset: tiers of the trees per source (source_tiers), those of the tree over sources (top_tiers) and the root (None: no rows)."""

    source_tiers: list[DataFrame]
    top_tiers: list[DataFrame]
    root: str | None


def build(rows: DataFrame) -> Manifest:
    """Manifest of rows (source, id, digest, item): per source a tree over the digests in the order of id (nulls first), above them one over the sources.

    item is any column to be carried along. Sources are ordered bytewise, null first. Rows with equal ids are ordered by their
    digests; equal rows are leaves of their own.
    """
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    leaves = stored(rows.select(key.alias("key"), "id", "digest", "item"), "merkle-leaves")
    tiers = _tree(numbered(leaves, "key", [F.col("id").asc_nulls_first(), F.col("digest")]).select("key", "at", "item", "digest"))
    tops = _roots(tiers).select(F.lit("").alias("key"), F.struct(F.col("key").alias("source_key"), "tier").alias("item"), "digest")
    top_tiers = _tree(numbered(tops, "key", [F.col("item.source_key")]).select("key", "at", "item", "digest"))
    root = _roots(top_tiers).first()
    return Manifest(tiers, top_tiers, root["digest"] if root else None)


def log(tiers: list[DataFrame]) -> DataFrame:
    """(key, place, level, digest): the append log of each tree by the places of its nodes; what higher tiers repeat of lower ones is left out."""
    out = None
    for k, t in enumerate(tiers):
        rows = t.select("key", F.inline(F.arrays_zip("places", "levels", "nodes"))).toDF("key", "place", "level", "digest")
        rows = rows.where(F.col("level") > k * LEVELS) if k else rows
        out = rows if out is None else out.unionAll(rows)
    return out


def proofs(m: Manifest) -> DataFrame:
    """(item, leaf, subroot, path): path has, per level up to the root of all, the number of siblings on the left and the digests of all siblings."""
    tops = _paths(m.top_tiers).select(F.col("item.source_key").alias("key"), F.col("item.tier").alias("tier"), "path", F.col("digest").alias("tag"))
    return _paths(m.source_tiers, tops).select("item", F.col("digest").alias("leaf"), F.col("tag").alias("subroot"), "path")


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    up = lambda d, x: F.sha2(F.concat(F.substring(x["siblings"], F.lit(1), x["left"] * 64), d, F.substring(x["siblings"], x["left"] * 64 + 1, F.lit(64 * FAN))), 256)
    return F.aggregate(path, digest, up)


def audit(docs: DataFrame) -> DataFrame:
    """Every document with its leaf, subroot, root and proof, and whether its copy still verifies against the manifest.

    The copies whose unsigned crc32 of the decimal doc_id is even have lost the line feeds of their text; those of null
    doc_ids are untouched. Null fields are dashes in a leaf, an empty text is not a null one. Rows with equal doc_ids are
    ordered by their leaves, repeated rows are leaves of their own; an empty table gives no rows.
    """
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    copy = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = docs.select("source", F.col("doc_id").alias("id"), leaf().alias("digest"), F.struct("doc_id", leaf(copy).alias("copy")).alias("item"))
    m = build(rows)
    root = F.lit(m.root).cast("string")
    out = proofs(m).select(F.col("item.doc_id").alias("doc_id"), "leaf", "subroot", root.alias("root"), F.sha2(F.concat_ws("", F.transform("path", lambda x: x["siblings"])), 256).alias("proof_sha256"), fold(F.col("item.copy"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
