"""Jaccard self-join on word 5-grams with adaptive multi-match prefixes.

Two sets x, y with Jaccard similarity of 3/4 or more have at least ceil(3 (|x| + |y|) / 7) shingles in common.
With all shingles in one order, rare ones first, they therefore share a shingle in their prefixes, and l of
them if both prefixes are l - 1 longer. Each document chooses its own l: a longer prefix costs more rows, but
by Markov's inequality at most (frequencies in the prefix) / l documents share l shingles with it, so that
documents with frequent shingles take a larger l. A pair is verified only if it shares the smaller l of the two.

The work is done in two rounds. In the first the order is that of the hashes and l is an eighth of the set: a
document that does not share as many prefix shingles with others has no similar one and is left out. In the second
the shingles of the remaining documents are counted exactly; a document that has too few shared ones is left out,
and of the others the prefixes in the order of these frequencies meet in buckets. Very frequent shingles are known
from a sample beforehand, so that their buckets can be dealt out over tasks; results do not depend on it.

Documents with equal sets are one node. Groups of near copies do not become pairs: every set is first verified
against one leader, the set it shares most prefix shingles with among those that come first in its buckets, and
afterwards only pairs from different components are enumerated. The closest few of each two components are verified first,
the others only where these have not joined the two. Of those, pairs whose parity bitmaps differ in more
bits than similar sets can differ in shingles are left out within the join (each shingle flips one bit of its set's
bitmap, so the sets differ in as many shingles at least).
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.llm import textbytes
from quillstone.llm.common import join_kind, map_arrow, spread_join, stored, without
from quillstone.llm.components import components as connected

WORDS = 5
#: Values of l that a document chooses from, and the cost of a prefix row in candidates.
MATCHES, ROW_COST = (1, 2, 3, 4, 6, 8), 1.0
#: 64-bit words of a parity bitmap: those of sets that differ in d shingles differ in about 1024 * (1 - exp(-d / 1024)) of
#: 2,048 bits, so that few pairs that differ a little too much (linked ones: by a seventh of both sizes at most) get through.
PARITY_WORDS = 32
#: Nodes of the sample that frequent shingles are known from, about, and in how many of them such a shingle is.
SAMPLE_NODES, HOT_IN_SAMPLE = 4_000, 8
#: Documents of a shingle for each task that its bucket is dealt out over.
BUCKET_ROWS = 2_000
#: Candidate pairs of two components that are verified before all others.
TRIED = 3
#: Keys that stand for a component in a bucket before all its keys do.
STAND_INS = 4
_PARITY_DDL = ", ".join(f"p{k} long" for k in range(PARITY_WORDS))

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = np.random.default_rng(5).integers(1, 2**63, 256, dtype="u8") | np.uint64(1)
_P = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    up, down = np.full(n, _P, "u8"), np.full(n, pow(_P, -1, 2**64), "u8")
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles.

    A-Z are lower-cased; words are separated by blanks and the controls 9 to 13. A text with fewer than 5
    words has its whole sequence as one shingle; null and wordless texts have none.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    out: list[np.ndarray] = []
    for a, b in textbytes.blocks(raw):
        codes, starts = textbytes.joined(raw[a:b])
        space = _SPACE[codes]
        first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        after = np.flatnonzero(~space[:-1] & space[1:]) + 1
        up, down = _powers(1 << max(20, int(len(codes)).bit_length()))
        total = np.zeros(len(codes) + 1, "u8")
        np.cumsum(_BYTE[codes] * up[: len(codes)], out=total[1:])
        word = _mix((total[after] - total[first]) * down[first] + (after - first).astype("u8"))
        own = np.searchsorted(first, starts)  # the first word of each text
        grams = np.zeros(max(0, len(word) - WORDS + 1), "u8")
        for k in range(WORDS):
            grams = grams * np.uint64(_P) + word[k : k + len(grams)]
        grams = _mix(grams + np.uint64(WORDS))
        for x, y in zip(own[:-1].tolist(), own[1:].tolist(), strict=True):
            if y - x >= WORDS:
                out.append(np.unique(grams[x : y - WORDS + 1]))
            elif y > x:
                h = np.zeros(1, "u8")
                for k in range(x, y):
                    h = h * np.uint64(_P) + word[k : k + 1]
                out.append(_mix(h + np.uint64(y - x)))
            else:
                out.append(np.zeros(0, "u8"))
    return out


PARITY = [f"p{k}" for k in range(PARITY_WORDS)]


def _parity(shingles: np.ndarray) -> np.ndarray:
    bits = np.bincount((shingles >> np.uint64(8)) % np.uint64(64 * PARITY_WORDS), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(bits.astype("u1")).view("i8")


def _sets(b: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) of a batch, some texts at a time."""
    at = b.schema.get_field_index(column)
    for i in range(0, b.num_rows, 200):
        yield from enumerate(shingle_sets(b.column(at).slice(i, 200).to_pylist()), i)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row its number of shingles and a digest of the set."""
    for b in batches:
        seen = [(len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest()) for _, s in _sets(b)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in seen], pa.int64()), pa.array([d for _, d in seen], pa.binary())], ["doc_id", "n_shingles", "digest"])


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.r_[0, np.cumsum([len(a) for a in arrays])].astype("i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, "u8")]).astype("u8").view("i8")))


def _opening(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefixes in the order of hashes, and how many of their shingles a document must share to have a similar one.

    A prefix for l = n // 8 of n shingles; a similar set has 3 n / 4 shingles at least, so that its own l is 3 n / 32 or more.
    """
    for b in batches:
        nodes, needs, lists = [], [], []
        ids = b.column(0).to_pylist()
        for i, s in _sets(b):
            n = len(s)
            if n:
                least = -(-3 * n // 4)
                nodes.append(ids[i])
                needs.append(max(1, least // 8))
                lists.append(s[: n - least + max(1, n // 8)])
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(needs, pa.int32()), _lists(lists)], ["node", "need", "tokens"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole sets with their parity bitmaps."""
    for b in batches:
        ids = b.column(0).to_pylist()
        found = [(ids[i], s) for i, s in _sets(b) if len(s)]
        parity = np.array([_parity(s) for _, s in found], "i8").reshape(len(found), PARITY_WORDS)
        columns = [pa.array([d for d, _ in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int32()), *[pa.array(parity[:, k]) for k in range(PARITY_WORDS)], _lists([s for _, s in found])]
        yield pa.RecordBatch.from_arrays(columns, ["node", "size", *PARITY, "tokens"])


def hot_tokens(nodes: DataFrame, n: int) -> DataFrame:
    """(token, hot): shingles of many documents with their estimated number, from a sample of about SAMPLE_NODES of n.

    The list is bounded by the sample. It only says which buckets are dealt out over several tasks and in which order
    such shingles stand; a shingle that it lacks is counted exactly.
    """
    share = min(1.0, SAMPLE_NODES / max(1, n))
    some = nodes.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < share * 1_000_000)
    tokens = map_arrow(some, _whole, f"node long, size int, {_PARITY_DDL}, tokens array<long>").select(F.explode("tokens").alias("token"))
    hot = tokens.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_IN_SAMPLE)
    return stored(hot.select("token", (F.col("n") / share).cast("long").alias("hot")), "hot")


def _counted(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """rows (token, node, ...) whose shingle another document has too, with df, its number of documents."""
    known = rows.join(hot.hint("broadcast"), "token", "left")  # hot: bounded by its sample
    salt = F.when(F.col("hot").isNotNull(), F.pmod(F.hash("node"), (1 + F.col("hot") / BUCKET_ROWS).cast("int"))).otherwise(0)
    n = F.count("*").over(Window.partitionBy("token", "salt"))
    return known.withColumn("salt", salt).withColumn("df", F.coalesce("hot", n)).where("df > 1").drop("salt", "hot")


def _prefixes(sets: DataFrame) -> DataFrame:
    """(token, df, place, key, size, least): the prefixes in the order of frequency, each as long as its estimated cost asks for.

    tokens of sets are those that other documents have, rare ones first; the size - size(tokens) others come before.
    """
    least = F.ceil(3 * F.col("size") / 4.0).cast("int")
    single = F.col("size") - F.size("tokens")
    end = lambda k: F.greatest(F.col("size") - least + k - single, F.lit(0))
    # of the documents that the prefix meets, (sum of frequencies) / l at most share l of its shingles
    met = lambda k: F.aggregate(F.slice("docs", F.lit(1), end(k)), F.lit(0.0), lambda s, d: s + d - 1)
    costs = F.transform(F.filter(F.array(*map(F.lit, MATCHES)), lambda k: (k == 1) | (k <= least)), lambda k: F.struct((met(k) / k + ROW_COST * end(k)).alias("cost"), k.alias("k")))
    chosen = sets.select("key", "size", "tokens", "docs", F.array_min(costs)["k"].alias("least"))
    cut = chosen.select("key", "size", "least", single.alias("single"), F.posexplode(F.slice(F.arrays_zip("tokens", "docs"), F.lit(1), end(F.col("least")))).alias("at", "t"))
    return cut.select(F.col("t.tokens").alias("token"), F.col("t.docs").alias("df"), (F.col("single") + F.col("at")).cast("int").alias("place"), "key", "size", "least")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, src, dst) of the pairs (a, b) of keys whose sets are similar, src and dst their nodes; whole sets are compared.

    Shingles that no other document has are in no intersection, so that the shared ones are enough.
    """
    named = stored(pairs, "pairs")
    side = lambda c: sets.select(F.col("key").alias(c), F.col("node").alias(f"n{c}"), F.col("size").alias(f"s{c}"), F.col("tokens").alias(f"t{c}"))
    both = spread_join(named, side("b"), "b").join(side("a").hint("merge"), "a")
    return both.where(7 * F.size(F.array_intersect("ta", "tb")) >= 3 * (F.col("sa") + F.col("sb"))).select("a", "b", F.col("na").alias("src"), F.col("nb").alias("dst"))


def surveyed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, node) of every row; node is the smallest doc_id with the same set, null without a shingle."""
    seen = stored(map_arrow(docs.select("doc_id", "text"), _survey, "doc_id long, n_shingles long, digest binary"), "survey")
    first = seen.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    out = spread_join(seen, first, "digest", "left")
    return stored(out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("first", "doc_id")).alias("node")), "members")


def shared_sets(docs: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets that may have a similar one: (key, node, size, tokens, docs), and (key, parity bitmap).

    tokens are the shingles that other such sets have, by frequency, then hash; docs their frequencies.
    """
    # an id stays if one of its texts stands for its set
    others = members.groupBy("doc_id").agg(F.max(F.coalesce(F.col("node") == F.col("doc_id"), F.lit(False))).alias("own")).where("not own").select("doc_id")
    others = stored(others, "others")
    nodes = docs.select("doc_id", "text").join(others.hint(join_kind(others)), "doc_id", "left_anti")
    hot = hot_tokens(nodes, members.where("node = doc_id").count())

    opened = map_arrow(nodes, _opening, "node long, need int, tokens array<long>").select("node", "need", F.explode("tokens").alias("token"))
    alive = _counted(opened, hot).groupBy("node", "need").agg(F.count("*").alias("n")).where("n >= need").select(F.col("node").alias("doc_id")).distinct()
    alive = stored(alive, "alive")
    rows = nodes.join(alive.hint(join_kind(alive)), "doc_id", "left_semi")
    whole = map_arrow(rows, _whole, f"node long, size int, {_PARITY_DDL}, tokens array<long>")
    whole = stored(whole.withColumn("key", F.monotonically_increasing_id()), "whole")

    tokens = _counted(whole.select("key", "node", F.explode("tokens").alias("token")), hot)
    by_key = tokens.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    sets = by_key.join(whole.select("key", "node", "size").hint("merge"), "key").where(F.size("t") >= F.ceil(3 * F.col("size") / 4.0))
    sets = stored(sets.select("key", "node", "size", F.col("t.token").alias("tokens"), F.col("t.df").alias("docs")), "sets")
    return sets, whole.select("key", *PARITY)


def _best(near: DataFrame) -> DataFrame:
    """Pairs (a, b): for each key the other key that it meets most often, of equals the smallest; near: key, other."""
    n = near.groupBy("key", "other").agg(F.count("*").alias("n"))
    return n.groupBy("key").agg(F.max(F.struct("n", -F.col("other"))).alias("m")).select(F.col("key").alias("a"), (-F.col("m.col2")).alias("b"))


def _named(edges: DataFrame) -> DataFrame:
    """(key, component) of the keys that edges (a, b) join."""
    return stored(connected(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "key-components").withColumnRenamed("node", "key")


def _closest(candidates: DataFrame) -> DataFrame:
    """Of the candidate pairs of each two components up to TRIED pairs (a, b): those whose bitmaps differ least.

    One link joins two components; those most likely to link are verified first, so that two groups of near
    copies that belong together are not linked by all their pairs.
    """
    two = [F.least("ca", "cb").alias("c"), F.greatest("ca", "cb").alias("d"), F.pmod(F.xxhash64("a", "b"), F.lit(TRIED)).alias("k")]
    least = candidates.groupBy(*two).agg(F.min(F.struct(F.col("differ") / (F.col("sa") + F.col("sb")), "a", "b")).alias("m"))
    return least.select("m.a", "m.b")


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows (token, salt, salts, component, ...) of buckets that hold several components."""
    tokens = rows.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("salts").alias("most")).where("x < y")
    tokens = tokens.select("token", F.explode(F.sequence(F.lit(0), F.col("most") - 1)).alias("salt"))
    return rows.join(tokens.hint("merge"), ["token", "salt"], "left_semi")


def _stand_ins(rows: DataFrame) -> DataFrame:
    """Up to STAND_INS keys of each component in a bucket, for the buckets in which these are far fewer than all.

    Two large groups of copies then meet by a few rows and are joined by one link; what they do not link is left to the pairs of all.
    """
    part = F.pmod(F.xxhash64("key"), F.lit(STAND_INS))
    one = rows.groupBy("token", "component", part.alias("part")).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("token", "component")]), F.xxhash64("key", "token")).alias("r"), F.count("*").alias("n"))
    one = stored(one.select("token", "component", "r.*", "n"), "stand-ins")
    dense = one.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("m")).where("n >= 1.5 * m").select("token")
    return one.drop("n").join(dense.hint("merge"), "token", "left_semi")


def _met(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows of different components in one bucket that may be similar, with their components, sizes and places."""
    rest = rows.join(maps.hint("merge"), "key")
    x = rest.where("place < size - ceil(6 * size / 7.0) + least").alias("x")
    y = rest.drop("salt").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("y").hint("merge")
    need = F.expr("ceil(3 * (x.size + y.size) / 7.0)")
    able = F.expr("least(x.place, y.place) + least(x.size - x.place, y.size - y.place)") >= need
    pair = F.expr("x.token = y.token and x.salt = y.salt and x.component != y.component and (x.size < y.size or x.size = y.size and x.key < y.key) and 4 * x.size >= 3 * y.size") & able
    differ = F.expr(" + ".join(f"bit_count(x.{p} ^ y.{p})" for p in PARITY))
    return x.join(y, pair & (differ <= F.expr("x.size + y.size") - 2 * need)).select(
        F.col("x.key").alias("a"), F.col("y.key").alias("b"), F.expr("least(x.least, y.least)").alias("least"), need.alias("need"),
        F.col("x.component").alias("ca"), F.col("y.component").alias("cb"), F.col("x.size").alias("sa"), F.col("y.size").alias("sb"), differ.alias("differ"),
        F.expr("struct(x.place as p, least(x.size - x.place, y.size - y.place) as room)").alias("at"),
    )


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, node) of every row, and edges (src, dst) between nodes that give the components."""
    members = surveyed(docs)
    sets, maps = shared_sets(docs, members)

    # buckets: rows of prefixes that share a shingle; those of frequent ones are dealt out
    salts = (1 + F.col("df") / BUCKET_ROWS).cast("int")
    made = _prefixes(sets).withColumn("salts", salts).withColumn("salt", F.pmod(F.hash("key"), salts))
    bucket = Window.partitionBy("token", "salt")
    rank = F.struct("place", "size", "key")
    shared = made.select("*", F.count("*").over(bucket).alias("n"), F.min(rank).over(bucket).alias("leader")).where("n > 1 or salts > 1")
    shared = stored(shared.select("token", "salt", "salts", "key", "place", "size", "least", F.col("leader.key").alias("leader")), "buckets")

    # every set against the leader that it shares most with
    near = shared.where("key != leader").select("key", F.col("leader").alias("other"))
    star = stored(verified(_best(near), sets), "star")
    of = spread_join(shared.drop("leader"), _named(star), "key", "left").withColumn("component", F.coalesce("component", "key"))
    of = stored(of, "placed")

    # pairs from different components, in buckets that have several: first only of keys that stand for their components
    rest = stored(_mixed(of), "mixed")
    few = stored(_stand_ins(rest), "few")
    if not few.isEmpty():
        star = stored(star.unionAll(verified(_closest(_met(few, maps)), sets)), "joined")
        rest = stored(spread_join(rest.drop("component"), _named(star), "key", "left").withColumn("component", F.coalesce("component", "key")), "placed-again")
        rest = stored(_mixed(rest), "mixed-again")
    met = _met(rest, maps)
    one = [F.first(c).alias(c) for c in ("least", "need", "ca", "cb", "sa", "sb", "differ")]  # the same in all rows of a pair
    again = met.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("at").alias("at"), *one).where("n >= least and at.room >= need")
    again = stored(again.select("a", "b", "ca", "cb", "sa", "sb", "differ"), "candidates")
    first = stored(verified(_closest(again), sets), "first")
    # the other candidates count only where their components are still apart; a component is named by one of its keys
    named = _named(star.unionAll(first))
    two = again.select(F.least("ca", "cb").alias("c"), F.greatest("ca", "cb").alias("d"))
    now = lambda df, c: df.join(named.select(F.col("key").alias(c), F.col("component").alias(f"n{c}")).hint("merge"), c, "left")
    still = stored(now(now(two.distinct(), "c"), "d").where("coalesce(nc, c) != coalesce(nd, d)").select("c", "d"), "apart")
    apart = again.withColumns({"c": F.least("ca", "cb"), "d": F.greatest("ca", "cb")}).join(still.hint("merge"), ["c", "d"], "left_semi").select("a", "b")
    late = verified(apart, sets)
    return members, stored(star.unionAll(first).unionAll(late).select("src", "dst"), "links")


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach, the row's own included. Null, empty and wordless
    texts have no shingles and link with nothing. Rows that repeat a doc_id are one document: the links of
    any of its texts count. An empty table gives no rows; other columns are not read.
    """
    members, edges = links(docs)
    # a node is linked with the other ids of its set through them; an id with several texts joins their nodes
    own = members.where("node is not null and node != doc_id").select(F.col("doc_id").alias("src"), F.col("node").alias("dst"))
    twice = members.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x != y").select(F.col("doc_id").alias("src"))
    ties = own.join(twice.hint("merge"), "src", "left_semi")
    named = stored(connected(edges.unionAll(ties)), "components")
    out = spread_join(members, named, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id"))


def drop_near(docs: DataFrame) -> DataFrame:
    """docs without the rows whose group has a smaller doc_id; columns as they were."""
    return without(docs, components(docs).where("component_id != doc_id").select("doc_id").distinct())
