"""Group-normalised rewards: windows by group, global moments as a one-row aggregate."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.sources.files import written

FLOOR = 1e-6


def weighted_sum(rewards: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(sample_id, unique_id, scalar): the weighted sum of a sample's rewards; unnamed rewards weigh 1."""
    w = F.lit(1.0)
    for name, x in weights.items():
        w = F.when(F.col("reward_name") == name, x).otherwise(w)
    return rewards.groupBy("unique_id", "sample_id").agg(F.sum(F.col("reward").cast("double") * w).alias("scalar"))


def group_advantage(scalars: DataFrame, over_all: bool = False) -> DataFrame:
    """scalar less its group's mean, over the group's (or the whole batch's) population deviation, FLOOR at least."""
    group = Window.partitionBy("unique_id")
    rows = scalars
    deviation = F.stddev_pop("scalar").over(group)
    if over_all:
        rows = rows.join(F.broadcast(rows.agg(F.stddev_pop("scalar").alias("sd"))))  # one row
        deviation = F.col("sd")
    return rows.select("sample_id", "unique_id", ((F.col("scalar") - F.avg("scalar").over(group)) / F.greatest(deviation, F.lit(FLOOR))).alias("advantage"))


def decoupled_advantage(rewards: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Group z-scores of each reward, weighted and summed, then normalised over the batch."""
    group = Window.partitionBy("unique_id", "reward_name")
    r = F.col("reward").cast("double")
    z = rewards.withColumn("reward", (r - F.avg(r).over(group)) / F.greatest(F.stddev_pop(r).over(group), F.lit(FLOOR)))
    total = weighted_sum(z, weights)
    moments = total.agg(F.avg("scalar").alias("mean"), F.stddev_pop("scalar").alias("sd"))
    return total.join(F.broadcast(moments)).select("sample_id", "unique_id", ((F.col("scalar") - F.col("mean")) / F.greatest("sd", F.lit(FLOOR))).alias("advantage"))


def group_deviation(scalars: DataFrame) -> DataFrame:
    """Sample deviation of each group at its samples; 0 in a group of one."""
    return scalars.select("sample_id", "unique_id", F.coalesce(F.stddev_samp("scalar").over(Window.partitionBy("unique_id")), F.lit(0.0)).alias("deviation"))


def group_diagnostics(scalars: DataFrame) -> DataFrame:
    """Mean, largest and least deviation of groups, deviation of their means, share of flat groups."""
    g = scalars.groupBy("unique_id").agg(F.avg("scalar").alias("m"), F.stddev_pop("scalar").alias("sd"))
    return g.agg(F.avg("sd").alias("sd_mean"), F.max("sd").alias("sd_max"), F.min("sd").alias("sd_min"), F.stddev_pop("m").alias("mean_sd"), F.avg((F.col("sd") < FLOOR).cast("double")).alias("flat_share"))


def advantage_figures(advantages: DataFrame) -> DataFrame:
    """largest, least and mean_abs of the column advantage."""
    return advantages.agg(F.max("advantage").alias("largest"), F.min("advantage").alias("least"), F.avg(F.abs("advantage")).alias("mean_abs"))


def moments(scalars: DataFrame) -> DataFrame:
    """n, mean and sd (of the population) of the column scalar, from partial sums."""
    return scalars.agg(F.count("*").alias("n"), F.avg("scalar").alias("mean"), F.stddev_pop("scalar").alias("sd"))


def clipped(advantages: DataFrame, least: float, most: float) -> DataFrame:
    """advantages with the column advantage kept within a range."""
    return advantages.withColumn("advantage", F.least(F.greatest("advantage", F.lit(least)), F.lit(most)))


def wrong_groups(samples: DataFrame, k: int) -> DataFrame:
    """Groups that do not have k members."""
    return samples.groupBy("unique_id").agg(F.count("*").alias("n")).where(F.col("n") != k)


def cell_advantage(samples: DataFrame, penalties: DataFrame, least_deviation: float = FLOOR) -> DataFrame:
    """(sample_id, unique_id, y, x, advantage) at the cells that a sample's penalty map covers.

    The reward of a cell is minus its penalty, 0 where a sample has none, so groups are summed over covered
    cells and divided by their whole size. Sample deviation, least_deviation at least; null in a group of one.
    samples: (sample_id, unique_id); penalties: (sample_id, y, x, penalty).
    """
    cells = penalties.join(samples.hint("merge"), "sample_id").withColumn("r", -F.col("penalty"))
    sizes = samples.groupBy("unique_id").agg(F.count("*").alias("k"))
    sums = cells.groupBy("unique_id", "y", "x").agg(F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    mean, k = F.col("s") / F.col("k"), F.col("k")
    variance = F.greatest((F.col("q") - F.col("s") * mean) / F.when(k > 1, k - 1), F.lit(0.0))
    moments = sums.join(sizes.hint("merge"), "unique_id").select("unique_id", "y", "x", mean.alias("mean"), F.when(k > 1, F.greatest(F.sqrt(variance), F.lit(least_deviation))).alias("sd"))
    return cells.join(moments.hint("merge"), ["unique_id", "y", "x"]).select("sample_id", "unique_id", "y", "x", ((F.col("r") - F.col("mean")) / F.col("sd")).alias("advantage"))


def binary(preferences: DataFrame) -> DataFrame:
    """preferences (i, j, value) whose values must be 0 or 1; any other one, null too, ends the job with an error."""
    odd = F.raise_error(F.concat(F.lit("preferences are 0 or 1, not "), F.coalesce(F.col("value").cast("string"), F.lit("null")))).cast(preferences.schema["value"].dataType)
    return preferences.withColumn("value", F.when(F.col("value").isin(0, 1), F.col("value")).otherwise(odd))


def _sides(preferences: DataFrame) -> DataFrame:
    """(i, j, a, b) with i < j: the values of both sides; a missing one is 0. One shuffle."""
    low, high = F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")
    value = lambda side: F.coalesce(F.max(F.when(side, F.col("value"))), F.lit(0))
    rows = preferences.where("i != j").select(low, high, "value", (F.col("i") < F.col("j")).alias("up"))
    return rows.groupBy("i", "j").agg(value(F.col("up")).alias("a"), value(~F.col("up")).alias("b"))


def asymmetric(preferences: DataFrame) -> DataFrame:
    """(i, j) with i < j whose two values (i, j, value) differ; a missing one is 0. Empty for a symmetric matrix."""
    return _sides(preferences).where("a != b").select("i", "j")


def unbalanced(preferences: DataFrame, total: int = 0, diagonal: bool = True) -> DataFrame:
    """(i, j) with i < j whose two values do not add up to total, and, with diagonal, (i, i) whose value is not 0; a missing one is 0.

    With a total of 0 empty for an antisymmetric matrix; with 1 for one in which one of each two items is preferred.
    """
    wrong = _sides(preferences).where(F.col("a") + F.col("b") != total).select("i", "j")
    return wrong.unionByName(preferences.where("i = j and value != 0").select("i", "j")) if diagonal else wrong


def not_antisymmetric(preferences: DataFrame) -> DataFrame:
    """(i, j) with i < j whose values (i, j, value), 0 or 1, do not add up to 1; a missing side counts as 0."""
    return unbalanced(preferences, 1, diagonal=False)


def _links(preferences: DataFrame) -> DataFrame:
    """(u, v, up, down): an edge per pair of items of which at least one is preferred, from the end with fewer edges to the other.

    up is whether u is preferred to v, down the reverse. Of items with equally many edges the smaller comes first, so that no
    item has more than sqrt(2 * edges) edges that lead away from it.
    """
    both = _sides(binary(preferences)).where("a = 1 or b = 1")
    edges = written(both, "edges")
    ends = edges.select(F.explode(F.array("i", "j")).alias("n")).groupBy("n").agg(F.count("*").alias("d"))
    degree = lambda c: ends.select(F.col("n").alias(c), F.col("d").alias(f"d{c}"))
    known = edges.join(degree("i").hint("merge"), "i").join(degree("j").hint("merge"), "j")
    first = F.struct("di", "i") < F.struct("dj", "j")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return known.select(pick("i", "j").alias("u"), pick("j", "i").alias("v"), (pick("a", "b") == 1).alias("up"), (pick("b", "a") == 1).alias("down"))


def transitive_triples(preferences: DataFrame) -> DataFrame:
    """(i, j, k), all distinct, where i is preferred to j, j to k and i to k.

    Triangles are found at the end with the fewest edges: its edges that lead away meet in pairs, and a third edge closes them. An item with very
    many edges begins few of them, so that it makes no square of their number.
    """
    e = written(_links(preferences), "links")
    side = lambda p: e.select("u", *[F.col(c).alias(f"{p}{c}") for c in ("v", "up", "down")])
    wedges = side("x").join(side("y").hint("merge"), "u").where("xv < yv")
    far = e.select(F.least("u", "v").alias("xv"), F.greatest("u", "v").alias("yv"), F.when(F.col("u") < F.col("v"), F.col("up")).otherwise(F.col("down")).alias("xy"), F.when(F.col("u") < F.col("v"), F.col("down")).otherwise(F.col("up")).alias("yx"))
    t = wedges.join(far.hint("merge"), ["xv", "yv"])
    over = {("u", "xv"): "xup", ("xv", "u"): "xdown", ("u", "yv"): "yup", ("yv", "u"): "ydown", ("xv", "yv"): "xy", ("yv", "xv"): "yx"}
    ways = [F.when(F.col(over[i, j]) & F.col(over[j, k]) & F.col(over[i, k]), F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.col(k).alias("k"))) for i, j, k in itertools.permutations(("u", "xv", "yv"))]
    return t.select(F.explode(F.array_compact(F.array(*ways))).alias("t")).select("t.*")


def _paths(preferences: DataFrame) -> DataFrame:
    """(j, paths): in how many ways an item lies between two others that it is preferred to and that are preferred to it; only degrees are counted."""
    s = _sides(preferences)
    ends = s.select(F.explode(F.array(F.struct(F.col("i").alias("j"), F.col("b").alias("won"), F.col("a").alias("lost")), F.struct("j", F.col("a").alias("won"), F.col("b").alias("lost")))).alias("e")).select("e.*")
    n = ends.groupBy("j").agg(F.sum("won").alias("over"), F.sum("lost").alias("under"), F.sum(F.col("won") * F.col("lost")).alias("mutual"))
    return n.select("j", (F.col("over") * F.col("under") - F.col("mutual")).cast("long").alias("paths"))


def violations(preferences: DataFrame) -> DataFrame:
    """(j, paths, closed): for each item between others the paths through it and how many of them a direct preference closes.

    The matrix is transitive where the two are equal for all items. Paths are products of degrees and closed ones come
    from triangles, so that none is listed.
    """
    closed = transitive_triples(preferences).groupBy("j").agg(F.count("*").alias("closed"))
    return _paths(preferences).where("paths > 0").join(closed.hint("merge"), "j", "left").select("j", "paths", F.coalesce("closed", F.lit(0)).alias("closed"))


def intransitive(preferences: DataFrame) -> DataFrame:
    """(i, j, k), all distinct, where i is preferred to j and j to k but not i to k; values are 0 or 1, a missing one is 0.

    Paths are listed only through items that have such a triple; a hub whose paths are all closed is never spread out.
    """
    open_ = written(violations(preferences).where("closed < paths").select("j"), "open")
    over = preferences.where("value = 1 and i != j").select("i", "j")
    into = over.join(open_.hint("merge"), "j", "left_semi")
    away = over.select(F.col("i").alias("j"), F.col("j").alias("k")).join(open_.hint("merge"), "j", "left_semi")
    chains = into.join(away.hint("merge"), "j").where("i != k")
    return chains.join(over.select("i", F.col("j").alias("k")).hint("merge"), ["i", "k"], "left_anti").select("i", "j", "k")
