"""Evaluation metrics over outcome and count tables. Ratios with a divisor of 0 are 0; results have 6 places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def precision_recall(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1")]


def instance_metrics(found: DataFrame, *keys: str) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 per label and overall (``all``), for each value of keys."""
    n = lambda k: F.sum(F.when(F.col("outcome") == k, 1).otherwise(0)).cast("long").alias(k)
    by_label = found.groupBy(*keys, "label").agg(n("tp"), n("fp"), n("fn"))
    add = lambda k: F.sum(k).cast("long").alias(k)
    # the labels and their sum as sets of one aggregate, over the few rows that are counted already
    sets = by_label.groupingSets([[*keys, "label"], [*keys]], *keys, "label").agg(F.grouping("label").alias("_all"), add("tp"), add("fp"), add("fn"))
    both = sets.withColumn("label", F.when(F.col("_all") == 1, "all").otherwise(F.col("label")))
    return both.select(*keys, "label", "tp", "fp", "fn", *precision_recall(F.col("tp"), F.col("fp"), F.col("fn")))


def image_confusion(images: DataFrame) -> DataFrame:
    """Defect against no defect; images has booleans has_gt and has_pred."""
    n = lambda g, p: F.count_if((F.col("has_gt") == g) & (F.col("has_pred") == p))
    c = images.agg(n(True, True).alias("tp"), n(False, True).alias("fp"), n(True, False).alias("fn"), n(False, False).alias("tn"))
    return c.select("*", F.round(ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 6).alias("accuracy"), *precision_recall(F.col("tp"), F.col("fp"), F.col("fn")))


def count_metrics(counts: DataFrame) -> DataFrame:
    """Totals, means, mean absolute error, exact share and correlation of n_gt and n_pred (0 where one does not vary)."""
    g, p = F.col("n_gt"), F.col("n_pred")
    flat = (F.stddev_pop(g) == 0) | (F.stddev_pop(p) == 0)
    return counts.agg(
        F.count("*").alias("n_images"), F.sum(g).alias("total_gt"), F.sum(p).alias("total_pred"), F.round(F.avg(g), 6).alias("mean_gt"), F.round(F.avg(p), 6).alias("mean_pred"),
        F.round(F.avg(F.abs(g - p)), 6).alias("mae"), F.round(F.avg((g == p).cast("double")), 6).alias("exact_share"), F.round(F.when(flat, 0.0).otherwise(F.corr(g, p)), 6).alias("pearson"),
    )


def description_similarity(pairs: DataFrame, *keys: str, shares: tuple[float, ...] = (0.3, 0.5, 0.7)) -> DataFrame:
    """Mean, median and shares at or above each threshold of the column ``similarity`` of matched pairs, for each value of keys."""
    s = F.col("similarity")
    reached = [F.round(F.avg((s >= t).cast("double")), 6).alias(f"share_{round(100 * t)}") for t in shares]
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(s), 6).alias("mean"), F.round(F.percentile(s, 0.5), 6).alias("median"), *reached)


def description_counts(pairs: DataFrame, counts: DataFrame, gt: str = "gt_desc", pred: str = "pred_desc") -> DataFrame:
    """matched, unmatched_gt, unmatched_pred, missing_gt and missing_pred: matched pairs, boxes that are in none, and pairs whose description is null or empty.

    pairs: image_id and the descriptions of matched boxes; counts: image_id, n_gt, n_pred of all images. One row per side is joined, not per pair.
    """
    none = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) == "")
    of_pairs = pairs.agg(F.count("*").alias("matched"), none(gt).alias("missing_gt"), none(pred).alias("missing_pred"))
    of_all = counts.agg(F.coalesce(F.sum("n_gt"), F.lit(0)).alias("g"), F.coalesce(F.sum("n_pred"), F.lit(0)).alias("p"))
    both = of_pairs.join(F.broadcast(of_all))  # one row each
    return both.select("matched", (F.col("g") - F.col("matched")).alias("unmatched_gt"), (F.col("p") - F.col("matched")).alias("unmatched_pred"), "missing_gt", "missing_pred")


def detection_aware_mean(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Mean over all images of the total similarity over the larger box count; counts: image_id, n_gt, n_pred."""
    total = pairs.groupBy("image_id").agg(F.sum("similarity").alias("total"))
    per = F.coalesce("total", F.lit(0.0)) / F.greatest("n_gt", "n_pred", F.lit(1))
    return counts.join(total.hint("merge"), "image_id", "left").agg(F.count("*").alias("n_images"), F.round(F.avg(per), 6).alias("mean"))


def severity(importance: Column, cuts: tuple[float, float] = (40, 70)) -> Column:
    """Negligible, moderate or critical by the cut points; null stays null."""
    return F.when(importance < cuts[0], "negligible").when(importance < cuts[1], "moderate").when(importance.isNotNull(), "critical")


def label_f1(pairs: DataFrame, *keys: str, classes: tuple[str, ...] = ("artifact", "misalignment"), weight: str | None = None) -> DataFrame:
    """tp, fp, fn and F1 of each class among matched pairs (gt_label, pred_label): a wrong label is fn for the true and fp for the predicted class.

    weight names a column with the number of pairs that a row stands for; without it a row is one pair.
    """
    each = pairs.select(*keys, "gt_label", "pred_label", (F.col(weight) if weight else F.lit(1)).cast("long").alias("_n"), F.explode(F.array(*map(F.lit, classes))).alias("class"))
    g, p = F.col("gt_label") == F.col("class"), F.col("pred_label") == F.col("class")
    sum_if = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0))
    n = each.groupBy(*keys, "class").agg(sum_if(g & p).alias("tp"), sum_if(~g & p).alias("fp"), sum_if(g & ~p).alias("fn"))
    return n.select(*keys, "class", "tp", "fp", "fn", *precision_recall(F.col("tp"), F.col("fp"), F.col("fn")))


def extended_confusion(flags: DataFrame, *keys: str) -> DataFrame:
    """tp, fp, fn, tn with specificity and balanced accuracy of (keys, gt, pred), booleans."""
    n = lambda g, p: F.count_if((F.col("gt") == g) & (F.col("pred") == p))
    c = flags.groupBy(*keys).agg(n(True, True).alias("tp"), n(False, True).alias("fp"), n(True, False).alias("fn"), n(False, False).alias("tn"))
    specificity, recall = ratio(F.col("tn"), F.col("tn") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("*", F.round(specificity, 6).alias("specificity"), F.round((specificity + recall) / 2, 6).alias("balanced_accuracy"))


def class_flags(per_class: DataFrame, *keys: str) -> DataFrame:
    """(keys, class, gt, pred) of rows (keys, class, gt, pred), and one for ``overall``, true where a class is."""
    either = per_class.groupBy(*keys).agg(F.bool_or("gt").alias("gt"), F.bool_or("pred").alias("pred")).withColumn("class", F.lit("overall"))
    return per_class.select(*keys, "class", "gt", "pred").unionByName(either.select(*keys, "class", "gt", "pred"))


def merged_summaries(parts: list[DataFrame], key: str) -> DataFrame:
    """Partial summaries in one; of a name in several the last part's row stays."""
    every = None
    for i, p in enumerate(parts):
        one = p.withColumn("_source", F.lit(i))
        every = one if every is None else every.unionByName(one)
    columns = [c for c in parts[0].columns if c != key]
    return every.groupBy(key).agg(F.max_by(F.struct(*columns), "_source").alias("_r")).select(key, "_r.*")


def summary_sheet(**tables: DataFrame) -> DataFrame:
    """(sheet, item, metric, value): the numbers of several metric tables in one; their other columns, joined by blanks, name the item."""
    out = None
    for name, df in tables.items():
        numbers = [f.name for f in df.schema.fields if f.dataType.typeName() in ("long", "integer", "double", "float")]
        keys = [c for c in df.columns if c not in numbers]
        item = F.concat_ws(" ", *keys) if keys else F.lit("")
        long = df.select(F.lit(name).alias("sheet"), item.alias("item"), F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in numbers])).alias("m")).select("sheet", "item", "m.*")
        out = long if out is None else out.unionByName(long)
    return out


def ranking_summary(ranks: DataFrame, methods: list[str]) -> DataFrame:
    """(method, n, mean_rank, first, second, third) over items that rank all methods; ranks: item, method, rank."""
    whole = ranks.withColumn("_n", F.count("*").over(Window.partitionBy("item"))).where(F.col("_n") == len(methods))
    share = lambda k: F.round(F.avg((F.col("rank") == k).cast("double")), 6)
    return whole.groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg("rank"), 6).alias("mean_rank"), share(1).alias("first"), share(2).alias("second"), share(3).alias("third"))


def win_rates(ranks: DataFrame, methods: list[str]) -> DataFrame:
    """(method, other, rate): how often a method has the better rank, ties counting half, over items that rank all methods."""
    per = ranks.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("method", "rank"))).alias("r")).where(F.size("r") == len(methods))
    pairs = F.array(*[F.struct(F.lit(a).alias("method"), F.lit(b).alias("other"), F.when(F.col("r")[a] < F.col("r")[b], 1.0).when(F.col("r")[a] == F.col("r")[b], 0.5).otherwise(0.0).alias("w")) for a in methods for b in methods if a != b])
    return per.select(F.explode(pairs).alias("p")).groupBy("p.method", "p.other").agg(F.round(F.avg("p.w"), 6).alias("rate"))


def unit_means(vectors: DataFrame, key: str) -> DataFrame:
    """(key, place, value): mean of the vectors (key, mask, embedding) whose mask is true, scaled to length 1; all zeros stay."""
    e = vectors.where("mask").select(key, F.posexplode("embedding").alias("place", "v"))
    mean = e.groupBy(key, "place").agg(F.avg(F.col("v").cast("double")).alias("m"))
    length = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(key)))
    return mean.select(key, "place", F.when(length > 0, F.col("m") / length).otherwise(0.0).alias("value"))
