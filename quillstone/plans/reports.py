"""Registered queries on projections, areas, labels, rankings, rewards and hooks, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quillstone.functions import paths, records, responses, text
from quillstone.functions.geometry import box, iou
from quillstone.operators import advantage, assignment, hooks, matching, metrics, projection, regions, rows, spatial
from quillstone.plans import dialects
from quillstone.plans.dialects import TEXT_CTES, texts
from quillstone.plans.oracles import COUNTS, OUTCOMES, PAIRS, matched, prf
from quillstone.sources import files
from quillstone.sources.fixtures import fixture, with_clause
from quillstone.sources.tables import read_table

QUERIES: dict = {}
GRID = 8
METHODS = ["sdg", "imdoc", "fixed"]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def images_of(spark, sf_dir, *columns):
    return fixture(spark, sf_dir, "fx_images").select("image_id", *columns)


def sides(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_gt"), fixture(spark, sf_dir, "fx_pred")


# sources --------------------------------------------------------------------------------------------------------


@query
def s05_csv_round_trip(spark, sf_dir):
    d, path = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), files.work_path(spark, "csv")
    files.write_csv(d, path)
    return spark.read.option("header", True).schema(d.schema).csv(path)


@query
def s02_prompts(spark, sf_dir):
    path = files.work_path(spark, "prompts")
    fixture(spark, sf_dir, "fx_images").select(F.when(F.col("image_id") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "caption", F.lit("  "))).alias("value")).write.text(path)
    return files.read_prompts(spark, txt=path).groupBy("prompt").agg(F.count("*").alias("n"))


@query
def s04_routed(spark, sf_dir):
    path = files.work_path(spark, "routed")
    files.write_routed(fixture(spark, sf_dir, "fx_images").select("image_id", "gen"), F.col("gen"), path)
    return spark.read.schema("image_id long, gen string, route string").json(path).groupBy("route").agg(F.count("*").alias("n"), F.count_if(F.col("route") == F.col("gen")).alias("same"))


@query
def s06_image_sizes(spark, sf_dir):
    """Width and height from image headers that are made of the orders' numbers."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 4000).alias("w"), (1 + F.col("o_custkey") % 3000).alias("h"))
    number = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    magic = F.when(F.col("o_orderkey") % 7 == 0, F.unhex(F.lit("FFD8FFE000104A46"))).otherwise(F.unhex(F.lit("89504E470D0A1A0A")))
    content = F.concat(magic, F.unhex(F.lit("0000000D49484452")), number("w"), number("h"))
    sizes = files.image_sizes(o.select(F.col("o_orderkey").cast("string").alias("path"), content.alias("content")))
    return sizes.groupBy("width").agg(F.count("*").alias("n"), F.sum("height").alias("heights"))


@query
def s07_report(spark, sf_dir):
    path = files.work_path(spark, "report")
    gt, pred = sides(spark, sf_dir)
    """The tree of a report and the pairs that fared worst, both written and read back."""
    from quillstone.plans.catalog import _counts
    from quillstone.plans.scores import m09_worst_pairs

    def tree(df, section, key=None):
        names = [c for c in df.columns if c != key]
        at = lambda n: F.array(F.lit(section), *([F.col(key)] if key else []), F.lit(n))
        return df.select(F.explode(F.array(*[F.struct(at(n).alias("path"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("m.*")

    sheet = metrics.instance_metrics(matching.image_outcomes(gt, pred, 0.5))
    figures = tree(sheet, "instances", "label").unionByName(tree(metrics.count_metrics(_counts(spark, sf_dir)), "counts"))
    worst = m09_worst_pairs(spark, sf_dir)
    files.write_report(figures, worst, path)
    leaves, pairs = files.read_report(spark, path, worst.schema)
    named = pairs.select(F.concat_ws("/", F.lit("worst"), "image_id", "gt_idx").alias("path"), F.col("similarity").alias("value"))
    return leaves.select(F.array_join("path", "/").alias("path"), F.round(F.col("value").cast("double"), 6).alias("value")).unionByName(named)


# projections ----------------------------------------------------------------------------------------------------


@query
def p01_fields(spark, sf_dir):
    return projection.project_fields(fixture(spark, sf_dir, "fx_images"), ["image_id", "caption", "raw_response"])


@query
def p04_split(spark, sf_dir):
    yes, no = projection.split_on(fixture(spark, sf_dir, "fx_images").select("image_id", F.when(F.col("image_id") % 3 == 0, F.upper("filepath")).otherwise(F.col("filepath")).alias("filepath")), "filepath", "test")
    return yes.select("image_id", F.lit("with").alias("part")).unionByName(no.select("image_id", F.lit("without").alias("part")))


@query
def p07_unique_names(spark, sf_dir):
    short = F.when(F.col("image_id") % 3 == 0, paths.basename(F.col("filepath"))).when(F.col("image_id") % 3 == 1, F.concat(F.lit("d/"), paths.basename(F.col("filepath")))).otherwise(F.col("filepath"))
    return fixture(spark, sf_dir, "fx_images").select("image_id", paths.unique_name(short).alias("name"))


@query
def p09_existing(spark, sf_dir):
    images = images_of(spark, sf_dir, "filepath")
    listing = images.where("image_id % 4 != 0").select(F.col("filepath").alias("path"))
    return projection.filter_existing(images, "filepath", listing).select("image_id")


@query
def p10_offline(spark, sf_dir):
    d = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring("text", 1, F.col("turn") * 4 + 5).alias("ann_response"))
    return projection.offline_responses(d).select("conv_id", "turn", F.length("response").alias("n"))


@query
def p11_cap(spark, sf_dir):
    """Images from position 100 on in the order of a hash, half of all at most."""
    images = images_of(spark, sf_dir)
    h = F.md5(F.col("image_id").cast("string"))
    return projection.cap(images, 100, images.count() // 2, h, F.col("image_id"))


@query
def p13_layouts(spark, sf_dir):
    b = F.struct(F.array(*[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]).alias("box_2d"), "label")
    per = fixture(spark, sf_dir, "fx_gt").groupBy("image_id").agg(F.collect_list(b).alias("b"))
    of = lambda label: F.when(F.col("image_id") % 2 == 0, F.filter("b", lambda x: x["label"] == label))
    shaped = per.select("image_id", of("misalignment").alias("misalignment_boxes"), F.when(F.col("image_id") % 6 != 0, of("artifact")).alias("artifact_boxes"), F.when(F.col("image_id") % 5 != 0, F.transform("b", lambda x: x["box_2d"])).alias("boxes"))
    n = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long").alias(c)
    return projection.ground_truth_layout(shaped).select("image_id", n("gt_misalignment"), n("gt_artifact"), n("gt_boxes"))


@query
def p14_merged(spark, sf_dir):
    images = images_of(spark, sf_dir, "caption")
    one = images.where("image_id % 2 = 0").select("image_id", F.concat(F.lit("p"), "image_id").alias("prediction"))
    two = images.where("image_id % 3 = 0").select("image_id", F.concat(F.lit("h"), "image_id").alias("artifact_heatmap"), F.concat(F.lit("r"), "image_id").alias("response"))
    out = projection.merged_sources(images, "image_id", [(one, {"prediction": "imdoc_prediction"}), (two, {"artifact_heatmap": "imdoc_artifact", "response": "sdg_response"})])
    return out.select("image_id", "imdoc_prediction", "imdoc_artifact", "sdg_response")


@query
def w07_padded(spark, sf_dir):
    per = fixture(spark, sf_dir, "fx_gt").groupBy("image_id").agg(F.collect_list("label").alias("labels"))
    every = images_of(spark, sf_dir).join(per.hint("merge"), "image_id", "left")
    return projection.padded(every, "labels").select("image_id", F.size("labels").cast("long").alias("n"))


@query
def j01_aligned(spark, sf_dir):
    """Tables that hold the same images are joined; see aligned() for those that do not."""
    a, b = images_of(spark, sf_dir, "caption"), images_of(spark, sf_dir, "split")
    return projection.aligned(a, b, "image_id").groupBy("split").agg(F.count("*").alias("n"), F.min("caption").alias("first"))


@query
def j04_lenient(spark, sf_dir):
    gt, pred = sides(spark, sf_dir)
    one = lambda df, name: df.groupBy("image_id").agg(F.count("*").alias(name))
    met = rows.joined_leniently(one(gt, "n_gt"), one(pred, "n_pred"), "image_id", [F.col("image_id")], [F.desc("image_id")])
    return met.select("image_id", "n_gt", "n_pred")


@query
def r11_metadata(spark, sf_dir):
    out = projection.metadata_map(fixture(spark, sf_dir, "fx_images").withColumn("gen", F.when(F.col("image_id") % 4 != 1, F.col("gen"))), ["image_id", "filepath"])
    return out.select("image_id", F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("metadata"))


# texts and vectors ----------------------------------------------------------------------------------------------


@query
def k02_labels(spark, sf_dir):
    label = F.element_at(F.array(*map(F.lit, [" Misaligned ", "ARTIFACTS", "Both", "", "text misalignment artifact"])), (F.col("gt_idx") % 5 + 1).cast("int"))
    return fixture(spark, sf_dir, "fx_gt").select(text.normal_label(label).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query
def x04_dots(spark, sf_dir):
    """Cosine of each vector with the mean direction of its label, by norms and, of unit vectors, by the dot product."""
    e = read_table(spark, sf_dir, "embeddings")
    norm = F.sqrt(text.dot(F.col("embedding"), F.col("embedding")))
    unit = e.select("vec_id", "label", "embedding", F.transform("embedding", lambda v: v.cast("double") / norm).alias("unit"))
    first = unit.groupBy("label").agg(F.min_by("unit", "vec_id").alias("other"))
    both = unit.join(first.hint("merge"), "label")
    return both.select("vec_id", F.round(text.cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"), F.round(text.dot(F.col("unit"), F.col("other")), 5).alias("dot"))


@query
def x06_sub_prompts(spark, sf_dir):
    t = F.concat(F.lit("A view of "), "caption", F.lit(". [TOP-LEFT]: a cat. [BOTTOM-RIGHT]: two "), "gen", F.when(F.col("image_id") % 2 == 0, ".").otherwise(" "))
    parts = fixture(spark, sf_dir, "fx_images").select("image_id", F.posexplode(text.sub_prompts(t)).alias("place", "part"))
    return parts


@query
def x07_grid_sizes(spark, sf_dir):
    t = F.when(F.col("image_id") % 3 == 0, F.concat(F.lit("a "), F.col("image_id") % 7 + 1, F.lit(" x"), F.col("image_id") % 5 + 1, F.lit(" grid 9x9"))).when(F.col("image_id") % 3 == 1, F.concat(F.col("image_id") % 4 + 1, F.lit("⨉ 3"))).otherwise(F.col("caption"))
    return fixture(spark, sf_dir, "fx_images").select("image_id", text.grid_size(t).alias("g")).select("image_id", F.col("g.rows").cast("long").alias("rows"), F.col("g.columns").cast("long").alias("columns"))


@query
def x09_judged(spark, sf_dir):
    i = F.col("image_id")
    t = F.concat(F.lit("Alignment Score (1-5): "), i % 50 / 10, F.lit("\nCoherence Score: "), i % 5, F.when(i % 4 != 0, F.concat(F.lit("\nStyle Score x: "), i % 3, F.lit(".5"))).otherwise(F.lit("\nStyle: 3")))
    s = fixture(spark, sf_dir, "fx_images").select("image_id", F.round(text.judged_score(t), 6).alias("score"))
    return s.groupBy("score").agg(F.count("*").alias("n"))


@query
def x10_share_of_real(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    v = lambda k: F.col("embedding")[k].cast("double") * 40
    return e.select("vec_id", F.round(text.share_of_real(v(0), v(1), v(2), v(3)), 6).alias("share"))


# boxes, areas and labels ----------------------------------------------------------------------------------------


@query
def g11_iou_eps(spark, sf_dir):
    gt, pred = sides(spark, sf_dir)
    return matching.candidate_pairs(gt, pred, 0.0).select("image_id", "gt_idx", "pred_idx", F.round(iou(box("gt_"), box("pred_"), eps=1e-9), 6).alias("iou"))


@query
def g13_union_iou(spark, sf_dir):
    gt, pred = sides(spark, sf_dir)
    both = regions.class_boxes(images_of(spark, sf_dir), gt, pred)
    u = both.select("image_id", "class", regions.union_iou(F.col("gt"), F.col("pred")).alias("u"))
    return u.select("image_id", "class", F.round("u.iou", 6).alias("iou"), "u.both_empty")


@query
def m15_union_report(spark, sf_dir):
    gt, pred = sides(spark, sf_dir)
    return regions.union_report(regions.class_boxes(images_of(spark, sf_dir), gt, pred))


def _heat(spark, sf_dir, name):
    """Heat of the cells that boxes cover: the largest importance as a share."""
    return spatial.cells(fixture(spark, sf_dir, name).where("label != 'both'"), GRID).groupBy("image_id", "label", "y", "x").agg((F.max("importance") / 100.0).alias("heat"))


@query
def g15_hot_regions(spark, sf_dir):
    return regions.hot_regions(_heat(spark, sf_dir, "fx_gt"), GRID, 0.5)


@query
def g16_grid_cells(spark, sf_dir):
    i = F.col("image_id")
    grids = images_of(spark, sf_dir).select("image_id", (i % 3).alias("rows"), (1 + i % 4).alias("columns"), (500 + i % 13).alias("width"), (400 + i % 7).alias("height"))
    return regions.grid_cells(grids).select("image_id", "cell", "left", "upper", "right", "lower")


@query
def m14_heat_sweep(spark, sf_dir):
    top = lambda name: _heat(spark, sf_dir, name).groupBy("image_id", "label").agg(F.max("heat").alias(name))
    every = images_of(spark, sf_dir).select("image_id", F.explode(F.array(F.lit("artifact"), F.lit("misalignment"))).alias("label"))
    both = every.join(top("fx_gt").hint("merge"), ["image_id", "label"], "left").join(top("fx_pred").hint("merge"), ["image_id", "label"], "left").na.fill(0.0)
    flags = both.select("image_id", F.col("label").alias("class"), F.explode(F.array(F.lit(0.0), F.lit(0.1), F.lit(0.33))).alias("threshold"), "fx_gt", "fx_pred").select("image_id", "class", "threshold", (F.col("fx_gt") > F.col("threshold")).alias("gt"), (F.col("fx_pred") > F.col("threshold")).alias("pred"))
    return metrics.extended_confusion(metrics.class_flags(flags, "image_id", "threshold"), "threshold", "class")


@query
def m13_extended_confusion(spark, sf_dir):
    gt, pred = sides(spark, sf_dir)
    both = regions.class_boxes(images_of(spark, sf_dir), gt, pred)
    flags = both.select("image_id", "class", (F.coalesce(F.size("gt"), F.lit(0)) > 0).alias("gt"), (F.coalesce(F.size("pred"), F.lit(0)) > 0).alias("pred"))
    return metrics.extended_confusion(metrics.class_flags(flags, "image_id"), "class")


def _agnostic(spark, sf_dir, pred):
    m = matching.matched_boxes(fixture(spark, sf_dir, "fx_gt"), pred, 0.1, "importance", labels=False)
    return m.select("image_id", text.normal_label(F.col("g.label")).alias("gt_label"), text.normal_label(F.col("p.label")).alias("pred_label"), F.col("g.importance").cast("int").alias("gt_importance"), F.col("p.importance").cast("int").alias("pred_importance"))


@query
def m10_label_f1(spark, sf_dir):
    return metrics.label_f1(_agnostic(spark, sf_dir, fixture(spark, sf_dir, "fx_pred")))


def _vectors(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").select(F.concat(F.lit("d"), "vec_id").alias("text"), F.col("embedding").alias("vector"))


def _described_alike(spark, sf_dir, pred):
    """(gt_label, pred_label, gt_importance, pred_importance, n): how many matched pairs are alike in labels and descriptions, which importance names."""
    return _agnostic(spark, sf_dir, pred).groupBy("gt_label", "pred_label", "gt_importance", "pred_importance").agg(F.count("*").alias("n"))


def _cosines(spark, sf_dir, alike):
    """(gt_label, n, cosine) of the pairs that are alike whose descriptions both have a vector; each two descriptions are compared once."""
    m = alike.select("gt_label", F.when(F.col("gt_importance") % 9 != 0, F.concat(F.lit("d"), "gt_importance")).alias("a"), F.concat(F.lit("d"), "pred_importance").alias("b"), "n")
    m = m.where("a is not null and b is not null").groupBy("gt_label", "a", "b").agg(F.sum("n").alias("n"))
    v = _vectors(spark, sf_dir)
    both = projection.text_vectors(projection.text_vectors(m, "a", v, "va"), "b", v, "vb").where("va is not null and vb is not null")
    return both.select("gt_label", "n", text.cosine(F.col("va"), F.col("vb")).alias("cosine"))


def _mean_cosine():
    return F.round(F.sum(F.col("n") * F.col("cosine")) / F.sum(F.when(F.col("cosine").isNotNull(), F.col("n"))), 5)


@query
def m11_description_cosine(spark, sf_dir):
    c = _cosines(spark, sf_dir, _described_alike(spark, sf_dir, fixture(spark, sf_dir, "fx_pred")))
    return c.groupBy("gt_label").agg(F.sum("n").alias("n"), _mean_cosine().alias("mean"))


@query
def m12_experiments(spark, sf_dir):
    """Label F1 and description cosine of two experiments: all predicted boxes, and those with an even index."""
    pred, out = fixture(spark, sf_dir, "fx_pred"), None
    for name, df in (("all", pred), ("even", pred.where("pred_idx % 2 = 0"))):
        alike = files.written(_described_alike(spark, sf_dir, df), "alike")
        f1 = metrics.label_f1(alike, weight="n").select("class", "f1")
        cosine = _cosines(spark, sf_dir, alike).groupBy(F.col("gt_label").alias("class")).agg(_mean_cosine().alias("cosine"))
        one = f1.join(cosine.hint("merge"), "class", "left").select(F.lit(name).alias("experiment"), "class", "f1", F.coalesce("cosine", F.lit(0.0)).alias("cosine"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def m16_resolutions(spark, sf_dir):
    """How many images there are, how many have no header that is read, and how many sizes differ."""
    o = read_table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 400).alias("w"), (F.col("o_custkey") % 30).alias("h"))
    return o.agg(F.count("*").alias("total"), F.count_if(F.col("w").isNull()).alias("errors"), F.count_distinct("w", "h").alias("sizes"))


@query
def m17_merged_summaries(spark, sf_dir):
    r = fixture(spark, sf_dir, "fx_rewards")
    one = lambda df, k: df.groupBy("reward_name").agg(F.count("*").alias("n"), F.lit(k).alias("part"))
    return metrics.merged_summaries([one(r, "first"), one(r.where("reward_name != 'key'"), "second")], "reward_name")


@query
def m18_clean_accuracy(spark, sf_dir):
    from quillstone.plans.catalog import _counts

    clean = _counts(spark, sf_dir).where("n_gt = 0")
    return clean.agg(F.count("*").alias("n"), F.round(F.avg((F.col("n_pred") == 0).cast("double")), 6).alias("accuracy"))


@query
def m19_summary_sheet(spark, sf_dir):
    gt, pred = sides(spark, sf_dir)
    found = matching.image_outcomes(gt, pred, 0.5)
    return metrics.summary_sheet(classes=metrics.instance_metrics(found).drop("precision", "recall"), thresholds=matching.swept(gt, pred, (0.1, 0.5)).withColumn("threshold", F.format_number("threshold", 2)))


@query
def m07_reply_quality(spark, sf_dir):
    """Degenerate, failed and parsed replies among texts of many forms, some made degenerate by digits before them or by U+FFFD."""
    i = F.col("image_id")
    r = texts(spark, sf_dir).select("image_id", F.when(i % 5 == 0, F.concat(F.repeat(F.lit("7"), 400), "reply")).when(i % 11 == 0, F.repeat(F.lit("\ufffd"), 101)).otherwise(F.col("reply")).alias("reply"))
    kind = F.when(records.degenerate(F.col("reply")), "degenerate").when(responses.parse_eval(F.col("reply")).isNull(), "failed").otherwise("parsed")
    return r.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query
def r02_messages(spark, sf_dir):
    d = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"), F.max_by("text", "turn").alias("last"))
    m = d.select("conv_id", records.sft_messages(F.col("first"), F.col("last")).alias("m"))
    return m.select("conv_id", F.posexplode("m").alias("place", "m")).select("conv_id", "place", "m.role", F.md5("m.content").alias("digest"))


@query
def p08_first_truthy(spark, sf_dir):
    c = F.when(F.col("image_id") % 3 == 0, "").when(F.col("image_id") % 3 == 1, None).otherwise(F.col("caption"))
    return fixture(spark, sf_dir, "fx_images").select("image_id", text.first_truthy(c, F.nullif(F.col("split"), F.lit("test")), F.lit("none")).alias("value"))


@query
def g02_coordinates(spark, sf_dir):
    """Images whose boxes all have corners in range and order, whatever their labels; y1 moved so that some fail."""
    b = F.struct(F.array(F.col("x0"), "y0", "x1", F.when(F.col("gt_idx") == 3, F.col("y0")).otherwise(F.col("y1"))).cast("array<double>").alias("box_2d"), F.lit("other").alias("label"))
    per = fixture(spark, sf_dir, "fx_gt").groupBy("image_id").agg(F.collect_list(b).alias("b"))
    return images_of(spark, sf_dir).join(per.hint("merge"), "image_id", "left").groupBy(records.valid_boxes(F.col("b"), None).alias("valid")).agg(F.count("*").alias("n"))


@query
def g06_think_blocks(spark, sf_dir):
    """How many texts lose a think block."""
    r = texts(spark, sf_dir).select(F.replace("reply", F.lit("</think>"), F.when(F.col("image_id") % 2 == 0, "</think>\n").otherwise("</think>")).alias("t"))
    return r.agg(F.count("*").alias("n"), F.count_if(text.strip_think(F.col("t")) != F.col("t")).alias("changed"), F.sum(F.length(text.strip_think(F.col("t")))).alias("length"))


@query
def x05_unit_means(spark, sf_dir):
    """Mean vector of the unmasked vectors of a label, scaled to length 1."""
    e = read_table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 4 != 0).alias("mask"), "embedding")
    return metrics.unit_means(e, "label").select("label", "place", F.round("value", 5).alias("value"))


@query
def k05_optimal_costs(spark, sf_dir):
    """Total cost of the optimal assignment of each image with boxes on both sides: 2 for each pair that no label allows, else less its DIoU."""
    gt, pred = sides(spark, sf_dir)
    m = assignment.optimal_matches(gt, pred).groupBy("image_id").agg(F.count("*").alias("k"), F.sum("diou").alias("near"))
    n = lambda df, name: df.groupBy("image_id").agg(F.count("*").alias(name))
    both = n(gt, "a").join(n(pred, "b").hint("merge"), "image_id").join(m.hint("merge"), "image_id", "left").na.fill(0)
    return both.select("image_id", F.round(assignment.MISMATCH * (F.least("a", "b") - F.col("k")) - F.col("near"), 6).alias("cost"))


# rankings -------------------------------------------------------------------------------------------------------


def _ranks(spark, sf_dir):
    """(item, method, rank) of three methods by hash; ties where the first digits are equal, some items without all methods."""
    per = rows.permuted(images_of(spark, sf_dir), "image_id", METHODS, "rank").select(F.col("image_id").alias("item"), F.posexplode("order").alias("place", "method"))
    rank = F.when((F.col("item") % 6 == 0) & (F.col("place") == 1), 1).otherwise(F.col("place") + 1)
    return per.where("item % 10 != 3 or place != 2").select("item", "method", rank.alias("rank"))


@query
def r05_rankings(spark, sf_dir):
    return metrics.ranking_summary(_ranks(spark, sf_dir), METHODS)


@query
def r05_win_rates(spark, sf_dir):
    return metrics.win_rates(_ranks(spark, sf_dir), METHODS)


@query
def r06_ranking_export(spark, sf_dir):
    shown = rows.permuted(images_of(spark, sf_dir), "image_id", METHODS, "blind")
    named = F.map_from_arrays(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.col("order"))
    seconds = F.round((F.col("image_id") * 977 % 100_000) / 1000.0).cast("long")
    return shown.select("image_id", named["A"].alias("a"), named["C"].alias("c"), F.when(F.col("image_id") % 8 != 0, seconds).alias("duration_seconds"))


@query
def r07_blind_manifest(spark, sf_dir):
    shown = rows.permuted(images_of(spark, sf_dir, "filepath"), "image_id", METHODS, "blind")
    name = paths.unique_name(F.col("filepath"))
    return shown.select("image_id", F.concat(F.lit("images/"), name, F.lit("_original.jpg")).alias("original"), F.array_join(F.transform("order", lambda m: F.concat(F.lit("images/"), name, F.lit("_"), m, F.lit(".jpg"))), ",").alias("edits"))


@query
def r01_templates(spark, sf_dir):
    records.TEMPLATES.update(short="Rate {caption}", long='Rate {caption} as {{"score": 0}}')
    images = fixture(spark, sf_dir, "fx_images").select("image_id", "caption")
    return images.select("image_id", records.filled(records.template("short"), F.col("caption")).alias("short"), records.filled(records.template("long"), F.col("caption")).alias("long"))


# rewards and maps -----------------------------------------------------------------------------------------------


def _gate(spark, sf_dir):
    return texts(spark, sf_dir).select("image_id", responses.format_gate(F.col("reply")).alias("passed"))


def _greedy(spark, sf_dir):
    """Greedy matches with their DIoU in place of the optimal ones, and a similarity by importance: what SQL can follow."""
    m = matching.matched_boxes(fixture(spark, sf_dir, "fx_gt"), fixture(spark, sf_dir, "fx_pred"), 0.1, "importance")
    like = F.abs(F.col("g.importance") - F.col("p.importance")) / 100.0
    return m.select("image_id", F.col("g.idx").alias("gt_idx"), F.col("p.idx").alias("pred_idx"), F.col("iou").alias("diou"), (1 - like).alias("similarity"), F.col("g.importance").alias("gt_importance"), F.col("p.importance").alias("pred_importance"))


@query
def w03_description_terms(spark, sf_dir):
    gt, pred = sides(spark, sf_dir)
    r = assignment.rewards(gt, pred, _greedy(spark, sf_dir), images_of(spark, sf_dir))
    return r.select("image_id", "n_matched", *[F.round(c, 6).alias(c) for c in ("box", "description", "importance")])


@query
def w05_gated(spark, sf_dir):
    gt, pred = sides(spark, sf_dir)
    r = assignment.gated(assignment.rewards(gt, pred, _greedy(spark, sf_dir), images_of(spark, sf_dir)), _gate(spark, sf_dir))
    return r.groupBy("passed").agg(F.count("*").alias("n"), F.count_if(F.col("total") == -1).alias("failures"), F.round(F.avg("total"), 5).alias("total"))


@query
def w09_stacked(spark, sf_dir):
    p = spatial.penalty_map(fixture(spark, sf_dir, "fx_gt"), {"misalignment": 0.5}, 0.05, GRID, stacking=True)
    return p.groupBy("image_id").agg(F.count("*").alias("cells"), F.round(F.sum("penalty"), 5).alias("penalty"))


def _groups(spark, sf_dir):
    """(image_id, unique_id, scalar): images in groups of eight, the scalar from the id."""
    i = F.col("image_id")
    return images_of(spark, sf_dir).select("image_id", F.col("image_id").alias("sample_id"), F.floor(i / 8).alias("unique_id"), (i * 37 % 101 / 101.0).alias("scalar"))


@query
def w10_scaled_maps(spark, sf_dir):
    """Reward maps whose penalties are scaled by the deviation of the image's group, at least 0.02."""
    s = _groups(spark, sf_dir)
    deviation = advantage.group_deviation(s.select("sample_id", "unique_id", "scalar")).select(F.col("sample_id").alias("image_id"), F.col("deviation").alias("scale"))
    m = spatial.reward_map(fixture(spark, sf_dir, "fx_gt"), s.select("image_id", "scalar").join(deviation.hint("merge"), "image_id"), {"misalignment": 0.5}, 0.05, GRID, 0.02)
    return m.groupBy("image_id").agg(F.count("*").alias("cells"), F.round(F.sum("value"), 5).alias("value"))


@query
def w12_penalty_telemetry(spark, sf_dir):
    t = spatial.penalty_telemetry(fixture(spark, sf_dir, "fx_gt"), images_of(spark, sf_dir), 0.5, 0.05)
    return t.select("label", "n_images", *[F.round(c, 6).alias(c) for c in ("penalty", "boxes", "with_boxes")])


@query
def a08_smoothed(spark, sf_dir):
    heat = spatial.cells(fixture(spark, sf_dir, "fx_gt"), GRID).groupBy("image_id", "y", "x").agg((F.max("importance") / 100.0).alias("value"))
    return regions.smoothed(heat, 3, GRID).withColumn("value", F.round("value", 5))


@query
def a12_group_manifest(spark, sf_dir):
    return rows.group_manifest(images_of(spark, sf_dir), "image_id", 48, 4, 6, "g")


# hooks ----------------------------------------------------------------------------------------------------------


@query
def u01_pointwise(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("event_id", "value")
    return hooks.pointwise(e, lambda f: f["value"] / 100 - 1).select("event_id", F.round("reward", 6).alias("reward"))


@query
def u02_groupwise(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return hooks.groupwise(e, "user_id", lambda f: f["value"].rank(method="min")).select("event_id", "reward")


@query
def u03_registered(spark, sf_dir):
    hooks.register("Half", lambda f: f["value"] / 2)
    e = read_table(spark, sf_dir, "events").select("event_id", "value")
    return hooks.pointwise(e, hooks.lookup("hALF")).select("event_id", F.round("reward", 6).alias("reward"))


@query
def u04_aggregated(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("user_id", "value")
    return hooks.aggregated(e, lambda d: d.groupBy("user_id").agg(F.round(F.max("value") - F.min("value"), 6).alias("spread")))


@query
def u05_similarity(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("a"), F.lower("p_type").alias("b"))
    return hooks.similarity_of(p, lambda a, b: F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))).select("p_partkey", F.round("similarity", 6).alias("similarity"))


@query
def u06_preprocessed(spark, sf_dir):
    d = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")

    def step(f: pd.DataFrame) -> pd.DataFrame:
        return f.assign(role=f["role"].str.upper(), doubled=f["turn"] * 2)

    return hooks.preprocessed(d, step, "conv_id long, turn long, role string, doubled long", batch=50)


I, G, GP, ALL = with_clause("fx_images"), with_clause("fx_gt"), with_clause("fx_gt", "fx_pred"), with_clause("fx_images", "fx_gt", "fx_pred")
BASE = "string_split(filepath, '/')[-1]"
CLASSES = "(SELECT unnest(['artifact', 'misalignment']) AS class)"
#: union areas by elementary rectangles: u (image_id, class, iou, both_empty, no_gt, no_pred)
UNION = f"""{ALL}, every AS (SELECT image_id, class FROM fx_images, {CLASSES}),
  b AS (SELECT image_id, class, 'g' AS s, x0, y0, x1, y1 FROM fx_gt JOIN {CLASSES} ON label IN (class, 'both') UNION ALL SELECT image_id, class, 'p', x0, y0, x1, y1 FROM fx_pred JOIN {CLASSES} ON label IN (class, 'both')),
  xs AS (SELECT image_id, class, x, lead(x) OVER (PARTITION BY image_id, class ORDER BY x) AS z FROM (SELECT image_id, class, x0 AS x FROM b UNION SELECT image_id, class, x1 FROM b)),
  ys AS (SELECT image_id, class, y, lead(y) OVER (PARTITION BY image_id, class ORDER BY y) AS z FROM (SELECT image_id, class, y0 AS y FROM b UNION SELECT image_id, class, y1 FROM b)),
  r AS (SELECT xs.image_id, xs.class, x, y, max((xs.z - x) * (ys.z - y)) AS area, bool_or(s = 'g') AS g, bool_or(s = 'p') AS p FROM xs JOIN ys ON ys.image_id = xs.image_id AND ys.class = xs.class JOIN b ON b.image_id = xs.image_id AND b.class = xs.class AND b.x0 <= x AND x < b.x1 AND b.y0 <= y AND y < b.y1 GROUP BY 1, 2, 3, 4),
  a AS (SELECT image_id, class, sum(CASE WHEN g AND p THEN area ELSE 0 END) AS i, sum(area) AS u FROM r GROUP BY 1, 2),
  n AS (SELECT image_id, class, count(*) FILTER (s = 'g') AS ng, count(*) FILTER (s = 'p') AS np FROM b GROUP BY 1, 2),
  u AS (SELECT e.image_id, e.class, CASE WHEN ng IS NULL THEN 1.0 WHEN ng = 0 OR np = 0 THEN 0.0 ELSE CAST(i AS DOUBLE) / u END AS iou, ng IS NULL AS both_empty, coalesce(ng, 0) = 0 AS no_gt, coalesce(np, 0) = 0 AS no_pred FROM every e LEFT JOIN n USING (image_id, class) LEFT JOIN a USING (image_id, class))"""


def cells(source: str, keep: str = "true", group: str = "image_id, label") -> str:
    """CTE body: heat of the cells of GRID x GRID that boxes cover."""
    return f"""(SELECT {group}, y, x, max(importance) / 100.0::DOUBLE AS heat FROM (SELECT *, unnest(range(a, b)) AS x FROM (SELECT *, unnest(range(e, f)) AS y FROM (SELECT image_id, label, importance, x0 * {GRID} // 1000 AS a, least(x1 * {GRID} // 1000, {GRID}) AS b,
      y0 * {GRID} // 1000 AS e, least(y1 * {GRID} // 1000, {GRID}) AS f FROM {source} WHERE {keep}))) GROUP BY ALL)"""


HEAT = f"""{ALL}, hg AS {cells("fx_gt", "label <> 'both'")}, hp AS {cells("fx_pred", "label <> 'both'")}"""


def confusion(source: str, keys: str) -> str:
    """Confusion with specificity and balanced accuracy of (keys, gt, pred)."""
    return f"""SELECT {keys}, tp, fp, fn, tn, round(s, 6) AS specificity, round((s + r) / 2, 6) AS balanced_accuracy FROM (SELECT *, CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END AS s, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r
      FROM (SELECT {keys}, count(*) FILTER (gt AND pred) AS tp, count(*) FILTER (NOT gt AND pred) AS fp, count(*) FILTER (gt AND NOT pred) AS fn, count(*) FILTER (NOT gt AND NOT pred) AS tn FROM {source} GROUP BY ALL))"""


def agnostic(pred: str = "true") -> str:
    """CTEs up to m (gt_label, pred_label, gi, pi): matches at IoU 0.1 without regard to labels, of the predicted boxes that pred keeps."""
    head = matched("0.1", labels=False).replace("FROM fx_gt g JOIN fx_pred p USING (image_id))", f"FROM fx_gt g JOIN (SELECT * FROM fx_pred WHERE {pred}) p USING (image_id))")
    return f"""{head}, m AS (SELECT g.label AS gt_label, p.label AS pred_label, g.importance AS gi, p.importance AS pi FROM matches x JOIN fx_gt g ON g.image_id = x.image_id AND g.gt_idx = x.gt_idx JOIN fx_pred p ON p.image_id = x.image_id AND p.pred_idx = x.pred_idx),
  lf AS (SELECT class, count(*) FILTER (gt_label = class AND pred_label = class) AS tp, count(*) FILTER (gt_label <> class AND pred_label = class) AS fp, count(*) FILTER (gt_label = class AND pred_label <> class) AS fn FROM m, {CLASSES} GROUP BY 1),
  dc AS (SELECT gt_label, a.embedding AS va, b.embedding AS vb FROM m JOIN embeddings a ON a.vec_id = gi JOIN embeddings b ON b.vec_id = pi WHERE gi % 9 <> 0),
  cs AS (SELECT gt_label, list_inner_product(va::DOUBLE[], vb::DOUBLE[]) / ((sqrt(list_inner_product(va::DOUBLE[], va::DOUBLE[])) + 1e-9) * (sqrt(list_inner_product(vb::DOUBLE[], vb::DOUBLE[])) + 1e-9)) AS c FROM dc)"""


def _experiment(name: str, keep: str) -> str:
    return f"""SELECT '{name}' AS experiment, * FROM ({agnostic(keep)}, f AS ({prf("lf", "class")}) SELECT class, f1, coalesce((SELECT round(avg(c), 5) FROM cs WHERE gt_label = class), 0) AS cosine FROM f)"""


def _order(seed: str, key: str = "image_id") -> str:
    """The methods in the order of their hashes."""
    items = ", ".join(f"{{'h': md5(concat('{seed}|', {key}, '|{m}')), 'n': '{m}'}}" for m in METHODS)
    return f"list_transform(list_sort([{items}]), lambda s: s.n)"


RANKS = f"""{I}, o AS (SELECT image_id AS item, {_order("rank")} AS o FROM fx_images), e AS (SELECT item, unnest(o) AS method, generate_subscripts(o, 1) - 1 AS place FROM o),
  ranks AS (SELECT item, method, CASE WHEN item % 6 = 0 AND place = 1 THEN 1 ELSE place + 1 END AS rank FROM e WHERE item % 10 <> 3 OR place <> 2), whole AS (SELECT * FROM ranks WHERE item % 10 <> 3)"""
REWARD = f"""{matched("0.1")}, d AS (SELECT x.image_id, pr.iou AS diou, abs(g.importance - p.importance) AS gap FROM matches x JOIN fx_gt g ON g.image_id = x.image_id AND g.gt_idx = x.gt_idx JOIN fx_pred p ON p.image_id = x.image_id AND p.pred_idx = x.pred_idx
    JOIN pairs pr ON pr.image_id = x.image_id AND pr.gt_idx = x.gt_idx AND pr.pred_idx = x.pred_idx),
  s AS (SELECT image_id, count(*) AS n_matched, sum(diou) AS near, sum(greatest(1 - gap / 50.0::DOUBLE, 0)) AS close, sum(least(greatest((0.5 - gap / 100.0::DOUBLE) / 0.4, 0), 1)) AS like_ FROM d GROUP BY 1),
  c AS (SELECT o_orderkey AS image_id, coalesce(ng, 0) AS ng, coalesce(np, 0) AS np, coalesce(n_matched, 0) AS n_matched, coalesce(near, 0) AS near, coalesce(close, 0) AS close, coalesce(like_, 0) AS like_ FROM orders
    LEFT JOIN (SELECT image_id, count(*) AS ng FROM fx_gt GROUP BY 1) a ON a.image_id = o_orderkey LEFT JOIN (SELECT image_id, count(*) AS np FROM fx_pred GROUP BY 1) b ON b.image_id = o_orderkey LEFT JOIN s ON s.image_id = o_orderkey),
  w AS (SELECT image_id, n_matched, CASE WHEN ng = 0 AND np = 0 THEN 0.3 WHEN np = 0 THEN -0.8 WHEN ng = 0 THEN -0.3 ELSE greatest(least((near - 0.5 * (ng + np - 2 * n_matched)) / greatest(ng, np, 1), 1), -1) END AS box, like_ / greatest(ng, np, 1) AS description, close / greatest(ng, np, 1) AS importance FROM c)"""
#: Penalties per label and cell: {joint} of weights, each label's own floor {least} with its factor {factor}.
_LABELS = f"""{G}, w AS (SELECT image_id, label, y, x, {{joint}}(importance) / 100.0::DOUBLE AS w FROM (SELECT *, unnest(range(a, b)) AS x FROM (SELECT *, unnest(range(e, f)) AS y FROM
  (SELECT image_id, label, importance, x0 * {GRID} // 1000 AS a, least(x1 * {GRID} // 1000, {GRID}) AS b, y0 * {GRID} // 1000 AS e, least(y1 * {GRID} // 1000, {GRID}) AS f FROM fx_gt))) GROUP BY ALL)"""
_STACK = f"""{G}, p AS (SELECT image_id, y, x, sum(CASE label WHEN 'misalignment' THEN 0.5::DOUBLE ELSE 0.05::DOUBLE END * w) AS p FROM (SELECT image_id, label, y, x, {{joint}}(importance) / 100.0::DOUBLE AS w FROM (SELECT *, unnest(range(a, b)) AS x FROM (SELECT *, unnest(range(e, f)) AS y FROM
  (SELECT image_id, label, importance, x0 * {GRID} // 1000 AS a, least(x1 * {GRID} // 1000, {GRID}) AS b, y0 * {GRID} // 1000 AS e, least(y1 * {GRID} // 1000, {GRID}) AS f FROM fx_gt))) GROUP BY ALL) GROUP BY ALL)"""

ORACLE_SQL = {
    "s05_csv_round_trip": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders",
    "s02_prompts": f"{I} SELECT trim(caption) AS prompt, count(*) AS n FROM fx_images WHERE image_id % 5 <> 0 GROUP BY 1",
    "s04_routed": f"{I} SELECT gen AS route, count(*) AS n, count(*) AS same FROM fx_images GROUP BY 1",
    "s06_image_sizes": "SELECT CASE WHEN o_orderkey % 7 <> 0 THEN 1 + o_orderkey % 4000 END AS width, count(*) AS n, CAST(sum(CASE WHEN o_orderkey % 7 <> 0 THEN 1 + o_custkey % 3000 END) AS BIGINT) AS heights FROM orders GROUP BY 1",
    "p01_fields": f"{I} SELECT image_id, caption, CAST(NULL AS VARCHAR) AS raw_response FROM fx_images",
    "p04_split": f"{I} SELECT image_id, CASE WHEN image_id % 3 <> 0 AND contains(filepath, 'test') THEN 'with' ELSE 'without' END AS part FROM fx_images",
    "p07_unique_names": f"{I}, s AS (SELECT image_id, gen, split, replace({BASE}, '.png', '') AS s FROM fx_images) SELECT image_id, CASE image_id % 3 WHEN 0 THEN s WHEN 1 THEN concat('d_', s) ELSE concat(gen, '_', split, '_', s) END AS name FROM s",
    "p09_existing": f"{I} SELECT image_id FROM fx_images WHERE image_id % 4 <> 0",
    "p10_offline": "SELECT conv_id, turn, CAST(length(substr(text, 1, turn * 4 + 5)) AS INTEGER) AS n FROM conversations WHERE length(substr(text, 1, turn * 4 + 5)) > 10",
    "p11_cap": f"{I} SELECT image_id FROM (SELECT image_id, row_number() OVER (ORDER BY md5(CAST(image_id AS VARCHAR)), image_id) - 1 AS n, count(*) OVER () AS t FROM fx_images) WHERE n >= 100 AND n < 100 + t // 2",
    "p13_layouts": f"""{G} SELECT image_id, CASE WHEN image_id % 2 = 0 THEN count(*) FILTER (label = 'misalignment') END AS gt_misalignment, CASE WHEN image_id % 6 = 0 THEN 0 WHEN image_id % 2 = 0 THEN count(*) FILTER (label = 'artifact') END AS gt_artifact,
        CASE WHEN image_id % 2 = 0 THEN NULL WHEN image_id % 5 = 0 THEN 0 ELSE count(*) END AS gt_boxes FROM fx_gt GROUP BY 1""",
    "p14_merged": f"{I} SELECT image_id, CASE WHEN image_id % 2 = 0 THEN concat('p', image_id) END AS imdoc_prediction, CASE WHEN image_id % 3 = 0 THEN concat('h', image_id) END AS imdoc_artifact, CASE WHEN image_id % 3 = 0 THEN concat('r', image_id) END AS sdg_response FROM fx_images",
    "w07_padded": f"{COUNTS} SELECT image_id, n_gt AS n FROM counts",
    "j01_aligned": f"{I} SELECT split, count(*) AS n, min(caption) AS first FROM fx_images GROUP BY 1",
    "j04_lenient": f"{GP}, g AS (SELECT image_id, count(*) AS n_gt FROM fx_gt GROUP BY 1), p AS (SELECT image_id, count(*) AS n_pred FROM fx_pred GROUP BY 1) SELECT image_id, n_gt, n_pred FROM g JOIN p USING (image_id)",
    "r11_metadata": f"{I} SELECT image_id, concat('caption=', caption, CASE WHEN image_id % 4 <> 1 THEN concat(';gen=', gen) ELSE '' END, ';split=', split) AS metadata FROM fx_images",
    "k02_labels": f"{G} SELECT CASE gt_idx % 5 WHEN 1 THEN 'artifact' WHEN 2 THEN 'both' WHEN 3 THEN '' ELSE 'misalignment' END AS label, count(*) AS n FROM fx_gt GROUP BY 1",
    "x04_dots": """WITH f AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS o FROM embeddings GROUP BY 1), j AS (SELECT vec_id, embedding::DOUBLE[] AS v, o FROM embeddings JOIN f USING (label)),
        c AS (SELECT vec_id, round(list_inner_product(v, o) / sqrt(list_inner_product(v, v)) / sqrt(list_inner_product(o, o)), 5) AS c FROM j) SELECT vec_id, c AS cosine, c AS dot FROM c""",
    "x06_sub_prompts": f"""{I} SELECT image_id, 0 AS place, concat('A view of ', caption, '.') AS part FROM fx_images UNION ALL SELECT image_id, 1, ' a cat.' FROM fx_images UNION ALL SELECT image_id, 2, concat(' two ', gen, CASE WHEN image_id % 2 = 0 THEN '.' ELSE ' .' END) FROM fx_images""",
    "x07_grid_sizes": f"{I} SELECT image_id, CASE image_id % 3 WHEN 0 THEN image_id % 7 + 1 WHEN 1 THEN image_id % 4 + 1 ELSE 1 END AS rows, CASE image_id % 3 WHEN 0 THEN image_id % 5 + 1 WHEN 1 THEN 3 ELSE 1 END AS columns FROM fx_images",
    "x09_judged": f"{I} SELECT CASE WHEN image_id % 4 = 0 THEN 0 ELSE round((0.8::DOUBLE * (image_id % 50 / 10) + 0.1::DOUBLE * (image_id % 5) + 0.1::DOUBLE * (image_id % 3 + 0.5)) / 5, 6) END AS score, count(*) AS n FROM fx_images GROUP BY 1",
    "x10_share_of_real": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, round(1 / (1 + exp(20 * (v[1] + v[2] - v[3] - v[4]))), 6) AS share FROM e",
    "g11_iou_eps": f"{PAIRS} SELECT image_id, gt_idx, pred_idx, round(i / (areas - i + 1e-9), 6) AS iou FROM pairs",
    "g13_union_iou": f"{UNION} SELECT image_id, class, round(iou, 6) AS iou, both_empty FROM u",
    "m15_union_report": f"""{UNION} SELECT class, count(*) AS n, round(avg(iou), 6) AS mean_iou, round(coalesce(avg(CASE WHEN NOT both_empty THEN iou END), 0), 6) AS mean_iou_non_empty, round(avg(CASE WHEN iou >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS share_50,
        count(*) FILTER (both_empty) AS both_empty, count(*) FILTER (no_gt) AS no_gt, round(avg(CASE WHEN no_gt THEN 1.0 ELSE 0.0 END), 6) AS no_gt_share, count(*) FILTER (no_pred) AS no_pred, round(avg(CASE WHEN no_pred THEN 1.0 ELSE 0.0 END), 6) AS no_pred_share, round(coalesce(avg(CASE WHEN no_gt THEN CASE WHEN no_pred THEN 1.0 ELSE 0.0 END END), 0), 6) AS clean_accuracy FROM u GROUP BY 1""",
    "g15_hot_regions": f"""{HEAT}, t AS (SELECT image_id, label, y // 2 AS r, x // 2 AS c, sum(heat) / 4 AS m FROM hg WHERE y < 6 AND x < 6 GROUP BY ALL)
        SELECT image_id, label, CASE WHEN r = 1 AND c = 1 THEN 'center' ELSE concat(['upper', 'middle', 'lower'][r + 1], '-', ['left', 'center', 'right'][c + 1]) END AS region FROM t WHERE m > 0.5""",
    "g16_grid_cells": f"""{I}, g AS (SELECT image_id, image_id % 3 AS r, 1 + image_id % 4 AS c, (500 + image_id % 13) // (1 + image_id % 4) AS w, CASE WHEN image_id % 3 > 0 THEN (400 + image_id % 7) // (image_id % 3) END AS h FROM fx_images WHERE image_id % 3 > 0),
        e AS (SELECT *, unnest(range(r * c)) AS cell FROM g) SELECT image_id, CAST(cell AS INTEGER) AS cell, cell % c * w AS left, cell // c * h AS upper, (cell % c + 1) * w AS right, (cell // c + 1) * h AS lower FROM e""",
    "m14_heat_sweep": f"""{HEAT}, e AS (SELECT i.image_id, class, (SELECT coalesce(max(heat), 0) FROM hg WHERE hg.image_id = i.image_id AND hg.label = class) AS g, (SELECT coalesce(max(heat), 0) FROM hp WHERE hp.image_id = i.image_id AND hp.label = class) AS p FROM fx_images i, {CLASSES}),
        f AS (SELECT image_id, class, CAST(threshold AS DOUBLE) AS threshold, g > threshold AS gt, p > threshold AS pred FROM e, (SELECT unnest([0.0, 0.1, 0.33]) AS threshold)),
        o AS (SELECT threshold, class, gt, pred FROM f UNION ALL SELECT threshold, 'overall', bool_or(gt), bool_or(pred) FROM f GROUP BY threshold, image_id) {confusion("o", "threshold, class")}""",
    "m13_extended_confusion": f"""{UNION}, f AS (SELECT class, NOT no_gt AS gt, NOT no_pred AS pred FROM u UNION ALL SELECT 'overall', bool_or(NOT no_gt), bool_or(NOT no_pred) FROM u GROUP BY image_id) {confusion("f", "class")}""",
    "m10_label_f1": f"{agnostic()} {prf('lf', 'class')}",
    "m11_description_cosine": f"{agnostic()} SELECT gt_label, count(*) AS n, round(avg(c), 5) AS mean FROM cs GROUP BY 1",
    "m12_experiments": f"{_experiment('all', 'true')} UNION ALL {_experiment('even', 'pred_idx % 2 = 0')}",
    "m16_resolutions": "SELECT count(*) AS total, count(*) FILTER (o_orderkey % 7 = 0) AS errors, count(DISTINCT CASE WHEN o_orderkey % 7 <> 0 THEN concat(o_orderkey % 400, 'x', o_custkey % 30) END) AS sizes FROM orders",
    "m17_merged_summaries": f"{with_clause('fx_rewards')} SELECT reward_name, count(*) AS n, CASE WHEN reward_name = 'key' THEN 'first' ELSE 'second' END AS part FROM fx_rewards GROUP BY 1",
    "m18_clean_accuracy": f"{COUNTS} SELECT count(*) AS n, round(avg(CASE WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM counts WHERE n_gt = 0",
    "r05_rankings": f"""{RANKS} SELECT method, count(*) AS n, round(avg(rank), 6) AS mean_rank, {", ".join(f"round(avg(CASE WHEN rank = {k} THEN 1.0 ELSE 0.0 END), 6) AS {n}" for k, n in ((1, "first"), (2, "second"), (3, "third")))} FROM whole GROUP BY 1""",
    "r05_win_rates": f"{RANKS} SELECT a.method, b.method AS other, round(avg(CASE WHEN a.rank < b.rank THEN 1.0 WHEN a.rank = b.rank THEN 0.5 ELSE 0.0 END), 6) AS rate FROM whole a JOIN whole b ON a.item = b.item AND a.method <> b.method GROUP BY 1, 2",
    "r06_ranking_export": f"{I}, o AS (SELECT image_id, {_order('blind')} AS o FROM fx_images) SELECT image_id, o[1] AS a, o[3] AS c, CASE WHEN image_id % 8 <> 0 THEN CAST(round(image_id * 977 % 100000 / 1000.0::DOUBLE) AS BIGINT) END AS duration_seconds FROM o",
    "r07_blind_manifest": f"{I}, o AS (SELECT image_id, concat('images/', gen, '_', split, '_', replace({BASE}, '.png', ''), '_') AS p, {_order('blind')} AS o FROM fx_images) SELECT image_id, concat(p, 'original.jpg') AS original, concat(p, o[1], '.jpg,', p, o[2], '.jpg,', p, o[3], '.jpg') AS edits FROM o",
    "r01_templates": f"""{I} SELECT image_id, concat('Rate ', caption) AS short, concat('Rate ', caption, ' as {{"score": 0}}') AS long FROM fx_images""",
    "w03_description_terms": f"{REWARD} SELECT image_id, n_matched, round(box, 6) AS box, round(description, 6) AS description, round(importance, 6) AS importance FROM w",
    "w09_stacked": f"{_STACK.format(joint='sum')} SELECT image_id, count(*) AS cells, round(sum(p), 5) AS penalty FROM p GROUP BY 1",
    "w10_scaled_maps": f"""{_LABELS.format(joint='max')}, s AS (SELECT o_orderkey AS image_id, o_orderkey // 8 AS u, o_orderkey * 37 % 101 / 101.0::DOUBLE AS s FROM orders), v AS (SELECT image_id, s, coalesce(stddev_samp(s) OVER (PARTITION BY u), 0) AS d FROM s),
        p AS (SELECT image_id, y, x, any_value(s) AS s, sum(greatest(greatest(CASE label WHEN 'misalignment' THEN 0.5::DOUBLE ELSE 0.05::DOUBLE END * d, 0.02) * w, 0.02)) AS p FROM w JOIN v USING (image_id) GROUP BY 1, 2, 3)
        SELECT image_id, count(*) AS cells, round(sum(s - p), 5) AS value FROM p GROUP BY 1""",
    "w12_penalty_telemetry": f"""{ALL}, c AS (SELECT image_id, CASE label WHEN 'misalignment' THEN label ELSE 'artifact' END AS label, importance, x0 * 64 // 1000 AS a, least(x1 * 64 // 1000, 64) AS b, y0 * 64 // 1000 AS e, least(y1 * 64 // 1000, 64) AS f FROM fx_gt),
        w AS (SELECT image_id, label, y, x, max(importance) AS w FROM (SELECT *, unnest(range(a, b)) AS x FROM (SELECT *, unnest(range(e, f)) AS y FROM c)) GROUP BY ALL), s AS (SELECT image_id, label, sum(w) AS s FROM w GROUP BY 1, 2)
        SELECT label, count(*) AS n_images, round(sum(s) / count(*) / 409600 * CASE label WHEN 'misalignment' THEN 0.5 ELSE 0.05 END, 6) AS penalty, (SELECT round((SELECT count(*) FROM fx_gt) / count(*), 6) FROM fx_images) AS boxes,
          (SELECT round((SELECT count(DISTINCT image_id) FROM fx_gt) / count(*), 6) FROM fx_images) AS with_boxes FROM s GROUP BY 1""",
    "a08_smoothed": f"""{G}, h AS {cells("fx_gt", group="image_id")}, k AS (SELECT dy, dx, exp(-0.5 * (dy * dy + dx * dx)) AS w FROM (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)), kk AS (SELECT dy, dx, w / (SELECT sum(w) FROM k) AS w FROM k),
        p AS (SELECT unnest(range(-1, {GRID + 1})) AS q), m AS (SELECT q, CASE WHEN q < 0 THEN -q WHEN q >= {GRID} THEN 2 * {GRID - 1} - q ELSE q END AS c FROM p),
        s AS (SELECT image_id, my.q - dy AS y, mx.q - dx AS x, heat * w AS v FROM h JOIN m my ON my.c = h.y JOIN m mx ON mx.c = h.x, kk)
        SELECT image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(sum(v), 5) AS value FROM s WHERE y BETWEEN 0 AND {GRID - 1} AND x BETWEEN 0 AND {GRID - 1} GROUP BY 1, 2, 3""",
    "a12_group_manifest": f"""{I}, m AS (SELECT image_id FROM fx_images ORDER BY md5(concat('g|', image_id)), image_id LIMIT 48), p AS (SELECT image_id, row_number() OVER (ORDER BY md5(concat('g|deal|', image_id)), image_id) - 1 AS n FROM m)
        SELECT image_id, copy, n // 8 AS rank, n % 8 * 4 + copy AS slot FROM p, (SELECT unnest([0, 1, 2, 3]) AS copy)""",
    "u01_pointwise": "SELECT event_id, round(value / 100 - 1, 6) AS reward FROM events",
    "u02_groupwise": "SELECT event_id, CAST(rank() OVER (PARTITION BY user_id ORDER BY value) AS DOUBLE) AS reward FROM events",
    "u03_registered": "SELECT event_id, round(value / 2, 6) AS reward FROM events",
    "u04_aggregated": "SELECT user_id, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1",
    "u05_similarity": "SELECT p_partkey, round(levenshtein(lower(p_name), lower(p_type)) / greatest(length(p_name), length(p_type)), 6) AS similarity FROM part",
    "u06_preprocessed": "SELECT conv_id, turn, upper(role) AS role, turn * 2 AS doubled FROM conversations",
}
_M03 = "found GROUP BY ROLLUP (label)"
# one true box after the other takes a predicted one that is free, or none: the least cost of each set of taken boxes
ORACLE_SQL["k05_optimal_costs"] = f"""{PAIRS.replace("WITH ", "WITH RECURSIVE ", 1)}, c AS (SELECT image_id, dense_rank() OVER (PARTITION BY image_id ORDER BY gt_idx) - 1 AS i, dense_rank() OVER (PARTITION BY image_id ORDER BY pred_idx) - 1 AS j,
    CASE WHEN gt_label = pred_label OR gt_label = 'both' OR pred_label = 'both' THEN -(iou - CASE WHEN diagonal > 0 THEN centre / diagonal ELSE 0 END) ELSE 2 END AS cost FROM pairs),
  n AS (SELECT image_id, max(i) + 1 AS boxes, least(max(i), max(j)) + 1 AS k FROM c GROUP BY 1),
  l AS (SELECT image_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS mask, CAST(0 AS DOUBLE) AS cost FROM n
    UNION ALL SELECT image_id, i + 1, mask, min(cost) FROM (
      SELECT l.image_id, l.i, l.mask, l.cost FROM l JOIN n USING (image_id) WHERE l.i < n.boxes
      UNION ALL SELECT l.image_id, l.i, l.mask | (CAST(1 AS BIGINT) << c.j), l.cost + c.cost FROM l JOIN c ON c.image_id = l.image_id AND c.i = l.i AND l.mask & (CAST(1 AS BIGINT) << c.j) = 0) GROUP BY 1, 2, 3)
  SELECT image_id, round(min(cost), 6) AS cost FROM l JOIN n USING (image_id) WHERE i = boxes AND bit_count(mask) = k GROUP BY 1"""
_EVAL = dialects.ORACLE_SQL["b01_literals"].replace(dialects.TEXTS, "").rsplit("SELECT image_id, CAST(len(b)", 1)[0].rstrip()
ORACLE_SQL["m07_reply_quality"] = f"""{dialects.TEXTS.replace("texts AS (", "raw AS (")}, texts AS (SELECT image_id, CASE WHEN image_id % 5 = 0 THEN concat(repeat('7', 400), reply) WHEN image_id % 11 = 0 THEN repeat(chr(65533), 101) ELSE reply END AS reply FROM raw)
  {_EVAL}, d AS (SELECT image_id, length(reply) AS n, list_max(list_transform(range(10), lambda k: length(reply) - length(replace(reply, CAST(k AS VARCHAR), '')))) AS digit, length(reply) - length(replace(reply, chr(65533), '')) AS odd FROM texts)
  SELECT CASE WHEN n > 100 AND (digit / n > 0.5 OR odd / n > 0.3) THEN 'degenerate' WHEN l IS NULL THEN 'failed' ELSE 'parsed' END AS kind, count(*) AS n FROM d JOIN l USING (image_id) GROUP BY 1"""
ORACLE_SQL |= {
    "r02_messages": """WITH d AS (SELECT conv_id, arg_min(text, turn) AS a, arg_max(text, turn) AS z FROM conversations GROUP BY 1) SELECT conv_id, 0 AS place, 'user' AS role, md5(concat('<image>', a)) AS digest FROM d UNION ALL SELECT conv_id, 1, 'assistant', md5(z) FROM d""",
    "p08_first_truthy": f"{I} SELECT image_id, CASE WHEN image_id % 3 = 2 THEN caption WHEN split <> 'test' THEN split ELSE 'none' END AS value FROM fx_images",
    "g02_coordinates": f"""{ALL}, b AS (SELECT image_id, bool_and(gt_idx <> 3 AND x0 < x1 AND y0 < y1 AND x1 <= 1000 AND y1 <= 1000) AS v FROM fx_gt GROUP BY 1) SELECT coalesce(v, false) AS valid, count(*) AS n FROM fx_images LEFT JOIN b USING (image_id) GROUP BY 1""",
    "g06_think_blocks": f"""{dialects.TEXTS}, t AS (SELECT CASE WHEN image_id % 2 = 0 THEN replace(reply, '</think>', '</think>' || chr(10)) ELSE reply END AS t FROM texts), s AS (SELECT t, regexp_replace(t, '(?s)<think>.*?</think>\n', '', 'g') AS s FROM t)
        SELECT count(*) AS n, count(*) FILTER (s <> t) AS changed, CAST(sum(length(s)) AS BIGINT) AS length FROM s""",
    "x05_unit_means": """WITH e AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS place FROM embeddings WHERE vec_id % 4 <> 0), m AS (SELECT label, place, avg(CAST(v AS DOUBLE)) AS m FROM e GROUP BY 1, 2)
        SELECT label, CAST(place AS INTEGER) AS place, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 5) AS value FROM m""",
}
ORACLE_SQL["m19_summary_sheet"] = f"""{matched("0.1, 0.5")},
  o AS (SELECT CASE WHEN m.gt_idx IS NULL THEN 'fn' ELSE 'tp' END AS outcome, g.label FROM fx_gt g LEFT JOIN matches m ON m.t = 0.5 AND g.image_id = m.image_id AND g.gt_idx = m.gt_idx
    UNION ALL SELECT 'fp', p.label FROM fx_pred p ANTI JOIN (SELECT * FROM matches WHERE t = 0.5) m ON p.image_id = m.image_id AND p.pred_idx = m.pred_idx),
  c AS (SELECT 'classes' AS sheet, coalesce(label, 'all') AS item, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn FROM o GROUP BY ROLLUP (label)),
  f AS (SELECT sheet, item, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM c),
  h AS (SELECT 'thresholds' AS sheet, CASE WHEN t = 0.1 THEN '0.10' ELSE '0.50' END AS item, count(*) AS tp, (SELECT count(*) FROM fx_pred) - count(*) AS fp, (SELECT count(*) FROM fx_gt) - count(*) AS fn FROM matches GROUP BY t)
  SELECT sheet, item, unnest(['tp', 'fp', 'fn', 'f1']) AS metric, unnest([tp::DOUBLE, fp, fn, f1]) AS value FROM f UNION ALL SELECT sheet, item, unnest(['tp', 'fp', 'fn']), unnest([tp::DOUBLE, fp, fn]) FROM h"""
ORACLE_SQL["w05_gated"] = f"""{REWARD}, {TEXT_CTES},
  g AS (SELECT image_id, contains(reply, '<think>') AND regexp_matches(reply, '(?s)<answer>') AND l IS NOT NULL AND list_bool_and(list_transform(from_json(l, '[{{"box_2d": ["DOUBLE"], "description": "VARCHAR"}}]'), lambda x: x.box_2d[1] < x.box_2d[3] AND x.box_2d[2] < x.box_2d[4] AND x.description IS NOT NULL)) AS ok
    FROM (SELECT image_id, reply, CASE WHEN json_valid(t) AND t LIKE '[%' THEN t END AS l FROM (SELECT image_id, reply, coalesce(nullif(regexp_extract(a, '(?s)```(?:json)?\\s*(.*?)\\s*```', 1), ''), a) AS t FROM (SELECT image_id, reply, regexp_extract(reply, '(?s)<answer>\\s*(.*?)\\s*</answer>', 1) AS a FROM texts)))),
  z AS (SELECT coalesce(ok, false) AS passed, CASE WHEN coalesce(ok, false) THEN 0.6 * box + 0.25 * description + 0.15 * importance ELSE -1 END AS total FROM w LEFT JOIN g USING (image_id))
  SELECT passed, count(*) AS n, count(*) FILTER (total = -1) AS failures, round(avg(total), 5) AS total FROM z GROUP BY 1"""
