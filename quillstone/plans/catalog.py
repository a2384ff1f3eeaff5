"""Registered queries over the given tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import paths, text
from quillstone.functions.geometry import box, diou, iou
from quillstone.operators import advantage, matching, metrics, rows, spatial
from quillstone.plans import details, dialects, oracles, replies, reports, scores
from quillstone.sources import files
from quillstone.sources.fixtures import fixture
from quillstone.sources.tables import read_table

QUERIES: dict = {}
THRESHOLDS = (0.1, 0.2, 0.25, 0.3, 0.4, 0.5)
WEIGHTS = {"value": 0.5, "key": 0.3, "type": 0.2}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fixture(spark, sf_dir, "fx_gt"), fixture(spark, sf_dir, "fx_pred")


def six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# boxes and matching ---------------------------------------------------------------------------------------------


@query
def j06_candidate_pairs(spark, sf_dir):
    gt, pred = boxes(spark, sf_dir)
    return six(matching.candidate_pairs(gt, pred, 0.1), "iou").select("image_id", "gt_idx", "pred_idx", "iou")


@query
def g12_diou(spark, sf_dir):
    gt, pred = boxes(spark, sf_dir)
    pairs = matching.candidate_pairs(gt, pred, 0.0)
    return pairs.select("image_id", "gt_idx", "pred_idx", F.round(iou(box("gt_"), box("pred_")), 6).alias("iou"), F.round(diou(box("gt_"), box("pred_")), 6).alias("diou"))


@query
def k03_greedy_matches(spark, sf_dir):
    gt, pred = boxes(spark, sf_dir)
    return matching.greedy_matches(matching.candidate_pairs(gt, pred, 0.5), ["image_id"]).select("image_id", "pred_idx", "gt_idx")


@query
def k04_agnostic_matches(spark, sf_dir):
    gt, pred = boxes(spark, sf_dir)
    return matching.greedy_matches(matching.candidate_pairs(gt, pred, 0.5), ["image_id"], labels=False).select("image_id", "pred_idx", "gt_idx")


@query
def k06_outcomes(spark, sf_dir):
    gt, pred = boxes(spark, sf_dir)
    found = matching.image_outcomes(gt, pred, 0.5)
    return found.groupBy("image_id", "outcome", "label").agg(F.count("*").alias("n"))


@query
def m03_instance_metrics(spark, sf_dir):
    gt, pred = boxes(spark, sf_dir)
    return metrics.instance_metrics(matching.image_outcomes(gt, pred, 0.5))


@query
def m04_threshold_sweep(spark, sf_dir):
    gt, pred = boxes(spark, sf_dir)
    return matching.swept(gt, pred, THRESHOLDS).select("*", *metrics.precision_recall(F.col("tp"), F.col("fp"), F.col("fn")))


def _counts(spark, sf_dir):
    gt, pred = boxes(spark, sf_dir)
    n = lambda df, name: df.groupBy("image_id").agg(F.count("*").alias(name))
    images = fixture(spark, sf_dir, "fx_images").select("image_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return images.join(n(gt, "n_gt"), "image_id", "left").join(n(pred, "n_pred"), "image_id", "left").select("image_id", zero("n_gt"), zero("n_pred"))


@query
def m01_image_confusion(spark, sf_dir):
    return metrics.image_confusion(_counts(spark, sf_dir).select((F.col("n_gt") > 0).alias("has_gt"), (F.col("n_pred") > 0).alias("has_pred")))


@query
def m05_count_metrics(spark, sf_dir):
    return metrics.count_metrics(_counts(spark, sf_dir))


@query
def m06_count_histogram(spark, sf_dir):
    c = _counts(spark, sf_dir)
    both = c.select(F.explode(F.array(F.struct(F.lit("gt").alias("side"), F.col("n_gt").alias("boxes")), F.struct(F.lit("pred").alias("side"), F.col("n_pred").alias("boxes")))).alias("s")).select("s.*")
    return both.groupBy("side", "boxes").agg(F.count("*").alias("images"))


@query
def m16_box_sizes(spark, sf_dir):
    gt, _ = boxes(spark, sf_dir)
    sizes = gt.groupBy((F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height")).agg(F.count("*").alias("n"))
    return sizes.orderBy(F.desc("n"), "width", "height").limit(20)


@query
def w11_map_scalars(spark, sf_dir):
    gt, _ = boxes(spark, sf_dir)
    return six(spatial.map_scalar_of_boxes(gt, 0.5, 0.05), "scalar")


# rewards and groups ---------------------------------------------------------------------------------------------


def _scalars(spark, sf_dir):
    return advantage.weighted_sum(fixture(spark, sf_dir, "fx_rewards"), WEIGHTS)


@query
def a01_group_advantage(spark, sf_dir):
    return six(advantage.group_advantage(_scalars(spark, sf_dir)), "advantage")


@query
def a01_batch_deviation(spark, sf_dir):
    return six(advantage.group_advantage(_scalars(spark, sf_dir), over_all=True), "advantage")


@query
def a02_decoupled_advantage(spark, sf_dir):
    return six(advantage.decoupled_advantage(fixture(spark, sf_dir, "fx_rewards"), WEIGHTS), "advantage")


@query
def a03_moments(spark, sf_dir):
    return six(advantage.moments(_scalars(spark, sf_dir)), "mean", "sd")


@query
def a04_group_diagnostics(spark, sf_dir):
    return six(advantage.group_diagnostics(_scalars(spark, sf_dir)), "sd_mean", "sd_max", "sd_min", "mean_sd", "flat_share")


@query
def a05_clipped(spark, sf_dir):
    return six(advantage.clipped(advantage.group_advantage(_scalars(spark, sf_dir)), -1.0, 1.0), "advantage")


@query
def a06_group_deviation(spark, sf_dir):
    return six(advantage.group_deviation(_scalars(spark, sf_dir)), "deviation")


@query
def a09_wrong_groups(spark, sf_dir):
    return advantage.wrong_groups(read_table(spark, sf_dir, "events").select(F.col("user_id").alias("unique_id")), 100)


@query
def a10_mixed_sample(spark, sf_dir):
    images = fixture(spark, sf_dir, "fx_images").select("image_id", "split")
    return rows.mixed_sample(images.where("split = 'train'"), images.where("split = 'test'"), 500, "mix", "image_id").select("image_id", "part")


@query
def a13_shards(spark, sf_dir):
    return rows.shards(fixture(spark, sf_dir, "fx_images").select("image_id"), 7, F.col("image_id"))


@query
def a14_batches(spark, sf_dir):
    return rows.shuffled_batches(fixture(spark, sf_dir, "fx_images").select("image_id"), 32, "3|0|1", F.col("image_id"))


@query
def w08_mean_reward(spark, sf_dir):
    r = fixture(spark, sf_dir, "fx_rewards")
    return r.groupBy("sample_id").agg(F.round(F.coalesce(F.avg(F.col("reward").cast("double")), F.lit(0.5)), 6).alias("scalar"))


@query
def m17_reward_summary(spark, sf_dir):
    r = fixture(spark, sf_dir, "fx_rewards").withColumn("reward", F.col("reward").cast("double"))
    return r.groupBy("reward_name").agg(F.count("*").alias("n"), F.round(F.avg("reward"), 6).alias("mean"), F.round(F.stddev_pop("reward"), 6).alias("sd"))


# records, paths and joins ---------------------------------------------------------------------------------------


@query
def p02_keyword_routes(spark, sf_dir):
    return rows.route_keywords(fixture(spark, sf_dir, "fx_images").select("image_id", "filepath"), "filepath", ["sana", "flux2", "test", "train"]).select("image_id", "route")


@query
def p03_split(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_images").groupBy(paths.exclusive_split(F.col("filepath")).alias("split")).agg(F.count("*").alias("n"))


@query
def p05_remapped(spark, sf_dir):
    f = F.col("filepath")
    return fixture(spark, sf_dir, "fx_images").select("image_id", paths.remap_prefix(f, [("/data/SDG/sana", "/a"), ("/data/SDG", "/b"), ("/data", "/c")]).alias("filepath"))


@query
def p06_names(spark, sf_dir):
    f = F.col("filepath")
    name = F.concat_ws("_", paths.stem(f), paths.generator_name(f))
    return fixture(spark, sf_dir, "fx_images").select("image_id", paths.generator_name(f).alias("generator"), name.alias("unique_name"))


@query
def p12_funnel(spark, sf_dir):
    c = _counts(spark, sf_dir)
    return rows.funnel(c, F.when(F.col("n_gt") == 0, "no_gt").when(F.col("n_pred") == 0, "no_prediction").when(F.col("n_gt") != F.col("n_pred"), "count_differs"))


@query
def s09_union_by_name(spark, sf_dir):
    d, c = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "conversations")
    both = files.union_by_name(d.select(F.col("doc_id").alias("id"), "text", "lang"), c.select(F.col("conv_id").alias("id"), "text", "role"))
    return both.groupBy("lang", "role").agg(F.count("*").alias("n"))


@query
def j02_latest_by_basename(spark, sf_dir):
    images = fixture(spark, sf_dir, "fx_images")
    pred = boxes(spark, sf_dir)[1]
    named = pred.join(images.select("image_id", "filepath"), "image_id").withColumn("name", paths.basename(F.col("filepath")))
    last = rows.last_by(named, "name", F.struct("pred_idx", "image_id"), ["pred_idx", "label"])
    return images.withColumn("name", paths.basename(F.col("filepath"))).join(last, "name").select("image_id", "pred_idx", "label")


@query
def j03_absent(spark, sf_dir):
    images = fixture(spark, sf_dir, "fx_images")
    return rows.absent(images, images.where("image_id % 3 = 0"), "filepath").select("image_id", "filepath")


@query
def j07_remaining(spark, sf_dir):
    images = fixture(spark, sf_dir, "fx_images")
    return rows.remaining(images, "filepath", images.where("image_id % 3 = 0"), images.where("image_id % 7 = 0")).select("image_id")


@query
def m13_quality_confusion(spark, sf_dir):
    d, l = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    both = d.select("doc_id", (F.col("n_chars") > 1000).alias("p")).join(l.select("doc_id", (F.col("quality") == 1).alias("g")), "doc_id")
    n = lambda g, p: F.count_if((F.col("g") == g) & (F.col("p") == p))
    c = both.agg(n(True, True).alias("tp"), n(False, True).alias("fp"), n(True, False).alias("fn"), n(False, False).alias("tn"))
    specificity, recall = metrics.ratio(F.col("tn"), F.col("tn") + F.col("fp")), metrics.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("*", F.round(specificity, 6).alias("specificity"), F.round((specificity + recall) / 2, 6).alias("balanced_accuracy"))


# texts and vectors ----------------------------------------------------------------------------------------------


@query
def x01_plain_names(spark, sf_dir):
    return read_table(spark, sf_dir, "part").select("p_partkey", text.plain_description(F.concat(F.col("p_name"), F.lit(" <b>"), F.col("p_type"), F.lit("</b>: "), F.col("p_brand"))).alias("plain"))


@query
def x03_token_f1(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    a, b = (text.tokens(text.plain_description(F.col(c))) for c in ("p_name", "p_type"))
    return p.select("p_partkey", F.round(text.token_f1(F.concat(a, b), F.concat(b, F.array(F.lit("the")))), 6).alias("f1"))


@query
def x08_prompt_ids(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_images").select("image_id", text.prompt_id(F.col("filepath")).alias("prompt_id"))


@query
def x05_mean_vectors(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("place", "v"))
    return e.groupBy("label", "place").agg(F.round(F.avg(F.col("v").cast("double")), 5).alias("mean"))


@query
def g06_strip_think(spark, sf_dir):
    d = read_table(spark, sf_dir, "conversations")
    t = F.concat(F.lit("<think>"), F.col("role"), F.when(F.col("turn") % 2 == 0, "</think>\n").otherwise("</think>"), F.col("text"))
    return d.select("conv_id", "turn", F.md5(text.strip_think(t)).alias("digest"))


QUERIES |= replies.QUERIES | scores.QUERIES | dialects.QUERIES | reports.QUERIES | details.QUERIES
ORACLE_SQL = oracles.ORACLE_SQL | replies.ORACLE_SQL | scores.ORACLE_SQL | dialects.ORACLE_SQL | reports.ORACLE_SQL
ORACLE_SQL |= details.oracle_sql(ORACLE_SQL)
