"""Registered queries on descriptions, severity, cell advantages, preferences and manifests, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import responses, text
from quillstone.operators import advantage, boxes, matching, metrics, rows, spatial
from quillstone.plans.oracles import COUNTS, IMAGES, TOKENS, matched
from quillstone.plans.replies import replies
from quillstone.sources import files
from quillstone.sources.fixtures import fixture, with_clause
from quillstone.sources.tables import read_table

QUERIES: dict = {}
GRID = 8


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _matched(spark, sf_dir, threshold, *columns):
    """Greedy matches with the named columns of both sides; they never leave their image's row, so that no join is needed."""
    m = matching.matched_boxes(fixture(spark, sf_dir, "fx_gt"), fixture(spark, sf_dir, "fx_pred"), threshold, "importance")
    side = lambda p, k: [F.col(f"{k}.{c}").alias(f"{p}_{c}") for c in columns]
    return m.select("image_id", "iou", F.col("g.idx").alias("gt_idx"), F.col("p.idx").alias("pred_idx"), *side("gt", "g"), *side("pred", "p"))


def _described(spark, sf_dir):
    """Matched pairs with the similarity of their descriptions: texts of the part whose key is the importance, each pair compared once.

    Importance is 1 to 100, so the parts that it can name are those keys.
    """
    m = files.written(_matched(spark, sf_dir, 0.5, "label", "importance"), "matches")
    part = read_table(spark, sf_dir, "part")
    words = lambda *c: text.tokens(text.plain_description(F.concat_ws(" ", *c)))
    one = part.select(F.col("p_partkey").alias("gt_importance"), words("p_name", "p_type").alias("a"))
    two = part.select(F.col("p_partkey").alias("pred_importance"), words("p_name", "p_brand").alias("b"))
    met = m.select("gt_importance", "pred_importance").distinct()
    like = met.join(one.hint("merge"), "gt_importance").join(two.hint("merge"), "pred_importance").select("gt_importance", "pred_importance", text.token_f1(F.col("a"), F.col("b")).alias("similarity"))
    # importance is 1 to 100 on both sides: 10,000 rows at most, whatever the number of boxes
    return m.join(like.hint("broadcast"), ["gt_importance", "pred_importance"]).withColumnRenamed("gt_label", "label")


@query
def m08_description_similarity(spark, sf_dir):
    return metrics.description_similarity(_described(spark, sf_dir), "label")


@query
def m08_detection_aware(spark, sf_dir):
    from quillstone.plans.catalog import _counts

    return metrics.detection_aware_mean(_described(spark, sf_dir), _counts(spark, sf_dir))


@query
def m09_worst_pairs(spark, sf_dir):
    worst = _described(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("similarity", "iou")})
    return worst.select("image_id", "gt_idx", "similarity", "iou").orderBy("similarity", "iou", "image_id", "gt_idx").limit(20)


@query
def m18_severity_agreement(spark, sf_dir):
    m = _matched(spark, sf_dir, 0.1, "importance")
    same = metrics.severity(F.col("gt_importance")) == metrics.severity(F.col("pred_importance"))
    return m.groupBy(metrics.severity(F.col("gt_importance")).alias("severity")).agg(F.count("*").alias("n"), F.round(F.avg(same.cast("double")), 6).alias("agreement"))


@query
def a07_cell_advantage(spark, sf_dir):
    gt = fixture(spark, sf_dir, "fx_gt")
    maps = spatial.penalty_map(gt, {"misalignment": 0.5}, 0.05, GRID).withColumnRenamed("image_id", "sample_id")
    samples = fixture(spark, sf_dir, "fx_images").select(F.col("image_id").alias("sample_id"), F.floor(F.col("image_id") / 40).alias("unique_id"))
    return advantage.cell_advantage(samples, maps).withColumn("advantage", F.round("advantage", 4))


def _preferences(spark, sf_dir):
    """Images of one group of six are compared, each way by a hash."""
    n = lambda c: fixture(spark, sf_dir, "fx_images").select(F.col("image_id").alias(c), F.floor(F.col("image_id") / 6).alias("g"))
    both = n("i").join(n("j").hint("merge"), "g").where("i != j")
    return both.select("i", "j", (F.conv(F.substring(F.md5(F.concat_ws("|", "i", "j")), 1, 1), 16, 10).cast("int") % 2).alias("value"))


@query
def a15_not_antisymmetric(spark, sf_dir):
    return advantage.not_antisymmetric(_preferences(spark, sf_dir))


@query
def a15_intransitive(spark, sf_dir):
    return advantage.intransitive(_preferences(spark, sf_dir))


@query
def a11_repeat_manifest(spark, sf_dir):
    images = fixture(spark, sf_dir, "fx_images").select("image_id")
    return rows.repeat_manifest(images, "image_id", 48, 4, 3, 8, "r")


@query
def g10_resized(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", (1 + F.col("o_orderkey") * 37 % 3001).alias("h"), (1 + F.col("o_custkey") * 53 % 2903).alias("w"))
    return o.select("o_orderkey", boxes.smart_resize(F.col("h"), F.col("w")).alias("s")).select("o_orderkey", "s.height", "s.width")


@query
def j01_mismatches(spark, sf_dir):
    return rows.mismatches(fixture(spark, sf_dir, "fx_gt").select("image_id"), fixture(spark, sf_dir, "fx_pred").select("image_id"), "image_id")


@query
def w01_format_gate(spark, sf_dir):
    told = F.when(F.col("image_id") % 3 != 0, F.replace(F.col("reply"), F.lit('"importance"'), F.lit('"description": "odd hand", "importance"'))).otherwise(F.col("reply"))
    return replies(spark, sf_dir).select("image_id", responses.format_gate(told).alias("passed"))


PLAIN = r"trim(regexp_replace(regexp_replace(lower(trim({})), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
WORDS = [TOKENS(PLAIN.format(f"concat(p_name, ' ', {c})")) for c in ("p_type", "p_brand")]
DESCRIBED = f"""{matched("0.5")}, pt AS (SELECT p_partkey, {WORDS[0]} AS a, {WORDS[1]} AS b FROM part WHERE p_partkey <= 100), -- importance is 1 to 100
  met AS (SELECT m.image_id, m.gt_idx, g.label, g.importance AS gi, p.importance AS pi, pr.iou FROM matches m JOIN fx_gt g ON g.image_id = m.image_id AND g.gt_idx = m.gt_idx
    JOIN fx_pred p ON p.image_id = m.image_id AND p.pred_idx = m.pred_idx JOIN pairs pr ON pr.image_id = m.image_id AND pr.gt_idx = m.gt_idx AND pr.pred_idx = m.pred_idx),
  words AS (SELECT x.p_partkey AS gi, y.p_partkey AS pi, x.a, y.b, unnest(list_distinct(x.a)) AS u FROM pt x, pt y),
  likes AS (SELECT gi, pi, 2.0 * CAST(sum(least(len(list_filter(a, lambda x: x = u)), len(list_filter(b, lambda x: x = u)))) AS DOUBLE) / (len(any_value(a)) + len(any_value(b))) AS similarity FROM words GROUP BY 1, 2),
  described AS (SELECT * FROM met JOIN likes USING (gi, pi))"""
LEVEL = "CASE WHEN {0} < 40 THEN 'negligible' WHEN {0} < 70 THEN 'moderate' ELSE 'critical' END".format
PREFERENCES = """WITH o AS (SELECT o_orderkey AS i, o_orderkey // 6 AS g FROM orders),
  prefs AS (SELECT a.g, a.i, b.i AS j, CAST(concat('0x', substr(md5(concat(a.i, '|', b.i)), 1, 1)) AS INTEGER) % 2 AS v FROM o a JOIN o b ON a.g = b.g WHERE a.i <> b.i)"""
_H, _W = "CAST(1 + o_orderkey * 37 % 3001 AS DOUBLE)", "CAST(1 + o_custkey * 53 % 2903 AS DOUBLE)"


def _resized(side: str) -> str:
    return f"CAST(CASE WHEN px > 1310720 THEN greatest(floor({side} / sqrt(h * w / 1310720) / 32), 1) * 32 WHEN px < 262144 THEN greatest(floor({side} * sqrt(262144 / h / w) / 32), 1) * 32 ELSE greatest(round_even({side} / 32, 0), 1) * 32 END AS BIGINT)"


ORACLE_SQL = {
    "m08_description_similarity": f"""{DESCRIBED} SELECT label, count(*) AS n, round(avg(similarity), 6) AS mean, round(quantile_cont(similarity, 0.5), 6) AS median,
        {", ".join(f"round(avg(CASE WHEN similarity >= {t} THEN 1.0 ELSE 0.0 END), 6) AS share_{round(100 * t)}" for t in (0.3, 0.5, 0.7))} FROM described GROUP BY 1""",
    "m08_detection_aware": f"""{DESCRIBED}, n AS (SELECT image_id, (SELECT count(*) FROM fx_gt g WHERE g.image_id = i.image_id) AS a, (SELECT count(*) FROM fx_pred p WHERE p.image_id = i.image_id) AS b FROM (SELECT o_orderkey AS image_id FROM orders) i),
        t AS (SELECT image_id, sum(similarity) AS s FROM described GROUP BY 1) SELECT count(*) AS n_images, round(avg(coalesce(s, 0) / greatest(a, b, 1)), 6) AS mean FROM n LEFT JOIN t USING (image_id)""",
    "m09_worst_pairs": f"{DESCRIBED} SELECT image_id, gt_idx, round(similarity, 6) AS similarity, round(iou, 6) AS iou FROM described ORDER BY 3, 4, 1, 2 LIMIT 20",
    "m18_severity_agreement": f"""{matched("0.1")} SELECT {LEVEL("g.importance")} AS severity, count(*) AS n, round(avg(CASE WHEN {LEVEL("g.importance")} = {LEVEL("p.importance")} THEN 1.0 ELSE 0.0 END), 6) AS agreement
        FROM matches m JOIN fx_gt g ON g.image_id = m.image_id AND g.gt_idx = m.gt_idx JOIN fx_pred p ON p.image_id = m.image_id AND p.pred_idx = m.pred_idx GROUP BY 1""",
    "a07_cell_advantage": f"""{with_clause("fx_gt")}, c AS (SELECT image_id, label, importance, CAST(floor(x0 * {GRID} / 1000) AS BIGINT) AS a, least(CAST(floor(x1 * {GRID} / 1000) AS BIGINT), {GRID}) AS b,
          CAST(floor(y0 * {GRID} / 1000) AS BIGINT) AS e, least(CAST(floor(y1 * {GRID} / 1000) AS BIGINT), {GRID}) AS f FROM fx_gt),
        ys AS (SELECT *, unnest(range(e, f)) AS y FROM c), cells AS (SELECT *, unnest(range(a, b)) AS x FROM ys),
        w AS (SELECT image_id, label, y, x, max(importance / 100.0) AS w FROM cells GROUP BY 1, 2, 3, 4),
        r AS (SELECT image_id AS sample_id, image_id // 40 AS unique_id, y, x, -sum(CASE label WHEN 'misalignment' THEN 0.5 ELSE 0.05 END * CAST(w AS DOUBLE)) AS r FROM w GROUP BY 1, 2, 3, 4),
        every AS (SELECT o_orderkey AS sample_id, o_orderkey // 40 AS unique_id FROM orders), places AS (SELECT DISTINCT unique_id, y, x FROM r),
        dense AS (SELECT e.unique_id, p.y, p.x, coalesce(r.r, 0) AS r FROM places p JOIN every e USING (unique_id) LEFT JOIN r ON r.sample_id = e.sample_id AND r.y = p.y AND r.x = p.x),
        m AS (SELECT unique_id, y, x, avg(r) AS mean, greatest(CASE WHEN count(*) > 1 THEN stddev_samp(r) END, CASE WHEN count(*) > 1 THEN 1e-6 END) AS sd FROM dense GROUP BY 1, 2, 3)
        SELECT r.sample_id, r.unique_id, CAST(r.y AS INTEGER) AS y, CAST(r.x AS INTEGER) AS x, round((r.r - mean) / sd, 4) AS advantage FROM r JOIN m ON m.unique_id = r.unique_id AND m.y = r.y AND m.x = r.x""",
    "a15_not_antisymmetric": f"{PREFERENCES} SELECT a.i, a.j FROM prefs a JOIN prefs b ON a.g = b.g AND a.i = b.j AND a.j = b.i WHERE a.i < a.j AND a.v + b.v <> 1",
    "a15_intransitive": f"""{PREFERENCES}, y AS (SELECT * FROM prefs WHERE v = 1) SELECT a.i, a.j, b.j AS k FROM y a JOIN y b ON a.g = b.g AND a.j = b.i
        LEFT JOIN y c ON c.g = a.g AND c.i = a.i AND c.j = b.j WHERE a.i <> b.j AND c.i IS NULL""",
    "a11_repeat_manifest": f"""{IMAGES}, m AS (SELECT image_id FROM fx_images ORDER BY md5(concat('r|', image_id)), image_id LIMIT 48), c AS (SELECT image_id, unnest([0, 1, 2, 3]) AS copy FROM m),
        p AS (SELECT *, row_number() OVER (ORDER BY md5(concat('r|deal|', image_id, '|', copy)), image_id, copy) - 1 AS n FROM c)
        SELECT image_id, copy, n // 24 AS iteration, n % 24 // 8 AS rank, n % 8 AS slot FROM p""",
    "g10_resized": f"""WITH s AS (SELECT o_orderkey, {_H} AS h, {_W} AS w FROM orders), t AS (SELECT *, greatest(round_even(h / 32, 0), 1) * greatest(round_even(w / 32, 0), 1) * 1024 AS px FROM s)
        SELECT o_orderkey, CASE WHEN greatest(h, w) <= 200 * least(h, w) THEN {_resized("h")} END AS height, CASE WHEN greatest(h, w) <= 200 * least(h, w) THEN {_resized("w")} END AS width FROM t""",
    "j01_mismatches": f"{COUNTS} SELECT image_id, n_gt AS n_left, n_pred AS n_right FROM counts WHERE n_gt <> n_pred",
    "w01_format_gate": f"{with_clause('fx_pred')} SELECT DISTINCT image_id, image_id % 8 = 7 OR (image_id % 8 IN (0, 1) AND image_id % 3 <> 0) AS passed FROM fx_pred",
}
