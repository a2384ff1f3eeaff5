"""SQL with the rows of the registered queries, for DuckDB."""

from __future__ import annotations

from quillstone.sources.fixtures import with_clause

BOXES = with_clause("fx_gt", "fx_pred")
PAIRS = f"""{BOXES}, inter AS (
    SELECT g.image_id, g.gt_idx, p.pred_idx, g.label AS gt_label, p.label AS pred_label,
        CAST(greatest(least(g.x1, p.x1) - greatest(g.x0, p.x0), 0) * greatest(least(g.y1, p.y1) - greatest(g.y0, p.y0), 0) AS DOUBLE) AS i,
        CAST((g.x1 - g.x0) * (g.y1 - g.y0) + (p.x1 - p.x0) * (p.y1 - p.y0) AS DOUBLE) AS areas,
        pow((g.x0 + g.x1 - p.x0 - p.x1) / 2.0, 2) + pow((g.y0 + g.y1 - p.y0 - p.y1) / 2.0, 2) AS centre,
        pow(greatest(g.x1, p.x1) - least(g.x0, p.x0), 2) + pow(greatest(g.y1, p.y1) - least(g.y0, p.y0), 2) AS diagonal
    FROM fx_gt g JOIN fx_pred p USING (image_id)),
  pairs AS (SELECT *, CASE WHEN areas - i > 0 THEN i / (areas - i) ELSE 0 END AS iou FROM inter)"""
FITS = "(gt_label = pred_label OR (gt_label = 'both' AND pred_label IN ('artifact', 'misalignment')) OR (pred_label = 'both' AND gt_label IN ('artifact', 'misalignment')))"


def matched(threshold: str, labels: bool = True) -> str:
    """CTEs up to matches (image_id, t, pred_idx, gt_idx): greedy, one ranked pair after the other."""
    head = PAIRS.replace("WITH ", "WITH RECURSIVE ", 1)
    return f"""{head},
  ths AS (SELECT CAST(unnest([{threshold}]) AS DOUBLE) AS t),
  ranked AS (SELECT image_id, t, pred_idx, gt_idx, row_number() OVER (PARTITION BY image_id, t ORDER BY iou DESC, pred_idx DESC, gt_idx DESC) AS rn
    FROM pairs JOIN ths ON iou >= t {"WHERE " + FITS if labels else ""}),
  walk AS (
    SELECT image_id, t, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS ps, CAST([] AS BIGINT[]) AS gs FROM ranked WHERE rn = 1
    UNION ALL
    SELECT w.image_id, w.t, r.rn,
      CASE WHEN list_contains(ps, r.pred_idx) OR list_contains(gs, r.gt_idx) THEN ps ELSE list_append(ps, CAST(r.pred_idx AS BIGINT)) END,
      CASE WHEN list_contains(ps, r.pred_idx) OR list_contains(gs, r.gt_idx) THEN gs ELSE list_append(gs, CAST(r.gt_idx AS BIGINT)) END
    FROM walk w JOIN ranked r ON r.image_id = w.image_id AND r.t = w.t AND r.rn = w.rn + 1),
  ends AS (SELECT image_id, t, arg_max(ps, rn) AS ps, arg_max(gs, rn) AS gs FROM walk GROUP BY ALL),
  matches AS (SELECT image_id, t, unnest(ps) AS pred_idx, unnest(gs) AS gt_idx FROM ends)"""


OUTCOMES = f"""{matched("0.5")},
  found AS (
    SELECT g.image_id, CASE WHEN m.gt_idx IS NULL THEN 'fn' ELSE 'tp' END AS outcome, g.label FROM fx_gt g LEFT JOIN matches m ON g.image_id = m.image_id AND g.gt_idx = m.gt_idx
    UNION ALL
    SELECT p.image_id, 'fp', p.label FROM fx_pred p ANTI JOIN matches m ON p.image_id = m.image_id AND p.pred_idx = m.pred_idx)"""


def prf(source: str, keys: str) -> str:
    return f"""SELECT {keys}, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1
  FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM {source})"""


COUNTS = f"""{with_clause("fx_images", "fx_gt", "fx_pred")}, counts AS (
    SELECT image_id, coalesce(n_gt, 0) AS n_gt, coalesce(n_pred, 0) AS n_pred FROM fx_images
    LEFT JOIN (SELECT image_id, count(*) AS n_gt FROM fx_gt GROUP BY 1) USING (image_id)
    LEFT JOIN (SELECT image_id, count(*) AS n_pred FROM fx_pred GROUP BY 1) USING (image_id))"""
REWARDS = with_clause("fx_rewards")
SCALARS = f"""{REWARDS}, scalars AS (
    SELECT unique_id, sample_id, sum(CAST(reward AS DOUBLE) * CASE reward_name WHEN 'value' THEN 0.5 WHEN 'key' THEN 0.3 ELSE 0.2 END) AS scalar
    FROM fx_rewards GROUP BY 1, 2)"""
GROUP_ADVANTAGE = """(scalar - avg(scalar) OVER (PARTITION BY unique_id)) / greatest(stddev_pop(scalar) OVER (PARTITION BY unique_id), 1e-6)"""
IMAGES = with_clause("fx_images")
PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({})), '<[^>]+>', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
TOKENS = "list_filter(string_split({}, ' '), lambda t: t <> '')".format
NAME, TYPE = (TOKENS(PLAIN.format(c)) for c in ("p_name", "p_type"))

ORACLE_SQL = {
    "j06_candidate_pairs": f"{PAIRS} SELECT image_id, gt_idx, pred_idx, round(iou, 6) AS iou FROM pairs WHERE iou >= 0.1",
    "g12_diou": f"{PAIRS} SELECT image_id, gt_idx, pred_idx, round(iou, 6) AS iou, round(iou - CASE WHEN diagonal > 0 THEN centre / diagonal ELSE 0 END, 6) AS diou FROM pairs",
    "k03_greedy_matches": f"{matched('0.5')} SELECT image_id, pred_idx, gt_idx FROM matches",
    "k04_agnostic_matches": f"{matched('0.5', labels=False)} SELECT image_id, pred_idx, gt_idx FROM matches",
    "k06_outcomes": f"{OUTCOMES} SELECT image_id, outcome, label, count(*) AS n FROM found GROUP BY 1, 2, 3",
    "m03_instance_metrics": f"""{OUTCOMES}, sums AS (
        SELECT coalesce(label, 'all') AS label, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn
        FROM found GROUP BY ROLLUP (label)) {prf('sums', 'label')}""",
    "m04_threshold_sweep": f"""{matched('0.1, 0.2, 0.25, 0.3, 0.4, 0.5')}, sums AS (
        SELECT ths.t AS threshold, count(m.t) AS tp, (SELECT count(*) FROM fx_pred) - count(m.t) AS fp, (SELECT count(*) FROM fx_gt) - count(m.t) AS fn
        FROM ths LEFT JOIN matches m ON m.t = ths.t GROUP BY 1) {prf('sums', 'threshold')}""",
    "m01_image_confusion": f"""{COUNTS}, c AS (SELECT count(*) FILTER (n_gt > 0 AND n_pred > 0) AS tp, count(*) FILTER (n_gt = 0 AND n_pred > 0) AS fp,
          count(*) FILTER (n_gt > 0 AND n_pred = 0) AS fn, count(*) FILTER (n_gt = 0 AND n_pred = 0) AS tn FROM counts)
        {prf('c', 'tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy')}""",
    "m05_count_metrics": f"""{COUNTS} SELECT count(*) AS n_images, CAST(sum(n_gt) AS BIGINT) AS total_gt, CAST(sum(n_pred) AS BIGINT) AS total_pred, round(avg(n_gt), 6) AS mean_gt, round(avg(n_pred), 6) AS mean_pred,
        round(avg(abs(n_gt - n_pred)), 6) AS mae, round(avg(CASE WHEN n_gt = n_pred THEN 1.0 ELSE 0.0 END), 6) AS exact_share,
        round(CASE WHEN stddev_pop(n_gt) = 0 OR stddev_pop(n_pred) = 0 THEN 0 ELSE corr(n_gt, n_pred) END, 6) AS pearson FROM counts""",
    "m06_count_histogram": f"{COUNTS} SELECT 'gt' AS side, n_gt AS boxes, count(*) AS images FROM counts GROUP BY 1, 2 UNION ALL SELECT 'pred', n_pred, count(*) FROM counts GROUP BY 1, 2",
    "m16_box_sizes": f"{BOXES} SELECT x1 - x0 AS width, y1 - y0 AS height, count(*) AS n FROM fx_gt GROUP BY 1, 2 ORDER BY n DESC, width, height LIMIT 20",
    "w11_map_scalars": f"""{BOXES}, c AS (SELECT image_id, label, importance, CAST(floor(x0 * 64 / 1000) AS BIGINT) AS a, least(CAST(floor(x1 * 64 / 1000) AS BIGINT), 64) AS b,
          CAST(floor(y0 * 64 / 1000) AS BIGINT) AS e, least(CAST(floor(y1 * 64 / 1000) AS BIGINT), 64) AS f FROM fx_gt),
        ys AS (SELECT *, unnest(range(e, f)) AS y FROM c), cells AS (SELECT *, unnest(range(a, b)) AS x FROM ys),
        w AS (SELECT image_id, label, y, x, max(importance) AS w FROM cells GROUP BY 1, 2, 3, 4),
        s AS (SELECT image_id, CAST(sum(CASE WHEN label = 'misalignment' THEN w ELSE 0 END) AS DOUBLE) AS m, CAST(sum(CASE WHEN label <> 'misalignment' THEN w ELSE 0 END) AS DOUBLE) AS o FROM w GROUP BY 1)
        SELECT image_id, round(-(0.5::DOUBLE * m + 0.05::DOUBLE * o) / 409600, 6) AS scalar FROM s""",
    "a01_group_advantage": f"{SCALARS} SELECT sample_id, unique_id, round({GROUP_ADVANTAGE}, 6) AS advantage FROM scalars",
    "a01_batch_deviation": f"{SCALARS} SELECT sample_id, unique_id, round((scalar - avg(scalar) OVER (PARTITION BY unique_id)) / greatest((SELECT stddev_pop(scalar) FROM scalars), 1e-6), 6) AS advantage FROM scalars",
    "a02_decoupled_advantage": f"""{REWARDS}, z AS (SELECT unique_id, sample_id, reward_name,
          (CAST(reward AS DOUBLE) - avg(CAST(reward AS DOUBLE)) OVER w) / greatest(stddev_pop(CAST(reward AS DOUBLE)) OVER w, 1e-6) AS z FROM fx_rewards WINDOW w AS (PARTITION BY unique_id, reward_name)),
        s AS (SELECT unique_id, sample_id, sum(z * CASE reward_name WHEN 'value' THEN 0.5 WHEN 'key' THEN 0.3 ELSE 0.2 END) AS s FROM z GROUP BY 1, 2)
        SELECT sample_id, unique_id, round((s - (SELECT avg(s) FROM s)) / greatest((SELECT stddev_pop(s) FROM s), 1e-6), 6) AS advantage FROM s""",
    "a03_moments": f"{SCALARS} SELECT count(*) AS n, round(avg(scalar), 6) AS mean, round(stddev_pop(scalar), 6) AS sd FROM scalars",
    "a04_group_diagnostics": f"""{SCALARS}, g AS (SELECT unique_id, avg(scalar) AS m, stddev_pop(scalar) AS sd FROM scalars GROUP BY 1)
        SELECT round(avg(sd), 6) AS sd_mean, round(max(sd), 6) AS sd_max, round(min(sd), 6) AS sd_min, round(stddev_pop(m), 6) AS mean_sd, round(avg(CASE WHEN sd < 1e-6 THEN 1.0 ELSE 0.0 END), 6) AS flat_share FROM g""",
    "a05_clipped": f"{SCALARS} SELECT sample_id, unique_id, round(least(greatest({GROUP_ADVANTAGE}, -1.0), 1.0), 6) AS advantage FROM scalars",
    "a06_group_deviation": f"{SCALARS} SELECT sample_id, unique_id, round(coalesce(stddev_samp(scalar) OVER (PARTITION BY unique_id), 0), 6) AS deviation FROM scalars",
    "a09_wrong_groups": "SELECT user_id AS unique_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) <> 100",
    "a10_mixed_sample": f"""{IMAGES}, n AS (SELECT count(*) FILTER (split = 'train') AS a, count(*) AS b FROM fx_images),
        r AS (SELECT image_id, split, row_number() OVER (PARTITION BY split ORDER BY md5(concat('mix|', image_id)), image_id) AS rn FROM fx_images)
        SELECT image_id, split AS part FROM r, n WHERE rn <= CASE split WHEN 'train' THEN 500 * a // b ELSE 500 - 500 * a // b END""",
    "a13_shards": f"{IMAGES} SELECT image_id, CAST(least((row_number() OVER (ORDER BY image_id) - 1) // greatest(count(*) OVER () // 7, 1), 6) AS BIGINT) AS shard FROM fx_images",
    "a14_batches": f"{IMAGES} SELECT image_id, CAST((row_number() OVER (ORDER BY md5(concat('3|0|1|', image_id)), image_id) - 1) // 32 AS BIGINT) AS batch FROM fx_images",
    "w08_mean_reward": f"{REWARDS} SELECT sample_id, round(coalesce(avg(CAST(reward AS DOUBLE)), 0.5), 6) AS scalar FROM fx_rewards GROUP BY 1",
    "m17_reward_summary": f"{REWARDS} SELECT reward_name, count(*) AS n, round(avg(CAST(reward AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST(reward AS DOUBLE)), 6) AS sd FROM fx_rewards GROUP BY 1",
    "p02_keyword_routes": f"{IMAGES} SELECT image_id, k AS route FROM fx_images, (SELECT unnest(['sana', 'flux2', 'test', 'train']) AS k) WHERE contains(lower(filepath), k)",
    "p03_split": f"{IMAGES} SELECT split, count(*) AS n FROM fx_images GROUP BY 1",
    "p05_remapped": f"{IMAGES} SELECT image_id, CASE WHEN gen = 'sana' THEN concat('/a', substr(filepath, 15)) ELSE concat('/b', substr(filepath, 10)) END AS filepath FROM fx_images",
    "p06_names": f"{IMAGES} SELECT image_id, gen AS generator, concat(split, '_', lpad(cast(image_id AS string), 6, '0'), '_', gen) AS unique_name FROM fx_images",
    "p12_funnel": f"{COUNTS} SELECT CASE WHEN n_gt = 0 THEN 'no_gt' WHEN n_pred = 0 THEN 'no_prediction' WHEN n_gt <> n_pred THEN 'count_differs' ELSE 'ok' END AS reason, count(*) AS n FROM counts GROUP BY 1",
    "s09_union_by_name": "SELECT lang, role, count(*) AS n FROM (SELECT lang, NULL AS role FROM documents UNION ALL SELECT NULL, role FROM conversations) GROUP BY 1, 2",
    # images may share a path or a name: from a million orders on, fx_images cuts their numbers to six digits
    "j02_latest_by_basename": f"""{with_clause("fx_images", "fx_pred")}, named AS (SELECT image_id, string_split(filepath, '/')[-1] AS name FROM fx_images),
        ranked AS (SELECT name, pred_idx, label, row_number() OVER (PARTITION BY name ORDER BY pred_idx DESC, image_id DESC) AS rn FROM fx_pred JOIN named USING (image_id))
        SELECT image_id, pred_idx, label FROM named JOIN ranked USING (name) WHERE rn = 1""",
    "j03_absent": f"{IMAGES} SELECT image_id, filepath FROM fx_images WHERE filepath NOT IN (SELECT filepath FROM fx_images WHERE image_id % 3 = 0)",
    "j07_remaining": f"{IMAGES} SELECT image_id FROM fx_images WHERE filepath NOT IN (SELECT filepath FROM fx_images WHERE image_id % 3 = 0 OR image_id % 7 = 0)",
    "m13_quality_confusion": """WITH c AS (SELECT count(*) FILTER (quality = 1 AND n_chars > 1000) AS tp, count(*) FILTER (quality <> 1 AND n_chars > 1000) AS fp,
          count(*) FILTER (quality = 1 AND n_chars <= 1000) AS fn, count(*) FILTER (quality <> 1 AND n_chars <= 1000) AS tn FROM documents JOIN labels USING (doc_id))
        SELECT tp, fp, fn, tn, round(CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END, 6) AS specificity,
          round((CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END + CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END) / 2, 6) AS balanced_accuracy FROM c""",
    "x01_plain_names": f"""SELECT p_partkey, {PLAIN.format("concat(p_name, ' <b>', p_type, '</b>: ', p_brand)")} AS plain FROM part""",
    "x03_token_f1": f"""WITH t AS (SELECT p_partkey, list_concat({NAME}, {TYPE}) AS a, list_append({TYPE}, 'the') AS b FROM part),
        h AS (SELECT p_partkey, sum(least(len(list_filter(a, lambda x: x = u)), len(list_filter(b, lambda x: x = u)))) AS hits FROM (SELECT *, unnest(list_distinct(a)) AS u FROM t) GROUP BY 1)
        SELECT p_partkey, round(2.0 * CAST(hits AS DOUBLE) / (len(a) + len(b)), 6) AS f1 FROM t JOIN h USING (p_partkey)""",
    "x08_prompt_ids": f"""{IMAGES}, h AS (SELECT image_id, CAST(concat('0x', substr(sha256(filepath), 1, 16)) AS UBIGINT) AS u FROM fx_images)
        SELECT image_id, CAST(CASE WHEN u >= 9223372036854775808 THEN CAST(u AS HUGEINT) - 18446744073709551616 ELSE u END AS BIGINT) AS prompt_id FROM h""",
    "x05_mean_vectors": """WITH e AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS place FROM embeddings)
        SELECT label, CAST(place AS INTEGER) AS place, round(avg(CAST(v AS DOUBLE)), 5) AS mean FROM e GROUP BY 1, 2""",
    "g06_strip_think": "SELECT conv_id, turn, md5(CASE WHEN turn % 2 = 0 THEN text ELSE concat('<think>', role, '</think>', text) END) AS digest FROM conversations",
}
