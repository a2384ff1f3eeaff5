"""Registered queries on streams with timers, files of images, maps with coverage and floors, preferences, places and further forms of other operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import records
from quillstone.operators import advantage, assignment, boxes, hooks, matching, metrics, regions, rows, spatial
from quillstone.plans import reports, scores
from quillstone.plans.oracles import BOXES, COUNTS, GROUP_ADVANTAGE, IMAGES, SCALARS, matched
from quillstone.plans.replies import GROUP, _events
from quillstone.plans.reports import _LABELS, GRID, REWARD, UNION, images_of, sides
from quillstone.sources import files
from quillstone.sources.fixtures import fixture
from quillstone.sources.tables import read_table
from quillstone.streaming import groups

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# streams and files ----------------------------------------------------------------------------------------------


@query
def t01_timed_groups(spark, sf_dir):
    """Complete groups and, once a second has passed without a member, what is left of them, as rows of one stream."""
    samples = _events(spark, sf_dir).select(F.col("event_id").alias("sample_id"), F.col("user_id").alias("unique_id"))
    out = groups.drained(groups.timed_groups(samples, GROUP, 1000), "timed", timers=True)
    return out.groupBy("unique_id", "complete").agg(F.count("*").alias("groups"), F.sum(F.size("members")).alias("members"))


@query
def t03_expiring(spark, sf_dir):
    """First rows by key; that a key was seen is known for an hour."""
    path, events = files.work_path(spark, "expiring"), _events(spark, sf_dir).select("user_id")
    groups.append_once(events, "user_id", F.col("user_id") % 3 != 0, path, keep_ms=3_600_000)
    return files.read_outcomes(spark, events.schema, path)


@query
def t03_by_event_time(spark, sf_dir):
    path, events = files.work_path(spark, "by-time"), _events(spark, sf_dir).select("user_id", "ts")
    groups.append_once(events, "user_id", F.col("user_id") % 3 != 0, path, keep_ms=3_600_000, time="ts")
    return files.read_outcomes(spark, events.schema, path).select("user_id", "part")


@query
def m16_image_report(spark, sf_dir):
    """PNG files of the suppliers, some missing and some spoilt, written, listed with faults and repeats, and read."""
    k = F.col("s_suppkey")
    s = read_table(spark, sf_dir, "supplier").select(k, F.format_string("s%d/img_%d.png", k % 10, k).alias("path"))
    number = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    magic = F.when(k % 11 == 0, F.unhex(F.lit("FFD8FFE0"))).otherwise(F.unhex(F.lit("89504E470D0A1A0A")))
    content = F.concat(magic, F.unhex(F.lit("0000000D49484452")), number(1 + k % 40), number(1 + k % 30), F.lit("rest").cast("binary"))
    root = files.work_path(spark, "images")
    files.write_files(s.where(k % 7 != 0).select("path", content.alias("content")), root).write.parquet(files.work_path(spark, "written"))
    line = F.when(k % 13 == 0, "not json").when(k % 17 == 0, '{"other": 1}').otherwise(F.to_json(F.struct(F.col("path").alias("filename"))))
    listing = files.work_path(spark, "listing")
    s.select(line.alias("value")).unionAll(s.where(k % 5 == 0).select(line)).unionAll(s.limit(1).select(F.lit("  "))).write.text(listing)
    figures, sizes, _ = files.image_report(spark, listing, root)
    total = figures.select(F.explode(F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).alias("n")) for c in ("total", "missing", "errors", "sizes")])).alias("f")).select("f.*")
    return total.unionByName(sizes.select(F.concat_ws("x", "width", "height").alias("figure"), "n"))


@query
def s02_prompt_set(spark, sf_dir):
    """A split as JSON lines, which go before its text, and one as a text alone."""
    images, folder = fixture(spark, sf_dir, "fx_images"), files.work_path(spark, "prompts")
    of = lambda split: images.where(F.col("split") == split)
    of("test").select(F.col("caption").alias("prompt"), "gen").write.json(f"{folder}/test.jsonl")
    of("test").select(F.lit("not read").alias("value")).write.text(f"{folder}/test.txt")
    of("train").select(F.concat(F.lit("  "), "caption", F.lit(" \n\n"))).write.text(f"{folder}/train.txt")
    read = lambda split: files.read_prompt_set(spark, folder, split).select(F.lit(split).alias("split"), "prompt")
    return read("test").unionByName(read("train")).groupBy("split", "prompt").agg(F.count("*").alias("n"))


@query
def s09_many_files(spark, sf_dir):
    """Two JSON files with different columns as one table."""
    at = files.work_path(spark, "many")
    read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size")).write.json(f"{at}/a")
    read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).write.json(f"{at}/b")
    return files.read_many(spark, [f"{at}/a", f"{at}/b"]).select("id", "size", "name")


# maps -----------------------------------------------------------------------------------------------------------


def _sums(penalties):
    return penalties.groupBy("image_id").agg(F.count("*").alias("cells"), F.round(F.sum("penalty"), 10).alias("penalty"))


@query
def w09_covered(spark, sf_dir):
    """Penalties of both classes less the share of the image that the class covers, each at least 0.02."""
    return _sums(spatial.penalty_map(fixture(spark, sf_dir, "fx_gt"), {"misalignment": 0.5}, 0.05, GRID, normalised=("misalignment", "artifact"), least=0.02))


@query
def w09_unweighted(spark, sf_dir):
    """Without importance: a covered cell counts once for each label."""
    return _sums(spatial.penalty_map(fixture(spark, sf_dir, "fx_gt"), {"misalignment": 0.5}, 0.05, GRID, weighted=False, normalised=("misalignment",), least=0.06))


@query
def w09_counted(spark, sf_dir):
    """Without importance, stacked: a cell counts every box, and so does coverage."""
    return _sums(spatial.penalty_map(fixture(spark, sf_dir, "fx_gt"), {"misalignment": 0.5}, 0.05, GRID, stacking=True, weighted=False, normalised=("artifact",), least=0.01))


# preferences and places -----------------------------------------------------------------------------------------


@query
def a15_asymmetric(spark, sf_dir):
    return advantage.asymmetric(scores._preferences(spark, sf_dir))


@query
def a15_antisymmetric(spark, sf_dir):
    """Values -1, 0 and 1 whose two sides mostly cancel, and a diagonal that is not always 0."""
    n = lambda c: fixture(spark, sf_dir, "fx_images").select(F.col("image_id").alias(c), F.floor(F.col("image_id") / 6).alias("g"))
    i, j = F.col("i"), F.col("j")
    value = F.when(i == j, (i % 7 == 0).cast("int")).when(i < j, (i + 2 * j) % 3 - 1).otherwise(1 - (j + 2 * i) % 3 + ((i + j) % 5 == 0).cast("int"))
    both = n("i").join(n("j").hint("merge"), "g").select("i", "j", value.cast("int").alias("value"))
    return advantage.unbalanced(both)


@query
def a15_violations(spark, sf_dir):
    return advantage.violations(scores._preferences(spark, sf_dir))


@query
def j01_misplaced(spark, sf_dir):
    """Places at which the images stand in another order, in which some neighbours are exchanged."""
    images, i = images_of(spark, sf_dir), F.col("image_id")
    return rows.misplaced(images, images, "image_id", [i], [i + F.when(i % 50 == 7, 1.5).otherwise(0.0)])


@query
def j01_by_place(spark, sf_dir):
    i = F.col("image_id")
    met = rows.joined_by_place(images_of(spark, sf_dir, "caption"), images_of(spark, sf_dir, "split"), "image_id", [i], [i])
    return met.select("index", "image_id", "caption", "split")


@query
def j04_by_place(spark, sf_dir):
    """As many rows on both sides: they meet by place, whatever their keys."""
    i = F.col("image_id")
    met = rows.joined_leniently(images_of(spark, sf_dir, "caption"), images_of(spark, sf_dir, "split"), "image_id", [i], [F.desc("image_id")])
    return met.select("index", "image_id", "caption", "split")


@query
def j12_remaining(spark, sf_dir):
    """Lines whose numbered output is not there yet."""
    images = images_of(spark, sf_dir)
    done = images.select(F.format_string("%04d.png", F.col("image_id")).alias("file")).where("file not like '%7.png'")
    return rows.numbered_outputs(images, done, F.col("image_id"))[1].select("image_id", "file")


@query
def r10_multisets(spark, sf_dir):
    """Labels of an image that one side holds more often than the other."""
    gt, pred = sides(spark, sf_dir)
    return rows.multiset_difference(gt.select("image_id", "label"), pred.select("image_id", "label")).groupBy("image_id", "label", "side").agg(F.count("*").alias("n"))


@query
def a13_balanced(spark, sf_dir):
    return rows.shards(images_of(spark, sf_dir), 7, F.col("image_id"), form="balanced")


@query
def a13_strided(spark, sf_dir):
    return rows.shards(images_of(spark, sf_dir), 7, F.col("image_id"), form="strided")


@query
def a11_even_manifest(spark, sf_dir):
    """50 prompts become 54, with which the 24 places of an iteration are filled evenly."""
    return rows.repeat_manifest(images_of(spark, sf_dir), "image_id", rows.even_step(50, 4, 3, 8), 4, 3, 8, "r")


@query
def a12_even_manifest(spark, sf_dir):
    return rows.group_manifest(images_of(spark, sf_dir), "image_id", rows.even_step(50, 4, 6, 4, whole_groups=True), 4, 6, "g")


# figures --------------------------------------------------------------------------------------------------------


@query
def a04_advantages(spark, sf_dir):
    from quillstone.plans.catalog import _scalars

    figures = advantage.advantage_figures(advantage.group_advantage(_scalars(spark, sf_dir)))
    return figures.select(*[F.round(c, 5).alias(c) for c in figures.columns])


@query
def m08_counts(spark, sf_dir):
    from quillstone.plans.catalog import _counts

    m = scores._matched(spark, sf_dir, 0.5, "importance")
    told = lambda c, n, none: F.when(F.col(c) % n == 0, none).otherwise("told")
    return metrics.description_counts(m.select("image_id", told("gt_importance", 5, F.lit("")).alias("gt_desc"), told("pred_importance", 7, F.lit(None)).alias("pred_desc")), _counts(spark, sf_dir))


@query
def m15_combined(spark, sf_dir):
    gt, pred = sides(spark, sf_dir)
    return regions.union_report(regions.class_boxes(images_of(spark, sf_dir), gt, pred), combined=True)


@query
def k04_eps_matches(spark, sf_dir):
    gt, pred = sides(spark, sf_dir)
    m = matching.matched_boxes(gt, pred, 0.5, labels=False, eps=1e-9)
    return m.select("image_id", F.col("p.idx").alias("pred_idx"), F.col("g.idx").alias("gt_idx"))


@query
def g01_records(spark, sf_dir):
    """Counts of boxes and records with faults, and how many records are kept without them."""
    moved = fixture(spark, sf_dir, "fx_gt").withColumns({"x0": F.col("x0") + 300, "y1": F.col("y1") - 60})
    audited = boxes.audit(moved)
    kept = boxes.audited_records(images_of(spark, sf_dir), audited, "image_id", skip_invalid=True).agg(F.count("*").alias("kept"))
    return boxes.audit_counts(audited, "image_id").join(F.broadcast(kept))  # one row each


@query
def g02_strict(spark, sf_dir):
    """JSON texts of single boxes with numbers that are whole, fractions or texts, and labels in either case, by their types."""
    return _strict(spark, sf_dir).select("image_id", "gt_idx", records.strict_boxes(F.col("t")).alias("valid"))


def _strict(spark, sf_dir):
    fixture(spark, sf_dir, "fx_gt")  # registers lineitem
    return spark.sql(f"{STRICT} SELECT image_id, gt_idx, t FROM told")


@query
def g15_phrases(spark, sf_dir):
    found = regions.region_phrases(reports.g15_hot_regions(spark, sf_dir))
    return found.select("image_id", F.array_join("phrases", "; ").alias("phrases"))


@query
def r04_batch_prompts(spark, sf_dir):
    """Prompts of an edit batch in both styles, with the rule, and without feedback."""
    i = F.col("image_id")
    feedback = F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("fix "), "split"))
    style = F.when(i % 2 == 0, "heatmap").otherwise("boxes")
    made = [records.batch_edit_prompt(F.col("caption"), feedback, style, no_text=rule) for rule in (False, True)]
    return images_of(spark, sf_dir, "caption", "split").select("image_id", F.md5(made[0]).alias("plain"), F.md5(made[1]).alias("with_rule"))


@query
def w06_greedy_telemetry(spark, sf_dir):
    """Telemetry of the gated rewards over greedy pairs, which SQL can follow."""
    gt, pred = sides(spark, sf_dir)
    r = assignment.gated(assignment.rewards(gt, pred, reports._greedy(spark, sf_dir), images_of(spark, sf_dir)), reports._gate(spark, sf_dir))
    return assignment.telemetry(r)


# SQL functions --------------------------------------------------------------------------------------------------


@query
def u03_sql(spark, sf_dir):
    """A reward that is called by name from SQL."""
    hooks.register_sql(spark, "half_value", lambda f: f["value"] / 2)
    read_table(spark, sf_dir, "events").createOrReplaceTempView("events_to_score")
    return spark.sql("SELECT event_id, round(half_value(struct(value)), 6) AS reward FROM events_to_score")


@query
def b12_sql(spark, sf_dir):
    """The boxes of JSON lists, some with items that are none, as a table function of SQL."""
    hooks.register_boxes_of(spark)
    one = F.struct("pred_idx", F.to_json(F.struct(F.array("x0", "y0", "x1", "y1").alias("box_2d"), "label")).alias("t"))
    per = fixture(spark, sf_dir, "fx_pred").groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_list(one))["t"], ", ").alias("t"))
    first = F.when(F.col("image_id") % 3 == 0, '{"label": "none"}, 7, {"box_2d": [1, null, 3, 4]}, ').otherwise("")
    per.select("image_id", F.concat(F.lit("["), first, "t", F.when(F.col("image_id") % 10 == 1, "").otherwise("]")).alias("reply")).createOrReplaceTempView("replies_to_read")
    return spark.sql("SELECT image_id, b.place, b.label, b.x0, b.y1 FROM replies_to_read, LATERAL boxes_of(reply) b")


# SQL ------------------------------------------------------------------------------------------------------------

#: In SQL that Spark and DuckDB both run.
STRICT = f"""{reports.G}, told AS (SELECT image_id, gt_idx, concat('[{{"label": ', CASE gt_idx % 5 WHEN 0 THEN concat('"', upper(label), '"') WHEN 1 THEN 'null' ELSE concat('"', label, '"') END, ', "box_2d": [',
  CASE (image_id + gt_idx) % 6 WHEN 0 THEN concat(x0, '.0') WHEN 1 THEN concat('"', x0, '"') WHEN 2 THEN concat(x0, '.5') ELSE concat('', x0) END, ', ', y0, ', ', x1, ', ', y1 + CASE WHEN image_id % 8 = 0 THEN 300 ELSE 0 END, ']}}',
  CASE WHEN image_id % 11 = 0 THEN ', 5' WHEN image_id % 13 = 0 THEN ' 5' ELSE '' END, ']') AS t FROM fx_gt)"""
_ALPHA = "CASE label WHEN 'misalignment' THEN 0.5::DOUBLE ELSE 0.05::DOUBLE END"
_PLACES = f"{IMAGES}, n AS (SELECT image_id, caption, split, row_number() OVER (ORDER BY image_id) - 1 AS i, count(*) OVER () AS n FROM fx_images)"
_UNION_FIGURES = """avg(iou) AS mean_iou, coalesce(avg(CASE WHEN NOT both_empty THEN iou END), 0) AS mean_iou_non_empty, avg(CASE WHEN iou >= 0.5 THEN 1.0 ELSE 0.0 END) AS share_50, count(*) FILTER (both_empty) AS both_empty,
  count(*) FILTER (no_gt) AS no_gt, avg(CASE WHEN no_gt THEN 1.0 ELSE 0.0 END) AS no_gt_share, count(*) FILTER (no_pred) AS no_pred, avg(CASE WHEN no_pred THEN 1.0 ELSE 0.0 END) AS no_pred_share, coalesce(avg(CASE WHEN no_gt THEN CASE WHEN no_pred THEN 1.0 ELSE 0.0 END END), 0) AS clean_accuracy"""
_MEANS = ("mean_iou", "mean_iou_non_empty", "share_50", "no_gt_share", "no_pred_share", "clean_accuracy")
_SUMS = ("n", "both_empty", "no_gt", "no_pred")
_REGION = "[" + ", ".join(f"'{r}'" for row in regions.REGIONS for r in row) + "]"


def _manifest(m: int, k: int, place: str) -> str:
    return f"""{IMAGES}, m AS (SELECT image_id, row_number() OVER (ORDER BY md5(concat('g|deal|', image_id)), image_id) - 1 AS n FROM (SELECT image_id FROM fx_images ORDER BY md5(concat('g|', image_id)), image_id LIMIT {m})),
        c AS (SELECT *, unnest(range({k})) AS copy FROM m) SELECT image_id, CAST(copy AS INTEGER) AS copy, {place} FROM c"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _batch_sql(rule: bool) -> str:
    fill = lambda t: f"replace(replace(replace(replace({_text(t)}, '{{caption}}', caption), '{{guide}}', guide), '{{rule}}', {_text(records.NO_TEXT if rule else '')}), '{{feedback}}', feedback)"
    return f"md5(CASE WHEN feedback = '' THEN {fill(records.BATCH_PLAIN)} ELSE {fill(records.BATCH_EDIT)} END)"


def oracle_sql(known: dict[str, str]) -> dict[str, str]:
    """known: SQL of other queries, which the reports gather."""
    leaf = lambda at, names, source: " UNION ALL ".join(f"SELECT concat({at}, '{c}') AS path, CAST({c} AS DOUBLE) AS value FROM ({source})" for c in names)
    counts = ("n_images", "total_gt", "total_pred", "mean_gt", "mean_pred", "mae", "exact_share", "pearson")
    return {
        "s07_report": f"""{leaf("'instances/', label, '/'", ("tp", "fp", "fn", "precision", "recall", "f1"), known["m03_instance_metrics"])} UNION ALL {leaf("'counts/'", counts, known["m05_count_metrics"])}
            UNION ALL SELECT concat('worst/', image_id, '/', gt_idx), similarity FROM ({known["m09_worst_pairs"]})""",
        "t01_timed_groups": f"""SELECT user_id AS unique_id, true AS complete, count(*) // {GROUP} AS groups, count(*) // {GROUP} * {GROUP} AS members FROM events GROUP BY 1 HAVING count(*) >= {GROUP}
            UNION ALL SELECT user_id, false, 1, count(*) % {GROUP} FROM events GROUP BY 1 HAVING count(*) % {GROUP} > 0""",
        "t03_expiring": known["t03_appended_once"],
        "t03_by_event_time": known["t03_appended_once"],
        "m16_image_report": """WITH s AS (SELECT s_suppkey AS k FROM supplier UNION ALL SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 = 0), l AS (SELECT k, k % 13 <> 0 AND k % 17 <> 0 AS named, k % 7 <> 0 AS there, k % 11 <> 0 AS good FROM s),
            r AS (SELECT concat(1 + k % 40, 'x', 1 + k % 30) AS size, 1 + k % 40 AS w, 1 + k % 30 AS h FROM l WHERE named AND there AND good)
            SELECT 'total' AS figure, count(*) FILTER (named) AS n FROM l UNION ALL SELECT 'missing', count(*) FILTER (named AND NOT there) FROM l UNION ALL SELECT 'errors', count(*) FILTER (NOT named OR (there AND NOT good)) FROM l
            UNION ALL SELECT 'sizes', count(DISTINCT size) FROM r UNION ALL (SELECT size, count(*) FROM r GROUP BY size, w, h ORDER BY 2 DESC, w, h LIMIT 20)""",
        "s02_prompt_set": f"{IMAGES} SELECT split, trim(caption) AS prompt, count(*) AS n FROM fx_images GROUP BY 1, 2",
        "s09_many_files": "SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS name FROM part UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier",
        "w09_covered": f"""{_LABELS.format(joint="max")}, c AS (SELECT *, count(*) FILTER (w > 0) OVER (PARTITION BY image_id, label) / {GRID * GRID}.0::DOUBLE AS coverage FROM w)
            SELECT image_id, count(DISTINCT y * 1000 + x) AS cells, round(sum(greatest(greatest({_ALPHA} * (1 - coverage), 0.02) * w, 0.02)), 10) AS penalty FROM c GROUP BY 1""",
        "w09_unweighted": f"""{_LABELS.format(joint="count")}, c AS (SELECT *, count(*) OVER (PARTITION BY image_id, label) / {GRID * GRID}.0::DOUBLE AS coverage FROM w)
            SELECT image_id, count(DISTINCT y * 1000 + x) AS cells, round(sum(greatest({_ALPHA} * (1 - CASE label WHEN 'misalignment' THEN coverage ELSE 0 END), 0.06)), 10) AS penalty FROM c GROUP BY 1""",
        "w09_counted": f"""{_LABELS.format(joint="100 * count")}, c AS (SELECT *, sum(w) OVER (PARTITION BY image_id, label) / {GRID * GRID}.0::DOUBLE AS coverage FROM w)
            SELECT image_id, count(DISTINCT y * 1000 + x) AS cells, round(sum(greatest({_ALPHA} * (1 - CASE label WHEN 'misalignment' THEN 0 ELSE coverage END), 0.01) * w), 10) AS penalty FROM c GROUP BY 1""",
        "a15_asymmetric": f"{scores.PREFERENCES} SELECT a.i, a.j FROM prefs a JOIN prefs b ON a.g = b.g AND a.i = b.j AND a.j = b.i WHERE a.i < a.j AND a.v <> b.v",
        "a15_antisymmetric": """WITH o AS (SELECT o_orderkey AS i, o_orderkey // 6 AS g FROM orders), m AS (SELECT a.g, a.i, b.i AS j, CASE WHEN a.i = b.i THEN CAST(a.i % 7 = 0 AS INT) WHEN a.i < b.i THEN (a.i + 2 * b.i) % 3 - 1 ELSE 1 - (b.i + 2 * a.i) % 3 + CAST((a.i + b.i) % 5 = 0 AS INT) END AS v FROM o a JOIN o b ON a.g = b.g)
            SELECT x.i, x.j FROM m x JOIN m y ON x.g = y.g AND x.i = y.j AND x.j = y.i WHERE x.i <= x.j AND x.v + y.v <> 0""",
        "a15_violations": f"""{scores.PREFERENCES}, y AS (SELECT * FROM prefs WHERE v = 1) SELECT a.j, count(*) AS paths, count(c.i) AS closed FROM y a JOIN y b ON a.g = b.g AND a.j = b.i LEFT JOIN y c ON c.g = a.g AND c.i = a.i AND c.j = b.j WHERE a.i <> b.j GROUP BY 1""",
        "j01_misplaced": f"""{IMAGES}, a AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS i FROM fx_images), b AS (SELECT image_id, row_number() OVER (ORDER BY image_id + CASE WHEN image_id % 50 = 7 THEN 1.5 ELSE 0 END) - 1 AS i FROM fx_images)
            SELECT i AS "index", a.image_id AS "left", b.image_id AS "right" FROM a JOIN b USING (i) WHERE a.image_id <> b.image_id""",
        "j01_by_place": f'{_PLACES} SELECT i AS "index", image_id, caption, split FROM n',
        "j04_by_place": f'{_PLACES} SELECT a.i AS "index", a.image_id, a.caption, b.split FROM n a JOIN n b ON a.i = b.n - 1 - b.i',
        "j12_remaining": f"""{IMAGES}, l AS (SELECT image_id, printf('%04d.png', row_number() OVER (ORDER BY image_id) - 1) AS file FROM fx_images)
            SELECT image_id, file FROM l WHERE file LIKE '%7.png' OR file NOT IN (SELECT printf('%04d.png', image_id) FROM fx_images)""",
        "r10_multisets": f"""{BOXES}, a AS (SELECT image_id, label, count(*) AS n FROM fx_gt GROUP BY 1, 2), b AS (SELECT image_id, label, count(*) AS n FROM fx_pred GROUP BY 1, 2),
            d AS (SELECT image_id, label, coalesce(a.n, 0) - coalesce(b.n, 0) AS d FROM a FULL JOIN b USING (image_id, label)) SELECT image_id, label, CASE WHEN d > 0 THEN 'left' ELSE 'right' END AS side, abs(d) AS n FROM d WHERE d <> 0""",
        "a13_balanced": f"{_PLACES} SELECT image_id, CASE WHEN i < n % 7 * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE n % 7 + (i - n % 7 * (n // 7 + 1)) // greatest(n // 7, 1) END AS shard FROM n",
        "a13_strided": f"{_PLACES} SELECT image_id, i % 7 AS shard FROM n",
        "a11_even_manifest": known["a11_repeat_manifest"].replace("LIMIT 48", "LIMIT (50 + 5) // 6 * 6"),
        "a12_even_manifest": _manifest(54, 4, "n // 9 AS rank, n % 9 * 4 + copy AS slot"),
        "a04_advantages": f"{SCALARS}, a AS (SELECT {GROUP_ADVANTAGE} AS a FROM scalars) SELECT round(max(a), 5) AS largest, round(min(a), 5) AS least, round(avg(abs(a)), 5) AS mean_abs FROM a",
        "m08_counts": f"""{matched("0.5")}, m AS (SELECT g.importance AS gi, p.importance AS pi FROM matches m JOIN fx_gt g ON g.image_id = m.image_id AND g.gt_idx = m.gt_idx JOIN fx_pred p ON p.image_id = m.image_id AND p.pred_idx = m.pred_idx)
            SELECT count(*) AS matched, (SELECT count(*) FROM fx_gt) - count(*) AS unmatched_gt, (SELECT count(*) FROM fx_pred) - count(*) AS unmatched_pred, count(*) FILTER (gi % 5 = 0) AS missing_gt, count(*) FILTER (pi % 7 = 0) AS missing_pred FROM m""",
        "m15_combined": f"""{UNION}, figures AS (SELECT class, count(*) AS n, {_UNION_FIGURES} FROM u GROUP BY 1), gathered AS (SELECT * FROM figures UNION ALL BY NAME SELECT 'combined' AS class, {", ".join(f"avg({c}) AS {c}" for c in _MEANS)}, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _SUMS)} FROM figures)
            SELECT class, {", ".join(f"round({c}, 6) AS {c}" for c in _MEANS)}, {", ".join(_SUMS)} FROM gathered""",
        "k04_eps_matches": known["k04_agnostic_matches"].replace("CASE WHEN areas - i > 0 THEN i / (areas - i) ELSE 0 END AS iou", "i / (areas - i + 1e-9) AS iou"),
        "g01_records": f"""{reports.ALL}, m AS (SELECT image_id, x0 + 300 > 1000 OR y1 - 60 < 0 OR x1 > 1000 OR y1 - 60 > 1000 OR y0 >= y1 - 60 OR x0 + 300 >= x1 AS bad FROM fx_gt), r AS (SELECT image_id, count(*) AS n, count(*) FILTER (bad) AS bad FROM m GROUP BY 1)
            SELECT CAST(sum(n) AS BIGINT) AS boxes, CAST(sum(bad) AS BIGINT) AS invalid_boxes, count(*) AS records, count(*) FILTER (bad > 0) AS invalid_records, (SELECT count(*) FROM fx_images) - count(*) FILTER (bad > 0) AS kept FROM r""",
        "g02_strict": f"""{STRICT}, j AS (SELECT image_id, gt_idx, CASE WHEN json_valid(t) THEN from_json(t, '["JSON"]') END AS l FROM told)
            SELECT image_id, gt_idx, coalesce(list_bool_and(list_transform(l, lambda b: coalesce(json_type(b) = 'OBJECT' AND lower(b ->> '$.label') IN ('artifact', 'misalignment') AND list_bool_and(list_transform(range(4), lambda k: json_type(b, '$.box_2d[' || k || ']') IN ('UBIGINT', 'BIGINT') AND CAST(b ->> ('$.box_2d[' || k || ']') AS DOUBLE) BETWEEN 0 AND 1000))
                AND CAST(b ->> '$.box_2d[0]' AS DOUBLE) < CAST(b ->> '$.box_2d[2]' AS DOUBLE) AND CAST(b ->> '$.box_2d[1]' AS DOUBLE) < CAST(b ->> '$.box_2d[3]' AS DOUBLE), false))), false) AS valid FROM j""",
        "g15_phrases": f"""SELECT image_id, string_agg(concat(label, ' in ', region), '; ' ORDER BY label <> 'misalignment', list_position({_REGION}, region)) AS phrases FROM ({known["g15_hot_regions"]}) GROUP BY 1""",
        "r04_batch_prompts": f"""{IMAGES}, f AS (SELECT image_id, caption, CASE WHEN image_id % 4 = 0 THEN '' ELSE concat('fix ', split) END AS feedback, CASE WHEN image_id % 2 = 0 THEN {_text(records.GUIDES["heatmap"])} ELSE {_text(records.GUIDES["boxes"])} END AS guide FROM fx_images)
            SELECT image_id, {_batch_sql(False)} AS plain, {_batch_sql(True)} AS with_rule FROM f""",
        "w06_greedy_telemetry": known["w05_gated"].replace("SELECT passed, count(*) AS n, count(*) FILTER (total = -1) AS failures, round(avg(total), 5) AS total FROM z GROUP BY 1", "").rstrip().replace("z AS (SELECT coalesce(ok, false) AS passed,", "z AS (SELECT w.*, c.ng, c.np,").replace("FROM w LEFT JOIN g USING (image_id))", "FROM w JOIN c USING (image_id) LEFT JOIN g USING (image_id))")
        + """ SELECT concat(CASE WHEN ng > 0 THEN 'gt' ELSE 'no_gt' END, '_', CASE WHEN np > 0 THEN 'pred' ELSE 'no_pred' END) AS "case", count(*) AS n, count(*) FILTER (total = -1) AS failures, CAST(sum(n_matched) AS BIGINT) AS matched, CAST(sum(ng - n_matched) AS BIGINT) AS unmatched_gt, CAST(sum(np - n_matched) AS BIGINT) AS unmatched_pred,
            round(avg(box), 5) AS box, round(avg(description), 5) AS description, round(avg(importance), 5) AS importance, round(avg(total), 5) AS total FROM z GROUP BY 1""",
        "u03_sql": known["u03_registered"],
        "b12_sql": f"{BOXES} SELECT image_id, CAST(pred_idx AS INTEGER) AS place, label, CAST(x0 AS DOUBLE) AS x0, CAST(y1 AS DOUBLE) AS y1 FROM fx_pred WHERE image_id % 10 <> 1",
    }
