"""Registered queries on replies, boxes, assignment, files and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import paths, records, responses
from quillstone.operators import assignment, boxes, rows
from quillstone.sources import files
from quillstone.sources.fixtures import fixture, with_clause
from quillstone.sources.tables import read_table
from quillstone.streaming import groups

QUERIES: dict = {}
GROUP = 7


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def replies(spark, sf_dir):
    """(image_id, reply): the predicted boxes of an image as text, in one of eight dialects by image_id % 8."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    corners = F.concat_ws(", ", *map(part, ("x0", "y0", "x1", "y1")))
    json = F.concat(F.lit('{"box_2d": ['), corners, F.lit('], "label": "'), part("label"), F.lit('", "importance": '), part("importance"), F.lit("}"))
    box = F.struct("pred_idx", json.alias("json"))
    per = fixture(spark, sf_dir, "fx_pred").groupBy("image_id").agg(F.sort_array(F.collect_list(box)).alias("b"))
    inner = F.concat_ws(", ", "b.json")
    plain = F.concat(F.lit("["), inner, F.lit("]"))
    answer = lambda c: F.concat(F.lit("<think>why</think>\n<answer>"), c, F.lit("</answer>"))
    forms = [
        answer(plain), answer(F.concat(F.lit("```json\n"), plain, F.lit("\n```"))), answer(F.translate(plain, '"', "'")), answer(F.concat(F.lit("["), inner, F.lit(",]"))),
        F.concat(F.lit("<answer>"), plain), plain, F.lit("no defects found"), answer(F.lit(" ")),
    ]
    reply = F.lit(None).cast("string")
    for k, form in enumerate(forms):  # only the form of an image is put together
        reply = F.when(F.col("image_id") % 8 == k, form).otherwise(reply)
    return per.select("image_id", reply.alias("reply"))


#: Policy: dialects whose boxes it reads, and those that give an empty list; the others are null.
READS = {"eval": ("0, 1, 2, 3, 5", "7"), "reward": ("0, 1", "7"), "labels": ("0, 2, 3", "1, 4, 5, 6, 7"), "repair": ("0, 2, 3, 4", "7"), "snippet": ("0, 1", "2, 3, 4, 5, 6, 7")}
NAMES = {"eval": "b01_eval_replies", "reward": "b02_reward_replies", "labels": "b03_label_replies", "repair": "b04_repaired_replies", "snippet": "b06_snippet_replies"}


def _parse_query(policy: str):
    def run(spark, sf_dir):
        parsed = replies(spark, sf_dir).select("image_id", responses.POLICIES[policy](F.col("reply")).alias("b"))
        total = F.aggregate("b", F.lit(0.0), lambda s, b: s + b["box_2d"][0] + 2 * b["box_2d"][3] + b["importance"])
        return parsed.select("image_id", F.when(F.col("b").isNotNull(), F.size("b")).cast("long").alias("n"), total.cast("long").alias("check"))

    return run


QUERIES |= {name: _parse_query(policy) for policy, name in NAMES.items()}


@query
def b12_exploded_boxes(spark, sf_dir):
    b = replies(spark, sf_dir).select("image_id", F.posexplode(responses.parse_eval(F.col("reply"))).alias("place", "b"))
    return b.select("image_id", "place", "b.label", F.col("b.box_2d")[0].cast("long").alias("x0"))


@query
def g01_box_audit(spark, sf_dir):
    moved = fixture(spark, sf_dir, "fx_gt").withColumns({"x0": F.col("x0") + 300, "y1": F.col("y1") - 60})
    return boxes.audit(moved).select("label", F.explode("errors").alias("error")).groupBy("label", "error").agg(F.count("*").alias("n"))


@query
def g09_pixels(spark, sf_dir):
    gt = fixture(spark, sf_dir, "fx_gt")
    return boxes.to_pixels(gt, F.lit(37), F.lit(53)).select("image_id", "gt_idx", "x0", "y0", "x1", "y1")


@query
def g09_old_pixels(spark, sf_dir):
    """Coordinates that were taken in 512 steps, kept in the image."""
    return boxes.to_pixels(fixture(spark, sf_dir, "fx_gt"), F.lit(37), F.lit(53), base=512, clamped=True).select("image_id", "gt_idx", "x0", "y0", "x1", "y1")


@query
def g14_jitter(spark, sf_dir):
    return boxes.jitter(fixture(spark, sf_dir, "fx_gt"), 3, 10, "j", "image_id", "gt_idx").select("epoch", "image_id", "gt_idx", "x0", "y0", "x1", "y1")


@query
def k05_optimal_matches(spark, sf_dir):
    gt, pred = (fixture(spark, sf_dir, n) for n in ("fx_gt", "fx_pred"))
    return assignment.optimal_matches(gt, pred).withColumn("diou", F.round("diou", 6))


@query
def w05_rewards(spark, sf_dir):
    gt, pred, images = (fixture(spark, sf_dir, n) for n in ("fx_gt", "fx_pred", "fx_images"))
    r = assignment.rewards(gt, pred, assignment.optimal_matches(gt, pred), images)
    return r.drop("description").withColumns({c: F.round(c, 6) for c in ("box", "importance", "total")})


@query
def w06_reward_telemetry(spark, sf_dir):
    gt, pred, images = (fixture(spark, sf_dir, n) for n in ("fx_gt", "fx_pred", "fx_images"))
    return assignment.telemetry(assignment.rewards(gt, pred, assignment.optimal_matches(gt, pred), images))


@query
def s03_jsonl_round_trip(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    path = files.work_path(spark, "jsonl")
    files.write_jsonl(d, path)
    return files.read_jsonl(spark, path, d.schema).select("doc_id", "lang", F.md5("text").alias("digest"))


@query
def s08_appended(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    path = files.work_path(spark, "append")
    ok = F.col("lang") == "en"
    files.append_results(d.where("doc_id % 2 = 0"), ok, path, "even")
    files.append_results(d.where("doc_id % 2 = 1"), ok, path, "odd")
    files.append_results(d.where("doc_id % 2 = 0"), ok, path, "even")  # done again, it replaces its rows
    return files.read_outcomes(spark, d.schema, path).select("doc_id", "part")


def _events(spark, sf_dir):
    # a pattern, as a stream does not take the path of a single file
    return spark.readStream.schema(read_table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")


@query
def t01_complete_groups(spark, sf_dir):
    samples = _events(spark, sf_dir).select(F.col("event_id").alias("sample_id"), F.col("user_id").alias("unique_id"))
    emitted = groups.drained(groups.complete_groups(samples, GROUP), "groups")
    return emitted.groupBy("unique_id").agg(F.count("*").alias("groups"), F.sum(F.size("members")).alias("members"))


@query
def t02_scored(spark, sf_dir):
    scored = groups.scored_batches(_events(spark, sf_dir).select("event_id", "value"), lambda f: f["value"] / (1 + f["value"].abs()), 64)
    return groups.drained(scored.select("event_id", F.round("score", 6).alias("score")), "scored")


@query
def t03_appended_once(spark, sf_dir):
    path = files.work_path(spark, "once")
    events = _events(spark, sf_dir).select("user_id")
    groups.append_once(events, "user_id", F.col("user_id") % 3 != 0, path)
    return files.read_outcomes(spark, events.schema, path)


TEMPLATE = 'Find defects of "{caption}" as {{"box_2d": []}}'


@query
def r01_prompts(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_images").select("image_id", records.filled(TEMPLATE, F.col("caption")).alias("prompt"))


@query
def r02_sft_reasons(spark, sf_dir):
    both = fixture(spark, sf_dir, "fx_images").select("image_id", "caption").join(replies(spark, sf_dir), "image_id", "left")
    valid = records.valid_boxes(responses.parse_eval(F.col("reply")))
    reason = F.coalesce(records.sft_reason(F.col("caption"), F.col("reply"), valid), F.lit("ok"))
    return both.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def judged(spark, sf_dir):
    """(image_id, reply, kind) of the replies, some of them degenerate by digits or by U+FFFD."""
    r = replies(spark, sf_dir).select("image_id", F.when(F.col("image_id") % 5 == 0, F.concat(F.repeat(F.lit("7"), 200), "reply")).when(F.col("image_id") % 11 == 0, F.repeat(F.lit("\ufffd"), 101)).otherwise(F.col("reply")).alias("reply"))
    kind = F.when(records.degenerate(F.col("reply")), "degenerate").when(responses.parse_eval(F.col("reply")).isNull(), "failed").otherwise("parsed")
    return r.withColumn("kind", kind)


@query
def m07_all_replies(spark, sf_dir):
    """Every reply of eight forms, those with digits too; without SQL, held to a plain version by tests."""
    return judged(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


@query
def m02_class_confusion(spark, sf_dir):
    """Image-level confusion of each class; ``both`` counts in each."""
    classes = F.explode(F.when(F.col("label") == "both", F.array(F.lit("artifact"), F.lit("misalignment"))).otherwise(F.array("label"))).alias("class")
    has = lambda n: fixture(spark, sf_dir, n).select("image_id", classes).groupBy("image_id", "class").agg(F.lit(1).alias(n))
    every = fixture(spark, sf_dir, "fx_images").select("image_id", F.explode(F.array(F.lit("artifact"), F.lit("misalignment"))).alias("class"))
    t = every.join(has("fx_gt").hint("merge"), ["image_id", "class"], "left").join(has("fx_pred").hint("merge"), ["image_id", "class"], "left").na.fill(0)
    n = lambda g, p: F.count_if((F.col("fx_gt") == g) & (F.col("fx_pred") == p))
    return t.groupBy("class").agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))


@query
def j05_common_images(spark, sf_dir):
    images = fixture(spark, sf_dir, "fx_images").select("filepath", "image_id", F.explode(F.array(*map(F.lit, (3, 4, 5)))).alias("k")).where("image_id % k != 0")
    method = F.concat(F.lit("m"), F.col("k"))
    return rows.in_all(images.select("filepath", method.alias("method"), F.concat_ws("_", method, paths.basename(F.col("filepath"))).alias("name")), "filepath", "method", "name", ["m3", "m4", "m5"])


@query
def j12_numbered_outputs(spark, sf_dir):
    """Line i with the output %04d.png; lines without an output are dropped."""
    images = fixture(spark, sf_dir, "fx_images").select("image_id", "caption")
    done = images.select(F.format_string("%04d.png", F.col("image_id")).alias("file")).where("file not like '%7.png'")
    return rows.numbered_outputs(images, done, F.col("image_id"))[0].select("image_id", "file")


GT, PRED, IMAGES = (with_clause(n) for n in ("fx_gt", "fx_pred", "fx_images"))


def _parse_sql(policy: str) -> str:
    some, none = READS[policy]
    case = lambda v: f"CASE WHEN image_id % 8 IN ({some}) THEN {v} WHEN image_id % 8 IN ({none}) THEN 0 END"
    return f"{PRED} SELECT image_id, CAST({case('count(*)')} AS BIGINT) AS n, CAST({case('sum(x0 + 2 * y1 + importance)')} AS BIGINT) AS check FROM fx_pred GROUP BY 1"


def _shift(side: str) -> str:
    draw = f"CAST(concat('0x', substr(md5(concat('j|', epoch, '|', image_id, '|', gt_idx, '|{side}')), 1, 8)) AS BIGINT) % 21 - 10"
    return f"CASE WHEN epoch = 0 THEN {side} ELSE least(greatest({side} + {draw}, 0), 1000) END AS {side}"


def _side(a: str, b: str) -> str:
    flat, low, high = f"{a} = {b} AND epoch > 0", f"least({a}, {b})", f"greatest({a}, {b})"
    return f"CASE WHEN {flat} AND {high} >= 1000 THEN {low} - 1 ELSE {low} END AS {a}, CASE WHEN {flat} AND {high} < 1000 THEN {high} + 1 ELSE {high} END AS {b}"


ORACLE_SQL = {name: _parse_sql(policy) for policy, name in NAMES.items()} | {
    "b12_exploded_boxes": f"{PRED} SELECT image_id, CAST(pred_idx AS INTEGER) AS place, label, x0 FROM fx_pred WHERE image_id % 8 IN ({READS['eval'][0]})",
    "g01_box_audit": f"""{GT}, m AS (SELECT label, x0 + 300 AS x0, y0, x1, y1 - 60 AS y1 FROM fx_gt),
        e AS (SELECT label, unnest([CASE WHEN x0 > 1000 THEN 'x0 out of range' END, CASE WHEN y1 < 0 OR y1 > 1000 THEN 'y1 out of range' END, CASE WHEN x1 > 1000 THEN 'x1 out of range' END,
          CASE WHEN y0 >= y1 THEN 'y0 >= y1' END, CASE WHEN x0 >= x1 THEN 'x0 >= x1' END]) AS error FROM m)
        SELECT label, error, count(*) AS n FROM e WHERE error IS NOT NULL GROUP BY 1, 2""",
    "g09_pixels": f"""{GT}, p AS (SELECT image_id, gt_idx, x0 * 37 // 1000 AS x0, y0 * 53 // 1000 AS y0, x1 * 37 // 1000 AS x1, y1 * 53 // 1000 AS y1 FROM fx_gt) SELECT * FROM p WHERE x0 < x1 AND y0 < y1""",
    "g09_old_pixels": f"""{GT}, p AS (SELECT image_id, gt_idx, least(x0 * 37 // 512, 37) AS x0, least(y0 * 53 // 512, 53) AS y0, least(x1 * 37 // 512, 37) AS x1, least(y1 * 53 // 512, 53) AS y1 FROM fx_gt) SELECT * FROM p WHERE x0 < x1 AND y0 < y1""",
    "g14_jitter": f"""{GT}, e AS (SELECT *, unnest([0, 1, 2]) AS epoch FROM fx_gt), m AS (SELECT epoch, image_id, gt_idx, {", ".join(map(_shift, ("x0", "y0", "x1", "y1")))} FROM e)
        SELECT epoch, image_id, gt_idx, {_side("x0", "x1")}, {_side("y0", "y1")} FROM m""",
    "r01_prompts": f"""{IMAGES} SELECT image_id, concat('Find defects of "', caption, '" as {{"box_2d": []}}') AS prompt FROM fx_images""",
    "r02_sft_reasons": f"""{with_clause("fx_images", "fx_pred")}, p AS (SELECT image_id, count(*) FILTER (x0 >= x1 OR y0 >= y1 OR x1 > 1000 OR y1 > 1000) AS bad FROM fx_pred GROUP BY 1)
        SELECT CASE WHEN bad IS NULL THEN 'missing_field' WHEN image_id % 8 IN (4, 5, 6) THEN 'missing_think_block' WHEN bad > 0 AND image_id % 8 <> 7 THEN 'invalid_bbox' ELSE 'ok' END AS reason, count(*) AS n
        FROM fx_images LEFT JOIN p USING (image_id) GROUP BY 1""",
    "m02_class_confusion": f"""{with_clause("fx_images", "fx_gt", "fx_pred")}, c AS (SELECT unnest(['artifact', 'misalignment']) AS class),
        t AS (SELECT class, EXISTS (SELECT 1 FROM fx_gt g WHERE g.image_id = i.image_id AND g.label IN (class, 'both')) AS g, EXISTS (SELECT 1 FROM fx_pred p WHERE p.image_id = i.image_id AND p.label IN (class, 'both')) AS p FROM fx_images i, c)
        SELECT class, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn FROM t GROUP BY 1""",
    "j05_common_images": f"""{IMAGES}, b AS (SELECT *, string_split(filepath, '/')[-1] AS name FROM fx_images), m AS (SELECT filepath, min(concat('m3_', name)) FILTER (image_id % 3 <> 0) AS m3, min(concat('m4_', name)) FILTER (image_id % 4 <> 0) AS m4,
          min(concat('m5_', name)) FILTER (image_id % 5 <> 0) AS m5 FROM b GROUP BY 1) SELECT * FROM m WHERE m3 IS NOT NULL AND m4 IS NOT NULL AND m5 IS NOT NULL""",
    "j12_numbered_outputs": f"""{IMAGES}, l AS (SELECT image_id, printf('%04d.png', row_number() OVER (ORDER BY image_id) - 1) AS file FROM fx_images)
        SELECT image_id, file FROM l WHERE file IN (SELECT printf('%04d.png', image_id) FROM fx_images) AND file NOT LIKE '%7.png'""",
    "s03_jsonl_round_trip": "SELECT doc_id, lang, md5(text) AS digest FROM documents",
    "s08_appended": "SELECT doc_id, CASE WHEN lang = 'en' THEN 'ok' ELSE 'failed' END AS part FROM documents",
    "t01_complete_groups": f"SELECT user_id AS unique_id, count(*) // {GROUP} AS groups, count(*) // {GROUP} * {GROUP} AS members FROM events GROUP BY 1 HAVING count(*) >= {GROUP}",
    "t02_scored": "SELECT event_id, round(value / (1 + abs(value)), 6) AS score FROM events",
    "t03_appended_once": "SELECT DISTINCT user_id, CASE WHEN user_id % 3 <> 0 THEN 'ok' ELSE 'failed' END AS part FROM events",
}
