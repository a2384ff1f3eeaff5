"""Registered queries on replies in many dialects and on the boxes in them; their SQL renders the same texts and reads them again."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions import records, responses, rewriting
from quillstone.sources.fixtures import fixture, with_clause
from quillstone.sources.tables import read_table

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


JSON_BOX = """{{"box_2d": [{c}], "label": "{l}", "description": "it's {l}", "importance": {i}}}"""
LITERAL_BOX = """{{'box_2d': [{c}], 'label': '{l}', 'description': "it's {l}", 'importance': None}}"""
CORNERS = ("%d, %d, %d, %d", "%s", "%d")
#: Texts around the list of boxes ({j} as JSON, {p} as a Python literal), without its brackets.
FORMS = [
    "<think>at [10, 20, 30, 40] and [5,6]</think>\n<answer>[{j}]</answer>", "<answer>```json\n[{j}]\n```</answer>", "<think></think><answer>```\n[{j}]\n```</answer>",
    "<answer>[{p}]</answer>", "<answer>[{p},]</answer> and <answer>[]</answer>", "<answer>[]</answer> <answer>[{j}]</answer>", "Boxes: [{j}] done.",
    "text\n```json\n[{j}]\n```\nmore", "<think>why</think><answer>Here: [{j}] thanks</answer>", "<answer>{j}</answer>", "no defects [1", "<answer>[{j}]", "[{j}]", '<answer>{{"none": 1}}</answer>',
]


def texts(spark, sf_dir):
    """(image_id, reply): the predicted boxes of an image in one of FORMS, by a hash of the id."""
    told = {"c": ("x0", "y0", "x1", "y1"), "l": ("label",), "i": ("importance",)}

    def one(shape: str, b: Column) -> Column:
        """A box in a shape, put together from its constant pieces and columns."""
        pieces = []
        for text, name, *_ in string.Formatter().parse(shape):
            pieces.append([F.lit(text)])
            pieces += [[F.coalesce(b[c].cast("string"), F.lit("null"))] if k == 0 else [F.lit(", "), F.coalesce(b[c].cast("string"), F.lit("null"))] for k, c in enumerate(told.get(name, ()))]
        return F.concat(*sum(pieces, []))

    box = F.struct("pred_idx", "x0", "y0", "x1", "y1", "label", "importance")
    per = fixture(spark, sf_dir, "fx_pred").groupBy("image_id").agg(F.sort_array(F.collect_list(box)).alias("b"))
    which = F.conv(F.substring(F.md5(F.col("image_id").cast("string")), 1, 4), 16, 10).cast("int") % len(FORMS) + 1
    form = F.element_at(F.array(*[F.lit(f.replace("{{", "{").replace("}}", "}")) for f in FORMS]), which)
    # only what the form of an image asks for is put together
    fill = lambda f, mark, shape: F.when(f.contains(mark), F.replace(f, F.lit(mark), F.array_join(F.transform("b", lambda b: one(shape, b)), ", "))).otherwise(f)
    reply = responses.let(responses.let(form, lambda f: fill(f, "{j}", JSON_BOX)), lambda f: fill(f, "{p}", LITERAL_BOX))
    return per.select("image_id", reply.alias("reply"))


def _policy(name: str):
    def run(spark, sf_dir):
        parsed = texts(spark, sf_dir).select("image_id", responses.POLICIES[name](F.col("reply")).alias("b"))
        total = F.aggregate("b", F.lit(0.0), lambda s, b: s + b["box_2d"][0] + 3 * b["box_2d"][1] + 2 * b["box_2d"][3] + F.coalesce(b["importance"], F.lit(0.0)) + F.length(b["description"]))
        return parsed.select("image_id", F.when(F.col("b").isNotNull(), F.size("b")).cast("long").alias("n"), total.cast("long").alias("check"))

    return run


NAMES = {"eval": "b01_literals", "reward": "b02_literals", "labels": "b03_literals", "repair": "b04_literals", "distill": "b05_distilled", "snippet": "b06_literals", "harvest": "b07_harvested", "yxyx": "b08_swapped"}
QUERIES |= {n: _policy(p) for p, n in NAMES.items()}


@query
def b12_texts(spark, sf_dir):
    """The boxes of the replies in all forms, with their places among those that are boxes."""
    b = texts(spark, sf_dir).select("image_id", F.posexplode(responses.parse_eval(F.col("reply"))).alias("place", "b"))
    return b.select("image_id", "place", "b.label", F.col("b.box_2d")[0].cast("long").alias("x0"))


@query
def w01_texts(spark, sf_dir):
    return texts(spark, sf_dir).select("image_id", responses.format_gate(F.col("reply")).alias("passed"))


@query
def r02_texts(spark, sf_dir):
    """Why records of the replies in all forms are left out."""
    both = fixture(spark, sf_dir, "fx_images").select("image_id", "caption").join(texts(spark, sf_dir).hint("merge"), "image_id", "left")
    valid = records.valid_boxes(responses.parse_eval(F.col("reply")))
    return both.select("image_id", F.coalesce(records.sft_reason(F.col("caption"), F.col("reply"), valid), F.lit("ok")).alias("reason"))


@query
def b09_array_items(spark, sf_dir):
    items = texts(spark, sf_dir).select("image_id", F.posexplode(responses.array_items(F.col("reply"))).alias("place", "item"))
    return items.select("image_id", "place", F.get_json_object("item", "$.label").alias("label"))


@query
def b10_think(spark, sf_dir):
    return texts(spark, sf_dir).select("image_id", F.md5(responses.think_text(F.col("reply"))).alias("digest"))


@query
def b11_completions(spark, sf_dir):
    """The text of turns wrapped in one of the shapes that completions come in."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    q = F.regexp_extract(F.to_json(F.struct("text")), r'(?s)^\{"text":(.*)\}$', 1)
    shapes = [q, F.concat(F.lit('{"text": '), q, F.lit("}")), F.concat(F.lit('[{"text": '), q, F.lit('}, "", "end"]')), F.concat(F.lit('{"choices": [{"message": {"content": '), q, F.lit("}}]}")), F.concat(F.lit('{"content": ['), q, F.lit("]}")), F.lit("17"), F.lit('{"other": 1}'), F.lit(None).cast("string")]
    payload = F.element_at(F.array(*shapes), (F.col("turn") + F.length("role") + F.col("conv_id")).cast("int") % len(shapes) + 1)
    whole = c.where("text is not null").select("conv_id", "turn", responses.completion_text(payload, 4).alias("t"))
    return whole.select("conv_id", "turn", F.md5("t").alias("digest"))


@query
def b13_box_items(spark, sf_dir):
    """Boxes as objects or bare lists, with further numbers, an alias and fractions, as box lists of whole numbers."""
    gt = fixture(spark, sf_dir, "fx_gt")
    bare = F.format_string("[%d.7, %d, %d, %d, 5]", "x0", "y0", "x1", "y1")
    named = F.format_string('{"box_2d": [%d, %d.9, %d, %d], "label": "%s", "desc": "d%d"}', "x0", "y0", "x1", "y1", "label", "importance")
    short = F.format_string('{"box_2d": [%d, %d], "label": "%s"}', "x0", "y0", "label")
    one = F.when(F.col("gt_idx") % 3 == 0, bare).when(F.col("gt_idx") % 3 == 1, named).otherwise(short)
    lists = gt.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("gt_idx", one.alias("t"))))["t"].alias("items"))
    b = lists.select("image_id", F.posexplode(responses.boxes_of_items(F.col("items"), cut=True)).alias("place", "b"))
    return b.select("image_id", "place", F.col("b.box_2d")[0].cast("long").alias("x0"), F.col("b.box_2d")[1].cast("long").alias("y0"), "b.label", "b.description")


@query
def b14_list_columns(spark, sf_dir):
    """Predicted corners stored as text, every third one as no list at all, read back and counted."""
    p = fixture(spark, sf_dir, "fx_pred").groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pred_idx", F.format_string("{'box_2d': [%d, %d, %d, %d], 'label': 'it''s'}".replace("''", ""), "x0", "y0", "x1", "y1").alias("t"))))["t"], ", ").alias("t"))
    stored = F.when(F.col("image_id") % 3 == 0, F.concat(F.lit("["), "t")).otherwise(F.concat(F.lit(" ["), "t", F.lit("] ")))
    return p.select("image_id", F.size(responses.text_lists(stored)).cast("long").alias("n"))


@query
def g03_swapped(spark, sf_dir):
    gt = fixture(spark, sf_dir, "fx_gt")
    c = responses.swapped(F.array("y0", "x0", "y1", "x1"))
    return gt.select("image_id", "gt_idx", c[0].alias("x0"), c[1].alias("y0"), c[2].alias("x1"), c[3].alias("y1"))


def _told(spark, sf_dir):
    gt = fixture(spark, sf_dir, "fx_gt")
    t = F.format_string("a $1 \\ [%d, %d, %d, %d] and [ %d,%d ,7,8] not [1.5, 2, 3, 4] nor [%d, %d, %d]", "y0", "x0", "y1", "x1", "gt_idx", "importance", "x0", "y0", "x1")
    return gt.select("image_id", "gt_idx", t.alias("t"), F.format_string('[{"box_2d": [%d, %d, %d, %d], "label": "%s"}]', "y0", "x0", "y1", "x1", "label").alias("a"))


@query
def g04_swapped_text(spark, sf_dir):
    text = F.concat(F.lit("before [1, 2, 3, 4] <think> "), "t", F.lit("</think> after [1, 2, 3, 4]"))
    return _told(spark, sf_dir).select("image_id", "gt_idx", F.md5(rewriting.swap_in_think(text)).alias("digest"))


@query
def g05_rewritten_answers(spark, sf_dir):
    text = F.concat("t", F.lit("<answer>"), F.when(F.col("gt_idx") % 4 == 3, "[]").otherwise(F.col("a")), F.lit("</answer> end"))
    read = F.col("read")
    told = _told(spark, sf_dir).select("image_id", "gt_idx", responses.parse_eval(rewriting.swap_in_answer(text)).alias("read"))
    return told.select("image_id", "gt_idx", F.size(read).cast("long").alias("n"), F.get(read, F.lit(0))["box_2d"][0].cast("long").alias("x0"), F.get(read, F.lit(0))["box_2d"][3].cast("long").alias("y1"))


@query
def g07_feedback(spark, sf_dir):
    return texts(spark, sf_dir).select("image_id", F.md5(rewriting.feedback_text(F.col("reply"))).alias("digest"))


@query
def g08_repaired(spark, sf_dir):
    """Coordinates written as shares, as decimals or as whole numbers; with the number of rows that were mended in their image."""
    gt = fixture(spark, sf_dir, "fx_gt")
    token = lambda c: F.when(F.col("gt_idx") % 3 == 0, F.format_string("%d.5", c)).when(F.col("gt_idx") % 3 == 1, F.concat(F.lit("0."), F.lpad(F.col(c).cast("string"), 4, "0"))).otherwise(F.col(c).cast("string"))
    t = gt.select("image_id", "gt_idx", F.array(token("x0"), token("y0"), F.col("x1").cast("string"), F.col("y1").cast("string")).alias("t"))
    fixed = t.select("image_id", "gt_idx", rewriting.repaired_numbers(F.col("t")).alias("c"), rewriting.needs_repair(F.col("t")).alias("mended"))
    return fixed.select("image_id", "gt_idx", F.col("c")[0].alias("x0"), F.col("c")[1].alias("y0"), F.col("c")[2].alias("x1"), "mended")


def _box(df, side):
    b = F.struct(F.array(*[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]).alias("box_2d"), "label", F.lit(None).cast("string").alias("description"), F.when(F.col("importance") > 50, F.col("importance").cast("double")).alias("importance"))
    of = lambda label: F.array_sort(F.collect_list(F.when(F.col("label") == label, b))).alias(label[:3])
    return df.groupBy("image_id").agg(of("misalignment"), of("artifact"))


@query
def r03_grpo_records(spark, sf_dir):
    """Prompt and true boxes by class of each image with boxes; a box outside the range or out of order refuses the record."""
    gt = fixture(spark, sf_dir, "fx_gt").withColumn("x1", F.when(F.col("gt_idx") % 11 == 4, F.col("x0")).otherwise(F.col("x1")))
    b = gt.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("gt_idx", F.struct(F.array(*[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]).alias("box_2d"), F.initcap("label").alias("label")).alias("b"))))["b"].alias("boxes"))
    images = fixture(spark, sf_dir, "fx_images").select("image_id", "filepath", "caption")
    r = images.join(b, "image_id", "left").select("image_id", records.grpo_record(F.col("filepath"), F.concat(F.lit("Find: "), "caption"), F.col("boxes")).alias("r"))
    return r.select("image_id", "r.reason", F.size("r.gt_misalignment").cast("long").alias("n_misalignment"), F.size("r.gt_artifact").cast("long").alias("n_artifact"), F.md5(F.element_at("r.messages", 1)["content"][1]["text"]).alias("prompt"))


@query
def r04_edit_prompts(spark, sf_dir):
    images = fixture(spark, sf_dir, "fx_images").select("image_id", "caption").join(texts(spark, sf_dir), "image_id", "left")
    style = F.when(F.col("image_id") % 3 == 0, "heatmap").when(F.col("image_id") % 3 == 1, "boxes").otherwise("plain")
    return images.select("image_id", F.md5(records.edit_prompt(F.col("caption"), F.col("reply"), style)).alias("digest"))


@query
def r08_merged_boxes(spark, sf_dir):
    merged = _box(fixture(spark, sf_dir, "fx_gt"), "gt").select("image_id", F.posexplode(rewriting.merged_boxes(F.col("mis"), F.col("art"))).alias("place", "b"))
    return merged.groupBy("image_id", "b.label").agg(F.count("*").alias("n"), F.sum(F.col("b.box_2d")[0] + 2 * F.col("b.box_2d")[1]).cast("long").alias("check"), F.sum("b.importance").cast("long").alias("importance"))


@query
def r09_box_texts(spark, sf_dir):
    b = fixture(spark, sf_dir, "fx_pred").groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("pred_idx", "label")))["label"].alias("b"))
    every = fixture(spark, sf_dir, "fx_images").select("image_id").join(b, "image_id", "left")
    return every.select("image_id", records.box_text(F.col("b")).alias("text"))


@query
def r10_distillation_audit(spark, sf_dir):
    """Replies against the boxes they should hold; every seventh image expects one box less."""
    want = fixture(spark, sf_dir, "fx_pred").where("image_id % 7 != 0 or pred_idx > 0").groupBy("image_id").agg(F.collect_list(F.struct(F.array(*[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]).alias("box_2d"), "label")).alias("want"))
    both = texts(spark, sf_dir).join(want.hint("merge"), "image_id", "left")
    expected = F.coalesce("want", F.array().cast("array<struct<box_2d:array<double>,label:string>>"))
    reason = rewriting.distillation_reason(F.col("reply"), responses.parse_distill(F.col("reply")), expected)
    return both.groupBy(F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _printf(box: str, n: int) -> str:
    args = ["x0", "y0", "x1", "y1", "label", "label", "importance"][:n]
    return f"printf({_sql(box.format(c=CORNERS[0], l=CORNERS[1], i=CORNERS[2]))}, {', '.join(args)})"


def _form(form: str) -> str:
    return f"replace(replace({_sql(form.replace('{{', '{').replace('}}', '}'))}, '{{j}}', j), '{{p}}', p)"


TEXT_CTES = f"""o AS (SELECT image_id, pred_idx, {_printf(JSON_BOX, 7)} AS j, {_printf(LITERAL_BOX, 6)} AS p FROM fx_pred),
  per AS (SELECT image_id, string_agg(j, ', ' ORDER BY pred_idx) AS j, string_agg(p, ', ' ORDER BY pred_idx) AS p, CAST(concat('0x', substr(md5(CAST(image_id AS VARCHAR)), 1, 4)) AS INTEGER) % {len(FORMS)} AS v FROM o GROUP BY 1),
  texts AS (SELECT image_id, CASE v {" ".join(f"WHEN {i} THEN {_form(f)}" for i, f in enumerate(FORMS))} END AS reply FROM per)"""
TEXTS = f"""{with_clause("fx_images", "fx_gt", "fx_pred")}, {TEXT_CTES}"""


def _extract(x: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{pattern}') THEN regexp_extract({x}, '{pattern}', 1) END"


def _tag(x: str, tag: str = "answer") -> str:
    return _extract(x, rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>")


def _fence(x: str) -> str:
    return _extract(x, r"(?s)```(?:json)?\s*(.*?)\s*```")


def _brackets(x: str) -> str:
    return _extract(x, r"(?s)(\[.*\])")


def _list(x: str, strict: bool = False) -> str:
    plain = rf"regexp_replace(regexp_replace(replace({x}, 'None', 'null'), '''(\w+)''', '\"\1\"', 'g'), ',\s*([\]}}])', '\1', 'g')".replace('\\"', '"')
    literal = "" if strict else f" WHEN json_valid({plain}) THEN {plain}"
    return f"CASE WHEN {x} LIKE '[%' AND {x} LIKE '%]' THEN CASE WHEN json_valid({x}) THEN {x}{literal} END END"


SHAPE = '\'[{"box_2d": ["DOUBLE"], "label": "VARCHAR", "description": "VARCHAR", "importance": "DOUBLE"}]\''


def _checked(source: str, x0: int = 1, y0: int = 2, y1: int = 4) -> str:
    """n and check of a list as JSON in the column l of a CTE."""
    return f"""SELECT image_id, CAST(len(b) AS BIGINT) AS n, CAST(coalesce(list_sum(list_transform(b, lambda x: x.box_2d[{x0}] + 3 * x.box_2d[{y0}] + 2 * x.box_2d[{y1}] + coalesce(x.importance, 0) + length(x.description))), CASE WHEN b IS NOT NULL THEN 0 END) AS BIGINT) AS check
        FROM (SELECT image_id, list_filter(from_json(l, {SHAPE}), lambda x: x.box_2d IS NOT NULL) AS b FROM {source})"""


def _lenient(x: str) -> str:
    """eval: empty text and JSON or a literal that is no list (objects in a row are a tuple) are empty lists, the rest is null."""
    return f"CASE WHEN {x} = '' THEN '[]' WHEN ({_list(x)}) IS NOT NULL THEN {_list(x)} WHEN json_valid({x}) OR json_valid('[' || {x} || ']') THEN '[]' END"


#: Eval: the lists l of the replies.
_EVALUATED = f"""{TEXTS}, a AS (SELECT image_id, reply, trim(reply) AS r, {_tag("reply")} AS t, {_fence("reply")} AS f FROM texts), u AS (SELECT *, coalesce({_fence("t")}, t) AS tu FROM a),
        l AS (SELECT image_id, reply, coalesce({_lenient("tu")}, {_lenient("f")}, CASE WHEN r LIKE '[%' THEN {_lenient("r")} END) AS l FROM u),
        b AS (SELECT image_id, reply, list_filter(from_json(l, {SHAPE}), lambda x: x.box_2d IS NOT NULL AND x.label IS NOT NULL) AS b FROM l)"""
_ORDERED = "x.box_2d[1] < x.box_2d[3] AND x.box_2d[2] < x.box_2d[4]"

ORACLE_SQL = {
    "b02_literals": f"""{TEXTS}, t AS (SELECT image_id, {_tag("reply")} AS t FROM texts), u AS (SELECT image_id, coalesce({_fence("t")}, t) AS u FROM t), l AS (SELECT image_id, CASE WHEN u = '' THEN '[]' ELSE {_list("u", strict=True)} END AS l FROM u) {_checked("l")}""",
    "b03_literals": f"""{TEXTS}, t AS (SELECT image_id, {_tag("reply")} AS t FROM texts), l AS (SELECT image_id, coalesce({_list("t")}, '[]') AS l FROM t) {_checked("l")}""",
    "b04_literals": f"""{TEXTS}, t AS (SELECT image_id, coalesce({_tag("reply")}, {_extract("reply", "(?s)<answer>[ ]*(.*)")}) AS t FROM texts), l AS (SELECT image_id, CASE WHEN t = '' THEN '[]' ELSE {_list("t")} END AS l FROM t) {_checked("l")}""",
    "b06_literals": f"""{TEXTS}, t AS (SELECT image_id, {_tag("reply")} AS t FROM texts), s AS (SELECT image_id, {_brackets("t")} AS s FROM t), l AS (SELECT image_id, coalesce({_list("s", strict=True)}, '[]') AS l FROM s) {_checked("l")}""",
    "b12_texts": f"{_EVALUATED} SELECT image_id, CAST(generate_subscripts(b, 1) - 1 AS INTEGER) AS place, unnest(b).label AS label, CAST(unnest(b).box_2d[1] AS BIGINT) AS x0 FROM b",
    "w01_texts": f"""{TEXTS}, t AS (SELECT image_id, reply, {_tag("reply")} AS t FROM texts), u AS (SELECT image_id, reply, coalesce({_fence("t")}, t) AS u FROM t), l AS (SELECT image_id, reply, CASE WHEN u = '' THEN '[]' ELSE {_list("u", strict=True)} END AS l FROM u)
        SELECT image_id, contains(reply, '<think>') AND l IS NOT NULL AND coalesce(list_bool_and(list_transform(from_json(l, {SHAPE}), lambda x: coalesce(len(x.box_2d) = 4 AND {_ORDERED} AND x.description IS NOT NULL, false))), true) AS passed FROM l""",
    "r02_texts": f"""{_EVALUATED} SELECT image_id, CASE WHEN coalesce(caption, '') = '' OR coalesce(reply, '') = '' THEN 'missing_field' WHEN NOT regexp_matches(reply, '(?s)<think>.*?</think>') THEN 'missing_think_block'
          WHEN b IS NULL OR NOT coalesce(list_bool_and(list_transform(b, lambda x: coalesce(len(x.box_2d) = 4 AND list_min(x.box_2d) >= 0 AND list_max(x.box_2d) <= 1000 AND {_ORDERED} AND lower(x.label) IN ('artifact', 'misalignment'), false))), true) THEN 'invalid_bbox' ELSE 'ok' END AS reason
        FROM fx_images LEFT JOIN b USING (image_id)""",
    "b01_literals": f"""{TEXTS}, a AS (SELECT image_id, trim(reply) AS r, {_tag("reply")} AS t, {_fence("reply")} AS f FROM texts), u AS (SELECT *, coalesce({_fence("t")}, t) AS tu FROM a),
        l AS (SELECT image_id, coalesce({_lenient("tu")}, {_lenient("f")}, CASE WHEN r LIKE '[%' THEN {_lenient("r")} END) AS l FROM u) {_checked("l")}""",
    "b05_distilled": f"""{TEXTS}, t AS (SELECT image_id, coalesce({_tag("reply")}, '') AS t FROM texts), a AS (SELECT image_id, trim(regexp_replace(regexp_replace(t, '^```(?:json)?', ''), '```$', ''), chr(10) || ' ') AS a FROM t),
        b AS (SELECT *, {_brackets("a")} AS s FROM a), l AS (SELECT image_id, coalesce({_list("a")}, {_list("s")}, '[]') AS l FROM b) {_checked("l")}""",
    "b07_harvested": f"""{TEXTS}, t AS (SELECT image_id, coalesce({_tag("reply")}, reply) AS t FROM texts), s AS (SELECT *, {_brackets("t")} AS s FROM t), l AS (SELECT image_id, t, {_list("s", strict=True)} AS l FROM s),
        whole AS (SELECT image_id, t, coalesce(l, '[]') AS l FROM l), found AS (SELECT image_id, CASE WHEN json_array_length(l) > 0 THEN l ELSE '[' || array_to_string(list_transform(regexp_extract_all(t, '(?s)\\{{"box_2d": \\[\\d+, \\d+, \\d+, \\d+\\], "label": "[^"]+"[^}}]*\\}}'),
          lambda o: regexp_extract(o, '(?s)(\\{{"box_2d".*"label": "[^"]+")', 1) || ', "description": ""}}'), ',') || ']' END AS l FROM whole),
        kept AS (SELECT image_id, to_json(list_filter(from_json(l, {SHAPE}), lambda x: lower(x.label) IN ('artifact', 'misalignment'))) AS l FROM found) {_checked("kept")}""",
    "b08_swapped": f"""{TEXTS}, t AS (SELECT image_id, coalesce({_tag("reply")}, {_fence("reply")}, {_brackets("reply")}) AS t FROM texts), l AS (SELECT image_id, coalesce({_list("t")}, '[]') AS l FROM t) {_checked("l", 2, 1, 3)}""",
    "b09_array_items": f"""{TEXTS}, t AS (SELECT image_id, {_tag("reply")} AS t FROM texts), s AS (SELECT image_id, {_brackets("t")} AS s FROM t), l AS (SELECT image_id, from_json({_list("s", strict=True)}, {SHAPE}) AS b FROM s)
        SELECT image_id, CAST(generate_subscripts(b, 1) - 1 AS INTEGER) AS place, unnest(b).label AS label FROM l""",
    "b10_think": f"{TEXTS} SELECT image_id, md5(coalesce({_tag('reply', 'think')}, trim(reply, chr(10) || ' '))) AS digest FROM texts",
    "b11_completions": """WITH c AS (SELECT conv_id, turn, text, (turn + length(role) + conv_id) % 8 AS v FROM conversations WHERE text IS NOT NULL)
        SELECT conv_id, turn, md5(CASE WHEN v IN (0, 1, 3, 4) THEN text WHEN v = 2 THEN CASE WHEN text = '' THEN 'end' ELSE text || chr(10) || 'end' END ELSE '' END) AS digest FROM c""",
    "b13_box_items": f"""{with_clause("fx_gt")}, k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY gt_idx) - 1 AS place FROM fx_gt WHERE gt_idx % 3 <> 2)
        SELECT image_id, CAST(place AS INTEGER) AS place, x0, y0, CASE WHEN gt_idx % 3 = 1 THEN label ELSE '' END AS label, CASE WHEN gt_idx % 3 = 1 THEN concat('d', importance) ELSE '' END AS description FROM k""",
    "b14_list_columns": f"{with_clause('fx_pred')} SELECT image_id, CASE WHEN image_id % 3 = 0 THEN 0 ELSE count(*) END AS n FROM fx_pred GROUP BY 1",
    "g03_swapped": f"{with_clause('fx_gt')} SELECT image_id, gt_idx, x0, y0, x1, y1 FROM fx_gt",
    "g04_swapped_text": f"""{with_clause("fx_gt")} SELECT image_id, gt_idx, md5(concat('before [1, 2, 3, 4] <think>', chr(10), printf('a $1 \\ [%d, %d, %d, %d] and [%d, %d, 8, 7] not [1.5, 2, 3, 4] nor [%d, %d, %d]', x0, y0, x1, y1, importance, gt_idx, x0, y0, x1), chr(10), '</think> after [1, 2, 3, 4]')) AS digest FROM fx_gt""",
    "g05_rewritten_answers": f"{with_clause('fx_gt')} SELECT image_id, gt_idx, CASE WHEN gt_idx % 4 = 3 THEN 0 ELSE 1 END AS n, CASE WHEN gt_idx % 4 <> 3 THEN x0 END AS x0, CASE WHEN gt_idx % 4 <> 3 THEN y1 END AS y1 FROM fx_gt",
    "g07_feedback": f"{TEXTS}, f AS (SELECT image_id, reply, trim(regexp_replace(reply, '</?(?:think|answer)>', '', 'g'), chr(10) || ' ') AS f FROM texts) SELECT image_id, md5(CASE WHEN f <> '' THEN f ELSE substr(reply, 1, 2000) END) AS digest FROM f",
    "g08_repaired": f"""{with_clause("fx_gt")}, t AS (SELECT *, gt_idx % 3 AS v FROM fx_gt)
        SELECT image_id, gt_idx, {", ".join(f"CAST(CASE v WHEN 0 THEN round_even(CASE WHEN {c} = 0 THEN 500 ELSE {c} + 0.5 END, 0) WHEN 1 THEN round_even({c}::DOUBLE / 10000 * 1000, 0) ELSE {c} END AS BIGINT) AS {c}" for c in ("x0", "y0"))}, x1, v <> 2 AS mended FROM t""",
    "r03_grpo_records": f"""{with_clause("fx_images", "fx_gt")}, b AS (SELECT image_id, count(*) FILTER (label = 'misalignment') AS m, count(*) FILTER (label = 'artifact') AS a, count(*) FILTER (label <> 'both' AND (gt_idx % 11 = 4 OR x1 > 1000 OR y1 > 1000 OR x0 >= x1 OR y0 >= y1)) AS bad FROM fx_gt GROUP BY 1)
        SELECT image_id, CASE WHEN bad > 0 THEN 'invalid_bbox' END AS reason, coalesce(m, 0) AS n_misalignment, coalesce(a, 0) AS n_artifact, md5(concat('Find: ', caption)) AS prompt FROM fx_images LEFT JOIN b USING (image_id)""",
    "r04_edit_prompts": f"""{TEXTS}, j AS (SELECT image_id, caption, reply, image_id % 3 AS v FROM fx_images LEFT JOIN texts USING (image_id))
        SELECT image_id, md5(CASE WHEN coalesce(reply, '') = '' THEN concat({_sql(records.FIXED_EDIT)}, caption)
          ELSE concat({_sql(records.FEEDBACK_EDIT)}, caption, chr(10), chr(10), CASE v WHEN 0 THEN {_sql(records.ACCOMPANIED["heatmap"])} WHEN 1 THEN {_sql(records.ACCOMPANIED["boxes"])} ELSE {_sql(records.ACCOMPANIED["plain"])} END, reply) END) AS digest FROM j""",
    "r08_merged_boxes": f"""{with_clause("fx_gt")} SELECT image_id, label, count(*) AS n, CAST(sum(y0 + 2 * x0) AS BIGINT) AS check, CAST(sum(CASE WHEN importance > 50 THEN importance ELSE 50 END) AS BIGINT) AS importance FROM fx_gt WHERE label <> 'both' GROUP BY 1, 2""",
    "r09_box_texts": f"""{with_clause("fx_images", "fx_pred")}, b AS (SELECT image_id, concat('["', string_agg(label, '","' ORDER BY pred_idx), '"]') AS t FROM fx_pred GROUP BY 1) SELECT image_id, coalesce(t, 'None') AS text FROM fx_images LEFT JOIN b USING (image_id)""",
    "r10_distillation_audit": f"""{TEXTS}, k AS (SELECT image_id, reply, {_tag("reply", "think")} AS think, coalesce({_tag("reply")}, '') AS t FROM texts), a AS (SELECT *, trim(regexp_replace(regexp_replace(t, '^```(?:json)?', ''), '```$', ''), chr(10) || ' ') AS a FROM k),
        s AS (SELECT *, {_brackets("a")} AS s FROM a), l AS (SELECT *, from_json(coalesce({_list("a")}, {_list("s")}, '[]'), {SHAPE}) AS l FROM s),
        w AS (SELECT image_id, list_sort(list(concat(label, x0, ',', y0, ',', x1, ',', y1))) AS w FROM fx_pred WHERE image_id % 7 <> 0 OR pred_idx > 0 GROUP BY 1),
        e AS (SELECT l.*, coalesce(w, []) AS w, list_sort(list_transform(l.l, lambda x: concat(x.label, CAST(x.box_2d[1] AS BIGINT), ',', CAST(x.box_2d[2] AS BIGINT), ',', CAST(x.box_2d[3] AS BIGINT), ',', CAST(x.box_2d[4] AS BIGINT)))) AS g FROM l LEFT JOIN w USING (image_id))
        SELECT CASE WHEN think IS NULL THEN 'missing_think_block' WHEN think = '' THEN 'empty_think_block' WHEN g <> w THEN 'bbox_mismatch' ELSE 'ok' END AS reason, count(*) AS n FROM e GROUP BY 1""",
}
