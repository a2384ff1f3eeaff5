"""Assignment against all permutations, rewards of empty sides, readers of lines and headers, streams of several files."""

import collections
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone.functions import responses
from quillstone.operators import assignment, boxes
from quillstone.plans import catalog
from quillstone.plans import replies as plans_replies
from quillstone.sources import files
from quillstone.streaming import groups

SF = "/root/testdata/sf0.001"
BOX = "image_id long, {0}_idx long, x0 int, y0 int, x1 int, y1 int, label string, importance int"


@pytest.mark.parametrize("shape", [(1, 1), (2, 4), (4, 2), (5, 5), (3, 6)])
def test_assignment_costs_least(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(30):
        cost = rng.choice([rng.uniform(-1, 1, shape), np.full(shape, 2.0)])
        found = assignment.least_cost(cost)
        wide = cost if shape[0] <= shape[1] else cost.T
        best = min(sum(wide[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        assert len(found) == min(shape) and len({i for i, _ in found}) == len({j for _, j in found}) == len(found)
        assert sum(cost[i, j] for i, j in found) == pytest.approx(best)


def test_rewards_of_hand_made_images(spark):
    gt = spark.createDataFrame([(1, 0, 0, 0, 10, 10, "both", None), (2, 0, 0, 0, 10, 10, "artifact", 5), (5, 0, 0, 0, 10, 10, "artifact", 5)], BOX.format("gt"))
    pred = spark.createDataFrame([(1, 0, 0, 0, 10, 10, "Artifact", 75), (3, 0, 0, 0, 10, 10, "artifact", 1), (5, 0, 0, 0, 10, 10, "misalignment", 5)], BOX.format("pred"))
    images = spark.createDataFrame([(i,) for i in range(1, 6)], "image_id long")
    got = {r.image_id: (r.n_matched, r.box, r.importance) for r in assignment.rewards(gt, pred, assignment.optimal_matches(gt, pred), images).collect()}
    assert got == {1: (1, 1.0, 0.5), 2: (0, -0.8, 0.0), 3: (0, -0.3, 0.0), 4: (0, 0.3, 0.0), 5: (0, -1.0, 0.0)}


def test_assignment_queries_cover_every_image(spark):
    assert catalog.QUERIES["w05_rewards"](spark, SF).count() == spark.read.parquet(f"{SF}/orders.parquet").count()
    greedy = catalog.QUERIES["k03_greedy_matches"](spark, SF).count()
    assert catalog.QUERIES["k05_optimal_matches"](spark, SF).count() >= greedy
    assert {r["case"] for r in catalog.QUERIES["w06_reward_telemetry"](spark, SF).collect()} == {"gt_pred", "gt_no_pred", "no_gt_pred", "no_gt_no_pred"}


def test_bad_and_blank_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2,\n  \n{"a": 3}\n', encoding="utf-8")
    schema, path = StructType.fromDDL("a int, b string"), str(tmp_path / "a.jsonl")
    assert [tuple(r) for r in files.read_jsonl(spark, path, schema).collect()] == [(1, "x"), (3, None)]
    assert [r[files.BAD] for r in files.read_jsonl(spark, path, schema, "quarantine").collect()] == [None, '{"a": 2,', None]
    with pytest.raises(Exception):
        files.read_jsonl(spark, path, schema, "fail").collect()


def test_prompts_and_png_headers(spark, tmp_path):
    (tmp_path / "p.txt").write_text(" one \n\ntwo\n")
    assert [r.prompt for r in files.read_prompts(spark, txt=str(tmp_path / "p.txt")).collect()] == ["one", "two"]
    head = bytes.fromhex("89504E470D0A1A0A") + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    df = spark.createDataFrame([("a", bytearray(head)), ("b", bytearray(b"no"))], "path string, content binary")
    assert [tuple(r) for r in files.image_sizes(df).collect()] == [("a", 640, 480), ("b", None, None)]


def test_audit_stops_at_nulls(spark):
    df = spark.createDataFrame([(None, 0, 1, 1), (5, 5, 5, 2000)], "x0 int, y0 int, x1 int, y1 int")
    assert [r.errors for r in boxes.audit(df).collect()] == [["not numeric"], ["y1 out of range", "x0 >= x1"]]


def test_groups_over_several_batches(spark, tmp_path):
    d = spark.range(50).select(F.col("id").alias("sample_id"), (F.col("id") % 4).alias("unique_id"))
    d.repartition(5).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    got = groups.drained(groups.complete_groups(stream, 5), "g")
    members = [m for r in got.collect() for m in r.members]
    assert got.count() == 8 and len(set(members)) == 40 and all(len({m % 4 for m in r.members}) == 1 for r in got.collect())
    assert {(r.unique_id, r.n) for r in groups.incomplete_groups(d, got).collect()} == {(0, 3), (1, 3), (2, 2), (3, 2)}


def test_quality_of_all_replies(spark):
    """Digits and U+FFFD are counted in each text; the others fail to parse as their dialect does."""
    read = plans_replies.judged(spark, SF).collect()
    share = lambda t, c: t.count(c) / len(t)
    want = collections.Counter()
    for r in read:
        bad = len(r.reply) > 100 and (max(share(r.reply, str(d)) for d in range(10)) > 0.5 or share(r.reply, "\ufffd") > 0.3)
        want["degenerate" if bad else "failed" if r.image_id % 8 in (4, 6) else "parsed"] += r.image_id % 5 != 0 or bad
        assert r.image_id % 5 or (r.kind == "degenerate") == bad
    got = {r.kind: r.n for r in catalog.QUERIES["m07_all_replies"](spark, SF).collect()}
    with_digits = [r for r in read if r.image_id % 5 == 0]
    assert sum(got.values()) == len(read) and got["degenerate"] == want["degenerate"]
    assert any(r.kind == "degenerate" for r in with_digits)
    rest = collections.Counter(r.kind for r in read if r.image_id % 5)
    assert rest["failed"] == want["failed"] and rest["parsed"] == want["parsed"]


def test_completions_in_many_shapes(spark):
    from quillstone.functions import responses

    cases = [(None, ""), ('"plain"', "plain"), ("plain words", "plain words"), ('{"text": "a"}', "a"), ('{"text": 1, "content": "b"}', "b"), ('[{"text": "a"}, "", "b", 3, null]', "a\nb"), ('{"choices": [{"message": {"content": [{"text": "deep"}]}}]}', "deep"), ("17", ""), ("{}", ""), ("[]", ""), ('{"content": null, "message": "m"}', "")]
    df = spark.createDataFrame(cases, "payload string, want string")
    got = df.select("payload", "want", responses.completion_text(F.col("payload"), 6).alias("got")).collect()
    assert [(r.payload, r.got) for r in got] == [(r.payload, r.want) for r in got]


def test_python_literals(spark):
    from quillstone.functions import responses

    reply = """<answer>[{'box_2d': [1, 2, 3, 4], 'label': 'artifact', 'description': "it's \\"odd\\"", 'importance': None}, {'box_2d': [1, 2, 3, 5], 'label': 'it\\'s', 'description': 'None, True', 'importance': 7},]</answer>"""
    df = spark.createDataFrame([(reply,)], "r string")
    b = df.select(responses.parse_eval(F.col("r")).alias("b")).first().b
    assert [(x.box_2d, x.label, x.description, x.importance) for x in b] == [([1.0, 2.0, 3.0, 4.0], "artifact", 'it\'s "odd"', None), ([1.0, 2.0, 3.0, 5.0], "it's", "None, True", 7.0)]


def test_registry_and_hooks(spark):
    from quillstone.operators import hooks

    hooks.register("Mixed", len)
    assert hooks.lookup("mIXED") is len and hooks.lookup("math.sqrt")(4) == 2
    for wrong in ("none", "no.such.module", "math.nothing"):
        with pytest.raises(KeyError):
            hooks.lookup(wrong)
    df = spark.range(10).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    with pytest.raises(Exception):
        hooks.pointwise(df, lambda f: f["v"].head(1)).collect()
    with pytest.raises(TypeError):
        hooks.aggregated(df, lambda d: d.collect())


def test_union_areas(spark):
    from quillstone.operators import regions

    shape = "gt array<struct<x0:double,y0:double,x1:double,y1:double>>, pred array<struct<x0:double,y0:double,x1:double,y1:double>>, iou double, empty boolean"
    one, zero = (0.0, 0.0, 10.0, 10.0), (0.0, 0.0, 0.0, 0.0)
    cases = [([], [], 1.0, True), ([zero], None, 1.0, True), ([one], [], 0.0, False), ([one, one], [(0.0, 0.0, 5.0, 10.0), (4.0, 0.0, 10.0, 10.0)], 1.0, False), ([one], [(5.0, 0.0, 15.0, 10.0)], 1 / 3, False)]
    for r in spark.createDataFrame(cases, shape).select("iou", "empty", regions.union_iou(F.col("gt"), F.col("pred")).alias("u")).collect():
        assert r.u.iou == pytest.approx(r.iou) and r.u.both_empty == r.empty


def test_aligned_tables_and_groups_that_do_not_divide(spark):
    from quillstone.operators import projection, rows

    a = spark.range(3).select(F.col("id").alias("k"))
    with pytest.raises(ValueError):
        projection.aligned(a, a.where("k < 2"), "k")
    with pytest.raises(ValueError):
        rows.group_manifest(a, "k", 3, 2, 2, "s")


def test_rectangles_give_the_map_scalar(spark):
    from quillstone.operators import spatial

    rng = np.random.default_rng(3)
    rows = [(int(i), str(rng.choice(["artifact", "misalignment", "both"])), int(a), int(b), int(a + w), int(b + h), None if p < 1 else int(p)) for i, a, b, w, h, p in rng.integers([0, 0, 0, 0, 0, 0], [6, 900, 900, 600, 600, 101], (40, 6))]
    df = spark.createDataFrame(rows, "image_id long, label string, x0 int, y0 int, x1 int, y1 int, importance int")
    plain = {r.image_id: r.scalar for r in spatial.map_scalar(spatial.penalty_map(df, {"misalignment": 0.5}, 0.05)).collect()}
    got = {r.image_id: r.scalar for r in spatial.map_scalar_of_boxes(df, 0.5, 0.05).collect()}
    assert got.keys() == plain.keys() and all(got[i] == pytest.approx(plain[i]) for i in got)


def test_images_of_one_shape_are_assigned_as_alone():
    """Stacks of ties and of forbidden pairs: each matrix gets what it gets alone, at the least cost of all orders."""
    r = np.random.default_rng(3)
    for n, m in ((1, 1), (2, 4), (3, 3), (4, 6)):
        stack = np.where(r.random((40, n, m)) < 0.3, 2.0, r.normal(size=(40, n, m)).round(1))
        for cost, columns in zip(stack, assignment.least_costs(stack), strict=True):
            assert [(i, int(j)) for i, j in enumerate(columns)] == assignment.least_cost(cost)
            assert sum(cost[range(n), columns]) == pytest.approx(min(sum(cost[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(m), n)))


def test_odd_line_ends_are_trimmed_as_a_pattern_does(spark):
    """Blanks, and line ends that are no blanks, around what stands in tags."""
    inner = ["", " ", "a", " a ", "a \x85", "a \x85 ", "\x85 a\u2028", " a\r\n", "a \u2029", "\u00a0a\u00a0", "a  \u2028\n"]
    d = spark.createDataFrame([(i, f"<answer>{t}</answer> <answer>b</answer>", t) for i, t in enumerate(inner)], "i int, t string, inner string")
    plain = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    found = plain(F.get(F.regexp_extract_all("t", F.lit(r"(?s)<answer>\s*(.*?)\s*</answer>"), F.lit(1)), F.lit(0)))
    r = d.select("inner", responses.tag_block(F.col("t"), "answer").alias("got"), found.alias("want"), responses.trimmed(F.col("inner")).alias("cut"), plain(F.col("inner")).alias("plain")).collect()
    assert [x.got for x in r] == [x.want for x in r] and [x.cut for x in r] == [x.plain for x in r]
