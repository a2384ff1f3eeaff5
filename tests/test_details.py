"""Streams with timers and expiry, outcomes in one pass, maps, preferences, strict boxes, reports, places: hand-made cases."""

import itertools
import json
import random
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillstone.functions import records
from quillstone.operators import advantage, boxes, hooks, rows, spatial
from quillstone.sources import files
from quillstone.streaming import groups

SAMPLES = "sample_id long, unique_id long"


def put(spark, path, data, schema=SAMPLES):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(path))


def stream_of(spark, path, schema=SAMPLES, **options):
    return spark.readStream.schema(schema).options(**options).parquet(str(path))


# streams --------------------------------------------------------------------------------------------------------


def test_leftovers_come_out_after_a_stop_and_nothing_comes_twice(spark, tmp_path):
    """The query is stopped while groups are open, and goes on from its checkpoint; leftovers are rows of the same stream."""
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    put(spark, src, [(i, i % 3) for i in range(10)])  # 4, 3 and 3 members

    def start():
        s = groups.timed_groups(stream_of(spark, src), 4, 1500)
        return s.writeStream.format("parquet").option("checkpointLocation", state).trigger(processingTime="0 seconds").start(out)

    q = start()
    end = time.monotonic() + 90
    while not any(p["numInputRows"] for p in q.recentProgress) and time.monotonic() < end:
        time.sleep(0.05)
    q.stop()  # timers of groups 1 and 2 may or may not have fired
    put(spark, src, [(100, 1), (101, 5)])
    groups.run_dry(start(), 90, emptied=True)
    got = [(r.unique_id, sorted(r.members), r.complete) for r in spark.read.parquet(out).collect()]
    members = [m for _, ms, _ in got for m in ms]
    assert sorted(members) == [*range(10), 100, 101]
    assert (0, [0, 3, 6, 9], True) in got and (5, [101], False) in got
    assert all(len(ms) == 4 if done else 0 < len(ms) < 4 for _, ms, done in got)


def test_what_is_seen_expires(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        first = groups.first_rows(stream_of(spark, src), "unique_id", 4000)
        groups.run_dry(first.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out), 90)
        return sorted(r.sample_id for r in spark.read.schema(SAMPLES).parquet(out).collect())

    put(spark, src, [(1, 7), (2, 7), (3, 8)])
    first = run()
    assert len(first) == 2 and 3 in first
    time.sleep(4.5)
    put(spark, src, [(9, 7)])
    assert run() == sorted([*first, 9])  # the key came again after its time


def test_repeats_within_event_time(spark, tmp_path):
    src = tmp_path / "in"
    schema = "k long, at timestamp_ntz"
    spark.sql("SELECT explode(array(1, 1, 2)) AS k, timestamp_ntz'2024-01-01 00:00:00' AS at").select(F.col("k").cast("long"), "at").write.parquet(str(src))
    got = groups.drained(groups.first_rows(stream_of(spark, src, schema), "k", 1000, "at"), "t")
    assert sorted(r.k for r in got.collect()) == [1, 2]


def test_rows_are_split_once_though_the_split_is_random(spark, tmp_path):
    """Each row is in one of the outcomes, as the input is evaluated once; a run that is repeated replaces its own rows only."""
    df = spark.range(20_000).repartition(7)
    path = str(tmp_path / "o")
    for run in ("a", "b", "a"):
        files.append_results(df, F.rand() < 0.5, path, run)
    got = files.read_outcomes(spark, df.schema, path)
    assert got.count() == 40_000 and got.groupBy("id").count().where("count != 2").isEmpty()
    assert {r.part for r in got.select("part").distinct().collect()} == {"ok", "failed"}
    files.append_results(df.limit(3), F.lit(None).cast("boolean"), str(tmp_path / "n"), "a")
    assert files.read_outcomes(spark, df.schema, str(tmp_path / "n")).where("part = 'failed'").count() == 3


def test_scoring_in_batches(spark, tmp_path):
    src = tmp_path / "in"
    put(spark, src, [(i, 0) for i in range(130)])
    got = groups.drained(groups.scored_batches(stream_of(spark, src), lambda f: [float(len(f))] * len(f), 50), "scored")
    assert sorted((r.score, n) for r, n in [(r, r["n"]) for r in got.groupBy("score").agg(F.count("*").alias("n")).collect()]) == [(30.0, 30), (50.0, 100)]


# maps -----------------------------------------------------------------------------------------------------------

BOXES = "image_id long, label string, x0 int, y0 int, x1 int, y1 int, importance int"


def plain_map(data, alpha, other, grid, stacking=False, weighted=True, normalised=(), least=0.0, scale=1.0):
    """Cell by cell, label by label."""
    masks, touched = {}, set()
    for label, x0, y0, x1, y1, importance in data:
        label = label or "artifact"
        at = [min(max(v * grid // 1000, 0), grid) for v in (x0, y0, x1, y1)]
        for y, x in itertools.product(range(at[1], at[3]), range(at[0], at[2])):
            mask = masks.setdefault(label, {})
            touched.add((y, x))
            w = (1.0 if importance is None else importance / 100) if weighted else 1.0
            mask[y, x] = mask.get((y, x), 0.0) + w if stacking else max(mask.get((y, x), 0.0), w)
    out = dict.fromkeys(touched, 0.0)
    for label, mask in masks.items():
        kind = "misalignment" if label == "misalignment" else "artifact"
        p = (alpha if kind == "misalignment" else other) * scale
        if kind in normalised:
            p *= 1 - sum((w > 0) if weighted else w for w in mask.values()) / grid**2
        p = max(p, least)
        for cell, w in mask.items():
            out[cell] += max(p * w, least) if weighted and w > 0 else p * w
    return out


@pytest.mark.parametrize("weighted", [True, False])
@pytest.mark.parametrize("stacking", [True, False])
def test_maps_with_coverage_and_floors(spark, weighted, stacking):
    draw = random.Random(4)
    data = {i: [(draw.choice(["misalignment", "artifact", "both", None]), *(draw.randint(-50, 900) for _ in range(2)), *(draw.randint(100, 1100) for _ in range(2)), draw.choice([None, 0, 30, 100])) for _ in range(draw.randint(1, 5))] for i in range(12)}
    df = spark.createDataFrame([(i, *b) for i, bs in data.items() for b in bs], BOXES)
    scales = spark.createDataFrame([(i, 1.0, i / 5) for i in data], "image_id long, scalar double, scale double")
    options = {"stacking": stacking, "weighted": weighted, "normalised": ("misalignment", "artifact"), "least": 0.03}
    got = {i: {} for i in data}
    for r in spatial.reward_map(df, scales, {"misalignment": 0.5}, 0.2, grid=10, **options).collect():
        got[r.image_id][r.y, r.x] = 1 - r.value
    for i, bs in data.items():
        assert got[i] == pytest.approx(plain_map(bs, 0.5, 0.2, 10, scale=i / 5, **options))


def test_maps_shuffle_boxes_once(spark):
    df = spark.createDataFrame([(1, "artifact", 0, 0, 500, 500, 40)], BOXES)
    plan = spatial.penalty_map(df, {}, 0.1, normalised=("artifact",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


# preferences ----------------------------------------------------------------------------------------------------

PREFERENCES = "i long, j long, value int"


def plain_violations(m, n):
    return {(i, j, k) for i, j, k in itertools.permutations(range(n), 3) if m.get((i, j)) == 1 and m.get((j, k)) == 1 and m.get((i, k)) != 1}


def test_preferences_against_all_triples(spark):
    draw = random.Random(2)
    for n in (2, 5, 12):
        m = {(i, j): draw.randint(0, 1) for i in range(n) for j in range(n) if draw.random() < 0.6}
        df = spark.createDataFrame([(*k, v) for k, v in m.items()], PREFERENCES)
        assert {tuple(r) for r in advantage.intransitive(df).collect()} == plain_violations(m, n)
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
        assert {tuple(r) for r in advantage.asymmetric(df).collect()} == {p for p in pairs if m.get(p, 0) != m.get(p[::-1], 0)}
        wrong = {p for p in pairs if m.get(p, 0) + m.get(p[::-1], 0)}
        assert {tuple(r) for r in advantage.unbalanced(df, diagonal=False).collect()} == wrong
        assert {tuple(r) for r in advantage.unbalanced(df).collect()} == wrong | {(i, i) for i in range(n) if m.get((i, i))}


def test_a_hub_is_not_spread_out(spark):
    """An item that 5,000 others are preferred to, and that is preferred to 5,000 more: 25 million paths, none of which is listed."""
    n = 5000
    up = spark.range(n).select(F.col("id").alias("i"), F.lit(-1).cast("long").alias("j"))
    down = spark.range(n).select(F.lit(-1).cast("long").alias("i"), (F.col("id") + n).alias("j"))
    chain = spark.createDataFrame([(-10, -11, 1), (-11, -12, 1), (-10, -12, 1), (-20, -21, 1), (-21, -22, 1)], PREFERENCES)
    df = up.unionByName(down).withColumn("value", F.lit(1)).unionByName(chain)
    got = {r.j: (r.paths, r.closed) for r in advantage.violations(df).collect()}
    assert got == {-1: (n * n, 0), -11: (1, 1), -21: (1, 0)}


def test_other_values_are_refused(spark):
    for bad in (2, None, -1):
        with pytest.raises(PySparkException, match="preferences are 0 or 1"):
            advantage.transitive_triples(spark.createDataFrame([(1, 2, 1), (2, 3, bad)], PREFERENCES)).collect()


# boxes, reports and files ---------------------------------------------------------------------------------------


def test_strict_boxes(spark):
    box = lambda corners, label='"artifact"': f'[{{"label": {label}, "box_2d": {corners}}}]'
    good = ["[]", box("[1, 2, 3, 4]", '"Misalignment"'), box("[false, 0, true, 1000]")]
    bad = [None, "", "null", "{}", "x", "[1]", "[null]", box("[1, 2, 3.0, 4]"), box('[1, 2, "3", 4]'), box("[1, 2, 2.5, 4]"), box("[1, 2, 3]"), box("[1, 2, 3, 4, 5]"), box("[1, 2, 1, 4]"), box("[1, 2, 3, 1001]"), box("[-1, 2, 3, 4]"), box("null"), box("[1, 2, null, 4]"), box("[1, 2, 3, 4]", '"both"'), box("[1, 2, 3, 4]", "null"), box("[1, 2, 3, 4]", "5"), box("[1, 2, 3, 4]")[:-1] + ", 7]"]
    df = spark.createDataFrame([(t, True) for t in good] + [(t, False) for t in bad], "t string, want boolean")
    assert [(r.t, r.got) for r in df.select("t", "want", records.strict_boxes(F.col("t")).alias("got")).where("got != want").collect()] == []


def test_labels_in_any_case(spark):
    df = spark.sql("SELECT array(named_struct('box_2d', array(1D, 2D, 3D, 4D), 'label', 'Misalignment')) AS b")
    assert df.select(records.valid_boxes(F.col("b")).alias("v")).first().v


def test_report_tree(spark, tmp_path):
    data = [(["a", "x"], 1.5), (["a", 'q"'], 2.0), (["b"], None), (["c", "d", "e"], 3.0)]
    metrics = spark.createDataFrame(data, "path array<string>, value double")
    worst = spark.createDataFrame([(1, 0.5), (2, 0.25)], "k int, s double")
    files.write_report(metrics, worst, str(tmp_path / "r"))
    (text,) = [r.value for r in spark.read.text(str(tmp_path / "r/report")).collect()]
    assert json.loads(text) == {"a": {"x": 1.5, 'q"': 2.0}, "b": None, "c": {"d": {"e": 3.0}}}
    leaves, pairs = files.read_report(spark, str(tmp_path / "r"), worst.schema)
    assert {tuple(r.path): r.value and float(r.value) for r in leaves.collect()} == {tuple(k): v for k, v in data}
    assert sorted(map(tuple, pairs.collect())) == [(1, 0.5), (2, 0.25)]
    assert files.nested_json(metrics.limit(0)).first().json == "{}"


def test_image_report(spark, tmp_path):
    png = lambda w, h: bytes.fromhex("89504E470D0A1A0A") + b"\0\0\0\rIHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big") + b"x" * 50
    made = spark.createDataFrame([("a/1.png", bytearray(png(64, 32))), ("a/2.png", bytearray(png(64, 32))), ("3.png", bytearray(png(9, 9))), ("bad.png", bytearray(b"\xff\xd8")), ("cut.png", bytearray(png(5, 5)[:18]))], "path string, content binary")
    root = str(tmp_path / "images")
    assert files.write_files(made, root).count() == 5
    lines = ['{"filename": "a/1.png"}', '{"filename": "a/2.png"}', '{"filename": "a/1.png"}', '{"filename": "3.png"}', '{"filename": "none.png"}', '{"filename": "bad.png"}', '{"filename": "cut.png"}', "oops", '{"name": 1}', "  "]
    (tmp_path / "list.jsonl").write_text("\n".join(lines))
    figures, sizes, per = files.image_report(spark, str(tmp_path / "list.jsonl"), root)
    assert figures.first().asDict() == {"total": 7, "missing": 1, "errors": 4, "sizes": 2}
    assert [tuple(r) for r in sizes.collect()] == [(64, 32, 3), (9, 9, 1)] and per.count() == 6


def test_prompt_sets(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" one\n\n two \n")
    (tmp_path / "b.txt").write_text("not read\n")
    (tmp_path / "b.jsonl").write_text('{"prompt": "three"}\n')
    read = lambda s: [r.prompt for r in files.read_prompt_set(spark, str(tmp_path), s).select("prompt").collect()]
    assert read("a") == ["one", "two"] and read("b") == ["three"]
    with pytest.raises(FileNotFoundError):
        read("c")


def test_audit_drops_records(spark):
    df = spark.createDataFrame([(1, 0, 0, 5, 5), (1, 0, 0, 5, 5000), (2, 1, 1, 2, 2), (3, None, 0, 1, 1)], "k int, x0 int, y0 int, x1 int, y1 int")
    audited, every = boxes.audit(df), spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "k int")
    assert boxes.audit_counts(audited, "k").first().asDict() == {"boxes": 4, "invalid_boxes": 2, "records": 3, "invalid_records": 2}
    assert {r.k for r in boxes.audited_records(every, audited, "k", skip_invalid=True).collect()} == {2, 4} and boxes.audited_records(every, audited, "k").count() == 4


# rows by place --------------------------------------------------------------------------------------------------


def test_exchanged_rows_are_refused(spark):
    one = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "n int, k string")
    other = spark.createDataFrame([(0, "a", 1), (1, "c", 2), (2, "b", 3)], "n int, k string, v int")
    n = [F.col("n")]
    assert rows.joined_by_place(one.select("n", "k"), one.select("n", "k", F.lit(1).alias("v")).drop("n").withColumn("m", F.col("v")), "k", n, [F.col("k")]).count() == 3
    with pytest.raises(ValueError, match="differ by place"):
        rows.joined_by_place(one, other.drop("n").withColumn("m", F.col("v")), "k", n, [F.col("m")])
    assert [tuple(r) for r in rows.misplaced(one, other.limit(2), "k", n, n).orderBy("index").collect()] == [(1, "b", "c"), (2, "c", None)]
    lenient = lambda right: [(r.k, r.v) for r in rows.joined_leniently(one, right.withColumnRenamed("n", "m"), "k", n, [F.col("m")]).orderBy("index").collect()]
    assert lenient(other) == [("a", 1), ("b", 2), ("c", 3)]  # as many rows: by place
    assert lenient(other.where("n > 0")) == [("b", 3), ("c", 2)]  # by key, in the order of the left side


def test_shards_and_steps(spark):
    for n, k in ((10, 3), (7, 7), (5, 8), (0, 3), (23, 4)):
        df = spark.range(n)
        got = {form: [r.shard for r in rows.shards(df, k, F.col("id"), form=form).orderBy("id").collect()] for form in ("contiguous", "balanced", "strided")}
        sizes = [n // k + (i < n % k) for i in range(k)]
        assert got["balanced"] == [i for i, s in enumerate(sizes) for _ in range(s)]
        assert got["strided"] == [i % k for i in range(n)]
        assert got["contiguous"] == [min(i // max(n // k, 1), k - 1) for i in range(n)]
    assert rows.even_step(50, 4, 3, 8) == 54 and rows.even_step(48, 4, 3, 8) == 48 and rows.even_step(50, 4, 6, 4, whole_groups=True) % 6 == 0


def test_multisets_and_pivots(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "v string") for xs in ("aab", "abb"))
    assert sorted(map(tuple, rows.multiset_difference(a, b).collect())) == [("a", "left"), ("b", "right")]
    listing = spark.createDataFrame([("p", "m1", "x"), ("p", "m2", "y"), ("q", "m1", "z"), (None, "m1", "n"), (None, "m2", "n"), ("p", "m3", "w")], "k string, m string, v string")
    assert [tuple(r) for r in rows.in_all(listing, "k", "m", "v", ["m1", "m2"]).collect()] == [("p", "x", "y")]


def test_sql_functions(spark):
    hooks.register_sql(spark, "twice_of", lambda f: f["a"] * 2 + f["b"])
    assert spark.sql("SELECT twice_of(struct(3 AS a, 1 AS b)) AS v").first().v == 7.0
    hooks.register_boxes_of(spark)
    reply = '[{"box_2d": [1, 2, 3, 4], "label": "a"}, 5, {"box_2d": [1, 2]}, {"box_2d": [5, 6, 7, 8.5]}]'
    spark.createDataFrame([(1, reply), (2, "no"), (3, None), (4, "{}")], "k int, t string").createOrReplaceTempView("told")
    got = spark.sql("SELECT k, b.* FROM told, LATERAL boxes_of(t) b ORDER BY k, place").collect()
    assert [tuple(r) for r in got] == [(1, 0, "a", 1.0, 2.0, 3.0, 4.0), (1, 1, None, 5.0, 6.0, 7.0, 8.5)]
