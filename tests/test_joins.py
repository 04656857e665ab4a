"""Grid and interval joins against all pairs, with one key holding a third of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from eventide.operators import spatial, windows


@pytest.fixture(scope="module")
def boxes(spark):
    rng = random.Random(1)
    made = []
    for i in range(700):
        x, y = rng.uniform(-50, 600), rng.uniform(-50, 400)
        w = rng.choice([0, 1, 8, 20, 64, 500]) * rng.choice([1, rng.random()])
        made.append((rng.choice([1, 1, 2, 3, 4, 5]), i, x, y, x + w, y + w * rng.random()))
    made += [(1, 1000 + i, 10.0, 10.0, 20.0, 20.0) for i in range(30)] + [(1, 2000, 20.0, 20.0, 30.0, 30.0), (1, 2001, None, 0.0, 1.0, 1.0), (2, 2002, 5.0, 5.0, 4.0, 6.0)]
    return spark.createDataFrame(made, "frame int, box_id int, x1 double, y1 double, x2 double, y2 double").repartition(5)


def whole(r):
    return None not in tuple(r) and r["x1"] <= r["x2"] and r["y1"] <= r["y2"]


@pytest.mark.parametrize("reach", [0.0, 7.5])
def test_pairs_of_one_table(boxes, reach):
    rows = [r for r in boxes.collect() if whole(r)]
    near = lambda a, b: a["x1"] - reach <= b["x2"] + reach and b["x1"] - reach <= a["x2"] + reach and a["y1"] - reach <= b["y2"] + reach and b["y1"] - reach <= a["y2"] + reach
    want = sorted((a["frame"], *a[1:], *b[1:]) for a in rows for b in rows if a["frame"] == b["frame"] and a["box_id"] < b["box_id"] and near(a, b))
    found = sorted(tuple(r) for r in spatial.box_pairs(boxes, ["frame"], reach).collect())
    assert found == want and len(found) > 2000


def test_two_tables_and_reach_by_row(boxes):
    a = boxes.where("box_id % 3 = 0").select("frame", *[F.col(c).alias(f"a_{c}") for c in ("box_id", "x1", "y1", "x2", "y2")])
    b = boxes.where("box_id % 3 <> 0").select("frame", *[F.col(c).alias(f"b_{c}") for c in ("box_id", "x1", "y1", "x2", "y2")])
    left, right = ([r for r in t.collect() if None not in tuple(r) and r[2] <= r[4] and r[3] <= r[5]] for t in (a, b))
    touch = lambda p, q: p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5]
    want = sorted((p[1], q[1]) for p in left for q in right if p[0] == q[0] and touch(p, q))
    assert sorted(tuple(r) for r in spatial.box_join(a, b, ["frame"]).select("a_box_id", "b_box_id").collect()) == want
    wide = spatial.box_pairs(boxes, ["frame"], F.col("x2") - F.col("x1")).select("a_box_id", "b_box_id").collect()
    rows = [(r["frame"], r["box_id"], *(v + s * (r["x2"] - r["x1"]) for v, s in zip(r[2:], (-1, -1, 1, 1), strict=True))) for r in boxes.collect() if whole(r)]
    assert sorted(map(tuple, wide)) == sorted((p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and p[1] < q[1] and touch(p, q))


def test_no_boxes(boxes):
    assert spatial.box_pairs(boxes.where("false"), ["frame"]).collect() == []


def test_far_boxes_of_one_frame_cost_no_pairs(spark):
    """100,000 boxes of one frame that touch their neighbours only: all pairs would be five thousand million."""
    n = F.col("id")
    grid = spark.range(100_000).select(F.lit(1).alias("frame"), n.alias("box_id"), (n % 400 * 10).alias("x1"), (F.floor(n / 400) * 30).alias("y1")).withColumns({"x2": F.col("x1") + 10, "y2": F.col("y1") + 5})
    assert spatial.box_pairs(grid, ["frame"]).count() == 250 * 399


def test_cover_is_exact(spark):
    spans = spark.range(0, 3000).select(((F.col("id") * 37) % 200 - 90).alias("a"), F.floor(F.col("id") / 40).alias("n")).withColumn("b", F.col("a") + F.col("n"))
    parts = spans.distinct().withColumn("p", F.explode(windows.cover(F.col("a"), F.col("b"))))
    ticks = parts.withColumn("t", F.explode(F.expr("sequence(p.at * cast(power(2, p.level) as long), (p.at + 1) * cast(power(2, p.level) as long) - 1)")))
    checked = ticks.groupBy("a", "b").agg(F.count("*").alias("n"), F.countDistinct("t").alias("d"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.countDistinct("p").alias("parts"))
    assert checked.where("n <> d or lo <> a or hi <> b or d <> b - a + 1 or parts > 2 * ceil(log2(b - a + 2))").count() == 0
    assert checked.count() == spans.distinct().count()


def test_intervals_short_long_and_hot(spark):
    rng = random.Random(2)
    points = [(rng.choice("aab"), i, rng.uniform(-100, 4000)) for i in range(600)]
    spans = [(rng.choice("aab"), f"s{i}", a := rng.uniform(-100, 4000), a + rng.choice([-5, 0, 0.4, 3, 50, 3000])) for i in range(200)]
    p, s = spark.createDataFrame(points, "k string, i int, t double"), spark.createDataFrame(spans, "k string, s string, start double, end double")
    want = sorted((i, name) for k, i, t in points for kk, name, a, b in spans if k == kk and a <= t <= b)
    assert sorted(tuple(r) for r in windows.interval_join(p, s, ["k"], "t", "start", "end", 1.0).select("i", "s").collect()) == want
    assert sorted(r["i"] for r in windows.interval_join(p, s, ["k"], "t", "start", "end", 0.3, "left_semi").collect()) == sorted({i for i, _ in want})
    assert windows.interval_join(p, s.where("false"), ["k"], "t", "start", "end", 1.0).count() == 0


def test_an_interval_over_everything_costs_few_rows(spark):
    s = spark.createDataFrame([(0.0, 1e9)], "start double, end double").select(F.explode(windows.cover(F.floor("start"), F.floor("end"))))
    assert s.count() <= 60
