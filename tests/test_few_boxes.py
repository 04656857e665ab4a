"""Keys with few boxes are joined without the grid, next to keys with many; both give all pairs."""

import random

import pytest

from eventide.operators import spatial

SCHEMA = "k long, box_id long, x1 long, y1 long, x2 long, y2 long"


def made(spark, sizes):
    rng = random.Random(4)
    rows = []
    for k, n in sizes:
        for i in range(n):
            x, y = rng.randrange(300), rng.randrange(300)
            rows.append((k, len(rows), x, y, x + rng.choice((0, 5, 40)), y + rng.choice((0, 9, 60))))
    rows += [(1, len(rows), None, 1, 2, 3), (1, len(rows) + 1, 9, 9, 4, 12)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def touching(a, b):
    ok = lambda r: None not in r and r[2] <= r[4] and r[3] <= r[5]
    return ok(a) and ok(b) and a[0] == b[0] and max(a[2], b[2]) <= min(a[4], b[4]) and max(a[3], b[3]) <= min(a[5], b[5])


@pytest.mark.parametrize("sizes", [[(1, 6), (2, 1), (None, 5)], [(1, 6), (2, spatial.FEW), (3, spatial.FEW + 60), (4, 200), (None, 90)]])
def test_pairs(spark, sizes):
    rows, df = made(spark, sizes)
    got = sorted((r["a_box_id"], r["b_box_id"]) for r in spatial.box_pairs(df, ["k"]).collect())
    assert got == sorted((a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and touching(a, b))
    left = df.where("box_id % 3 = 0").toDF("k", "l", "a_x1", "a_y1", "a_x2", "a_y2")
    right = df.toDF("k", "r", "b_x1", "b_y1", "b_x2", "b_y2")
    for one, two in ((left, right), (right, left)):
        prefix = "ab" if one is left else "ba"
        joined = spatial.box_join(one, two, ["k"], f"{prefix[0]}_", f"{prefix[1]}_")
        assert sorted((r["l"], r["r"]) for r in joined.collect()) == sorted((a[1], b[1]) for a in rows for b in rows if a[1] % 3 == 0 and touching(a, b))


def test_few_boxes_need_no_cells(spark):
    _, df = made(spark, [(k, 5) for k in range(50)])
    for found in (spatial.box_pairs(df, ["k"]), spatial.box_join(df.toDF("k", "l", "a_x1", "a_y1", "a_x2", "a_y2"), df.toDF("k", "r", "b_x1", "b_y1", "b_x2", "b_y2"), ["k"])):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "_cx" not in plan and "Generate" not in plan
