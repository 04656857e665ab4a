"""Running values in stretches against ordinary windows, with one key holding a third of the rows and more."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from eventide.operators import scans


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    key = lambda: rng.choice(["a", "a", "a", "a", "b", "c", None, f"k{rng.randint(0, 40)}"])
    made = [(key(), rng.choice([None, *range(30)]), i, rng.choice([None, rng.randint(-50, 50)]), float(rng.randint(0, 9))) for i in range(2500)]
    return spark.createDataFrame(made, "k string, t int, i int, v int, w double").repartition(6)


def same(found, want, columns):
    pick = lambda df: sorted((tuple(r) for r in df.select("i", *columns).collect()))
    assert pick(found) == pick(want)


def test_all_scans(rows):
    s = scans.series(rows, ["k"], ["t", "i"], 13)
    assert s.rows.where("k = 'a'").select(scans.CHUNK).distinct().count() >= 4
    v = F.col("v")
    made = scans.scanned(
        s, last=scans.last(v), last_before=scans.last(v, before=True), lo=scans.least(v), hi=scans.largest(v), hi_before=scans.largest(v, before=True), n=scans.number(), sum=scans.total(v), sum_before=scans.total(v, before=True),
        ago1=scans.ago(v, 1), ago7=scans.ago(v, 7), hi4=scans.largest(v, rows=4), lo10=scans.least(v, rows=10), then=scans.following(v), top=scans.overall(v),
    ).frame()
    w = Window.partitionBy("k").orderBy("t", "i")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = rows.select(
        "*", F.last("v", True).over(upto).alias("last"), F.last("v", True).over(before).alias("last_before"), F.min("v").over(upto).alias("lo"), F.max("v").over(upto).alias("hi"), F.max("v").over(before).alias("hi_before"),
        F.row_number().over(w).cast("long").alias("n"), F.sum("v").over(upto).alias("sum"), F.sum("v").over(before).alias("sum_before"), F.lag("v", 1).over(w).alias("ago1"), F.lag("v", 7).over(w).alias("ago7"),
        F.max("v").over(w.rowsBetween(-3, 0)).alias("hi4"), F.min("v").over(w.rowsBetween(-9, 0)).alias("lo10"), F.lead("v").over(w).alias("then"), F.max("v").over(Window.partitionBy("k")).alias("top"),
    )
    same(made, want, ["k", "last", "last_before", "lo", "hi", "hi_before", "n", "sum", "sum_before", "ago1", "ago7", "hi4", "lo10", "then", "top"])


def test_stretches_of_one_row(rows):
    few = rows.where("i < 40").withColumn("k", F.lit("one"))
    made = scans.scanned(scans.series(few, ["k"], ["i"], 39), ago5=scans.ago(F.col("w"), 5), hi9=scans.largest(F.col("w"), rows=9), n=scans.number()).frame()
    w = Window.partitionBy("k").orderBy("i")
    same(made, few.select("*", F.lag("w", 5).over(w).alias("ago5"), F.max("w").over(w.rowsBetween(-8, 0)).alias("hi9"), F.row_number().over(w).cast("long").alias("n")), ["ago5", "hi9", "n"])


def test_latch_and_merge_against_loops(spark, rows):
    made = scans.latched(scans.series(rows, ["k"], ["t", "i"], 11), F.col("w"), 7, 3).frame()
    on, want, at = 0, [], object()
    for r in sorted(rows.collect(), key=lambda r: (r["k"] or "", r["k"] is not None, r["t"] is not None, r["t"] or 0, r["i"])):
        on = on if (r["k"], 0) == at else 0
        at = (r["k"], 0)
        on = 1 if r["w"] >= 7 else 0 if r["w"] < 3 else on
        want.append((r["i"], on))
    assert sorted(tuple(r) for r in made.select("i", "on").collect()) == sorted(want)
    with pytest.raises(ValueError):
        scans.latched(scans.series(rows, ["k"], ["t", "i"]), F.col("w"), 1, 2)

    rng = random.Random(2)
    spans = [(rng.choice("aaab"), a := rng.randint(0, 4000), a + rng.randint(0, 9)) for _ in range(900)]
    found = scans.merged_intervals(spark.createDataFrame(spans, "k string, start int, end int"), ["k"], 2)
    expect = []
    for key in "ab":
        cur = None
        for a, b in sorted(x[1:] for x in spans if x[0] == key):
            if cur and a - cur[1] <= 2:
                cur = [cur[0], max(cur[1], b), cur[2] + 1]
                expect[-1] = (key, *cur)
            else:
                cur = [a, b, 1]
                expect.append((key, *cur))
    assert sorted(tuple(r) for r in found.select("k", "start", "end", "merged").collect()) == sorted(expect)


def test_empty(rows):
    s = scans.scanned(scans.series(rows.where("false"), ["k"], ["t", "i"]), n=scans.number(), then=scans.following(F.col("v")), hi3=scans.largest(F.col("v"), rows=3))
    assert s.frame().collect() == []


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_merkle_storeys_against_a_plain_tree(spark, monkeypatch, levels):
    import hashlib

    from eventide.operators import ledger

    monkeypatch.setattr(ledger, "SUBTREE", levels)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    logs = {1: 1, 2: 2, 3: 7, 4: 64, 5: 77}
    df = spark.createDataFrame([(j, i * 3, f"h{j}-{i}") for j, n in logs.items() for i in range(n)], "job_id int, seq int, entry_hash string").repartition(4)
    roots, proofs = {}, []
    for j, n in logs.items():
        tree = [[sha(f"00h{j}-{i}") for i in range(n)]]
        while len(tree[-1]) > 1:
            a = tree[-1]
            tree.append([sha("01" + a[k] + a[k + 1]) if k + 1 < len(a) else a[k] for k in range(0, len(a), 2)])
        roots[j] = tree[-1][0]
        proofs += [(j, i, k, "left" if (i >> k) % 2 else "right", a[(i >> k) ^ 1]) for k, a in enumerate(tree) for i in range(n) if (i >> k) ^ 1 < len(a)]
    assert {r["job_id"]: r["root"] for r in ledger.merkle_roots(df).collect()} == roots
    found = ledger.merkle_proofs(df)
    assert sorted(tuple(r) for r in found.select("job_id", "i", "level", "side", "sibling").collect()) == sorted(proofs)
    assert ledger.proofs_hold(df, found, ledger.merkle_roots(df)).where("ok").count() == sum(logs.values())
    assert ledger.merkle_roots(df.where("false")).collect() == [] and ledger.merkle_proofs(df.where("false")).collect() == []
