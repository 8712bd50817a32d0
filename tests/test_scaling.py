"""Forms for huge groups agree with the direct forms and with numpy."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from sievekit.operators import scaling as S
from sievekit.operators.instances import assign_ids, outlier_instances


def sample_rows(n=3000, seed=7):
    """One key holds most of the rows; many values repeat."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(40)}"
        value = rng.choice([rng.uniform(-50, 200), float(rng.randrange(5))])
        rows.append((key, value, i))
    return rows


def test_percentiles_of_hot_and_small_keys(spark):
    rows = sample_rows()
    df = spark.createDataFrame(rows, "k string, v double, i long").repartition(7)
    out = S.exact_percentiles(df, ["k"], {"p50": ("v", 0.5), "p95": ("v", 0.95), "q": (F.col("v") * 2, 0.25)})
    got = {r["k"]: r for r in out.collect()}
    groups = {}
    for k, v, _ in rows:
        groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert np.isclose(got[k]["p50"], np.percentile(vs, 50))
        assert np.isclose(got[k]["p95"], np.percentile(vs, 95))
        assert np.isclose(got[k]["q"], np.percentile(np.array(vs) * 2, 25))


def test_global_percentile(spark):
    rows = sample_rows()
    df = spark.createDataFrame(rows, "k string, v double, i long")
    got = S.exact_percentiles(df, [], {"m": ("v", 0.5)}).first()["m"]
    assert np.isclose(got, np.median([v for _, v, _ in rows]))


def test_row_numbers_match_a_window(spark):
    df = spark.createDataFrame(sample_rows(), "k string, v double, i long").repartition(5)
    order = [F.col("v").desc(), F.col("i")]
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("long"))
    got = S.row_numbers(df, ["k"], order, [F.floor(-F.col("v"))], "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_ids_in_crowds_with_one_confidence(spark):
    rng = random.Random(2)
    rows = [("s", 0.3 if i % 3 else rng.random(), rng.randrange(2000), rng.randrange(50), i) for i in range(900)]
    df = spark.createDataFrame(rows, "sample_id string, confidence double, y long, x long, t long").repartition(4)
    got = {r["t"]: r["id"] for r in assign_ids(df, tie="t").collect()}
    want = {r[4]: n + 1 for n, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[2], r[3], r[4])))}
    assert got == want


def test_running_sum(spark):
    df = spark.createDataFrame([(i, (-1) ** i * i) for i in range(500)], "t long, d long")
    got = {r["t"]: r["s"] for r in S.bucketed_running_sum(df, F.col("t"), F.floor(F.col("t") / 37), "d", "s").collect()}
    total = 0
    for i in range(500):
        total += (-1) ** i * i
        assert got[i] == total


def test_result_does_not_depend_on_partitions(spark):
    rows = sample_rows(800)
    outs = []
    for n in (1, 13):
        df = spark.createDataFrame(rows, "k string, v double, i long").repartition(n)
        outs.append(sorted(map(tuple, S.exact_medians(df, ["k"], {"m": "v"}).collect())))
    assert outs[0] == outs[1]


def test_null_keys_and_all_null_groups_stay(spark):
    rows = [("a", 1.0, 1), ("a", None, 2), (None, 3.0, 3), (None, None, 4), ("empty", None, 5), ("empty", None, 6)]
    df = spark.createDataFrame(rows, "k string, v double, i long")
    order, bucket = [F.col("v").desc(), F.col("i")], [F.floor(-F.col("v"))]
    medians = {tuple(r) for r in S.exact_medians(df, ["k"], {"m": "v"}).collect()}
    assert medians == {("a", 1.0), (None, 3.0), ("empty", None)}
    numbers = S.row_numbers(df, ["k"], order, bucket, "n").collect()
    assert sorted((r["k"] or "", r["n"]) for r in numbers) == [("", 1), ("", 2), ("a", 1), ("a", 2), ("empty", 1), ("empty", 2)]


def test_numbers_within_days_and_parts_of_days(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 1, 1, 2, None]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, day int, i long").repartition(6)
    order = [F.col("day"), F.col("i")]
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("long"))
    got = S.row_numbers(df, ["k"], order, [F.col("day")], "n", fine=[F.floor(F.col("i") / 50)])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))


def test_ids_put_no_confidence_last_and_not_a_number_first(spark):
    marks = [0.5, None, float("nan"), float("inf"), -1.0, 1e300, None]
    rows = [("s", m, i % 2, i, i) for i, m in enumerate(marks)]
    df = spark.createDataFrame(rows, "sample_id string, confidence double, y long, x long, t long")
    got = [r["t"] for r in assign_ids(df, tie="t").orderBy("id").collect()]
    assert got == [2, 3, 5, 0, 4, 6, 1]


def test_nothing_runs_before_an_action(spark):
    df = spark.createDataFrame(sample_rows(200), "k string, v double, i long")
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        S.exact_percentiles(df, ["k"], {"m": ("v", 0.5)})
        S.row_numbers(df, ["k"], [F.col("v")], [F.floor(F.col("v"))], "n", fine=[F.col("v")])
        ran = spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(ran) == []


def test_percentiles_read_their_input_once(spark):
    df = spark.createDataFrame(sample_rows(200), "k string, v double, i long").repartition(3)
    out = S.exact_percentiles(df, ["k"], {"m": ("v", 0.5), "q": ("i", 0.9)})
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("== Initial Plan ==")]
    assert "ReusedExchange" in final and final.count("Scan ExistingRDD") == 1


def test_outlier_instances_against_numpy(spark):
    rng = np.random.default_rng(5)
    rows, tall = [], {"a": 40, "b": 25, "few": 9}
    for key, n in tall.items():
        for i in range(n):
            length, breadth = rng.normal(100, 5), rng.normal(30, 2)
            length = 300.0 if i == 3 else length
            rows.append((key, i, float(length), float(breadth), float(length / breadth), float(rng.normal(900, 30)), float(rng.uniform(0.8, 1))))
    # One value in all rows: the regularised matrix still has a factor.
    rows += [("flat", i, 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(12)] + [("a", 99, None, None, None, None, None)]
    names = "sample_id string, i int, length_px double, breadth_px double, lb_ratio double, area double, solidity double"
    df = spark.createDataFrame(rows, names).withColumns({"broken_label": F.lit("whole"), "segmentation_quality": F.lit("good")})
    got = {(r["sample_id"], r["i"]): r["outlier_distance"] for r in outlier_instances(df).collect()}
    want = {}
    for key in ("a", "b", "flat"):
        mine = [r for r in rows if r[0] == key]
        x = np.array([[v or 0.0 for v in r[2:]] for r in mine])
        inverse = np.linalg.inv(np.cov(x.T) + np.eye(5) * 1e-6)
        for r, d in zip(mine, x - x.mean(axis=0)):
            far = float(np.sqrt(max(d @ inverse @ d, 0.0)))
            if far > 3.0:
                want[key, r[1]] = far
    assert ("a", 3) in want and set(got) == set(want)
    assert all(np.isclose(got[k], want[k], rtol=1e-6) for k in want)
