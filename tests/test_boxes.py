"""Greedy selection, overlap and touching against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sievekit.operators import boxes as B
from sievekit.operators import pixels as PX


def iou(a, b):
    ow = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    oh = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    inter = ow * oh
    return inter / (a[2] * a[3] + b[2] * b[3] - inter) if inter else 0.0


def make_boxes(seed, n=160):
    """A crowded sample with many exact copies, a small one, and some empty boxes."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = "hot" if i % 4 else "cold"
        box = (rng.randrange(120), rng.randrange(80), rng.randrange(10, 60), rng.randrange(10, 40))
        if i % 5 == 0:
            box = (40, 40, 30, 20)
        if i % 31 == 0:
            box = (*box[:2], 0, 5)
        rows.append((s, i, rng.randrange(8) / 8, *box))
    return rows


SCHEMA = "sample_id string, id long, confidence double, x long, y long, w long, h long"


@pytest.mark.parametrize("limit", [None, 5])
@pytest.mark.parametrize("seed", [1, 2])
def test_nms(spark, seed, limit):
    rows = make_boxes(seed)
    want = set()
    for s in ("hot", "cold"):
        kept = []
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: (-r[2], r[1])):
            if all(iou(r[3:], k[3:]) <= 0.3 for k in kept):
                kept.append(r)
        want |= {(s, k[1]) for k in kept}
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = B.greedy_nms(df, threshold=0.3, limit=limit)
    assert {(r["sample_id"], r["id"]) for r in got.collect()} == want
    if limit is None:  # selecting again changes nothing
        assert B.greedy_nms(got, threshold=0.3).count() == len(want)


@pytest.mark.parametrize("limit", [None, 5])
def test_merge_keeps_base_and_order(spark, limit):
    rows = make_boxes(3)
    base, extra = [r for r in rows if r[1] % 3 == 0], [r for r in rows if r[1] % 3]
    want = []
    for s in ("cold", "hot"):
        kept = [r for r in base if r[0] == s]
        ids = [("base", r[1]) for r in sorted(kept, key=lambda r: r[1])]
        for r in sorted((r for r in extra if r[0] == s), key=lambda r: r[1]):
            if all(iou(r[3:], k[3:]) < 0.5 for k in kept):
                kept.append(r)
                ids.append(("extra", r[1]))
        want += [(s, n + 1, *key) for n, key in enumerate(ids)]
    make = lambda part: spark.createDataFrame(part, SCHEMA).withColumnRenamed("id", "seq")
    got = B.merge_by_iou(make(base), make(extra), limit=limit)
    assert sorted(tuple(r) for r in got.select("sample_id", "foreign_id", "origin", "seq").collect()) == sorted(want)


def greedy(rows, threshold):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[2], r[1])):
        if all(iou(r[3:], k[3:]) <= threshold for k in kept):
            kept.append(r)
    return {r[1] for r in kept}


def test_nms_over_many_tiles(spark, monkeypatch):
    """Boxes across tile borders, boxes larger than a tile, tiles with more undecided boxes than they compare."""
    monkeypatch.setattr(B, "TILE_LIMIT", 12)
    monkeypatch.setattr(B, "TILE_SIDES", (32, 64, 128))
    rng = random.Random(7)
    rows = [
        ("s", i, rng.randrange(6) / 8, rng.randrange(-90, 200), rng.randrange(150), rng.randrange(4, 150), rng.randrange(4, 60))
        for i in range(260)
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["id"] for r in B.greedy_nms(df, threshold=0.2, limit=5).collect()}
    assert got == greedy(rows, 0.2)


def test_chain_ends_in_few_jobs(spark):
    """Every box hangs on the one before it; the rounds follow tiles, not the chain."""
    rows = [("s", i, 1.0 - i / 8192, 6 * i, 0, 10, 10) for i in range(5000)]
    tracker, group = spark.sparkContext.statusTracker(), "box-chain"
    spark.sparkContext.setJobGroup(group, group)
    got = {r["id"] for r in B.greedy_nms(spark.createDataFrame(rows, SCHEMA), threshold=0.2).collect()}
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    assert got == set(range(0, 5000, 2))
    assert jobs < 40, jobs


@pytest.mark.parametrize("limit", [None, 2])
def test_equal_boxes_stay_at_threshold_one(spark, limit):
    rows = [("s", i, 0.5, 3, 3, 9, 9) for i in range(4)] + [("s", 9, 0.9, 5, 5, 9, 9)]
    assert B.greedy_nms(spark.createDataFrame(rows, SCHEMA), threshold=1.0, limit=limit).count() == 5


@pytest.mark.parametrize("limit", [None, 10])
def test_mask_nms(spark, limit):
    rng = random.Random(5)
    masks = {i: {(rng.randrange(6), rng.randrange(6)) for _ in range(20)} for i in range(30)}
    masks[30] = masks[31] = masks[32] = masks[3]
    conf = {i: rng.randrange(4) / 4 for i in masks}
    kept = []
    for i in sorted(masks, key=lambda i: (-conf[i], i)):
        if all(len(masks[i] & masks[k]) / len(masks[i] | masks[k]) <= 0.5 for k in kept):
            kept.append(i)
    rows = [("s", i, conf[i], x, y) for i, m in masks.items() for x, y in m]
    df = spark.createDataFrame(rows, "sample_id string, instance_id long, confidence double, x int, y int")
    assert sorted(r["instance_id"] for r in B.greedy_mask_nms(df, limit=limit).collect()) == sorted(kept)


@pytest.mark.parametrize("kind", ["long", "double"])
def test_keep_overlapping(spark, kind):
    rng = random.Random(9)
    cast = int if kind == "long" else float
    rand = lambda: tuple(cast(rng.randrange(*r)) for r in ((-80, 300), (-80, 300), (90,), (1, 90)))
    inst = [(s, i, *rand()) for s in ("a", "none", "foreign") for i in range(40)]
    det = [("a", rng.random() < 0.4, *rand()) for _ in range(12)] + [("foreign", False, *rand())]
    idf = spark.createDataFrame(inst, f"sample_id string, grain_id long, x {kind}, y {kind}, w {kind}, h {kind}")
    ddf = spark.createDataFrame(det, f"sample_id string, is_target boolean, x {kind}, y {kind}, w {kind}, h {kind}")
    want = {("none", i) for i in range(40)}
    for s, i, *b in inst:
        if s == "a" and any(t and iou(b, d) > 0 for k, t, *d in det if k == "a"):
            want.add((s, i))
    assert {(r[0], r[1]) for r in B.keep_overlapping(idf, ddf).select("sample_id", "grain_id").collect()} == want


def test_a_crowded_cell_is_one_row(spark):
    """10^5 instances and 10^5 targets in one cell: the targets become one row before anything meets them."""
    rows = spark.range(100_000).selectExpr("'s' AS sample_id", "id AS grain_id", "id % 40 AS x", "id % 7 AS y", "id % 5 + 1 AS w", "3L AS h")
    targets = rows.selectExpr("sample_id", "true AS is_target", "x % 20 + 50 AS x", "y + 5 AS y", "4L AS w", "h")
    wide = rows.withColumn("w", F.when(F.col("grain_id") % 1000 == 7, 60).otherwise(F.col("w")))
    want = wide.where("x + w > 50 AND y + h > 5").count()
    assert 0 < want == B.keep_overlapping(wide, targets).count()


def test_touching(spark):
    rng = random.Random(4)
    px = {(i, 12 * (i % 4) + rng.randrange(9), 12 * (i // 4) + rng.randrange(12)) for i in range(16) for _ in range(12)}
    px |= {(90, 200, 200), (91, 201, 201), (92, 204, 200), (93, 200, 200)}
    want = {}
    for i, x, y in px:
        near = any(j != i and abs(x - u) <= 1 and abs(y - v) <= 1 for j, u, v in px)
        want[i] = want.get(i, False) or near
    df = spark.createDataFrame([("s", *p, True) for p in px], "sample_id string, instance_id int, x int, y int, mask boolean")
    assert {r["instance_id"]: r["is_touching"] for r in PX.flag_touching(df).collect()} == want


def test_tiles(spark):
    def plan(h, w, tile=640, step=512):
        out, y = [], 0
        while True:
            x, y2 = 0, min(y + tile, h)
            while True:
                x2 = min(x + tile, w)
                out.append((x, y, x2 - x, y2 - y))
                if x2 >= w:
                    break
                x += step
            if y2 >= h:
                return out
            y += step

    for h, w in ((100, 100), (640, 641), (2000, 1152), (1153, 5000)):
        df = spark.createDataFrame([(h, w)], "image_h int, image_w int")
        got = sorted(tuple(r) for r in B.plan_tiles(df).select("tile_x", "tile_y", "tile_w", "tile_h").collect())
        assert got == sorted(plan(h, w))


def test_one_pixel_dilation_is_enough(spark):
    rows = [("s", 1, 0, 0, True), ("s", 2, 2, 0, True)]
    df = spark.createDataFrame(rows, "sample_id string, instance_id int, x int, y int, mask boolean")
    assert PX.flag_touching(df).where(F.col("is_touching")).count() == 0


def test_keep_overlapping_of_ordinary_and_crowded_samples(spark):
    """Ordinary samples are not cut into cells; crowded ones beside them answer the same."""
    rng = random.Random(3)
    rand = lambda: (rng.randrange(-80, 900), rng.randrange(-80, 900), rng.randrange(0, 90), rng.randrange(0, 60))
    inst = [(s, i % 55, *rand()) for s in ("a", "b", None) for i in range(60)]
    det = [(s, rng.random() < 0.9, *rand()) for s, n in (("a", 15), ("b", 2 * B.FEW_TARGETS)) for _ in range(n)]
    box = "x long, y long, w long, h long"
    idf = spark.createDataFrame(inst, f"sample_id string, grain_id long, {box}")
    ddf = spark.createDataFrame(det, f"sample_id string, is_target boolean, {box}")
    hits = {(s, i) for s, i, *b in inst if any(t and k == s and min(b[2:] + d[2:]) > 0 and iou(b, d) > 0 for k, t, *d in det)}
    want = sorted((i for i in inst if i[0] is None or i[:2] in hits), key=repr)
    assert hits and sorted((tuple(r) for r in B.keep_overlapping(idf, ddf).collect()), key=repr) == want
    few = B.keep_overlapping(idf, ddf.where("sample_id = 'a'"))
    assert "cell_x" not in few._jdf.queryExecution().toString()


def test_keep_overlapping_without_a_place(spark):
    box = "x long, y long, w long, h long"
    inst = [("a", i, *b) for i, b in enumerate([(0, 0, 5, 5), (None, 0, 5, 5), (0, None, 5, 5), (0, 0, None, 5), (0, 0, 5, None)])]
    idf = spark.createDataFrame(inst, f"sample_id string, grain_id long, {box}")
    det = [("a", True, *b) for b in [(1, 1, 3, 3), (None, 1, 3, 3), (1, None, 3, 3), (1, 1, None, 3)]]
    ddf = spark.createDataFrame(det, f"sample_id string, is_target boolean, {box}")
    assert [r["grain_id"] for r in B.keep_overlapping(idf, ddf).collect()] == [0]
    assert B.keep_overlapping(idf, ddf.where("x IS NULL OR y IS NULL OR w IS NULL")).count() == 0
