"""Steps of the near-copy join that decide how much disk it takes."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from sievekit.llm import links, similarity


def jobs(spark, name, work):
    """How many jobs it takes; one per shuffle and one per action."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_stars_need_no_round(spark):
    edges = spark.createDataFrame([(100, 100 + i) for i in range(1, 30)] + [(8, 7), (7, 8)], "a long, b long")
    found = []
    assert jobs(spark, "stars", lambda: found.extend(links.components(edges).collect())) <= 10
    assert {(r["node"], r["root"]) for r in found} == {(100 + i, 100) for i in range(30)} | {(7, 7), (8, 7)}


def test_classes_are_joined_by_their_roots(spark):
    rng = random.Random(4)
    first, then = ([(rng.randrange(90), rng.randrange(90)) for _ in range(n)] for n in (40, 25))
    every = links.components(spark.createDataFrame(first + then, "a long, b long"))
    classes = links.components(spark.createDataFrame(first, "a long, b long"))
    got = similarity._joined(classes, spark.createDataFrame(then, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.collect()))
    none = spark.createDataFrame([], "a long, b long")
    assert sorted(map(tuple, similarity._joined(classes, none).collect())) == sorted(map(tuple, classes.collect()))
    assert similarity._joined(links.components(none), none).count() == 0


def test_sketches_travel_as_wide_as_their_sets_need(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    sets = [(n, np.unique(np.concatenate([base[: n - n // 5], rng.integers(0, 1 << 63, n // 5).astype(np.uint64)]))) for n in (60, 170, 171, 341, 342, 900)]
    rows = spark.createDataFrame([(n, similarity._sketch(s).tolist()) for n, s in sets], "n long, sketch array<long>")
    folded = {r["n"]: np.array([r["s"]], np.int64).view(np.uint64) for r in rows.select("n", similarity._folded(F.col("sketch"), F.col("n")).alias("s")).collect()}
    assert [folded[n].shape[1] for n, _ in sets] == [4, 4, 8, 8, 16, 16]
    for n, s in sets:
        for m, t in sets:
            u, v = similarity._narrowed(folded[n], folded[m].shape[1]), similarity._narrowed(folded[m], folded[n].shape[1])
            odd = [np.bincount((x >> np.uint64(32)).astype(np.int64) % (64 * u.shape[1]), minlength=64 * u.shape[1]) & 1 for x in (s, t)]
            differ = int(np.bitwise_count(u ^ v).sum())
            assert differ == int((odd[0] != odd[1]).sum()) <= len(np.setxor1d(s, t))
