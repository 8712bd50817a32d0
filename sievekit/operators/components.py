"""Connected components of foreground pixels, and their statistics.

Nodes are horizontal runs, not pixels. Images within the run limit are labelled in one task
each; larger ones by minimum labels with root hooking and pointer jumping, checkpointed every round.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievekit.fixed import THRESHOLDS
from sievekit.functions.rules import rnd
from sievekit.operators.scaling import by_group_size, exact_medians
from sievekit.session import checkpointed

# An image row holds fewer pixels than this, so (row, column) packs into one id.
_ROW = 1 << 27


def foreground_runs(pixels: DataFrame, by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """(by, id, y, x0, x1): maximal runs of foreground pixels in an image row."""
    row = Window.partitionBy(*by, "y").orderBy("x")
    rows = pixels.where("fg").select(*by, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    grouped = rows.withColumn("g", F.col("x") - F.row_number().over(row)).groupBy(*by, "y", "g").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1")
    )
    return grouped.select(*by, (F.col("y") * _ROW + F.col("x0")).alias("id"), "y", "x0", "x1")


def _label_runs(runs: pd.DataFrame) -> np.ndarray:
    """Smallest run id reachable from each run (8-connected), rows sorted by (y, x0)."""
    y, x0, x1, ids = (runs[k].to_numpy() for k in ("y", "x0", "x1", "id"))
    parent = np.arange(len(ids))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    start = 0
    for i in range(len(ids)):
        while start < i and (y[start] < y[i] - 1 or (y[start] == y[i] - 1 and x1[start] < x0[i] - 1)):
            start += 1
        j = start
        while j < i and y[j] == y[i] - 1 and x0[j] <= x1[i] + 1:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
            j += 1
    return ids[[root(i) for i in range(len(ids))]]


def label_components(pixels: DataFrame, by: Sequence[str] = ("sample_id",), limit: int | None = None) -> DataFrame:
    """(by, label, y, x0, x1): every run with the id of its component's first run."""
    by = list(by)
    runs = checkpointed(foreground_runs(pixels, by))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema.fields if f.name != "id")

    def in_task(part: DataFrame) -> DataFrame:
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["y", "x0"]).reset_index(drop=True)
            pdf["label"] = _label_runs(pdf)
            return pdf[[*by, "y", "x0", "x1", "label"]]

        # Runs are small in bytes but costly in Python: a named width keeps AQE from merging tasks.
        width = int(part.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return part.repartition(width, *by).groupBy(*by).applyInPandas(one, f"{schema}, label bigint")

    def in_rounds(part: DataFrame) -> DataFrame:
        return _propagate(part, by).select(*by, "y", "x0", "x1", "label")

    return by_group_size(runs, by, in_task, in_rounds, limit)


def _propagate(runs: DataFrame, by: list[str], block: int = 64) -> DataFrame:
    # Neighbouring runs share a block of columns, so the range test stays inside a block.
    spread = F.explode(F.sequence(F.floor((F.col("x0") - 1) / block), F.floor((F.col("x1") + 1) / block)))
    cells = runs.withColumn("blk", spread)
    below = cells.select(
        *[F.col(k).alias(f"b_{k}") for k in by], F.col("id").alias("b_id"), (F.col("y") - 1).alias("b_y"),
        F.col("x0").alias("b_x0"), F.col("x1").alias("b_x1"), F.col("blk").alias("b_blk"),
    )
    same = [F.col(k) == F.col(f"b_{k}") for k in (*by, "y", "blk")]
    touch = (F.col("b_x0") <= F.col("x1") + 1) & (F.col("b_x1") >= F.col("x0") - 1)
    half = cells.join(below, [*same, touch]).select(*by, F.col("id").alias("a"), F.col("b_id").alias("b")).distinct()
    edges = checkpointed(half.unionAll(half.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))))
    # f: id -> label; g: id -> label of the label. A run that hears a smaller label passes it
    # on to the run that gave it its own, so whole trees join and rounds stay few.
    state = checkpointed(runs.select(*by, "id", F.col("id").alias("f"), F.col("id").alias("g")))
    while True:
        heard = edges.join(state.select(*by, F.col("id").alias("b"), "g"), [*by, "b"]).groupBy(
            *by, F.col("a").alias("id")
        ).agg(F.min("g").alias("m"))
        known = state.join(heard, [*by, "id"], "left").withColumn("m", F.least("g", "m"))
        offers = F.array(
            F.struct(F.col("id").alias("to"), F.least("f", "m").alias("v")),
            F.struct(F.col("f").alias("to"), F.col("m").alias("v")),
        )
        f = known.select(*by, F.explode(offers).alias("o")).groupBy(*by, F.col("o.to").alias("id")).agg(
            F.min("o.v").alias("f")
        )
        f = checkpointed(f)
        root = f.select(*by, F.col("id").alias("f"), F.col("f").alias("g"))
        new = checkpointed(f.join(root, [*by, "f"]).select(*by, "id", "f", "g"))
        moved = new.join(state.select(*by, "id", F.col("g").alias("old")), [*by, "id"]).where(F.col("g") != F.col("old"))
        state = new
        if moved.isEmpty():
            return runs.join(state.select(*by, "id", F.col("g").alias("label")), [*by, "id"])


def component_stats(
    labelled: DataFrame, by: Sequence[str] = ("sample_id",),
    min_area: int = THRESHOLDS["segmentation"]["min_grain_area_pixels"],
) -> DataFrame:
    """Area and box of every component, and whether it is large enough."""
    return labelled.groupBy(*by, "label").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("area"),
        F.min("x0").alias("x"),
        F.min("y").alias("y"),
        (F.max("x1") - F.min("x0") + 1).alias("w"),
        (F.max("y") - F.min("y") + 1).alias("h"),
    ).withColumn("accepted", F.col("area") >= min_area)


def component_summary(stats: DataFrame, by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Accepted and rejected counts, and the typical area of the accepted ones."""
    stats = checkpointed(stats)  # one row per component, read three times below
    counts = stats.groupBy(*by).agg(
        F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected")
    )
    typical = exact_medians(stats, by, {"median_area": F.when(F.col("accepted"), F.col("area"))})
    return counts.join(typical, list(by), "left").withColumn(
        "median_area", rnd(F.coalesce("median_area", F.lit(2000.0)))
    )
