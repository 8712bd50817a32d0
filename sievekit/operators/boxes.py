"""Boxes and masks of one sample against each other: overlap, greedy selection, tiles.

Greedy selection is order dependent: an item stays unless a better one that stays overlaps it
too much. Samples within the group limit are folded in one task. Boxes of larger ones are folded
tile by tile: what a tile alone can decide is decided there, and only boxes that hang on a
neighbouring tile wait for the next round, in which tiles are as large as the rest allows. Masks
of larger samples run in rounds over pixels, of which only the one best mask removes others. No
pairs are formed, and the result is exactly that of the fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.functions.rules import box_iou
from sievekit.operators.scaling import by_group_size, keyed_join, row_numbers
from sievekit.session import checkpointed

# Boxes of one sample that a single task may fold (the fold is quadratic).
FOLD_LIMIT = 2_000
# Boxes that one tile should hold at most, and that it compares as undecided ones.
TILE_LIMIT = 4_000
# Targets of one sample that each of its instances is held against.
FEW_TARGETS = 64
# Tile sides to choose from, in pixels.
TILE_SIDES = tuple(256 << i for i in range(0, 16, 2))
BOX = ("x", "y", "w", "h")


def with_cells(boxes: DataFrame, size: int = 64) -> DataFrame:
    """One row per grid cell a box covers; empty boxes have no cell."""

    def span(start: str, length: str) -> Column:
        return F.explode(
            F.sequence(F.floor(F.col(start) / size), F.floor((F.col(start) + F.col(length) - 1) / size))
        )

    solid = boxes.where((F.col("w") > 0) & (F.col("h") > 0))
    return solid.withColumn("cell_x", span("x", "w")).withColumn("cell_y", span("y", "h"))


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _bits(low: Column, high: Column) -> Column:
    """A long with the bits from ``low`` to ``high`` (0 to 63) set."""
    full = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (F.lit(63) - (high - low)).cast("int"))
    return F.call_function("shiftleft", full, low.cast("int"))


def _clipped(boxes: DataFrame) -> DataFrame:
    """A row per 64-pixel cell of every box: the columns it covers there as bits, and its first and last row."""
    def inside(cell: str, place: Column) -> Column:
        return F.least(F.greatest(place - F.col(cell) * 64, F.lit(0)), F.lit(63)).cast("int")

    cells = with_cells(boxes, 64)
    return cells.select(
        "*",
        _bits(inside("cell_x", F.col("x")), inside("cell_x", F.col("x") + F.col("w") - 1)).alias("bits"),
        inside("cell_y", F.col("y")).alias("top"),
        inside("cell_y", F.col("y") + F.col("h") - 1).alias("bottom"),
    ).drop(*BOX)


def keep_overlapping(
    instances: DataFrame, detections: DataFrame, by: Sequence[str] = ("sample_id",), key: str = "grain_id", size: int = 64
) -> DataFrame:
    """Instances that overlap a target detection; all of a sample without any detection.

    A sample's targets, up to ``FEW_TARGETS``, are one list that its instances are held against.
    Of samples with more, boxes of whole pixels go by cells: the targets of a 64-pixel cell,
    however many, become 64 rows of 64 bits, and an instance asks the cells it reaches into; no
    pairs are formed. Other boxes meet the targets of their ``size``-pixel cells one by one.
    """
    by = list(by)
    # Of two places, least and greatest would take the known one.
    solid = (F.col("w") > 0) & (F.col("h") > 0) & F.col("x").isNotNull() & F.col("y").isNotNull()
    targets = detections.where("is_target").where(solid).select(*by, *BOX)
    mine = instances.where(solid).select(*by, key, *BOX)
    crowded = targets.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > FEW_TARGETS).select(*by)
    if crowded.isEmpty():
        hits = _hits_of_lists(mine, targets, by, key)
    else:
        hot = checkpointed(crowded)
        hits = _hits_of_lists(mine, targets.join(hot, by, "left_anti"), by, key).unionByName(
            _hits_of_cells(mine.join(hot, by, "left_semi"), targets.join(hot, by, "left_semi"), by, key, size)
        )
    seen = detections.select(*by).distinct()
    free = instances.join(seen, by, "left_anti")
    return instances.join(hits, [*by, key], "left_semi").unionByName(free)


def _hits_of_lists(mine: DataFrame, targets: DataFrame, by: list[str], key: str) -> DataFrame:
    lists = targets.groupBy(*by).agg(F.collect_set(F.struct(*BOX)).alias("targets"))

    def meets(t: Column) -> Column:
        def over(start: str, length: str) -> Column:
            return F.least(F.col(start) + F.col(length), t[start] + t[length]) > F.greatest(F.col(start), t[start])

        return over("x", "w") & over("y", "h")

    return mine.join(lists, by).where(F.exists("targets", meets)).select(*by, key)


def _hits_of_cells(mine: DataFrame, targets: DataFrame, by: list[str], key: str, size: int) -> DataFrame:
    place = [*by, "cell_x", "cell_y"]
    if all(df.schema[k].dataType.simpleString() in _WHOLE for df in (targets, mine) for k in BOX):
        covered = _clipped(targets).distinct().withColumn("row", F.explode(F.sequence("top", "bottom")))
        covered = covered.groupBy(*place, "row").agg(F.bit_or("bits").alias("bits"))
        rows = covered.groupBy(*place).agg(F.map_from_entries(F.collect_list(F.struct("row", "bits"))).alias("rows"))

        def shared(row: Column) -> Column:
            return F.coalesce(F.col("rows")[row], F.lit(0)).bitwiseAND(F.col("bits")) != 0

        hits = _clipped(mine).join(rows, place).where(F.exists(F.sequence("top", "bottom"), shared))
    else:
        cells = with_cells(targets.distinct(), size).withColumnsRenamed({k: f"t_{k}" for k in [*BOX, *place]})
        same = [F.col(k) == F.col(f"t_{k}") for k in place]
        meets = (
            (F.least(F.col("x") + F.col("w"), F.col("t_x") + F.col("t_w")) > F.greatest("x", "t_x"))
            & (F.least(F.col("y") + F.col("h"), F.col("t_y") + F.col("t_h")) > F.greatest("y", "t_y"))
        )
        hits = with_cells(mine, size).join(cells, [*same, meets], "left_semi")
    return hits.select(*by, key).distinct()


# --- greedy selection -------------------------------------------------------


def _too_close(strict: bool, iou: Column, threshold: float) -> Column:
    return iou > threshold if strict else iou >= threshold


def _tiled(boxes: DataFrame, by: list[str], limit: int) -> DataFrame:
    """A row per tile (``side, tx, ty``) that a box reaches into, and whether it is the box's only one.

    Every group has the largest tiles that hold at most ``limit`` boxes, by their first corners.
    """
    corner = boxes.select(*by, "x", "y", F.explode(F.lit(list(TILE_SIDES))).alias("side"))
    full = corner.groupBy(*by, "side", F.floor(F.col("x") / F.col("side")), F.floor(F.col("y") / F.col("side"))).agg(
        F.count("*").alias("n")
    )
    crowd = full.groupBy(*by, "side").agg(F.max("n").alias("n"))
    sides = crowd.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("n") <= limit, F.col("side"))), F.lit(TILE_SIDES[0])).alias("side"))

    def reached(start: str, length: str) -> Column:
        last = F.greatest(F.col(start), F.ceil(F.col(start) + F.col(length)) - 1)
        return F.sequence(F.floor(F.col(start) / F.col("side")), F.floor(last / F.col("side")))

    tiles = keyed_join(boxes, sides, by).withColumns({"tx": reached("x", "w"), "ty": reached("y", "h")})
    tiles = tiles.withColumn("alone", (F.size("tx") == 1) & (F.size("ty") == 1))
    return tiles.withColumn("tx", F.explode("tx")).withColumn("ty", F.explode("ty"))


class _Tile:
    """Boxes of one tile in rank order: those that surely stay, and those that may."""

    def __init__(self, threshold: float, strict: bool, limit: int):
        self.threshold, self.strict, self.limit = threshold, strict, limit
        self.sure, self.maybe = np.zeros((0, 4)), np.zeros((0, 4))
        self.n_sure = self.n_maybe = 0

    def _near(self, kept: np.ndarray, b: np.ndarray) -> bool:
        over = np.minimum(kept[:, :2] + kept[:, 2:], b[:2] + b[2:]) - np.maximum(kept[:, :2], b[:2])
        shared = np.prod(np.maximum(over, 0), axis=1)
        meet = shared > 0
        shared = shared[meet]
        iou = shared / (kept[meet, 2] * kept[meet, 3] + b[2] * b[3] - shared)
        return bool((iou > self.threshold if self.strict else iou >= self.threshold).any())

    def judge(self, b: np.ndarray, alone: bool, stays: bool) -> int:
        """0: goes; 1: nothing in this tile is against it; 2: hangs on a box that may stay."""
        if not stays:
            if self._near(self.sure[: self.n_sure], b):
                return 0
            # With too many undecided ones the rest waits uncompared; the next round has fewer.
            if self.n_maybe >= self.limit or self._near(self.maybe[: self.n_maybe], b):
                self._add("maybe", b)
                return 2
        self._add("sure" if stays or alone else "maybe", b)
        return 1

    def _add(self, name: str, b: np.ndarray) -> None:
        n, rows = getattr(self, f"n_{name}"), getattr(self, name)
        if name == "maybe" and n >= self.limit:
            return
        if n == len(rows):
            rows = np.concatenate([rows, np.zeros((max(64, n), 4))])
            setattr(self, name, rows)
        rows[n] = b
        setattr(self, f"n_{name}", n + 1)


def _tile_rounds(boxes: DataFrame, by: list[str], threshold: float, strict: bool, limit: int) -> DataFrame:
    """(by, id) of the boxes (by, rank, BOX) that the greedy selection keeps.

    A round streams every tile in rank order through a task that holds the tile's kept boxes and
    at most ``limit`` undecided ones. A box that lies in one tile and has nothing against it is
    kept at once; one that lies in several is kept if none of them has anything against it, and
    removes others in the next round. The best box left is always decided, so rounds end.
    """
    state, kept = boxes.withColumn("stays", F.lit(False)), []
    names = [*by, "rank", *BOX, "stays", "alone"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = None
        for batch in batches:
            sides = [batch.column(batch.schema.get_field_index(f"_{k}")).to_numpy(zero_copy_only=False) for k in BOX]
            flags = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("alone", "stays", "first")]
            found = []
            for b, alone, stays, first in zip(np.column_stack(sides).astype(float), *flags):
                if first:
                    tile = _Tile(threshold, strict, limit)
                found.append(tile.judge(b, alone, stays))
            columns = [batch.column(batch.schema.get_field_index(k)) for k in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.int32())], [*names, "verdict"])

    while True:
        tiles = _tiled(state, by, limit)
        own = Window.partitionBy(*by, "tx", "ty").orderBy("rank")
        rows = tiles.select(*names, *[F.col(k).cast("double").alias(f"_{k}") for k in BOX], (F.row_number().over(own) == 1).alias("first"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema.fields)
        judged = rows.mapInArrow(judge, f"{schema}, verdict int").groupBy(*by, "rank").agg(
            *[F.first(k).alias(k) for k in (*BOX, "stays", "alone")],
            F.when(F.min("verdict") == 0, 0).otherwise(F.max("verdict")).alias("verdict"),
        )
        done = checkpointed(judged.where("verdict > 0"))
        kept.append(done.where("verdict = 1 AND NOT stays").select(*by, F.col("rank.id").alias("id")))
        if done.where("verdict = 2").isEmpty():
            break
        # Boxes of one tile have removed all they can; those of several act once more.
        state = done.where("verdict = 2 OR NOT (stays OR alone)").select(
            *by, "rank", *BOX, (F.col("verdict") == 1).alias("stays")
        )
    result = kept[0]
    for more in kept[1:]:
        result = result.unionByName(more)
    return result


def _rounds(places: DataFrame, by: list[str], place: list[str], conflicts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Keys of the items kept. ``places``: by, rank (struct ending in id), place columns, payload.

    ``conflicts`` gets rows of losing items beside the winner of that place (payload prefixed
    ``t_``) and returns the (by, id) to remove.
    """
    payload = [c for c in places.columns if c not in (*by, *place)]
    state, kept = checkpointed(places), []
    while not state.isEmpty():
        best = state.groupBy(*by, *place).agg(F.min(F.struct(*payload)).alias("top"))
        marked = state.join(best, [*by, *place])
        marked = marked.withColumn("mine", F.col("rank") == F.col("top.rank"))
        winners = checkpointed(
            marked.groupBy(*by, F.col("rank.id").alias("id")).agg(F.every("mine").alias("won")).where("won").drop("won")
        )
        kept.append(winners)
        beside = marked.where(~F.col("mine")).select(
            *by, *payload, *[F.col(f"top.{c}").alias(f"t_{c}") for c in payload]
        )
        won = winners.withColumnRenamed("id", "w_id")
        on = [beside[k] == won[k] for k in by] + [F.col("t_rank.id") == F.col("w_id")]
        removed = conflicts(beside.join(won, on, "left_semi"))
        decided = winners.unionByName(removed.select(*by, "id").distinct())
        gone = decided.withColumnsRenamed({k: f"d_{k}" for k in [*by, "id"]})
        out = [F.col(k) == F.col(f"d_{k}") for k in by] + [F.col("rank.id") == F.col("d_id")]
        state = checkpointed(state.join(gone, out, "left_anti"))
    if not kept:
        return places.select(*by, F.col("rank.id").alias("id"))
    result = kept[0]
    for more in kept[1:]:
        result = result.unionByName(more)
    return result


def greedy_boxes(
    boxes: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    key: str,
    threshold: float,
    strict: bool = True,
    pinned: str | None = None,
    limit: int | None = None,
    size: int = 64,
) -> DataFrame:
    """(by, key) of the boxes kept, best first by ``order`` (ascending), ties by ``key``.

    ``pinned`` names a boolean column: such boxes always stay.
    """
    by, limit = list(by), FOLD_LIMIT if limit is None else limit
    fields = [*[e.alias(f"o{i}") for i, e in enumerate(order)], F.col(key).alias("id")]
    pin = F.col(pinned) if pinned else F.lit(False)
    items = boxes.select(*by, F.struct((~pin).alias("free"), *fields).alias("rank"), *BOX)

    def fold(part: DataFrame) -> DataFrame:
        rows = part.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rank", *BOX))).alias("a"))

        def step(acc: Column, b: Column) -> Column:
            def near(k: Column) -> Column:
                iou = box_iou(*[k[n] for n in BOX], *[b[n] for n in BOX])
                return _too_close(strict, iou, threshold)

            drop = b["rank"]["free"] & F.exists(acc, near)
            return F.when(drop, acc).otherwise(F.concat(acc, F.array(b)))

        kept = F.aggregate("a", F.slice("a", 1, 0), step)
        return rows.select(*by, F.explode(kept).alias("k")).select(*by, F.col("k.rank.id").alias(key))

    def rounds(part: DataFrame) -> DataFrame:
        fixed = part.where(~F.col("rank.free"))
        free = part.where(F.col("rank.free"))
        empty = free.where((F.col("w") <= 0) | (F.col("h") <= 0))
        solid = free.where((F.col("w") > 0) & (F.col("h") > 0))
        if threshold < 1.0 or not strict:  # of equal boxes only the best can stay, whatever else happens
            solid = solid.groupBy(*by, *BOX).agg(F.min("rank").alias("rank")).select(*by, "rank", *BOX)
        if pinned:
            walls = with_cells(fixed.select(*by, *BOX).distinct(), size)
            walls = walls.withColumnsRenamed({k: f"t_{k}" for k in [*BOX, *by, "cell_x", "cell_y"]})
            cells = with_cells(solid, size)
            same = [F.col(k) == F.col(f"t_{k}") for k in [*by, "cell_x", "cell_y"]]
            iou = box_iou(*BOX, *[f"t_{k}" for k in BOX])
            hit = cells.join(walls, [*same, _too_close(strict, iou, threshold)], "left_semi")
            hit = hit.select(*by, "rank").distinct()
            solid = solid.join(hit, [*by, "rank"], "left_anti")

        won = _tile_rounds(solid, by, threshold, strict, TILE_LIMIT)
        always = fixed.unionByName(empty).select(*by, F.col("rank.id").alias("id"))
        return won.unionByName(always).withColumnRenamed("id", key)

    return by_group_size(items, by, fold, rounds, limit)


def greedy_nms(
    detections: DataFrame, by: Sequence[str] = ("sample_id",), key: str = "id", threshold: float = 0.5,
    limit: int | None = None,
) -> DataFrame:
    """Detections that survive: by confidence, dropping later ones with box IoU above t."""
    by = list(by)
    kept = greedy_boxes(detections, by, [-F.col("confidence")], key, threshold, limit=limit)
    return detections.join(kept, [*by, key], "left_semi")


def _fold_masks(pixels: DataFrame, by: list[str], key: str, threshold: float) -> DataFrame:
    """The masks kept of samples that fit a task, folded in rank order."""
    order = Window.partitionBy(*by).orderBy(-F.col("confidence"), key)
    ranked = pixels.select(*by, key, "x", "y", F.dense_rank().over(order).alias("_rank"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        place = pdf.groupby(["x", "y"], sort=False).ngroup().to_numpy()
        owners: list[list[int]] = [[] for _ in range(place.max() + 1)]
        areas: list[int] = []
        kept = []
        for _, rows in pdf.assign(_place=place).groupby("_rank", sort=True):
            own = rows["_place"].to_numpy()
            shared = np.bincount([k for at in own for k in owners[at]], minlength=len(areas))
            if (shared / (np.array(areas) + len(own) - shared) > threshold).any():
                continue
            for at in own:
                owners[at].append(len(areas))
            areas.append(len(own))
            kept.append(rows.index[0])
        return pdf.loc[kept, [*by, key]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pixels.select(*by, key).schema.fields)
    return ranked.groupBy(*by).applyInPandas(fold, schema)


def greedy_mask_nms(
    pixels: DataFrame, by: Sequence[str] = ("sample_id",), key: str = "instance_id", threshold: float = 0.5,
    limit: int | None = None,
) -> DataFrame:
    """(by, key) of the masks that survive, by confidence, at mask IoU above t.

    ``pixels``: by, key, confidence, x, y of mask pixels, unique. Samples of at most ``limit``
    pixels are folded in a task. Larger ones run in rounds: a pixel is a place, and overlap is
    the number of pixels shared with the one winner there.
    """
    by = list(by)

    def clash(rows: DataFrame) -> DataFrame:
        shared = rows.groupBy(*by, F.col("rank.id").alias("id"), F.col("t_rank.id").alias("w")).agg(
            F.count("*").alias("n"), F.first("area").alias("a"), F.first("t_area").alias("b")
        )
        iou = F.try_divide(F.col("n").cast("double"), F.col("a") + F.col("b") - F.col("n"))
        return shared.where(iou > threshold).select(*by, "id")

    def rounds(part: DataFrame) -> DataFrame:
        area = part.groupBy(*by, key).agg(F.count("*").alias("area"))
        places = part.join(area, [*by, key]).select(
            *by, F.struct((-F.col("confidence")).alias("o"), F.col(key).alias("id")).alias("rank"), "area", "x", "y"
        )
        return _rounds(places, by, ["x", "y"], clash).withColumnRenamed("id", key)

    return by_group_size(pixels, by, lambda part: _fold_masks(part, by, key, threshold), rounds, limit)


def merge_by_iou(
    base: DataFrame, extra: DataFrame, by: Sequence[str] = ("sample_id",), seq: str = "seq", threshold: float = 0.5,
    limit: int | None = None,
) -> DataFrame:
    """Base boxes plus the extra ones, in order, that match nothing kept so far.

    Output: by, foreign_id (base first, both in ``seq`` order), origin, seq and the box.
    """
    by = list(by)
    cols = [*by, seq, *BOX]
    # Base and extra number their rows separately; the parity keeps the ids apart.
    both = base.select(*cols, F.lit(True).alias("is_base")).unionByName(
        extra.select(*cols, F.lit(False).alias("is_base"))
    ).withColumn("_key", F.col(seq) * 2 + F.when(F.col("is_base"), 0).otherwise(1))
    kept = greedy_boxes(both, by, [F.col(seq)], "_key", threshold, strict=False, pinned="is_base", limit=limit)
    rows = both.join(kept, [*by, "_key"], "left_semi").withColumn(
        "origin", F.when(F.col("is_base"), "base").otherwise("extra")
    )
    numbered = row_numbers(
        checkpointed(rows),
        by,
        [F.col("origin"), F.col(seq)],
        [F.col("origin"), F.floor(F.col(seq) / 65536)],
        "foreign_id",
    )
    return numbered.drop("_key", "is_base")


def extra_components(probe: DataFrame, base: DataFrame, by: Sequence[str] = ("sample_id",), min_area: int = 50) -> DataFrame:
    """Components found at a lower threshold whose box the base set does not have."""
    return probe.where(F.col("area") >= min_area).join(
        base.select(*by, *BOX).distinct(), [*by, *BOX], "left_anti"
    )


# --- tiles ------------------------------------------------------------------


def plan_tiles(images: DataFrame, tile: int = 640, overlap: int = 128) -> DataFrame:
    """Overlapping tiles of each image; the last one of a row or column is clipped."""
    step = tile - overlap if tile > overlap else tile

    def starts(length: str) -> Column:
        steps = F.greatest(F.lit(0), F.ceil((F.col(length) - tile) / step)).cast("int")
        return F.transform(F.sequence(F.lit(0), steps), lambda i: i * step)

    grid = images.where((F.col("image_w") > 0) & (F.col("image_h") > 0))
    grid = grid.withColumn("tile_y", F.explode(starts("image_h"))).withColumn("tile_x", F.explode(starts("image_w")))
    return grid.withColumns(
        {
            "tile_w": F.least(F.lit(tile), F.col("image_w") - F.col("tile_x")),
            "tile_h": F.least(F.lit(tile), F.col("image_h") - F.col("tile_y")),
            "tiled": F.greatest("image_w", "image_h") > tile,
        }
    )


def tile_to_global(detections: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Shift tile-local boxes (or pixels) to image coordinates."""
    return detections.withColumns({x: F.col(x) + F.col("tile_x"), y: F.col(y) + F.col("tile_y")})
