"""Stencils, components, images and contours on small drawn inputs."""

from __future__ import annotations

import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit.fixed import GLCM_OFFSETS
from sievekit.operators import components as CC
from sievekit.operators import contours as CT
from sievekit.operators import pixels as PX
from sievekit.sources import images as IM

SCHEMA = "sample_id string, instance_id int, x int, y int, r int, g int, b int, mask boolean"


def crop_rows(gray, mask, sample="s", inst=1):
    h, w = gray.shape
    return [
        (sample, inst, x, y, int(gray[y, x]), int(gray[y, x]), int(gray[y, x]), bool(mask[y, x]))
        for y in range(h)
        for x in range(w)
    ]


def reflect(a):
    return np.pad(a.astype(float), 1, mode="reflect")


def test_laplacian_on_8x8(spark):
    rng = np.random.default_rng(3)
    gray, mask = rng.integers(0, 256, (8, 8)), rng.random((8, 8)) < 0.7
    df = spark.createDataFrame(crop_rows(gray, mask), SCHEMA)
    for fill in (0, 128):
        p = reflect(np.where(mask, gray, fill))
        lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
        got = PX.laplacian_variance(df, fill=fill).first()["lap_var"]
        assert math.isclose(got, np.var(lap[mask]))


def test_roughness_uses_inner_pixels(spark):
    rng = np.random.default_rng(5)
    gray = rng.integers(0, 256, (8, 8))
    mask = np.ones((8, 8), bool)
    mask[0, 0] = False
    p = reflect(gray)
    lap = np.abs(2 * (p[:-2, :-2] + p[:-2, 2:] + p[2:, :-2] + p[2:, 2:]) - 8 * p[1:-1, 1:-1])
    inner = mask.copy()
    inner[:2, :2] = False
    df = spark.createDataFrame(crop_rows(gray, mask), SCHEMA)
    row = PX.instance_colour_features(df).first()
    want = lap[inner].mean() / (gray[mask].mean() + 1)
    assert math.isclose(row["surface_roughness"], want, abs_tol=1e-5)
    assert row["area_pixels"] == 63


def test_cooccurrence_of_a_checkerboard(spark):
    gray = (np.indices((6, 6)).sum(axis=0) % 2) * 255
    df = spark.createDataFrame(crop_rows(gray, np.ones((6, 6), bool)), SCHEMA)
    n = {(r["i"], r["j"]): r["n"] for r in PX.cooccurrence(df).collect()}
    # Even offsets (diagonals) see equal levels, odd ones see the opposite level.
    assert set(n) == {(0, 0), (63, 63), (0, 63), (63, 0)}
    assert n[0, 63] + n[63, 0] == 2 * 30 + 2 * 18
    assert n[0, 0] + n[63, 63] == 2 * 25 + 2 * 16
    f = PX.cooccurrence_features(PX.cooccurrence(df)).first()
    assert math.isclose(f["contrast"], 63 * 63 * 96 / 178, abs_tol=1e-4)


def test_otsu_and_polarity(spark):
    gray = np.full((20, 20), 30)
    gray[8:12, 5:15] = 200
    rows = crop_rows(gray, np.ones((20, 20), bool)) + crop_rows(255 - gray, np.ones((20, 20), bool), "light")
    rows += crop_rows(np.full((20, 20), 243), np.ones((20, 20), bool), "blank")
    df = spark.createDataFrame(rows, SCHEMA)
    images = spark.createDataFrame([(k, 20, 20) for k in ("s", "light", "blank")], "sample_id string, image_w int, image_h int")
    marked, facts = PX.foreground_mask(df, images)
    got = {r["sample_id"]: r for r in facts.collect()}
    assert got["s"]["is_dark_bg"] and not got["light"]["is_dark_bg"] and got["blank"]["is_blank"]
    fg = {r[0]: r[1] for r in marked.groupBy("sample_id").agg(F.count_if("fg")).collect()}
    # A white-on-dark bar is cut out exactly; on the light sample the threshold level itself is background.
    assert fg["s"] == 40 and fg["blank"] == 0
    assert got["s"]["background_gray"] == 30 and got["blank"]["background_gray"] == 243


def flood(cells):
    left, out = set(cells), []
    while left:
        stack, comp = [left.pop()], set()
        while stack:
            x, y = stack.pop()
            comp.add((x, y))
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    q = (x + dx, y + dy)
                    if q in left:
                        left.remove(q)
                        stack.append(q)
        out.append(comp)
    return out


@pytest.mark.parametrize("limit", [None, 3])
def test_components_match_flood_fill(spark, limit):
    rng = random.Random(11)
    drawn = {
        "noise": {(x, y) for x in range(40) for y in range(30) if rng.random() < 0.35},
        # A spiral: long dependency chains, one component.
        "comb": {(x, y) for x in range(0, 40, 2) for y in range(20)} | {(x, 0 if (x // 2) % 2 else 19) for x in range(40)},
        "one": {(500, 1)},
    }
    rows = [(k, x, y, True) for k, cells in drawn.items() for x, y in cells]
    df = spark.createDataFrame(rows, "sample_id string, x int, y int, fg boolean").repartition(5)
    stats = CC.component_stats(CC.label_components(df, limit=limit), min_area=4)
    got = sorted((r["sample_id"], r["area"], r["x"], r["y"], r["w"], r["h"]) for r in stats.collect())
    want = []
    for k, cells in drawn.items():
        for comp in flood(cells):
            xs, ys = [p[0] for p in comp], [p[1] for p in comp]
            want.append((k, len(comp), min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1))
    assert got == sorted(want)
    summary = {r["sample_id"]: r for r in CC.component_summary(stats).collect()}
    assert (summary["one"]["accepted"], summary["one"]["rejected"], summary["one"]["median_area"]) == (0, 1, 2000.0)


def png(path, pixels, channels):
    """Write an 8-bit PNG by hand: grey, RGB or RGBA."""
    h, w = len(pixels), len(pixels[0])
    kind = {1: 0, 3: 2, 4: 6}[channels]
    raw = b"".join(b"\0" + bytes(v for p in row for v in (p if channels > 1 else (p,))) for row in pixels)

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    head = struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_scan_pixels_and_manifest(spark, tmp_path):
    png(tmp_path / "rgb.png", [[(1, 2, 3), (250, 100, 0)], [(9, 8, 7), (0, 0, 255)]], 3)
    png(tmp_path / "grey.png", [[7, 200]], 1)
    png(tmp_path / "clear.png", [[(10, 20, 30, 255), (10, 20, 30, 0)]], 4)
    (tmp_path / "empty.png").write_bytes(b"x")
    (tmp_path / "notes.txt").write_bytes(b"not an image at all")
    got = {
        (r["sample_id"].rsplit("/", 1)[1], r["x"], r["y"]): (r["r"], r["g"], r["b"])
        for r in IM.scan_pixels(spark, str(tmp_path)).collect()
    }
    assert got[("rgb.png", 1, 0)] == (250, 100, 0) and got[("rgb.png", 0, 1)] == (9, 8, 7)
    assert got[("grey.png", 1, 0)] == (200, 200, 200)
    assert got[("clear.png", 0, 0)] == (10, 20, 30) and got[("clear.png", 1, 0)] == (255, 255, 255)
    verdicts = {r["path"].rsplit("/", 1)[1]: r["verdict"] for r in IM.scan_image_manifest(spark, str(tmp_path)).collect()}
    assert verdicts == {"rgb.png": "ok", "grey.png": "ok", "clear.png": "ok", "empty.png": "empty", "notes.txt": "unsupported"}


def test_contour_of_a_rectangle(spark):
    pts = [(0, 0), (10, 0), (10, 4), (0, 4)]
    rows = [("s", 1, i, x, y) for i, (x, y) in enumerate(pts)] + [("s", 2, i, x, y) for i, (x, y) in enumerate(reversed(pts))]
    rows += [("s", 3, 0, 0, 0), ("s", 3, 1, 1, 0)]
    df = spark.createDataFrame(rows, "sample_id string, instance_id int, seq int, x int, y int")
    m = CT.polygon_moments(df)
    got = {r["instance_id"]: r for r in CT.polygon_measures(m).collect()}
    for i in (1, 2):
        assert (got[i]["area"], got[i]["perimeter"], got[i]["cx"], got[i]["cy"]) == (40.0, 28.0, 5.0, 2.0)
    assert got[3]["refused"] == "Contour area < 5 pixels"
    spans = {r["instance_id"]: r for r in CT.principal_spans(df, m).collect()}
    assert (spans[1]["principal_span"], spans[1]["transverse_span"], spans[1]["caliper_length"]) == (10.0, 4.0, 10.0)


def explained(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("tile", [4, 64])
def test_gather_over_tiles(spark, tile, monkeypatch):
    """Sparse pixels of two frames over many tiles, negative places, repeats, and all offsets that operators use."""
    monkeypatch.setattr(PX, "TILE", tile)
    rng = random.Random(tile)
    spots = {(s, rng.randrange(-9, 30), rng.randrange(-9, 30)): rng.randrange(100) for s in "ab" for _ in range(700)}
    rows = [(*k, v) for k, v in spots.items()]
    df = spark.createDataFrame(rows + rows[:20], "s string, x int, y int, v int").repartition(5)
    offsets = [*PX.CROSS, *PX.CORNERS, *GLCM_OFFSETS]
    met = PX.gather(df, ["s"], offsets, F.col("v"), keep=[])
    plan = explained(met)
    got = sorted(map(tuple, met.collect()), key=repr)
    want = [(s, x, y, v, *[spots.get((s, x + dx, y + dy)) for dx, dy in offsets]) for s, x, y, v in rows + rows[:20]]
    assert got == sorted(want, key=repr)
    assert "SortAggregate" not in plan and plan.count("Arguments: hashpartitioning") == 1


def test_tiles_copy_few_pixels(spark):
    frame = spark.range(256 * 256).selectExpr("id % 256 AS x", "id div 256 AS y", "1 AS s")
    for reach in (1, 3):
        assert PX.tiled(frame, ["s"], reach).count() < 1.3 * 256 * 256
    crop = spark.range(60).selectExpr("id % 10 AS x", "id div 10 AS y", "1 AS s")
    assert PX.tiled(crop, ["s"], 3).count() == 60


def test_touching_over_tiles_and_copies(spark, monkeypatch):
    monkeypatch.setattr(PX, "TILE", 4)
    rng = random.Random(8)
    masks = {i: {(x0 + dx, y0 + dy) for dx in range(3) for dy in range(2)} for i in range(40) for x0, y0 in [(rng.randrange(40), rng.randrange(40))]}
    masks |= {100 + i: {(60, 60)} for i in range(50)} | {200: {(70, 70)}, 201: {(71, 71)}, 202: {(73, 71)}}
    near = lambda a, b: any(abs(x - u) <= 1 and abs(y - v) <= 1 for x, y in a for u, v in b)
    want = {i: any(i != j and near(a, b) for j, b in masks.items()) for i, a in masks.items()}
    rows = [("s", i, True, x, y) for i, m in masks.items() for x, y in m] + [("s", 0, False, 5, 5)]
    df = spark.createDataFrame(rows, "sample_id string, instance_id long, mask boolean, x int, y int").repartition(4)
    assert {r["instance_id"]: r["is_touching"] for r in PX.flag_touching(df).collect()} == want
