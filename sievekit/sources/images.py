"""Image files: a checked manifest, and pixels of every image."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.fixed import IMAGE_EXTENSIONS
from sievekit.functions.rules import Col, c

MAX_PIXELS = 100_000_000
# Pixels sent to Spark at a time, whatever the size of the image.
_CHUNK = 1 << 16
# Bytes at the start of a file in which its size is looked for.
_HEAD = 1 << 16


def image_verdict(
    name: Col, length: Col, pixels: Col | None = None, extensions: Sequence[str] = IMAGE_EXTENSIONS,
    max_pixels: int = MAX_PIXELS, max_bytes: int | None = None,
) -> Column:
    """ok, or the first reason a file is refused: empty, unsupported, too_large."""
    suffix = F.lower(F.regexp_extract(c(name), r"[^/\\](\.[^./\\]+)$", 1))
    out = F.when(F.coalesce(c(length), F.lit(0)) < 8, "empty").when(~suffix.isin(*extensions), "unsupported")
    if max_bytes is not None:
        out = out.when(c(length) > max_bytes, "too_many_bytes")
    if pixels is not None:
        out = out.when(c(pixels) > max_pixels, "too_large")
    return out.otherwise("ok")


def _jpeg_size(head: bytes) -> tuple[int, int] | None:
    """Width and height from the first frame header; None if it is not in ``head``."""
    at = 2
    while at + 9 <= len(head) and head[at] == 0xFF:
        kind = head[at + 1]
        # Frame headers, but for the three kinds of table that share their range.
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(head[at + 7 : at + 9], "big"), int.from_bytes(head[at + 5 : at + 7], "big")
        # Fill bytes and markers without a length are a byte or two long.
        bare = kind == 0x01 or 0xD0 <= kind <= 0xD8
        at += 1 if kind == 0xFF else 2 if bare else 2 + int.from_bytes(head[at + 2 : at + 4], "big")
    return None


def _head_facts(head: bytes) -> tuple[bool, int | None, int | None]:
    """(known start, width, height) of a file that begins with ``head``."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return True, int.from_bytes(head[16:20], "big"), int.from_bytes(head[20:24], "big")
    if head[:3] == b"\xff\xd8\xff":
        return True, *(_jpeg_size(head) or (None, None))
    return False, None, None


def _head_sizes(heads: pd.Series) -> pd.DataFrame:
    facts = pd.DataFrame([_head_facts(h or b"") for h in heads], columns=["known", "image_w", "image_h"])
    return facts.astype({"known": bool, "image_w": "Int64", "image_h": "Int64"})


def scan_image_manifest(
    spark: SparkSession, path: str, max_bytes: int | None = 50 << 20, max_pixels: int = MAX_PIXELS
) -> DataFrame:
    """Every file under ``path`` with its size in pixels and its verdict; no image is decoded.

    Spark's file source leaves files without a single byte out, here as elsewhere.

    The first ``_HEAD`` bytes of PNG and JPEG files say how large they are. ``unreadable``
    is a file of such a name that does not begin like one; a file that breaks off later is not
    noticed here. Sizes are null, and not judged, for other formats and for a JPEG whose frame
    header comes later.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head = F.when(F.col("length") <= max_bytes, F.substring("content", 1, _HEAD)) if max_bytes else F.substring("content", 1, _HEAD)
    sizes = F.pandas_udf(_head_sizes, "known boolean, image_w long, image_h long")
    rows = files.select("path", "length", "modificationTime", head.alias("_head")).withColumn("_facts", sizes("_head"))
    rows = rows.select("path", "length", "modificationTime", "_facts.*")
    verdict = image_verdict("path", "length", F.col("image_w") * F.col("image_h"), max_pixels=max_pixels, max_bytes=max_bytes)
    headed = F.lower("path").rlike(r"\.(png|jpe?g)$")
    return rows.select(
        "path", "length", "modificationTime", "image_w", "image_h",
        F.when((verdict == "ok") & headed & ~F.col("known"), "unreadable").otherwise(verdict).alias("verdict"),
    )


def _pixel_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            flat = np.frombuffer(row.data, dtype=np.uint8).reshape(row.height * row.width, row.channels)
            for start in range(0, len(flat), _CHUNK):
                part = flat[start : start + _CHUNK].astype(np.int32)
                # Bytes are stored blue, green, red; grey has one, transparency is a fourth.
                rgb = part[:, [2, 1, 0]] if row.channels >= 3 else np.repeat(part[:, :1], 3, axis=1)
                if row.channels == 4:
                    alpha = part[:, 3:4]
                    rgb = (rgb * alpha + 255 * (255 - alpha) + 127) // 255
                at = np.arange(start, start + len(part))
                yield pd.DataFrame(
                    {
                        "sample_id": row.origin, "x": (at % row.width).astype(np.int32),
                        "y": (at // row.width).astype(np.int32), "r": rgb[:, 0], "g": rgb[:, 1], "b": rgb[:, 2],
                    }
                )


def scan_pixels(spark: SparkSession, path: str, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """(sample_id, x, y, r, g, b) of all readable images; the JVM decodes, numpy unrolls.

    Which files have no pixels here, and why, is in ``scan_image_manifest``.
    """
    images = spark.read.format("image").option("dropInvalid", "true").load(path)
    flat = images.select(
        "image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data"
    ).where(F.col("height").cast("long") * F.col("width") <= max_pixels)
    return flat.mapInPandas(_pixel_chunks, "sample_id string, x int, y int, r int, g int, b int")
