"""Files of several kinds get their size and the first reason that refuses them."""

from __future__ import annotations

import struct
import zlib

from sievekit.sources.images import scan_image_manifest, scan_pixels


def png(width, height, rows=b""):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def jpeg(width, height, before=0):
    extra = b"\xff\xe1" + struct.pack(">H", before + 2) + bytes(before)
    return b"\xff\xd8" + extra + b"\xff\xff\xc0" + struct.pack(">HBHH", 11, 8, height, width) + bytes(9)


def test_manifest(spark, tmp_path):
    pixels = b"".join(b"\0" + bytes([x, y, 7]) for y in range(3) for x in range(1))
    files = {
        "ok.png": (png(1, 3, pixels), 1, 3, "ok"),
        "huge.png": (png(20_000, 10_000), 20_000, 10_000, "too_large"),
        "photo.JPG": (jpeg(640, 480, 500), 640, 480, "ok"),
        "late.jpg": (jpeg(640, 480, 65_533), None, None, "ok"),
        "broken.png": (b"this is no image at all", None, None, "unreadable"),
        "short.png": (b"\x89PNG\r\n\x1a\n\0\0", None, None, "unreadable"),
        "bytes.png": (png(2, 2) + bytes(66_000), None, None, "too_many_bytes"),
        "nothing.png": (b"abc", None, None, "empty"),
        "notes.txt": (b"twelve bytes", None, None, "unsupported"),
    }
    for name, (data, *_) in files.items():
        (tmp_path / name).write_bytes(data)
    got = {
        r["path"].rsplit("/", 1)[1]: (r["image_w"], r["image_h"], r["verdict"])
        for r in scan_image_manifest(spark, str(tmp_path), max_bytes=66_000).collect()
    }
    assert got == {name: tuple(rest) for name, (_, *rest) in files.items()}
    seen = scan_pixels(spark, str(tmp_path / "ok.png")).orderBy("y").collect()
    assert [(r["x"], r["y"], r["r"], r["g"], r["b"]) for r in seen] == [(0, y, 0, y, 7) for y in range(3)]
