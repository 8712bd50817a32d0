"""A log that is appended to and rotated while it is followed."""

from __future__ import annotations

import os

import pytest

from sievekit.sources import follow
from sievekit.streaming import logs as ST


def run(spark, folder, root, chunk=40):
    """One run over what is there now, resumed from its checkpoint; all lines so far."""
    lines = ST.follow_logs(spark, f"file://{folder}", chunk).select("value", "member", "byte")
    query = (
        lines.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return sorted(r["value"] for r in spark.read.parquet(f"{root}/out").collect())


def append(folder, text, name="app.log"):
    with open(f"{folder}/{name}", "ab") as file:
        file.write(text.encode())


def test_append_rotate_append(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "other.log").write_text("no\n")
    want = [f"line {i} é" for i in range(30)]
    append(folder, "\n".join(want) + "\n" + "half a ")
    assert run(spark, folder, tmp_path) == sorted(want)
    append(folder, "line\r\n\n")
    want += ["half a line", ""]
    assert run(spark, folder, tmp_path) == sorted(want)
    append(folder, "last before rotation\n")
    os.rename(folder / "app.log", folder / "app.log.1")
    append(folder, "line 0 é\nnew file\nopen")  # the same first line as the old file
    want += ["last before rotation", "line 0 é", "new file"]
    assert run(spark, folder, tmp_path) == sorted(want)
    os.rename(folder / "app.log.1", folder / "app.log.2")
    append(folder, " end\n")
    os.rename(folder / "app.log", folder / "app.log.1")
    append(folder, "third\n" + "x" * 300 + "\n")
    want += ["open end", "third", "x" * 300]
    assert run(spark, folder, tmp_path) == sorted(want)
    os.remove(folder / "app.log.2")  # read, so nothing is lost
    append(folder, "fourth\n")
    assert run(spark, folder, tmp_path) == sorted(want + ["fourth"])
    assert run(spark, folder, tmp_path) == sorted(want + ["fourth"])


def test_ranges_cut_lines_once(tmp_path):
    append(tmp_path, "".join("y" * n + "\n" for n in (0, 1, 5, 0, 90, 3, 40, 39, 0, 0)) + "rest")
    for chunk in (1, 2, 7, 40, 1000):
        reader = follow.FollowReader(str(tmp_path), "app.log", chunk)
        end = reader.latestOffset()
        for first in (0, 1, 3, 9):
            parts = reader.partitions({k: first for k in end}, end)
            found = [(b, v) for p in parts for batch in reader.read(p) for v, b in zip(batch[0].to_pylist(), batch[2].to_pylist())]
            assert [v for _, v in sorted(found)] == [x.decode() for x in (tmp_path / "app.log").read_bytes()[first:].split(b"\n")[:-1]]


def test_rotated_between_plan_and_read(tmp_path):
    append(tmp_path, "a\nb\n")
    reader = follow.FollowReader(str(tmp_path), "app.log", 100)
    parts = reader.partitions({}, reader.latestOffset())
    os.rename(tmp_path / "app.log", tmp_path / "app.log.1")
    append(tmp_path, "c\n")
    assert [x for p in parts for batch in reader.read(p) for x in batch[0].to_pylist()] == ["a", "b"]
    os.remove(tmp_path / "app.log.1")
    with pytest.raises(OSError):
        [list(reader.read(p)) for p in parts]


def test_only_mounted_folders():
    assert follow.local_folder("file:///a/b%20c") == "/a/b c" and follow.local_folder("/x") == "/x"
    with pytest.raises(ValueError):
        follow.local_folder("s3a://bucket/logs")
