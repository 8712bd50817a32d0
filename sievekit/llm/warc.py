"""WARC archives of request results: written with the text writer, read by a data source of our own.

Records without a predecessor in the project: the service keeps results in run folders, not
in web archives. The operators take any table with a key, a URL and a text payload.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

_CRLF = "\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, "
    "payload_digest string, payload_bytes bigint, payload binary"
)
#: Columns that are headers of a record, known before its payload.
_HEADERS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date",
    "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest",
}


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text's UTF-8 bytes."""
    quads = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.conv(F.substring(F.sha1(text), i * 5 + 1, F.lit(5)), 16, 10).cast("int"),
    )
    chars = F.transform(
        quads,
        lambda v: F.concat(*[F.substring(F.lit(_BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]),
    )
    return F.array_join(chars, "")


def mark_revisits(results: DataFrame, key: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """Adds ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to`` to every row.

    Of rows with equal payloads of at least ``min_bytes`` bytes that with the largest key is the
    response, the others revisit it; rows that share that key, and rows of a group without
    any key, are all responses. The largest key is found by an aggregate, so copies of any
    number do not meet in one task.
    """
    text = F.coalesce(F.col(payload), F.lit(""))
    rows = results.withColumns(
        {payload: text, "payload_bytes": F.octet_length(text).cast("long"), "payload_digest": base32_sha1(text)}
    )
    last = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max(key).alias("_last"))
    again = F.col("_last").isNotNull() & (F.col("payload_bytes") >= min_bytes) & ~F.col(key).eqNullSafe(F.col("_last"))
    return rows.join(last, "payload_digest", "left").withColumns(
        {"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("_last"))}
    ).drop("_last")


def write_warc(
    results: DataFrame, path: str, key: str = "request_id", url: str = "path", payload: str = "document",
    min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip",
) -> None:
    """Write one WARC record per row into a new folder of ``path``.

    ``results`` has ``key`` (the ``request_id``), ``url`` (the full URL of its ``path``) and
    ``payload`` (the result ``document``). Files are WARC/1.1, one per task: a row of Spark's
    text writer is a record, and the line separator is what ends a record. So any store that
    Spark writes to will do. With ``gzip`` each file is one compressed stream; ``none`` keeps
    them plain, and the reader then seeks over what it skips. Copies of a payload become revisit records without it
    (``mark_revisits``); their HTTP header keeps its length.

    Null payloads are empty; a null key or URL leaves its header out. Blanks and control
    characters of a URL are percent-encoded so that they cannot end the header. Repeated rows
    are records of their own. Only three columns are read, so other names cannot clash. An
    empty table gives a folder without records.
    """
    rows = mark_revisits(
        results.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(payload).alias("payload")), "key", "payload", min_bytes
    )

    def header(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))).otherwise("")

    def urn(name: str) -> Column:
        return F.concat(F.lit("<urn:record:"), F.col(name).cast("string"), F.lit(">"))

    clean = F.col("url")
    for code in (*range(0x21), 0x7F):
        clean = F.replace(clean, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(_CRLF * 2),
    )
    body = F.when(F.col("record_type") == "response", F.concat(http, "payload")).otherwise(http)
    record = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"), header("WARC-Type", F.col("record_type")), header("WARC-Record-ID", urn("key")),
        header("WARC-Date", F.lit(date)), header("WARC-Target-URI", clean), header("WARC-Refers-To", urn("refers_to")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(F.col("record_type") == "revisit", f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_CRLF}").otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response" + _CRLF),
        F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(_CRLF * 2), body,
    )
    rows.select(record.alias("value")).write.option("lineSep", _CRLF * 2).text(path, compression=compression)


@dataclass
class Files(InputPartition):
    """Archive files that one task reads."""

    paths: tuple[str, ...]


class _Stream:
    """Headers and blocks of a file, read in pieces; skipped blocks are never held whole."""

    def __init__(self, file, piece: int = 1 << 20):
        self.file, self.piece, self.held = file, piece, b""

    def until(self, end: bytes) -> bytes | None:
        at = 0
        while (found := self.held.find(end, at)) < 0:
            at = max(0, len(self.held) - len(end) + 1)
            more = self.file.read(self.piece)
            if not more:
                return None
            self.held += more
        out, self.held = self.held[:found], self.held[found + len(end) :]
        return out

    def take(self, n: int) -> bytes:
        if len(self.held) < n:
            self.held += self.file.read(n - len(self.held))
        if len(self.held) < n:
            raise ValueError("an archive ends inside a record")
        out, self.held = self.held[:n], self.held[n:]
        return out

    def skip(self, n: int) -> None:
        here = min(n, len(self.held))
        self.held, n = self.held[here:], n - here
        if n and self.file.seekable():
            self.file.seek(n, 1)
            return
        while n and (more := self.file.read(min(n, self.piece))):
            n -= len(more)


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split(_CRLF)
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


class WarcReader(DataSourceReader):
    """Plans files into partitions, takes header predicates, and decodes payloads only when asked."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "false").lower() == "true"
        self.target = int(options.get("partitionbytes", 32 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in _HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Small files together, a large file alone."""
        store, root = pyarrow.fs.FileSystem.from_uri(self.path)
        infos = store.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        files = sorted((i.path, i.size) for i in infos if i.is_file and posixpath.basename(i.path)[0] not in "._")
        out: list[InputPartition] = []
        batch, size = [], 0
        for path, n in files:
            if batch and size + n > self.target:
                out.append(Files(tuple(batch)))
                batch, size = [], 0
            batch.append(path)
            size += n
        return [*out, Files(tuple(batch))]

    def _fits(self, row: dict) -> bool:
        for f in self.filters:
            value = row[f.attribute[0]]
            if isinstance(f, StringStartsWith):
                ok = value is not None and value.startswith(f.value)
            else:
                ok = value is not None and value in (f.value if isinstance(f, In) else (f.value,))
            if not ok:
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        rows: list[tuple] = []
        held = 0
        for path in partition.paths:
            packed = path.endswith(".gz")
            with (store.open_input_stream(path, compression="gzip") if packed else store.open_input_file(path)) as file:
                for row in self._records(_Stream(file)):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if len(rows) >= 4096 or held > 16 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
        yield _batch(rows)

    def _records(self, stream: _Stream) -> Iterator[tuple]:
        while (raw := stream.until(b"\r\n\r\n")) is not None:
            head = _headers(raw)
            length = int(head["content-length"])
            row = {name: head.get(source) for name, source in _HEADERS.items()}
            for name in ("record_id", "refers_to"):
                row[name] = row[name] and row[name].removeprefix("<urn:record:").removesuffix(">")
            row["payload_digest"] = row["payload_digest"] and row["payload_digest"].removeprefix("sha1:")
            if self._fits(row):
                block = stream.take(length) if length <= 4096 or self.payload else None
                if block is None:  # only the HTTP header
                    http = stream.until(b"\r\n\r\n")
                    stream.skip(length - len(http) - 4)
                    payload = None
                else:
                    http, _, payload = block.partition(b"\r\n\r\n")
                size = int(_headers(http)["content-length"])
                if not self.payload or row["record_type"] != "response":
                    payload = None
                elif len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != row["payload_digest"]:
                    raise ValueError(f"the payload of {row['record_id']} is not the one that was archived")
                yield *(row[name] for name in _HEADERS), size, payload
            else:
                stream.skip(length)
            stream.take(4)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sievekit_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of all WARC files under ``path`` (plain or ``.gz``).

    Columns: see ``SCHEMA``; ``payload`` is null unless asked for, and is then checked against
    its digest. Equality, membership and prefix conditions on header columns are answered
    from the headers: what does not fit is skipped without being read into memory or decoded.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format(WarcSource.name()).option("payload", str(payload).lower()).load(path)
