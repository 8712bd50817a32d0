"""Short codes for the feature vectors of detected objects, by product quantisation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from sievekit.fixed import GATE_FEATURES
from sievekit.session import discard, scratch_path

#: Sums of components are handed on in digits of this base, so that they never overflow.
_LIMB = 40

_WHOLE = np.frompyfunc(int, 1, 1)


class Coder:
    """Codebooks of whole numbers, one per part, and the nearest entries of a batch of vectors.

    ``books[p]`` is an (entries, width) array: int64 where squared distances fit, else Python numbers.
    ``moved[p]`` tells which entries changed since distances were last stored; None, if none are.
    """

    def __init__(self, books: list[np.ndarray], moved: list[np.ndarray] | None = None):
        self.books, self.moved = books, moved
        self.cuts = np.concatenate([[0], np.cumsum([b.shape[1] for b in books])]).astype(int)

    def part(self, vectors: np.ndarray, p: int) -> np.ndarray:
        part = vectors[:, self.cuts[p] : self.cuts[p + 1]]
        return _WHOLE(part) if self.books[p].dtype == object else part.astype(np.int64)

    def assign(self, vectors: np.ndarray, entry: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each part and its squared distance, equal ones going to the lower index.

        ``entry`` and ``distance`` are those stored after the last assignment. Where the assigned
        entry stayed, its stored distance is still exact and no other entry that stayed is nearer, so
        only moved ones are compared with it. Elsewhere all are.
        """
        entry, distance = entry.copy(), distance.copy()
        for p, book in enumerate(self.books):
            part = self.part(vectors, p)
            moved = np.ones(len(book), bool) if self.moved is None else self.moved[p]
            stays = ~moved[entry[:, p]]
            again = np.flatnonzero(~stays)
            _nearest(part, book, again, range(len(book)), entry[:, p], distance[:, p], fresh=True)
            _nearest(part, book, np.flatnonzero(stays), np.flatnonzero(moved), entry[:, p], distance[:, p], fresh=False)
        return entry, distance


def _nearest(part, book, rows, candidates, entry, distance, fresh: bool) -> None:
    """Take the nearest of ``candidates`` into entry and distance of ``rows``, where it beats what is there."""
    if not len(rows):
        return
    best = np.full(len(rows), -1) if fresh else entry[rows]
    least = None if fresh else distance[rows]
    part = part[rows]
    for k in candidates:
        d = ((part - book[k]) ** 2).sum(axis=1) if book.shape[1] else np.zeros(len(rows), book.dtype)
        if least is None:
            best[:], least = k, d
            continue
        better = (d < least) | ((d == least) & (k < best))
        best, least = np.where(better, k, best), np.where(better, d, least)
    entry[rows], distance[rows] = best, least


def _limbs(value: int) -> list[int]:
    """Digits of a whole number; the last one carries the sign."""
    out = []
    while not -(1 << _LIMB) <= value < 1 << _LIMB:
        out.append(value & ((1 << _LIMB) - 1))
        value >>= _LIMB
    return [*out, value]


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _distances(column: pa.Array, parts: int, wide: bool) -> np.ndarray:
    flat = column.flatten()
    if wide:
        return np.array([int(x) for x in flat.to_pylist()], object).reshape(-1, parts)
    return flat.to_numpy(zero_copy_only=False).reshape(-1, parts)


def _step(rows: DataFrame, coder: Coder, width: int, wide: bool, to: str) -> DataFrame:
    """Assign all parts anew; write the rows with what they are assigned to, and read them."""
    parts, whole = len(coder.books), pa.string() if wide else pa.int64()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            entry = batch.column("entry").flatten().to_numpy(zero_copy_only=False).reshape(n, parts).astype(np.int64)
            distance = _distances(batch.column("distance"), parts, wide)
            entry, distance = coder.assign(_vectors(batch.column("vector"), width), entry, distance)
            offsets = pa.array(np.arange(0, n * parts + 1, parts, dtype=np.int32))
            flat = [str(x) for x in distance.ravel()] if wide else distance.ravel()
            found = {
                "entry": pa.ListArray.from_arrays(offsets, pa.array(entry.ravel().astype(np.int16))),
                "distance": pa.ListArray.from_arrays(offsets, pa.array(flat, whole)),
            }
            yield pa.RecordBatch.from_arrays([found.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

    rows.mapInArrow(work, rows.schema).write.parquet(to)
    return rows.sparkSession.read.schema(rows.schema).parquet(to)


def _sums(rows: DataFrame, coder: Coder, width: int) -> list[list[tuple[int, list[int]]]]:
    """(count, component sums) of each entry of each part.

    Every task adds up its own rows; to the driver come at most a few numbers for each component of the codebooks.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, object) for b in coder.books]
        count = np.zeros((len(coder.books), max(len(b) for b in coder.books)), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _vectors(batch.column("vector"), width)
            entry = batch.column("entry").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for p, book in enumerate(coder.books):
                part = coder.part(vectors, p)
                for k in np.unique(entry[:, p]):
                    own = entry[:, p] == k
                    count[p, k] += own.sum()
                    sums[p][k] += part[own].sum(axis=0).astype(object)
        out = [
            (p, k, i, j, limb)
            for p, book in enumerate(sums) for k in np.flatnonzero(count[p])
            for i, total in enumerate([int(count[p, k]), *map(int, book[k])]) for j, limb in enumerate(_limbs(total))
        ]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["part", "entry", "at", "limb", "value"])

    named = "part bigint, entry bigint, at bigint, limb bigint, value bigint"
    found = rows.select("vector", "entry").mapInArrow(work, named).groupBy("part", "entry", "at", "limb").agg(F.sum("value").alias("value"))
    totals = [[[0] * (b.shape[1] + 1) for _ in b] for b in coder.books]
    for r in found.collect():
        totals[r["part"]][r["entry"]][r["at"]] += r["value"] << (_LIMB * r["limb"])
    return [[(t[0], t[1:]) for t in book] for book in totals]


def _kept(detections: DataFrame, key: str, features: str | Sequence[str], label: str, scale: float) -> DataFrame:
    """(key, label, vector) of whole numbers; rows without a full, finite vector are left out."""
    vector = F.col(features) if isinstance(features, str) else F.array(*features)
    rows = detections.select(F.col(key).alias("key"), F.col(label).alias("label"), vector.cast("array<double>").alias("v"))
    fits = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * F.lit(float(scale))) < float("inf")))
    return rows.where(F.col("v").isNotNull() & fits).select("key", "label", "v")


def compress_features(
    detections: DataFrame, key: str = "object_id", features: str | Sequence[str] = GATE_FEATURES, label: str = "class_id",
    parts: int = 3, entries: int = 16, rounds: int = 6, scale: float = 4096,
) -> tuple[DataFrame, list[list[list[int]]]]:
    """Codes for the feature vectors of detections, and the codebooks they refer to.

    ``detections`` has ``key``, ``label`` (such as the class that was found) and the features: the name of one
    array column, or those of several numeric ones. A component x becomes the whole number
    floor(scale * x); a vector is cut into ``parts`` consecutive parts (equal ones; if the length does
    not divide, the first parts have one component more). The codebook of a part starts as that part
    of the ``entries`` first vectors by key. Each of ``rounds`` rounds assigns every part to its
    nearest entry (squared distance, equal ones to the lower index) and sets each entry to
    floor(sum / count) of its parts, component by component; an entry without parts stays. At last
    parts are assigned again. Returns (rows, codebooks): ``key, code, error, label_error`` per kept
    detection, where ``code`` has two hex digits per part, ``error`` is the sum of its parts' squared
    distances and ``label_error`` the sum of ``error`` over its label, and the entries by part.

    Active-entry Lloyd: each row keeps the exact distance to its assigned entries. Where an entry
    stayed, only moved entries are compared with it; other parts are compared with all. Rows and
    what they are assigned to are a table in the shared folder that each round reads and writes
    once; codebooks, whose size is a parameter, are all that reaches the driver.

    All arithmetic is exact, for components of any size; ``error`` and ``label_error`` are null
    where they do not fit a long. Rows are left out if the vector is null, has a null, NaN or infinite
    component (also after scaling), or another length than the first kept one by key. Null keys
    come last. Rows of equal key are taken in the order of their vectors and are rows of their own.
    With fewer than ``entries`` rows the codebook is as much smaller. Null labels are one label.
    Further columns are not read. An empty table gives an empty result and empty codebooks.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("codes have two digits: 1 to 256 entries, and one part or more")
    spark, place = detections.sparkSession, scratch_path(detections.sparkSession, "codes")
    kept = _kept(detections, key, features, label, scale)
    head = kept.orderBy(F.col("key").asc_nulls_last(), "v").limit(1).collect()
    width = len(head[0]["v"]) if head else 0
    kept = kept.where(F.size("v") == width)
    first = [r["v"] for r in kept.orderBy(F.col("key").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    most = kept.select(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0.0
    sizes = [len(x) for x in np.array_split(np.arange(width), parts)]
    # Sums of squares of differences must fit 63 bits, and the components an int.
    bound = int(most * scale) + 1
    wide = bound >= 1 << 31 or (2 * bound) ** 2 * max(sizes) >= 1 << 62
    number = "double" if wide else "int"  # a double holds floor(scale * x) exactly
    floors = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast(number) if not wide else _floor(x * F.lit(float(scale))))
    blank = {"entry": F.array_repeat(F.lit(0).cast("smallint"), parts), "distance": F.array_repeat(F.lit("0" if wide else 0).cast("string" if wide else "bigint"), parts)}
    rows = kept.select("key", "label", floors.alias("vector"), *[v.alias(k) for k, v in blank.items()])

    starts = [[int(np.floor(x * float(scale))) for x in v] for v in first]
    cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    kind = object if wide else np.int64
    books = [np.array([v[a:b] for v in starts], kind).reshape(len(starts), b - a) for a, b in zip(cuts, cuts[1:])]
    moved, step = None, 0
    if starts:
        for step in range(rounds + 1):
            rows = _step(rows, Coder(books, moved), width, wide, f"{place}/{step}")
            if step:
                discard(spark, f"{place}/{step - 1}")
            if step == rounds:
                break
            old, totals = books, _sums(rows, Coder(books), width)
            books = [
                np.array([[s // n for s in sums] if n else list(entry) for (n, sums), entry in zip(found, book)], kind).reshape(book.shape)
                for found, book in zip(totals, books)
            ]
            moved = [(a != b).any(axis=1) if a.shape[1] else np.zeros(len(a), bool) for a, b in zip(old, books)]

    code = F.array_join(F.transform("entry", lambda k: F.lower(F.lpad(F.hex(k.cast("bigint")), 2, "0"))), "")
    whole = F.transform("distance", lambda d: d.try_cast("decimal(38,0)"))
    error = F.aggregate(whole, F.lit(0).cast("decimal(38,0)"), lambda a, d: F.try_add(a, d).cast("decimal(38,0)"))
    rows = rows.select("key", "label", code.alias("code"), error.try_cast("bigint").alias("error"))
    sums = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("total"), F.count_if(F.col("error").isNull()).alias("lost"))
    sums = sums.select(F.col("label").alias("of"), F.when(F.col("lost") == 0, F.col("total").try_cast("bigint")).alias("label_error"))
    sums.write.parquet(f"{place}/labels")  # its size is known when the join is planned
    sums = spark.read.schema(sums.schema).parquet(f"{place}/labels")
    found = rows.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select(F.col("key").alias(key), "code", "error", "label_error")
    return found, [[[int(x) for x in entry] for entry in book] for book in books]


def _floor(x):
    """Floor of a double as a double, for any size."""
    return F.when(F.abs(x) >= float(1 << 53), x).otherwise(F.floor(x).cast("double"))


def codebooks_sha256(books: list[list[list[int]]]) -> str:
    """Digest of all entries' components, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
