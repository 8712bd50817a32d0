"""Lines that repeat lines of earlier records, exactly or but for one word."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.llm import texts as T
from sievekit.session import checkpointed, discard, scratch_path

_STEP = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


#: Lines of a record come before so many of the next one.
_LINES = 1 << 31


class _Sums:
    """Hashes of word runs of a piece, from one running sum."""

    def __init__(self, piece: T.Piece):
        start, end, _ = piece.words()
        words = T.ranges(piece.buf, start, end, fold=True)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * T.FORWARD.upto(len(words)), out=self.sums[1:])
        self.back = T.BACK.upto(len(words) + 1)
        l_start, l_end, self.lines = piece.lines()
        self.first, self.last = np.searchsorted(start, l_start), np.searchsorted(start, l_end)

    def run(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The words a to b, wherever they stand."""
        return (self.sums[b] - self.sums[a]) * self.back[a]


def _named(run: np.ndarray, *tags: np.ndarray | int) -> np.ndarray:
    for tag in tags:
        run = T.mix(run + np.asarray(tag).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return run.view(np.int64)


def _anchor(n: np.ndarray) -> np.ndarray:
    """Words at either end of a line of n of which one edit leaves one end alone."""
    return np.maximum(n // 2 // 3 * 3, 1)


def _scan(rows: DataFrame, exact: int, least: int) -> DataFrame:
    """(key, seen, no, line, ends): each line of at least ``exact`` words.

    ``line`` names its words; ``ends`` its first and last words, as long as half of the line or
    a little less. Two lines within one edit, the longer of at least ``least`` words, share one
    of them; a line that is too short for any such pair has none.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in T.pieces(batch.column(2)):
                s = _Sums(p)
                a, b = s.first, s.last
                n = b - a
                keep = np.flatnonzero(n >= exact)
                row = np.repeat(np.arange(len(p)), np.diff(s.lines))[keep]
                no = keep - s.lines[row]
                a, b, n = a[keep], b[keep], n[keep]
                ends = []
                for size in (n, n - 1):  # as the shorter line of a pair, and as the longer one
                    k = _anchor(size)
                    ends += [_named(s.run(a, a + k), k, 1), _named(s.run(b - k, b), k, 2)]
                same = _anchor(n) == _anchor(n - 1)
                count = np.where(same | (n < least), 2, 4) * (n >= least - 1)
                flat = np.stack(ends, axis=1)
                mask = np.arange(4)[None, :] < count[:, None]
                offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row + p.first)), batch.column(1).take(pa.array(row + p.first)),
                        pa.array(no.astype(np.int32)), pa.array(_named(s.run(a, b), n)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[mask])),
                    ],
                    ["key", "seen", "no", "line", "ends"],
                )

    return rows.mapInArrow(work, "key bigint, seen bigint, no int, line bigint, ends array<bigint>")


def _variants(rows: DataFrame, least: int) -> DataFrame:
    """(variant, at, line, key, no): the deletion neighbourhood of the lines ``asked`` (no, line).

    ``at`` is the word that is left out, of lines of at least ``least`` words; -1 stands for the
    whole line. A record that shares the
    key of the one that was asked, but not the line, gives nothing.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in T.pieces(batch.column(1)):
                s = _Sums(p)
                out = []
                for r in range(len(p)):
                    for asked in batch.column(2)[p.first + r].as_py():
                        no = asked["no"]
                        if no >= s.lines[r + 1] - s.lines[r]:
                            continue
                        a, b = int(s.first[s.lines[r] + no]), int(s.last[s.lines[r] + no])
                        n = b - a
                        at = np.arange(a, b if n >= least else a)
                        whole = s.run(np.array([a]), np.array([b]))
                        if _named(whole, n)[0] != asked["line"]:
                            continue
                        # words before the gap, and those behind it moved up by one
                        less = s.run(np.full(len(at), a), at) + (s.sums[b] - s.sums[at + 1]) * s.back[a] * _STEP
                        name = np.concatenate([_named(less, n - 1), _named(whole, n)])
                        size = len(name)
                        line = np.full(size, _named(whole, n)[0])
                        out.append((name, np.append(at - a, -1), line, np.full(size, p.first + r), np.full(size, no)))
                if out:
                    name, at, line, row, no = (np.concatenate(x) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(name), pa.array(at.astype(np.int32)), pa.array(line),
                            batch.column(0).take(pa.array(row)), pa.array(no.astype(np.int32)),
                        ],
                        ["variant", "at", "line", "key", "no"],
                    )

    return rows.mapInArrow(work, "variant bigint, at int, line bigint, key bigint, no int")


def _place(key: str, no: str) -> Column:
    """Order of lines as one number: record, then line."""
    return (F.col(key).cast("decimal(20,0)") * F.lit(_LINES).cast("decimal(11,0)") + F.col(no)).cast("decimal(38,0)")


def drop_repeated_lines(
    records: DataFrame, key: str = "request_id", text: str = "error_message", min_words: int = 8, also: Sequence[str] = (),
    exact_words: int | None = None,
) -> DataFrame:
    """The messages of log records without lines that an earlier record, or the record itself, already has.

    ``records`` has ``key``, a whole number that orders the records (a ``request_id`` or a
    sequence number), and ``text`` (a free text such as ``error_message``). A line is cut at
    \\n; its words are what blanks part, A-Z lower-cased. A line is dropped if any earlier line
    has the same words but for at most one that is changed, added or left out. The one word is
    forgiven where the longer line has at least ``min_words`` words (both, if it is changed);
    lines of at least ``exact_words`` words (``min_words`` if not given; 1 takes every line with
    a word) go if an earlier one is equal. Shorter lines always stay, and do not count as
    earlier ones. Returns ``key,
    n_lines, n_dropped, text``: the kept lines in their order, and behind them the columns
    named in ``also``, as they are.

    Deletion neighbourhood: each line gives hashed variants with one word left out, and itself.
    Lines with an equal variant are one edit apart exactly if the gaps are at the same place
    (a changed word) or only one of them has a gap (an added word); this is the check of the
    distance. Only the earliest line of each variant is looked at, never pairs. Variants are
    made only for lines whose first or last half another line shares, which one edit cannot
    destroy in both.

    Null and empty texts have one empty line, that stays. A null key sorts first. Rows of equal
    key are at the same place: none of their lines is earlier than another's on the same line
    number. Only two columns are read, so other names cannot clash. An empty table gives an
    empty result.
    """
    first_key = -(1 << 63)
    rows = records.select(
        F.coalesce(F.col(key).cast("long"), F.lit(first_key)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.struct(F.lit(0), *also).alias("also"),
    ).select("key", F.xxhash64("text").alias("seen"), "text", "also")
    spark, place = records.sparkSession, scratch_path(records.sparkSession, "lines")
    _scan(rows.drop("also"), max(1, min_words if exact_words is None else exact_words), min_words).write.parquet(place)
    lines = spark.read.parquet(place)

    # Every line once; ends belong to the line, so all its occurrences have the same ones.
    ends = [f"end{i}" for i in range(4)]
    places = lines.select("line", _place("key", "no").alias("place"), *[F.get("ends", F.lit(i)).alias(e) for i, e in enumerate(ends)])
    places.groupBy("line").agg(
        F.min("place").alias("place"), F.max("place").alias("final"), *[F.max(e).alias(e) for e in ends]
    ).write.parquet(f"{place}-distinct")
    distinct = spark.read.parquet(f"{place}-distinct")
    by_end = distinct.select("line", "place", F.explode(F.array_compact(F.array(*ends))).alias("end"))
    shared = by_end.groupBy("end").agg(F.min("line").alias("x"), F.max("line").alias("y")).where("x <> y").select("end")
    firsts = by_end.join(shared, "end", "left_semi").select("line", "place").distinct()
    no = F.pmod("place", F.lit(_LINES).cast("decimal(11,0)"))
    firsts = firsts.select("line", no.cast("int").alias("no"), ((F.col("place") - no) / _LINES).cast("bigint").alias("key"))
    asked = firsts.groupBy("key").agg(F.collect_list(F.struct("no", "line")).alias("asked"))
    _variants(rows.select("key", "text").join(asked, "key"), min_words).write.parquet(f"{place}-variants")
    variants = spark.read.parquet(f"{place}-variants").select("variant", "at", "line", _place("key", "no").alias("place"))

    gaps = variants.groupBy("variant", "at").agg(F.min("place").alias("m"), F.max("place").alias("final"))
    heads = gaps.groupBy("variant").agg(
        F.min(F.when(F.col("at") < 0, F.col("m"))).alias("whole"), F.min(F.when(F.col("at") >= 0, F.col("m"))).alias("gap")
    )
    changed = variants.join(gaps.where("m <> final and at >= 0").select("variant", "at", "m"), ["variant", "at"])
    added = variants.join(heads.where("whole is not null and gap is not null"), "variant")
    earlier = F.when(F.col("at") < 0, F.col("gap")).otherwise(F.col("whole"))
    bad = changed.where("m < place").select("line").unionAll(added.where(earlier < F.col("place")).select("line")).distinct()
    bad = checkpointed(bad)
    discard(spark, f"{place}-variants")

    # Of a near line every occurrence goes, of another repeated one all but the first place.
    verdict = distinct.drop(*ends).join(bad.withColumn("near", F.lit(True)), "line", "left").where("near or place <> final").select(
        "line", F.when(F.col("near"), None).otherwise(F.col("place")).alias("keep")
    )
    gone = (
        lines.select("line", "key", "seen", "no", _place("key", "no").alias("place")).join(verdict, "line")
        .where("keep is null or place > keep").groupBy("key", "seen").agg(F.collect_set("no").alias("gone"))
    )
    split = F.split("text", "\n", -1)
    kept = F.filter(F.col("lines"), lambda _, i: ~F.array_contains(F.col("gone"), i))
    result = rows.join(gone, ["key", "seen"], "left").withColumn("lines", split)
    return result.select(
        F.when(F.col("key") != first_key, F.col("key")).alias(key),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        *[F.col("also")[name].alias(name) for name in also],
    )
