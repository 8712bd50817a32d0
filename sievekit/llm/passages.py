"""Which records quote passages of a benchmark: Wu-Manber search for many word sequences at once."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm import texts as T
from sievekit.session import checkpointed


def _pairs(hashes: np.ndarray, width: int) -> np.ndarray:
    """At each word the hash of the block that ends there; what has no block is 0."""
    if width == 1:
        return hashes
    out = np.zeros(len(hashes), np.uint64)
    out[1:] = T.mix(hashes[:-1] * np.uint64(3) + hashes[1:])
    return out


class Table:
    """Wu-Manber tables for sequences of one length, over words instead of characters.

    ``shift``: how far a window may move when it ends with a block (two words); a block that
    no sequence holds is not listed and moves it ``length - block + 1`` words. ``buckets``: the
    sequences that end with a block whose shift is 0, as texts, each with its items.
    """

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))

    def add(self, blocks: list[int], sequence: bytes, item: int) -> None:
        for at in range(self.block - 1, self.length):
            left = self.length - 1 - at
            self.shift[blocks[at]] = min(left, self.shift.get(blocks[at], self.far))
        owners = self.buckets[blocks[self.length - 1]][sequence]
        if not owners or owners[-1] != item:
            owners.append(item)

    def search(self, blocks: list[int], text) -> Iterator[tuple[int, list[int]]]:
        """(first word, items) of every occurrence; ``text(i, j)`` are the words i to j as bytes."""
        at, n, shift, far, length = self.length - 1, len(blocks), self.shift.get, self.far, self.length
        while at < n:
            step = shift(blocks[at], far)
            if step:
                at += step
                continue
            bucket = self.buckets.get(blocks[at])
            owners = bucket.get(text(at - length + 1, at + 1)) if bucket else None
            if owners:
                yield at - length + 1, owners
            at += 1


def _words(piece: T.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    start, end, first = piece.words(T.NOT_ALNUM)
    return start, end, first, T.ranges(piece.buf, start, end, fold=True)


def _reader(buf: np.ndarray, start: np.ndarray, end: np.ndarray):
    raw = buf.tobytes()

    def text(i: int, j: int) -> bytes:
        return b" ".join([raw[a:b] for a, b in zip(start[i:j].tolist(), end[i:j].tolist())]).lower()

    return text  # bytes.lower() changes A-Z only


def tables(texts: Iterable[str | None], window: int) -> dict[int, Table]:
    """By length; item numbers are places in ``texts``."""
    found: dict[int, Table] = {}
    for p in T.pieces(pa.array(list(texts), pa.string())):
        start, end, first, hashes = _words(p)
        text = _reader(p.buf, start, end)
        for r in range(len(p)):
            a, b = int(first[r]), int(first[r + 1])
            length = min(window, b - a)
            if length:
                table = found.setdefault(length, Table(length))
                blocks = _pairs(hashes[a:b], table.block).tolist()
                for i in range(b - a - length + 1):
                    table.add(blocks[i : i + length], text(a + i, a + i + length), p.first + r)
    return found


def _blocks(passages: DataFrame, size: int) -> Iterator[tuple[list, list[str | None]]]:
    """The passages in blocks of about ``size`` characters."""
    ids: list = []
    texts: list[str | None] = []
    held = 0
    for item, text in passages.toLocalIterator():
        ids.append(item)
        texts.append(text)
        held += len(text or "")
        if held >= size:
            yield ids, texts
            ids, texts, held = [], [], 0
    yield ids, texts


def find_passages(
    records: DataFrame,
    passages: DataFrame,
    key: str = "request_id",
    text: str = "error_message",
    item: str = "parameter",
    passage: str = "limitation",
    window: int = 13,
    min_percent: int = 5,
    block_chars: int = 1 << 21,
) -> DataFrame:
    """Which log records quote passages of a fixed set of texts, and how much of each is quoted.

    ``records`` has ``key`` (the ``request_id``) and ``text`` (a free text such as
    ``error_message``); ``passages`` has ``item`` (the ``parameter`` of a standard) and
    ``passage`` (its ``limitation`` text). Words are runs of letters, digits and non-ASCII
    characters, A-Z lower-cased. Every run of ``window`` words of a passage is searched; a
    shorter passage is one run. Returns ``key, n_words, n_hit, n_items, items, contaminated``:
    words inside occurrences, the items (as sorted strings) that have any, and whether at least
    ``min_percent`` percent of the words, and one, are hit.

    The passages are the search set: they are read through the driver in blocks of about
    ``block_chars`` characters, and each block is sent to the tasks as search tables. One
    block is searched in one pass without a shuffle; with more, what is known so far is
    checkpointed between passes.

    Null and empty texts have no words and are clean; null and empty passages have no runs. A
    passage whose item is null hits words but is not listed; passages that share an item count
    as one. Rows are handled one by one, so repeated rows and null keys stay. Only the named
    columns are read, so other names cannot clash. Empty tables give empty or clean results.
    """
    kind = records.schema[key].dataType.simpleString()
    state = records.select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.lit(None).cast("binary").alias("hits"),
        F.lit(None).cast("array<string>").alias("items"),
    )
    spark = records.sparkSession
    blocks = _blocks(passages.select(F.col(item).cast("string"), F.col(passage).cast("string")), block_chars)
    block, found = next(blocks), None
    while block is not None:
        if found is not None:
            state = checkpointed(found)
        sent, block = spark.sparkContext.broadcast(block), next(blocks, None)

        def searched(batches: Iterator[pa.RecordBatch], sent=sent, more=block is not None) -> Iterator[pa.RecordBatch]:
            ids, texts = sent.value
            ready = tables(texts, window)
            widths = {table.block for table in ready.values()}
            for batch in batches:
                hits, items, words, n_hit = [], [], *np.zeros((2, batch.num_rows), np.int64)
                for p in T.pieces(batch.column(1)):
                    start, end, first, hashes = _words(p)
                    pairs = _pairs(hashes, 2)
                    text_of = _reader(p.buf, start, end)
                    for r in range(len(p)):
                        a, b = int(first[r]), int(first[r + 1])
                        words[p.first + r] = b - a
                        known = batch.column(2)[p.first + r].as_py()
                        hit = np.unpackbits(np.frombuffer(known, np.uint8), count=b - a) if known else np.zeros(b - a, np.uint8)
                        owners: set[int] = set()
                        ends = {width: h[a:b].tolist() for width, h in ((1, hashes), (2, pairs)) if width in widths}
                        for table in ready.values():
                            for at, those in table.search(ends[table.block], lambda i, j, a=a: text_of(a + i, a + j)):
                                hit[at : at + table.length] = 1
                                owners.update(those)
                        n_hit[p.first + r] = hit.sum()
                        hits.append(np.packbits(hit).tobytes() if hit.any() else None)
                        before = batch.column(3)[p.first + r].as_py() or []
                        items.append(sorted({*before, *(ids[i] for i in owners if ids[i] is not None)}))
                left = batch.column(1) if more else pa.nulls(batch.num_rows, pa.string())
                columns = [batch.column(0), left, pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(words), pa.array(n_hit)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "text", "hits", "items", "n_words", "n_hit"])

        found = state.select("key", "text", "hits", "items").mapInArrow(
            searched, f"key {kind}, text string, hits binary, items array<string>, n_words bigint, n_hit bigint"
        )
    result = found.select(
        F.col("key").alias(key),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
    )
    quoted = (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * min_percent)
    return result.withColumn("contaminated", quoted)
