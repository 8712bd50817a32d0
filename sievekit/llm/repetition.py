"""Quality rules for the messages of log records, with a suffix array for repetition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm import texts as T

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

#: Words of a window whose second occurrence counts in ``n_repeat_words``.
WINDOW = 5


def suffix_array(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a word sequence in order, and the common prefix of each with the one before it.

    Prefix doubling: ranks by the first 1, 2, 4 ... words until all differ. The ranks of all
    steps give the common prefixes without reading the words again.
    """
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    steps, width = [rank], 1
    while rank.max(initial=0) + 1 < n and width < n:
        behind = np.zeros(n, np.int64)
        behind[: n - width] = rank[width:] + 1
        rank = np.unique(rank * (n + 1) + behind, return_inverse=True)[1].astype(np.int64)
        steps.append(rank)
        width *= 2
    order = np.argsort(rank, kind="stable")
    shared = np.zeros(n, np.int64)
    a, b, at = order[1:], order[:-1], np.zeros(max(n - 1, 0), np.int64)
    for k in reversed(range(len(steps))):
        step = np.append(steps[k], -1)
        i, j = a + at, b + at
        fits = np.maximum(i, j) + (1 << k) <= n
        at += np.where(fits & (step[np.minimum(i, n)] == step[np.minimum(j, n)]), 1 << k, 0)
    if n:
        shared[1:] = at
    return order, shared


def repeats(words: np.ndarray, least: int) -> tuple[int, int]:
    """Words inside repeated runs of at least ``least`` words, and the longest run."""
    if len(words) < least + 1:
        return 0, 0
    order, shared = suffix_array(words)
    longest = np.zeros(len(words), np.int64)  # of the repeats that start at a word
    np.maximum.at(longest, order, shared)
    np.maximum.at(longest, order[:-1], shared[1:])
    longest[longest < least] = 0
    return _covered(np.flatnonzero(longest), longest[longest > 0], len(words)), int(longest.max())


def _covered(start: np.ndarray, length: np.ndarray | int, n: int) -> int:
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, start, 1)
    np.add.at(edges, start + length, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:n]))


def quality_rules(
    records: DataFrame,
    key: str = "request_id",
    text: str = "error_message",
    min_words: int = 10,
    max_repeat_percent: int = 20,
    min_run: int = 10,
    max_run_percent: int = 15,
    max_run: int = 200,
) -> DataFrame:
    """Counts and a verdict for the message of every log record.

    ``records`` has a row per log record with ``key`` (its ``request_id``) and ``text`` (a
    free text such as ``error_message``, where traces repeat themselves). Returns ``key,
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, run_words,
    longest_run, kept``.

    A message fails the base rules with fewer than ``min_words`` words, or if more than
    ``max_repeat_percent`` of its words lie in 5-word windows that occur twice. Of the others,
    the suffix array of the words finds the maximal repeated runs of at least ``min_run``
    words: the union of their spans (``run_words``) may hold up to ``max_run_percent`` of the
    words and the longest may have up to ``max_run`` words.

    Null and empty texts have no words and fail. Every row is judged by itself: repeated rows
    and null keys stay. Only two columns are read, so other names cannot clash. An empty table
    gives an empty result. A text must fit into a task; memory is about 50 bytes per byte of
    the longest one.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((7, batch.num_rows), np.int64)
            for p in T.pieces(batch.column(1)):
                start, end, first = p.words()
                hashes = T.ranges(p.buf, start, end, fold=False)
                chars = np.concatenate([[0], np.cumsum(~T.BLANKS[p.buf] & (p.buf & 0xC0 != 0x80))])
                symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[p.buf])])
                l_start, l_end, l_first = p.lines()
                worded = np.searchsorted(start, l_end) > np.searchsorted(start, l_start)
                lines = T.ranges(p.buf, l_start, l_end, fold=False)
                for r in range(len(p)):
                    words = hashes[first[r] : first[r + 1]]
                    own = lines[l_first[r] : l_first[r + 1]][worded[l_first[r] : l_first[r + 1]]]
                    again, run, longest = 0, 0, 0
                    seen, where, times = np.unique(T.windows(words, WINDOW), return_inverse=True, return_counts=True)
                    if len(seen) < len(where):
                        again = _covered(np.flatnonzero(times[where] > 1), WINDOW, len(words))
                        if min_run < WINDOW or again > min_run:  # a longer repeat is made of repeated windows
                            run, longest = repeats(words, min_run)
                    elif min_run < WINDOW:
                        run, longest = repeats(words, min_run)
                    out[:, p.first + r] = (
                        len(words), chars[p.offsets[r + 1]] - chars[p.offsets[r]],
                        symbols[p.offsets[r + 1]] - symbols[p.offsets[r]],
                        len(own) - len(np.unique(own)), again, run, longest,
                    )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, out)],
                ["key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "run_words", "longest_run"],
            )

    kind = records.schema[key].dataType.simpleString()
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words run_words longest_run".split()
    found = records.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        judged, f"key {kind}, " + ", ".join(f"{x} bigint" for x in names)
    )
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    fine = (F.col("run_words") * 100 <= F.col("n_words") * max_run_percent) & (F.col("longest_run") <= max_run)
    return found.select(
        F.col("key").alias(key), *names[:5], failed.alias("base_failed"), "run_words", "longest_run", (~failed & fine).alias("kept")
    )
