"""Spelling variants among the words of log messages, grouped under the common spelling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm import texts as T
from sievekit.session import discard, scratch_path

#: Letters of a word, A-Z being lower-cased.
LETTERS = r"[A-Za-zÀ-ÿ]"

#: An edit is in one of so many parts of a word; the letters of the others must be equal.
PARTS = 4

#: Longer words are looked up by number when they meet, instead of being carried along.
INLINE = 64

_U = np.uint64


def count_words(
    records: DataFrame, key: str = "request_id", text: str = "error_message", min_letters: int = 7, min_count: int = 2,
    slip: int | None = None,
) -> DataFrame:
    """(word, n): the words of the messages of all records, and how often they come.

    A word is a whole run of the letters A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased; words of
    fewer than ``min_letters`` letters or ``min_count`` occurrences are left out. ``slip`` puts in typing
    errors to test and measure with: where it divides the unsigned crc32 h of ``<key>:<word>`` in
    UTF-8, the letter at h modulo the word's length is left out (one word in ``slip``).

    Null and empty messages have no words; a null key reads as empty. Repeated records count as
    often as they come. Runs of any length are words. Words are counted before they are
    shuffled, so that a very common one is no hot spot.
    """
    # A shorter run cannot become long enough.
    runs = F.regexp_extract_all(F.col(text), F.lit(f"({LETTERS}{{{min_letters},}})"), F.lit(1))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = records.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(runs).alias("run")).select(
        "key", F.translate("run", upper, upper.lower()).alias("run")
    )
    word = F.col("run")
    if slip:
        words = words.withColumn("h", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.char_length("run")).cast("int")
        less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
        word = F.when(F.col("h") % slip == 0, less).otherwise(word)
    words = words.select(word.alias("word")).where(F.char_length("word") >= min_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


class _Reduced:
    """Words of a batch as one row of letters, reduced to few symbols, with running hashes."""

    def __init__(self, words: list[str], symbols: int):
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(_U)
        self.of = np.repeat(np.arange(len(words)), self.size)  # the word of a letter
        self.at = np.arange(len(letters)) - self.start[self.of]  # its place in the word
        power = T.FORWARD.upto(int(self.size.max(initial=0)) + 2)
        self.power, self.back = power, T.BACK.upto(len(power))
        self.symbol = T.mix(letters) % _U(symbols) + _U(1)
        self.reduced, self.exact = self._sums(self.symbol), self._sums(T.mix(letters + _U(1)))

    def _sums(self, values: np.ndarray) -> np.ndarray:
        """Running hash before each letter, of the whole row; differences belong to a word."""
        out = np.zeros(len(values) + 1, _U)
        np.cumsum(values * self.power[self.at], out=out[1:])
        return out

    def head(self, word: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The word's first n letters, as they are."""
        a = self.start[word]
        return self.exact[a + n] - self.exact[a]

    def tail(self, word: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The word's last n letters, as they are."""
        b = self.start[word + 1]
        return (self.exact[b] - self.exact[b - n]) * self.back[self.size[word] - n]

    def key(self, word: np.ndarray, reduced: np.ndarray, size: np.ndarray, part: np.ndarray) -> np.ndarray:
        """A reduced word of ``size`` symbols, and the letters outside of the part of it that an edit is in."""
        a, b = part * size // PARTS, (part + 1) * size // PARTS
        tag = size.astype(_U) * _U(PARTS) + part.astype(_U)
        kept = T.mix(self.head(word, a) + tag) + self.tail(word, size - b)
        return T.mix(T.mix(reduced + tag) + kept).view(np.int64)


def _part(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The part of a word of ``size`` letters that the place ``at`` is in; the last one, if behind them."""
    return ((np.minimum(at, size - 1) + 1) * PARTS - 1) // size


def _own(r: _Reduced) -> tuple[np.ndarray, np.ndarray]:
    """(word, key): each reduced word with any of its parts left open."""
    word = np.repeat(np.arange(len(r.size)), PARTS)
    whole = r.reduced[r.start[word + 1]] - r.reduced[r.start[word]]
    return word, r.key(word, whole, r.size[word], np.tile(np.arange(PARTS), len(r.size)))


def _neighbours(r: _Reduced, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, key): every reduced word that one edit makes, with the letters outside of the part it is in.

    Of edits that make the same one in the same part, there is one.
    """
    out = [_own(r)]  # a letter that becomes another one of its symbol
    i = np.arange(len(r.of))
    word, at, size = r.of, r.at, r.size[r.of]
    a, b = r.start[word], r.start[word + 1]
    before, after = r.reduced[i] - r.reduced[a], r.reduced[b] - r.reduced[i + 1]
    next_symbol = np.where(i + 1 == b, _U(0), r.symbol[np.minimum(i + 1, len(i) - 1)])
    less, more = np.maximum(size - 1, 1), size + 1
    here = _part(at, less)
    keep = (size > 1) & ((next_symbol != r.symbol) | (_part(at + 1, less) != here))
    out.append((word[keep], r.key(word[keep], (before + after * r.back[1])[keep], less[keep], here[keep])))
    same, here, there = _part(at, size), _part(at, more), _part(at + 1, more)
    moved = (r.symbol * r.power[at] + after) * r.power[1]
    for s in range(1, symbols + 1):
        with_s = before + _U(s) * r.power[at]
        keep = r.symbol != _U(s)
        out.append((word[keep], r.key(word[keep], (with_s + after)[keep], size[keep], same[keep])))
        keep |= here != there
        out.append((word[keep], r.key(word[keep], (with_s + moved)[keep], more[keep], here[keep])))
        w = np.flatnonzero(r.size > 0)  # behind the last letter
        whole = r.reduced[r.start[w + 1]] - r.reduced[r.start[w]]
        out.append((w, r.key(w, whole + _U(s) * r.power[r.size[w]], r.size[w] + 1, _part(r.size[w], r.size[w] + 1))))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _keyed(words: DataFrame, symbols: int, full: bool) -> DataFrame:
    """(key, word, word_id) for ``words(word_id, word)``: of their own reduced form, or of all near ones.

    ``word_id`` stands in for words that are not carried along, else it is null.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _runs(batch.column(1)):
                some = batch.column(1)[a:b]
                with np.errstate(over="ignore"):
                    r = _Reduced(some.to_pylist(), symbols)
                    row, key = _neighbours(r, symbols) if full else _own(r)
                short = pa.array(r.size <= INLINE)
                text, number = pc.if_else(short, some, None), pc.if_else(short, None, batch.column(0)[a:b])
                for i in range(0, len(row), 1 << 16):
                    at = pa.array(row[i : i + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array(key[i : i + (1 << 16)]), text.take(at), number.take(at)], ["key", "word", "word_id"])

    return words.select("word_id", "word").mapInArrow(work, "key bigint, word string, word_id bigint")


def _runs(column: pa.Array, limit: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` letters."""
    total = np.cumsum([len(w) for w in column.to_pylist()])
    a = 0
    while a < len(column):
        done = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, done + limit, "right")))
        yield a, b
        a = b


def group_spellings(words: DataFrame, symbols: int = 2, ratio: int = 10) -> DataFrame:
    """The common spelling of each word of a counted vocabulary.

    ``words`` has ``word``, each once, and ``n``, its count in the messages (``count_words``). Two words
    are near if one letter put in, left out or replaced makes one of the other. A word's ``form`` is its
    near word of the largest count (of equal ones, the first in code-point order), if that is at
    least ``ratio`` times its own; ``root`` is where the forms end that start at the word. Returns
    ``word, form, root, n, n_near, form_n``, a row per word; ``form`` and ``form_n`` are null where
    there is none.

    Reduced alphabet: letters are hashed to ``symbols`` symbols, and each word makes the full one-edit
    neighbourhood of its reduced form, which for few symbols is small. Neighbourhoods meet the reduced
    vocabulary by equal keys; a key also names the letters outside of the quarter of the word that the
    edit is in, so that words which merely look alike when reduced do not meet. Words that meet are
    compared letter by letter. The result does not depend on ``symbols``. Counts grow along the
    forms, by ``ratio`` each time, so roots are found in a few rounds of joining forms with forms.

    Words of any length are handled: a row holds a long word's number only, and the words come back
    where they meet. Rows with a null or empty word, or without a positive count, are left out. Of
    repeated words the counts are added. Further columns are not read. An empty vocabulary gives an empty result.
    """
    if ratio < 2:
        raise ValueError("forms must be commoner than their variants")
    spark, place = words.sparkSession, scratch_path(words.sparkSession, "spelling")
    known = words.where("word <> '' and n > 0").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    known.select(F.xxhash64("word").alias("word_id"), "word", "n").write.parquet(f"{place}/words")
    known = spark.read.schema("word_id bigint, word string, n bigint").parquet(f"{place}/words")

    near = _keyed(known, symbols, full=False).withColumnsRenamed({"word": "near", "word_id": "near_id"})
    met = _keyed(known, symbols, full=True).join(near, "key")
    met = met.where(F.coalesce(F.levenshtein("word", "near", 1) == 1, F.lit(True)))
    numbers = [F.coalesce(f"{w}_id", F.xxhash64(w)).alias(f"{w}_id") for w in ("word", "near")]
    met = met.select(*numbers).where("word_id <> near_id").distinct()
    near = known.select(F.col("word_id").alias("near_id"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = met.join(known, "word_id").join(near, "near_id").where(F.levenshtein("word", "near", 1) == 1)
    best = pairs.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    )
    form_n = -F.col("best.less")
    good = form_n >= F.col("n") * ratio
    found = known.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(good, F.col("best.form")).alias("form"), F.when(good, form_n).alias("form_n"),
    )
    found.write.parquet(f"{place}/found")
    found = spark.read.schema(found.schema).parquet(f"{place}/found")

    # Each round doubles the steps taken; a step takes the count up ``ratio`` times.
    roots, step, moved = found.where("form is not null").select("word", F.col("form").alias("root")), 0, True
    while moved:
        roots.write.parquet(f"{place}/roots{step}")
        roots = spark.read.schema(roots.schema).parquet(f"{place}/roots{step}")
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = not roots.join(on, "root", "left_semi").isEmpty()
        if moved:
            roots, step = roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), step + 1
    for old in range(step):
        discard(spark, f"{place}/roots{old}")
    discard(spark, f"{place}/words")
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
