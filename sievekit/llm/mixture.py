"""Mix records of several sources to target weights, as shards of equal blocks of words."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievekit.session import checkpointed

_WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Words to take of each source; what is above ``most`` times its size goes to the others by weight."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    found = [0.0] * len(sizes)
    left, active = share * sum(n for _, n in sizes), list(range(len(sizes)))
    while active:
        scale = left / sum(weight[i] for i in active)
        full = [i for i in active if scale * weight[i] > most * sizes[i][1]]
        for i in full or active:
            found[i] = most * sizes[i][1] if full else scale * weight[i]
            left -= found[i] if full else 0.0
        active = [i for i in active if i not in full] if full else []
    return found


def _key(seed: int, *parts: int) -> int:
    return int(np.random.SeedSequence([seed, *parts]).generate_state(1, np.uint64)[0])


class Permutation:
    """A pseudorandom permutation of 0..n-1 that needs no table: a Feistel network, walked until in range."""

    def __init__(self, n: int, key: int, rounds: int = 4):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = np.random.SeedSequence(key).generate_state(rounds, np.uint64)

    def _round(self, right: np.ndarray, key: np.uint64) -> np.ndarray:
        h = (right + key) * np.uint64(0x9E3779B97F4A7C15)
        return (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33) & self.mask

    def _step(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ self._round(left, key), left
            else:
                left, right = right, left ^ self._round(right, key)
        return left << np.uint64(self.half) | right

    def __call__(self, index: np.ndarray, back: bool = False) -> np.ndarray:
        x = self._step(np.asarray(index, np.uint64), back)
        while (out := x >= self.n).any():
            x[out] = self._step(x[out], back)
        return x.astype(np.int64)


@dataclass
class Source:
    """Plan of one source: ``slots`` draws over ``blocks`` blocks, the last of ``rest`` words."""

    number: int
    name: str | None
    size: int
    target: float
    blocks: int
    slots: int
    rest: int

    def drawn(self, index: np.ndarray, seed: int) -> np.ndarray:
        """Blocks of the given draws: each pass over the source is a permutation of its own."""
        out = np.zeros(len(index), np.int64)
        for turn in np.unique(index // self.blocks) if len(index) else ():
            here = index // self.blocks == turn
            out[here] = Permutation(self.blocks, _key(seed, self.number, int(turn)))(index[here] % self.blocks)
        return out


def plan(sizes: Sequence[tuple[str | None, int]], wanted: Sequence[float], block: int, seed: int) -> list[Source]:
    """How often to draw from each source, so that the words drawn are its target, rounded."""
    found = []
    for number, ((name, size), target) in enumerate(zip(sizes, wanted)):
        blocks, goal = -(-size // block), round(target)
        short = blocks * block - size  # words that the last block lacks
        slots = rest = 0
        if goal:
            turns = range(-(-goal // size) + 1)
            last = [t * blocks + int(Permutation(blocks, _key(seed, number, t))(np.array([blocks - 1]), back=True)[0]) for t in turns]

            def words(n: int) -> int:
                return n * block - short * sum(at < n for at in last)

            slots = goal // block
            while words(slots) < goal:
                slots += 1
            rest = goal - words(slots - 1)
        found.append(Source(number, name, size, target, blocks, slots, rest))
    return found


def _drawn_of(good: int, other: int, take: int, u: float) -> int:
    """How many of ``take`` draws without return are among ``good``: the hypergeometric law by inversion.

    Chances come from their ratios, outward from the likeliest value. What lies more than 12 standard
    deviations and 40 from it is below the precision of a double.
    """
    low, high = max(0, take - other), min(good, take)
    total = good + other
    mode = min(max((take + 1) * (good + 1) // (total + 2), low), high)
    spread = (take * (good / total) * (other / total) * ((total - take) / max(total - 1, 1))) ** 0.5
    reach = int(12 * spread) + 40
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    rise = np.log(good - up) + np.log(take - up) - np.log(up + 1) - np.log(other - take + up + 1)
    fall = np.log(down) + np.log(other - take + down) - np.log(good - down + 1) - np.log(take - down + 1)
    chance = np.exp(np.concatenate([np.cumsum(fall)[::-1], [0.0], np.cumsum(rise)]))
    below = np.cumsum(chance)
    return mode - len(down) + int(np.searchsorted(below, u * below[-1], side="right"))


@lru_cache(maxsize=1 << 14)
def _split(counts: tuple[int, ...], take: int, seed: tuple[int, ...]) -> tuple[int, ...]:
    """A multinomial draw of ``take`` slots, given that all draws together make ``counts``.

    One law for all sizes. Shards of a task share most halves above them, hence the cache.
    """
    rng = np.random.default_rng(seed)
    out, left = [], sum(counts)
    for k in counts:
        x = _drawn_of(k, left - k, take, rng.random()) if k and take else 0
        out.append(x)
        take, left = take - x, left - k
    return tuple(out)


def shard_counts(counts: np.ndarray, shard: int, shards: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First draw and number of draws of every source in one shard.

    All draws are halved again and again, each half by a seeded multinomial draw, so any shard
    is found alone, without the ones before it, and the totals are met.
    """
    low, high, start = 0, shards, np.zeros_like(counts)
    while high - low > 1:
        middle = (low + high) // 2
        drawn = _split(tuple(counts.tolist()), (middle - low) * size, (seed, low, high))
        left = np.array(drawn, np.int64)
        if shard < middle:
            counts, high = left, middle
        else:
            start, counts, low = start + left, counts - left, middle
    return start, counts


def _offsets(sums: DataFrame, by: list[str], order: str) -> DataFrame:
    below = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, order, F.coalesce(F.sum("n").over(below), F.lit(0)).alias("base"))


def mixing_plan(
    records: DataFrame,
    key: str = "request_id",
    text: str = "error_message",
    source: str = "route",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block: int = 64,
    shard_slots: int = 4096,
    seed: int = 11,
    with_text: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """The laid-out records and the drawn slots of a mix; see ``mix_sources``.

    Records: ``key, source, text, number, size, source_size, target, start`` (``start``: place
    of the first word among the words of its source). Slots: ``shard, place, number, block,
    take``; ``take`` words of that block of that source, all but for the last slot of a source.
    Without ``with_text`` the texts are read once, for sizes and places, and left out of the records.
    """
    spark = records.sparkSession
    value = F.coalesce(F.col(text), F.lit(""))
    rows = records.select(
        F.col(key).alias("key"), F.col(source).cast("string").alias("source"), value.alias("text"),
        F.regexp_count(value, F.lit(_WORD)).cast("long").alias("size"),
    ).withColumn("mark", F.xxhash64("key", "text"))
    if not with_text:
        rows = checkpointed(rows.drop("text"))
    totals = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    sizes = sorted(((r["source"], r["n"]) for r in totals), key=lambda x: (x[0] is None, x[0] or ""))
    sources = plan(sizes, targets(sizes, weights, share, most), block, seed)

    names = spark.createDataFrame(
        [(s.name, s.number, s.size, float(s.target)) for s in sources], "name string, number int, source_size bigint, target double"
    )
    # Fine buckets, so that a source with a third of the rows spreads; their offsets in two steps.
    buckets = max(1, sum(r["rows"] for r in totals) // 128)
    rows = rows.join(names, F.col("source").eqNullSafe(F.col("name"))).withColumn("bucket", F.pmod("mark", F.lit(buckets)))
    rows = rows.withColumn("range", F.floor(F.col("bucket") / 4096))
    heights = _offsets(rows.groupBy("number", "range", "bucket").agg(F.sum("size").alias("n")), ["number", "range"], "bucket")
    ranges = _offsets(rows.groupBy("number", "range").agg(F.sum("size").alias("n")), ["number"], "range")
    heights = heights.join(ranges.withColumnRenamed("base", "under"), ["number", "range"])
    heights = heights.select("number", "bucket", (F.col("base") + F.col("under")).alias("base"))
    before = Window.partitionBy("number", "bucket").orderBy("mark", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).join(heights, ["number", "bucket"])
    laid = laid.select(
        "key", "source", *(["text"] if with_text else []), "number", "size", "source_size", "target", (F.col("base") + F.col("before")).alias("start")
    )

    counts = np.array([s.slots for s in sources], np.int64)
    shards = -(-int(counts.sum()) // shard_slots)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                start, own = shard_counts(counts, shard, shards, shard_slots, seed)
                parts = []
                for s in sources:
                    if own[s.number]:
                        index = np.arange(start[s.number], start[s.number] + own[s.number])
                        take = np.where(index == s.slots - 1, s.rest, block)
                        parts.append((np.full(len(index), s.number), s.drawn(index, seed), take))
                number, blocks, take = (np.concatenate(x) for x in zip(*parts))
                order = np.random.default_rng([seed, shard]).permutation(len(number))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(number), shard)), pa.array(order.astype(np.int32)), pa.array(number.astype(np.int32)),
                        pa.array(blocks), pa.array(take.astype(np.int32)),
                    ],
                    ["shard", "place", "number", "block", "take"],
                )

    slots = spark.range(shards).mapInArrow(draw, "shard bigint, place int, number int, block bigint, take int")
    return laid, slots


def _cut(laid: DataFrame, block: int) -> DataFrame:
    """A row per record and block that it reaches into, with its words' places in the block."""
    end = F.col("start") + F.col("size")
    spread = laid.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block)))
    )
    return spread.withColumns(
        {
            "low": F.greatest(F.col("start") - F.col("block") * block, F.lit(0)),
            "high": F.least(end - F.col("block") * block, F.lit(block)),
        }
    )


def mix_sources(
    records: DataFrame,
    key: str = "request_id",
    text: str = "error_message",
    source: str = "route",
    block: int = 64,
    **options,
) -> DataFrame:
    """How many words of every record a mix of all sources takes.

    ``records`` has ``key`` (the ``request_id``), ``text`` (a free text such as
    ``error_message``) and ``source`` (where it comes from, such as the ``route``). Returns
    ``key, size, source_size, target, taken``. The sources, in code-point order and null last,
    take the ``weights`` in turn; all targets together are ``share`` times all words; a target
    above ``most`` times the source's size stops there and the excess goes to the others by
    weight. Further options: see ``mixing_plan``.

    The words of a source, records in a pseudorandom but fixed order, are packed into blocks of
    ``block`` words (the last one may be short). Output shards of ``shard_slots`` slots draw how
    many slots each source fills from a multinomial law, given that the totals come out; a
    slot's place among its source's draws is mapped through a pseudorandom permutation of the
    source's blocks, one per pass. Joining blocks by index gives the words. No block is drawn
    more often than a source's passes, so no record exceeds ``most`` times its size, rounded up
    to whole passes. The same table and seed give the same mix.

    Null and empty texts have size 0 and are taken 0 times. Rows stay as they are, repeated ones
    and null keys too. Only the named columns are read, so other names cannot clash. An empty
    table gives an empty result. The driver sees one row per source.
    """
    laid, slots = mixing_plan(records, key, text, source, block=block, with_text=False, **options)
    uses = slots.groupBy("number", "block").agg(
        F.count_if(F.col("take") == block).alias("whole"), F.max(F.when(F.col("take") < block, F.col("take"))).alias("part")
    )
    part = F.greatest(F.least("high", F.coalesce("part", F.lit(0))) - F.col("low"), F.lit(0))
    words = F.col("whole") * (F.col("high") - F.col("low")) + part
    cut = _cut(laid.select("number", "start", "size"), block)
    # The planner takes the drawn slots for a few rows; they grow with the input.
    taken = cut.join(uses.hint("merge"), ["number", "block"]).groupBy("number", "start", "size").agg(F.sum(words).cast("long").alias("taken"))
    named = laid.join(taken, ["number", "start", "size"], "left")
    return named.select(
        F.col("key").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def mixed_blocks(records: DataFrame, text: str = "error_message", block: int = 64, **options) -> DataFrame:
    """The mix itself: ``shard, place, words``, the words of one slot in order; arguments as ``mix_sources``."""
    laid, slots = mixing_plan(records, text=text, block=block, **options)
    cut = _cut(laid, block)
    own = F.slice(F.regexp_extract_all("text", F.lit(_WORD), 0), (F.col("block") * block + F.col("low") - F.col("start") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int"))
    parts = cut.groupBy("number", "block").agg(F.array_sort(F.collect_list(F.struct("low", own.alias("words")))).alias("parts"))
    words = F.slice(F.flatten(F.transform("parts", lambda x: x["words"])), F.lit(1), F.col("take"))
    return slots.hint("merge").join(parts, ["number", "block"]).select("shard", "place", words.alias("words"))
