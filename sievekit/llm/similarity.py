"""Records whose messages share most of their word shingles: an exact Jaccard self-join.

The join uses relations between sets twice. **In the index**: the list of a shingle is cut
into blocks of sets that are alike in size and in the shingle's position; blocks that cannot
hold a partner are skipped whole. **In the answers**: every set of a list is first compared
with the list's pivot only; sets found similar to a pivot take over its class, and no pair
inside a class is looked at again. Sets that share at least half with a pivot, their anchor,
are compared with each other by their differences from it only. What is left is decided exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.llm import texts as T
from sievekit.llm.links import components
from sievekit.session import checkpointed, discard, scratch_path, shuffles_end_with_actions

#: At most so many frequent shingles are sent to every task (8 bytes each, with their ranks).
FREQUENT = 1 << 21
#: A shingle in fewer prefixes is never called frequent.
RARE = 8
#: Entries of one index block.
BLOCK = 32
#: Words of 64 bits in a set's parity sketch.
SKETCH = 16


def shingle_sets(piece: T.Piece, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    start, end, first = piece.words()
    hashes = T.ranges(piece.buf, start, end, fold=True)
    every = T.windows(hashes, words)  # also those that reach into the next text, which are left out
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a < words:
            yield T.windows(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)
        else:
            own = np.sort(every[a : b - words + 1])
            yield own[np.append(True, own[1:] != own[:-1])]


def _signature(shingles: np.ndarray) -> int:
    return int(T.digest(shingles).view(np.int64))


def _sketch(shingles: np.ndarray) -> np.ndarray:
    """A bit for every residue of the hashes: is it that of an odd number of shingles?

    The sketches of two sets differ in no more bits than the sets differ in shingles.
    """
    odd = np.bincount((shingles >> np.uint64(32)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _folded(sketch: Column, n: Column) -> Column:
    """The sketch of a set in a block of sets of ``n`` shingles at most, over as many residues as tell such sets apart.

    Halves laid on each other are the sketch over half of the residues, as parities add up.
    """
    for half in (SKETCH // 2, SKETCH // 4):
        laid = F.zip_with(F.slice(sketch, 1, half), F.slice(sketch, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        sketch = F.when(n * 3 <= 2 * 64 * half, laid).otherwise(sketch)
    return sketch


def _narrowed(bits: np.ndarray, width: int) -> np.ndarray:
    while bits.shape[1] > width:
        bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
    return bits


def _prefix(n: int, percent: int) -> int:
    """Any two similar sets share a shingle among so many first ones of each."""
    return n - -(-percent * n // 100) + 1


def _needed(percent: int, n: Column | str, m: Column | str) -> Column:
    """Least common shingles of similar sets of these sizes."""
    return F.ceil((F.col(n) + F.col(m)) * percent / F.lit(100.0 + percent) - 1e-9)


def _shared_prefix(percent: int) -> Column:
    """Least shingles that similar sets (n, m) share within both prefixes."""

    def left(n: str) -> Column:  # what lies behind the prefix
        return F.ceil(F.col(n) * percent / 100.0 - 1e-9) - 1

    return F.greatest(F.lit(1), _needed(percent, "n", "m") - F.greatest(left("n"), left("m")))


def _map(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work(pieces of the text column, batch)`` yields the columns of one output batch."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in work(batch):
                yield pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c, pa.Array) else c for c in columns], names)

    return rows.mapInArrow(run, schema)


def _ragged(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(kind.to_pandas_dtype()), kind))


def _code(shingles: np.ndarray) -> np.ndarray:
    """Half of a shingle's hash; it is enough to say what is frequent."""
    return (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def _nodes(rows: DataFrame, kind: str, words: int, percent: int) -> DataFrame:
    """A row per record: key, n, set signature, sketch, and the codes of the shingles first in plain hash order.

    These are twice as many as a prefix holds, since frequent shingles will leave the prefix
    and others follow.
    """

    def work(batch):
        sizes, sets, sketches, codes = [], [], [], []
        for p in T.pieces(batch.column(1)):
            for s in shingle_sets(p, words):
                sizes.append(len(s))
                sets.append(_signature(s))
                sketches.append(_sketch(s))
                codes.append(_code(s[: 2 * _prefix(len(s), percent)]))
        facts = np.array(sizes, np.int64), np.array(sets, np.int64), _ragged(sketches, pa.int64())
        yield batch.column(0), *facts, _ragged(codes, pa.int32())

    return _map(rows, work, f"key {kind}, n bigint, set bigint, sketch array<bigint>, codes array<int>")


def _frequent(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the shingles that stand first in most sets, and how often: more than ``RARE`` times, ``FREQUENT`` at most.

    They are put last in the order of every set, the most frequent behind all others. Any order
    that all sets share gives the same answers; this one keeps the lists short. Equal shingles are counted before the shuffle, in
    packed rows, one per task and slice of the hash range.
    """
    slices = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def packed(batch):
        codes, counts = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
        slot = codes % slices
        order = np.argsort(slot, kind="stable")
        cuts = np.searchsorted(slot[order], np.arange(slices + 1))
        once, more, times = [], [], []
        for a, b in zip(cuts, cuts[1:]):
            own = order[a:b]
            again = counts[own] > 1
            once.append(codes[own[~again]].tobytes())
            more.append(codes[own[again]].tobytes())
            times.append(counts[own[again]].astype(np.int32).tobytes())
        yield np.arange(slices, dtype=np.int64), *(pa.array(x, pa.binary()) for x in (once, more, times))

    total = nodes.agg(F.sum(F.size("codes"))).first()[0] or 0
    least = max(RARE, total // FREQUENT)
    sliced = _map(nodes.select("codes"), packed, "slot bigint, once binary, more binary, times binary").repartition(slices, "slot")
    often = sliced.mapInArrow(lambda batches: _merged(batches, least), "code int, count bigint").toArrow()
    return often.column(0).to_numpy(), often.column(1).to_numpy()


def _merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    codes, counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
    for batch in batches:
        once, more, times = ([np.frombuffer(x.as_py(), np.int32) for x in batch.column(k)] for k in (1, 2, 3))
        ones = np.ones(sum(map(len, once)), np.int64)
        merged, where = np.unique(np.concatenate([codes, *once, *more]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([counts, ones, *times]), len(merged)).astype(np.int64)
        codes = merged
    keep = counts > least
    yield pa.RecordBatch.from_arrays([pa.array(codes[keep]), pa.array(counts[keep])], ["code", "count"])


def _entries(rows: DataFrame, frequent: tuple[np.ndarray, np.ndarray], words: int, percent: int) -> DataFrame:
    """(token, at, set): the prefix of every distinct set of a batch, frequent shingles last.

    ``at`` is the size of the set, its place in the list's prefix (28 bits) and, in the last 8 bits, how much of
    the prefix frequent shingles leave to others, which few sets or none share.
    """
    codes, counts = frequent
    place = np.argsort(codes)
    ranks = np.empty(len(codes), np.int32)
    ranks[np.lexsort((codes[place], counts[place]))] = np.arange(len(codes))
    sent = rows.sparkSession.sparkContext.broadcast((codes[place], ranks))

    def work(batch):
        (last, rank), done = sent.value, set()
        for p in T.pieces(batch.column(0)):
            tokens, sets, places = [], [], []
            for s in shingle_sets(p, words):
                if not len(s) or (sign := _signature(s)) in done:
                    continue
                done.add(sign)
                lead = len(s)
                if len(last):
                    code = _code(s)
                    at = np.minimum(np.searchsorted(last, code), len(last) - 1)
                    often = last[at] == code
                    lead = int((~often).sum())
                    s = np.concatenate([s[~often], s[often][np.argsort(rank[at[often]], kind="stable")]])
                k = _prefix(len(s), percent)
                tokens.append(s[:k])
                sets.append(np.full(k, sign))
                places.append((np.arange(k) << 8) + (len(s) << 36) + 255 * min(lead, k) // k)
            if tokens:
                yield np.concatenate(tokens).view(np.int64), np.concatenate(places), np.concatenate(sets)

    return _map(rows.select("text"), work, "token bigint, at bigint, set bigint")


def _index(entries: DataFrame, percent: int) -> DataFrame:
    """(token, set, n, pos, block, pivot, m, more): lists of two or more sets, in order of size and place.

    ``more`` is false only where the list is known to have two rows.

    A list is cut where the size leaves the range of its first set. The pivot of a part is the
    set with the fewest shingles that are not frequent, the smallest of such. In a family of near copies
    this is one with few changes, and it does not depend on the shingle; so the lists of the
    family agree on it, and the others differ little from it. A part that goes on in the next
    batch keeps it, unless one comes that has fewer.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None  # the last row so far; (token, rows, first size, pivot) of its list
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy() for i in range(3)])
            if held is not None:
                rows = np.concatenate([held, rows], axis=1)
            rows = rows[:, np.append((np.diff(rows, axis=1) != 0).any(axis=0), True)]  # copies lie side by side
            out, state = _cut(rows[:, :-1], state, percent, int(rows[0, -1]))
            held = rows[:, -1:]
            yield _batch(out)
        if held is not None:
            yield _batch(_cut(held, state, percent, None)[0])

    def _batch(out: np.ndarray) -> pa.RecordBatch:
        names = ["token", "set", "n", "pos", "block", "pivot", "m", "more"]
        return pa.RecordBatch.from_arrays([*map(pa.array, out[:-1]), pa.array(out[-1] > 0)], names)

    spread = entries.repartition("token").sortWithinPartitions("token", "at", "set")
    return spread.mapInArrow(cut, "token bigint, set bigint, n bigint, pos bigint, block bigint, pivot bigint, m bigint, more boolean")


def _cut(rows: np.ndarray, state, percent: int, following: int | None):
    """Number the rows of sorted lists; ``following`` is the token of the next row."""
    token, at, sets = rows
    n, pos, lead = at >> 36, (at >> 8) & 0xFFFFFFF, at & 0xFF
    if not len(token):
        return np.zeros((8, 0), np.int64), state
    same = np.append(token[1:] == token[:-1], following is not None and token[-1] == following)
    before = np.insert(token[1:] == token[:-1], 0, state is not None and state[0] == token[0])
    listed = np.flatnonzero(same | before)  # what is alone in its list has no partner
    more = (before & same) | (before & np.insert(before[:-1], 0, True)) | (same & np.append(same[1:], True))
    block, pivot, size = np.zeros((3, len(token)), np.int64)
    known = state
    starts, best = [], None
    for k, i in enumerate(listed.tolist()):
        if not before[i] or known is None:
            known = (token[i], 0, n[i], None)
            starts.append(k)
        elif n[i] * percent > known[2] * 100:
            known = (token[i], -(-known[1] // BLOCK) * BLOCK, n[i], None)
            starts.append(k)
        elif k == 0:  # the part goes on from the last batch, and so does its pivot
            starts.append(k)
            best = known[3]
        block[i] = known[1] // BLOCK
        known = (known[0], known[1] + 1, *known[2:])
    if len(listed):
        starts = np.array(starts)
        sizes = np.diff(np.append(starts, len(listed)))
        first = listed[np.lexsort((sets[listed], lead[listed], np.repeat(np.arange(len(starts)), sizes)))[starts]]
        chosen = np.stack([lead[first], sets[first], n[first]])
        if best is not None and best < tuple(chosen[:, 0].tolist()):
            chosen[:, 0] = best
        pivot[listed], size[listed] = np.repeat(chosen[1], sizes), np.repeat(chosen[2], sizes)
        known = (*known[:3], tuple(chosen[:, -1].tolist()))
    return np.stack([token, sets, n, pos, block, pivot, size, more])[:, listed], known


def _built(pairs: DataFrame, nodes: DataFrame, records: DataFrame, words: int, place: str) -> DataFrame:
    """(a, b, x, y): the candidate pairs with their whole sets.

    Only sets that occur in a candidate are built again, from the text of one of their records.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    holders = nodes.where("n > 0").groupBy("set").agg(F.min("key").alias("key")).join(wanted, "set", "left_semi")
    holders = holders.select(F.col("key").alias("holder")).distinct()
    texts = records.join(holders, F.col("key").eqNullSafe(F.col("holder")), "left_semi").select("text")

    def work(batch):
        for p in T.pieces(batch.column(0)):
            sets = [s for s in shingle_sets(p, words) if len(s)]
            yield np.array([_signature(s) for s in sets], np.int64), _ragged(sets, pa.int64())

    _map(texts, work, "set bigint, shingles array<bigint>").write.parquet(place)
    built = records.sparkSession.read.parquet(place)
    left = built.select(F.col("set").alias("a"), F.col("shingles").alias("x"))
    right = built.select(F.col("set").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")


def _each(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for i in range(batch.num_rows):
        x, y = (batch.column(k)[i].values.to_numpy() for k in (2, 3))
        yield x, y, np.intersect1d(x, y, assume_unique=True)


def _verified(pairs: DataFrame, nodes: DataFrame, records: DataFrame, words: int, percent: int, place: str) -> DataFrame:
    """The similar ones of the candidate pairs (a, b), by their whole sets."""

    def compare(batch):
        keep = np.array([100 * len(c) >= percent * (len(x) + len(y) - len(c)) for x, y, c in _each(batch)], bool)
        yield batch.column(0).to_numpy()[keep], batch.column(1).to_numpy()[keep]

    found = checkpointed(_map(_built(pairs, nodes, records, words, place), compare, "a bigint, b bigint"))
    discard(records.sparkSession, place)
    return found


def _anchored(pairs: DataFrame, nodes: DataFrame, records: DataFrame, words: int, percent: int, place: str) -> DataFrame:
    """(a, b, similar, more, less) of the pairs that share half of what they have.

    b is the anchor of a; ``more`` are the shingles that only a has, ``less`` those that only b has.
    """

    def compare(batch):
        kept, similar, more, less = [], [], [], []
        for i, (x, y, c) in enumerate(_each(batch)):
            if 3 * len(c) >= len(x) + len(y):
                kept.append(i)
                similar.append(100 * len(c) >= percent * (len(x) + len(y) - len(c)))
                more.append(np.setdiff1d(x, c, assume_unique=True))
                less.append(np.setdiff1d(y, c, assume_unique=True))
        a, b = (batch.column(k).to_numpy()[kept] for k in (0, 1))
        yield a, b, np.array(similar, bool), _ragged(more, pa.int64()), _ragged(less, pa.int64())

    schema = "a bigint, b bigint, similar boolean, more array<bigint>, less array<bigint>"
    _map(_built(pairs, nodes, records, words, f"{place}/built"), compare, schema).write.parquet(f"{place}/found")
    discard(records.sparkSession, f"{place}/built")
    return records.sparkSession.read.parquet(f"{place}/found")


def _higher(stars: DataFrame) -> DataFrame:
    """(a, b) of the sets whose anchor has an anchor itself that more sets have: they may go to that one."""
    follow = stars.groupBy("b").agg(F.count("*").alias("n"))
    top = stars.select(F.col("a").alias("b"), F.col("b").alias("top"))
    top = top.join(follow, "b").join(follow.select(F.col("b").alias("top"), F.col("n").alias("m")), "top").where("m > n")
    return stars.select("a", "b").join(top, "b").where("a <> top").select("a", F.col("top").alias("b"))


def _differences(anchored: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(anchor, item, set, apart, asks, size): what the sets of one anchor p differ from it in, where sets of two classes do.

    Let D and A be what x lacks of p and what it has beyond p. Then x and y have |p| - |D| - |D'| +
    s in common, where s counts the differences that they share. If both are similar to p they
    are of its class; if x is not, y must share more than (100 D' + percent A') / (100 + percent)
    of its own differences with x. So y is looked up by just so many of them, the rarest, that
    one of those that it must share is among them (``asks``). ``apart`` are the sets that are not similar to p.
    """

    def rows(batch):
        out = [[], [], [], [], [], []]
        for i in range(batch.num_rows):
            a, b, similar, root = (batch.column(k)[i].as_py() for k in range(4))
            more, less = (batch.column(k)[i].values.to_numpy() for k in (4, 5))
            every = np.concatenate([more * 2, less * 2 + 1])  # what is lacking is another thing than what is had
            least = (100 * len(less) + percent * len(more)) // (100 + percent) + 1
            for column, value in zip(out, (b, a, root, least, not similar)):
                column.append(np.full(len(every), value))
            out[5].append(every)
        yield [np.concatenate(c) if c else np.zeros(0, bool if k == 4 else np.int64) for k, c in enumerate(out)]

    schema = "anchor bigint, set bigint, root bigint, least bigint, apart boolean, item bigint"
    rooted = anchored.join(known.select(F.col("set").alias("a"), "root"), "a").select("a", "b", "similar", "root", "more", "less")
    long = _map(rooted, rows, schema)
    often = long.groupBy("anchor", "item").agg(F.count("*").alias("often"), (F.min("root") < F.max("root")).alias("mixed"))
    own = Window.partitionBy("set")  # no more rows than the set's differences
    listed = long.join(often.where("mixed"), ["anchor", "item"], "left").withColumns(
        {"rank": F.row_number().over(own.orderBy(F.coalesce("often", F.lit(1)), "item")), "size": F.count("*").over(own)}
    )
    asks = (F.col("rank") <= F.col("size") - F.col("least") + 1).alias("asks")
    return checkpointed(listed.where("mixed").select("anchor", "item", "set", "apart", asks, "size"))


def _centres(listed: DataFrame) -> DataFrame:
    """(a, b): each set with that one of those that share a difference with it that differs least from the anchor."""
    centre = listed.groupBy("anchor", "item").agg(F.min_by("set", F.struct("size", "set")).alias("b"))
    return listed.join(centre, ["anchor", "item"]).where("set <> b").select(F.col("set").alias("a"), "b").distinct()


def _derived(listed: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) of different classes among the sets of one anchor, whose sketches are near."""
    listed = listed.join(known, "set")
    found, probes = (listed.where(x).select("anchor", "item", *_sided(listed, y)) for x, y in (("asks", "a"), ("apart", "b")))
    once = ~F.col("apart_a") | (F.col("set_a") < F.col("set_b"))  # two that ask each other
    met = found.join(probes, ["anchor", "item"]).where(once & _may_link(percent))
    return met.select(F.least("set_a", "set_b").alias("a"), F.greatest("set_a", "set_b").alias("b")).distinct()


def _leftover(index: DataFrame, classes: DataFrame, anchors: DataFrame, facts: DataFrame, percent: int, place: str) -> DataFrame:
    """Pairs (a, b, n, m, c) of different classes and anchors, but for those of a set and its list's pivot.

    c shingles are in both prefixes. Index blocks are matched by their ranges of size and place
    first; only the entries of the blocks that remain are looked at, and only they carry the sketches
    of their sets, folded to what sets of their size need, so that a pair becomes a row only if it may link. Pairs of blocks that begin with the
    same sets go to the same task, where equal pairs are added up before the shuffle.
    """
    listed = index.groupBy("set").agg(F.count("*").alias("listed")).withColumnRenamed("set", "node")
    named = listed.join(classes, "node", "left").join(anchors, "node", "left")
    known = index.where("more").join(named, index["set"] == named["node"]).select(
        "listed", "token", "set", "n", "pos", "block", "pivot", F.coalesce("root", "set").alias("cls"), F.coalesce("anchor", "set").alias("anchor")
    )
    blocks = known.groupBy("token", "block").agg(
        *[f(x).alias(f"{g}_{x}") for x in ("n", "pos", "cls", "anchor", "listed") for f, g in ((F.min, "lo"), (F.max, "hi"))],
        F.min("set").alias("least"),
        F.collect_list(F.struct("set", "n", "pos", "cls", "pivot", "anchor", "listed")).alias("sets"),  # at most BLOCK
    )
    mixed = blocks.groupBy("token").agg(F.min("lo_cls").alias("x"), F.max("hi_cls").alias("y")).where("x <> y").select("token")
    blocks.join(mixed, "token", "left_semi").write.parquet(f"{place}/blocks")
    blocks = index.sparkSession.read.schema(blocks.schema).parquet(f"{place}/blocks")
    names = ("block", "lo_n", "hi_n", "lo_pos", "hi_pos", "lo_cls", "hi_cls", "lo_anchor", "hi_anchor", "hi_listed")
    other = blocks.select("token", *[F.col(x).alias(f"{x}_2") for x in names])

    def one(x: str) -> Column:
        return (F.col(f"lo_{x}") == F.col(f"hi_{x}")) & (F.col(f"lo_{x}_2") == F.col(f"hi_{x}_2")) & (F.col(f"lo_{x}") == F.col(f"lo_{x}_2"))

    # The best that any two entries can reach: the shorter rest behind both places.
    ahead = F.least("hi_pos", "hi_pos_2") + 1
    reach = ahead + F.least(F.col("hi_n") - F.col("lo_pos"), F.col("hi_n_2") - F.col("lo_pos_2")) - 1
    alike = (
        (F.col("block") <= F.col("block_2")) & ~one("cls") & ~one("anchor")
        & (F.col("hi_n") * 100 >= F.col("lo_n_2") * percent) & (F.col("hi_n_2") * 100 >= F.col("lo_n") * percent)
        & (reach >= _needed(percent, "lo_n", "lo_n_2"))
    )
    met = checkpointed(blocks.drop("sets").join(other, "token").where(alike).select("token", "block", "block_2"))
    used = met.select("token", F.explode(F.array("block", "block_2")).alias("block")).distinct()
    entries = blocks.join(used, ["token", "block"], "left_semi").select("token", "block", "least", "hi_n", F.explode("sets").alias("e"))
    sketches = facts.select(F.col("set").alias("of"), "sketch")
    sketch = _folded(F.col("sketch"), F.col("hi_n")).alias("sketch")
    entries = entries.join(sketches, F.col("e.set") == F.col("of")).select("token", "block", "least", "e.*", sketch)
    rich = entries.groupBy("token", "block").agg(
        F.first("least").alias("least"),
        F.collect_list(F.struct(F.struct("set", "n", "pos", "cls", "pivot", "anchor", "listed").alias("e"), "sketch")).alias("both"),
    ).select("token", "block", "least", F.col("both.e").alias("sets"), F.flatten("both.sketch").alias("sketches"))
    rich_2 = rich.select("token", *[F.col(x).alias(f"{x}_2") for x in ("block", "least", "sets", "sketches")])
    met = met.join(rich, ["token", "block"]).join(rich_2, ["token", "block_2"]).repartition("least", "least_2").select(
        (F.col("block") == F.col("block_2")).alias("own"), "sets", "sets_2", "sketches", "sketches_2"
    )

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            sides = [(batch.column(k).offsets.to_numpy(), [f.to_numpy() for f in batch.column(k).values.flatten()]) for k in (1, 2)]
            for r in range(batch.num_rows):
                x, y = ([f[o[r] : o[r + 1]] for f in fields] for o, fields in sides)
                ok = (x[3][:, None] != y[3][None, :]) & (x[5][:, None] != y[5][None, :])
                if own[r]:
                    ok &= x[0][:, None] < y[0][None, :]
                ok &= (x[0][:, None] != y[4][None, :]) & (x[4][:, None] != y[0][None, :])
                n, m, i, j = x[1][:, None], y[1][None, :], x[2][:, None], y[2][None, :]
                ok &= (100 + percent) * (np.minimum(i, j) + np.minimum(n - i, m - j)) >= percent * (n + m)
                ok &= (100 * n >= percent * m) & (100 * m >= percent * n)
                # A prefix shingle that is in no list is shared with nobody.
                behind = np.maximum(-(-percent * n // 100), -(-percent * m // 100)) - 1
                ok &= np.minimum(x[6][:, None], y[6][None, :]) >= -(-percent * (n + m) // (100 + percent)) - behind
                a, b = np.nonzero(ok)
                u, v = (batch.column(k)[r].values.to_numpy().view(np.uint64).reshape(len(s[0]), -1) for k, s in ((3, x), (4, y)))
                u, v = _narrowed(u, v.shape[1]), _narrowed(v, u.shape[1])
                bits = np.bitwise_count(u[a] ^ v[b]).sum(axis=1, dtype=np.int64)
                near = bits * (100 + percent) <= (x[1][a] + y[1][b]) * (100 - percent)
                a, b = a[near], b[near]
                if len(a):
                    found.append((x[0][a], y[0][b], x[1][a], y[1][b]))
                    held += len(a)
                if held >= 1 << 19:
                    yield _added_up(found)
                    found, held = [], 0
        if found:
            yield _added_up(found)

    raw = checkpointed(met.mapInArrow(expand, "a bigint, b bigint, n bigint, m bigint, c bigint"))
    discard(index.sparkSession, f"{place}/blocks")
    return raw


def _apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose classes, ``root_a`` and ``root_b``, differ."""
    for x in "ab":
        names = classes.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
        pairs = pairs.join(names, x, "left").withColumn(f"root_{x}", F.coalesce(f"root_{x}", x))
    return pairs.where("root_a <> root_b")


def _joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes (node, root) after further links (a, b): only roots and new nodes are linked anew."""
    tops = components(_apart(links, classes).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    named = classes.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    new = tops.join(classes.select("node"), "node", "left_anti")
    return checkpointed(named.select("node", F.coalesce("top", "root").alias("root")).unionAll(new.select("node", "root")))


def _facts(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(set, n, sketch, root) of every set."""
    return sets.join(classes.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))


def _sided(facts: DataFrame, side: str) -> list[Column]:
    return [F.col(c).alias(f"{c}_{side}") for c in facts.columns if c not in ("anchor", "item", "asks", "size")]


def _may_link(percent: int) -> Column:
    """Two sets are of different classes, and may be similar by their sketches."""
    bits = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return (F.col("root_a") != F.col("root_b")) & (bits * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))


def _near(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may link."""
    a, b = (known.select(*_sided(known, x)) for x in "ab")
    return pairs.join(a, F.col("a") == F.col("set_a")).join(b, (F.col("b") == F.col("set_b")) & _may_link(percent)).select("a", "b")


def _added_up(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Equal pairs once, the smaller set first, with their number."""
    u, v, s, t = (np.concatenate(x) for x in zip(*found))
    names, where = np.unique(np.concatenate([u, v]), return_inverse=True)
    size = np.zeros(len(names), np.int64)
    size[where] = np.concatenate([s, t])
    u, v = where[: len(u)], where[len(u) :]
    pairs, times = np.unique(np.minimum(u, v) * len(names) + np.maximum(u, v), return_counts=True)
    a, b = pairs // len(names), pairs % len(names)
    columns = [names[a], names[b], size[a], size[b], times]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["a", "b", "n", "m", "c"])


def _grouped(rows: DataFrame, kind: str, words: int, percent: int, place: str) -> tuple[DataFrame, DataFrame]:
    """The nodes, and (node, root) of every set that is linked with another one."""
    _nodes(rows, kind, words, percent).write.parquet(f"{place}/nodes")
    nodes = rows.sparkSession.read.parquet(f"{place}/nodes")
    frequent = _frequent(nodes)
    _index(_entries(rows, frequent, words, percent), percent).write.parquet(f"{place}/index")
    index = rows.sparkSession.read.parquet(f"{place}/index")

    enough = F.col("c") >= _shared_prefix(percent)
    pivots = checkpointed(
        index.where("set <> pivot").groupBy(F.col("set").alias("a"), F.col("pivot").alias("b"))
        .agg(F.max("n").alias("n"), F.max("m").alias("m"), F.count("*").alias("c"))
    )
    # One pivot per set joins its class and is its anchor: the one with most in common.
    stars = checkpointed(pivots.where(F.col("c") * 3 >= _shared_prefix(percent)).groupBy("a").agg(F.max_by("b", "c").alias("b")))
    higher = checkpointed(_higher(stars))
    anchored = _anchored(stars.unionAll(higher), nodes, rows, words, percent, f"{place}/stars")
    classes = components(anchored.where("similar").select("a", "b"))
    sets = checkpointed(nodes.where("n > 0").groupBy("set").agg(F.max("n").alias("n"), F.first("sketch").alias("sketch")))
    again = anchored.join(higher, ["a", "b"], "left_semi")
    anchored = anchored.join(again.select("a"), "a", "left_anti").unionAll(again)
    # Then one pair, the one with most in common, of every two classes that a pivot may join, and the centres of what
    # the sets of an anchor share: most of a family is one class before any two of its sets meet.
    known = _facts(sets, classes)
    listed = _differences(anchored, known, percent)
    tried = _apart(pivots.where(enough), classes)
    best = tried.groupBy("root_a", "root_b").agg(F.max_by(F.struct("a", "b"), "c").alias("p")).select("p.*")
    likely = checkpointed(_near(best.unionAll(_centres(listed)), known, percent).distinct())
    classes = _joined(classes, _verified(likely, nodes, rows, words, percent, f"{place}/likely"))
    ordered = F.when(F.col("a") < F.col("b"), F.struct("a", "b", "n", "m", "c")).otherwise(
        F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("m").alias("n"), F.col("n").alias("m"), "c")
    )
    anchors = anchored.select(F.col("a").alias("node"), F.col("b").alias("anchor"))
    known = _facts(sets, classes)
    raw = _leftover(index, classes, anchors, known, percent, place).unionAll(pivots.select(ordered.alias("p")).select("p.*"))
    pairs = raw.groupBy("a", "b").agg(F.max("n").alias("n"), F.max("m").alias("m"), F.sum("c").alias("c")).where(enough)
    near = _near(pairs.select("a", "b"), known, percent).unionAll(_derived(listed, known, percent))
    rest = checkpointed(near.distinct())
    more = _verified(rest, nodes, rows, words, percent, f"{place}/rest")
    return nodes, _joined(classes, more)


def link_similar(
    records: DataFrame, key: str = "request_id", text: str = "error_message", words: int = 5, percent: int = 75
) -> DataFrame:
    """Groups of log records whose messages are near copies of each other.

    ``records`` has ``key`` (the ``request_id``) and ``text`` (a free text such as
    ``error_message``). A text's set are its distinct runs of ``words`` words (A-Z
    lower-cased); a shorter text is one run. Two records are linked when their sets' Jaccard
    similarity is at least ``percent`` percent; linked records and what they are linked to
    form a component. Returns ``key, n_shingles, component_id``, the latter the smallest key
    of the component.

    No link is lost: prefix and count filters are exact, and every candidate whose class is
    not known yet is verified with whole sets. Equal sets are one node from the start, so
    copies cost a row each. Nothing is gathered per group; the largest thing sent to all
    tasks are the ``FREQUENT`` most frequent shingles, and the driver sees only them.

    Null, empty and blank texts have no set and are linked with nothing; their component is
    their own key. A null key is a component of its own unless its set is shared. Repeated rows
    come out repeatedly. Only two columns are read, so other names cannot clash. An empty table
    gives an empty result.
    """
    spark = records.sparkSession
    kind = records.schema[key].dataType.simpleString()
    rows = records.select(F.col(key).alias("key"), F.col(text).alias("text"))
    place = scratch_path(spark, "shingles")
    with shuffles_end_with_actions(spark):
        nodes, classes = _grouped(rows, kind, words, percent, place)
    named = nodes.select("key", "n", "set").join(classes, nodes["set"] == classes["node"], "left").select(
        "key", "n", F.when(F.col("n") > 0, F.coalesce("root", "set")).alias("cls")
    )
    first = named.where("n > 0").groupBy("cls").agg(F.min("key").alias("component_id"))
    return named.join(first, "cls", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"),
    )
