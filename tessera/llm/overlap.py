"""Exact candidates for sets of a given Jaccard similarity, by prefixes.

All members stand in one order: those that are frequent in a bounded sample last, the others
by hash.  Two sets ``A`` and ``B`` of a Jaccard similarity of ``least`` share at least
``least * |A|`` members, so the first member that they share is among the first
``|A| - ceil(least * |A|) + 1`` of ``A``, and likewise of ``B``.  Each set is filed under these
members only, and no similar pair is lost, whatever the order; rare members first only keep
the files small.  Of two sets in one file, sizes and places tell how much they can share at
most.

A file is never cut.  :func:`filed` gives each set of a file one neighbour, so that groups
of thousands of near copies are joined by as many pairs as rows; :func:`across` then gives
all pairs of a file that are not of one component yet.  Files of more than ``block`` sets
are dealt out as pairs of blocks.  :func:`parity` bits rule most pairs out before whole sets
are compared: every member that only one of two sets has changes one bit, so the bits in
which they differ are at most as many as these members.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import map_rows, pieces, settings, ship, spare, stored
from tessera.llm.substring_dedup import mixed

SHORT = 512  # bits of parity beside each row of a file
#: Batches that hold texts stay small in the executors' memory.
_SMALL = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
_SLACK = 1e-9  # products are rounded; a bound that is too low costs time, not a pair


class Order:
    """Members by hash, the ``late`` ones (rarest first) behind all others."""

    def __init__(self, late: np.ndarray):
        self.place = np.argsort(late, kind="stable")
        self.late = late[self.place]

    def first(self, members: np.ndarray, least: float) -> np.ndarray:
        """The members (distinct and sorted) that a set is filed under, in order.  An empty set
        is filed under zero."""
        n = len(members)
        if not n:
            return np.zeros(1, np.uint64)
        if len(self.late):
            at = np.minimum(np.searchsorted(self.late, members), len(self.late) - 1)
            late = self.late[at] == members
            members = np.concatenate([members[~late], members[late][np.argsort(self.place[at[late]], kind="stable")]])
        return members[: n - math.ceil(least * n - _SLACK) + 1]


def small_batches(spark: SparkSession):
    """Settings for jobs that send whole texts to Python."""
    return settings(spark, _SMALL)


def order(rows: DataFrame, members: Callable[[str | None], np.ndarray], texts: int = 10_000, rare: int = 5, most: int = 50_000) -> Order:
    """An order from about ``texts`` of the distinct ``mark, text`` of ``rows``, drawn by hash:
    late are members that ``rare`` of them or more have, at most ``most``, the most frequent
    ones.  The sample sets the order only; every text is filed."""
    share = min(1.0, texts / max(1, rows.count()))
    drawn = rows.select("mark", "text").filter(F.pmod(F.xxhash64("mark"), F.lit(1 << 30)) < F.lit(round(share * (1 << 30))))

    def split():
        return lambda cols: {"m": [members(t).view(np.int64) for t in cols["text"]]}

    each = map_rows(drawn.dropDuplicates(["mark"]), split, "m array<bigint>").select(F.explode("m").alias("m"))
    seen = each.groupBy("m").count().filter(F.col("count") >= rare).orderBy(F.desc("count"), "m").limit(most)
    with small_batches(rows.sparkSession):
        found = seen.agg(F.sort_array(F.collect_list(F.struct("count", "m"))).alias("found")).first().found  # at most `most`
    return Order(np.array([r.m for r in found], np.int64).view(np.uint64))


def parity(members: np.ndarray, k: int = 0) -> bytes:
    """For each remainder of members by ``k``, a power of two (of itself at least their
    number), whether an odd number of them has it."""
    k = k or max(64, 1 << (len(members) - 1).bit_length())
    odd = np.bincount((members & np.uint64(k - 1)).astype(np.int64), minlength=k) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """The least number of members that only one of two sets of these parities has."""
    if len(a) < len(b):
        a, b = b, a
    x, bits = int.from_bytes(a, "little"), 8 * len(a)
    while bits > 8 * len(b):
        bits //= 2
        x = x >> bits ^ x & (1 << bits) - 1
    return (x ^ int.from_bytes(b, "little")).bit_count()


def close(pairs: DataFrame, least: float) -> DataFrame:
    """``a, b`` of the ``a, b, size_a, size_b, parity_a, parity_b`` that may be similar."""

    def rows():
        def apply(cols):
            sizes = zip(cols["size_a"], cols["size_b"], strict=True)
            most = [(1 - least) / (1 + least) * (m + n) + _SLACK for m, n in sizes]
            hit = [apart(x, y) <= m for x, y, m in zip(cols["parity_a"], cols["parity_b"], most, strict=True)]
            return {x: list(compress(cols[x], hit)) for x in "ab"}

        return apply

    return map_rows(pairs, rows, "a bigint, b bigint", chunk=4_096)


def _possible(size_a, place_a, size_b, place_b, least: float) -> np.ndarray:
    """Whether sets can be similar whose first common member has these places.  For later
    common members the bound is too low, but the pair has come up under the first one."""
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    share = np.minimum(size_a - place_a, size_b - place_b)
    return (small >= least * large - _SLACK) & (share >= least / (1 + least) * (size_a + size_b) - _SLACK)


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, put together so that rows of one first column are not parted."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut or held and held[0][0][0] != columns[0][0]:
            whole = [*held, [c[:cut] for c in columns]]
            yield [np.concatenate(c) for c in zip(*whole, strict=True)]
            held = []
        held.append([c[cut:] for c in columns])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def filed(sets: DataFrame, least: float) -> DataFrame:
    """``member, mark, size, place, next`` of files that several of ``mark, size, first`` are in.

    ``next`` is another mark of the file that may be similar, or null: the file's rows stand in
    an order by hash, and each is given the one behind it.  Repeated marks are taken once.
    """
    spark = sets.sparkSession
    ship(spark)
    row = pa.schema([("member", pa.int64()), ("mark", pa.int64()), ("size", pa.int32()), ("place", pa.int32())])
    out = row.append(pa.field("next", pa.int64()))

    def send(batches):
        for part in chain.from_iterable(pieces(batch, 1_024, 1 << 20) for batch in batches):
            mark, once = np.unique(part.column(0).to_numpy(), return_index=True)
            lists = part.column(2).take(pa.array(once))
            n = lists.value_lengths().to_numpy()
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            columns = [lists.flatten(), np.repeat(mark, n), np.repeat(part.column(1).to_numpy()[once], n), place.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, row, strict=True)], schema=row)
        spare()

    def search(batches):
        for member, mark, size, place in _files(batches):
            with np.errstate(over="ignore"):
                o = np.lexsort((mark, mixed((mark ^ member).view(np.uint64)), member))
            member, mark, size, place = member[o], mark[o], size[o], place[o]
            same = member[1:] == member[:-1]
            fresh = np.concatenate([[True], ~(same & (mark[1:] == mark[:-1]))])
            member, mark, size, place = member[fresh], mark[fresh], size[fresh], place[fresh]
            same = member[1:] == member[:-1]
            several = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            follows = np.concatenate([same & _possible(size[:-1], place[:-1], size[1:], place[1:], least), [False]])
            after = pa.array(np.concatenate([mark[1:], mark[-1:]]), pa.int64(), mask=~follows)
            columns = [pa.array(c) for c in (member, mark, size, place)]
            yield pa.RecordBatch.from_arrays([*columns, after], schema=out).filter(pa.array(several))
        spare()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = sets.select("mark", "size", "first").mapInArrow(send, "member bigint, mark bigint, size int, place int")
    dealt = dealt.repartition(n, "member").sortWithinPartitions("member")
    return dealt.mapInArrow(search, "member bigint, mark bigint, size int, place int, next bigint")


def _similar(size_a, place_a, bits_a, size_b, place_b, bits_b, least: float) -> np.ndarray:
    """:func:`_possible`, and parities that leave it open."""
    hit = _possible(size_a, place_a, size_b, place_b, least)
    return hit & (np.bitwise_count((bits_a ^ bits_b).view(np.uint64)).sum(axis=1) <= (1 - least) / (1 + least) * (size_a + size_b) + _SLACK)


def _pairs(member, mark, size, place, root, bits, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Marks of pairs of one file and different roots; rows sorted by member, then size."""
    a, step = np.arange(len(mark)), 1
    while len(a := a[a + step < len(mark)]):
        b = a + step
        a = a[(member[a] == member[b]) & (size[a] >= least * size[b] - _SLACK)]  # sizes only grow
        x = a[root[a] != root[a + step]]
        y = x + step
        hit = _similar(size[x], place[x], bits[x], size[y], place[y], bits[y], least)
        if hit.any():
            yield mark[x[hit]], mark[y[hit]]
        step += 1


def _cross(left: np.ndarray, right: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Marks of pairs between two blocks, rows ``mark, size, place, root`` and parity."""
    for row in left:
        other = right[right[:, 3] != row[3]]
        hit = _similar(row[1], row[2], row[4:], other[:, 1], other[:, 2], other[:, 4:], least)
        if hit.any():
            yield np.full(hit.sum(), row[0]), other[hit, 0]


def across(rows: DataFrame, least: float, block: int = 4_096) -> DataFrame:
    """``a, b`` with ``a > b``: all pairs of ``member, mark, size, place, root, bits`` that stand in
    a file, may be similar and have different roots; ``bits`` is a parity of ``SHORT``.  The
    same pair may come up repeatedly."""
    spark = rows.sparkSession
    ship(spark)
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])
    kind = "a bigint, b bigint, left binary, right binary"

    def sent(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if pairs:
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            found = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
            none = pa.nulls(len(found), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), none, none], schema=out)

    def gathered(pairs) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for pair in pairs:
            held.append(pair)
            n += len(pair[0])
            if n >= 1 << 18:
                yield from sent(held)
                held, n = [], 0
        yield from sent(held)

    def cell(left: np.ndarray, right: np.ndarray | None) -> pa.RecordBatch:
        other = None if right is None else right.tobytes()
        return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([left.tobytes()]), pa.array([other], pa.binary())], schema=out)

    def search(batches):
        for columns in _files(batches):
            o = np.lexsort((columns[1], columns[2], columns[0]))
            member, *held, bits = (c[o] for c in columns)
            bits = np.frombuffer(b"".join(bits.tolist()), np.int64).reshape(len(member), -1)
            first = np.flatnonzero(np.concatenate([[True], member[1:] != member[:-1]]))
            n = np.diff([*first, len(member)])
            several = np.minimum.reduceat(held[3], first) != np.maximum.reduceat(held[3], first)
            small = np.repeat(several & (n <= block), n)
            yield from gathered(_pairs(member[small], *(c[small] for c in held), bits[small], least))
            for at in np.flatnonzero(several & (n > block)).tolist():
                here = slice(first[at], first[at] + n[at])
                rows = np.column_stack([*(c[here].astype(np.int64) for c in held), bits[here]])
                blocks = [rows[i : i + block] for i in range(0, len(rows), block)]
                for i, left in enumerate(blocks):
                    yield cell(left, None)
                    for right in blocks[i + 1 :]:
                        if left[-1, 1] >= least * right[0, 1] - _SLACK:  # its largest, their smallest
                            yield cell(left, right)
        spare()

    wide = 4 + SHORT // 64

    def expand(batches):
        for batch in batches:
            for left, right in zip(*(batch.column(i).to_pylist() for i in (2, 3)), strict=True):
                one = np.frombuffer(left, np.int64).reshape(-1, wide)
                if right is None:
                    yield from gathered(_pairs(np.zeros(len(one), np.int64), *one[:, :4].T, one[:, 4:], least))
                else:
                    yield from gathered(_cross(one, np.frombuffer(right, np.int64).reshape(-1, wide), least))
        spare()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("member", "mark", "size", "place", "root", "bits").repartition(n, "member").sortWithinPartitions("member")
    found = stored(dealt.mapInArrow(search, kind), "files")
    cells = found.filter("left is not null").repartition(n).mapInArrow(expand, kind)
    return found.filter("left is null").unionByName(cells).select("a", "b")
