"""SimHash near-duplicates: exact pairs within a Hamming radius by vantage-point trees.

Distinct fingerprints are points of Hamming space.  A vantage-point tree fitted on a
bounded sample cuts the space into shards: each inner node sends a point inside or
outside a ball around its vantage point.  By the triangle inequality a point whose
distance from the ball's border is more than the radius has all its neighbours on its
own side; a point nearer to the border also queries the shards of the other side.
Every point lives in one shard and visits each later shard that its own ball overlaps,
so that every pair meets in one shard.  In a shard the same
pruning goes on in a local tree, down to blocks.  In a block two fingerprints within the
radius agree in one of ``radius + 1`` bands of bits (there are too few differing bits to
touch them all), so only points that share a band are compared, and none is lost.

A shard gives a spanning forest of its links instead of all pairs, so a group of
thousands of near copies costs as many rows as it has members.  The forests are joined
into components: each node points to its smallest neighbour, pointers are followed to
their ends by doubling, and what they lead to is contracted, so that rounds grow with the
logarithm of a component's size.

:func:`deduplicate` asks for texts of a given Jaccard similarity of word shingles instead of
a number of bits.  Candidates are links within the radius between fingerprints of short
shingles under several seeds; each is then confirmed on the shingle sets themselves.  No
radius covers every such pair, and a spanning forest shows only some, so what fingerprints
leave apart is completed from prefixes of the sets (:mod:`tessera.llm.overlap`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import overlap
from tessera.llm.shared import drop_stored, join_counted, map_rows, ship, spare, stored
from tessera.llm.substring_dedup import mixed, rolled, word_hashes

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of word shingles (repeats count); zero for a text without words.

    Letters A-Z are lower-cased.  A text of fewer words is one shingle.  A bit is set if
    it is set in more than half of the shingles' XXH64 values.
    """
    found = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends, at = [], -1
    for word in found:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    digest, counts, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(found) - words + 1
    spans = zip(starts, islice(ends, words - 1, None), strict=False)
    while part := [digest(joined[a:b], seed) for a, b in islice(spans, 1 << 14)]:
        octets = np.array(part, np.uint64).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > total, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, seed: int) -> DataFrame:
    """``id, fp`` (the 64 bits as a signed long) for each row."""

    def rows():
        def apply(cols):
            bits = np.array([fingerprint(t, words, seed) for t in cols["text"]], np.uint64).view(np.int64)
            return {"id": cols["id"], "fp": bits}

        return apply

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), rows, f"id {kind}, fp bigint")


class VantageTree:
    """A tree of vantage points over ``points`` (unsigned 64-bit), cut ``depth`` times.

    Nodes are ``(vantage point, border, inside, outside)``; leaves are numbered from the
    left.  Points at the border's distance are inside.
    """

    def __init__(self, points: np.ndarray, depth: int, least: int = 2):
        self.leaves = 0
        self.root = self._grow(points, depth, least)

    def _grow(self, points: np.ndarray, depth: int, least: int):
        if depth > 0 and len(points) >= least:
            cut = best_cut(points)
            if cut is not None:
                vantage, border, inside = cut
                return vantage, border, self._grow(points[inside], depth - 1, least), self._grow(points[~inside], depth - 1, least)
        self.leaves += 1
        return self.leaves - 1

    def routes(self, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each leaf: which points visit it and, of those, which live there.  A
        point visits its own leaf and later ones that its ball overlaps."""
        yield from self._walk(self.root, points, np.arange(len(points)), np.ones(len(points), bool), radius)

    def _walk(self, node, points, which, home, radius):
        if not len(which):
            return
        if isinstance(node, int):
            yield node, which, home
            return
        vantage, border, inside, outside = node
        far = np.bitwise_count(points[which] ^ vantage).astype(np.int16)
        own = far <= border
        # to the left: only points that live there, or whose home is still ahead; a point
        # whose home lies to the left never needs leaves before its home
        left = own & home | ~home & (far - radius <= border)
        right = ~own & home | home & own & (far + radius > border) | ~home & (far + radius > border)
        yield from self._walk(inside, points, which[left], home[left] & own[left], radius)
        yield from self._walk(outside, points, which[right], home[right] & ~own[right], radius)


def best_cut(points: np.ndarray) -> tuple[np.uint64, int, np.ndarray] | None:
    """A vantage point and a border near the median distance; none if all distances are equal."""
    for vantage in points[:: max(1, len(points) // 3)][:3]:
        far = np.bitwise_count(points ^ vantage)
        border = int(np.median(far))
        for b in (border, border - 1):
            inside = far <= b
            if 0 < (n := int(inside.sum())) < len(points):
                if min(n, len(points) - n) * 16 >= len(points):
                    return vantage, b, inside
    return None


class Block:
    """Some points, sorted by each of ``radius + 1`` bands of their bits."""

    def __init__(self, which: np.ndarray, points: np.ndarray, radius: int):
        self.which, self.radius, self.bands = which, radius, []
        cuts = np.linspace(0, 64, radius + 2).astype(int)
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            values = self.band(points[which], low, high)
            order = np.argsort(values, kind="stable")
            self.bands.append((low, high, values[order], which[order]))

    @staticmethod
    def band(points: np.ndarray, low: int, high: int) -> np.ndarray:
        return (points >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)

    def near(self, asked: np.ndarray, queries: np.ndarray, points: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of queries (of those ``asked``), points within the radius, distances."""
        for low, high, values, which in self.bands:
            own = self.band(queries[asked], low, high)
            first = np.searchsorted(values, own, "left")
            size = np.searchsorted(values, own, "right") - first
            total = np.cumsum(size)
            at = 0
            while at < len(asked):
                end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
                n = size[at:end]
                q = np.repeat(asked[at:end], n)
                place = np.repeat(first[at:end] - np.cumsum(n) + n, n) + np.arange(len(q))
                h = which[place]
                far = np.bitwise_count(queries[q] ^ points[h])
                hit = far <= self.radius
                yield q[hit], h[hit], far[hit]
                at = end


class Shard:
    """The points that live in a shard, their local tree, and the links found so far."""

    def __init__(self, points: np.ndarray, radius: int, block: int = 1 << 15):
        self.points, self.radius = points, radius
        self.group = np.arange(len(points))  # the smallest member known to be linked
        self.blocks: list[Block] = []
        self.tree = self._grow(np.arange(len(points)), block)
        self.nearest = self.query(points)  # links among themselves

    def _grow(self, which: np.ndarray, block: int):
        cut = best_cut(self.points[which]) if len(which) > block else None
        if cut is None:
            parts = [which[i : i + 8 * block] for i in range(0, len(which), 8 * block)]
            self.blocks += [Block(p, self.points, self.radius) for p in parts]
            return list(range(len(self.blocks) - len(parts), len(self.blocks)))
        vantage, border, inside = cut
        return vantage, border, self._grow(which[inside], block), self._grow(which[~inside], block)

    def query(self, points: np.ndarray) -> np.ndarray:
        """For each point the index of the nearest other point of the shard that it is
        linked with, or -1.  Points of the shard that are linked through a query fall into
        one group."""
        found = np.full(len(points), -1), np.full(len(points), -1), np.full(len(points), 65, np.uint8)
        self._search(self.tree, points, np.arange(len(points)), found)
        return found[1]

    def _search(self, node, points, which, found) -> None:
        if not len(which):
            return
        if isinstance(node, tuple):
            vantage, border, inside, outside = node
            far = np.bitwise_count(points[which] ^ vantage).astype(np.int16)
            self._search(inside, points, which[far - self.radius <= border], found)
            self._search(outside, points, which[far + self.radius > border], found)
            return
        for b in node:
            for q, h, far in self.blocks[b].near(which, points, self.points):
                if len(q):
                    self._link(q, h, far, found)

    def _link(self, q: np.ndarray, h: np.ndarray, far: np.ndarray, found) -> None:
        first, nearest, best = found
        o = np.lexsort((self.points[h], far, q))  # nearest last
        o = o[::-1][far[o][::-1] > 0]
        closer = o[far[o] < best[q[o]]]
        nearest[q[closer]], best[q[closer]] = h[closer], far[closer]
        new = first[q] < 0
        first[q[new][::-1]] = h[new][::-1]
        a, b = self.group[first[q]], self.group[h]
        differ = a != b
        if not differ.any():
            return
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for x, y in np.unique(np.stack([a[differ], b[differ]], 1), axis=0).tolist():
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        old = np.array(list(up))
        to = np.arange(len(self.points))
        to[old] = [top(x) for x in old.tolist()]
        self.group = to[self.group]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Links from members to the first of their group, and to their nearest."""
        which = np.nonzero(self.group != np.arange(len(self.points)))[0]
        close = np.nonzero(self.nearest >= 0)[0]
        a, b = np.concatenate([which, close]), np.concatenate([self.group[which], self.nearest[close]])
        return self.points[a], self.points[b]


def links(points: DataFrame, radius: int, views: int = 1, sample: int = 20_000, depth: int = 6, most: int = 2_000_000) -> DataFrame:
    """``view, a, b``: links between the distinct ``fp`` of each ``view`` (0 up to ``views``),
    shard by shard: a spanning forest of all that are within the radius, and for each value
    the nearest in each shard that it visits.

    ``sample`` values of a view, the smallest by a hash, fit its upper tree of ``2 ** depth``
    shards (nothing else is drawn from them).  The depth is set by the cluster, not by the
    data: each cut makes points visit more shards, so with a fixed depth what is shuffled
    grows in proportion to the points.  A shard expected to hold more than ``most`` points
    is dealt by a hash into parts, and its queries visit each part; queries are streamed.
    An empty table, or one without a link, gives an empty table; a null ``fp`` must not
    occur, other columns are not read.
    """
    spark = points.sparkSession
    ship(spark)
    total = {r.view: r.n for r in points.groupBy("view").agg(F.count(F.lit(1)).alias("n")).collect()}
    trees, parts = [], []
    for view in range(views):
        drawn = points.filter(F.col("view") == view).orderBy(F.xxhash64("fp")).limit(sample)
        fitted = np.array([r.fp for r in drawn.select("fp").collect()], np.int64).view(np.uint64)
        tree = VantageTree(fitted, depth, least=16)
        size = np.zeros(max(1, tree.leaves), np.int64)
        for leaf, _, home in tree.routes(fitted, 0):
            size[leaf] = home.sum()
        trees.append(tree)
        parts.append(np.maximum(1, np.ceil(size * (total.get(view, 0) / max(1, len(fitted))) / most)).astype(np.int64))
    route = pa.schema([("view", pa.int32()), ("shard", pa.int32()), ("part", pa.int32()), ("visit", pa.bool_()), ("fp", pa.int64())])

    def sent(view: int, leaf: int, p: int, visit: bool, values: np.ndarray) -> pa.RecordBatch:
        n = len(values)
        columns = [np.full(n, view, np.int32), np.full(n, leaf, np.int32), np.full(n, p, np.int32), np.full(n, visit), values.view(np.int64)]
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), schema=route)

    def send(batches):
        for batch in batches:
            of, every = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for view in np.unique(of).tolist():
                own, dealt = every[of == view], parts[view]
                for leaf, which, home in trees[view].routes(own, radius):
                    at = own[which]
                    part = ((at * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % dealt[leaf]
                    for p in range(dealt[leaf]):
                        here = home & (part == p)
                        for visit, values in ((False, at[here]), (True, at if dealt[leaf] > 1 else at[~here])):
                            if len(values):
                                yield sent(view, leaf, p, visit, values)
        spare()

    edge = pa.schema([("view", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def edges(view: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), view, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=edge)

    def search(batches):
        key, shard, held = None, None, []
        for key_now, visit, values in _runs(batches):
            if key_now != key:
                shard = shard or _filled(held, radius)  # no other point may have visited
                if shard is not None:
                    yield edges(key[0], *shard.forest())
                key, shard, held = key_now, None, []
            if not visit:
                held.append(values)
                continue
            shard = shard or _filled(held, radius)
            if shard is not None:
                near = shard.query(values)
                yield edges(key[0], values[near >= 0], shard.points[near[near >= 0]])
        shard = shard or _filled(held, radius)
        if shard is not None:
            yield edges(key[0], *shard.forest())
        spare()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ("view", "shard", "part")
    dealt = points.select(F.col("view").cast("int"), "fp").mapInArrow(send, "view int, shard int, part int, visit boolean, fp bigint").repartition(n, *keys)
    return dealt.sortWithinPartitions(*keys, "visit").mapInArrow(search, "view int, a bigint, b bigint")


def _filled(held: list[np.ndarray], radius: int) -> Shard | None:
    """A shard of the points that live in it, linked among themselves.  They are sorted, so
    that its links don't depend on the order in which points arrive."""
    return Shard(np.sort(np.concatenate(held)), radius) if held else None


def _runs(batches) -> Iterator[tuple[tuple[int, int, int], bool, np.ndarray]]:
    """Stretches of equal (view, shard, part, visit) in sorted batches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        view, shard, part = (batch.column(i).to_numpy() for i in range(3))
        visit = batch.column(3).to_numpy(zero_copy_only=False)
        fp = batch.column(4).to_numpy().view(np.uint64)
        cuts = np.nonzero((np.diff(view) != 0) | (np.diff(shard) != 0) | (np.diff(part) != 0) | (visit[1:] != visit[:-1]))[0] + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)], strict=True):
            yield (int(view[a]), int(shard[a]), int(part[a])), bool(visit[a]), fp[a:b]


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``a, b`` links; equal roots mean connected.

    Each round points every node to the smallest of itself and its neighbours, follows
    the pointers to their ends by doubling and keeps the links between different ends.
    An end stands for two nodes at least, so rounds grow with the logarithm of a
    component's size, and so do the doublings in a round.  What a round needs is written
    to the shared folder and goes with the round.  Links from a node to itself and
    repeated ones don't count; an empty table gives an empty table; nulls must not occur.
    """
    links = edges.filter("a <> b").select("a", "b")
    left = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    found = None
    while not left.isEmpty():
        to = stored(left.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "roots")
        while True:
            ends = to.select(F.col("node").alias("root"), F.col("root").alias("end"))
            jumped = stored(to.join(ends, "root").select("node", F.col("end").alias("root"), (F.col("end") != F.col("root")).alias("moved")), "roots")
            drop_stored(to)
            to = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        if found is None:
            found = to
        else:
            next_ = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = stored(found.join(next_, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "found")
        start = to.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        end = to.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        before = left
        left = stored(left.join(start, "a").join(end, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
        drop_stored(before)
    return found if found is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, seed: int = 42
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each input row.

    Documents link when their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest identifier that links reach, the document itself
    included.  Null and empty texts have fingerprint zero and link like any other; null
    identifiers count as the largest (a component of nulls only has a null); repeated
    rows come out repeated; an empty table gives an empty table; other columns are not
    read.
    """
    each = stored(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    points = stored(each.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "points")
    roots = components(stored(links(points.select(F.lit(0).alias("view"), "fp"), radius), "edges"))
    linked = points.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.join(least, "root").select("fp", "least")
    home = stored(points.join(linked, "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("component_id")), "components")
    hex16 = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return join_counted(each, home, "fp", "n").select(F.col("id").alias(id_col), hex16.alias("fingerprint"), "component_id")


def _shingles(text: str | None, words: int) -> np.ndarray:
    """Hashes of all word shingles, letters A-Z lower-cased; a text of fewer words is one."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = word_hashes(found, len(found))
    return rolled(h, min(words, len(h))) if len(h) else h


def view_prints(text: str | None, words: int, views: int) -> list[int]:
    """SimHash fingerprints of the same shingles under several seeds; zeros without words."""
    h, out = _shingles(text, words), []
    for v in range(views):
        counts, each = np.zeros(64, np.int64), mixed(h ^ np.uint64(0x9E3779B97F4A7C15 * (v + 1) % (1 << 64)))
        for at in range(0, len(each), 1 << 14):
            octets = each[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0]))
    return out


def _salted_pairs(pairs: DataFrame, sets: DataFrame, parts: int = 256, salts: int = 64) -> DataFrame:
    """``a, b, sa, sb``: pairs beside the shingle sets of both.  A ``b`` in more than one of
    ``parts`` of all pairs has its set sent ``salts`` times, and its pairs are dealt to them."""
    bar = max(1_000, pairs.count() // parts)
    hot = F.broadcast(pairs.groupBy("b").count().filter(F.col("count") > bar).select(F.col("b").alias("mark"), F.lit(True).alias("hot")))  # at most `parts` rows
    spread = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    copies = sets.join(hot, "mark", "left").select(F.col("mark").alias("b"), F.col("s").alias("sb"), spread.alias("salt"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int")).otherwise(0)
    dealt = pairs.join(hot.withColumnRenamed("mark", "b"), "b", "left").select("a", "b", salt.alias("salt"))
    return dealt.join(sets.select(F.col("mark").alias("a"), F.col("s").alias("sa")), "a").join(copies, ["b", "salt"])


def _confirmed(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, words: int, least: float) -> DataFrame:
    """``a, b``: the pairs of marks whose shingle sets are similar, both empty ones included.
    Whole sets are compared only if their parities leave it open."""

    def sets():
        return lambda cols: {"mark": cols["mark"], "s": [np.unique(_shingles(t, words)).view(np.int64) for t in cols["text"]]}

    bits = nodes.select("mark", F.struct("size", "parity").alias("s"))
    sides = [F.col(f"s{x}.{c}").alias(f"{c}_{x}") for c in ("size", "parity") for x in "ab"]
    pairs = stored(overlap.close(_salted_pairs(pairs, bits).select("a", "b", *sides), least), "close")
    wanted = pairs.select(F.col("a").alias("mark")).unionByName(pairs.select(F.col("b").alias("mark"))).distinct()
    # of equal texts one row: the smallest identifier, the other rows of which are equal too;
    # joined by both, so that the copies of one text are not shuffled to one task
    wanted = stored(nodes.select("mark", "first").join(wanted, "mark"), "wanted")
    a, b = rows.alias("a"), wanted.alias("b")
    texts = a.join(b, (F.col("a.mark") == F.col("b.mark")) & F.col("a.id").eqNullSafe(F.col("b.first"))).select("a.mark", "a.text")
    with overlap.small_batches(rows.sparkSession):
        shingled = stored(map_rows(texts, sets, "mark bigint, s array<bigint>").dropDuplicates(["mark"]), "sets")
    both = F.size(F.array_intersect("sa", "sb"))
    share = both / (F.size("sa") + F.size("sb") - both)
    fits = F.when((F.size("sa") == 0) & (F.size("sb") == 0), True).otherwise(F.coalesce(share >= least, F.lit(False)))
    found = stored(_salted_pairs(pairs, shingled).filter(fits).select("a", "b"), "edges")
    for used in (pairs, wanted, shingled):
        drop_stored(used)
    return found


def similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8,
    radius: int = 6, views: int = 6, view_words: int = 2, depth: int = 4, block: int = 4_096,
) -> DataFrame:
    """``id, mark, keep_id``: for each row the smallest identifier of its group.

    Texts link when the Jaccard similarity of their sets of ``words``-word shingles is at
    least ``least``; ``mark`` is a hash of the text, and equal texts are of one group.
    Candidates come from fingerprints of ``view_words``-word shingles under ``views`` seeds,
    within ``radius`` bits: shorter shingles and several seeds, since a fingerprint of
    ``words``-word shingles of similar texts is often farther off than any radius a tree
    can prune.  Every candidate is confirmed on the sets.  Pairs that no view brings up, or
    that a shard's forest shows only through a third text, come from the sets' prefixes: all
    that share a member of both and are not of one group yet are compared, so that no link
    is missed.  ``block`` is the size from which a prefix's file is dealt out to tasks.

    Texts without words are equal to each other; a text of fewer words is one shingle.
    Null identifiers count as the largest; repeated rows come out repeated; an empty table
    gives an empty table; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("mark"), docs[text_col].alias("text"))
    order = overlap.order(rows, lambda text: np.unique(_shingles(text, words)))

    def prints():
        def apply(cols):
            sets = [np.unique(_shingles(t, words)) for t in cols["text"]]
            fps = [view_prints(t, view_words, views) for t in cols["text"]]
            first = [order.first(s, least).view(np.int64) for s in sets]
            sizes, parities = [max(1, len(s)) for s in sets], [overlap.parity(s) for s in sets]
            bits = [overlap.parity(s, overlap.SHORT) for s in sets]
            return {"id": cols["id"], "mark": cols["mark"], "fps": fps, "size": sizes, "parity": parities, "bits": bits, "first": first}

        return apply

    with overlap.small_batches(docs.sparkSession):
        each = stored(map_rows(rows, prints, f"id {kind}, mark bigint, fps array<bigint>, size int, parity binary, bits binary, first array<bigint>"), "views")
    once = [F.first(c).alias(c) for c in ("fps", "size", "parity", "bits")]
    nodes = stored(each.groupBy("mark").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), *once), "nodes")
    seen = stored(nodes.select("mark", F.posexplode("fps").alias("view", "fp")).withColumn("at", F.struct("view", "fp")), "seen")
    homes = stored(seen.groupBy("at").agg(F.min("mark").alias("home"), F.count(F.lit(1)).alias("n")), "homes")
    found = links(homes.select("at.view", "at.fp"), radius, views, depth=depth)
    ends = [homes.select(F.col("at.view").alias("view"), F.col("at.fp").alias(x), F.col("home").alias(f"h{x}")) for x in "ab"]
    near = found.join(ends[0], ["view", "a"]).join(ends[1], ["view", "b"]).select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    within = join_counted(seen, homes, "at", "n").select(F.col("mark").alias("a"), F.col("home").alias("b"))
    files = stored(overlap.filed(each, least), "files")
    beside = files.filter("next is not null").select(F.col("mark").alias("a"), F.col("next").alias("b"))
    pairs = near.unionByName(within).unionByName(beside).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = stored(pairs.distinct(), "pairs")
    drop_stored(seen)
    drop_stored(homes)
    roots = components(_confirmed(pairs, rows, nodes, words, least))
    # what is still apart: the files' other pairs, of texts of different groups
    rooted = nodes.select("mark", "bits").join(roots.withColumnRenamed("node", "mark"), "mark", "left")
    rooted = files.join(rooted.withColumn("root", F.coalesce("root", "mark")), "mark")
    rest = stored(overlap.across(rooted, least, block).distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    drop_stored(files)
    more = _confirmed(rest, rows, nodes, words, least)
    if not more.isEmpty():
        roots = components(stored(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "edges"))
    linked = stored(nodes.select("mark", "first").join(roots.withColumnRenamed("node", "mark"), "mark"), "linked")
    lowest = linked.groupBy("root").agg(F.min("first").alias("least"))
    keep = stored(nodes.join(linked.join(lowest, "root").select("mark", "least"), "mark", "left").select("mark", "n", F.coalesce("least", "first").alias("keep_id")), "keep")
    return join_counted(each.select("id", "mark"), keep, "mark", "n").select("id", "mark", "keep_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: of each group of :func:`similar` the
    smallest identifier.  Rows that repeat that identifier with the same text all stay, and
    so do the rows of a group without any identifier, which nothing tells apart."""
    found = similar(docs, id_col, text_col, words, least)
    goes = found.filter(~F.col("id").eqNullSafe(F.col("keep_id"))).select("id", "mark").distinct()
    a, b = docs.alias("a"), goes.alias("b")
    same = docs[id_col].eqNullSafe(F.col("b.id")) & (F.xxhash64(docs[text_col]) == F.col("b.mark"))
    return a.join(b, same, "left_anti").select(*(docs[c] for c in docs.columns))
