"""Substring deduplication by level-wise doubling.

A passage of ``window`` words can repeat only if the shorter passages inside it do.  Level
by level, from a few words up to the window, each level doubling the length of the last,
passages are counted over the corpus, and only windows whose passage repeats go on to the
next level; the loop ends when none survive or the window's own length is reached.  Below
the window a whole window is stood for by the passage inside it with the smallest
fingerprint.  Equal windows hold equal words and so pick equal passages, which means that
no repeat is lost, while most places are never sent.  These fingerprints only thin out:
two passages that share one by chance cost time, not a wrong answer.  What is removed is
settled on the last level by 128-bit BLAKE2b digests of the window's own bytes.

Each batch folds equal keys before the shuffle: what it can settle itself (a second copy
in the same batch) leaves as places of its document, and one row for each key is sent on.
A line shared by a third of all documents thus reaches its task once for each batch.
Documents whose whole text has an earlier copy lose every window, so they are settled by
a digest of the text and don't take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import join_counted, map_rows, stored

_STEP = 0xD6E8FEB86659FD93  # odd multiplier over words
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    """XXH64 of ``n`` words.  Faster than looking them up: most lookups miss the caches."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(h: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of all passages of ``length`` words, put together by doubling."""
    with np.errstate(over="ignore"):
        out, have, part, size, power = None, 0, h, 1, _STEP
        while size <= length:
            if length & size:
                if out is None:
                    out, have = part, size
                else:  # what is there, then this part
                    n = max(len(h) - have - size + 1, 0)
                    out = out[:n] * np.uint64(power) + part[have : have + n]
                    have += size
            n = max(len(part) - size, 0)
            part = part[:n] * np.uint64(power) + part[size : size + n]
            power = power * power % (1 << 64)
            size *= 2
        return mixed(out)


def slid(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    rest = width - size
    return np.minimum(a[: len(a) - rest], a[rest:]) if rest else a


def lengths(window: int, start: int) -> list[int]:
    """The levels: from at least ``start`` words, each at most twice the last, to the window."""
    found = [window]
    while (half := -(-found[0] // 2)) >= max(start, 1) and half < found[0]:
        found.insert(0, half)
    return found


class Passages:
    """The words of some texts end to end, and the windows in them."""

    def __init__(self, texts: list[bytes | None], window: int):
        self.window, self.words = window, [(t or b"").split() for t in texts]
        self.first = np.cumsum([0, *map(len, self.words)])
        size = int(self.first[-1])
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = word_hashes(chain.from_iterable(self.words), size)
        self.n = max(size - window + 1, 0)
        self.whole = self.doc[: self.n] == self.doc[window - 1 :] if self.n else np.zeros(0, bool)

    def least(self, prints: np.ndarray, length: int) -> np.ndarray:
        """For each window the smallest of its passages' fingerprints."""
        return slid(prints, self.window - length + 1)[: self.n]

    def alive(self, length: int, survived: np.ndarray) -> np.ndarray:
        """Windows whose smallest passage of ``length`` words is at one of the places that survived."""
        prints = rolled(self.hash, length)
        kept = np.full(len(prints), _TOP, np.uint64)
        kept[survived] = prints[survived]
        return (self.least(kept, length) == self.least(prints, length)) & self.whole

    def picked(self, length: int, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the passages that are smallest in some live window, and their fingerprints."""
        prints, span = rolled(self.hash, length), self.window - length + 1
        pad = np.full(span - 1, _TOP, np.uint64)
        inner = np.where(alive, ~self.least(prints, length), _TOP)  # largest of the least, by complement
        reach = ~slid(np.concatenate([pad, inner, pad]), span)
        at = np.flatnonzero((reach == prints) & (reach != 0))
        return at, prints[at]

    def digests(self, at: np.ndarray) -> np.ndarray:
        """Digests (two halves) of the windows at some places."""
        out, window, blake = bytearray(), self.window, hashlib.blake2b
        for d in np.unique(self.doc[at]).tolist():
            a, b = np.searchsorted(at, self.first[d : d + 2])
            words, joined = self.words[d], b" ".join(self.words[d])
            ends = np.cumsum([len(w) + 1 for w in words])
            places = at[a:b] - self.first[d]
            starts = np.where(places > 0, ends[places - 1], 0).tolist()
            for s, e in zip(starts, (ends[places + window - 1] - 1).tolist(), strict=True):
                out += blake(joined[s:e], digest_size=16).digest()
        return np.frombuffer(bytes(out), np.uint64).reshape(-1, 2)


def _ranks(ids: list) -> np.ndarray:
    """Order of identifiers, null last; equal ones are equal."""
    order = {v: i for i, v in enumerate(sorted({i for i in ids if i is not None}))}
    return np.array([order.get(i, len(order)) if i is not None else len(order) for i in ids], np.int64)


def _rows_level(window: int, before: int | None, length: int):
    """Rows of one level: for each key of the batch one with its place, and for each
    document one with the ``places`` that the batch has settled."""

    def rows():
        def apply(cols):
            text = Passages(cols["text"], window)
            alive = text.whole
            if before is not None:
                spans = [np.asarray(p, np.int64) + a for p, a in zip(cols["places"], text.first[:-1].tolist(), strict=True)]
                alive = text.alive(before, np.unique(np.concatenate(spans)))
            if not alive.any():
                return {n: [] for n in ("h1", "h2", "id", "mark", "place", "again", "places")}
            if length < window:
                at, h1 = text.picked(length, alive)
                h2 = np.zeros(len(at), np.uint64)
                o = np.lexsort((at, h1))
                same = np.concatenate([[False], h1[o][1:] == h1[o][:-1]])
                again = same | np.concatenate([same[1:], [False]])  # occurs twice in the batch
                sent = ~same
            else:
                at = np.flatnonzero(alive)
                h1, h2 = text.digests(at).T
                doc = text.doc[at]
                rank = _ranks(cols["id"])[doc]
                o = np.lexsort((at, doc, rank, h2, h1))
                same = np.concatenate([[False], (h1[o][1:] == h1[o][:-1]) & (h2[o][1:] == h2[o][:-1])])
                group = np.flatnonzero(~same)[np.cumsum(~same) - 1]
                own = same & np.concatenate([[False], doc[o][1:] == doc[o][:-1]])
                again = own | (rank[o] > rank[o][group])  # starts earlier in the batch
                sent = ~again
            doc, place = text.doc[at], (at - text.first[text.doc[at]]).astype(np.int32)
            keyed, known = o[sent], np.sort(o[again])
            owners, cuts = np.unique(doc[known], return_index=True)
            ids, marks = pa.array(cols["id"]), np.array(cols["mark"], np.int64)
            n, k = len(keyed), len(owners)
            lists = pa.ListArray.from_arrays(pa.array([*([0] * n), *cuts.tolist(), len(known)], pa.int32()), pa.array(place[known]))
            return {
                "h1": np.concatenate([h1[keyed].view(np.int64), marks[owners]]),
                "h2": np.concatenate([h2[keyed].view(np.int64), np.full(k, -1)]),
                "id": pa.concat_arrays([ids.take(pa.array(doc[keyed])), ids.take(pa.array(owners))]) if ids.type != pa.null() else pa.nulls(n + k),
                "mark": np.concatenate([marks[doc[keyed]], marks[owners]]),
                "place": pa.array(np.concatenate([place[keyed], np.zeros(k, np.int32)]), pa.int32(), mask=np.arange(n + k) >= n),
                "again": np.concatenate([again[sent], np.ones(k, bool)]),
                "places": lists,
            }

        return apply

    return rows


def _rows_kept(window: int, with_text: bool):
    def apply(cols):
        out = {"id": cols["id"], "n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
        for text, places, copy in zip(cols["text"], cols["places"], cols["copy"], strict=True):
            words = (text or b"").split()
            n = len(words)
            if copy and n >= window:
                words = []
            elif places:
                cover = np.zeros(n + 1, np.int32)
                np.add.at(cover, np.array(places), 1)
                np.add.at(cover, np.array(places) + window, -1)
                words = list(compress(words, (np.cumsum(cover)[:n] == 0).tolist()))
            kept = b" ".join(words)
            out["n_words"].append(n)
            out["n_removed"].append(n - len(words))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if with_text:
                out["kept"].append(kept.decode("utf-8", "replace"))
        return out

    return lambda: apply


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, with_text: bool = True, start: int = 5
) -> DataFrame:
    """Remove each word covered by a ``window``-word window that also starts earlier.

    Returns ``doc_id, n_words, n_removed, kept_sha256`` and, with ``with_text``, the text
    ``kept`` (its words joined by one space).  Words are runs without ASCII white space.
    Earlier means a smaller identifier, or an earlier start in the same document; windows
    are judged on the input.  ``start`` is the fewest words of a level.  Null and empty
    texts have no words; texts shorter than a window lose nothing; very long texts are
    taken whole (some 200 bytes a word in one worker).  A null identifier counts as the
    largest.  Rows that repeat an identifier do not remove each other's words.  An empty
    table gives an empty table; other columns are not read.
    """
    if window < 2:
        raise ValueError("a window holds at least two words")
    kind = docs.schema[id_col].dataType.simpleString()
    text = docs[text_col].cast("binary")
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("mark"), text.alias("text"))

    slim = stored(rows.select("id", "mark", F.unhex(F.sha2(F.coalesce("text", F.lit(b"")), 256)).alias("digest")), "digests")
    firsts = slim.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = stored(firsts.filter("n > 1 AND first IS NOT NULL"), "firsts")
    later = F.col("id").isNull() | (F.col("id") > F.col("first"))
    copies = stored(join_counted(slim, firsts, "digest", "n").filter(later).select("id", "mark").distinct(), "copies")

    def beside(found: DataFrame, how: str, *more: str) -> DataFrame:
        a, b = rows.alias("a"), found.alias("b")
        same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.mark") == F.col("b.mark"))
        return a.join(b, same, how).select("a.*", *(f"b.{c}" for c in more))

    schema = f"h1 bigint, h2 bigint, id {kind}, mark bigint, place int, again boolean, places array<int>"
    key, before, live = Window.partitionBy("h1", "h2"), None, beside(copies, "left_anti")
    for length in lengths(window, start):
        sent = map_rows(live, _rows_level(window, before, length), schema, chunk=4096, most=4 << 20)
        if length < window:
            judged = sent.withColumn("n", F.count(F.lit(1)).over(key)).filter("n > 1 OR again")
        else:
            judged = sent.withColumn("n", F.rank().over(key.orderBy(F.col("id").asc_nulls_last()))).filter("n > 1 OR again")
        lists = F.coalesce(F.when(F.col("place").isNull(), F.col("places")), F.array("place"))
        found = stored(judged.groupBy("id", "mark").agg(F.flatten(F.collect_list(lists)).alias("places")), f"level-{length}")
        if found.isEmpty():
            break
        before, live = length, beside(found, "inner", "places")

    removed = found.select("id", "mark", "places", F.lit(False).alias("copy"))
    removed = removed.unionByName(copies.select("id", "mark", F.lit(None).cast("array<int>").alias("places"), F.lit(True).alias("copy")))
    out = f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept string" if with_text else "")
    return map_rows(beside(removed, "left", "places", "copy").drop("mark"), _rows_kept(window, with_text), out, chunk=4096, most=4 << 20).withColumnRenamed("id", id_col)
