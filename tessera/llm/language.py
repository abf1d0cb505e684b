"""Language identification by nearest centroids.

A text is a vector of byte n-grams (2 and 3, hashed) of its lower-cased letters, with
sublinear counts, weighted by inverse document frequency and scaled to unit length.
Each language has several centroids, found by clustering its sample on the sphere, so
that one language may have several ways of writing.  The nearest centroid by cosine
names the language; a text farther from every centroid than its bound is rejected.
Texts of a word or two have few n-grams to agree in, so their bounds are lower.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import map_rows

UNKNOWN = "und"
#: Buckets of each n-gram length, and how many texts are counted together.
BUCKETS, TOGETHER = 4_096, 64
#: Bytes of letters from which the whole bound holds; below, it falls with their root.
WHOLE = 24

_LETTERS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def letters(text: str | None) -> bytes:
    """Lower-cased words of letters (and bytes beyond ASCII), one space between."""
    return b" " + b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()) + b" "


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def counted(texts: list[str | None]) -> np.ndarray:
    """Counts of hashed n-grams, one row for each text."""
    parts = [letters(t) for t in texts]
    sizes = np.array([len(p) for p in parts])
    x = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    row = np.repeat(np.arange(len(parts)), sizes)
    out = np.zeros((len(parts), 2 * BUCKETS), np.float32)
    for n, base in ((2, 0), (3, BUCKETS)):
        if len(x) < n:
            continue
        code = x[: len(x) - n + 1]
        for k in range(1, n):
            code = code * 257 + x[k : len(x) - n + 1 + k]
        bucket = ((code * 0x9E3779B1) >> 11) % BUCKETS
        own = row[: len(bucket)] == row[n - 1 :]
        flat = row[: len(bucket)][own] * BUCKETS + bucket[own]
        out[:, base : base + BUCKETS] = np.bincount(flat, minlength=len(parts) * BUCKETS).reshape(len(parts), BUCKETS)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


@dataclass
class Centroids:
    languages: list[str]  # of each centroid
    vectors: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # cosine that a text must have to count as one of the centroid's

    def vector(self, texts: list[str | None]) -> np.ndarray:
        return unit(np.log1p(counted(texts)) * self.idf)

    def nearest(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, cosine in 0..1 and whether it is rejected."""
        out = []
        for at in range(0, len(texts), TOGETHER):
            part = texts[at : at + TOGETHER]
            cosine = self.vector(part) @ self.vectors.T
            best = cosine.argmax(1) if cosine.shape[1] else np.zeros(len(part), int)
            for text, b, row in zip(part, best.tolist(), cosine, strict=True):
                if not has_letter(text) or not len(row):
                    out.append((UNKNOWN, 0.0, True))
                else:
                    score = float(min(1.0, max(0.0, row[b])))
                    room = min(1.0, (len(letters(text)) / WHOLE) ** 0.5)
                    out.append((self.languages[b], score, bool((row < room * self.least).all())))
        return out


def spherical(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and the cluster of each row; seeds are spread apart."""
    rng = np.random.default_rng(seed)
    seeds = [int(rng.integers(len(x)))]
    while len(seeds) < min(k, len(x)):
        near = (x @ x[seeds].T).max(1)
        near[seeds] = 2
        seeds.append(int(near.argmin()))
    c = x[seeds]
    for _ in range(rounds):
        of = (x @ c.T).argmax(1)
        c = np.stack([unit(x[of == j].sum(0, keepdims=True))[0] if (of == j).any() else c[j] for j in range(len(c))])
    return c, (x @ c.T).argmax(1)


def fit_centroids(texts: list[str], langs: list[str], clusters: int = 4, low: float = 0.01, share: float = 0.45) -> Centroids:
    """:func:`fit_counts` for texts; those without a letter are left out."""
    kept = [i for i, t in enumerate(texts) if has_letter(t)]
    x = np.concatenate([counted([texts[i] for i in kept[a : a + 256]]) for a in range(0, len(kept), 256)]) if kept else np.zeros((0, 2 * BUCKETS), np.float32)
    return fit_counts(x, [langs[i] for i in kept], clusters, low, share)


def fit_counts(x: np.ndarray, langs: list[str], clusters: int = 4, low: float = 0.01, share: float = 0.45) -> Centroids:
    """Centroids from n-gram counts of labelled texts.  A centroid's bound is a ``share`` of
    the ``low`` quantile of its own texts' cosines, so a few odd texts in a sample don't
    open it."""
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    x = unit(np.log1p(x) * idf).astype(np.float32)
    of = np.array(langs)
    names, vectors, bounds = [], [], []
    for lang in sorted(set(of.tolist())):
        own = x[of == lang]
        c, cluster = spherical(own, clusters)
        for j in range(len(c)):
            members = own[cluster == j]
            if len(members):
                names.append(lang)
                vectors.append(c[j])
                bounds.append(share * float(np.quantile(members @ c[j], low)))
    stack = np.stack(vectors) if vectors else np.zeros((0, 2 * BUCKETS), np.float32)
    return Centroids(names, stack, idf, np.array(bounds))


def train(
    docs: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = 400, max_languages: int = 200, clusters: int = 4,
) -> Centroids:
    """Fit on at most ``per_language`` rows of each language, the smallest by a hash of
    the identifier among the rows for which ``use`` holds; null languages, identifiers and
    texts without a letter are not used.  More than ``max_languages`` languages are
    refused.  Texts are counted where they lie: what comes to the driver is the n-gram
    counts of sampled rows, at most ``2 * BUCKETS`` numbers each."""
    rows = docs.filter(use & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    mark = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 40))
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).agg(F.count(F.lit(1))).limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    part = F.lit(False)
    for lang, n in sizes.items():
        part = part | ((F.col(lang_col) == lang) & (mark < int((1 << 40) * min(1.0, 1.3 * per_language / n))))

    def grams():
        def apply(cols):
            out: dict[str, list] = {"lang": cols["lang"], "mark": cols["mark"], "at": [], "n": []}
            for text in cols["text"]:
                x = counted([text])[0] if has_letter(text) else np.zeros(0)
                out["at"].append(at := np.flatnonzero(x).astype(np.int32))
                out["n"].append(x[at].astype(np.int32))
            return out

        return apply

    sample = rows.filter(part).select(F.col(lang_col).alias("lang"), mark.alias("mark"), F.col(text_col).alias("text")).limit(4 * per_language * max(1, len(sizes)))
    got = map_rows(sample, grams, "lang string, mark bigint, at array<int>, n array<int>").filter("size(at) > 0").toArrow().to_pydict()
    order = sorted(range(len(got["lang"])), key=lambda i: (got["lang"][i], got["mark"][i], len(got["at"][i])))
    used: dict[str, int] = {}
    kept = [i for i in order if used.setdefault(got["lang"][i], 0) < per_language and not used.update({got["lang"][i]: used[got["lang"][i]] + 1})]
    x = np.zeros((len(kept), 2 * BUCKETS), np.float32)
    for row, i in enumerate(kept):
        x[row, got["at"][i]] = got["n"][i]
    return fit_counts(x, [got["lang"][i] for i in kept], clusters)


def identify(docs: DataFrame, centroids: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for each row, from the text alone.

    A null text, or one without a letter, is ``und`` with score 0 and rejected.  Other
    texts get the nearest language even where rejected.  Repeated rows and null
    identifiers pass through; an empty table gives an empty table; other columns are not
    read.
    """

    def rows():
        def apply(cols):
            lang, score, rejected = zip(*centroids.nearest(cols["text"]), strict=True)
            return {"id": cols["id"], "lang_pred": lang, "score": score, "rejected": rejected}

        return apply

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return map_rows(picked, rows, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, centroids: Centroids, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that identification rejects, all columns kept.

    Rows with a null or letterless text go.  Null identifiers, repeated rows and columns of
    any name pass through; long texts are read whole; an empty table stays empty.
    """

    def rows():
        def apply(cols):
            rejected = [r for _, _, r in centroids.nearest(cols[text_col])]
            return {n: [v for v, r in zip(values, rejected, strict=True) if not r] for n, values in cols.items()}

        return apply

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_rows(docs, rows, schema)
