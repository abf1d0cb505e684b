"""Toxicity: a factorization machine over hashed terms.

Terms are the lower-cased words of a text and their prefixes of some lengths, hashed;
a text is the set of its terms.  The machine adds to a linear score the interactions of
all pairs of terms through low-rank factors, so that an insult beside a group's name can
weigh more, or less, than the two apart.  It is fitted on a bounded sample of labelled
rows: first on the terms that tell the classes apart by themselves, then from there on
all terms of the sample, so that terms which tell only together are learned as well.
Rows kept aside say how long.  Scoring reads every whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import map_rows, stored

_WORD = re.compile(r"[^\W\d_]+")


class Terms(dict):
    """Hashed terms of words: the word and its longer prefixes.  Bounded."""

    def __init__(self, prefixes: tuple[int, ...], bits: int = 31, most: int = 200_000):
        super().__init__()
        self.prefixes, self.mask, self.most = prefixes, (1 << bits) - 1, most

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        shown = [word, *(word[:n] + "*" for n in self.prefixes if len(word) > n)]
        found = self[word] = tuple(xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) & self.mask for s in shown)
        return found

    def of(self, text: str | None) -> set[int]:
        out: set[int] = set()
        out.update(*map(self.__getitem__, set(_WORD.findall((text or "").lower()))))
        return out


@dataclass
class FactorizationMachine:
    """``bias + w.x + sum over pairs i<j of <v_i, v_j> x_i x_j`` on the terms of the sample."""

    terms: np.ndarray  # sorted hashed terms
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def columns(self, found: set[int]) -> np.ndarray:
        """Places of a text's terms that the machine knows."""
        own = np.fromiter(found, np.int64, len(found))
        at = np.searchsorted(self.terms, own)
        at[at == len(self.terms)] = 0
        return at[self.terms[at] == own] if len(self.terms) else at[:0]

    def score(self, found: set[int]) -> float:
        at = self.columns(found)
        v = self.factors[at]
        pairs = 0.5 * ((v.sum(0) ** 2) - (v * v).sum(0)).sum()
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[at].sum() + pairs, -500, 500))))


def select(marked: DataFrame, most: int, least: int = 5) -> np.ndarray:
    """The terms of ``y, terms`` rows with the largest likelihood ratio between the
    classes, counted in the executors."""
    n = {r.y: float(r.n) for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = max(1.0, n.get(1, 0.0)), max(1.0, n.get(0, 0.0))
    counts = marked.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("c"))
    a, b, c = F.col("a"), F.col("c") - F.col("a"), F.col("c")

    def fit(k: Column, n: float, q: Column) -> Column:
        q = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), q))
        return k * F.log(q) + (F.lit(n) - k) * F.log(1 - q)

    both = c / (n1 + n0)
    ratio = fit(a, n1, a / n1) + fit(b, n0, b / n0) - fit(a, n1, both) - fit(b, n0, both)
    best = counts.filter(c >= least).withColumn("ratio", ratio).filter("ratio > 0").orderBy(F.col("ratio").desc(), "term").limit(most)
    return np.sort(np.array([r.term for r in best.select("term").collect()], np.int64))


def fit_machine(
    terms: np.ndarray, sets: list[set[int]], labels: np.ndarray, rows_share: float, rank: int = 8, epochs: int = 12, seed: int = 7
) -> FactorizationMachine:
    """Logistic loss, by stochastic gradients with adaptive steps.  ``rows_share`` is the
    share of positive rows among all labelled ones, which sets the bias."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), rank))
    share = min(max(rows_share, 1e-3), 1 - 1e-3)
    machine = FactorizationMachine(terms, float(np.log(share / (1 - share))), w, v)
    if not len(terms) or len(set(labels.tolist())) < 2:
        return machine
    x = np.zeros((len(sets), len(terms)), np.float32)
    for row, found in enumerate(sets):
        x[row, machine.columns(found)] = 1
    weight = np.where(labels == 1, share * len(labels) / max(1, (labels == 1).sum()), (1 - share) * len(labels) / max(1, (labels == 0).sum()))
    params = [w, v, np.array([machine.bias])]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(sets))
        for at in range(0, len(order), 256):
            rows = order[at : at + 256]
            b = x[rows].astype(float)
            bv = b @ v
            score = params[2][0] + b @ w + 0.5 * (bv**2 - (b * b) @ (v * v)).sum(1)
            e = (1 / (1 + np.exp(-np.clip(score, -500, 500))) - labels[rows]) * weight[rows] / len(rows)
            grads = (b.T @ e + 1e-4 * w, b.T @ (e[:, None] * bv) - ((b * b).T @ e)[:, None] * v + 1e-3 * v, np.array([e.sum()]))
            t += 1
            for i, (p, g) in enumerate(zip(params, grads, strict=True)):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                p -= 0.03 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    machine.bias = float(params[2][0])
    return machine


def fit_all(
    start: FactorizationMachine, sets: list[np.ndarray], labels: np.ndarray, rows_share: float, aside: np.ndarray,
    paces: tuple[tuple[bool, float, int], ...] = ((True, 0.03, 4), (False, 0.01, 16)), patience: int = 5, seed: int = 7,
) -> FactorizationMachine:
    """A machine over all terms of ``sets`` (sorted terms of each row), sparse.

    Each pace is whether to carry ``start`` on or begin with nothing learned, a damping,
    which holds back terms of few rows, and how many epochs.  Rows ``aside`` are not
    fitted on; the state with the least loss on them stands, ``start`` included."""
    if not len(sets) or not aside.any() or len(set(labels[~aside].tolist())) < 2:
        return start
    rank, size = start.factors.shape[1], np.array([len(s) for s in sets])
    begin = np.concatenate([[0], np.cumsum(size)])
    terms = np.unique(np.concatenate(sets))
    col = np.concatenate([np.searchsorted(terms, s).astype(np.int32) for s in sets])
    if not len(terms):
        return start
    weight = np.where(labels == 1, rows_share * len(labels) / max(1, (labels == 1).sum()), (1 - rows_share) * len(labels) / max(1, (labels == 0).sum()))
    fitted, held = np.nonzero(~aside)[0], np.nonzero(aside)[0]

    def scored(p: np.ndarray, part: np.ndarray, bias: float):
        n = size[part]
        row = np.repeat(np.arange(len(part)), n)
        at = col[np.repeat(begin[part] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        x = p[at]
        sums = np.stack([np.bincount(row, x[:, k], len(part)) for k in range(rank + 1)], 1)
        own = np.bincount(row, (x[:, 1:] ** 2).sum(1), len(part))
        return row, at, sums, bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - own)

    def loss(p: np.ndarray, bias: float) -> float:
        score = np.concatenate([scored(p, held[i : i + 256], bias)[3] for i in range(0, len(held), 256)])
        return float((weight[held] * (np.logaddexp(0, score) - labels[held] * score)).sum() / weight[held].sum())

    known = np.isin(start.terms, terms)
    place = np.searchsorted(terms, start.terms[known])
    alone = np.zeros((len(terms), rank + 1), np.float32)
    alone[place, 0], alone[place, 1:] = start.weights[known], start.factors[known]
    best, stands = loss(alone, start.bias), start
    for carried, damping, epochs in paces:
        rng = np.random.default_rng(seed)
        p = np.concatenate([np.zeros((len(terms), 1)), rng.normal(0, 0.01, (len(terms), rank))], 1, dtype=np.float32)
        bias = start.bias if carried else float(np.log(rows_share / (1 - rows_share)))
        if carried:
            p[place] = alone[place]
        first, second, t, since, least = np.zeros_like(p), np.zeros_like(p), 0, 0, loss(p, bias)
        for _ in range(epochs):
            order = rng.permutation(fitted)
            for i in range(0, len(order), 256):
                part = order[i : i + 256]
                row, at, sums, score = scored(p, part, bias)
                own, back = np.unique(at, return_inverse=True)
                q = p[own]
                e = ((1 / (1 + np.exp(-np.clip(score, -500, 500))) - labels[part]) * weight[part] / len(part))[row]
                total = np.bincount(back, e, len(own))
                grad = np.empty_like(q)
                grad[:, 0] = total + 1e-4 * q[:, 0]
                for k in range(1, rank + 1):
                    grad[:, k] = np.bincount(back, e * sums[row, k], len(own)) + (1e-4 - total) * q[:, k]
                t += 1
                a = first[own] = 0.9 * first[own] + 0.1 * grad
                b = second[own] = 0.999 * second[own] + 0.001 * grad * grad
                p[own] = q - 0.03 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + damping)
            now = loss(p, bias)
            since, least = (0, now) if now < least else (since + 1, least)
            if now < best:
                best, stands = now, FactorizationMachine(terms, bias, p[:, 0].astype(float), p[:, 1:].astype(float))
            if since >= patience or now > 1 + least:
                break
    return stands


def train(
    docs: DataFrame,
    labels: DataFrame,
    use: Column,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    per_class: int = 4_000,
    most_terms: int = 1_024,
    prefixes: tuple[int, ...] = (4, 5, 6, 7),
) -> FactorizationMachine:
    """Fit on at most ``per_class`` labelled rows of each class, the smallest by a hash of
    the identifier, among those for which ``use`` (over the labels' identifier) holds.
    Rows with a null label or identifier are not used."""
    known = labels.filter(use & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).cast("int").alias("y"))
    share = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = [known.filter(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(per_class) for y in (0, 1)]
    sample = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most 2 * per_class rows
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(sample.withColumnRenamed(id_col, "id"), "id")

    def features():
        terms = Terms(prefixes)
        return lambda cols: {"id": cols["id"], "y": cols["y"], "terms": [sorted(terms.of(t)) for t in cols["text"]]}

    kind = docs.schema[id_col].dataType.simpleString()
    marked = stored(map_rows(rows.select("id", "y", "text"), features, f"id {kind}, y int, terms array<int>"), "terms")
    terms = select(marked, most_terms)
    got = marked.select("y", F.xxhash64("id").alias("o"), "terms").toArrow()
    y, o, held = got["y"].to_numpy().astype(int), got["o"].to_numpy(), got["terms"].combine_chunks()
    ends = np.asarray(held.offsets, np.int64)
    rows_terms = np.split(held.values.to_numpy(), ends[1:-1]) if len(y) else []
    order = np.lexsort((y, o))
    y, sets = y[order], [rows_terms[i] for i in order]
    aside = np.random.default_rng(11).random(len(y)) < 0.15
    positive = share.get(1, 0) / max(1, sum(share.values()))
    start = fit_machine(terms, [set(sets[i][np.isin(sets[i], terms)].tolist()) for i in np.nonzero(~aside)[0]], y[~aside], positive)
    return fit_all(start, sets, y, min(max(positive, 1e-3), 1 - 1e-3), aside)


def score_documents(
    docs: DataFrame, machine: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", prefixes: tuple[int, ...] = (4, 5, 6, 7)
) -> DataFrame:
    """``doc_id, score, predicted`` for each row, from the text alone.

    A null or empty text has no terms and gets the bias's score.  Long texts are read
    whole.  Repeated rows and null identifiers pass through; an empty table gives an
    empty table; other columns are not read.
    """

    def rows():
        terms = Terms(prefixes)

        def apply(cols):
            score = [machine.score(terms.of(t)) for t in cols["text"]]
            return {"id": cols["id"], "score": score, "predicted": [int(s >= 0.5) for s in score]}

        return apply

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return map_rows(picked, rows, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)
