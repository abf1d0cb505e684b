"""Soft-membership mixing, in DataFrame operations only.

A naive Bayes classifier, fitted on a labelled table, gives each document a posterior
over domains; its scores are calibrated on the same sample.  Then nonnegative rates
``r`` are fitted so that the expected tokens of each domain, the sum over documents of
``tokens * posterior * r``, come to target weights of the whole.  That is a least-squares
problem with one unknown per document, solved by projected gradients: each step needs
the domain totals under the present rates (one distributed sum of as many numbers as
there are domains) and moves each document's rate by its own posterior.  The gradient is
taken in the norm weighted by tokens, and the residual in the metric of the domain
totals, for which a step of length one is safe: where no rate is clipped at zero the
first step already solves the problem.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import fresh, stored

#: Buckets of hashed words and of hashed word shapes.
WORDS, SHAPES = 4_096, 2_048

_SPACE = r"[\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda t: t != "")


def shape(token: Column) -> Column:
    """What a token looks like: how it begins and ends, and its length."""
    return F.xxhash64(F.left(token, F.lit(1)), F.right(token, F.lit(2)), F.least(F.length(token), F.lit(12)))


def word_bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(WORDS)).cast("int")


def shape_bucket(token: Column) -> Column:
    return F.pmod(shape(token), F.lit(SHAPES)).cast("int")


@dataclass
class Mixture:
    """A fitted classifier and, once solved, the steps that lead to the rates."""

    domains: list[str]
    words: list[list[float]]  # by domain: log-likelihood of each bucket, less the mean
    shapes: list[list[float]]
    scale: float = 1.0
    shift: list[float] = field(default_factory=list)
    steps: list[list[float]] = field(default_factory=list)
    reached: list[float] = field(default_factory=list)
    targets: list[float] = field(default_factory=list)

    @property
    def residual(self) -> float:
        """The largest gap between reached and target totals, as a share of all tokens."""
        total = sum(self.targets)
        return max((abs(a - t) for a, t in zip(self.reached, self.targets, strict=True)), default=0.0) / total if total else 0.0

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Evidence by bucket: ``wb, w0, w1, ...`` for words and ``sb, s0, s1, ...`` for
        shapes; as many rows as there are buckets."""

        def table(name: str, rows: list[list[float]]) -> DataFrame:
            lines = ",".join(f"({b}{''.join(f',{x!r}D' for x in column)})" for b, column in enumerate(zip(*rows, strict=True)))
            names = ", ".join([f"{name}b", *(f"{name}{k}" for k in range(len(rows)))])
            return stored(spark.sql(f"SELECT * FROM VALUES {lines} AS t({names})"), f"evidence-{name}")

        return table("w", self.words), table("s", self.shapes)

    def posterior(self, scores: Column) -> Column:
        raised = [F.get(scores, F.lit(k)) * self.scale + self.shift[k] for k in range(len(self.domains))]
        top = F.greatest(*raised) if len(raised) > 1 else raised[0]
        parts = F.array(*(F.exp(x - top) for x in raised))
        whole = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
        return F.transform(parts, lambda x: x / whole)

    def rate(self, posterior: Column) -> Column:
        """The rate of a document, by its posterior: from one, all steps in turn."""
        r = F.lit(1.0)
        for step in self.steps:
            move = sum((F.get(posterior, F.lit(k)) * y for k, y in enumerate(step)), F.lit(0.0))
            r = F.greatest(F.lit(0.0), r - move)
        return r


def train(
    docs: DataFrame, labelled: DataFrame, domain_col: str, id_col: str = "doc_id", text_col: str = "text",
    per_domain: int = 1_000, max_domains: int = 32,
) -> Mixture:
    """Fit on at most ``per_domain`` labelled rows of each domain, the smallest by a hash
    of the identifier.  Null identifiers and domains are not used; more than
    ``max_domains`` domains are refused.  What reaches the driver is counts by bucket and
    one score per sampled row and domain."""
    known = labelled.filter(F.col(id_col).isNotNull() & F.col(domain_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(domain_col).cast("string").alias("domain"))
    shares = {r.domain: r.n for r in known.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).limit(max_domains + 1).collect()}
    if len(shares) > max_domains:
        raise ValueError(f"more than {max_domains} domains")
    domains = sorted(shares)
    if not domains:
        return Mixture(["all"], [[0.0] * WORDS], [[0.0] * SHAPES], shift=[0.0])
    drawn = None
    for d in domains:
        part = known.filter(F.col("domain") == d).orderBy(F.xxhash64("id"), "id").limit(per_domain)
        drawn = part if drawn is None else drawn.unionByName(part)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    sample = stored(rows.join(F.broadcast(drawn), "id"), "labelled")  # at most per_domain rows of each domain

    spread = sample.select("domain", F.explode(tokens(F.col("text"))).alias("t"))

    def counts(bucket: Column, buckets: int) -> list[list[float]]:
        n = {d: [1.0] * buckets for d in domains}
        for r in spread.groupBy("domain", bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect():
            n[r.domain][r.b] += r.n
        logs = [[log(x / sum(n[d])) for x in n[d]] for d in domains]
        mean = [sum(column) / len(domains) for column in zip(*logs, strict=True)]
        return [[x - m for x, m in zip(row, mean, strict=True)] for row in logs]

    mixture = Mixture(domains, counts(word_bucket(F.col("t")), WORDS), counts(shape_bucket(F.col("t")), SHAPES), shift=[0.0] * len(domains))
    scored = scored_rows(sample, mixture, "domain").select("domain", "scores", F.xxhash64("id").alias("o")).collect()
    scored.sort(key=lambda r: (r.domain, r.o))
    whole = sum(shares.values())
    per = {d: sum(r.domain == d for r in scored) for d in domains}
    weight = {d: shares[d] / whole / max(1, per[d]) for d in domains}
    _calibrate(mixture, [(r.scores, domains.index(r.domain), weight[r.domain]) for r in scored], [shares[d] / whole for d in domains])
    return mixture


def _calibrate(mixture: Mixture, rows: list[tuple[list[float], int, float]], shares: list[float], rounds: int = 40, pace: float = 0.5) -> None:
    """One scale and a shift for each domain, by gradient steps on the weighted log loss."""
    scale, shift = 0.5, [log(max(s, 1e-6)) for s in shares]
    g2 = [1e-8] * (1 + len(shift))
    for _ in range(rounds):
        down = [0.0] * (1 + len(shift))
        for s, y, w in rows:
            raised = [scale * x + b for x, b in zip(s, shift, strict=True)]
            top = max(raised)
            e = [exp(x - top) for x in raised]
            z = sum(e)
            for k in range(len(shift)):
                d = w * (e[k] / z - (k == y))
                down[0] += d * s[k]
                down[1 + k] += d
        g2 = [a + d * d for a, d in zip(g2, down, strict=True)]
        scale = max(0.01, scale - pace * down[0] / g2[0] ** 0.5)
        shift = [b - pace * d / a**0.5 for b, d, a in zip(shift, down[1:], g2[1:], strict=True)]
    mixture.scale, mixture.shift = scale, shift


def scored_rows(rows: DataFrame, mixture: Mixture, *beside: str) -> DataFrame:
    """``id, mark, n_tokens, scores`` (and other columns) for each row of ``id, text``: the
    evidence of all tokens, scaled by the square root of their number.  Tokens are summed
    in the task that reads the text; what is shuffled is a row for each text."""
    keys = ["row", "id", "mark", *beside]
    words, looks = mixture.tables(rows.sparkSession)
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", F.xxhash64("text").alias("mark"), *beside, tokens(F.col("text")).alias("ts"))
    each = numbered.select(*keys, F.explode_outer("ts").alias("t"))
    named = each.select(*keys, "t", word_bucket(F.col("t")).alias("wb"), shape_bucket(F.col("t")).alias("sb"))
    found = named.join(F.broadcast(words), "wb", "left").join(F.broadcast(looks), "sb", "left")  # a row for each bucket
    sums = [F.coalesce(F.sum(F.col(f"w{k}") + F.col(f"s{k}")), F.lit(0.0)).alias(f"s{k}") for k in range(len(mixture.domains))]
    summed = found.groupBy(*keys).agg(F.count("t").alias("n_tokens"), *sums)
    root = F.sqrt(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"))
    return summed.select("id", "mark", *beside, "n_tokens", F.array(*(F.col(f"s{k}") / root for k in range(len(sums)))).alias("scores"))


def membership(docs: DataFrame, mixture: Mixture, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, mark, n_tokens, posterior`` for each row; ``mark`` is a hash of the text.

    Null and empty texts have no tokens and the prior; long texts are read whole; repeated
    rows and null identifiers pass through; an empty table gives an empty table; other
    columns are not read."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return scored_rows(rows, mixture).select("id", "mark", "n_tokens", mixture.posterior(F.col("scores")).alias("posterior"))


def _solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """A small symmetric system, by elimination with pivots."""
    n = len(right)
    a = [[*row, b] for row, b in zip(matrix, right, strict=True)]
    for i in range(n):
        p = max(range(i, n), key=lambda j: abs(a[j][i]))
        a[i], a[p] = a[p], a[i]
        for j in range(i + 1, n):
            f = a[j][i] / a[i][i] if a[i][i] else 0.0
            a[j] = [x - f * y for x, y in zip(a[j], a[i], strict=True)]
    out = [0.0] * n
    for i in reversed(range(n)):
        rest = a[i][n] - sum(a[i][j] * out[j] for j in range(i + 1, n))
        out[i] = rest / a[i][i] if a[i][i] else 0.0
    return out


def solve(members: DataFrame, mixture: Mixture, weights: dict[str, float], rounds: int = 40, close: float = 1e-7, warn: float = 1e-3) -> Mixture:
    """Fit the rates to ``weights`` (by domain; scaled to sum one) of all tokens.  The sums
    run over all rows; the driver keeps a few numbers per domain and step.  Where targets
    can't be met (a domain that no document belongs to), rates end at the nearest totals
    that ``rounds`` steps reach; ``residual`` of the mixture says how far off, and a
    warning is given if that is more than ``warn``.  Without tokens every rate is one."""
    k = len(mixture.domains)
    whole = sum(weights.get(d, 0.0) for d in mixture.domains) or 1.0
    n, p = F.col("n_tokens").cast("double"), [F.get("posterior", F.lit(i)) for i in range(k)]
    sums = members.agg(
        F.coalesce(F.sum(n), F.lit(0.0)).alias("n"),
        *(F.coalesce(F.sum(n * p[i] * p[j]), F.lit(0.0)).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)),
    ).first()
    total = sums["n"]
    mixture.targets = [total * weights.get(d, 0.0) / whole for d in mixture.domains]
    gram = [[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]
    ridge = 1e-9 * (sum(gram[i][i] for i in range(k)) or 1.0)
    for i in range(k):
        gram[i][i] += ridge
    for step in range(rounds + 1):
        r = mixture.rate(F.col("posterior"))
        got = members.agg(*(F.coalesce(F.sum(n * p[i] * r), F.lit(0.0)).alias(f"t{i}") for i in range(k))).first()
        mixture.reached = list(got)
        off = [a - t for a, t in zip(got, mixture.targets, strict=True)]
        if not total or max(map(abs, off)) <= close * total or step == rounds:
            break
        mixture.steps.append(_solved(gram, off))
    if mixture.residual > warn:
        warnings.warn(f"the weights are missed by {mixture.residual:.3g} of all tokens", stacklevel=2)
    return mixture


def mix_documents(
    docs: DataFrame, labelled: DataFrame, domain_col: str, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, posterior, rate`` for each row; ``posterior`` follows the sorted
    names of the domains.

    A null or empty text has no tokens, the prior as its posterior, and the rate that
    goes with it.  Weights of unknown domains are left out.  Without labelled rows there
    is one domain and every rate is one.  Repeated rows and null identifiers pass
    through; an empty table gives an empty table; other columns are not read.
    """
    mixture = train(docs, labelled, domain_col, id_col, text_col)
    members = stored(membership(docs, mixture, id_col, text_col), "membership")
    solve(members, mixture, weights if len(mixture.domains) > 1 or mixture.domains[0] in weights else {d: 1.0 for d in mixture.domains})
    return members.select(F.col("id").alias(id_col), "n_tokens", "posterior", mixture.rate(F.col("posterior")).alias("rate"))


def drawn(docs: DataFrame, members: DataFrame, mixture: Mixture, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` at their rates, all columns kept: each row stands ``floor(rate + u)`` times,
    with ``u`` in 0..1 by a hash of identifier and text.

    Null and empty texts have the prior's rate; rows with the same identifier and text
    stand alike; null identifiers and columns of any name pass through; an empty table
    stays empty.
    """
    u = F.pmod(F.xxhash64("id", "mark"), F.lit(1 << 30)) / float(1 << 30)
    times = members.groupBy("id", "mark").agg(F.first(F.floor(mixture.rate(F.col("posterior")) + u).cast("int")).alias("times"))
    a, b = docs.alias("a"), times.alias("b")
    same = docs[id_col].eqNullSafe(F.col("b.id")) & F.xxhash64(docs[text_col]).eqNullSafe(F.col("b.mark"))
    stood = a.join(b, same).filter("b.times > 0")
    each = F.explode(F.sequence(F.lit(1), F.col("b.times")))
    return stood.select("a.*", each.alias(fresh(docs, "time"))).select(*docs.columns)
