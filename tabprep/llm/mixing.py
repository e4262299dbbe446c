"""Rates that bring the expected token totals of softly assigned domains to their targets."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.llm.common import materialize

#: Labelled documents that the classifier is fitted on at most.
LABELLED_ROWS = 20_000
#: Characters whose shares of a text the classifier sees.
CHARACTERS = "abcdefghiklmnoprstuvwyz" + "äöüßéèêçàñíóú"


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    return F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def _shares(text: Column) -> list[Column]:
    """Bytes lost with a character over its own bytes say how often it is there; characters beyond ASCII are looked for
    in what is left of the text without ASCII."""
    size = F.greatest(F.length(text), F.lit(1))
    beyond = F.regexp_replace(text, "[\\x00-\\x7F]+", "")
    found = []
    for c in CHARACTERS:
        where, width = (text, 1) if c.isascii() else (beyond, len(c.encode()))
        found.append((F.octet_length(where) - F.octet_length(F.replace(where, F.lit(c)))) / F.lit(width) / size)
    return found


@dataclass(frozen=True)
class Domains:
    """Linear scores of each domain; their softmax is the posterior."""

    names: tuple[str, ...]
    offsets: tuple[float, ...]
    slopes: tuple[tuple[float, ...], ...]

    def posteriors(self, shares: list[Column]) -> list[Column]:
        scores = []
        for offset, slope in zip(self.offsets, self.slopes, strict=True):
            total = F.lit(offset)
            for share, s in zip(shares, slope, strict=True):
                total = total + share * F.lit(s)
            scores.append(total)
        top = F.greatest(*scores) if len(scores) > 1 else scores[0]
        return [F.exp(s - top) for s in scores]


def fit_domains(docs: DataFrame, labelled: DataFrame, names: list[str], rows: int = LABELLED_ROWS, temper: float = 0.1) -> Domains:
    """Gaussian classes with one spread per character share, from at most ``rows`` rows of ``labelled`` (doc_id, domain).

    Rows with a null id or a domain that is not in ``names`` are no labels. Domains without labelled documents keep
    the prior of one document at the overall mean. Shares depend on each other, so scores are multiplied by ``temper``.
    """
    some = labelled.filter(F.col("doc_id").isNotNull() & F.col("domain").isin(*names)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    known = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("domain", *[s.alias(f"x{i}") for i, s in enumerate(_shares(text))])
    n = len(CHARACTERS)
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(n)] + [F.sum(F.col(f"x{i}") ** 2).alias(f"q{i}") for i in range(n)]
    found = {r["domain"]: r for r in known.groupBy("domain").agg(F.count("*").alias("n"), *sums).collect()}
    total = sum(r["n"] for r in found.values()) or 1
    overall = [sum(r[f"s{i}"] for r in found.values()) / total for i in range(n)]
    means = {k: [found[k][f"s{i}"] / found[k]["n"] for i in range(n)] if k in found else overall for k in names}
    spread = [
        max(1e-7, sum(r[f"q{i}"] - r[f"s{i}"] ** 2 / r["n"] for r in found.values()) / total) for i in range(n)
    ]
    offsets, slopes = [], []
    for k in names:
        prior = (found[k]["n"] if k in found else 0) + 1
        offsets.append(math.log(prior) - temper * sum(m * m / v for m, v in zip(means[k], spread, strict=True)) / 2)
        slopes.append(tuple(temper * m / v for m, v in zip(means[k], spread, strict=True)))
    return Domains(tuple(names), tuple(offsets), tuple(slopes))


def with_posteriors(docs: DataFrame, domains: Domains, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``_n_tokens`` and a posterior ``_p<i>`` for each domain. A text without letters has the prior's."""
    clean = F.lower(F.coalesce(F.col(text), F.lit("")))
    shares = _shares(F.col("_clean"))
    seen = docs.withColumn("_clean", clean)
    seen = seen.select(*keep, word_count(F.col("_clean")).alias("_n_tokens"), *[s.alias(f"_x{i}") for i, s in enumerate(shares)])
    parts = domains.posteriors([F.col(f"_x{i}") for i in range(len(shares))])
    seen = seen.select(*keep, "_n_tokens", *[p.alias(f"_e{k}") for k, p in enumerate(parts)])
    total = sum((F.col(f"_e{k}") for k in range(1, len(parts))), F.col("_e0"))
    return seen.select(*keep, "_n_tokens", *[(F.col(f"_e{k}") / total).alias(f"_p{k}") for k in range(len(parts))])


def rate(steps: list[list[float]]) -> Column:
    """The rate of a document after the given steps: start at 1, move along its posteriors, never below 0."""
    value = F.lit(1.0)
    for step in steps:
        moved = value
        for k, g in enumerate(step):
            moved = moved - F.col(f"_p{k}") * F.lit(float(g))
        value = F.greatest(F.lit(0.0), moved)
    return value


def fit_rates(seen: DataFrame, targets: list[float], most_steps: int = 30, error: float = 1e-4) -> list[list[float]]:
    """Projected gradient on the weighted least squares of the expected domain totals; returns the steps.

    Each step is one aggregation over all documents; a document's rate follows from its posteriors and the steps so
    far, so no rate is stored. Domains are weighed by the inverse of their own squared mass and documents by their
    length; the step size is the inverse of the largest eigenvalue. A domain without mass cannot be reached and is left out.
    """
    k = len(targets)
    tokens = F.col("_n_tokens")
    gram_sums = [F.sum(tokens * F.col(f"_p{i}") * F.col(f"_p{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    row = seen.agg(F.sum(tokens).alias("t"), *gram_sums).first()
    total = float(row["t"] or 0)
    gram = [[float(row[f"g{min(i, j)}_{max(i, j)}"] or 0) for j in range(k)] for i in range(k)]
    weight = [1 / gram[i][i] if gram[i][i] > 1e-9 * max(total, 1) else 0.0 for i in range(k)]
    vector = [1.0] * k
    largest = 1.0
    for _ in range(50):  # power iteration on a matrix of domains
        vector = [math.sqrt(weight[i]) * sum(gram[i][j] * math.sqrt(weight[j]) * vector[j] for j in range(k)) for i in range(k)]
        largest = max(map(abs, vector)) or 1.0
        vector = [v / largest for v in vector]
    share = sum(targets) or 1.0
    goals = [total * t / share for t in targets]
    steps: list[list[float]] = []
    for _ in range(most_steps):
        sums = seen.select(tokens, *[f"_p{i}" for i in range(k)], rate(steps).alias("_rate")).agg(
            *[F.sum(tokens * F.col(f"_p{i}") * F.col("_rate")).alias(f"m{i}") for i in range(k)]
        ).first()
        off = [float(sums[f"m{i}"] or 0) - goals[i] if weight[i] else 0.0 for i in range(k)]
        if max(map(abs, off), default=0.0) <= error * max(total, 1):
            break
        steps.append([weight[i] * off[i] / largest for i in range(k)])
    return steps


def copies(rate_column: Column, *identity: str) -> Column:
    """Whole copies of a document: the rate rounded up with the chance of its fraction, by a hash of the row."""
    chance = F.pmod(F.xxhash64(*identity, F.lit(17)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    return (F.floor(rate_column) + F.when(chance < rate_column - F.floor(rate_column), 1).otherwise(0)).cast("int")


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], rows: int = LABELLED_ROWS) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate and copies of each document.

    Null and empty texts have no tokens, the prior's posteriors and a rate like any other. Repeated rows count each.
    An empty table gives no rows.
    """
    domains = fit_domains(docs, labelled, list(targets), rows)
    seen = materialize(with_posteriors(docs, domains, ["doc_id"]))
    steps = fit_rates(seen, list(targets.values()))
    names = [F.col(f"_p{k}").alias(f"p_{name}") for k, name in enumerate(targets)]
    rated = seen.select("doc_id", F.col("_n_tokens").alias("n_tokens"), *names, rate(steps).alias("rate"))
    return rated.withColumn("copies", copies(F.col("rate"), "doc_id"))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], rows: int = LABELLED_ROWS) -> DataFrame:
    """The columns of ``docs``, whatever their names, each row as often as its rate says.

    Rows and their posteriors are written once; the steps read only the posteriors.
    """
    domains = fit_domains(docs, labelled, list(targets), rows)
    plain = [f"c{i}" for i in range(len(docs.columns))]
    text, doc_id = (plain[docs.columns.index(n)] for n in ("text", "doc_id"))
    seen = materialize(with_posteriors(docs.toDF(*plain), domains, plain, text))
    steps = fit_rates(seen, list(targets.values()))
    rated = seen.withColumn("_copies", copies(rate(steps), doc_id, text))
    many = rated.withColumn("_copy", F.explode(F.when(F.col("_copies") > 0, F.sequence(F.lit(1), F.col("_copies")))))
    return many.select(*plain).toDF(*docs.columns)
