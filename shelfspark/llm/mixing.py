"""Mixing sources to target weights with soft membership.

A classifier fitted on labelled rows gives each document a posterior over domains (naive Bayes over
hashed byte pairs of the text). With t the document's tokens and p its posterior, a document taken
at rate r adds r * t * p to the domains' expected tokens. The rates are nonnegative and minimise the
squared distance of those totals from their targets, by projected gradient steps from rate 1:

    r <- max(0, r - p . G^-1 (totals - targets)),   G = sum of t * p * p'

(the distance is measured in the norm of G^-1, in which the step 1 is exact until a rate reaches 0).
A step is one distributed sum of as many numbers as there are domains; only those reach the driver.
A task recomputes its rates from the few residuals of the steps before, so no rates are stored.

Rates become whole copies by a hash of the document id: r is kept in expectation. Without given
weights the rates are held at 1 or more instead of 0, so mixing repeats documents of scarce domains and
throws none away. The targets' total is the smallest that asks no domain to shrink and no document to
fall below that bound: as G 1 is the tokens there are, shares s of a total W are met by the rates
W * p . G^-1 s, so W is 1 over the smallest p . G^-1 s of all documents. Where that asks for more than
MOST_RAISE times the tokens, or no total will do, the bound alone holds, and the fit says in a warning
how far off its targets it ends.

Defined cases: null text is empty and has no tokens; its posterior is the prior. Repeated rows are
weighed each. Without labels there is one domain and every rate is 1. Domains without a target keep
their tokens. More than MOST_DOMAINS domains are refused (the driver holds FEATURES numbers for each, and
their square). An empty table gives no rows. Extra columns are ignored by ``rates`` and kept by ``mix``.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfspark.llm.common import read, slices, stored, text_bytes, text_of
from shelfspark.llm.registry import query

FIT_ROWS = 4000
FEATURES = 4096
# Byte pairs of one text are not independent: evidence levels off at this many.
EVIDENCE = 40.0
STEPS = 30
MOST_RAISE = 2.0
MOST_DOMAINS = 500
# Texts whose counts are held at a time: 16 MB.
COUNTED = 256
TOLERANCE = 1e-6
# Scarce domains get shares by this power of their own ones.
TEMPERATURE = 0.7


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.int64)
    table[65:91] += 32
    return table


_LOWER = _lower_table()


def pair_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, FEATURES) counts of hashed pairs of lower-cased bytes."""
    n = len(at) - 1
    low = _LOWER[data]
    own = np.repeat(np.arange(n), np.diff(at))
    pair = ((low[:-1] * 256 + low[1:]) * 40503 >> 4) & (FEATURES - 1)
    inside = own[:-1] == own[1:]
    return np.bincount(own[:-1][inside] * FEATURES + pair[inside], minlength=n * FEATURES).reshape(n, FEATURES)


@dataclass
class Domains:
    """Domain names, their log priors, and the log chances of byte pairs (FEATURES x domains)."""

    names: list[str]
    prior: np.ndarray
    chances: np.ndarray

    def posteriors(self, texts: pa.Array) -> np.ndarray:
        """A row for each text; texts are counted a few at a time, as each takes FEATURES numbers twice."""
        blocks = [self._posteriors(texts.slice(i, COUNTED)) for i in range(0, len(texts), COUNTED)]
        return np.concatenate(blocks) if blocks else np.zeros((0, len(self.names)))

    def _posteriors(self, texts: pa.Array) -> np.ndarray:
        counts = pair_counts(*text_bytes(texts))
        total = counts.sum(axis=1, keepdims=True)
        logits = self.prior + (counts @ self.chances) / (1 + total / EVIDENCE)
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)


def fit_domains(labelled: DataFrame, domain: str = "domain", text: str = "text") -> Domains:
    """Learn from all labelled rows, adding up in their tasks; what is learnt has a fixed size."""
    known = labelled.select(F.col(f"`{domain}`").cast("string").alias("domain"), text_of(text).alias("text"))
    known = known.filter(F.col("domain").isNotNull())

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = pair_counts(*text_bytes(part.column(1)))
                names = np.asarray(part.column(0).to_pylist(), dtype=object)
                for name in sorted(set(names)):
                    mine = found[names == name]
                    used = np.flatnonzero(mine.sum(axis=0))
                    features = np.append(used, -1)  # -1 counts the rows
                    yield pa.RecordBatch.from_pydict(
                        {
                            "domain": [name] * len(features),
                            "feature": features,
                            "n": np.append(mine.sum(axis=0)[used], len(mine)).astype(float),
                        }
                    )

    if known.select("domain").distinct().limit(MOST_DOMAINS + 1).count() > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    # FEATURES + 1 sums for each domain
    sums = known.mapInArrow(counts, "domain string, feature long, n double")
    got = sums.groupBy("domain", "feature").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(got["domain"].unique()) or ["all"]
    table = np.full((FEATURES + 1, len(names)), 0.1)
    for k, name in enumerate(names):
        mine = got[got["domain"] == name]
        table[mine["feature"].to_numpy(), k] += mine["n"].to_numpy()
    return Domains(names, np.log(table[-1] / table[-1].sum()), np.log(table[:-1] / table[:-1].sum(axis=0)))


@dataclass
class Mixture:
    """The classifier and the gradient steps that lead to the rates."""

    domains: Domains
    targets: np.ndarray
    before: np.ndarray
    after: np.ndarray
    steps: list[np.ndarray] = field(default_factory=list)
    least: float = 0.0

    def rates(self, posteriors: np.ndarray) -> np.ndarray:
        r = np.ones(len(posteriors))
        for step in self.steps:
            r = np.maximum(self.least, r - posteriors @ step)
        return r


def tokens_of(text: Column) -> Column:
    """Words between blanks."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("bigint")


def memberships(docs: DataFrame, domains: Domains, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens, p): the narrow table that the rates are fitted on."""

    @F.pandas_udf("array<double>")
    def posterior(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            batch = pa.RecordBatch.from_arrays([pa.array(series, pa.large_string(), from_pandas=True)], names=["text"])
            yield pd.Series([p for part in slices(batch, "text") for p in domains.posteriors(part.column(0))], dtype=object)

    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    return rows.select("doc_id", tokens_of(F.col("text")).alias("tokens"), posterior("text").alias("p"))


def _sums(members: DataFrame, mixture: Mixture) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens of each domain at the present rates, and G."""
    k = len(mixture.domains.names)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, gram = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                t = np.asarray(batch.column(0), dtype=float)
                p = np.asarray(batch.column(1).flatten()).reshape(-1, k)
                totals += (mixture.rates(p) * t) @ p
                gram += (p * t[:, None]).T @ p
        flat = np.concatenate([totals, gram.ravel()])
        yield pa.RecordBatch.from_pydict({"at": np.arange(len(flat)), "n": flat})

    parts = members.select("tokens", "p").mapInArrow(partial, "at long, n double")
    got = parts.groupBy("at").agg(F.sum("n").alias("n")).toPandas().sort_values("at")["n"].to_numpy()
    flat = got if len(got) else np.zeros(k + k * k)
    return flat[:k], flat[k:].reshape(k, k)


def default_weights(totals: np.ndarray, temperature: float = TEMPERATURE) -> np.ndarray:
    powered = np.where(totals > 0, np.maximum(totals, 1e-300) ** temperature, 0.0)
    return powered / powered.sum() if powered.sum() else powered


def _lowest(members: DataFrame, u: np.ndarray) -> float | None:
    """The smallest p . u of all documents; none without documents."""
    each = F.zip_with("p", F.array(*[F.lit(float(x)) for x in u]), lambda a, b: a * b)
    return members.agg(F.min(F.aggregate(each, F.lit(0.0), lambda a, b: a + b))).first()[0]


def fit_mixture(
    members: DataFrame,
    domains: Domains,
    weights: dict[str, float] | None = None,
    steps: int = STEPS,
    tolerance: float = TOLERANCE,
    least: float | None = None,
) -> Mixture:
    """Find the steps to rates whose expected domain tokens are the targets.

    ``weights`` are shares by domain name; without them, scarce domains gain by TEMPERATURE. Rates stay
    at ``least`` or above: 0 with given weights, 1 without. The total is the smallest that no domain has
    to shrink for, raised as far as a bound above 0 asks for. Targets that no rates reach (a domain no
    document belongs to alone, a share of 0) are met as nearly as can be, with a warning.
    """
    k = len(domains.names)
    least = (1.0 if weights is None else 0.0) if least is None else least
    mixture = Mixture(domains, np.zeros(k), np.zeros(k), np.zeros(k), least=least)
    totals, gram = _sums(members, mixture)
    share = default_weights(totals)
    if weights is not None:
        share = np.array([weights.get(name, 0.0) for name in domains.names])
        share = share / share.sum()
    held = share > 0
    whole = (totals[held] / share[held]).max() if held.any() else 0.0
    inverse = np.linalg.pinv(gram, rcond=1e-9)
    if least > 0 and held.any() and not totals[~held].any():
        lowest = _lowest(members, inverse @ share)
        if lowest is not None and lowest > 0 and least / lowest <= MOST_RAISE * whole:
            whole = max(whole, least / lowest)
    before = totals
    targets, last = np.where(held, share * whole, before), None
    size = max(targets.sum(), 1.0)
    for _ in range(steps):
        if np.abs(totals - targets).max() <= tolerance * size:
            break
        # a bound may hold the rates: as near as they get
        if last is not None and np.abs(totals - last).max() <= tolerance * 1e-3 * size:
            break
        last = totals
        mixture.steps.append(inverse @ (totals - targets))
        totals, _ = _sums(members, mixture)
    off = np.abs(totals - targets).max() / size
    if off > tolerance:
        warnings.warn(f"domain totals end off their targets, by up to {off:.2g} of all tokens", stacklevel=2)
    mixture.before, mixture.targets, mixture.after = before, targets, totals
    return mixture


def copies_of(rate: Column, key: Column, salt: int = 0) -> Column:
    """Whole copies whose mean over ids is the rate."""
    chance = F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # a rate a hair under a whole number, as rounding leaves it, is that number
    whole = F.floor(rate + F.lit(1e-4))
    return (whole + (chance < rate - whole).cast("int")).cast("bigint")


def rates(members: DataFrame, mixture: Mixture) -> DataFrame:
    """(doc_id, tokens, domain, membership, rate, copies) of every row."""

    @F.pandas_udf("double")
    def rate(p: pd.Series) -> pd.Series:
        return pd.Series(mixture.rates(np.array(p.tolist()).reshape(len(p), -1)))

    names = F.array(*[F.lit(n) for n in mixture.domains.names])
    best = F.array_position("p", F.array_max("p")).cast("int")
    rated = members.select(
        "doc_id", "tokens", F.element_at(names, best).alias("domain"), F.array_max("p").alias("membership"), rate("p").alias("rate")
    )
    return rated.withColumn("copies", copies_of(F.col("rate"), F.col("doc_id")))


def mix(docs: DataFrame, mixture: Mixture, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, each as many times as its rate asks for."""

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            batch = pa.RecordBatch.from_arrays([pa.array(series, pa.large_string(), from_pandas=True)], names=["text"])
            parts = [mixture.rates(mixture.domains.posteriors(s.column(0))) for s in slices(batch, "text")]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    copies = copies_of(rate(text_of(text)), F.col(f"`{key}`").cast("bigint"))
    repeated = F.array_repeat(F.lit(0), copies.cast("int"))
    # the row in one struct: no column of it can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), repeated.alias("copies"))
    return rows.select("row", F.explode("copies")).select("row.*")


def labelled_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(domain, text) of documents in the label table, their language as the domain.

    At most ``fit_rows`` ids are taken, those with the smallest hash, so they can be broadcast.
    """
    ids = labels.select(F.col("doc_id").alias("__labelled")).filter("__labelled is not null").distinct()
    few = ids.orderBy(F.xxhash64("__labelled"), "__labelled").limit(fit_rows)
    same = F.col("doc_id") == F.col("__labelled")
    return docs.join(F.broadcast(few), same, "left_semi").select(F.col("lang").alias("domain"), "text")


@query("op8_soft_mixing")
def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's domain, rate and copies."""
    docs = read(spark, sf_dir, "documents")
    domains = fit_domains(labelled_documents(docs, read(spark, sf_dir, "labels")))
    members = stored(memberships(docs, domains), "mixing-members")
    return rates(members, fit_mixture(members, domains))
