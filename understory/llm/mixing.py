"""Mixing documents to target weights with soft domain membership.

A classifier trained on the labels table gives every document its chances of
belonging to each domain. Rates, one for each document and not negative, are
fitted by projected gradient so that the domains' expected token totals,
sum of rate x tokens x chance, match the targets in the least-squares sense.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from understory.sources.shared import cut_lineage

# Domains are the pairs of labels (quality, toxic).
DOMAINS = ("low", "low_toxic", "good", "good_toxic")
TARGETS = {"low": 0.10, "low_toxic": 0.01, "good": 0.88, "good_toxic": 0.01}  # shares of the mixed tokens
FEATURES = 1 << 15
SAMPLE_ROWS = 20_000  # labelled documents the classifier is fitted on, at most, by the order of a hash
FIT_TASKS = 4  # the sample is bounded, and so are the tasks of a pass over it: their sums meet in one stage
REGULARIZATION = 1e-3
STEPS = 30
TOLERANCE = 1e-4  # of the targets, at which steps end


def _words(text: str) -> Column:
    """Lower-case runs of other than white space."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), "").alias("_words")


def _vectors(frame: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="_words", outputCol="_vector").transform(frame)


def fit_domains(docs: DataFrame, labels: DataFrame) -> LogisticRegressionModel | None:
    """A multinomial classifier of domains; None where no row is labelled. Rows that lack a label are not used."""
    known = labels.select("doc_id", "quality", "toxic").dropna().where("quality in (0, 1) and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg((2 * F.max("quality") + F.max("toxic")).cast("double").alias("_label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("_label", _words("text"))
    rows = cut_lineage(_vectors(rows).select("_vector", "_label"))
    if rows.isEmpty():
        return None
    return LogisticRegression(
        featuresCol="_vector", labelCol="_label", family="multinomial", maxIter=20, regParam=REGULARIZATION,
        standardization=False, probabilityCol="_chances",
    ).fit(rows.coalesce(FIT_TASKS))


def domain_chances(docs: DataFrame, model: LogisticRegressionModel | None, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns ``carry``, n_tokens and p_<domain> columns; without a model all domains are alike."""
    carried = F.struct(F.lit(True).alias("_there"), *carry).alias("_carried")
    keep = ["doc_id", *[F.col(f"_carried.{c}").alias(c) for c in carry], F.size("_words").cast("long").alias("n_tokens")]
    words = docs.select("doc_id", carried, _words("text"))
    if model is None:
        even = [F.lit(1.0 / len(DOMAINS)).alias(f"p_{d}") for d in DOMAINS]
        return words.select(*keep, *even)
    rows = _vectors(words)
    chances = vector_to_array("_chances")
    # labels that never occur at the end of the list have no chance in the model
    picked = [F.coalesce(F.get(chances, F.lit(i)), F.lit(0.0)).alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    return model.transform(rows).select(*keep, *picked)


def _rates(shares: np.ndarray, slopes: np.ndarray) -> np.ndarray:
    """The rates of rows of ``shares`` after the steps; the same operations in the same order as ``_rate``."""
    rate = np.ones(len(shares))
    for step in slopes:
        slope = np.zeros(len(shares))
        for k, s in enumerate(step):
            slope += s * shares[:, k]
        rate = np.maximum(0.0, rate - slope)
    return rate


def _rate(shares: list[Column], slopes: list[list[float]]) -> Column:
    """One and then, step by step, less the gradient and not below zero."""
    if not slopes:
        return F.lit(1.0)
    moves = F.lit(np.array(slopes).ravel().tolist())
    vector = F.array(*shares)

    def move(r: Column, i: Column) -> Column:
        slope = sum((F.element_at(moves, i * len(shares) + k + 1) * vector[k] for k in range(len(shares))), F.lit(0.0))
        return F.greatest(F.lit(0.0), r - slope)

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(slopes) - 1)), F.lit(1.0), move)


def fit_rates(docs: DataFrame, targets: dict[str, float], tokens: str = "n_tokens") -> tuple[Column, np.ndarray]:
    """(the rate as a column over ``docs``, the totals it reaches).

    ``docs`` has ``tokens`` and p_<domain>, where null counts as none; it is scanned once a
    step, each task returns one row of sums by domain and by pair of domains, and nothing
    else leaves the executors. A document's rate after any step follows from the slopes of
    the steps so far, so no rate is stored. A step is one stage without a shuffle or a
    compiled plan of its own: there are many, and the driver keeps what it plans.
    The totals are divided by their targets, so a small domain counts like a large one,
    and residuals are measured in the metric of the documents whose rates can move, in
    which a unit step is the longest safe one; targets that rates can reach are reached
    whatever the metric.
    """
    names = [d for d in targets if targets[d] > 0]
    goal = np.array([targets[d] for d in names], float)
    none = F.lit(0.0)
    share = [F.coalesce(F.col(tokens) * F.col(f"p_{d}") / F.lit(float(targets[d])), none) for d in names]
    scale = docs.agg(F.max(F.col(tokens)).cast("double")).first()[0] or 0.0
    if not names or scale <= 0:
        return F.lit(1.0), np.zeros(len(names))
    n = len(names)
    shares = docs.select([x.alias(f"_{k}") for k, x in enumerate(share)])

    def sums_after(slopes: np.ndarray):
        def of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = np.zeros(n + n * n)
            for batch in batches:
                x = batch.to_numpy(float)
                rate = _rates(x, slopes)
                found[:n] += rate @ x
                moving = x[rate > 0]
                found[n:] += (moving.T @ moving).ravel()
            yield pd.DataFrame({"sums": [found]})

        return of_task

    slopes: list[list[float]] = []  # of each step, by domain
    for step in range(STEPS + 1):
        parts = shares.mapInPandas(sums_after(np.array(slopes).reshape(-1, n)), "sums array<double>").collect()
        found = np.nan_to_num(np.array([r["sums"] for r in parts], float).reshape(-1, n + n * n).sum(axis=0))
        totals, gram = found[:n], found[n:].reshape(n, n)
        residual = totals - 1.0
        if step == STEPS or np.abs(residual).max() <= TOLERANCE:
            break
        spread, axes = np.linalg.eigh(gram)
        metric = axes @ np.diag(1 / np.maximum(spread, max(spread[-1], 1e-300) * 1e-9)) @ axes.T
        slopes.append((metric @ residual).tolist())
    return _rate(share, slopes), totals * goal


def mix_to_targets(docs: DataFrame, labels: DataFrame, shares: dict[str, float] | None = None,
                   total_tokens: float | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>..., rate), one row for every row of ``docs``.

    Columns named in ``carry`` stand after the doc_id, so a row without an id, or with one of several rows, keeps its
    text; a carried column may not have a name of the result.
    ``n_tokens`` counts runs of other than white space; null and empty texts have
    none and keep the rate 1. The targets are ``shares`` of ``total_tokens`` (by
    default the corpus's own total). A rate says how often a document is to be used
    on average: 0 leaves it out, 2.5 takes it two or three times. Labels that are
    null, other than 0 and 1, or of unknown documents are not used; of several
    labels of one document the larger count.
    """
    shares = shares or TARGETS
    model = fit_domains(docs, labels)
    taken = {"doc_id", "n_tokens", "rate", *[f"p_{d}" for d in DOMAINS]} & set(carry)
    if taken:
        raise ValueError(f"names of the result: {sorted(taken)}")
    rows = cut_lineage(domain_chances(docs, model, carry))
    total = total_tokens or rows.agg(F.sum("n_tokens")).first()[0] or 0
    rate, _ = fit_rates(rows, {d: s * total for d, s in shares.items()})
    return rows.withColumn("rate", rate)
