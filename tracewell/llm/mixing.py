"""Soft-membership mixing of documents to target domain weights.

A naive Bayes classifier over hashed words, fitted on the labelled table, gives
each document posterior probabilities of the domains. Nonnegative rates ``r``
(expected copies of a document) are then fitted so that the expected tokens of
domain ``k``, the sum of ``r * w * p_k``, match the targets, where ``w`` is the
document's share of all tokens: minimise

    sum_k (sum_d r_d w_d p_dk - target_k)^2 + ridge * sum_d w_d (r_d - 1)^2

over ``r >= 0``, by projected gradient. The gradient of a document's rate is a
sum of the domains' residuals weighted by its posteriors, so that all rates are
``max(0, 1 + sum_k pull_k p_k)``: a step moves the ``k`` pulls against the
residuals and projects the rates to what is not negative. Steps are
preconditioned by the ``k x k`` matrix of ``sum w p_k p_l`` over the documents of
positive rate, and halved until they gain enough (so conditioned, they are those
of Newton's method on the dual, a convex piecewise quadratic function of the
pulls). A step is one aggregation, and the driver holds no document.

The fit ends when each domain's residual is within its tolerance, ``TOLERANCE``
times the target (times the domain's share of the tokens where the target is 0).
The ridge starts below what the smallest domain needs for that and falls while
that helps; targets that no rates meet are named in the result.

Everything here is DataFrame expressions; nothing leaves the JVM.
"""

from __future__ import annotations

import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import Scratch, hash_sample, materialise

DOMAINS = ("clean", "poor", "toxic")
TARGETS = {"clean": 0.9, "poor": 0.1, "toxic": 0.0}
BUCKETS = 1 << 14
TRAIN_ROWS = 20_000
TOLERANCE = 0.002
STEPS = 200  # aggregations of a fit at most; a fit that they end is reported as missing its targets


def domain_of_labels() -> Column:
    """Domain of a row of ``labels``; null where the labels say too little."""
    return (
        F.when(F.col("toxic") == 1, "toxic")
        .when(F.col("quality") == 0, "poor")
        .when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    )


def hashed_words(text: Column, buckets: int) -> Column:
    """Bucket numbers of the words of a text, one entry for each word."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def fit_domains(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row: ``weights`` (bucket-major, a log-likelihood for each domain) and ``priors``.

    Learned from at most ``train_rows`` labelled documents, the first in the
    order of a hash of the id. A word counts once in a document. Domains without
    labelled documents keep the uniform likelihood and a prior of one document.
    """
    known = labels.select("doc_id", domain_of_labels().alias("domain")).where("domain is not null and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("domain").alias("domain"))
    known = hash_sample(known, train_rows, "doc_id")
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # train_rows rows at most
    number = F.array_position(F.array(*[F.lit(d) for d in DOMAINS]), F.col("domain")).cast("int") - 1
    scratch = Scratch(docs.sparkSession)
    seen = scratch.table(texts.select(number.alias("k"), F.array_distinct(hashed_words(F.col("text"), buckets)).alias("words")))
    sizes = seen.groupBy("k").agg(F.count("*").alias("docs"), F.sum(F.size("words")).alias("total"))
    k = len(DOMAINS)
    per = {r["k"]: (r["docs"], r["total"] or 0) for r in sizes.collect()}
    every = sum(n for n, _ in per.values()) + k
    counts = seen.select("k", F.explode("words").alias("b")).groupBy("b", "k").agg(F.count("*").alias("n"))
    wide = counts.groupBy("b").agg(*[F.sum(F.when(F.col("k") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(k)])
    space = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    smoothed = space.join(wide, "b", "left").select(
        "b",
        F.array(
            *[
                F.log((F.coalesce(F.col(f"n{i}"), F.lit(0)) + F.lit(0.5)) / F.lit(per.get(i, (0, 0))[1] + 0.5 * buckets))
                for i in range(k)
            ]
        ).alias("w"),
    )
    packed = smoothed.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("b", "w"))), lambda e: e["w"])).alias("weights"))
    priors = F.array(*[F.log(F.lit((per.get(i, (0, 0))[0] + 1) / every)) for i in range(k)])
    model = scratch.table(packed.withColumn("priors", priors).coalesce(1))
    scratch.drop(seen)
    return model


def with_posteriors(docs: DataFrame, model: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Add ``tokens`` and ``p_<domain>``; a text without words gets the priors.

    The model is one row of ``buckets`` times three numbers, a proven size, and
    comes as a scalar subquery: the documents never shuffle.
    """
    k = len(DOMAINS)
    new = {"tokens", "__w", "__score", "__best", "__sum", *(f"p_{d}" for d in DOMAINS)}
    base = docs.select(*[c for c in docs.columns if c not in new])
    scored = base.withColumn("__w", F.array_distinct(hashed_words(F.col("text"), buckets)))
    scored = scored.withColumns({"__weights": model.select("weights").scalar(), "__priors": model.select("priors").scalar()})

    def add(i: int):
        return lambda acc, b: acc + F.element_at("__weights", b * k + (i + 1))

    sums = [
        F.aggregate(
            "__w",
            F.element_at("__priors", i + 1),
            add(i),
        )
        for i in range(k)
    ]
    tokens = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")).cast("long")
    out = scored.withColumn("__score", F.array(*sums)).withColumn("tokens", tokens)
    out = out.withColumn("__score", F.transform("__score", lambda s: F.exp(F.greatest(s - F.array_max("__score"), F.lit(-700.0)))))
    total = reduce(lambda a, b: a + b, [F.element_at("__score", i + 1) for i in range(k)])
    for i, d in enumerate(DOMAINS):
        out = out.withColumn(f"p_{d}", F.element_at("__score", i + 1) / total)
    return out.drop("__w", "__score", "__weights", "__priors")


def tolerances(shares: list[float], goal: list[float], tolerance: float = TOLERANCE) -> list[float]:
    """The residual that each domain may keep, as a share of all tokens."""
    return [tolerance * (g or s) + 1e-12 for s, g in zip(shares, goal, strict=True)]


def fit_rates(soft: DataFrame, targets: dict[str, float] = TARGETS, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[list[float], list[dict]]:
    """The domains' pulls for ``with_rates``; also each step's residuals, the last those of the pulls.

    ``soft`` has ``tokens`` and posteriors, and is read once a step. An empty
    table, or one without tokens, has no pulls. ``missed`` tells from the
    residuals which targets are not met.
    """
    names = [f"p_{d}" for d in DOMAINS]
    goal = np.array([float(targets[d]) for d in DOMAINS])
    total = soft.agg(F.sum("tokens")).first()[0] or 0
    log: list[dict] = []
    if not total:
        return [], log
    k = len(DOMAINS)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def look(pull: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Half the sum of squared rates, the residuals, and the matrix over documents of positive rate."""
        rated = soft.select(*names, (F.col("tokens") / F.lit(float(total))).alias("w"), _rate(pull).alias("r"))
        sums = [F.sum(F.col("w") * F.col("r") * F.col("r")), *[F.sum(F.col("w") * F.col("r") * F.col(n)) for n in names]]
        sums += [F.sum(F.when(F.col("r") > 0, F.col("w") * F.col(names[i]) * F.col(names[j]))) for i, j in pairs]
        row = [float(x or 0.0) for x in rated.agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).first()]
        matrix = np.zeros((k, k))
        for (i, j), x in zip(pairs, row[1 + k :], strict=True):
            matrix[i, j] = matrix[j, i] = x
        return row[0] / 2, np.array(row[1 : 1 + k]) - goal, matrix

    pull = np.zeros(k)
    square, residual, matrix = look(pull)
    shares = residual + goal
    allowed = np.array(tolerances(shares.tolist(), goal.tolist(), tolerance))
    # A domain of share s alone has the pull target / s - 1, and the ridge leaves ridge * pull.
    alone = np.abs(goal / np.maximum(shares, 1e-9) - 1.0)
    ridge = max(1e-12, float(np.min(allowed / np.maximum(alone, 1e-3))) / 4)
    log.append(dict(zip(DOMAINS, residual.tolist(), strict=True)))
    kept, before = (pull, log[-1]), None
    while len(log) < steps and (np.abs(residual) > allowed).any():
        slope = residual + ridge * pull
        if (np.abs(slope) <= 0.05 * allowed).all():  # this ridge's minimum
            now = np.abs(residual)
            if ridge <= 1e-12 or before is not None and not ((now > allowed) & (now < 0.9 * before)).any():
                break
            kept, before, ridge = (pull, log[-1]), now, ridge / 10
            continue
        move = -np.linalg.solve(matrix + ridge * np.eye(k), slope)
        value, size = square - goal @ pull + ridge / 2 * pull @ pull, 1.0
        while True:
            tried = pull + size * move
            square, residual, matrix = look(tried)
            log.append(dict(zip(DOMAINS, residual.tolist(), strict=True)))
            gain = value - (square - goal @ tried + ridge / 2 * tried @ tried)
            if gain >= -1e-4 * size * (slope @ move) - 1e-13 * abs(value) or size < 1e-6 or len(log) >= steps:
                break
            size /= 2
        pull = tried
    if before is not None and (np.abs(residual) > allowed).any() and not (np.abs(residual) < 0.9 * before).any():
        pull = kept[0]  # a smaller ridge only made the rates wilder
        log.append(kept[1])
    return pull.tolist(), log


def missed(log: list[dict], targets: dict[str, float] = TARGETS, tolerance: float = TOLERANCE) -> dict[str, float]:
    """Domains whose target the fit does not meet, with the residual left, as a share of all tokens."""
    if not log:
        return {}
    goal = [float(targets[d]) for d in DOMAINS]
    allowed = tolerances([log[0][d] + g for d, g in zip(DOMAINS, goal, strict=True)], goal, tolerance)
    return {d: log[-1][d] for d, most in zip(DOMAINS, allowed, strict=True) if abs(log[-1][d]) > most}


def _rate(pulls) -> Column:
    terms = [F.lit(float(x)) * F.col(f"p_{d}") for x, d in zip(pulls, DOMAINS, strict=False)]
    return F.greatest(F.lit(0.0), reduce(lambda a, b: a + b, terms, F.lit(1.0)))


def with_rates(soft: DataFrame, pulls: list[float]) -> DataFrame:
    """Add ``rate`` to rows with posteriors."""
    return soft.withColumn("rate", _rate(pulls))


def with_misses(rated: DataFrame, log: list[dict], targets: dict[str, float] = TARGETS) -> DataFrame:
    """Add ``targets_missed``: the domains whose target is not met and by what share of the tokens, or an empty text."""
    left = missed(log, targets)
    if left:
        warnings.warn(f"targets not met, tokens beyond them: {left}", stacklevel=2)
    return rated.withColumn("targets_missed", F.lit(", ".join(f"{d} {x:+.3g}" for d, x in left.items())))


def mix_sources(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """All rows of ``docs`` with ``tokens``, ``p_clean``, ``p_poor``, ``p_toxic``, ``rate`` and ``targets_missed``.

    ``targets`` are shares of the corpus's token total and sum to 1. Null and
    empty texts have no tokens: their posteriors are the priors, and their rates
    follow from those. Without labelled rows all posteriors are equal. Of labels
    of one document that clash, the last by name counts: toxic, then poor. Rows of a
    repeated id are rated each by its text. Columns named like new ones are
    replaced.
    """
    model = fit_domains(docs, labels)
    soft = with_posteriors(docs.drop("rate", "targets_missed"), model)
    # The fit reads a narrow table; the texts are scored again rather than written twice.
    scratch = Scratch(docs.sparkSession)
    narrow = scratch.table(soft.select("tokens", *[f"p_{d}" for d in DOMAINS]))
    pulls, log = fit_rates(narrow, targets)
    scratch.drop(narrow)
    return with_misses(with_rates(soft, pulls), log, targets)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """Rates of all ``documents``; nulls, empty and repeated rows as in ``mix_sources``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_domains(docs, labels)
    soft = materialise(with_posteriors(docs, model).drop("text"))
    pulls, log = fit_rates(soft)
    return with_misses(with_rates(soft, pulls), log)
