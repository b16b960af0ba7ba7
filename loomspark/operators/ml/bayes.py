"""Naive Bayes by bins and by densities, Gaussian discriminant, Bernoulli features with smoothing."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.vectors import bin_of


def cuts(rows: DataFrame, features: list[str], label: str, bins: str = "bernoulli") -> dict[str, list[float]]:
    """Cuts of each feature: `bernoulli` its mean, `four` the sorted means of all rows and of both classes, `nine` eight equal steps from the least value."""
    m = {f: (F.avg(f), F.avg(F.when(F.col(label) == 0, F.col(f))), F.avg(F.when(F.col(label) == 1, F.col(f))), F.min(f), F.max(f)) for f in features}
    r = rows.agg(*[c.alias(f"{f}#{i}") for f in features for i, c in enumerate(m[f])]).first()
    out = {}
    for f in features:
        mean, zero, one, low, high = (r[f"{f}#{i}"] for i in range(5))
        if mean is None:
            out[f] = []
        elif bins == "bernoulli":
            out[f] = [mean]
        elif bins == "four":
            out[f] = sorted(x for x in (mean, zero, one) if x is not None)
        else:
            out[f] = [low + (high - low) / 8 * i for i in range(8)]
    return out


def fit_bins(rows: DataFrame, features: list[str], label: str, cuts_: dict[str, list[float]]) -> tuple[float, dict]:
    """(log prior odds, {(feature, bin): log odds}) with (count + 1) / (n + 2) smoothing; missing values count nowhere.

    Counts come from one aggregate over (label, feature, bin).
    """
    long = rows.select(F.col(label).alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("f"), bin_of(F.col(f), cuts_[f]).alias("b")) for f in features])).alias("s")).select("y", "s.f", "s.b")
    counts = {(r["y"], r["f"], r["b"]): r["n"] for r in long.where("b IS NOT NULL AND y IS NOT NULL").groupBy("y", "f", "b").agg(F.count("*").alias("n")).collect()}
    total = {r["y"]: r["n"] for r in rows.groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    odds = {}
    for f in features:
        for b in range(len(cuts_[f]) + 1):
            p1, p0 = (counts.get((1, f, b), 0) + 1) / (n1 + 2), (counts.get((0, f, b), 0) + 1) / (n0 + 2)
            odds[f, b] = math.log(p1 / p0)
    return math.log((n1 + 1) / (n0 + 1)), odds


def bin_score(cuts_: dict[str, list[float]], prior: float, odds: dict) -> Column:
    """Log odds of label 1; missing values add nothing."""
    total = F.lit(prior)
    for f, c in cuts_.items():
        b = bin_of(F.col(f), c)
        part = F.lit(0.0)
        for i in range(len(c) + 1):
            part = F.when(b == i, F.lit(odds[f, i])).otherwise(part)
        total = total + part
    return total


def fit_gaussian(rows: DataFrame, features: list[str], label: str, floor: float = 0.001) -> dict:
    """Means by class, one variance over all rows (at least the floor), prior odds."""
    aggs = [F.count_if(F.col(label) == v).alias(f"n{v}") for v in (0, 1)]
    aggs += [F.avg(F.when(F.col(label) == v, F.col(f))).alias(f"{f}#{v}") for f in features for v in (0, 1)]
    aggs += [F.greatest(F.var_pop(f), F.lit(floor)).alias(f"{f}#v") for f in features]
    return rows.agg(*aggs).first().asDict()


def gaussian_score(model: dict, features: list[str]) -> Column:
    """Log odds of label 1 under equal variances."""
    total = F.lit(math.log((model["n1"] + 1e-12) / (model["n0"] + 1e-12)))
    for f in features:
        m0, m1, v = model[f"{f}#0"], model[f"{f}#1"], model[f"{f}#v"]
        if None in (m0, m1, v):
            continue
        x = F.col(f)
        total = total + F.coalesce(((x - m0) * (x - m0) - (x - m1) * (x - m1)) / (2 * v), F.lit(0.0))
    return total


def fit_discriminant(rows: DataFrame, features: list[str], label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both class means and one covariance over all rows (ddof 1)."""
    d = len(features)
    r = rows.agg(*[F.avg(F.when(F.col(label) == v, F.col(f))).alias(f"m{v}_{i}") for v in (0, 1) for i, f in enumerate(features)], *[F.covar_samp(features[i], features[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]).first()
    cov = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
    return np.array([r[f"m0_{i}"] for i in range(d)]), np.array([r[f"m1_{i}"] for i in range(d)]), cov


def discriminant_score(model, features: list[str]) -> Column:
    """Log density ratio: linear in the features, as the covariance is shared; no priors."""
    m0, m1, cov = model
    inv = np.linalg.pinv(cov)
    w = inv @ (m1 - m0)
    total = F.lit(float(-0.5 * (m1 @ inv @ m1 - m0 @ inv @ m0)))
    for f, x in zip(features, w.tolist(), strict=True):
        total = total + F.col(f) * x
    return total


def fit_bernoulli(rows: DataFrame, features: list[str], label: str, alpha: float = 0.8) -> dict:
    """P(feature | class) of 0/1 features: counts start at alpha, class totals at alpha * features; prior from the smoothed totals."""
    d = len(features)
    r = rows.agg(*[F.count_if(F.col(label) == v).alias(f"n{v}") for v in (0, 1)], *[F.coalesce(F.sum(F.when(F.col(label) == v, F.col(f))), F.lit(0)).alias(f"{f}#{v}") for f in features for v in (0, 1)]).first()
    n = {v: r[f"n{v}"] + alpha * d for v in (0, 1)}
    return {"prior": n[1] / (n[0] + n[1]), "p": {f: tuple((r[f"{f}#{v}"] + alpha) / n[v] for v in (0, 1)) for f in features}}


def bernoulli_score(model: dict) -> Column:
    """Log odds of label 1."""
    total = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for f, (p0, p1) in model["p"].items():
        a, b = math.log(p1 / p0), math.log((1 - p1) / (1 - p0)) if p0 < 1 and p1 < 1 else 0.0
        total = total + F.when(F.col(f) == 1, F.lit(a)).otherwise(F.lit(b))
    return total


def certainty(log_odds: Column) -> Column:
    """|P(1) - P(0)|."""
    return F.abs(2 / (1 + F.exp(-log_odds)) - 1)
