"""Gaussian mixtures by expectation maximisation over array features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit(rows: DataFrame, features: str, k: int, rounds: int = 30, least: float = 1e-6, seed: int = 1, key: str = "id") -> dict[str, np.ndarray]:
    """Weights, means and covariances. A round is one pass: partitions return sums of a fixed size (k * d * d).

    Starting shares come from the hash of each row's key, so that runs agree.
    """
    data = rows.select(F.xxhash64(F.lit(seed), key).alias("h"), F.col(features).cast("array<double>").alias("x")).persist()
    first = data.select("x").first()
    if first is None:
        return {"weights": np.ones(k) / k, "means": np.zeros((k, 0)), "covariances": np.zeros((k, 0, 0))}
    d = len(first["x"])
    model = None
    for _ in range(rounds):
        current = model

        def sums(parts, current=current):
            import pandas as pd

            n, s, q = np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d))
            for p in parts:
                if not len(p):
                    continue
                x = np.stack(p["x"].to_numpy())
                if current is None:
                    rng = [np.random.default_rng(h & 0x7FFFFFFF).random(k) for h in p["h"]]
                    r = np.array(rng)
                    r /= r.sum(1, keepdims=True)
                else:
                    r = responsibilities(current, x)
                n += r.sum(0)
                s += r.T @ x
                q += np.einsum("nk,ni,nj->kij", r, x, x)
            yield pd.DataFrame({"s": [np.concatenate((n, s.ravel(), q.ravel())).tolist()]})

        total = np.sum([r["s"] for r in data.mapInPandas(sums, "s array<double>").collect()], axis=0)
        n, s, q = total[:k], total[k : k + k * d].reshape(k, d), total[k + k * d :].reshape(k, d, d)
        n = np.maximum(n, 1e-12)
        means = s / n[:, None]
        cov = q / n[:, None, None] - np.einsum("ki,kj->kij", means, means) + 1e-6 * np.eye(d)
        new = {"weights": n / n.sum(), "means": means, "covariances": cov}
        moved = np.abs(new["weights"] - model["weights"]).sum() if model else np.inf
        model = new
        if moved < least:
            break
    data.unpersist()
    return model


def responsibilities(model: dict, x: np.ndarray) -> np.ndarray:
    """Share of each component in each row."""
    logs = []
    for w, m, c in zip(model["weights"], model["means"], model["covariances"], strict=True):
        inv, (_, det) = np.linalg.pinv(c), np.linalg.slogdet(c)
        e = x - m
        logs.append(np.log(w) - 0.5 * (np.einsum("ni,ij,nj->n", e, inv, e) + det + len(m) * np.log(2 * np.pi)))
    z = np.array(logs).T
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    return p / p.sum(1, keepdims=True)


def assign(rows: DataFrame, model: dict, features: str, key: str) -> DataFrame:
    """(key, component): the likeliest component of each row."""
    import pandas as pd

    def run(parts):
        for p in parts:
            x = np.stack(p["x"].to_numpy()) if len(p) else np.zeros((0, model["means"].shape[1]))
            yield pd.DataFrame({"k": p["k"], "component": responsibilities(model, x).argmax(1) if len(p) else []})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("k"), F.col(features).cast("array<double>").alias("x")).mapInPandas(run, f"k {kind}, component int").withColumnRenamed("k", key)
