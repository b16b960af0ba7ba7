"""k-means from given seed rows: the nearest centroid by a broadcast of k rows, new means by an aggregate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions import vectors as V


def assign(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """Adds `cluster` and `d2`; ties to the smaller cluster. centroids(cluster, centre) is k rows."""
    table = centroids.agg(F.array_sort(F.collect_list(F.struct("cluster", "centre"))).alias("_c"))
    scored = F.transform("_c", lambda c: F.struct(V.squared_distance(F.col("features").cast("array<double>"), c["centre"]).alias("d2"), c["cluster"].alias("cluster")))
    return rows.crossJoin(F.broadcast(table)).withColumn("_b", F.array_min(scored)).select(*rows.columns, F.col("_b.cluster").alias("cluster"), F.col("_b.d2").alias("d2"))


def update(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """Means of the clusters; one without rows keeps its centre."""
    by = assigned.select("cluster", F.posexplode(F.col("features").cast("array<double>")).alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("m"))
    new = by.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("_n"))
    return centroids.join(new, "cluster", "left").select("cluster", F.coalesce("_n", "centre").alias("centre"))


def fit(rows: DataFrame, seeds: list, k: int | None = None, rounds: int = 50, key: str = "id") -> tuple[DataFrame, float]:
    """(centroids, summed squared error): from the rows with the seed keys, until the centres stay or rounds end."""
    spark = rows.sparkSession
    order = {s: i for i, s in enumerate(seeds[: k or len(seeds)])}
    found = sorted((order[r[key]], [float(x) for x in r["features"]]) for r in rows.where(F.col(key).isin(list(order))).select(key, "features").collect())
    centroids = spark.createDataFrame(found, "cluster int, centre array<double>")
    last = None
    for _ in range(rounds):
        centroids = spark.createDataFrame([tuple(r) for r in update(assign(rows, centroids), centroids).orderBy("cluster").collect()], "cluster int, centre array<double>")  # k rows
        now = [(r["cluster"], tuple(r["centre"])) for r in centroids.collect()]
        if now == last:
            break
        last = now
    return centroids, assign(rows, centroids).agg(F.sum("d2")).first()[0] or 0.0


def trials(rows: DataFrame, seeds: list[list], ks: list[int], rounds: int = 50, key: str = "id") -> DataFrame:
    """(k, mean, low, high) of the error over trials: mean and mean -/+ two deviations (ddof 1).

    A trial's centres begin at the rows with its first k seed keys. All trials of all k advance together, one pass over
    the rows a round, in which a task returns a sum for each centre; a trial whose centres stay is left out of the next.
    """
    import pyarrow as pa

    spark = rows.sparkSession
    wanted = sorted({s for own in seeds for s in own})
    start = {r[key]: np.array(r["features"], float) for r in rows.where(F.col(key).isin(wanted)).select(key, "features").collect()}
    centres = {(k, t): np.array([start[s] for s in own[:k]]) for k in ks for t, own in enumerate(seeds)}
    error: dict[tuple, float] = {}
    open_ = sorted(centres)
    for turn in range(rounds + 1):
        now = {c: centres[c] for c in open_}
        if not now:
            break

        def sums(parts, now=now):
            total = {c: [np.zeros(len(x)), np.zeros(x.shape), 0.0] for c, x in now.items()}
            for part in parts:
                flat = part.column(0).flatten().to_numpy(zero_copy_only=False)
                if not len(flat):
                    continue
                x = flat.reshape(part.num_rows, -1)
                for c, centre in now.items():
                    d = np.stack([((x - m) ** 2).sum(1) for m in centre], 1)
                    own = d.argmin(1)
                    total[c][0] += np.bincount(own, minlength=len(centre))
                    np.add.at(total[c][1], own, x)
                    total[c][2] += d[np.arange(len(x)), own].sum()
            flat = [(k, t, [*n.tolist(), *s.ravel().tolist(), e]) for (k, t), (n, s, e) in total.items()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat], pa.int32()), pa.array([f[2] for f in flat], pa.list_(pa.float64()))], ["k", "trial", "s"])

        parts = rows.select(F.col("features").cast("array<double>").alias("x")).where("x IS NOT NULL").mapInArrow(sums, "k int, trial int, s array<double>")
        whole = parts.select("k", "trial", F.posexplode("s").alias("i", "v")).groupBy("k", "trial", "i").agg(F.sum("v").alias("v"))
        found = whole.groupBy("k", "trial").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s")).collect()  # a row a trial
        for r in found:
            c, v = (r["k"], r["trial"]), np.array([x["v"] for x in r["s"]])
            n, total, error[c] = v[: c[0]], v[c[0] : -1].reshape(c[0], -1), float(v[-1])
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres[c])
            if turn == rounds or np.array_equal(new, centres[c]):
                open_.remove(c)
            centres[c] = new if turn < rounds else centres[c]
    by = spark.createDataFrame([(k, t, e) for (k, t), e in sorted(error.items())], "k int, trial int, sse double").groupBy("k").agg(F.avg("sse").alias("mean"), F.coalesce(F.stddev_samp("sse"), F.lit(0.0)).alias("sd"))
    return by.select("k", "mean", (F.col("mean") - 2 * F.col("sd")).alias("low"), (F.col("mean") + 2 * F.col("sd")).alias("high"))
