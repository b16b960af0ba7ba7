"""Grouped and conditional aggregates. Spark splits each into partial and final sums by itself."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def station_averages(readings: DataFrame, low: str = "TMIN", high: str = "TMAX", digits: int | None = 6, nan_on_empty: bool = False) -> DataFrame:
    """Mean of the low and of the high readings of each station: one pass, partial sums before the shuffle.

    A station without readings of a kind gets null for it, or NaN if asked for.
    """

    def mean(kind: str) -> Column:
        x = F.avg(F.when(F.col("type") == kind, F.col("value")))
        x = x if digits is None else F.round(x, digits)
        return F.coalesce(x, F.lit(float("nan"))) if nan_on_empty else x

    return readings.where(F.col("type").isin(low, high)).groupBy("station").agg(mean(low).alias("min_avg"), mean(high).alias("max_avg"))


def mean_by(readings: DataFrame, kind: str, digits: int = 6) -> DataFrame:
    """Mean of one kind of reading by station."""
    return readings.where(F.col("type") == kind).groupBy("station").agg(F.round(F.avg("value"), digits).alias("average"))


def mean_by_partition(readings: DataFrame, kind: str, parts: int = 4, digits: int = 6) -> DataFrame:
    """The same through explicit partial states (sum, count) of slices, merged at the end."""
    partial = readings.where(F.col("type") == kind).groupBy("station", F.pmod(F.xxhash64("station", "value"), F.lit(parts)).alias("slice")).agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    return partial.groupBy("station").agg(F.round(F.sum("total") / F.sum("n"), digits).alias("average"))


def mean_with_work(readings: DataFrame, kind: str, n: int = 17, digits: int = 6) -> DataFrame:
    """The same with a costly function in the update path; for benchmarks of the Arrow boundary."""
    from loomspark.functions.vectors import busy_fibonacci

    return mean_by(readings.where(F.col("type") == kind).withColumn("value", busy_fibonacci(n)(F.col("value").cast("double"))), kind, digits)


def time_series(readings: DataFrame, period: Column, low: str = "TMIN", high: str = "TMAX", digits: int | None = 6, order: list[str] | None = None) -> DataFrame:
    """Per station, its periods in order with the mean low and high of each: array<struct<period, min_avg, max_avg>>.

    Means are taken before the lists are built, so a list holds a row for each period, not for each reading. With `order`
    the readings of a mean add up in the order of these columns, so its last bit doesn't hang on how rows are split; they
    stream by and spill in a window, and none is gathered.
    """
    own = readings.where(F.col("type").isin(low, high)).withColumn("period", period)
    if order:
        w = Window.partitionBy("station", "period", "type").orderBy(*order)
        own = own.withColumn("nr", F.row_number().over(w)).withColumn("total", F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        own = own.groupBy("station", "period", "type").agg((F.max_by("total", "nr") / F.nullif(F.count("value"), F.lit(0))).alias("value"))
    exact = lambda kind: F.avg(F.when(F.col("type") == kind, F.col("value")))
    mean = lambda kind: exact(kind) if digits is None else F.round(exact(kind), digits)
    by = own.groupBy("station", "period").agg(mean(low).alias("min_avg"), mean(high).alias("max_avg"))
    return by.groupBy("station").agg(F.array_sort(F.collect_list(F.struct("period", "min_avg", "max_avg"))).alias("series"))


def word_count(texts: DataFrame, column: str = "text") -> DataFrame:
    """Occurrences of each word between white space."""
    return texts.select(F.explode(F.split(column, r"\s+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def regex_count(texts: DataFrame, pattern: str, column: str = "text", group: int = 1, top: int = 50) -> DataFrame:
    """Most frequent captures, by count and then by text, both descending."""
    found = texts.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(group))).alias("match"))
    return found.groupBy("match").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("match")).limit(top)


def feature_stats(rows: DataFrame, columns: list[str], ddof: int = 0, floor: float | None = None) -> DataFrame:
    """(feature, mean, sd, variance, low, high) of numeric columns in one pass; null sd becomes 0."""
    sd, var = (F.stddev_pop, F.var_pop) if ddof == 0 else (F.stddev_samp, F.var_samp)
    one = rows.agg(*[F.struct(F.avg(c).alias("mean"), F.coalesce(sd(c), F.lit(0.0)).alias("sd"), (F.greatest(var(c), F.lit(floor)) if floor else var(c)).alias("variance"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}.mean"), F.col(f"{c}.sd"), F.col(f"{c}.variance"), F.col(f"{c}.low"), F.col(f"{c}.high")) for c in columns])).alias("s")).select("s.*")


def correlation(rows: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Pearson's r of each column with the target."""
    one = rows.agg(*[F.corr(c, target).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in columns])).alias("s")).select("s.*")


def covariance(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, cov) of all pairs i <= j, ddof 1."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = rows.agg(*[F.covar_samp(a, b).alias(f"c{n}") for n, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"c{n}").alias("cov")) for n, (a, b) in enumerate(pairs)])).alias("s")).select("s.*")


def gram(rows: DataFrame, features: list[str], label: str, by: str | None = None) -> dict:
    """X'X, X'y, y'y and n (of each value of `by`) as numpy: d * d sums computed in one aggregate."""
    d = len(features)
    sums = [F.sum(F.col(features[i]) * F.col(features[j])).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d)]
    sums += [F.sum(F.col(f) * F.col(label)).alias(f"b{i}") for i, f in enumerate(features)]
    sums += [F.sum(F.col(label) * F.col(label)).alias("yy"), F.count("*").alias("n")]
    out = {}
    for r in (rows.groupBy(by) if by else rows.groupBy()).agg(*sums).collect():
        g = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                g[i, j] = g[j, i] = r[f"g{i}_{j}"] or 0.0
        out[r[by] if by else None] = (g, np.array([r[f"b{i}"] or 0.0 for i in range(d)]), r["yy"] or 0.0, r["n"])
    return out


def majority(votes: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """The most frequent label of each group; the smallest of equals."""
    counts = votes.groupBy(*keys, label).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.max_by(label, F.struct("n", (-F.col(label)).alias("low"))).alias(label))


def entropy(rows: DataFrame, label: str, keys: list[str] | None = None) -> DataFrame:
    """Entropy in bits of the label in each group."""
    keys = keys or []
    counts = rows.groupBy(*keys, label).agg(F.count("*").alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return total.select(*keys, (F.log2("t") - F.col("s") / F.col("t")).alias("entropy"), F.col("t").alias("n"))


def information_gain(rows: DataFrame, label: str, split: str) -> DataFrame:
    """One row: entropy of the label less its mean entropy within the values of `split`."""
    whole = entropy(rows, label).select(F.col("entropy").alias("h"), F.col("n").alias("t"))
    parts = entropy(rows, label, [split]).agg(F.sum(F.col("n") * F.col("entropy")).alias("s"))
    return whole.crossJoin(parts).select((F.col("h") - F.col("s") / F.col("t")).alias("gain"))


def chi_square(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, chi2) of 0/1 columns against a 0/1 label; NaN where a margin is empty."""
    y = F.col(label)
    one = rows.agg(*[F.array(*[F.sum(F.when((F.col(f) == a) & (y == b), 1).otherwise(0)).cast("double") for a in (1, 0) for b in (1, 0)]).alias(f"t{i}") for i, f in enumerate(features)])
    cells = one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"t{i}").alias("t")) for i, f in enumerate(features)])).alias("s")).select("s.*")
    a, b, c, d = (F.col("t")[i] for i in range(4))
    below = (a + b) * (c + d) * (a + c) * (b + d)
    return cells.select("feature", F.when(below > 0, (a + b + c + d) * F.pow(a * d - b * c, 2) / below).otherwise(F.lit(float("nan"))).alias("chi2"))


def confusion(scored: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """(actual, predicted, n)."""
    return scored.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def error_rates(scored: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """False positives, false negatives and errors as shares of all rows, and accuracy."""
    a, p = F.col(actual), F.col(predicted)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return scored.agg(share((a == 0) & (p == 1)).alias("false_positive"), share((a == 1) & (p == 0)).alias("false_negative"), share(a != p).alias("error"), share(a == p).alias("accuracy"))


def squared_error(scored: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    return scored.agg(F.avg(F.pow(F.col(actual) - F.col(predicted), 2)).alias("mse"))


def spread_sse(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Sum of squared deviations from the mean in each group, by running sums."""
    x = F.col(value)
    sums = rows.groupBy(*keys).agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    return sums.select(*keys, (F.col("q") - F.col("s") * F.col("s") / F.nullif(F.col("n").cast("double"), F.lit(0.0))).alias("sse"))


def normalised(counter: DataFrame, value: str = "value") -> DataFrame:
    """Values divided by their sum; a total of zero leaves them as they are."""
    total = counter.agg(F.sum(value).alias("_total"))
    return counter.crossJoin(F.broadcast(total)).withColumn(value, F.when(F.col("_total") != 0, F.col(value) / F.col("_total")).otherwise(F.col(value))).drop("_total")


def counter_add(a: DataFrame, b: DataFrame, key: str = "key", sign: int = 1) -> DataFrame:
    """Sum (or difference) of two sparse vectors."""
    both = a.select(key, "value").unionByName(b.select(key, (F.col("value") * sign).alias("value")))
    return both.groupBy(key).agg(F.sum("value").alias("value"))


def counter_dot(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    joined = a.select(key, F.col("value").alias("x")).join(b.select(key, F.col("value").alias("y")), key)
    return joined.agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0)).alias("dot"))


def arg_max(counter: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """The key of the largest value; of equals, the least key."""
    return counter.orderBy(F.desc(value), key).limit(1)


def impute_values(rows: DataFrame, numeric: list[str], nominal: list[str]) -> DataFrame:
    """One row: the mean of each numeric column, the most frequent value of each nominal one (least of equals)."""
    return rows.agg(*[F.avg(c).alias(c) for c in numeric], *[F.mode(c, deterministic=True).alias(c) for c in nominal])


def marginal(joint: DataFrame, key: str, prob: str = "prob") -> DataFrame:
    return joint.groupBy(key).agg(F.sum(prob).alias(prob))


def page_counters(links: DataFrame) -> DataFrame:
    """Pages, and those of them without links."""
    return links.agg(F.count("*").alias("pages"), F.count_if(F.size("targets") == 0).alias("dangling"))


def richest_links(links: DataFrame) -> DataFrame:
    """One row a page: that with most links; of equals, the least list."""
    ranked = F.struct((-F.size("targets")).alias("size"), "targets")
    return links.groupBy("page").agg(F.min(ranked).alias("s")).select("page", "s.targets")


def partition_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))


def trials(runs: DataFrame, value: str = "elapsed_ms", keys: list[str] | None = None) -> DataFrame:
    """Least, largest and mean of repeated measurements, of all or of each group."""
    return runs.groupBy(*(keys or [])).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))


def user_aggregate(rows: DataFrame, keys: list[str], value: str, zero, update, merge, finish, result: str = "double") -> DataFrame:
    """(keys..., result) of an aggregate given as functions: states are updated within a task, merged across tasks, finished once.

    update(state, value) and merge(state, state) return a state, finish(state) the result. A task sends one state a group.
    """
    import pickle

    from pyspark.sql import types as T

    def partial(parts):
        import pandas as pd

        states: dict = {}
        for p in parts:
            for row in p.itertuples(index=False, name=None):
                states[row[:-1]] = update(states.get(row[:-1], zero), row[-1])
        yield pd.DataFrame([(*k, pickle.dumps(s)) for k, s in states.items()], columns=[*keys, "_state"])

    def final(parts):
        import pandas as pd

        states: dict = {}
        for p in parts:
            for *k, raw in p.itertuples(index=False, name=None):
                own = pickle.loads(raw)
                states[tuple(k)] = merge(states[tuple(k)], own) if tuple(k) in states else own
        yield pd.DataFrame([(*k, finish(s)) for k, s in states.items()], columns=[*keys, "result"])

    kinds = rows.select(*keys).schema.fields
    some = rows.select(*keys, value).mapInPandas(partial, T.StructType([*kinds, T.StructField("_state", T.BinaryType())]))
    return some.repartition(*keys).mapInPandas(final, T.StructType([*kinds, T.StructField("result", T.StructType.fromDDL(f"r {result}").fields[0].dataType)]))
