"""Joins, windows, ranked and set operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import cut

# --- joins ---


def cogroup_sum(nodes: DataFrame, contributions: DataFrame, key: str, value: str) -> DataFrame:
    """Every node with the sum of its contributions, 0 where there is none."""
    sums = contributions.groupBy(key).agg(F.sum(value).alias(value))
    return nodes.join(sums, key, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def positional(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows with equal `row` numbers side by side, up to the shorter input."""
    return left.join(right, "row")


def lookup(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join to a table with unique keys; Spark broadcasts it if its size allows."""
    return rows.join(table, keys, "left")


def nearest(queries: DataFrame, points: DataFrame, distance: Column, k: int, exclude_self: bool = False) -> DataFrame:
    """The k points nearest to each query; ties to the smaller point id. Pairs without a distance (null or NaN) don't count.

    Every query (q, ...) meets every point (p, ...), as the operator is defined; each task then keeps k a query
    before rows are shuffled, so what moves grows with the queries, not with the pairs.
    """
    met = queries.join(points, F.col("q") != F.col("p")) if exclude_self else queries.crossJoin(points)
    near = met.withColumn("distance", distance).where(F.col("distance").isNotNull() & ~F.isnan("distance"))
    w = Window.partitionBy("q").orderBy("distance", "p")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def within(queries: DataFrame, points: DataFrame, distance: Column, radius: float) -> DataFrame:
    """Pairs nearer than the radius; every query is compared with every point."""
    return queries.crossJoin(points).withColumn("distance", distance).where(F.col("distance") < radius)


def pairs_of(values: DataFrame, column: str) -> DataFrame:
    """All unordered pairs of distinct values: (a, b) with a < b."""
    v = values.select(column).distinct()
    return v.select(F.col(column).alias("a")).join(v.select(F.col(column).alias("b")), F.col("a") < F.col("b"))


def without_words(words: DataFrame, stop: DataFrame, column: str = "word") -> DataFrame:
    return words.join(stop.select(column).distinct(), column, "left_anti")


def bridge(parents: DataFrame, members: DataFrame, key: str, member: str, name: str) -> DataFrame:
    """Parents with the sorted distinct members of each."""
    sets = members.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias(name))
    return parents.join(sets, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


# --- ordered scans ---


def running_series(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each row with the sum of its key's values so far."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(value).over(w))


def _ranged(rows: DataFrame, *order: Column) -> DataFrame:
    """The rows as a table whose part `_p` holds a range of the order, with their place `_i` in it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    return cut(part.withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("long"), 33)))


def _starts(spark, sums: list[tuple], names: list[str]) -> DataFrame:
    """(_p, names...) of sums so far before each part: one row a part."""
    so_far, out = [0] * len(names), []
    for p, *own in sorted(sums):
        out.append((p, *so_far))
        so_far = [a + (b or 0) for a, b in zip(so_far, own, strict=True)]
    kind = "double" if any(isinstance(x, float) for row in out for x in row) else "long"
    return F.broadcast(spark.createDataFrame([(r[0], *map(float if kind == "double" else int, r[1:])) for r in out], f"_p int, {', '.join(f'{n} {kind}' for n in names)}"))


def dense_index(rows: DataFrame, order: str, name: str = "idx") -> DataFrame:
    """0, 1, 2, ... in order of a column, without gathering rows in one task.

    Rows are range-partitioned and written with their place, so numbers hold when an executor is lost; counts of
    partitions (one row each) become offsets.
    """
    part = _ranged(rows, F.col(order))
    counts = [tuple(r) for r in part.groupBy("_p").agg(F.count("*")).collect()]
    return part.join(_starts(rows.sparkSession, counts, ["_o"]), "_p").withColumn(name, F.col("_o") + F.col("_i")).drop("_p", "_i", "_o")


def cumulative(rows: DataFrame, order: list[Column], **sums: str) -> DataFrame:
    """Adds running sums (new name = column) in an order of all rows, and as `new name`_before what they were a row earlier.

    Sums run within ranges, from what the ranges before them end with, so neighbours agree to the last bit.
    """
    part, names = _ranged(rows, *order), list(sums)
    w = Window.partitionBy("_p").orderBy("_i")
    run = part
    for i, n in enumerate(names):
        run = run.withColumn(f"_s{i}", F.sum(sums[n]).over(w))
    ends = [tuple(r) for r in run.groupBy("_p").agg(*[F.max_by(f"_s{i}", "_i") for i in range(len(names))]).collect()]
    out = run.join(_starts(rows.sparkSession, ends, [f"_o{i}" for i in range(len(names))]), "_p")
    for i, n in enumerate(names):
        out = out.withColumn(n, F.col(f"_o{i}") + F.col(f"_s{i}")).withColumn(f"{n}_before", F.coalesce(F.lag(n).over(w), F.col(f"_o{i}")))
    return out.drop("_p", "_i", *[f"{c}{i}" for c in ("_o", "_s") for i in range(len(names))])


def run_groups(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before, within the key: adjacent repeats removed; null equals null."""
    w = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumn("_nr", F.row_number().over(w)).withColumn("_before", F.lag(value).over(w))
    return marked.where((F.col("_nr") == 1) | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_nr", "_before")


def split_candidates(rows: DataFrame, target: str, keys: list[str], value: str = "value") -> DataFrame:
    """Thresholds between neighbouring values of each key, with count and sums of the target to their left.

    Rows are summed by value first, so the window holds distinct values only.
    """
    y = F.col(target)
    by = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
    w = Window.partitionBy(*keys).orderBy(value)
    left = w.rowsBetween(Window.unboundedPreceding, -1)
    out = by.select(*keys, ((F.col(value) + F.lag(value).over(w)) / 2).alias("threshold"), F.sum("n").over(left).alias("n_left"), F.sum("s").over(left).alias("s_left"), F.sum("q").over(left).alias("q_left"))
    return out.where("threshold IS NOT NULL")


def roc(scored: DataFrame, score: str = "score", label: str = "label", add_origin: bool = False) -> DataFrame:
    """(threshold, fpr, tpr): rates of the rows that score at least the threshold, one row a distinct score.

    Rows are counted by score first, then summed up over ranges of scores. Without add_origin the curve starts at
    its first threshold.
    """
    by = scored.groupBy(F.col(score).alias("threshold")).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("f"))
    total = scored.agg(F.sum(label).alias("tp"), F.sum(1 - F.col(label)).alias("tf"))
    summed = cumulative(by, [F.desc("threshold")], cp="p", cf="f")
    out = summed.crossJoin(F.broadcast(total)).select("threshold", (F.col("cf") / F.nullif(F.col("tf"), F.lit(0))).alias("fpr"), (F.col("cp") / F.nullif(F.col("tp"), F.lit(0))).alias("tpr"))
    return out.unionByName(scored.sparkSession.sql("SELECT CAST('Infinity' AS DOUBLE) AS threshold, 0.0D AS fpr, 0.0D AS tpr")) if add_origin else out


def auc(curve: DataFrame) -> DataFrame:
    """Area by trapezoids between neighbouring points: within ranges, and from each range's last point to the next one's first."""
    part = _ranged(curve.select("fpr", "tpr"), F.col("fpr"), F.col("tpr"))
    w = Window.partitionBy("_p").orderBy("_i")
    step = (F.col("fpr") - F.lag("fpr").over(w)) * (F.col("tpr") + F.lag("tpr").over(w)) / 2
    point = F.struct("fpr", "tpr")
    parts = part.withColumn("a", step).groupBy("_p").agg(F.sum("a").alias("a"), F.min_by(point, "_i").alias("lo"), F.max_by(point, "_i").alias("hi"))
    ends = Window.orderBy("_p")  # one row a range
    before = F.lag("hi").over(ends)
    joint = (F.col("lo.fpr") - before["fpr"]) * (F.col("lo.tpr") + before["tpr"]) / 2
    return parts.withColumn("j", joint).agg((F.sum("a") + F.coalesce(F.sum("j"), F.lit(0.0))).alias("s"), F.sum("j").alias("j")).select(F.coalesce("s", "j").alias("auc"))


def folds(rows: DataFrame, key: str, n: int = 10, blocked: bool = False, by_hash: bool = True) -> DataFrame:
    """Adds `fold`: the row's place modulo n, or in n blocks, in an order by its key's hash or by the key itself."""
    ordered = dense_index(rows.withColumn("_h", F.xxhash64(key)), "_h", "_at") if by_hash else dense_index(rows.withColumn("_h", F.lit(0)), key, "_at")
    if blocked:
        size = -(-rows.count() // n) or 1
        return ordered.withColumn("fold", F.floor(F.col("_at") / size).cast("int")).drop("_h", "_at")
    return ordered.withColumn("fold", (F.col("_at") % n).cast("int")).drop("_h", "_at")


def hash_folds(rows: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Adds `fold` from the key's hash alone: no shuffle."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def prefix_samples(rows: DataFrame, key: str, sizes: list[int], seed: int | None = 1) -> DataFrame:
    """(size, row...) of nested samples: the first so many rows in the order of a seeded hash, or of the key without a seed."""
    ordered = dense_index(rows, key, "_at") if seed is None else dense_index(rows.withColumn("_h", F.xxhash64(F.lit(seed), key)), "_h", "_at").drop("_h")
    return ordered.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where(F.col("_at") < F.col("size")).drop("_at")


def draw(distribution: DataFrame, draws: DataFrame, key: str = "key", prob: str = "prob", cells: int = 4096) -> DataFrame:
    """For each draw (id, u in [0, 1)), the key whose cumulative share first exceeds u; none where the shares end before u.

    Shares are summed in order of the keys; shares and draws meet by the cells of [0, 1) that they lie in.
    """
    cdf = cumulative(distribution.select(key, F.col(prob).alias("_w")), [F.col(key)], _hi="_w").withColumnRenamed("_hi_before", "_lo")
    cell = lambda c: F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * cells)
    spread = cdf.withColumn("_c", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi")))))
    met = draws.withColumn("_c", cell(F.col("u"))).join(spread, "_c")
    return met.where((F.col("u") >= F.col("_lo")) & (F.col("u") < F.col("_hi"))).select("id", key)


# --- ranked ---


def top(rows: DataFrame, n: int, by: str, then: str | None = None, ascending: bool = False) -> DataFrame:
    """The first n rows by a column, ties by another one ascending: each partition keeps n."""
    first = F.asc(by) if ascending else F.desc(by)
    return rows.orderBy(first, *([F.asc(then)] if then else [])).limit(n)


def arg_best(rows: DataFrame, keys: list[str], item: str, value: str, order: str, largest: bool = True) -> DataFrame:
    """The item of the best value in each group; of equals, the one that comes first in `order`."""
    v = F.col(value) if largest else -F.col(value)
    return rows.groupBy(*keys).agg(F.max_by(item, F.struct(v.alias("v"), (-F.col(order)).alias("o"))).alias(item))


def most_uncertain(scored: DataFrame, n: int, margin: str = "margin", key: str = "id") -> DataFrame:
    return scored.orderBy(F.abs(margin), key).limit(n)


# --- sets ---


def all_nodes(links: DataFrame) -> DataFrame:
    """Pages and whatever they link to."""
    return links.select("page").union(links.select(F.explode("targets"))).distinct()


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def unseen(rows: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(seen.select(*keys).distinct(), keys, "left_anti")


def feature_terms(words: Column, tags: Column, mentions: Column) -> Column:
    """Words, #tags and @mentions as one set."""
    empty = F.array().cast("array<string>")
    mark = lambda c, m: F.transform(F.coalesce(c, empty), lambda x: F.concat(F.lit(m), x))
    return F.array_union(F.array_union(F.coalesce(words, empty), mark(tags, "#")), mark(mentions, "@"))
