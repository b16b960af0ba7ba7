"""Operators against hand-worked cases and brute force, where no query has SQL for them."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions import tables
from loomspark.functions import vectors as V
from loomspark.operators import aggregates as A
from loomspark.operators import blocks
from loomspark.operators import decision as D
from loomspark.operators import graph as G
from loomspark.operators import nlp as N
from loomspark.operators import relational as R
from loomspark.operators.ml import harness, kmeans, linear, margins, mixture, neighbours, trees


def rows_of(spark, n=60, d=3, seed=1, classes=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).round(3)
    y = (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int) if classes == 2 else rng.integers(0, classes, n)
    return spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(n)], "id long, features array<double>, label int"), x, y


# --- rounding, windows, draws ---


def test_fixed_rounds_as_printf_does(spark):
    rng = random.Random(2)
    values = [37.4625, 0.0625, 0.1875, 2.5, 1.0005, -0.0004, -1.2345, 0.0, 1e9 + 0.0005, 123456.7895, *[rng.uniform(-1000, 1000) for _ in range(500)], *[k / 2000 for k in range(-400, 400)]]
    df = spark.createDataFrame([(float(v),) for v in values], "x double").select("x", V.fixed(F.col("x"), 3).alias("s"), V.fixed(F.col("x"), 0).alias("n"))
    for r in df.collect():
        assert r["s"] == f"{r['x']:.3f}" and r["n"] == f"{r['x']:.0f}"
    assert spark.createDataFrame([(None,)], "x double").select(V.fixed(F.col("x")).alias("s")).first()["s"] is None


def test_labels_and_grid_distances(spark):
    df = spark.createDataFrame([(0.5, 3, 4), (1.5, 0, 0), (None, 1, 1)], "p double, x int, y int")
    got = df.select(V.as_label(F.col("p")).alias("a"), V.as_label(F.col("p"), 0.5).alias("b"), V.grid_euclidean(F.col("x"), F.col("y"), F.lit(0), F.lit(0)).alias("d")).collect()
    assert [tuple(r)[:2] for r in got] == [(0, 1), (2, 1), (None, None)] and got[0]["d"] == 5.0


def test_adjacent_nulls_are_one_run(spark):
    df = spark.createDataFrame([("k", 1, None), ("k", 2, None), ("k", 3, "a"), ("k", 4, "a"), ("k", 5, None), ("l", 1, None)], "k string, t int, v string")
    assert sorted((r["k"], r["t"]) for r in R.run_groups(df, "k", "t", "v").collect()) == [("k", 1), ("k", 3), ("k", 5), ("l", 1)]


def test_running_sums_cross_ranges(spark):
    rng = random.Random(4)
    values = [(i, rng.random()) for i in range(500)]
    got = {r["k"]: (r["s"], r["s_before"]) for r in R.cumulative(spark.createDataFrame(values, "k int, w double"), [F.desc("k")], s="w").collect()}
    total = 0.0
    for k, w in sorted(values, reverse=True):
        assert got[k][1] == pytest.approx(total)
        total += w
        assert got[k][0] == pytest.approx(total)
    ordered = sorted(got.items(), reverse=True)
    assert all(a[1][0] == b[1][1] for a, b in zip(ordered, ordered[1:], strict=False))  # to the last bit


def test_roc_and_area(spark):
    rng = random.Random(5)
    scored = [(round(rng.random(), 2), int(rng.random() < 0.4)) for _ in range(400)]
    curve = R.roc(spark.createDataFrame(scored, "score double, label int"), add_origin=True)
    pos, neg = sum(y for _, y in scored), sum(1 - y for _, y in scored)
    got = {r["threshold"]: (r["fpr"], r["tpr"]) for r in curve.collect()}
    for t in {s for s, _ in scored}:
        assert got[t] == pytest.approx((sum(s >= t and not y for s, y in scored) / neg, sum(s >= t and y for s, y in scored) / pos))
    area = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a, y in scored if y for b, z in scored if not z) / pos / neg
    assert R.auc(curve).first()["auc"] == pytest.approx(area)
    assert R.auc(spark.createDataFrame([(0.0, 0.5), (0.5, 0.5), (0.5, 1.0), (1.0, 1.0)], "fpr double, tpr double")).first()["auc"] == 0.75


def test_draws_leave_no_gap(spark):
    shares = [(f"k{i:03d}", 1 / 301) for i in range(301)]
    edges = np.cumsum([p for _, p in shares])
    us = [*(float(e) for e in edges[:-1]), *np.random.default_rng(1).random(500).tolist(), 0.0]
    got = {r["id"]: r["key"] for r in R.draw(spark.createDataFrame(shares, "key string, prob double"), spark.createDataFrame(list(enumerate(us)), "id int, u double")).collect()}
    for i, u in enumerate(us):
        at = int(np.searchsorted(edges, u, "right"))
        assert got[i] in {shares[j][0] for j in (at - 1, at, at + 1) if 0 <= j < 301 and abs(u - edges[j]) < 1e-12 or j == at}


def test_folds_and_samples(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    sizes = Counter(r["fold"] for r in R.folds(df, "k", 10).collect())
    assert set(sizes) == set(range(10)) and max(sizes.values()) - min(sizes.values()) <= 1
    blocked = {r["k"]: r["fold"] for r in R.folds(df, "k", 10, blocked=True, by_hash=False).collect()}
    assert blocked == {k: k // 11 for k in range(103)}
    got = {}
    for r in R.prefix_samples(df, "k", [5, 20], seed=3).collect():
        got.setdefault(r["size"], set()).add(r["k"])
    assert len(got[5]) == 5 and len(got[20]) == 20 and got[5] < got[20]


# --- neighbours ---


def brute_nearest(x, y, q, k, distance, skip=True):
    d = [(distance(x[q], x[p]), p) for p in range(len(x)) if not (skip and p == q)]
    near = sorted((a, p) for a, p in d if not math.isnan(a))[:k]
    votes = Counter(int(y[p]) for _, p in near)
    return min(votes, key=lambda c: (-votes[c], c)) if votes else None


def cosine_gap(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return 1 - a @ b / n if n else math.nan


@pytest.mark.parametrize("similarity", ["euclidean", "cosine"])
def test_neighbours_with_zero_vectors_ties_and_nulls(spark, monkeypatch, similarity):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    _, x, y = rows_of(spark, 80)
    x[::9] = 0
    x[5] = x[6]
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(80)] + [(90, None, 1)], "id long, features array<double>, label int")
    got = {r["id"]: r["prediction"] for r in neighbours.classify(df, df, 5, similarity, leave_out=True).collect()}
    of = cosine_gap if similarity == "cosine" else lambda a, b: float(np.sqrt(((a - b) ** 2).sum()))
    want = {i: brute_nearest(x, y, i, 5, of) for i in range(80)}
    assert got == {i: c for i, c in want.items() if c is not None}
    one = spark.createDataFrame([(0, [1.0, 0.0], 7)], "id long, features array<double>, label int")
    two = spark.createDataFrame([(1, [0.0, 0.0], 1), (2, [1.0, 0.01], 2)], "id long, features array<double>, label int")
    assert neighbours.classify(one, two, 1, "cosine").first()["prediction"] == 2


def test_selections_by_leave_one_out(spark):
    df, x, y = rows_of(spark, 50, 4)

    def accuracy(positions):
        z = x[:, positions]
        return np.mean([brute_nearest(z, y, i, 7, lambda a, b: float(((a - b) ** 2).sum())) == y[i] for i in range(50)])

    r = [abs(np.corrcoef(x[:, i], y)[0, 1]) for i in range(4)]
    order = sorted(range(4), key=lambda i: (-r[i], i))
    got = {s["m"]: s["accuracy"] for s in neighbours.filter_selection(df, 4).collect()}
    assert got == pytest.approx({m: accuracy(order[: m + 1]) for m in range(4)})
    chosen, best = [], -1.0
    while len(chosen) < 4:
        rest = [i for i in range(4) if i not in chosen]
        found = max(((accuracy([*chosen, i]), -m) for m, i in enumerate(rest)))
        if found[0] <= best:
            break
        best = found[0]
        chosen.append(rest[-found[1]])
    assert neighbours.wrapper_selection(df, 4) == chosen


def test_sampled_relief_finds_the_telling_feature(spark):
    df, x, y = rows_of(spark, 200)
    got = {r["feature"]: r["score"] for r in neighbours.relief_sampled(df, 400).collect()}
    assert max(got, key=got.get) == 0 and len(got) == 3


# --- learners ---


def table(spark, n=200, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = 1.5 + x @ [2.0, -1.0, 0.5] + 0.1 * rng.normal(size=n)
    return spark.createDataFrame([(i, *map(float, x[i]), float(y[i]), i % 5, int(y[i] > 1.5) * 2 - 1) for i in range(n)], "id long, a double, b double, c double, y double, fold int, sign int"), x, y


def test_library_models_solve_their_equations(spark):
    df, x, y = table(spark)
    got = linear.library_linear(df, ["a", "b", "c"], "y", 0.3)
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc / len(y) + 0.3 * np.eye(3), xc.T @ yc / len(y))
    assert [got[k] for k in "abc"] == pytest.approx(w.tolist(), abs=1e-4) and got["bias"] == pytest.approx(y.mean() - x.mean(0) @ w, abs=1e-4)
    w = np.zeros(3)  # the lasso by coordinates
    for _ in range(500):
        for j in range(3):
            r = xc[:, j] @ (yc - xc @ w + xc[:, j] * w[j]) / len(y)
            w[j] = np.sign(r) * max(abs(r) - 0.6, 0) / (xc[:, j] @ xc[:, j] / len(y))
    got = linear.library_linear(df, ["a", "b", "c"], "y", 0.6, lasso=True)
    assert [got[k] for k in "abc"] == pytest.approx(w.tolist(), abs=1e-3) and got["c"] == pytest.approx(0.0, abs=1e-3)


def test_learning_curve_is_that_of_its_samples(spark):
    df, x, y = table(spark)
    got = {(r["size"], r["penalty"]): r["mse"] for r in linear.learning_curve(df, ["a", "b", "c"], "y", df, [20, 100], [0.0, 5.0], "id").collect()}
    own = {}
    for r in R.prefix_samples(df, "id", [20, 100], 1).collect():
        own.setdefault(r["size"], []).append(r["id"])
    z = np.c_[np.ones(len(x)), x]
    for n in (20, 100):
        for p in (0.0, 5.0):
            a, b = z[own[n]], y[own[n]]
            w = np.linalg.solve(a.T @ a + p * np.eye(4), a.T @ b)
            assert got[n, p] == pytest.approx(float(((z @ w - y) ** 2).mean()))


def test_harness_takes_any_learner(spark):
    df, x, y = table(spark)
    train = lambda rows: linear.ridge(rows, ["a", "b", "c"], "y")
    test = lambda w, rows: {"mse": A.squared_error(rows.withColumn("bias", F.lit(1.0)).withColumn("p", linear.predict(w)), "y", "p").first()["mse"]}
    got = {r["fold"]: r for r in harness.cross_validate(df, train, test).collect()}
    z = np.c_[np.ones(len(x)), x]
    for f in range(5):
        own = np.arange(len(x)) % 5 == f
        w = np.linalg.lstsq(z[~own], y[~own], rcond=None)[0]
        assert got[f]["test"] == pytest.approx(float(((z[own] @ w - y[own]) ** 2).mean())) and got[f]["train"] < 0.02
    sweep = harness.sample_sweep(df, "id", [0.1, 1.0], train, test, df).collect()
    assert [r["share"] for r in sweep] == [0.1, 1.0] and sweep[1]["value"] <= sweep[0]["value"]
    flags = df.selectExpr("id", "CAST(a > 0 AS INT) AS fa", "CAST(b > 2.5 AS INT) AS fb", "CAST(sign = 1 AS INT) AS y")
    assert harness.select(flags, ["fb", "fa"], "y", "chi_square", 1) == harness.select(flags, ["fb", "fa"], "y", "relief", 1) == ["fa"]
    assert sorted(harness.select(flags, ["fb", "fa"], "y", "random", 2)) == ["fa", "fb"]


def test_boosting_takes_any_learner(spark):
    df, _, _ = table(spark)
    signs = df.withColumn("label", F.col("sign"))

    def learner(rows, weight, i):  # the mean of one column after the other, and the side that is right more often
        c = "abc"[i % 3]
        m = rows.agg(F.avg(c)).first()[0]
        s = rows.agg(F.sum(F.col(weight) * F.col("label") * F.when(F.col(c) > m, 1).otherwise(-1))).first()[0]
        return c, m, 1 if s > 0 else -1

    predictor = lambda p: F.when(F.col(p[0]) > p[1], p[2]).otherwise(-p[2])
    found = trees.boost(signs, learner, predictor, rounds=3)
    total = sum((a * predictor(p) for a, p in found), F.lit(0.0))
    assert signs.where(F.signum(total) == F.col("label")).count() >= 160 and len(found) == 3
    ends = trees.adaboost(signs, ["a"], rounds=40, pick=trees.random_pick())
    low, high = signs.agg(F.min("a"), F.max("a")).first()
    assert any(not low <= t <= high for _, _, t in ends) or len(ends) == 40


def test_machines_meet_the_conditions():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 2))
    y = np.where(x[:, 0] + x[:, 1] + 0.5 * rng.normal(size=120) > 0, 1.0, -1.0)
    for kernel in ("linear", "gaussian"):
        for second in ("error", "random"):
            a, b = margins.optimise(x, y, 1.0, 1e-3, kernel, second)
            f = (a * y) @ margins.KERNELS[kernel](x, x) + b
            assert abs((a * y).sum()) < 1e-6 and a.min() >= 0 and a.max() <= 1
            r = y * f
            assert (r[a < 1e-9] > 1 - 1e-2).all() and (r[a > 1 - 1e-9] < 1 + 1e-2).all() and (abs(r[(a > 1e-9) & (a < 1 - 1e-9)] - 1) < 1e-2).all()


def test_sequential_learners():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = 0.5 + x @ [1.0, -2.0]
    assert linear.stochastic(x, y, 0.05, 30).tolist() == pytest.approx([0.5, 1.0, -2.0], abs=1e-6)
    far = x[abs(x[:, 0]) > 0.3]
    counts, wrong = linear.dual_perceptron(far, np.sign(far[:, 0]), margins.KERNELS["linear"], 200)
    assert wrong == 0 and (np.sign((counts * np.sign(far[:, 0])) @ (far @ far.T)) == np.sign(far[:, 0])).all()
    _, _, error = linear.autoencoder(np.eye(8), np.eye(8), passes=6000)
    assert error < 0.05  # eight patterns through three units


def test_mixture_is_that_of_one_partition_and_climbs(spark):
    rng = np.random.default_rng(6)
    x = np.r_[rng.normal(-3, 1, (80, 2)), rng.normal(3, 0.5, (40, 2))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    one, many = mixture.fit(df.coalesce(1), "features", 2, 40), mixture.fit(df.repartition(4), "features", 2, 40)
    assert np.allclose(one["means"], many["means"]) and sorted(np.round(one["weights"], 2)) == [0.33, 0.67]

    def likelihood(m):
        p = sum(w * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - mu, np.linalg.inv(c), x - mu)) / (2 * np.pi * np.sqrt(np.linalg.det(c))) for w, mu, c in zip(m["weights"], m["means"], m["covariances"], strict=True))
        return np.log(p).sum()

    steps = [likelihood(mixture.fit(df, "features", 2, r)) for r in (1, 2, 4, 8)]
    assert steps == sorted(steps)


def test_kmeans_is_that_of_numpy(spark):
    df, x, _ = rows_of(spark, 90, 2)
    centres = x[[3, 10, 20]]
    for _ in range(50):
        own = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        new = np.array([x[own == c].mean(0) for c in range(3)])
        if np.allclose(new, centres):
            break
        centres = new
    sse = ((x - centres[own]) ** 2).sum()
    got, error = kmeans.fit(df, [3, 10, 20])
    assert error == pytest.approx(sse) and np.allclose([r["centre"] for r in got.orderBy("cluster").collect()], centres)


# --- graphs ---


def web(spark):
    return spark.createDataFrame([("A", ["B", "X"]), ("B", []), ("A", ["C", "B"]), ("C", ["A", None])], "page string, targets array<string>")


def test_ties_of_link_lists(spark):
    assert {r["page"]: r["targets"] for r in A.richest_links(web(spark)).collect()} == {"A": ["B", "X"], "B": [], "C": ["A", None]}


def test_pagerank_plans_stay_small(spark):
    nodes, edges = G.build(web(spark))
    sizes, results = [], []
    for how in ({"iterations": 2}, {"iterations": 9}, {"iterations": 9, "strategy": "broadcast"}, {"iterations": 9, "start": "one"}):
        ranks = G.pagerank(nodes, edges, **how)
        sizes.append(len(ranks._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        results.append({r["page"]: r["rank"] for r in ranks.collect()})
    assert len(set(sizes)) == 1 and sizes[0] < 6
    assert results[1] == pytest.approx(results[2]) and results[1] == pytest.approx(results[3]) and sum(results[1].values()) == pytest.approx(1.0)


def test_ranks_by_number_are_those_by_name(spark):
    nodes, edges = G.build(web(spark))
    index = G.indexed(nodes)
    assert {r["page"]: r["idx"] for r in index.collect()} == {"A": 0, "B": 1, "C": 2, "X": 3}
    by_number = G.linked(edges, index)
    columns, dangling = G.adjacency(by_number, index)
    assert {r["idx"]: r["targets"] for r in columns.collect()} == {0: [1, 3], 1: [], 2: [0], 3: []}
    assert G.dangling_mass(index.select("idx", F.lit(0.25).alias("rank")), dangling).first()["lost"] == 0.5
    ranks = G.pagerank(index.select(F.col("idx").alias("page")), by_number)
    missing = ranks.unionByName(spark.createDataFrame([(99, 0.5)], "page long, rank double"))
    assert {r["page"]: r["rank"] for r in G.recovered(missing, index).collect()} == pytest.approx({r["page"]: r["rank"] for r in G.pagerank(nodes, edges).collect()})


def test_long_chains_are_followed_to_the_end(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(15)], "src long, dst long, cost double")
    start = spark.createDataFrame([(0,)], "node long")
    assert {r["node"]: r["distance"] for r in G.breadth_first(edges, start).collect()} == {i: i for i in range(16)}
    assert G.breadth_first(edges, start, most=3).count() == 4
    with pytest.raises(RuntimeError):
        G.cheapest(edges, start, most=3)
    with pytest.raises(RuntimeError):
        G.all_pairs(edges, most=2)


def test_problems(spark):
    free = {(x, y) for x in range(4) for y in range(4)} - {(1, 1), (2, 1)}
    place = G.position_problem(free, (0, 0), {(3, 3)}, cost=lambda p: 1.0 + p[0])
    assert len(G.solve(place, "breadth")) == 6
    assert len(G.solve(place, "star", lambda p: abs(p[0] - 3) + abs(p[1] - 3))) == len(G.solve(place, "cost")) == 6
    corners = G.visit_problem(free, (0, 0), {(0, 3), (3, 0), (3, 3), (0, 0)})
    assert len(G.solve(corners, "star", G.farthest_left)) == len(G.solve(corners, "breadth")) == 9
    puzzle = G.sliding_problem((1, 0, 2, 3, 4, 5, 6, 7, 8))
    assert G.solve(puzzle) == ["left"] and len(G.solve(G.sliding_problem((1, 4, 2, 3, 5, 0, 6, 7, 8)), "breadth")) == 3
    assert G.solve(G.position_problem({(0, 0)}, (0, 0), {(5, 5)})) is None


def test_pruned_values_are_the_trees():
    rng = random.Random(3)
    for _ in range(30):
        children, scores, n = {}, {}, 0

        def grow(depth):
            nonlocal n
            own = n
            n += 1
            if not depth:
                scores[own] = rng.randint(0, 9)
            else:
                children[own] = [grow(depth - 1) for _ in range(3)]
            return own

        grow(4)

        def value(node, largest):
            if node in scores:
                return scores[node]
            return (max if largest else min)(value(c, not largest) for c in children[node])

        found, seen = G.alpha_beta(children, scores, 0)
        assert found == value(0, True) and seen <= len(scores)


# --- decisions ---


def test_a_caught_target_is_in_jail(spark):
    belief = spark.createDataFrame([("g", "a", 0.5), ("g", "b", 0.5)], "target string, pos string, prob double")
    moves = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("jail", "a", 1.0)], "pos string, next string, p double")
    seen = spark.createDataFrame([("a", 1.0), ("jail", 1.0)], "pos string, likelihood double")
    got = D.forward_filter(belief, moves, [seen, seen, None], jail="jail").collect()
    assert [tuple(r) for r in got] == [("g", "jail", 1.0)]
    long = D.forward_filter(belief, moves, [spark.createDataFrame([("a", 0.7), ("b", 0.3)], "pos string, likelihood double")] * 6)
    assert len(long._jdf.queryExecution().optimizedPlan().toString().splitlines()) < 6
    p = np.array([0.5, 0.5])
    for _ in range(6):
        p = (p * [0.7, 0.3] / (p @ [0.7, 0.3]))[::-1]
    assert {r["pos"]: r["prob"] for r in long.collect()} == pytest.approx({"a": p[0], "b": p[1]})


def test_joint_particles_follow_the_joint_belief(spark):
    places = spark.createDataFrame([("a",), ("b",), ("c",)], "pos string")
    every = D.joint_positions(places, 2)
    assert every.count() == 9
    n = 9000
    particles = spark.range(n).select(F.col("id").alias("particle"), F.element_at(F.array(*[F.array(F.lit(x), F.lit(y)) for x in "abc" for y in "abc"]), (F.col("id") % 9 + 1).cast("int")).alias("places"))
    emit = [{"a": 0.6, "b": 0.3, "c": 0.1}, {"a": 0.1, "b": 0.1, "c": 0.8}]
    moves = {"a": [("a", 0.5), ("b", 0.5)], "b": [("b", 1.0)], "c": [("c", 0.2), ("a", 0.8)]}
    after = D.joint_particle_filter(particles, emit, moves)
    assert after.count() == n
    step = np.array([[0.5, 0.5, 0], [0, 1, 0], [0.8, 0, 0.2]])
    got = {(r["target"], r["pos"]): r["prob"] for r in D.joint_belief(after).collect()}
    for t, e in enumerate(emit):
        for pos, p in zip("abc", np.array([e[x] for x in "abc"]) @ step, strict=True):
            assert got.get((t, pos), 0.0) == pytest.approx(p, abs=0.03)
    jailed = D.joint_particle_filter(particles, [None, emit[1]], moves | {"jail": [("jail", 1.0)]}, jail="jail")
    assert {r["pos"] for r in D.joint_belief(jailed).where("target = 0").collect()} == {"jail"}
    afresh = D.joint_particle_filter(particles, [{}, {}], {p: [(p, 1.0)] for p in "abc"})
    assert {r["pos"] for r in D.joint_belief(afresh).collect()} == set("abc") and afresh.count() == n


def test_epsilon_greedy(spark):
    q = spark.createDataFrame([("s", "left", 1.0), ("s", "right", 3.0), ("s", "stay", 3.0), ("t", "go", 0.0)], "state string, action string, q double")
    agents = spark.range(4000).select("id", F.when(F.col("id") == 0, "none").when(F.col("id") == 1, "t").otherwise("s").alias("state"))
    got = Counter(r["action"] for r in D.epsilon_greedy(q, agents, 0.0).collect())
    assert got["left"] == 0 and got[None] == 1 and got["go"] == 1 and abs(got["right"] - got["stay"]) < 300
    some = Counter(r["action"] for r in D.epsilon_greedy(q, agents, 0.3).collect())
    assert 300 < some["left"] < 500


def test_extractors_and_hunting(spark):
    df = spark.createDataFrame([("s", "go", 1, 2, 0, 0, 0), ("s", "go", 1, 2, 3, 4, None)], "s string, a string, x int, y int, near int, food int, none int")
    got = df.select(D.EXTRACTORS["identity"](F.col("s"), F.col("a")).alias("i"), D.EXTRACTORS["coordinates"](F.col("s"), F.col("a"), x=F.col("x"), y=F.col("y")).alias("c"), D.EXTRACTORS["simple"](near=F.col("near"), food=F.col("food"), cells=F.lit(10)).alias("f")).collect()
    assert got[0]["i"] == {"s|go": 1.0} and got[0]["c"] == {"s": 1.0, "x=1": 1.0, "y=2": 1.0, "action=go": 1.0}
    assert set(got[0]["f"]) == {"bias", "near", "eats", "food"} and "eats" not in got[1]["f"] and got[1]["f"]["food"] == pytest.approx(0.04)
    cells = spark.createDataFrame([(x, 0) for x in range(5)], "x int, y int")
    edges = G.grid_edges(cells)
    belief = spark.createDataFrame([("g", "0,0", 0.9), ("g", "4,0", 0.1), ("h", "4,0", 1.0)], "target string, pos string, prob double")
    assert tuple(D.hunt_action(belief, G.all_pairs(edges), edges, "1,0").first()) == ("West", 0.0)


def test_caught_q_values_by_hand(spark):
    samples = spark.createDataFrame([(1, 0, "s", "a", "t", 1.0), (1, 1, "t", "b", "s", 2.0), (1, 2, "s", "a", "t", 0.0)], "learner long, step long, state string, action string, next string, reward double")
    got = {(r["state"], r["action"]): r["q"] for r in D.q_learning(samples, 0.5, 0.9).collect()}
    sa = 0.5 * 1.0
    tb = 0.5 * (2.0 + 0.9 * sa)
    assert got == pytest.approx({("s", "a"): sa + 0.5 * (0.9 * tb - sa), ("t", "b"): tb})


# --- generic surfaces ---


def test_user_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), (None, 7.0), ("a", 6.0)], "k string, v double").repartition(3)
    got = A.user_aggregate(df, ["k"], "v", (0.0, 0), lambda s, v: (s[0] + v, s[1] + 1), lambda s, t: (s[0] + t[0], s[1] + t[1]), lambda s: s[0] / s[1])
    assert {r["k"]: r["result"] for r in got.collect()} == {"a": 3.0, "b": 5.0, None: 7.0}


def test_table_functions(spark):
    tables.register(spark)
    spark.createDataFrame([("A:<a>:x",), ("B~:y",), ("none",), (None,)], "value string").createOrReplaceTempView("page_lines")
    assert [tuple(r) for r in spark.sql("SELECT t.* FROM page_lines, LATERAL named_pages(value) t").collect()] == [("A", "<a>:x")]
    assert [tuple(r) for r in spark.sql("SELECT * FROM words_of('a  b')").collect()] == [(0, "a"), (1, "b")]


def test_bigram_grammar_samples_its_corpus(spark):
    tagged = spark.createDataFrame([(1, 0, "D", "the"), (1, 1, "N", "dog"), (1, 2, "V", "runs"), (2, 0, "N", "dogs"), (2, 1, "V", "run")], "id int, position int, tag string, word string")
    rules = N.bigram_rules(tagged)
    got = {(r["lhs"], tuple(r["rhs"])): r["weight"] for r in rules.collect()}
    assert got == {("S2", ("_D",)): 1, ("S2", ("_N",)): 1, ("_D", ("D", "_N")): 1, ("_N", ("N", "_V")): 2, ("_V", ("V",)): 2, ("D", ("the",)): 1, ("N", ("dog",)): 1, ("N", ("dogs",)): 1, ("V", ("runs",)): 1, ("V", ("run",)): 1}
    said = {r["sentence"] for r in N.sample_sentences(rules, spark.range(200).withColumnRenamed("id", "id"), "S2").collect()}
    assert said == {f"{d}{n} {v}" for d in ("", "the ") for n in ("dog", "dogs") for v in ("runs", "run")}


def test_alignment_counts_by_hand(spark):
    got = N.alignment_counts(spark.createDataFrame([(1, "[ a/b < c/EPSILON EPSILON/and/or > ]"), (2, None), (3, "<num>/<num>")], "id long, tree string")).first().asDict()
    assert got == {"alignments": 2, "translations": 2, "source_only": 1, "target_only": 1, "in_order": 1, "reversed": 1}


def test_small_functions(spark):
    from loomspark.functions import text as X

    df = spark.createDataFrame([("A:b:c", "Don't  Stop\n1x!", ["x", "y"], 1, 2)], "a string, b string, c array<string>, i int, j int")
    r = df.select(X.split_once(F.col("a")).alias("s"), X.plain_letters(F.col("b")).alias("p"), X.prefixed(F.col("c"), "#").alias("m"), V.manhattan(F.col("i"), F.col("j"), F.lit(4), F.lit(0)).alias("d"), V.normal_pdf(F.lit(1.0), F.lit(0.0), F.lit(4.0)).alias("n")).first()
    assert (r["s"], r["p"], r["m"], r["d"]) == (["A", "b:c"], "dont stop x", ["#x", "#y"], 5) and r["n"] == pytest.approx(math.exp(-1 / 8) / math.sqrt(8 * math.pi))
    rows = spark.range(60).repartition(3)
    assert sum(x["n"] for x in A.partition_counts(rows).collect()) == 60
    assert R.union_all(rows, rows, rows).count() == 180
    folds = {x["id"]: x["fold"] for x in R.hash_folds(rows, "id", 4).collect()}
    assert folds == {x["id"]: x["fold"] for x in R.hash_folds(rows.coalesce(1), "id", 4).collect()} and set(folds.values()) == {0, 1, 2, 3}


def test_digits_by_rectangles_and_output_codes(spark):
    """Two strokes, upright and lying, as pictures of 28 x 28: rectangle features and output codes tell them apart."""
    from loomspark.operators.ml import images

    rng = np.random.default_rng(7)
    rows, boxes = [], images.rectangles(28, 28, 8)
    assert all(130 <= (b - t) * (r - l) <= 170 for t, l, b, r in boxes)
    for i in range(80):
        p = (rng.random((28, 28)) < 0.05) * 255
        kind = i % 3
        if kind == 0:
            p[:, 10:14] = 255
        elif kind == 1:
            p[20:24, :] = 255
        rows.append((i, 28, 28, bytearray(p.astype(np.uint8).tobytes()), kind))
    df = images.haar(spark.createDataFrame(rows, "id long, rows int, cols int, pixels binary, label int"), boxes)
    first = df.orderBy("id").first()
    black = np.frombuffer(bytes(rows[0][3]), np.uint8).reshape(28, 28) > 127
    t, l, b, r = boxes[0]
    y, x = (t + b) // 2, (l + r) // 2
    assert first["features"][:2] == [black[t:y, l:r].sum() - black[y:b, l:r].sum(), black[t:b, l:x].sum() - black[t:b, x:r].sum()]
    v = df.select("label", *[F.col("features")[i].alias(f"f{i}") for i in range(16)]).cache()
    said = trees.output_codes(v, [f"f{i}" for i in range(16)], "label", [0, 1, 2], bits=3, rounds=2)
    assert v.where(said == F.col("label")).count() >= 72


def test_pages_that_do_not_parse_are_left_out(spark):
    from loomspark.plans.shipping import ship
    from loomspark.sources import readers as S

    ship(spark)
    link = '<div id="bodyContent"><a href="../b/B.html">x&nbsp;y</a></div>'
    pages = spark.createDataFrame([("A", f"<html>{link}</html>"), ("C", f"<html>{link}<p></html>"), ("D", None)], "name string, html string")
    assert {r["page"]: r["targets"] for r in S.page_links(pages, strict=True).collect()} == {"A": ["B"]}
    assert {r["page"]: r["targets"] for r in S.page_links(pages).collect()} == {"A": ["B"], "C": ["B"], "D": None}
