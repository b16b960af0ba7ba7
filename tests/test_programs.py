"""Small cases worked out by hand, and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.functions import vectors as V
from loomspark.operators import aggregates as A
from loomspark.operators import decision as D
from loomspark.operators import graph as G
from loomspark.operators import nlp as N
from loomspark.operators import relational as R
from loomspark.operators.ml import bayes, kmeans, linear, margins, mixture, neighbours, trees


def test_averages(spark):
    r = spark.createDataFrame([("S1", "19120101", "TMIN", 10), ("S1", "19120102", "TMIN", 20), ("S1", "19120101", "TMAX", 30), ("S2", "19120101", "TMAX", 7), ("S2", "19120101", "PRCP", 99)], "station string, date string, type string, value int")
    assert {tuple(x) for x in A.station_averages(r).collect()} == {("S1", 15.0, 30.0), ("S2", None, 7.0)}
    nan = {x["station"]: x["min_avg"] for x in A.station_averages(r, nan_on_empty=True).collect()}
    assert math.isnan(nan["S2"])
    series = A.time_series(r, X.year_of(F.col("date")))
    assert series.where("station = 'S1'").select(X.render_series(F.col("series"), "period", "min_avg", "max_avg")).first()[0] == "[(1912,15.0,30.0)]"
    assert A.station_averages(r.limit(0)).collect() == []


def links(spark, rows):
    return spark.createDataFrame(rows, "page string, targets array<string>")


def test_pagerank_by_hand(spark):
    nodes, edges = G.build(links(spark, [("A", ["B", "X"]), ("B", [])]))
    got = {r["page"]: r["rank"] for r in G.pagerank(nodes, edges, 1).collect()}
    assert got["A"] == pytest.approx(0.238889, abs=1e-6) and got["B"] == got["X"] == pytest.approx(0.380556, abs=1e-6)
    nodes, edges = G.build(links(spark, [("A", ["B", "C"]), ("B", ["C"]), ("C", ["A"]), ("A", [])]))
    for how in ({}, {"strategy": "broadcast"}, {"strategy": "shuffle"}, {"start": "one"}):
        ranks = G.pagerank(nodes, edges, 6, **how).collect()
        assert sum(r["rank"] for r in ranks) == pytest.approx(1, abs=1e-9)
    dropped = G.build(links(spark, [("A", ["B", "X"]), ("B", [])]), missing="drop")
    assert dropped[0].count() == 2 and dropped[1].count() == 1


def test_ties_in_the_top(spark):
    ranks = spark.createDataFrame([("a", 0.2), ("b", 0.2), ("c", 0.6)], "page string, rank double")
    assert [r["page"] for r in G.top_ranks(ranks, 2).collect()] == ["c", "a"]


def test_curve_without_origin(spark):
    s = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)], "score double, label int")
    curve = R.roc(s)
    assert sorted((r["fpr"], r["tpr"]) for r in curve.collect()) == [(0, 0.5), (0.5, 0.5), (0.5, 1), (1, 1)]
    assert R.auc(curve).first()["auc"] == pytest.approx(0.75)
    assert R.auc(R.roc(s, add_origin=True)).first()["auc"] == pytest.approx(0.75)


def test_bins_and_scalars(spark):
    row = spark.range(1).select(*[V.bin_of(F.lit(float(x)), [1.0, 2.0]).alias(f"b{i}") for i, x in enumerate((1, 1.5, 2, 3))], X.id_form(F.lit("The New É")).alias("id"), X.page_of(F.lit("../a/b/B%20c.html")).alias("page"), X.page_of(F.lit("/the")).alias("none"), X.url_decoded(F.lit("%zz")).alias("raw"), X.http_date(F.lit("Sun, 06 Nov 1994 08:49:37 GMT")).cast("string").alias("day"), V.min_max(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("flat")).first()
    assert [row[f"b{i}"] for i in range(4)] == [0, 1, 1, 2]
    assert (row["id"], row["page"], row["none"], row["raw"], row["day"], row["flat"]) == ("the_new_É", "B c", None, "%zz", "1994-11-06", None)


def test_words(spark):
    got = spark.createDataFrame([("Don't re-do the well_known rock'n'roll, I'll say: ÉTÉ 2x",)], "t string").select(X.word_set(F.col("t")).alias("w")).first()["w"]
    assert {"re-do", "well_known", "rock'n'roll", "été", "2x", "i", "ll"} <= set(got)


@pytest.mark.parametrize(("raw", "plain"), [(None, ""), ("[b]hi[/b]", "hi"), ("[nation=x][/nation]", ""), ("[nation=x]", "x"), ("[nation=x]y[/nation]", "y"), ("a [region=some_place] [b]b[/b]", "a some_place b"), ("&amp;lt;tag&amp;gt;", "<tag>"), ("[url=http://a]t[/url]", "t")])
def test_markup(raw, plain):
    assert X.strip_bbcode(raw).replace("  ", " ") == plain


def test_page_walker(spark):
    from loomspark.plans.shipping import ship

    ship(spark)
    html = '<html><body><a href="../out.html">x</a><DIV ID="bodyContent"><a href="../a/B_c.html">x</a><div><a href="../d/T~1.html"></div></div><a href="../e/F.html">'
    page = spark.createDataFrame([("A", html), ("B", None)], "name string, html string")
    from loomspark.sources.readers import page_links

    got = {r["page"]: r["targets"] for r in page_links(page).collect()}
    assert got["A"] == ["B_c"] and not got["B"]


def test_game_and_search(spark):
    tree = spark.createDataFrame([("r", None, 0, "max", None), ("a", "r", 1, "min", None), ("b", "r", 1, "min", None), ("a1", "a", 2, None, 3.0), ("a2", "a", 2, None, 12.0), ("b1", "b", 2, None, 2.0)], "node string, parent string, level int, kind string, score double")
    assert {r["node"]: r["value"] for r in G.game_values(tree, 2).collect()}["r"] == 3.0
    graph = {"A": [("B", "A-B", 1.0), ("C", "A-C", 5.0)], "B": [("C", "B-C", 1.0)], "C": []}
    assert G.search("A", lambda s: s == "C", lambda s: graph[s], "breadth") == ["A-C"]
    assert G.search("A", lambda s: s == "C", lambda s: graph[s], "cost") == G.search("A", lambda s: s == "C", lambda s: graph[s], "star") == ["A-B", "B-C"]
    assert G.search("C", lambda s: s == "A", lambda s: graph[s]) is None
    best = G.cheapest(spark.createDataFrame([(s, d, c) for s, out in graph.items() for d, _, c in out], "src string, dst string, cost double"), spark.createDataFrame([("A",)], "node string"))
    assert G.path_to(best, "C") == ["A", "B", "C"]


def test_neighbours_of_themselves(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.random(4).tolist(), int(i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label int")
    got = {r["id"]: r["prediction"] for r in neighbours.classify(df, df, 1).collect()}
    assert got == {i: y for i, _, y in rows}
    assert {r["k"]: r["accuracy"] for r in neighbours.sweep(df, df, [1]).collect()} == {1: 1.0}


def test_partial_sums_equal_whole_ones(spark):
    rng = np.random.default_rng(1)
    x = rng.random((60, 2))
    df = spark.createDataFrame([(i % 5, float(a), float(b), float(3 * a - b + 0.5)) for i, (a, b) in enumerate(x)], "fold int, a double, b double, y double")
    by, (whole,) = A.gram(df, ["a", "b"], "y", "fold"), A.gram(df, ["a", "b"], "y").values()
    assert np.allclose(sum(s[0] for s in by.values()), whole[0])
    w = linear.ridge(df, ["a", "b"], "y")
    assert np.allclose([w["bias"], w["a"], w["b"]], [0.5, 3, -1])
    m = np.c_[np.ones(60), x]
    want = np.linalg.solve(m.T @ m + 2 * np.eye(3), m.T @ (x @ [3, -1] + 0.5))
    got = linear.ridge(df, ["a", "b"], "y", 2.0)
    assert np.allclose([got["bias"], got["a"], got["b"]], want)


def test_trees_split_where_they_should(spark):
    df = spark.createDataFrame([(float(i), float(i % 7), 10.0 if i >= 30 else 1.0, int(i >= 30)) for i in range(60)], "a double, b double, y double, label int")
    t = trees.grow(df, ["b", "a"], "y", 1)
    assert t.splits[0] == ("a", 29.5) and (t.values[1], t.values[2]) == (1.0, 10.0)
    c = trees.grow(df, ["b", "a"], "label", 2, "entropy")
    assert df.where(c.predict() != F.col("label")).count() == 0
    stumps = trees.adaboost(df.withColumn("label", F.when(F.col("label") == 1, 1).otherwise(-1)), ["a", "b"], rounds=1)
    assert stumps[0][1:] == ("a", 29.5)
    words = trees.code_words(4, 5)
    assert len({tuple(w) for w in words}) == 5 and all(w[0] == 1 and not all(w) for w in words)


def test_bayes_ignores_missing_values(spark):
    df = spark.createDataFrame([(float(i % 2), None if i % 3 else 1.0, i % 2) for i in range(40)], "a double, b double, y int")
    cuts = bayes.cuts(df, ["a", "b"], "y")
    s = bayes.bin_score(cuts, *bayes.fit_bins(df, ["a", "b"], "y", cuts))
    assert df.where((s > 0).cast("int") != F.col("y")).count() == 0
    model = bayes.fit_bernoulli(df.select(F.col("a").cast("int").alias("a"), "y"), ["a"], "y", 0.8)
    assert model["p"]["a"][1] == pytest.approx((20 + 0.8) / (20 + 0.8))
    d = bayes.discriminant_score(bayes.fit_discriminant(df.select("a", (F.col("a") * 2 + F.rand(1)).alias("c"), "y"), ["a", "c"], "y"), ["a", "c"])
    assert d is not None


def test_clusters_and_mixtures(spark):
    from loomspark.plans.shipping import ship

    ship(spark)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(0, 0.1, 2) + (5 if i % 2 else 0)).tolist(), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label int")
    centres, sse = kmeans.fit(df, [0, 1])
    assert sse < 3 and sorted(round(r["centre"][0]) for r in centres.collect()) == [0, 5]
    empty = spark.createDataFrame([(0, [0.0, 0.0]), (1, [99.0, 99.0])], "cluster int, centre array<double>")
    kept = {r["cluster"]: r["centre"] for r in kmeans.update(kmeans.assign(df, empty), empty).collect()}
    assert kept[1] == [99.0, 99.0]  # a cluster without rows stays where it is
    m = mixture.fit(df, "features", 2, 40)
    found = {r["id"]: r["component"] for r in mixture.assign(df, m, "features", "id").collect()}
    assert len({found[i] for i in range(0, 60, 2)}) == 1 and found[0] != found[1]
    x, y = np.array([r[1] for r in rows]), np.array([1.0 if r[2] else -1.0 for r in rows])
    a, b = margins.optimise(x, y)
    assert (np.sign((a * y) @ x @ x.T + b) == y).all() and abs(a @ y) < 1e-6


def test_decisions(spark):
    from loomspark.sources.readers import grid_cells

    t = D.grid_transitions(grid_cells(spark, [[" ", 10], ["S", " "]]), 0.0)
    assert t.groupBy("state", "action").agg(F.sum("prob").alias("p")).where("abs(p - 1) > 1e-9").count() == 0
    v = {r["state"]: r["value"] for r in D.value_iteration(t, 5).collect()}
    assert v["1,1"] == 10 and v["0,1"] == pytest.approx(9) and v["0,0"] == pytest.approx(8.1) and v["end"] == 0
    assert {r["state"]: r["action"] for r in D.greedy_policy(t, D.value_iteration(t, 5)).collect()}["0,1"] == "east"
    assert sum(D.sonar(2).values()) == pytest.approx(1)
    b = spark.createDataFrame([("g", "a", 0.5), ("g", "b", 0.5)], "target string, pos string, prob double")
    seen = D.observe(b, spark.createDataFrame([("a", 0.2), ("b", 0.6)], "pos string, likelihood double"))
    assert {r["pos"]: r["prob"] for r in seen.collect()} == {"a": pytest.approx(0.25), "b": pytest.approx(0.75)}


def test_alignment_and_grammar(spark):
    from loomspark.plans.shipping import ship

    ship(spark)
    a = N.Aligner({("x", "u"): -1.0, ("y", "v"): -1.0})
    assert a("x y", "u v") == "[ x/u y/v ]" and a("x y", "v u") == "< x/u y/v >" and a("", "u") is None
    assert N.Aligner({}, swap=False)("x", "u") in ("[ x/EPSILON EPSILON/u ]", "[ EPSILON/u x/EPSILON ]", None)
    rules = spark.createDataFrame([("START", 1, ["A", "end"]), ("A", 1, ["a"]), ("A", 0, ["never"])], "lhs string, weight int, rhs array<string>")
    assert {r["sentence"] for r in N.sample_sentences(rules, spark.range(20)).collect()} == {"a end"}


def test_dense_index_and_folds(spark):
    df = spark.range(0, 103).select((F.col("id") * 7 % 103).alias("k"))
    got = sorted((r["k"], r["idx"]) for r in R.dense_index(df, "k").collect())
    assert got == [(i, i) for i in range(103)]
    sizes = sorted(r["count"] for r in R.folds(df, "k").groupBy("fold").count().collect())
    assert sizes == [10] * 7 + [11] * 3
