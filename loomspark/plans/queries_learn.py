"""Queries of the learners. Those with random or long iterative parts have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import vectors as V
from loomspark.operators.ml import bayes, images, kmeans, linear, margins, mixture, neighbours, trees
from loomspark.plans import sql as S
from loomspark.plans.registry import FEATURES, ITEMS, item_features, read, register, vectors

X3 = FEATURES[:3]


def _weights(spark, w: dict[str, float], digits: int = 4):
    return spark.createDataFrame([(k, round(float(v), digits) + 0.0) for k, v in w.items()], "feature string, weight double")


# --- linear ---

# one feature: slope and intercept in closed form
@register(f"SELECT 'bias' AS feature, round(regr_intercept(price, quantity), 4) AS weight FROM {ITEMS} UNION ALL SELECT 'quantity', round(regr_slope(price, quantity), 4) FROM {ITEMS}")
def least_squares(spark, sf_dir):
    return _weights(spark, linear.ridge(item_features(spark, sf_dir), ["quantity"], "price"))


_RIDGE = f"(SELECT count(*)::DOUBLE + 2 AS a, sum(quantity) AS b, sum(quantity * quantity) + 2 AS c, sum(price) AS d, sum(quantity * price) AS e FROM {ITEMS})"


@register(f"SELECT 'bias' AS feature, round((c * d - b * e) / (a * c - b * b), 4) AS weight FROM {_RIDGE} UNION ALL SELECT 'quantity', round((a * e - b * d) / (a * c - b * b), 4) FROM {_RIDGE}")
def ridge_regression(spark, sf_dir):
    return _weights(spark, linear.ridge(item_features(spark, sf_dir), ["quantity"], "price", 2.0))


_N = len(X3) + 1


def _ridge_of(gram: str, penalty: str, carried: str, less: str = "") -> str:
    """SQL of ridge weights from a gram table g (less the table `less`, if one is named)."""
    own = lambda c: f"g.{c} - {less}.{c}" if less else f"g.{c}"
    cells = [f"{own(f'g{i}_{j}')}{f' + {penalty}' if i == j else ''} AS a{i}_{j}" for i in range(_N) for j in range(_N)]
    return S.solved(f"(SELECT {carried}{', '.join(cells)}, {', '.join(f'{own(f'b{i}')} AS c{i}' for i in range(_N))} FROM {gram})", _N, ", ".join(c.split(" AS ")[-1] for c in carried.rstrip(", ").split(", ")) + ", ")


@register(
    f"WITH tr AS MATERIALIZED {S.gram(f'(SELECT * FROM {ITEMS} WHERE id % 2 = 0)', X3, 'price')}, te AS MATERIALIZED {S.gram(f'(SELECT * FROM {ITEMS} WHERE id % 2 = 1)', X3, 'price')}, "
    f"w AS MATERIALIZED (SELECT * FROM {_ridge_of('tr g, (SELECT unnest(range(0, 151, 10))::DOUBLE AS penalty)', 'penalty', 'penalty, ')}) "
    f"SELECT penalty, round({S.squared_error('tr', 'w', _N)}, 6) AS train_mse, round({S.squared_error('te', 'w', _N)}, 6) AS test_mse FROM w, tr, te"
)
def penalty_sweep(spark, sf_dir):
    i = item_features(spark, sf_dir)
    s = linear.penalty_sweep(i.where("id % 2 = 0"), i.where("id % 2 = 1"), X3, "price", [float(p) for p in range(0, 151, 10)])
    return s.select("penalty", F.round("train_mse", 6).alias("train_mse"), F.round("test_mse", 6).alias("test_mse"))


@register(
    f"WITH f AS MATERIALIZED {S.gram(ITEMS, X3, 'price', 'id % 10')}, t AS MATERIALIZED {S.gram(ITEMS, X3, 'price')}, "
    f"w AS MATERIALIZED (SELECT * FROM {_ridge_of('t g, f, (SELECT unnest(range(0, 151, 25))::DOUBLE AS penalty)', 'penalty', 'f.grp AS fold, penalty, ', 'f')}) "
    f"SELECT penalty, round(avg({S.squared_error('f', 'w', _N)}), 8) AS mse FROM w JOIN f ON f.grp = w.fold GROUP BY 1"
)
def cross_validation(spark, sf_dir):
    i = item_features(spark, sf_dir).withColumn("fold", (F.col("id") % 10).cast("int"))
    return linear.cross_validated(i, X3, "price", [float(p) for p in range(0, 151, 25)]).select("penalty", F.round("mse", 8).alias("mse"))


@register()
def learning_curve(spark, sf_dir):
    i = item_features(spark, sf_dir)
    return linear.learning_curve(i.where("id % 2 = 0"), X3, "price", i.where("id % 2 = 1"), [50, 100, 150, 500], [1.0, 46.0, 150.0], "id")


_STEP = f"(SELECT avg(price) AS g0, avg(price * quantity) AS g1, avg(quantity) AS q, avg(quantity * quantity) AS qq FROM {ITEMS})"


# two rounds from zero weights at rate 0.1: w1 = 0.1 g, w2 = w1 - 0.1 (A w1 - g)
@register(f"SELECT 'bias' AS feature, round(0.1 * g0 - 0.1 * (0.1 * g0 + 0.1 * g1 * q - g0), 6) AS weight FROM {_STEP} UNION ALL SELECT 'quantity', round(0.1 * g1 - 0.1 * (0.1 * g0 * q + 0.1 * g1 * qq - g1), 6) FROM {_STEP}")
def gradient_descent_steps(spark, sf_dir):
    return _weights(spark, linear.gradient_descent(item_features(spark, sf_dir), ["quantity"], "price", 0.1, 2), 6)


# one logistic round from zero weights at rate 1: w = avg((y - 1/2) x)
@register(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg((label - 0.5) * {x}), 6) AS weight FROM {ITEMS}" for c, x in (("bias", "1"), *((f, f) for f in X3))))
def logistic_step(spark, sf_dir):
    return _weights(spark, linear.gradient_descent(item_features(spark, sf_dir), X3, "label", 1.0, 1, logistic=True), 6)


@register(f"WITH {S.descent(ITEMS, X3, 'label', 1.0, 10, 0.001)} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(w{i}, 4) AS weight FROM r10" for i, c in enumerate(["bias", *X3])))
def logistic_descent(spark, sf_dir):
    return _weights(spark, linear.gradient_descent(item_features(spark, sf_dir), X3, "label", 1.0, 10, logistic=True, penalty=0.001))


# the first round of a perceptron from zero weights: every row is a mistake
@register(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(sum(CASE WHEN label = 1 THEN 1 ELSE -1 END * {x}), 4) AS weight FROM {ITEMS}" for c, x in (("bias", "1"), *((f, f) for f in X3))))
def perceptron_round(spark, sf_dir):
    i = item_features(spark, sf_dir).withColumn("y", F.when(F.col("label") == 1, 1).otherwise(-1))
    return _weights(spark, linear.perceptron(i, X3, "y", rounds=1)[0])


@register()
def dual_perceptron(spark, sf_dir):
    import numpy as np

    def learn(g):
        import pandas as pd

        g = g.sort_values("id")
        x, y = np.stack(g["features"].to_numpy()), np.where(g["label"] > 4, 1.0, -1.0)
        counts, wrong = linear.dual_perceptron(x, y, margins.KERNELS["gaussian"], 10)
        return pd.DataFrame({"part": [g["part"].iloc[0]], "mistakes": [int(counts.sum())], "wrong": [wrong]})

    from loomspark.plans.shipping import ship

    ship(spark)
    v = vectors(spark, sf_dir).withColumn("part", F.col("id") % 8)  # 1 / 8 of the rows each: a sequential learner a group
    return v.groupBy("part").applyInPandas(learn, "part long, mistakes long, wrong long")


@register()
def stochastic_descent(spark, sf_dir):
    from loomspark.plans.shipping import ship

    ship(spark)

    def learn(g):
        import pandas as pd

        g = g.sort_values("id")
        w = linear.stochastic(g[X3].to_numpy(), g["price"].to_numpy(), 0.0125, 3)
        return pd.DataFrame([[g["part"].iloc[0], *w]], columns=["part", "bias", *X3])

    return item_features(spark, sf_dir).withColumn("part", F.pmod("id", F.lit(16))).groupBy("part").applyInPandas(learn, f"part long, bias double, {', '.join(f'{c} double' for c in X3)}")


@register()
def auto_encoder(spark, sf_dir):
    import numpy as np

    eye = np.eye(8)
    _, _, error = linear.autoencoder(eye, eye, passes=300)
    return spark.createDataFrame([(float(error),)], "error double")


# --- trees and boosting ---

_SPLIT = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {i} AS nr, t, gain FROM (SELECT (v + lag(v) OVER w) / 2 AS t, round(aq - power(asum, 2) / an - (lq - power(ls, 2) / ln_) - (aq - lq - power(asum - ls, 2) / (an - ln_)), 7) AS gain FROM (SELECT v, sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ln_, sum(s) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ls, sum(q) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lq, sum(n) OVER () AS an, sum(s) OVER () AS asum, sum(q) OVER () AS aq FROM (SELECT {f} AS v, count(*) AS n, sum(price) AS s, sum(price * price) AS q FROM {ITEMS} GROUP BY 1) WINDOW w AS (ORDER BY v)) WINDOW w AS (ORDER BY v))"
    for i, f in enumerate(X3)
)


@register(f"SELECT feature, round(t, 6) AS threshold FROM ({_SPLIT}) WHERE t IS NOT NULL ORDER BY gain DESC, nr, t LIMIT 1")
def best_variance_split(spark, sf_dir):
    i = item_features(spark, sf_dir).withColumn("node", F.lit(0))
    return trees.best_splits(i, X3, "price", "variance").select("feature", F.round("threshold", 6).alias("threshold"))


@register(f"WITH {', '.join(S.tree(ITEMS, 't', X3, 'price', 2, 'variance'))} SELECT node AS leaf, count(*) AS n, round(avg(price), 6) AS mean, round(any_value(m), 6) AS predicted FROM t2 JOIN tv USING (node) GROUP BY 1")
def regression_tree(spark, sf_dir):
    i = item_features(spark, sf_dir)
    t = trees.grow(i, X3, "price", 2)
    return i.withColumn("leaf", t.node()).groupBy("leaf").agg(F.count("*").alias("n"), F.round(F.avg("price"), 6).alias("mean"), F.round(F.avg(t.predict()), 6).alias("predicted"))


@register(f"WITH {', '.join(S.tree(ITEMS, 't', FEATURES, 'label', 3, 'entropy'))} SELECT label, CASE WHEN m > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction, count(*) AS n FROM t3 JOIN tv USING (node) GROUP BY 1, 2")
def classification_tree(spark, sf_dir):
    i = item_features(spark, sf_dir)
    t = trees.grow(i, FEATURES, "label", 3, "entropy")
    return i.withColumn("prediction", t.predict()).groupBy("label", "prediction").agg(F.count("*").alias("n"))


@register()
def bagged_trees(spark, sf_dir):
    i = item_features(spark, sf_dir)
    v = trees.vote(trees.bag(i, FEATURES, "label", "id", trees=3))
    return i.withColumn("prediction", v).groupBy("label", "prediction").agg(F.count("*").alias("n"))


def _boosted_sql(rounds: int) -> str:
    parts, now = [], f"(SELECT *, price AS r FROM {ITEMS})"
    for k in range(rounds):
        name = "uvxyz"[k]
        parts += S.tree(now, name, X3, "r", 2, "variance")
        parts.append(f"{name}r AS MATERIALIZED (SELECT t.* EXCLUDE (node, r), r - m AS r FROM {name}2 t JOIN {name}v USING (node))")
        now = f"{name}r"
    return f"WITH {', '.join(parts)} SELECT round(avg(r * r), 6) AS mse FROM {now}"


@register(_boosted_sql(3))
def boosted_regression(spark, sf_dir):
    i = item_features(spark, sf_dir)
    return i.agg(F.round(F.avg(F.pow(F.col("price") - trees.gradient_boost(i, X3, "price", 3), 2)), 6).alias("mse"))


def _signed(spark, sf_dir):
    return item_features(spark, sf_dir).withColumn("label", F.when(F.col("label") == 1, 1).otherwise(-1))


_STUMPS = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, (v + lag(v) OVER w) / 2 AS threshold, (1 - (sum(d) OVER () - 2 * sum(d) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) / 2 AS error FROM (SELECT {f} AS v, sum(CASE WHEN label = 1 THEN 1.0 ELSE -1.0 END) / (SELECT count(*) FROM {ITEMS}) AS d FROM {ITEMS} GROUP BY 1) WINDOW w AS (ORDER BY v)" for f in X3
)


@register(f"SELECT feature, round(threshold, 6) AS threshold, round(error, 6) AS error FROM ({_STUMPS}) WHERE threshold IS NOT NULL")
def stump_errors(spark, sf_dir):
    s = _signed(spark, sf_dir)
    n = s.count()
    out = trees.weighted_stumps(s.withColumn("w", F.lit(1.0 / n)), X3)
    return out.select("feature", F.round("threshold", 6).alias("threshold"), F.round("error", 6).alias("error"))


@register(f"WITH {S.boosted_stumps(f'(SELECT * EXCLUDE (label), CASE WHEN label = 1 THEN 1 ELSE -1 END AS label FROM {ITEMS})', X3, 3)} SELECT label, CAST(sign(m) AS DOUBLE) AS prediction, count(*) AS n FROM k3 GROUP BY 1, 2")
def ada_boost(spark, sf_dir):
    s = _signed(spark, sf_dir)
    m = trees.margin(trees.adaboost(s, X3, rounds=3))
    return s.withColumn("prediction", F.signum(m)).groupBy("label", "prediction").agg(F.count("*").alias("n"))


@register()
def ada_boost_random(spark, sf_dir):
    stumps = trees.adaboost(_signed(spark, sf_dir), X3, rounds=3, pick=trees.random_pick())
    return spark.createDataFrame([(f, float(c)) for f, c in trees.feature_confidence(stumps)], "feature string, confidence double")


@register()
def output_codes(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id", "label", *[F.col("features")[i].alias(f"f{i}") for i in range(64)])
    classes = [r["label"] for r in v.select("label").distinct().orderBy("label").collect()]
    said = trees.output_codes(v, [f"f{i}" for i in range(64)], "label", classes, bits=6, rounds=2)
    return v.withColumn("prediction", said).groupBy("label").agg(F.count("*").alias("n"), F.sum((F.col("label") == F.col("prediction")).cast("long")).alias("right"))


@register()
def active_learning(spark, sf_dir):
    s = _signed(spark, sf_dir)
    return spark.createDataFrame([(float(a), float(b)) for a, b in trees.active_learning(s, X3, "label", "id", turns=2, rounds=2)], "labelled double, error double")


# --- Bayes and densities ---


def _bayes_sql(bins: int) -> str:
    cut = {"p": "(SELECT avg(price) FROM i)", "q": "(SELECT avg(quantity) FROM i)"}
    side = {f: f"CASE WHEN {c} <= {cut[f]} THEN 0 ELSE 1 END" for f, c in (("p", "price"), ("q", "quantity"))}
    odds = lambda f: f"ln(((SELECT count(*) FROM b x WHERE x.label = 1 AND x.{f} = b.{f}) + 1.0) / (n1 + 2) / (((SELECT count(*) FROM b x WHERE x.label = 0 AND x.{f} = b.{f}) + 1.0) / (n0 + 2)))"
    return f"WITH i AS {ITEMS}, b AS (SELECT id, label, {side['p']} AS p, {side['q']} AS q FROM i), n AS (SELECT count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0 FROM i) SELECT DISTINCT p, q, round(ln((n1 + 1.0) / (n0 + 1.0)) + {odds('p')} + {odds('q')}, 5) AS score FROM b, n"


@register(_bayes_sql(2))
def bayes_bernoulli(spark, sf_dir):
    i = item_features(spark, sf_dir)
    cuts = bayes.cuts(i, ["price", "quantity"], "label")
    prior, odds = bayes.fit_bins(i, ["price", "quantity"], "label", cuts)
    return i.select(V.bin_of(F.col("price"), cuts["price"]).alias("p"), V.bin_of(F.col("quantity"), cuts["quantity"]).alias("q"), F.round(bayes.bin_score(cuts, prior, odds), 5).alias("score")).distinct()


def _bins_query(kind):
    def run(spark, sf_dir):
        i = item_features(spark, sf_dir)
        cuts = bayes.cuts(i, FEATURES, "label", kind)
        score = bayes.bin_score(cuts, *bayes.fit_bins(i, FEATURES, "label", cuts))
        return i.withColumn("prediction", (score > 0).cast("int")).groupBy("label", "prediction").agg(F.count("*").alias("n"))

    run.__name__ = f"bayes_{kind}_bins"
    return run


register(S.bayes(ITEMS, FEATURES, "four"))(_bins_query("four"))
register(S.bayes(ITEMS, FEATURES, "nine"))(_bins_query("nine"))


@register(S.bayes(f"(SELECT * EXCLUDE (price), CASE WHEN id % 5 <> 0 THEN price END AS price FROM {ITEMS})", FEATURES, "bernoulli"))
def bayes_missing(spark, sf_dir):
    i = item_features(spark, sf_dir).withColumn("price", F.when(F.col("id") % 5 != 0, F.col("price")))
    cuts = bayes.cuts(i, FEATURES, "label")
    score = bayes.bin_score(cuts, *bayes.fit_bins(i, FEATURES, "label", cuts))
    return i.withColumn("prediction", (score > 0).cast("int")).groupBy("label", "prediction").agg(F.count("*").alias("n"))


@register(
    f"SELECT id, round(ln((n1 + 1e-12) / (n0 + 1e-12)) + ((price - p0) * (price - p0) - (price - p1) * (price - p1)) / (2 * pv) + ((quantity - q0) * (quantity - q0) - (quantity - q1) * (quantity - q1)) / (2 * qv), 5) AS score FROM {ITEMS}, "
    f"(SELECT count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0, avg(price) FILTER (WHERE label = 0) AS p0, avg(price) FILTER (WHERE label = 1) AS p1, avg(quantity) FILTER (WHERE label = 0) AS q0, avg(quantity) FILTER (WHERE label = 1) AS q1, greatest(var_pop(price), 0.001) AS pv, greatest(var_pop(quantity), 0.001) AS qv FROM {ITEMS})"
)
def bayes_gaussian(spark, sf_dir):
    i, fs = item_features(spark, sf_dir), ["price", "quantity"]
    return i.select("id", F.round(bayes.gaussian_score(bayes.fit_gaussian(i, fs, "label"), fs), 5).alias("score"))


def _discriminant_sql(d: list[str]) -> str:
    stats = ", ".join([*[f"covar_samp({a}, {b}) AS a{i}_{j}" for i, a in enumerate(d) for j, b in enumerate(d)], *[f"avg({c}) FILTER (WHERE label = 1) - avg({c}) FILTER (WHERE label = 0) AS c{i}, avg({c}) FILTER (WHERE label = 1) + avg({c}) FILTER (WHERE label = 0) AS p{i}" for i, c in enumerate(d)]])
    n = len(d)
    w = S.solved(f"(SELECT {stats} FROM {ITEMS})", n, "".join(f"p{i}, " for i in range(n)))
    return f"SELECT label, CAST(({' + '.join(f'w{i} * ({c} - 0.5 * p{i})' for i, c in enumerate(d))} > 0) AS INT) AS prediction, count(*) AS n FROM {ITEMS}, {w} GROUP BY 1, 2"


@register(_discriminant_sql(FEATURES))
def gaussian_discriminant(spark, sf_dir):
    i = item_features(spark, sf_dir)
    s = bayes.discriminant_score(bayes.fit_discriminant(i, FEATURES, "label"), FEATURES)
    return i.withColumn("prediction", (s > 0).cast("int")).groupBy("label", "prediction").agg(F.count("*").alias("n"))


def _region_sql() -> str:
    from loomspark.plans.queries_relational import _FLAGGED, _FLAGS

    d = 0.8 * len(_FLAGS)
    sums = ", ".join(f"sum({f}) FILTER (WHERE quality = {v}) AS {f}{v}" for f in _FLAGS for v in (0, 1))
    p = lambda f, v: f"((coalesce({f}{v}, 0) + 0.8) / (n{v} + {d}))"
    odds = " + ".join(f"CASE WHEN {f} = 1 THEN ln({p(f, 1)} / {p(f, 0)}) ELSE ln((1 - {p(f, 1)}) / (1 - {p(f, 0)})) END" for f in _FLAGS)
    return f"SELECT doc_id, round(s, 6) AS log_odds, round(abs(2 / (1 + exp(-s)) - 1), 6) AS margin FROM (SELECT doc_id, ln((n1 + {d}) / (n0 + {d})) + {odds} AS s FROM {_FLAGGED}, (SELECT count(*) FILTER (WHERE quality = 1) AS n1, count(*) FILTER (WHERE quality = 0) AS n0, {sums} FROM {_FLAGGED}))"


@register(_region_sql())
def region_bayes(spark, sf_dir):
    from loomspark.plans.queries_relational import _FLAGS, _flagged

    d = _flagged(spark, sf_dir)
    s = bayes.bernoulli_score(bayes.fit_bernoulli(d, list(_FLAGS), "quality"))
    return d.select("doc_id", F.round(s, 6).alias("log_odds"), F.round(bayes.certainty(s), 6).alias("margin"))


@register()
def gaussian_mixture(spark, sf_dir):
    from loomspark.plans.shipping import ship

    ship(spark)
    v = vectors(spark, sf_dir)
    m = mixture.fit(v, "features", 2, 30)
    return mixture.assign(v, m, "features", "id").groupBy("component").agg(F.count("*").alias("n"))


# --- neighbours, clusters, selection ---

_VOTE = """WITH r AS (SELECT a.vec_id AS id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rn FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0)"""


@register(f"{_VOTE} SELECT id, arg_max(label, (n, -label)) AS prediction FROM (SELECT id, label, count(*) AS n FROM r WHERE rn <= 7 GROUP BY 1, 2) GROUP BY id")
def knn_classify(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return neighbours.classify(v.where("id % 20 = 0"), v.where("id % 20 <> 0"), 7)


@register(f"{_VOTE} SELECT k, round(avg(CAST(p = label AS DOUBLE)), 6) AS accuracy FROM (SELECT k, id, arg_max(label, (n, -label)) AS p FROM (SELECT k, id, label, count(*) AS n FROM r, (SELECT unnest([1, 5, 11, 21]) AS k) WHERE rn <= k GROUP BY 1, 2, 3) GROUP BY 1, 2) JOIN (SELECT vec_id AS id, label FROM embeddings) USING (id) GROUP BY k")
def knn_sweep(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return neighbours.sweep(v.where("id % 20 = 0"), v.where("id % 20 <> 0"), [1, 5, 11, 21]).select("k", F.round("accuracy", 6).alias("accuracy"))


_Z = "(SELECT e.vec_id, label, list(CASE WHEN s > 0 THEN (x - m) / s ELSE 0 END ORDER BY e.i) AS z FROM (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE {0}) e JOIN (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE {0}) GROUP BY 1) t USING (i) GROUP BY 1, 2)"


def _voted(distance: str, a: str, b: str, k: int) -> str:
    near = f"(SELECT a.vec_id AS id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY {distance}, b.vec_id) AS rn FROM {a} a, {b} b WHERE {distance} IS NOT NULL AND NOT isnan({distance}))"
    return f"SELECT id, arg_max(label, (n, -label)) AS prediction FROM (SELECT id, label, count(*) AS n FROM {near} WHERE rn <= {k} GROUP BY 1, 2) GROUP BY id"


@register(_voted("list_distance(a.z, b.z)", _Z.format("vec_id % 20 = 0"), _Z.format("vec_id % 20 <> 0"), 5))
def knn_z_scored(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return neighbours.classify(neighbours.z_scored(v.where("id % 20 = 0")), neighbours.z_scored(v.where("id % 20 <> 0")), 5)


_ZEROED = "(SELECT vec_id, label, [CASE WHEN vec_id % 37 = 0 THEN 0 ELSE x END for x in embedding::DOUBLE[]] AS z FROM embeddings WHERE {0})"


@register(_voted("CASE WHEN list_dot_product(a.z, a.z) * list_dot_product(b.z, b.z) > 0 THEN 1 - list_cosine_similarity(a.z, b.z) END", _ZEROED.format("vec_id % 20 = 0"), _ZEROED.format("vec_id % 20 <> 0"), 5))
def knn_cosine(spark, sf_dir):
    """Every 37th vector is zero: it is near to none, and none is near to it."""
    v = vectors(spark, sf_dir).withColumn("features", F.when(F.col("id") % 37 == 0, F.transform("features", lambda x: x * 0)).otherwise(F.col("features")))
    return neighbours.classify(v.where("id % 20 = 0"), v.where("id % 20 <> 0"), 5, "cosine")


@register(
    "WITH v AS (SELECT a.vec_id AS id, b.label, count(*) AS n FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0 AND list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) < 1.1 GROUP BY 1, 2), "
    "w AS (SELECT id, arg_max(label, (n, -label)) AS p FROM v GROUP BY 1), o AS (SELECT arg_max(label, (n, -label)) AS every FROM (SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 20 <> 0 GROUP BY 1)) "
    "SELECT e.vec_id AS id, coalesce(p, every) AS prediction FROM embeddings e LEFT JOIN w ON w.id = e.vec_id, o WHERE e.vec_id % 20 = 0"
)
def radius_classifier(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return neighbours.radius_classify(v.where("id % 20 = 0"), v.where("id % 20 <> 0"), 1.1)


@register(
    "SELECT q AS id, arg_max(label, (d, -label)) AS prediction FROM (SELECT a.vec_id AS q, b.label, round(avg(exp(-power(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2) / 2)), 12) AS d FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0 GROUP BY 1, 2) GROUP BY q"
)
def parzen_classifier(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return neighbours.parzen_classify(v.where("id % 20 = 0"), v.where("id % 20 <> 0"))


@register(
    "WITH d AS (SELECT a.vec_id AS q, a.label = b.label AS same, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y, row_number() OVER (PARTITION BY a.vec_id, a.label = b.label ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rn FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) "
    "SELECT CAST(i - 1 AS INT) AS feature, round(sum(CASE WHEN same THEN -1 ELSE 1 END * power(x[i] - y[i], 2)), 6) AS score FROM (SELECT same, x, y, unnest(range(1, len(x) + 1)) AS i FROM d WHERE rn = 1) GROUP BY 1"
)
def relief(spark, sf_dir):
    return neighbours.relief(vectors(spark, sf_dir)).select("feature", F.round("score", 6).alias("score"))


@register()
def relief_sampled(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("label", (F.col("label") > 4).cast("int"))
    return neighbours.relief_sampled(v, 500).select("feature", F.round("score", 6).alias("score"))


@register()
def filter_selection(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("label", (F.col("label") > 4).cast("int"))
    return neighbours.filter_selection(v, 64).select("m", F.round("accuracy", 6).alias("accuracy"))


@register()
def wrapper_selection(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("label", (F.col("label") > 4).cast("int"))
    return spark.createDataFrame([(i, f) for i, f in enumerate(neighbours.wrapper_selection(v, 64))], "step int, feature int")


_KMEANS = "(SELECT e.vec_id AS id, e.embedding::DOUBLE[] AS x, arg_min(s.c, (round(list_distance(e.embedding::DOUBLE[], s.x), 9), s.c)) AS cluster FROM embeddings e, (SELECT vec_id - 1 AS c, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id BETWEEN 1 AND 3) s GROUP BY 1, 2)"


def _seeds(spark, v):
    return v.where("id BETWEEN 1 AND 3").select((F.col("id") - 1).cast("int").alias("cluster"), F.col("features").alias("centre"))


@register(f"SELECT id, CAST(cluster AS INT) AS cluster FROM {_KMEANS}")
def kmeans_assignment(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return kmeans.assign(v, _seeds(spark, v)).select("id", "cluster")


@register(f"SELECT CAST(cluster AS INT) AS cluster, CAST(i AS INT) AS i, round(avg(v), 6) AS m FROM (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM {_KMEANS}) GROUP BY 1, 2")
def kmeans_step(spark, sf_dir):
    v = vectors(spark, sf_dir)
    s = _seeds(spark, v)
    return kmeans.update(kmeans.assign(v, s), s).select("cluster", F.posexplode("centre").alias("i", "m")).select("cluster", "i", F.round("m", 6).alias("m"))


#: Rows that the trials begin with, by rule: twelve a trial.
SEEDS = [[1 + (37 * t + 11 * j) % 400 for j in range(12)] for t in range(5)]


def _trials_sql(ks: list[int], rounds: int) -> str:
    seeds = ", ".join(f"({k}, {t}, {j}, {s})" for k in ks for t, own in enumerate(SEEDS) for j, s in enumerate(own[:k]))
    parts = [f"c0 AS MATERIALIZED (SELECT k, t, c, embedding::DOUBLE[] AS x FROM (VALUES {seeds}) AS v(k, t, c, s) JOIN embeddings ON vec_id = s)"]
    near = "SELECT k, t, e.vec_id, arg_min(c, (list_distance(e.embedding::DOUBLE[], c.x), c)) AS c, min(power(list_distance(e.embedding::DOUBLE[], c.x), 2)) AS d, any_value(e.embedding::DOUBLE[]) AS y FROM embeddings e, c{} c GROUP BY 1, 2, 3"
    for r in range(rounds):
        mean = f"SELECT k, t, c, list(m ORDER BY i) AS x FROM (SELECT k, t, c, i, avg(v) AS m FROM (SELECT k, t, c, unnest(y) AS v, generate_subscripts(y, 1) AS i FROM ({near.format(r)})) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.k, o.t, o.c, coalesce(n.x, o.x) AS x FROM c{r} o LEFT JOIN ({mean}) n USING (k, t, c))")
    sse = f"(SELECT k, t, sum(d) AS sse FROM ({near.format(rounds)}) GROUP BY 1, 2)"
    return f"WITH {', '.join(parts)} SELECT CAST(k AS INT) AS k, round(avg(sse), 6) AS mean, round(avg(sse) - 2 * stddev_samp(sse), 6) AS low, round(avg(sse) + 2 * stddev_samp(sse), 6) AS high FROM {sse} GROUP BY k"


@register(_trials_sql([1, 2, 3, 4], 8))
def kmeans_trials(spark, sf_dir):
    return kmeans.trials(vectors(spark, sf_dir), SEEDS, [1, 2, 3, 4], 8).select("k", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@register()
def kmeans_all_trials(spark, sf_dir):
    """All numbers of clusters up to twelve, to where the centres stay."""
    return kmeans.trials(vectors(spark, sf_dir), SEEDS, list(range(1, 13)), 50).select("k", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


# --- margins ---


@register()
def one_against_one(spark, sf_dir):
    from loomspark.plans.shipping import ship

    ship(spark)
    v = vectors(spark, sf_dir)
    classes = [r["label"] for r in v.select("label").distinct().orderBy("label").collect()]
    machines = margins.one_against_one(v, classes)
    return margins.vote(v, machines)


@register()
def principal_components(spark, sf_dir):
    return margins.principal_components(vectors(spark, sf_dir), 4).select("id", *[F.round(F.abs(F.col("components")[i]), 4).alias(f"c{i}") for i in range(4)])


@register()
def library_margins(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("label", (F.col("label") > 4).cast("int"))
    m = margins.library_svc(v)
    return spark.createDataFrame([(i, float(c)) for i, c in enumerate(m.coefficients.toArray())], "feature int, weight double")


@register("SELECT lang, count(*) AS n, round(avg(quality), 6) AS good FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def label_shares(spark, sf_dir):
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("good"))


@register("SELECT vec_id AS id, CAST(list_sum([CAST(embedding[i + 1] * 255 + 128 > 127.5 AS INT) * CASE WHEN i < 32 THEN 1 ELSE -1 END for i in range(64)]) AS DOUBLE) AS upper_less_lower, CAST(list_sum([CAST(embedding[i + 1] * 255 + 128 > 127.5 AS INT) * CASE WHEN i % 8 < 4 THEN 1 ELSE -1 END for i in range(64)]) AS DOUBLE) AS left_less_right FROM embeddings")
def haar_features(spark, sf_dir):
    """The vectors as 8 x 8 images: black where the component isn't negative."""
    from loomspark.plans.shipping import ship

    ship(spark)
    v = vectors(spark, sf_dir)
    pixels = F.unhex(F.array_join(F.transform("features", lambda x: F.when(x * 255 + 128 > 127.5, "FF").otherwise("00")), ""))
    out = images.haar(v.select("id", F.lit(8).alias("rows"), F.lit(8).alias("cols"), pixels.alias("pixels"), "label"), [(0, 0, 8, 8)])
    return out.select("id", F.col("features")[0].alias("upper_less_lower"), F.col("features")[1].alias("left_less_right"))
