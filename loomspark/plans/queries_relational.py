"""Queries of sources, filters, joins, aggregates, windows, ranked and set operators, and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.functions import vectors as V
from loomspark.operators import aggregates as A
from loomspark.operators import blocks as B
from loomspark.operators import relational as R
from loomspark.plans.registry import FEATURES, ITEMS, WEB_EDGES, item_features, read, readings, register, spread, vectors, web_links
from loomspark.streaming import events as S

# --- aggregates ---


@register(
    """SELECT user_id AS station, round(avg(CASE WHEN event_type = 'view' THEN value END), 6) AS min_avg,
    round(avg(CASE WHEN event_type = 'click' THEN value END), 6) AS max_avg
    FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id"""
)
def station_averages(spark, sf_dir):
    return A.station_averages(readings(spark, sf_dir), "view", "click")


_MEAN = "SELECT user_id AS station, round(avg(value), 6) AS average FROM events WHERE event_type = 'click' GROUP BY user_id"


@register(_MEAN)
def mean_sequential(spark, sf_dir):
    return A.mean_by(readings(spark, sf_dir), "click")


@register(_MEAN)
def mean_partitioned(spark, sf_dir):
    return A.mean_by_partition(readings(spark, sf_dir), "click")


@register("SELECT user_id AS station, round(avg(value), 6) AS average FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def mean_with_work(spark, sf_dir):
    return A.mean_with_work(readings(spark, sf_dir), "purchase", n=5)


@register(
    """SELECT station, count(*) AS n,
    string_agg(period || ':' || coalesce(printf('%.3f', min_avg), 'NaN') || ':' || coalesce(printf('%.3f', max_avg), 'NaN'), ',' ORDER BY period) AS series
    FROM (SELECT user_id AS station, strftime(ts, '%Y-%m-%d') AS period, avg(CASE WHEN event_type = 'view' THEN value END) AS min_avg, avg(CASE WHEN event_type = 'click' THEN value END) AS max_avg
    FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2) GROUP BY station"""
)
def time_series(spark, sf_dir):
    r = read(spark, sf_dir, "events").selectExpr("user_id AS station", "ts", "event_type AS type", "value", "event_id")
    series = A.time_series(r, F.date_format("ts", "yyyy-MM-dd"), "view", "click", digits=None, order=["event_id", "ts", "value"])
    show = lambda c: F.coalesce(V.fixed(c, 3), F.lit("NaN"))
    return series.select("station", F.size("series").cast("long").alias("n"), F.array_join(F.transform("series", lambda s: F.concat_ws(":", s["period"], show(s["min_avg"]), show(s["max_avg"]))), ",").alias("series"))


@register(r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def word_count(spark, sf_dir):
    return A.word_count(spread(read(spark, sf_dir, "documents").select("text")))


@register(r"SELECT match, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\b([a-z]+ing)\b', 1)) AS match FROM documents) GROUP BY match ORDER BY n DESC, match DESC LIMIT 50")
def regex_top50(spark, sf_dir):
    return A.regex_count(spread(read(spark, sf_dir, "documents").select("text")), r"\b([a-z]+ing)\b")


@register(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS sd, round(greatest(var_pop({c}), 0.001), 6) AS variance, round(min({c}), 6) AS low, round(max({c}), 6) AS high FROM {ITEMS}" for c in FEATURES
    )
)
def feature_stats(spark, sf_dir):
    s = A.feature_stats(item_features(spark, sf_dir), FEATURES, floor=0.001)
    return s.select("feature", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "variance", "low", "high")])


@register(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, price), 5) AS r FROM {ITEMS}" for c in FEATURES[:3]))
def pearson(spark, sf_dir):
    return A.correlation(item_features(spark, sf_dir), FEATURES[:3], "price").select("feature", F.round("r", 5).alias("r"))


@register(" UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, round(covar_samp({a}, {b}), 6) AS cov FROM {ITEMS}" for n, a in enumerate(FEATURES) for b in FEATURES[n:]))
def covariance(spark, sf_dir):
    return A.covariance(item_features(spark, sf_dir), FEATURES).select("i", "j", F.round("cov", 6).alias("cov"))


@register("SELECT o_custkey % 20 AS grp, arg_max(label, (n, -ascii(label))) AS label FROM (SELECT o_custkey, o_orderstatus AS label, count(*) OVER (PARTITION BY o_custkey % 20, o_orderstatus) AS n FROM orders) GROUP BY 1")
def majority_vote(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("grp"), F.ascii("o_orderstatus").alias("label"))
    return A.majority(o, ["grp"]).select("grp", F.char("label").alias("label"))


@register("SELECT round(-sum(p * log2(p)), 6) AS entropy, CAST(max(t) AS BIGINT) AS n FROM (SELECT count(*) / sum(count(*)) OVER () AS p, sum(count(*)) OVER () AS t FROM orders GROUP BY o_orderpriority)")
def label_entropy(spark, sf_dir):
    return A.entropy(read(spark, sf_dir, "orders"), "o_orderpriority").select(F.round("entropy", 6).alias("entropy"), "n")


_H = "(SELECT -sum(p * log2(p)) FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM orders GROUP BY o_orderpriority))"


@register(
    f"""SELECT round({_H} - (SELECT sum(t * h) / (SELECT count(*) FROM orders) FROM (SELECT o_orderstatus, sum(c) AS t, -sum(c / t0 * log2(c / t0)) AS h FROM
    (SELECT o_orderstatus, count(*) AS c, sum(count(*)) OVER (PARTITION BY o_orderstatus) AS t0 FROM orders GROUP BY o_orderstatus, o_orderpriority) GROUP BY o_orderstatus)), 6) AS gain"""
)
def information_gain(spark, sf_dir):
    return A.information_gain(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus").select(F.round("gain", 6).alias("gain"))


_FLAGS = {"long_text": "n_chars > 2000", "english": "lang = 'en'", "has_digit": "regexp_matches(text, '[0-9]')", "few_lines": "length(text) - length(replace(text, chr(10), '')) < 3"}


def _flagged(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 2000).cast("int").alias("long_text"), (F.col("lang") == "en").cast("int").alias("english"), F.col("text").rlike("[0-9]").cast("int").alias("has_digit"), (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) < 3).cast("int").alias("few_lines"))
    return d.join(read(spark, sf_dir, "labels"), "doc_id")


_FLAGGED = f"(SELECT d.doc_id, quality, toxic, {', '.join(f'CAST({v} AS INT) AS {k}' for k, v in _FLAGS.items())} FROM documents d JOIN labels USING (doc_id))"


@register(
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(CASE WHEN (a+b)*(c+d)*(a+c)*(b+d) > 0 THEN (a+b+c+d) * (a*d-b*c)*(a*d-b*c) / ((a+b)*(c+d)*(a+c)*(b+d)) ELSE 'NaN'::DOUBLE END, 5) AS chi2 FROM (SELECT "
        f"count(*) FILTER (WHERE {f}=1 AND quality=1)::DOUBLE AS a, count(*) FILTER (WHERE {f}=1 AND quality=0)::DOUBLE AS b, count(*) FILTER (WHERE {f}=0 AND quality=1)::DOUBLE AS c, count(*) FILTER (WHERE {f}=0 AND quality=0)::DOUBLE AS d FROM {_FLAGGED})"
        for f in _FLAGS
    )
)
def chi_square(spark, sf_dir):
    return A.chi_square(_flagged(spark, sf_dir), list(_FLAGS), "quality").select("feature", F.round("chi2", 5).alias("chi2"))


@register(f"SELECT quality AS actual, few_lines AS predicted, count(*) AS n FROM {_FLAGGED} GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return A.confusion(_flagged(spark, sf_dir), "quality", "few_lines")


_share = lambda c: f"round(avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END), 6)"


@register(f"SELECT {_share('quality=0 AND few_lines=1')} AS false_positive, {_share('quality=1 AND few_lines=0')} AS false_negative, {_share('quality<>few_lines')} AS error, {_share('quality=few_lines')} AS accuracy FROM {_FLAGGED}")
def error_rates(spark, sf_dir):
    e = A.error_rates(_flagged(spark, sf_dir), "quality", "few_lines")
    return e.select(*[F.round(c, 6).alias(c) for c in e.columns])


@register(f"SELECT round(avg(power(price - quantity, 2)), 6) AS mse FROM {ITEMS}")
def squared_error(spark, sf_dir):
    return A.squared_error(item_features(spark, sf_dir), "price", "quantity").select(F.round("mse", 6).alias("mse"))


@register("SELECT l_returnflag, round(sum(l_quantity * l_quantity) - sum(l_quantity) * sum(l_quantity) / count(*), 2) AS sse FROM lineitem GROUP BY 1")
def within_group_sse(spark, sf_dir):
    return A.spread_sse(read(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"]).select("l_returnflag", F.round("sse", 2).alias("sse"))


@register("SELECT event_type AS key, round(sum(value) / (SELECT sum(value) FROM events), 6) AS value FROM events GROUP BY 1")
def counter_normalised(spark, sf_dir):
    c = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg(F.sum("value").alias("value"))
    return A.normalised(c).select("key", F.round("value", 6).alias("value"))


@register("SELECT key, CAST(sum(v) AS BIGINT) AS value FROM (SELECT l_suppkey AS key, count(*) AS v FROM lineitem GROUP BY 1 UNION ALL SELECT s_suppkey, -1 FROM supplier) GROUP BY key")
def counter_difference(spark, sf_dir):
    a = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(F.count("*").alias("value"))
    b = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.lit(1).cast("long").alias("value"))
    return A.counter_add(a, b, sign=-1)


@register("SELECT CAST(sum(a.n * b.n) AS DOUBLE) AS dot FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1) a JOIN (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b USING (k)")
def counter_dot(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    c = lambda d: d.groupBy(F.col("l_suppkey").alias("key")).agg(F.count("*").cast("double").alias("value"))
    return A.counter_dot(c(li), c(li.where("l_returnflag = 'R'")))


@register("SELECT key, value FROM (SELECT l_partkey AS key, count(*) AS value FROM lineitem GROUP BY 1) ORDER BY value DESC, key LIMIT 1")
def counter_arg_max(spark, sf_dir):
    return A.arg_max(read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.count("*").alias("value")))


@register("SELECT round(avg(s_acctbal), 4) AS s_acctbal, (SELECT s_nationkey FROM supplier GROUP BY 1 ORDER BY count(*) DESC, s_nationkey LIMIT 1) AS s_nationkey FROM supplier")
def imputation_values(spark, sf_dir):
    return A.impute_values(read(spark, sf_dir, "supplier"), ["s_acctbal"], ["s_nationkey"]).select(F.round("s_acctbal", 4).alias("s_acctbal"), "s_nationkey")


@register(f"SELECT count(*) AS pages, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM {WEB_EDGES} e WHERE e.src = page)) AS dangling FROM (SELECT src AS page FROM {WEB_EDGES} UNION SELECT dst FROM {WEB_EDGES})")
def page_counters(spark, sf_dir):
    links = web_links(spark, sf_dir)
    nodes = R.all_nodes(links)
    full = nodes.join(links, "page", "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<string>")))
    return A.page_counters(full)


@register("SELECT event_type, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def trial_summary(spark, sf_dir):
    return A.trials(read(spark, sf_dir, "events"), "value", ["event_type"]).select("event_type", *[F.round(c, 6).alias(c) for c in ("least", "most", "mean")])


@register("SELECT l_returnflag AS pos, round(sum(q) / (SELECT sum(l_quantity) FROM lineitem), 6) AS prob FROM (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def marginal_distribution(spark, sf_dir):
    joint = A.normalised(read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("pos"), "l_linestatus").agg(F.sum("l_quantity").alias("prob")), "prob")
    return A.marginal(joint, "pos").select("pos", F.round("prob", 6).alias("prob"))


# --- filters and projections ---


@register("SELECT event_id, value FROM events WHERE event_type = 'purchase' AND value > 50")
def filter_equality(spark, sf_dir):
    return read(spark, sf_dir, "events").where("event_type = 'purchase' AND value > 50").select("event_id", "value")


@register("SELECT page_id, url FROM pages WHERE regexp_full_match(url, '[^~]+')")
def filter_names(spark, sf_dir):
    return read(spark, sf_dir, "pages").where(F.col("url").rlike("^[^~]+$")).select("page_id", "url")


@register(r"SELECT doc_id, regexp_extract(text, '([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})', 1) AS hit FROM documents WHERE regexp_matches(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')")
def grep_lines(spark, sf_dir):
    p = r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})"
    return read(spark, sf_dir, "documents").where(F.col("text").rlike(p)).select("doc_id", F.regexp_extract("text", p, 1).alias("hit"))


@register("SELECT vec_id AS id, CAST(embedding[3] AS DOUBLE) AS a, CAST(embedding[1] AS DOUBLE) AS b FROM embeddings")
def feature_subset(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id", V.pick(F.col("features"), [2, 0]).alias("f"))
    return v.select("id", F.col("f")[0].alias("a"), F.col("f")[1].alias("b"))


@register(f"SELECT id, CASE WHEN label = 0 THEN -1 ELSE 1 END AS label FROM {ITEMS}")
def label_map(spark, sf_dir):
    return item_features(spark, sf_dir).select("id", F.when(F.col("label") == 0, -1).otherwise(1).alias("label"))


@register("SELECT vec_id AS id, CAST(len(embedding) + 1 AS INT) AS width, round(list_sum([CAST(x AS DOUBLE) for x in embedding]) * CASE WHEN label % 2 = 0 THEN 1 ELSE -1 END, 4) AS total FROM embeddings")
def bias_and_sign_flip(spark, sf_dir):
    sign = F.when(F.col("label") % 2 == 0, 1).otherwise(-1)
    v = vectors(spark, sf_dir).select("id", V.with_bias(F.transform("features", lambda x: x * sign)).alias("f"))
    return v.select("id", F.size("f").alias("width"), F.round(F.aggregate("f", F.lit(-1.0), lambda a, x: a + x), 4).alias("total"))


@register("SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL")
def unlabelled_rows(spark, sf_dir):
    from loomspark.sources.readers import unlabelled

    return unlabelled(read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left"), "quality").select("doc_id", "lang")


@register("SELECT conv_id, turn FROM conversations WHERE role IN ('user') AND NOT (text LIKE '%password%')")
def eligible_rows(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("tags", F.array("role"))
    return c.where(F.array_contains("tags", "user") & ~F.col("text").contains("password")).select("conv_id", "turn")


# --- joins ---


@register("SELECT s_suppkey, round(coalesce(sum(l_extendedprice), 0), 2) AS given FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey AND l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1")
def cogroup_sum(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_extendedprice").alias("given"))
    return R.cogroup_sum(read(spark, sf_dir, "supplier").select("s_suppkey"), li, "s_suppkey", "given").select("s_suppkey", F.round("given", 2).alias("given"))


@register("SELECT a.nr, a.n_name, b.r_name FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS nr, n_name FROM nation) a JOIN (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS nr, r_name FROM region) b USING (nr)")
def positional_join(spark, sf_dir):
    a = R.dense_index(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", "row")
    b = R.dense_index(read(spark, sf_dir, "region"), "r_regionkey", "row")
    return R.positional(a, b).select(F.col("row").alias("nr"), "n_name", "r_name")


@register(
    """SELECT q, rank, p FROM (SELECT a.vec_id AS q, b.vec_id AS p, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9), b.vec_id) AS rank
    FROM embeddings a, embeddings b WHERE a.vec_id % 25 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 5"""
)
def nearest_neighbours(spark, sf_dir):
    v = vectors(spark, sf_dir)
    q = v.where("id % 25 = 0").select(F.col("id").alias("q"), F.col("features").alias("qx"))
    p = v.select(F.col("id").alias("p"), F.col("features").alias("px"), F.lit(0).alias("pl"))
    near = B.nearest(q.withColumn("ql", F.lit(0)), p, 5, [B.DISTANCE["euclidean_9"]], leave_out=True)
    return near.select("q", F.col("rank").cast("long").alias("rank"), "p")


@register("SELECT a.vec_id AS q, count(*) AS n FROM embeddings a, embeddings b WHERE a.vec_id % 25 = 0 AND list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) < 1.1 GROUP BY 1")
def radius_join(spark, sf_dir):
    v = vectors(spark, sf_dir)
    q = v.where("id % 25 = 0").select(F.col("id").alias("q"), F.col("features").alias("qx"))
    return R.within(q, v.select(F.col("id").alias("p"), F.col("features").alias("px")), V.euclidean(F.col("qx"), F.col("px")), 1.1).groupBy("q").agg(F.count("*").alias("n"))


@register("SELECT DISTINCT a.label AS a, b.label AS b FROM embeddings a JOIN embeddings b ON a.label < b.label")
def class_pairs(spark, sf_dir):
    return R.pairs_of(read(spark, sf_dir, "embeddings"), "label")


@register(r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS word FROM conversations) WHERE word <> '' AND word NOT IN (SELECT unnest(regexp_split_to_array(text, '\s+')) FROM benchmark) GROUP BY word")
def stop_word_anti_join(spark, sf_dir):
    words = A.word_count(read(spark, sf_dir, "conversations"))
    return R.without_words(words, A.word_count(read(spark, sf_dir, "benchmark")).select("word"))


@register("SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def many_to_many(spark, sf_dir):
    b = R.bridge(read(spark, sf_dir, "region"), read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_name"), "r_regionkey", "n_name", "nations")
    return b.select("r_name", F.array_join("nations", ",").alias("nations"))


@register("SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^a-z]+'), 'idiot')")
def membership_join(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.split(F.lower("text"), "[^a-z]+").alias("w"))
    return d.where(F.array_contains("w", "idiot")).select("doc_id")


@register("SELECT doc_id, doc_id % 10 = 9 AS test FROM documents")
def train_test_split(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 10 == 9).alias("test"))


# --- ordered scans ---


@register("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events")
def secondary_sort_running(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return R.running_series(e, "user_id", "event_id", "value").select("user_id", "event_id", F.round("running", 4).alias("running"))


@register("SELECT page, row_number() OVER (ORDER BY page) - 1 AS idx FROM (SELECT DISTINCT 's' || l_suppkey AS page FROM lineitem)")
def dense_index(spark, sf_dir):
    p = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("page")).distinct()
    return R.dense_index(p, "page")


@register("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def adjacent_distinct(spark, sf_dir):
    return R.run_groups(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@register(
    """SELECT l_returnflag, threshold, n_left, s_left FROM (SELECT l_returnflag, (v + lag(v) OVER w) / 2 AS threshold, CAST(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS n_left,
    round(sum(s) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 2) AS s_left FROM (SELECT l_returnflag, l_quantity AS v, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_returnflag ORDER BY v)) WHERE threshold IS NOT NULL"""
)
def split_scan(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("value"), F.col("l_extendedprice").alias("y"))
    return R.split_candidates(li, "y", ["l_returnflag"]).select("l_returnflag", "threshold", "n_left", F.round("s_left", 2).alias("s_left"))


_ROC = """(SELECT threshold, CAST(sum(f) OVER w AS DOUBLE) / (SELECT count(*) FROM labels WHERE toxic = 0) AS fpr, CAST(sum(p) OVER w AS DOUBLE) / (SELECT count(*) FROM labels WHERE toxic = 1) AS tpr
FROM (SELECT CAST(n_chars AS DOUBLE) AS threshold, sum(toxic) AS p, sum(1 - toxic) AS f FROM documents JOIN labels USING (doc_id) GROUP BY 1) WINDOW w AS (ORDER BY threshold DESC))"""


def _roc(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select(F.col("n_chars").cast("double").alias("score"), F.col("toxic").alias("label"))
    return R.roc(d)


@register(f"SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM {_ROC}")
def roc_curve(spark, sf_dir):
    return _roc(spark, sf_dir).select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@register(f"SELECT round(sum((fpr - a) * (tpr + b) / 2), 6) AS auc FROM (SELECT fpr, tpr, lag(fpr) OVER w AS a, lag(tpr) OVER w AS b FROM {_ROC} WINDOW w AS (ORDER BY fpr, tpr))")
def auc(spark, sf_dir):
    return R.auc(_roc(spark, sf_dir)).select(F.round("auc", 6).alias("auc"))


@register("SELECT p_partkey, CAST((row_number() OVER (ORDER BY p_partkey) - 1) % 10 AS INT) AS fold FROM part")
def fold_assignment(spark, sf_dir):
    return R.folds(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 10, by_hash=False)


@register("SELECT size, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS total FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS rn FROM part), (SELECT unnest([50, 100, 150]) AS size) WHERE rn <= size GROUP BY size")
def prefix_samples(spark, sf_dir):
    p = R.prefix_samples(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey", [50, 100, 150], seed=None)
    return p.groupBy("size").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("total"))


@register(
    """SELECT id, key FROM (SELECT event_id AS id, (event_id % 1000) / 1000.0 AS u FROM events), (SELECT key, sum(p) OVER (ORDER BY key) AS hi, sum(p) OVER (ORDER BY key) - p AS lo FROM
    (SELECT event_type AS key, CAST(rank() OVER (ORDER BY event_type) AS DOUBLE) / 15 AS p FROM events GROUP BY 1)) WHERE round(u, 6) >= round(lo, 6) AND round(u, 6) < round(hi, 6)"""
)
def cdf_draws(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    d = e.select(F.col("event_type").alias("key")).distinct().withColumn("prob", F.rank().over(Window.orderBy("key")).cast("double") / 15)
    draws = e.select(F.col("event_id").alias("id"), ((F.col("event_id") % 1000) / 1000).alias("u"))
    return R.draw(d, draws)


# --- ranked ---


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_100(spark, sf_dir):
    return R.top(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 100, "o_totalprice", "o_orderkey")


@register("SELECT c_custkey AS id, abs(c_acctbal - 4500) AS margin FROM customer ORDER BY margin, id LIMIT 7")
def most_uncertain(spark, sf_dir):
    return R.most_uncertain(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.abs(F.col("c_acctbal") - 4500).alias("margin")), 7)


@register("SELECT c_nationkey, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS c_custkey FROM customer GROUP BY 1")
def first_best(spark, sf_dir):
    return R.arg_best(read(spark, sf_dir, "customer"), ["c_nationkey"], "c_custkey", "c_acctbal", "c_custkey")


# --- sets ---


@register(f"SELECT src AS page FROM {WEB_EDGES} UNION SELECT dst FROM {WEB_EDGES}")
def node_union(spark, sf_dir):
    return R.all_nodes(web_links(spark, sf_dir))


@register("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def set_difference(spark, sf_dir):
    return R.unseen(read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@register("SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z]+')::VARCHAR[]) || ['#' || lang, '@' || source]) AS INT) AS n FROM documents")
def feature_terms(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    return d.select("doc_id", F.size(R.feature_terms(words, F.array("lang"), F.array("source"))).alias("n"))


# --- scalar functions ---


@register("SELECT n_nationkey, translate(n_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ ', 'abcdefghijklmnopqrstuvwxyz_') AS id, CAST(substring(CAST(19910000 + n_nationkey AS VARCHAR), 1, 4) AS INT) AS year FROM nation")
def id_forms(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    return n.select("n_nationkey", X.id_form(F.col("n_name")).alias("id"), X.year_of((F.col("n_nationkey") + 19910000).cast("string")).alias("year"))


@register("SELECT vec_id AS id, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in {"dot": "list_dot_product(a, b)", "euclid": "list_distance(a, b)", "cosine": "list_cosine_similarity(a, b)", "gaussian": "exp(-power(list_distance(a, b), 2) / 2)", "poly": "power(list_dot_product(a, b), 2)"}.items()) + " FROM (SELECT vec_id, embedding::DOUBLE[] AS a, (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1) AS b FROM embeddings)")
def similarities(spark, sf_dir):
    v = vectors(spark, sf_dir)
    first = v.orderBy("id").limit(1).select(F.col("features").alias("b"))
    m = v.crossJoin(F.broadcast(first))
    a, b = F.col("features"), F.col("b")
    return m.select("id", *[F.round(e, 6).alias(n) for n, e in {"dot": V.dot(a, b), "euclid": V.euclidean(a, b), "cosine": V.cosine(a, b), "gaussian": V.gaussian(a, b), "poly": V.polynomial(a, b)}.items()])


@register(f"SELECT id, CASE WHEN price <= 0.2 THEN 0 WHEN price <= 0.4 THEN 1 WHEN price <= 0.6 THEN 2 ELSE 3 END AS bin, CASE WHEN price > (SELECT avg(price) FROM {ITEMS}) THEN 1 ELSE 0 END AS high, CASE WHEN price >= 0.5 THEN 1 ELSE -1 END AS sgn, round(1 / (1 + exp(-price)), 6) AS sig FROM {ITEMS}")
def bins_and_signs(spark, sf_dir):
    i = item_features(spark, sf_dir)
    m = i.crossJoin(F.broadcast(i.agg(F.avg("price").alias("m"))))
    p = F.col("price")
    return m.select("id", V.bin_of(p, [0.2, 0.4, 0.6]).alias("bin"), V.over(p, F.col("m")).alias("high"), V.sign_up(p - 0.5).alias("sgn"), F.round(V.sigmoid(p), 6).alias("sig"))


@register(f"SELECT id, round((price - (SELECT min(price) FROM {ITEMS})) / (SELECT max(price) - min(price) FROM {ITEMS}), 6) AS scaled, round((price - (SELECT avg(price) FROM {ITEMS})) / (SELECT stddev_samp(price) FROM {ITEMS}), 6) AS z FROM {ITEMS}")
def scaled_features(spark, sf_dir):
    i = item_features(spark, sf_dir)
    m = i.crossJoin(F.broadcast(i.agg(F.min("price").alias("lo"), F.max("price").alias("hi"), F.avg("price").alias("m"), F.stddev_samp("price").alias("sd"))))
    p = F.col("price")
    return m.select("id", F.round(V.min_max(p, F.col("lo"), F.col("hi")), 6).alias("scaled"), F.round(V.z_score(p, F.col("m"), F.col("sd")), 6).alias("z"))


@register("SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS DOUBLE) AS building, CAST(c_mktsegment = 'MACHINERY' AS DOUBLE) AS machinery FROM customer")
def one_hot(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", V.one_hot(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"]).alias("h"))
    return c.select("c_custkey", F.col("h")[0].alias("building"), F.col("h")[1].alias("machinery"))


@register(f"SELECT round(sum(label * ln(p) + (1 - label) * ln(1 - p)), 3) AS ll FROM (SELECT label, 1 / (1 + exp(-price)) AS p FROM {ITEMS})")
def log_likelihood(spark, sf_dir):
    i = item_features(spark, sf_dir).withColumn("p", V.sigmoid(F.col("price")))
    return i.agg(F.round(V.log_likelihood(F.col("label"), F.col("p")), 3).alias("ll"))


@register(r"""SELECT page_id, len(h) AS n_links, coalesce(h[1], '') AS first_link FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1) AS h FROM pages)""")
def page_anchors(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", X.anchors(F.col("html")).alias("h"))
    return p.select("page_id", F.size("h").cast("long").alias("n_links"), F.coalesce(F.get("h", F.lit(0)), F.lit("")).alias("first_link"))


def _words_sql(text: str) -> str:
    """Distinct lower-case words: apostrophes of contractions (twice, as they may follow one another) become spaces first."""
    letter = r"\p{L}\p{N}"
    for _ in range(2):
        text = f"regexp_replace({text}, '([{letter}])''((?i:d|ll|m|re|s|ve)[^{letter}_])', '\\1 \\2', 'g')"
    return f"list_distinct([lower(x) for x in regexp_extract_all({text}, '[{letter}]+(?:[-_''][{letter}]+)*')])"


@register(f"SELECT conv_id, turn, CAST(len({_words_sql('text')}) AS INT) AS n FROM conversations")
def word_sets(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(X.word_set(F.col("text"))).alias("n"))


@register("SELECT r_regionkey, CAST(length(r_name) AS INT) AS n_arcs, substring(r_name, length(r_name), 1) AS last_symbol FROM region")
def linear_acceptor(spark, sf_dir):
    a = read(spark, sf_dir, "region").select("r_regionkey", X.arcs(X.char_tokens(F.col("r_name"))).alias("a"))
    return a.select("r_regionkey", F.size("a").alias("n_arcs"), F.element_at("a", -1)["symbol"].alias("last_symbol"))


@register("SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region")
def json_rows(spark, sf_dir):
    from loomspark.sources.sinks import json_rows as to_json

    return to_json(read(spark, sf_dir, "region").select("r_regionkey", "r_name"))


# --- windows over time ---


@register("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def daily_means(spark, sf_dir):
    return S.daily_means(read(spark, sf_dir, "events")).select("day", "event_type", "n", F.round("mean", 6).alias("mean"))


@register(
    """SELECT user_id, count(*) AS sessions, CAST(max(n) AS BIGINT) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM
    (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, s) GROUP BY user_id"""
)
def session_windows(spark, sf_dir):
    return S.sessions(read(spark, sf_dir, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))
