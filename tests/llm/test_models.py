import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import langid, topk, toxicity

WORDS = {"en": "the of and to with thing hand water for".split(), "de": "der die und ich schön keit mit wasser für".split(), "fr": "le la et que avec été eau pour chose".split()}


def prose(rng, lang, n=60):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", ",", "s"]) for _ in range(n))


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, lang := rng.choice(list(WORDS))), lang, "src", None) for i in range(400)]
    rows += [(1000, None, "en", "s", None), (1001, "", None, "s", None), (1002, "123 456 !!", "fr", "s", None), (1003, "der " * 30_000, None, None, None), (7, rows[7][1], rows[7][2], "src", None), (None, prose(rng, "de"), "de", "s", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")


def test_languages(documents):
    got = langid.identify(documents).collect()
    assert len(got) == documents.count()
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    for r in got:
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
    by = {r["doc_id"]: r for r in got}
    assert {by[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"} and all(by[i]["rejected"] for i in (1000, 1001, 1002))
    assert by[1003]["lang_pred"] == "de"
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_language_stage(documents):
    kept = langid.keep_identified(documents)
    assert kept.columns == documents.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert not {1000, 1001, 1002} & set(ids) and len(ids) >= documents.count() - 8
    assert langid.identify(documents.limit(0)).collect() == []
    none = langid.identify(documents.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_copies_leave_the_sample_of_a_language_whole(spark):
    rng = random.Random(6)
    rows = [(prose(rng, lang), lang) for lang in WORDS for _ in range(50)]
    once = langid.fit(spark.createDataFrame(rows, "text string, lang string"), sample=10, size=4000)
    copied = langid.fit(spark.createDataFrame([r for r in rows for _ in range(40 if r[1] == "de" else 1)], "text string, lang string"), sample=10, size=4000)
    assert [k for k, _ in once.dictionaries] == sorted(WORDS) and copied == once


def test_all_texts_teach_languages_and_margin(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(f"{prose(rng, lang, 12)} {''.join(chr(97 + int(c)) for c in f'{i:05}')}{lang}", lang) for lang in WORDS for i in range(1500)]
    df = spark.createDataFrame(rows, "text string, lang string")
    judged, narrow_of = [], langid.narrow_of
    monkeypatch.setattr(langid, "narrow_of", lambda seen: (judged.append(sum(s[2] if len(s) > 2 else 1 for s in seen)), narrow_of(seen))[1])
    model = langid.fit(df)
    words = {k: set(d.decode().split()) for k, d in model.dictionaries}
    assert all(text.split()[-1] in words[lang] for text, lang in rows) and judged == [len(rows)]
    copied = langid.dictionaries(df.withColumn("half", F.lit(0)).unionByName(df.withColumn("half", F.lit(0))))
    assert copied[None] == copied[0] == model.dictionaries
    assert langid.narrow_of([(0.0, False, 2), (0.1, True, 5), (0.2, False, 1)]) == 0.0


# --- toxicity ---


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(900):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "river", "stone", "cloud"]) + str(rng.randrange(50)) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            words.insert(rng.randrange(40), rng.choice(["scoundrel", "nitwit"]))
        docs.append((i, " ".join(words), "s"))
        labels.append((i, int(bad)))
    docs += [(2000, None, "s"), (2001, "", "s"), (2002, "stone " * 30_000, "s"), (2003, "a nitwit, indeed", "s"), (1, docs[1][1], "s")]
    labels += [(2000, None), (None, 1), (9999, 1), (4, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxic_scores(labelled):
    docs, labels = labelled
    got = toxicity.predictions(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)
    assert by[2001]["predicted"] == by[2000]["predicted"] == by[2002]["predicted"] == 0 and by[2003]["predicted"] == 1
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    assert sum(r["doc_id"] % 4 == 0 for r in kept.collect() if r["doc_id"] < 900) < 15


def test_degenerate_labels(labelled):
    docs, labels = labelled
    assert {r["score"] for r in toxicity.predictions(docs, labels.limit(0)).collect()} == {0.5}
    assert all(r["predicted"] == 0 for r in toxicity.predictions(docs, labels.where("toxic = 0")).collect())
    assert toxicity.predictions(docs.limit(0), labels).collect() == []


def test_pairs_tell_what_no_single_term_tells():
    rng = np.random.default_rng(1)
    a, b = toxicity.terms("insult")[0], toxicity.terms("group")[0]
    rows, y = [], []
    for _ in range(3000):
        u, v = rng.integers(0, 2, 2)
        rows.append(np.unique(np.array([x for x, on in ((a, u), (b, v)) if on] + rng.integers(0, 30, 3).tolist(), np.int32)))
        y.append(int(u and v))
    m = toxicity.train(rows, y)
    both, one = np.array([a, b]), np.array([a])
    assert m.score(both) > 0.8 and m.score(one) < 0.3 and m.score(np.array([b])) < 0.3
    s = m.factors[m.slot[both]].sum(0)
    assert 0.5 * ((s * s).sum() - (m.factors[m.slot[both]] ** 2).sum()) > 0.5  # the pair itself carries weight


def test_bias_is_the_share_of_all_labels(labelled):
    docs, labels = labelled  # 225 toxic and 676 clean rows
    for most in (6000, 100, 20):
        m = toxicity.fit(docs, labels, most)
        assert m.bias == pytest.approx(math.log(226 / 677)), most
    m = toxicity.fit(docs, labels, 100)
    assert m.score(toxicity.terms("")) < 0.3 and m.score(toxicity.terms("a nitwit, indeed")) > 0.7


def test_a_task_learns_and_not_the_driver(labelled, monkeypatch):
    docs, labels = labelled
    monkeypatch.setattr(toxicity, "train", lambda rows, labels, totals: (os.getpid(), sorted((y, r.tolist()) for r, y in zip(rows, labels, strict=True)), totals))
    learner, rows, totals = toxicity.fit(docs, labels)
    told = {r["doc_id"]: int(r["doc_id"] % 4 == 0) for r in docs.collect() if r["doc_id"] < 900}
    # document 1 stands there twice with one text
    assert rows == sorted((told[r["doc_id"]], toxicity.terms(r["text"]).tolist()) for r in docs.dropDuplicates(["doc_id"]).collect() if r["doc_id"] in told)
    assert totals == (676, 225) and learner != os.getpid()
    assert toxicity.fit(docs.limit(0), labels)[1:] == ([], (0, 0))


def test_a_weighted_sample_is_calibrated_to_the_share():
    rng = np.random.default_rng(4)
    rows = [np.unique(np.array([int(rng.random() < (0.7 if i % 2 else 0.3)), *rng.integers(2, 20, 3)], np.int32)) for i in range(4000)]
    y = [i % 2 for i in range(4000)]
    m = toxicity.train(rows, y, totals=(90_000, 10_000))
    p = np.array([m.score(r) for r in rows])
    assert np.average(p, weights=np.where(np.array(y) == 1, 10_000, 90_000)) == pytest.approx(0.1, abs=0.03)


# --- top-k ---


def brute(rows, every, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in ok:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in ok if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 8])
def test_top_k_is_exact(spark, block):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(0, 0.2, 40))]) for i in range(500)]
    rows += [(i + 500, rows[i][1]) for i in range(60)]  # ties
    rows += [(1000, None), (1050, [float("nan")] * 40), (1100, [None] * 40), (None, [1.0] * 40), (1150, []), (1200, [0.0] * 40), (1250, [0.5] * 3), (1251, [float("inf")] * 40)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, score int, rank int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(df, "vec_id % 50 = 0", block=block).collect())
    assert got == brute(rows, 50, 5)


def test_top_k_with_repeated_query_ids(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(0, 0.2, 8))]) for i in range(200)]
    rows += [(i, [3 * x for x in rows[i][1]]) for i in (0, 50, 50, 100, 100, 100, 100, 100, 100, 100)]  # of one batch, the best scores of their ids
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(df, "vec_id % 50 = 0").collect())
    assert got == brute(rows, 50, 5)


def test_top_k_of_large_and_few_numbers(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 1e6, 5)]) for i in range(60)]
    schema = "vec_id long, embedding array<float>"
    got = sorted(map(tuple, topk.search(spark.createDataFrame(rows, schema), "vec_id % 50 = 0").collect()))
    assert got == brute(rows, 50, 5)
    few = [(0, [1.0]), (1, [0.5])]
    assert sorted(map(tuple, topk.search(spark.createDataFrame(few, schema), "vec_id % 50 = 0").collect())) == brute(few, 50, 5)
    assert topk.search(spark.createDataFrame([], schema), "vec_id % 50 = 0").collect() == []
