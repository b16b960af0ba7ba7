"""Queries on tables that differ from the driver's smallest ones: repeated keys, rows split over files, larger blocks."""

import datetime

import compare
import duckdb
import numpy as np
import pytest

from loomspark.operators import blocks, boxes
from loomspark.operators.ml import neighbours
from loomspark.plans import registry


def _against_sql(spark, folder, name, table):
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return compare.differences(spark, con, registry.QUERIES[name], registry.ORACLE_SQL[name], str(folder))


def test_pages_given_twice_keep_all_links(spark, tmp_path):
    a = lambda *to: "".join(f'<a href="{t}">x</a>' for t in to)
    pages = [(1, "u", a("v", "w")), (2, "u", a("x")), (3, "v", a("u")), (4, "u", a("v", "v")), (5, "y", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert _against_sql(spark, tmp_path, "pagerank_pages", "pages") is None


@pytest.mark.parametrize("files", [1, 4])
def test_means_do_not_hang_on_the_split(spark, tmp_path, files):
    values = [94.48, 87.84, 13.4, 54.57]  # summed in this order the mean shows as 62.572, backwards as 62.573
    day = datetime.datetime(2024, 1, 1, 12)
    rows = [(i, day, 7, "view", v, "") for i, v in enumerate(values)] + [(9, day, 7, "click", None, ""), (10, day, 8, "click", 1.5, "")]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    for i in range(files):  # the last events come first
        df.where(f"pmod(event_id, {files}) = {files - 1 - i}").coalesce(1).sortWithinPartitions("event_id", ascending=False).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    found = {r["station"]: r["series"] for r in registry.QUERIES["time_series"](spark, str(tmp_path)).collect()}
    assert found == {7: "2024-01-01:62.572:NaN", 8: "2024-01-01:NaN:1.500"}


def test_nearest_points_meet_in_blocks(spark):
    plan = registry.QUERIES["nearest_neighbours"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_few_pairs_are_sorted(monkeypatch):
    """Of 40 batches of 1,000 points only what comes near the k-th place is sorted, ties and copies included."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(8, 3)).round(1), rng.normal(size=(40_000, 3)).round(1)
    y[5000:9000] = x[0]
    ids, labels = rng.permutation(40_000), np.zeros(40_000, np.int64)
    sorted_, plain = [], np.lexsort

    def counted(keys, **how):
        sorted_.append(np.size(keys[0]))
        return plain(keys, **how)

    monkeypatch.setattr(np, "lexsort", counted)
    near = blocks.Nearest(8, 1, 7)
    for s in range(0, 40_000, 1000):
        near.offer(0, blocks.squares(x, y[s : s + 1000]), ids[s : s + 1000], labels[s : s + 1000])
        near.merge()
    monkeypatch.undo()
    d = blocks.squares(x, y)
    assert [list(r) for r in near.p[0]] == [ids[np.lexsort((ids, r))[:7]].tolist() for r in d]
    assert sum(sorted_) < 8 * 40_000 / 10


def test_selection_of_repeated_rows_by_hand(spark):
    rows = [(i, [float(i % 3), float(i)], int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label long").repartition(5)
    assert neighbours.wrapper_selection(df, 2) == [0]
    assert {r["m"]: r["accuracy"] for r in neighbours.leave_one_out(df, [[0], [1]]).collect()}[0] == 1.0


def test_workers_get_the_package(spark, monkeypatch):
    called = []
    monkeypatch.setattr(blocks, "ship", called.append)
    df = spark.createDataFrame([(i, [float(i)], i % 2) for i in range(6)], "id long, features array<double>, label long")
    assert neighbours.leave_one_out(df, [[0]], 1).count() == 1 and called


def test_selection_by_filter_ranks_no_pairs_in_a_window(spark):
    df = spark.createDataFrame([(i, [float(i % 5), float(i)], int(i % 5 > 2)) for i in range(40)], "id long, features array<double>, label long")
    found = neighbours.filter_selection(df, 2, 3)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["m"]: r["accuracy"] for r in found.collect()}[0] == 1.0


def test_screening_by_products_loses_no_near_point(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(3000, 6)), 1) + 1e6  # far from zero, with many ties
    x[:40], x[7, 2], x[9, 0] = x[40], np.nan, 1e11
    x[100:1500, 1] = x[100, 1]
    ids, labels = rng.permutation(3000), rng.integers(0, 2, 3000)
    lists = [[3], [3, 1], [3, 1, 0], [3, 1, 0, 5], [2, 4], [2, 5]]
    near = blocks.Nearest(200, len(lists), 7)
    met: list[int] = []
    square = blocks.square
    monkeypatch.setattr(blocks, "square", lambda a, b, j: (met.append(len(a) * len(b)), square(a, b, j))[1])
    mean = np.where(np.isfinite(x), x, 0).mean(0)
    single = (x - mean).astype(np.float32)
    for s in (0, 100, 1100, 2100):
        e = {0: 100, 100: 1100, 1100: 2100, 2100: 3000}[s]
        blocks._screen(near, lists, (ids[:200], x[:200], single[:200]), (ids[s:e], labels[s:e], x[s:e], single[s:e]), s)
    near.merge()
    monkeypatch.undo()
    for m, positions in enumerate(lists):
        d = blocks.squares(x[:200], x, positions)
        d[np.arange(200), np.arange(200)] = np.nan
        for i in range(200):
            some = [j for j in np.lexsort((ids, d[i]))[:7] if np.isfinite(d[i, j])]
            assert near.p[m, i][: len(some)].tolist() == ids[some].tolist() and near.d[m, i][: len(some)].tolist() == d[i, some].tolist()
    far = rng.normal(size=(3000, 6))
    met.clear()
    monkeypatch.setattr(blocks, "square", lambda a, b, j: (met.append(len(a) * len(b)), square(a, b, j))[1])
    near = blocks.Nearest(200, 1, 7)
    for s in range(0, 3000, 500):
        blocks._screen(near, [[0, 1, 2, 3]], (ids[:200], far[:200], far[:200].astype(np.float32)), (ids[s : s + 500], labels[s : s + 500], far[s : s + 500], far[s : s + 500].astype(np.float32)), s)
    assert not met  # no block is worked out whole in double precision


@pytest.mark.parametrize("prefix", [[], [2], [2, 0]])
def test_boxes_lose_no_near_point(monkeypatch, prefix):
    """Lists that share all but their last position meet few pairs, with the neighbours of all pairs: ties, copies and non-finite values included."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(6000, 5)), 2)
    x[:60], x[70, 2], x[71, 2], x[72, 3] = x[60], np.nan, np.inf, np.nan
    ids, labels = rng.permutation(6000), rng.integers(0, 3, 6000)
    lists = [[*prefix, i] for i in (1, 3, 4)]
    block, met = boxes.Block(ids[:300], x[:300], lists, 7), []
    nearest = boxes._nearest_of
    monkeypatch.setattr(boxes, "_nearest_of", lambda d, k: (met.append(d.size), nearest(d, k))[1])
    search = boxes.Search(block, prefix, [0, 1, 2]) if prefix else None
    with np.errstate(all="ignore"):
        for s, e in ((0, 5), (5, 6000)):
            if search:
                search.scan(ids[s:e], labels[s:e], x[s:e])
            else:
                for m in range(3):
                    boxes.line(block, m, ids[s:e], labels[s:e], x[s:e])
        for m, positions in enumerate(lists):
            d = blocks.squares(x[:300], x, positions)
            d[np.arange(300), np.arange(300)] = np.nan
            for i in range(300):
                some = [j for j in np.lexsort((ids, d[i]))[:7] if np.isfinite(d[i, j])]
                assert block.p[m, i][: len(some)].tolist() == ids[some].tolist() and block.y[m, i][: len(some)].tolist() == labels[some].tolist()
                assert np.isfinite(block.d[m, i]).sum() == len(some)
    assert sum(met) < 3 * 300 * 6000 / 3


def test_selection_by_wrapper_screens_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, y = np.round(rng.normal(size=(300, 4)), 1), rng.integers(0, 2, 300)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id long, features array<double>, label long")
    lists = [[2, 0], [2, 1], [2, 3]]
    folds = []
    monkeypatch.setattr(blocks, "meet", lambda q, p, fold, schema, **how: (folds.append(fold), q.sparkSession.createDataFrame([], schema))[1])
    blocks.voted(*neighbours._sides(df, df), 7, lists).count()
    monkeypatch.setattr(blocks, "_screen", lambda *a: pytest.fail("all pairs are screened"))
    scan, rows = folds[0](np.arange(300), y, x)
    scan(np.arange(300), y, x)
    got = next(iter(rows())).to_pydict()
    for m, positions in enumerate(lists):
        d = blocks.squares(x, x, positions)
        np.fill_diagonal(d, np.inf)
        said = [np.bincount(y[np.lexsort((np.arange(300), r))[:7]], minlength=2).argmax() for r in d]
        assert (got["n"][m], got["good"][m]) == (300, int((said == y).sum()))
