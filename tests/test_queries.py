"""Every registered query against its SQL, or at least once to its end, on the smallest tables."""

import compare
import pytest

from loomspark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_agrees_with_sql(spark, con, name):
    assert compare.differences(spark, con, registry.QUERIES[name], registry.ORACLE_SQL[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)


def test_learners_meet_whole_tables(spark, monkeypatch):
    from loomspark.operators.ml import margins, neighbours, trees
    from loomspark.plans import queries_learn as Q

    met = {}

    def catch(name, out):
        def run(rows, *args, **how):
            met[name] = (rows.count(), rows.columns, args, how, rows)
            return out

        return run

    every = registry.vectors(spark, SF)
    empty = spark.createDataFrame([], "feature int, score double")
    monkeypatch.setattr(neighbours, "relief", catch("relief", empty))
    monkeypatch.setattr(margins, "one_against_one", catch("one_against_one", None))
    monkeypatch.setattr(margins, "vote", lambda rows, machines: rows)
    monkeypatch.setattr(trees, "active_learning", catch("active_learning", [(0.1, 0.1)]))
    for q in (Q.relief, Q.one_against_one, Q.active_learning):
        q(spark, SF)
    assert met["relief"][0] == met["one_against_one"][0] == every.count()
    assert {len(r["features"]) for r in met["relief"][4].select("features").collect()} == {64}
    assert met["one_against_one"][2] == (sorted({r["label"] for r in every.select("label").collect()}),) and "most" not in met["one_against_one"][3]
    assert met["active_learning"][0] == registry.item_features(spark, SF).count()


def test_entry_point():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(registry.QUERIES) <= set(e.queries())
