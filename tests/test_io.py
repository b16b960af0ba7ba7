import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.sources import readers as S
from loomspark.sources import sinks as K
from loomspark.streaming import events as E


def put(path, text):
    path.write_text(text, encoding="utf8")
    return f"file://{path}"


def test_readers(spark, tmp_path):
    with gzip.open(tmp_path / "r.csv.gz", "wt") as f:
        f.write("S1,19120101,TMAX,-75,,,E,\nS2,19120101,TMIN,x,,,\n")
    assert [(r["station"], r["value"]) for r in S.station_readings(spark, f"file://{tmp_path}/r.csv.gz").collect()] == [("S1", -75), ("S2", None)]
    assert S.named_pages(spark, put(tmp_path / "p", "A:<a>:x\nB~:y\nnone\n")).collect() == [("A", "<a>:x")]
    assert S.labelled_csv(spark, put(tmp_path / "c", "id,x1,x2,y\nt1,0.5,2,1\n"), skip=1, bias=True).collect() == [([1.0, 0.5, 2.0], 1.0)]
    assert S.numbers(spark, put(tmp_path / "n", " 0.1  nan 3\n\n 1 2 -1\n"), label_map={-1: 0}).collect() == [([0.1, None], 3.0), ([1.0, 2.0], 0.0)]
    assert S.arff(spark, put(tmp_path / "a", "@relation x\n% note\n0.1,0.5,car\n")).collect() == [([0.1, 0.5], "car")]
    assert S.sparse_vectors(spark, put(tmp_path / "s", "3 0:1.0 17:2.0\n")).collect() == [(3, {0: 1.0, 17: 2.0})]
    uci = S.uci(spark, put(tmp_path / "u.config", "2 1 1\n-1000\n2 a b\n2 - +\n0\n"), put(tmp_path / "u.data", "3.5 a +\n? b -\n1.5 a -\n")).collect()
    assert uci == [([3.5, 1.0, 0.0], 1), ([2.5, 0.0, 1.0], 0), ([1.5, 1.0, 0.0], 0)]
    both = S.side_by_side(spark, put(tmp_path / "l", "a\nb\nc\n"), put(tmp_path / "m", "x\ny\n")).orderBy("row").collect()
    assert [tuple(r) for r in both] == [(0, "a", "x"), (1, "b", "y")]
    assert S.translation_dictionary(spark, put(tmp_path / "d", "-\tja\t-10.5\nbad line\n")).collect() == [("-", "ja", -10.5)]
    assert S.grammar_rules(spark, put(tmp_path / "g", "# c\n8 S1 DECL .\n\n1 E\n")).collect() == [("S1", 8, ["DECL", "."]), ("E", 1, [])]
    assert S.arcs(spark, put(tmp_path / "f", "0 1 a b\n1\n")).collect() == [("0", "1", "a", "b")]
    assert S.symbols(spark, put(tmp_path / "y", "zero 17\n")).collect() == [("zero", 17)]
    start, goals, edges = S.search_graph(spark, "start_state: A\ngoal_states: C\nA 0:A->B B 2.0\nB 1:B->C C\n")
    assert (start, goals) == ("A", ["C"]) and {tuple(r) for r in edges.collect()} == {("A", "B", "0:A->B", 2.0), ("B", "C", "1:B->C", 1.0)}
    assert S.identity_patterns(spark, 3).orderBy("id").first()["input"] == [1.0, 0.0, 0.0]
    assert {r["kind"] for r in S.grid_cells(spark, [[" ", "#", 1]]).collect()} == {"free", "wall", "exit"}
    assert S.stop_words(spark, put(tmp_path / "w", "the\n\nthe\n")).collect() == [("the",)]
    xml = put(tmp_path / "r.xml", "<REGIONS><REGION><NAME>The X</NAME><FACTBOOK>[b]hi[/b]</FACTBOOK><EMBASSIES><EMBASSY>Y</EMBASSY><EMBASSY>Z</EMBASSY></EMBASSIES></REGION><REGION><NAME>E</NAME></REGION></REGIONS>")
    assert {(r["name"], tuple(r["embassies"])) for r in S.regions(spark, xml).collect()} == {("The X", ("Y", "Z")), ("E", ())}
    (tmp_path / "i").write_bytes(struct.pack(">4i", 2051, 2, 1, 2) + bytes([1, 2, 3, 4]))
    (tmp_path / "j").write_bytes(struct.pack(">2i", 2049, 2) + bytes([7, 9]))
    assert [(r["id"], bytes(r["pixels"])) for r in S.idx_images(spark, f"file://{tmp_path}/i", f"file://{tmp_path}/j", [9]).collect()] == [(1, b"\3\4")]
    assert S.lines(spark, f"file://{tmp_path}/l").count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, None), ("b", None, 2.0)], "station string, low double, high double")
    K.keyed_text(df, "station", K.pair_text(F.col("low"), F.col("high")), f"file://{tmp_path}/t")
    assert {r["value"] for r in spark.read.text(f"file://{tmp_path}/t").collect()} == {"a\t(1.5,NaN)", "b\t(NaN,2.0)"}
    K.routed(df, F.when(F.col("low").isNull(), "empty").otherwise("full"), f"file://{tmp_path}/r")
    assert spark.read.parquet(f"file://{tmp_path}/r/kind=empty").count() == 1
    table = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    changed = spark.createDataFrame([(2, "z"), (3, "w")], "id int, v string")
    assert {tuple(r) for r in K.upserted(table, changed, ["id"]).collect()} == {(1, "x"), (2, "z"), (3, "w")}
    assert {tuple(r) for r in K.inserted(table, changed.union(changed), ["id"]).collect()} == {(1, "x"), (2, "y"), (3, "w")}


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(400)
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = E.source(spark, f"file://{tmp_path}/in", events.schema)
    q = E.daily_means(stream, "60 days").writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    show = lambda df: sorted((str(r["day"]), r["event_type"], r["n"], round(r["mean"], 6)) for r in df.collect())
    assert show(spark.table("daily")) == show(E.daily_means(spark.read.parquet(f"file://{tmp_path}/in")))
    got = {}
    q = E.running_means(stream).writeStream.outputMode("update").foreachBatch(lambda b, i: got.update({r["user_id"]: (r["n"], round(r["mean"], 6)) for r in b.collect()})).start()
    q.processAllAvailable()
    q.stop()
    want = {r["user_id"]: (r["n"], round(r["m"], 6)) for r in spark.read.parquet(f"file://{tmp_path}/in").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("m")).collect()}
    assert got == want
    fit = E.StreamedDescent(["value"], "value", 0.0001)
    batches = []
    q = stream.writeStream.foreachBatch(lambda b, i: (batches.append([r["value"] for r in b.select("value").collect()]), fit(b, i))).start()
    q.processAllAvailable()
    q.stop()
    w = np.zeros(2)  # a step for each batch, by hand
    for own in batches:
        x = np.c_[np.ones(len(own)), own]
        w -= 0.0001 * x.T @ (x @ w - own) / len(own)
    assert [fit.weights["bias"], fit.weights["value"]] == pytest.approx(w.tolist()) and len(batches) == 3


def test_session_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(f"file://{tmp_path}/in")
    stream = E.source(spark, f"file://{tmp_path}/in", events.schema)
    q = E.sessions(stream, "2 days", "60 days").writeStream.outputMode("complete").format("memory").queryName("sessions").start()
    q.processAllAvailable()
    q.stop()
    show = lambda df: sorted((r["user_id"], str(r["start"]), str(r["end"]), r["n"]) for r in df.collect())
    assert show(spark.table("sessions")) == show(E.sessions(events, "2 days"))


def test_more_readers(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in.csv", "x,y\n" + "".join(f"{i},{i / 2}\n" for i in range(25_000)))
        z.writestr("other.csv", "1,2\n")
    got = S.zipped_csv(spark, f"file://{tmp_path}/a.zip", "in.csv", "x int, y double", header=True)
    assert got.count() == 25_000 and got.agg(F.sum("x"), F.sum("y")).first() == (312487500, 156243750.0)
    df = spark.range(100).withColumnRenamed("id", "k")
    assert sorted(r["k"] for r in S.row_range(df, "k", 10, 13).collect()) == [10, 11, 12]
    for i in range(3):
        df.where(f"k % 3 = {i}").write.parquet(f"file://{tmp_path}/iter{i}")
    assert S.part_files(spark, f"file://{tmp_path}/iter*").count() == 100
    assert spark.createDataFrame([("<TAGS><TAG>a</TAG><tag>b</tag></TAGS>",)], "t string").select(S.tags_of(F.col("t")).alias("x")).first()["x"] == ["a", "b"]
    assert S.unlabelled(spark.createDataFrame([(None, 1.0), (None, None), (1, 2.0)], "label int, margin double"), margin="margin").count() == 1
    lines = put(tmp_path / "a.arff", "@relation x\n0.1,0.5,car\n0.2,0.6,van\n")
    assert S.arff(spark, lines, keep=lambda c: c.endswith("car"), label=lambda c: (c == "car").cast("int")).collect() == [([0.1, 0.5], 1)]
    pairs = put(tmp_path / "pairs", "a b\tja\t-1.5\nx\ty\t-2.0\na b\tja\t-0.5\nx\ty\t3.0\nx y z\n")
    assert sorted(map(tuple, S.translation_dictionary(spark, pairs).collect())) == [("a b", "ja", -0.5), ("x", "y", -2.0)]


def test_more_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.5], 1, 0), ("b", [3.0, 4.0], 0, 1)], "k string, x array<double>, y int, fold int")
    at = f"file://{tmp_path}"
    K.tab_separated(df.select("k", "y"), f"{at}/tsv", single=True, header=True)
    assert sorted(r["value"] for r in spark.read.text(f"{at}/tsv").collect()) == ["a\t1", "b\t0", "k\ty"]
    K.columnar(df, f"{at}/col", ["fold"])
    assert spark.read.parquet(f"{at}/col/fold=1").first()["k"] == "b"
    K.fold_files(df, f"{at}/folds")
    assert spark.read.parquet(f"{at}/folds").where("fold = 0").count() == 1
    K.single_file(df.select("k"), f"{at}/one")
    assert sorted(r["value"] for r in spark.read.text(f"{at}/one").collect()) == ["a", "b"]
    K.delimited(df, "x", "y", f"{at}/d")
    assert sorted(r["value"] for r in spark.read.text(f"{at}/d").collect()) == ["1.0,2.5,1", "3.0,4.0,0"]
    K.heads(spark.range(50).withColumnRenamed("id", "k"), "k", [2, 5], f"{at}/heads")
    assert sorted(r["k"] for r in spark.read.parquet(f"{at}/heads/head=5").collect()) == [0, 1, 2, 3, 4]
    K.trial_report(df.select("k", "y"), spark.createDataFrame([(1.0,), (3.0,)], "elapsed_ms double"), f"{at}/trial")
    assert {r["value"] for r in spark.read.text(f"{at}/trial/times").collect()} == {"least\tmost\tmean", "1.0\t3.0\t2.0"}
    trees = spark.createDataFrame([(1, "[ a/b < c/EPSILON EPSILON/and/or > ]"), (2, None)], "id long, tree string")
    K.alignment_text(trees, f"{at}/align")
    assert {r["value"] for r in spark.read.text(f"{at}/align/counts").collect()} == {"alignments\t1", "translations\t1", "source_only\t1", "target_only\t1", "in_order\t1", "reversed\t1"}
