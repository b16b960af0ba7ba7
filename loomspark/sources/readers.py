"""Readers of the supported inputs. Paths go to Spark's readers, so any store that Spark knows will do."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

READINGS = "station STRING, date STRING, type STRING, value INT"


def station_readings(spark: SparkSession, *paths: str) -> DataFrame:
    """CSV without header (compressed or not): station, date, type, value; more columns are ignored, bad values are null."""
    return spark.read.csv(list(paths), schema=READINGS, mode="PERMISSIVE", enforceSchema=True)


def row_range(rows: DataFrame, order: str, first: int, last: int) -> DataFrame:
    """Rows first to last - 1 in order of a column."""
    from loomspark.operators.relational import dense_index

    return dense_index(rows, order, "_at").where((F.col("_at") >= first) & (F.col("_at") < last)).drop("_at")


def lines(spark: SparkSession, *paths: str, parts: int | None = None) -> DataFrame:
    """(value, path) of text files; bz2 is split, gz is one task a file."""
    out = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("path"))
    return out.repartition(parts) if parts else out


def part_files(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.parquet(pattern)


def named_pages(spark: SparkSession, *paths: str) -> DataFrame:
    """(name, html) of lines `name:html`; names with a tilde are left out."""
    s = F.split("value", ":", 2)
    return spark.read.text(list(paths)).where(F.instr("value", ":") > 0).select(s[0].alias("name"), s[1].alias("html")).where(F.col("name").rlike("^[^~]+$"))


def page_links(pages: DataFrame, container: tuple[str, str] | None = ("div", "bodyContent"), pattern: str | None = None, dedupe: bool = True, strict: bool = False) -> DataFrame:
    """(page, targets) of pages (name, html); null without html. If strict, pages that aren't well-formed are left out, and those without html."""
    from loomspark.functions import text as X

    pages = pages.select("name", X.links_in(container, strict)(F.col("html")).alias("_hrefs"))
    pages = pages.where("_hrefs IS NOT NULL") if strict else pages
    hrefs = F.col("_hrefs")
    named = F.filter(F.transform(hrefs, lambda h: X.page_of(h, pattern or X.PAGE_LINK)), lambda h: h.isNotNull())
    return pages.select(F.col("name").alias("page"), (F.array_distinct(named) if dedupe else named).alias("targets"))


def labelled_csv(spark: SparkSession, *paths: str, skip: int = 0, header: bool = True, bias: bool = False, sep: str = ",") -> DataFrame:
    """(features, label): the last column is the label, `skip` leading ones are dropped, a leading 1 is added on request."""
    raw = spark.read.csv(list(paths), header=header, sep=sep, inferSchema=False)
    cols = [F.col(f"`{c}`").cast("double") for c in raw.columns[skip:]]
    return raw.select(F.array(*([F.lit(1.0)] * bias), *cols[:-1]).alias("features"), cols[-1].alias("label"))


def numbers(spark: SparkSession, *paths: str, sep: str = r"\s+", labelled: bool = True, bias: bool = False, label_map: dict | None = None) -> DataFrame:
    """(features, label) of lines of numbers; `nan` and `?` are null, labels may be mapped.

    Blank lines are left out wherever they stand: lines have no order across the tasks that read them, so a blank one can't end the table.
    """
    v = F.split(F.trim("value"), sep)
    x = F.transform(v, lambda s: F.when(~F.lower(F.trim(s)).isin("nan", "?", ""), s.try_cast("double")))
    out = spark.read.text(list(paths)).where("trim(value) <> ''").select(x.alias("x"))
    lead = F.array(F.lit(1.0)) if bias else F.array().cast("array<double>")
    if not labelled:
        return out.select(F.concat(lead, "x").alias("features"))
    label = F.element_at("x", -1)
    if label_map:
        table = F.create_map(*[F.lit(float(k)) for kv in label_map.items() for k in kv])
        label = F.coalesce(table[label], label)
    return out.select(F.concat(lead, F.slice("x", 1, F.size("x") - 1)).alias("features"), label.alias("label"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row, value): a file's lines by place, from 0. The place is known to the reader of whole files only, so one task reads it."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")).alias("row", "value")).select(F.col("row").cast("long"), "value")


def side_by_side(spark: SparkSession, left: str, right: str, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Lines of two files with equal numbers, up to the shorter one."""
    a, b = numbered_lines(spark, left), numbered_lines(spark, right)
    return a.withColumnRenamed("value", names[0]).join(b.withColumnRenamed("value", names[1]), "row")


def arff(spark: SparkSession, *paths: str, keep: Callable[[Column], Column] | None = None, label: Callable[[Column], Column] | None = None) -> DataFrame:
    """(features, label): lines that don't start with @ or %, label last as text.

    `keep` maps a line to whether it counts, instead of that rule; `label` maps the last field to the label.
    """
    v = F.split("value", ",")
    line = F.col("value")
    wanted = keep(line) if keep else ~line.rlike(r"^\s*(?:[@%]|$)")
    last = F.trim(F.element_at(v, -1))
    return spark.read.text(list(paths)).where(wanted).select(F.transform(F.slice(v, 1, F.size(v) - 1), lambda s: F.trim(s).try_cast("double")).alias("features"), (label(last) if label else last).alias("label"))


def uci(spark: SparkSession, config: str, data: str) -> DataFrame:
    """(features, label): nominal columns one-hot, `?` imputed by mean or mode, label 0 or 1 by the config's order of labels.

    config: sizes; a line a column, -1000 for numbers or `k v1 .. vk`; the two labels; a last line.
    """
    conf = [r["value"].split() for r in numbered_lines(spark, config).orderBy("row").collect()]
    columns, labels = conf[1:-2], conf[-2]
    labels = labels[1:] if len(labels) > 2 else labels
    raw = spark.read.text(data).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("v"))
    cell = lambda i: F.when(F.element_at("v", i + 1) != "?", F.element_at("v", i + 1))
    named = raw.select(*[(cell(i).cast("double") if c[0] == "-1000" else cell(i)).alias(f"c{i}") for i, c in enumerate(columns)], F.element_at("v", len(columns) + 1).alias("label"))
    fill = named.agg(*[(F.avg(f"c{i}") if c[0] == "-1000" else F.mode(f"c{i}", True)).alias(f"m{i}") for i, c in enumerate(columns)])
    full = named.crossJoin(F.broadcast(fill))
    parts = []
    for i, c in enumerate(columns):
        x = F.coalesce(f"c{i}", f"m{i}")
        parts += [x] if c[0] == "-1000" else [(x == F.lit(v)).cast("double") for v in c[1:]]
    return full.select(F.array(*parts).alias("features"), F.when(F.col("label") == labels[0], 0).otherwise(1).alias("label"))


def sparse_vectors(spark: SparkSession, *paths: str) -> DataFrame:
    """(label, features map<int,double>) of lines `label f:v f:v`."""
    v = F.split(F.trim("value"), r"\s+")
    pair = lambda s: F.struct(F.split(s, ":")[0].cast("int").alias("k"), F.split(s, ":")[1].cast("double").alias("v"))
    return spark.read.text(list(paths)).where("trim(value) <> ''").select(v[0].cast("int").alias("label"), F.map_from_entries(F.transform(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), pair)).alias("features"))


def idx_images(spark: SparkSession, images: str, labels: str, digits: list[int] | None = None) -> DataFrame:
    """(id, rows, cols, pixels, label) of a pair of IDX files, one image file and its label file; only the digits asked for."""
    one = lambda path, name: spark.read.format("binaryFile").load(path).limit(1).select(F.lit(1).alias("pair"), F.col("content").alias(name))
    met = one(images, "a").join(one(labels, "b"), "pair")

    def run(parts):
        import pandas as pd

        for p in parts:
            for a, b in zip(p["a"], p["b"], strict=True):
                n, h, w = np.frombuffer(a, ">i4", 3, 4).tolist()
                px, y = np.frombuffer(a, np.uint8, n * h * w, 16).reshape(n, -1), np.frombuffer(b, np.uint8, n, 8)
                for at in range(0, n, 5000):
                    yield pd.DataFrame({"id": range(at, min(n, at + 5000)), "rows": h, "cols": w, "pixels": [r.tobytes() for r in px[at : at + 5000]], "label": y[at : at + 5000].astype("int32")})

    out = met.mapInPandas(run, "id long, rows int, cols int, pixels binary, label int")
    return out.where(F.col("label").isin(digits)) if digits else out


def regions(spark: SparkSession, *paths: str) -> DataFrame:
    """(name, factbook, embassies) of an XML dump, element by element."""
    schema = T.StructType.fromDDL("NAME STRING, FACTBOOK STRING, EMBASSIES STRUCT<EMBASSY: ARRAY<STRING>>")
    raw = spark.read.format("xml").option("rowTag", "REGION").schema(schema).load(",".join(paths))
    return raw.select(F.col("NAME").alias("name"), F.col("FACTBOOK").alias("factbook"), F.coalesce("EMBASSIES.EMBASSY", F.array().cast("array<string>")).alias("embassies"))


def tags_of(page):
    """Column: texts of all TAG elements."""
    return F.regexp_extract_all(page, F.lit("(?i)<TAG>([^<]*)</TAG>"), F.lit(1))


def unlabelled(rows: DataFrame, label: str = "label", margin: str | None = None) -> DataFrame:
    """Rows without a label, and with a margin if a column of margins is named."""
    out = rows.where(F.col(label).isNull())
    return out.where(F.col(margin).isNotNull()) if margin else out


def stop_words(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.text(list(paths)).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def translation_dictionary(spark: SparkSession, *paths: str) -> DataFrame:
    """(src, tgt, score) of lines that end on a target word and a negative decimal score, after white space each.

    All before these two is the source. Other lines are left out; of lines with one source and target, the last of its file holds.
    """
    words = F.split(F.rtrim("value"), r"\s+")
    raw = spark.read.text(list(paths)).select("value", F.monotonically_increasing_id().alias("at"), words.alias("w"))
    raw = raw.where("size(w) >= 3").withColumn("last", F.element_at("w", -1)).where(F.col("last").startswith("-") & (F.instr("last", ".") > 2) & F.col("last").try_cast("double").isNotNull())
    lines_ = raw.select(F.array_join(F.slice("w", 1, F.size("w") - 2), " ").alias("src"), F.element_at("w", -2).alias("tgt"), F.col("last").cast("double").alias("score"), "at").where("src <> ''")
    return lines_.groupBy("src", "tgt").agg(F.max_by("score", "at").alias("score"))


def grammar_rules(spark: SparkSession, *paths: str) -> DataFrame:
    """(lhs, weight, rhs) of lines `weight lhs rhs..`; lines that start with # and blank ones are left out."""
    v = F.split(F.trim("value"), r"\s+")
    return spark.read.text(list(paths)).where(~F.col("value").startswith("#") & (F.size(v) > 1)).select(v[1].alias("lhs"), v[0].cast("int").alias("weight"), F.slice(v, 3, F.greatest(F.size(v) - 2, F.lit(0))).alias("rhs"))


def arcs(spark: SparkSession, *paths: str) -> DataFrame:
    """(state, next, input, output) of a transducer's text form; lines of final states are left out."""
    v = F.split(F.trim("value"), r"\s+")
    return spark.read.text(list(paths)).where(F.size(v) >= 3).select(v[0].alias("state"), v[1].alias("next"), v[2].alias("input"), F.coalesce(F.get(v, 3), v[2]).alias("output"))


def symbols(spark: SparkSession, *paths: str) -> DataFrame:
    v = F.split(F.trim("value"), r"\s+")
    return spark.read.text(list(paths)).where(F.size(v) == 2).select(v[0].alias("symbol"), v[1].cast("int").alias("id"))


def search_graph(spark: SparkSession, text: str) -> tuple[str, list[str], DataFrame]:
    """Start, goals and edges(src, dst, action, cost) of a literal; a missing cost is 1."""
    start, goals, rows = "", [], []
    for line in text.splitlines():
        if m := re.match(r"\s*start_state:\s*(\S+)", line):
            start = m[1]
        elif m := re.match(r"\s*goal_states?:\s*(.*)", line):
            goals = m[1].split()
        elif len(v := line.split()) in (3, 4):
            rows.append((v[0], v[2], v[1], float(v[3]) if len(v) == 4 else 1.0))
    return start, goals, spark.createDataFrame(rows, "src string, dst string, action string, cost double")


def identity_patterns(spark: SparkSession, bits: int = 8) -> DataFrame:
    """(id, input, target): each pattern has one bit set and is its own target."""
    one = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.when(i == F.col("id"), 1.0).otherwise(0.0))
    return spark.range(bits).select("id", one.alias("input"), one.alias("target"))


def grid_cells(spark: SparkSession, rows: list[list]) -> DataFrame:
    """(x, y, kind, reward) of a literal: ' ' or 'S' free, '#' wall, a number an exit; the last row has y = 0."""
    out = []
    for y, row in enumerate(reversed(rows)):
        for x, c in enumerate(row):
            kind = "wall" if c == "#" else "exit" if isinstance(c, (int, float)) else "free"
            out.append((x, y, kind, float(c) if kind == "exit" else 0.0))
    return spark.createDataFrame(out, "x int, y int, kind string, reward double")


def zipped_csv(spark: SparkSession, archive: str, member: str, schema: str, header: bool = False, sep: str = ",") -> DataFrame:
    """Rows of a CSV member of zip archives (any path pattern) by the schema; an archive is unpacked by the task that reads it, line by line."""

    def run(parts):
        import io
        import zipfile

        import pyarrow as pa

        for part in parts:
            for raw in part.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(raw)) as z, io.TextIOWrapper(z.open(member), "utf-8") as f:
                    held: list[str] = []
                    for i, line in enumerate(f):
                        if i or not header:
                            held.append(line.rstrip("\r\n"))
                        if len(held) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(held)], ["value"])
                            held = []
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])

    rows = spark.read.format("binaryFile").load(archive).select("content").mapInArrow(run, "value string")
    return rows.where("value <> ''").select(F.from_csv("value", schema, {"sep": sep}).alias("r")).select("r.*")
