"""Writers and the shapes they write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators.aggregates import trials
from loomspark.operators.relational import prefix_samples


def tab_separated(rows: DataFrame, path: str, single: bool = False, header: bool = False) -> None:
    (rows.coalesce(1) if single else rows).write.mode("overwrite").csv(path, sep="\t", header=header)


def trial_report(results: DataFrame, runs: DataFrame, path: str, value: str = "elapsed_ms") -> None:
    """Results as tab-separated lines in `results`, and least, largest and mean time of the runs in `times`, with names on top."""
    tab_separated(results, f"{path}/results")
    tab_separated(trials(runs, value), f"{path}/times", single=True, header=True)


def keyed_text(rows: DataFrame, key: str, value: Column, path: str) -> None:
    """Lines `key<TAB>value`."""
    rows.select(F.concat_ws("\t", F.col(key).cast("string"), value)).write.mode("overwrite").text(path)


def pair_text(a: Column, b: Column) -> Column:
    """(a,b), with NaN for null."""
    f = lambda c: F.coalesce(c.cast("string"), F.lit("NaN"))
    return F.concat(F.lit("("), f(a), F.lit(","), f(b), F.lit(")"))


def columnar(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = rows.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def routed(rows: DataFrame, kind: Column, path: str) -> None:
    """Side outputs: a folder for each kind."""
    rows.withColumn("kind", kind).write.mode("overwrite").partitionBy("kind").parquet(path)


def single_file(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").text(path)


def delimited(rows: DataFrame, features: str, label: str, path: str, sep: str = ",") -> None:
    """features and label as one line."""
    rows.select(F.concat_ws(sep, F.transform(features, lambda x: x.cast("string")), F.col(label).cast("string"))).write.mode("overwrite").text(path)


def fold_files(rows: DataFrame, path: str, fold: str = "fold") -> None:
    rows.write.mode("overwrite").partitionBy(fold).parquet(path)


def heads(rows: DataFrame, order: str, sizes: list[int], path: str) -> None:
    """The first n rows for each n, in folders head=n: the rows are put in order once."""
    prefix_samples(rows, order, sizes, seed=None).withColumnRenamed("size", "head").write.mode("overwrite").partitionBy("head").parquet(path)


def alignment_text(trees: DataFrame, path: str) -> None:
    """Derivations as lines, in folder `trees`, and their counts as `name<TAB>count` lines in `counts`."""
    from loomspark.operators.nlp import alignment_counts

    trees.where("tree IS NOT NULL").select("tree").write.mode("overwrite").text(f"{path}/trees")
    counts = alignment_counts(trees)
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in counts.columns])).alias("s")).select("s.*")
    keyed_text(long, "name", F.col("n").cast("string"), f"{path}/counts")


def upserted(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table with changed rows replaced and new ones added; changes have one row a key."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes.select(*table.columns))


def inserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is new are added, once."""
    new = rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(new.select(*table.columns))


def json_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
