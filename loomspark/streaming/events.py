"""Structured Streaming over event tables: windows with watermarks, and stateful folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A stream gets a watermark, which needs timestamps with a zone; a batch stays as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def daily_means(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, event_type, n, mean) by tumbling days; the same plan serves batch and stream."""
    return _timed(events, late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("day"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, n) of sessions that end after a gap."""
    return _timed(events, late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_means(events: DataFrame) -> DataFrame:
    """(user_id, n, mean) updated with each micro-batch: an arbitrary stateful fold per user."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key, frames, state: GroupState):
        import pandas as pd

        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "mean": [total / n if n else None]})

    return events.groupBy("user_id").applyInPandasWithState(fold, "user_id long, n long, mean double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


class StreamedDescent:
    """Weights that follow a stream: each micro-batch is one gradient step. Use as foreachBatch."""

    def __init__(self, features: list[str], label: str, rate: float = 0.1):
        self.features, self.label, self.rate = ["bias", *features], label, rate
        self.weights = dict.fromkeys(self.features, 0.0)

    def __call__(self, batch: DataFrame, number: int) -> None:
        from loomspark.operators.ml.linear import predict

        rows = batch.withColumn("bias", F.lit(1.0))
        e = predict(self.weights) - F.col(self.label)
        got = rows.agg(*[F.avg(e * F.col(f)).alias(f) for f in self.features]).first()
        self.weights = {f: w - self.rate * (got[f] or 0.0) for f, w in self.weights.items()}
