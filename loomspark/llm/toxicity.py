"""Toxicity by a factorization machine over hashed terms.

A document is the set of its words and of their beginnings, hashed to 2**20 buckets. A score is
sigmoid(b * (w0 + sum of w_i + mean over the document's pairable terms of their pairs' <v_i, v_j>)); the pair term lets
an insult with a group mention weigh more than either does alone. w0 is the log-odds of all labelled rows that may be
learned from and isn't learned, and the sample's rows weigh as many of these as they stand for, so that scores mean the
same at every size. Learning takes a bounded sample of labelled rows (MOST of each label, TERMS buckets of each
text, by hash) that aren't held out. Every bucket that LEAST rows of the sample hold has a weight, and factors if LEAST
toxic ones do, whatever it tells alone; there is no selection before the learning. Weights follow the regularised leader
with a penalty on their size (FTRL-proximal), which leaves those at zero whose gradients add up to no more than noise;
factors take Adagrad steps and lose a little of their length each time, which ends those that no pair keeps alive. The
last fifth of the sample calibrates b. All documents are scored whole.

Null or empty text has no terms and scores as such. Labels that are null, or whose document is missing,
teach nothing; a document labelled twice counts as toxic if one label says so. With one class only (or no
label at all) every score is the smoothed share of toxic labels.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh, held_out, release, ship, tidied

BITS = 20
#: Bytes of the beginnings that are terms besides whole words: they catch inflected and compounded insults.
BEGINNINGS = (4, 5, 6)
#: Bound of the sample: labelled rows of each label.
MOST = 6000
#: Buckets of a sampled text that are learned from at most; rows of the sample that must hold a bucket.
TERMS, LEAST = 2048, 3
FACTORS, EPOCHS = 8, 12
#: Of the weights: first step, penalty on their size (times the root of the rows) and on their square.
RATE, SPARSE, RIDGE = 0.3, 0.45, 1.0
#: Of the factors: step, loss of length (over the root of the rows), spread at first.
STEP, SHRINK, SPREAD = 1.0, 0.45, 0.3

_WORD = bytes(c if chr(c).isalnum() and c < 128 or c > 127 else 32 for c in range(256))


def terms(text: str | None) -> np.ndarray:
    """Distinct buckets of the text's words and beginnings (in bytes of UTF-8), sorted."""
    words = set((text or "").lower().encode().translate(_WORD).split())
    found = list(map(zlib.crc32, words))
    for n in BEGINNINGS:
        found += [zlib.crc32(w, n) for w in {w[:n] for w in words if len(w) > n}]
    return np.unique(np.array(found, np.int64) & ((1 << BITS) - 1)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    slot: np.ndarray  # of each bucket, or -1
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    paired: np.ndarray  # whether a slot has had factors
    scale: float = 1.0

    def score(self, buckets: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.raw(buckets), -40, 40))))

    def raw(self, buckets: np.ndarray) -> float:
        own = self.slot[buckets]
        own = own[own >= 0]
        v = self.factors[own].astype(np.float64)
        s = v.sum(0)
        return float(self.bias + self.weights[own].sum(dtype=np.float64) + 0.5 * ((s * s).sum() - (v * v).sum()) / max(1, self.paired[own].sum()))


def train(rows: list[np.ndarray], labels: list[int], seed: int = 7, totals: tuple[int, int] | None = None) -> Model:
    """Fit on the sample's buckets; deterministic.

    `totals` counts the clean and the toxic rows that the sample stands for: its rows weigh accordingly.
    """
    y = np.array(labels, np.float64)
    slot = np.full(1 << BITS, -1, np.int32)
    clean, toxic = totals or (len(y) - y.sum(), y.sum())
    rate = (toxic + 1) / (clean + toxic + 2)
    bias = float(np.log(rate / (1 - rate)))
    nothing = Model(slot, bias, np.zeros(1, np.float32), np.zeros((1, FACTORS), np.float32), np.zeros(1, bool))
    if len(set(labels)) < 2:
        return nothing
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    rows, y = [rows[i] for i in order], y[order]
    weight = np.where(y == 1, toxic / y.sum(), clean / (len(y) - y.sum())) * (len(y) / (clean + toxic))  # 1 on average
    fit_n = len(y) - len(y) // 5
    held = np.bincount(np.concatenate(rows[:fit_n]), minlength=1 << BITS)
    kept = np.flatnonzero(held >= LEAST)
    if not len(kept):
        return nothing
    slot[kept] = np.arange(len(kept))
    own = [s[s >= 0] for s in (slot[r] for r in rows[:fit_n])]
    size = len(kept)
    w, drift, seen = np.zeros(size), np.zeros(size), np.zeros(size)  # weights, and their gradients' corrected sum and squares
    paired = np.bincount(np.concatenate([o for o, t in zip(own, y, strict=False) if t] or [np.empty(0, np.int32)]), minlength=size) >= LEAST
    share = 1 / np.maximum(1, np.array([paired[o].sum() for o in own]))
    v = rng.normal(0, SPREAD, (size, FACTORS)).astype(np.float32) * paired[:, None]
    moved = np.full(size, 1e-2, np.float32)
    sparse, shrink = SPARSE * fit_n**0.5, SHRINK / fit_n**0.5
    sums = lambda x, where, n: np.stack([np.bincount(where, c, n).astype(np.float32) for c in x.T], 1)
    for _ in range(EPOCHS):
        live = np.flatnonzero(v.any(1))
        place = np.full(size, -1, np.int32)
        place[live] = np.arange(len(live))
        for part in np.array_split(rng.permutation(fit_n), max(1, min(fit_n // 16, max(32, fit_n // 256)))):
            flat = np.concatenate([own[i] for i in part])
            row = np.repeat(np.arange(len(part)), [len(own[i]) for i in part])
            at = place[flat]
            among = at >= 0
            at, near = at[among], row[among]  # terms with factors
            f = v[live[at]]
            s = sums(f, near, len(part))
            z = bias + np.bincount(row, w[flat], len(part)) + 0.5 * share[part] * ((s * s).sum(1) - np.bincount(near, (f * f).sum(1), len(part)))
            e = weight[part] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[part])
            g = np.bincount(flat, e[row], size)
            drift += g - (np.sqrt(seen + g * g) - np.sqrt(seen)) / RATE * w
            seen += g * g
            w = -np.sign(drift) * np.maximum(0, np.abs(drift) - sparse) / ((0.1 + np.sqrt(seen)) / RATE + RIDGE)
            if len(live):
                g = sums((e * share[part]).astype(np.float32)[near][:, None] * (s[near] - f), at, len(live))
                moved[live] += (g * g).sum(1)
                step = STEP / np.sqrt(moved[live])
                new = v[live] - step[:, None] * g
                length = np.sqrt((new * new).sum(1)) + 1e-12
                v[live] = new * np.maximum(0, 1 - step * shrink * np.bincount(at, minlength=len(live)) / length)[:, None]
    w, v = w.astype(np.float32), v.astype(np.float32)
    model = Model(slot, bias, w, v, paired)
    z, t, u = np.array([model.raw(r) for r in rows[fit_n:]]), y[fit_n:], weight[fit_n:]
    b = 1.0  # Newton's steps on the held part of the sample, with a weak prior at 1
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(b * z, -40, 40)))
        b -= ((u * (p - t) * z).sum() + (b - 1)) / ((u * p * (1 - p) * z * z).sum() + 1)
        b = min(max(b, 0.2), 5.0)
    return Model(slot, bias, w, v, paired, float(b))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    """Learn from at most `most` labelled rows of each label, weighted to the share of all; held-out rows must not be in `labels`."""
    ship(docs.sparkSession)
    told = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = told.withColumn("h", F.xxhash64("doc_id"))
    some = by_hash.where("toxic = 1").orderBy("h", "doc_id").limit(most).unionByName(by_hash.where("toxic = 0").orderBy("h", "doc_id").limit(most))

    import pyarrow as pa

    def few(found: np.ndarray) -> np.ndarray:  # buckets are hashes, so those that are least in another order are a sample
        return found if len(found) <= TERMS else np.sort(found[np.argsort((found.astype(np.uint32) * np.uint32(2654435761)) & np.uint32(0xFFFFFFFF), kind="stable")[:TERMS]])

    def run(parts):
        for part in parts:
            own = [few(terms(t)).tobytes() for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own, pa.binary())], ["h", "toxic", "terms"])

    all_ = {r["toxic"]: r["count"] for r in docs.where("text IS NOT NULL").select("doc_id").join(told, "doc_id").groupBy("toxic").count().collect()}
    totals = (all_.get(0, 0), all_.get(1, 0))

    def learn(parts):
        found = sorted(r for part in parts for r in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True))
        if found:
            model = train([np.frombuffer(t, np.int32) for _, _, t in found], [y for _, y, _ in found], totals=totals)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    sample = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(some), "doc_id")  # 2 * most rows
    learned = sample.select("h", "toxic", "text").mapInArrow(tidied(run), "h long, toxic int, terms binary")
    # rows that repeat an id count once for each different text, and never more of them than the sample may hold: 2 * most * TERMS * 4 bytes
    # (one task holds them and learns, so that the driver gets nothing but the model)
    found = learned.distinct().limit(2 * most).coalesce(1).mapInArrow(tidied(learn), "model binary").collect()
    model = pickle.loads(found[0]["model"]) if found else train([], [], totals=totals)
    release(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Adds score (under a fresh name where it clashes) to the columns in `keep` (the id only, by default); one narrow pass."""
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # 4 MB for the slots, 36 bytes for each learned bucket, of which there are 2**20 at most
    carried = keep or ["doc_id"]

    def run(parts):
        m = shared.value
        for part in parts:
            for start in range(0, part.num_rows, 500):
                own = part.slice(start, 500)
                found = [m.score(terms(t)) for t in own.column(own.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(found, pa.float64())], [*[f"c{i}" for i in range(len(carried))], "score"])

    types = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carried))
    out = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(carried)], docs[text_col].alias("text"))
    return out.mapInArrow(tidied(run), f"{types}, score double").toDF(*carried, fresh("score", carried))


#: From this score on a document is predicted toxic.
TOXIC = 0.7


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's rows."""
    out = score(docs, fit(docs, labels.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that aren't predicted toxic, with the columns they came with."""
    out = score(docs, fit(docs, labels.where(~held_out())), keep=docs.columns)
    return out.where(F.col(out.columns[-1]) < TOXIC).select(*docs.columns)
