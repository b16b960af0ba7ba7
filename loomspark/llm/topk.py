"""Exact top-k inner-product search by columnar branch and bound.

Candidates lie in vertical layout, a row for each dimension. Scores accumulate one block of dimensions after
the other; after each block, what the remaining dimensions can add at most is the product of both vectors'
remaining norms (Cauchy-Schwarz), and candidates whose bound stays below every query's k-th best score so
far are compacted away. The first such scores come from the queries themselves, which are candidates of one
another. Nothing is pruned that could enter a result, so results are exact.

Up to QUERY_BLOCK queries (counted first) are broadcast and meet every candidate in one pass without a shuffle of
the candidates. More queries are dealt by row over blocks of about half that many, and the candidates over slices;
all cells of a block and a slice are met in one job, each by a task that holds the block and reads the slice as it
streams by. A cell returns at most k rows a query, and these are ranked in the end.

Components become floor(256 * x), x as double. Vectors that are null, empty, or hold null or non-finite
components take no part, nor do rows without id. Of vectors of different lengths, the shorter counts as
padded with zeros. A query's own row is told by its id: rows that repeat a query's id are no candidates of
it; other repeated rows are candidates one by one. Scores beyond a long are clamped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import ship, tidied

QUERY_BLOCK = 4096
#: Dimensions added at a time; queries and candidates that meet at once.
DIMENSIONS, QUERIES, CANDIDATES = 16, 128, 4096
_LONG = (1 << 63) - 1


def quantised(column) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their integer components as floats) of an Arrow list column."""
    import pyarrow as pa
    import pyarrow.compute as pc

    n = len(column)
    lens = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(column.flatten(), pa.float64())
    x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n), lens)
    good = lens > 0
    good[row[~np.isfinite(x)]] = False
    width = int(lens.max(initial=0))
    out = np.zeros((n, width))
    at = np.arange(len(x)) - np.repeat(np.cumsum(lens) - lens, lens)
    with np.errstate(invalid="ignore", over="ignore"):
        out[row, at] = np.floor(256 * x)
    keep = np.flatnonzero(good)
    return keep, out[keep]


def _fit(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _tails(x: np.ndarray) -> np.ndarray:
    """Norm of what follows each block of dimensions, a little too large rather than too small."""
    total = np.cumsum((x * x)[:, ::-1], 1)[:, ::-1]
    total = np.concatenate((total, np.zeros((len(x), 1))), 1)
    return np.sqrt(total[:, range(DIMENSIONS, x.shape[1] + DIMENSIONS, DIMENSIONS) if x.shape[1] % DIMENSIONS == 0 else [min(i, x.shape[1]) for i in range(DIMENSIONS, x.shape[1] + DIMENSIONS, DIMENSIONS)]]) * (1 + 1e-9)


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.rows: list[list[tuple]] = [[] for _ in ids]  # (-score, id)
        self.least = np.full(len(ids), -np.inf)
        self.floor = np.full(len(ids), -np.inf)

    def offer(self, q: int, scores, ids) -> None:
        own = sorted([*self.rows[q], *((-s, i) for s, i in zip(scores, ids, strict=True) if i != self.ids[q])])[: self.k]
        self.rows[q] = own
        if len(own) == self.k:
            self.least[q] = max(self.floor[q], float(-own[-1][0]))

    def scan(self, ids: np.ndarray, c: np.ndarray) -> None:
        """Meet a batch of candidates."""
        width = max(c.shape[1], self.x.shape[1])
        x, c = _fit(self.x, width), _fit(c, width)
        top = np.abs(x).max(initial=0) * np.abs(c).max(initial=0) * width
        if not np.isfinite(top) or top >= 2.0**53:  # beyond exact doubles: whole numbers of Python
            whole = [[int(v) for v in r] for r in c]
            for q, r in enumerate(x):
                a = [int(v) for v in r]
                self.offer(q, [sum(map(int.__mul__, a, b)) for b in whole], ids.tolist())
            return
        for start in range(0, len(c), CANDIDATES):
            own = c[start : start + CANDIDATES]
            columns, tail_c, names = np.ascontiguousarray(own.T), _tails(own), ids[start : start + CANDIDATES]
            for a in range(0, len(x), QUERIES):
                z = x[a : a + QUERIES]
                tail_z, least = _tails(z), self.least[a : a + QUERIES]
                alive, sums = np.arange(len(own)), np.zeros((len(z), len(own)))
                for b, dim in enumerate(range(0, width, DIMENSIONS)):
                    part = columns[dim : dim + DIMENSIONS]
                    sums += z[:, dim : dim + DIMENSIONS] @ (part if len(alive) == len(own) else part[:, alive])
                    keep = (sums + tail_z[:, b, None] * tail_c[alive, b] + 1e-6 >= least[:, None]).any(0)
                    if not keep.all():
                        alive, sums = alive[keep], sums[:, keep]
                    if not len(alive):
                        break
                hits = sums >= least[:, None]
                for q in np.flatnonzero(hits.any(1)).tolist():
                    at = np.flatnonzero(hits[q])
                    s = sums[q, at]
                    if len(at) > 4 * self.k:  # enough of the best, ties at the edge included
                        other = names[alive[at]] != self.ids[a + q]  # rows of the query's own id are none of them
                        at, s = at[other], s[other]
                        if len(at) > self.k:
                            edge = np.partition(s, len(s) - self.k)[len(s) - self.k]
                            at, s = at[s >= edge], s[s >= edge]
                    self.offer(a + q, s.astype(np.int64).tolist(), names[alive[at]].tolist())


def search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every row that `is_query` selects."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    wanted = vectors.where(is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    n = wanted.count()
    found = _broadcast(rows, wanted, k) if n <= block else _celled(rows, wanted, n, k, block)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _batch(best: Best, q: np.ndarray):
    """Arrow rows (q, query_id, vec_id, score) of what is best, by the queries' own numbers."""
    import pyarrow as pa

    flat = [(int(q[n]), int(best.ids[n]), i, max(-_LONG - 1, min(_LONG, -s))) for n, own in enumerate(best.rows) for s, i in own]
    return pa.RecordBatch.from_arrays([pa.array([f[j] for f in flat], pa.int64()) for j in range(4)], ["q", "query_id", "vec_id", "score"])


_SCHEMA = "q long, query_id long, vec_id long, score long"


def _broadcast(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    got = wanted.toArrow()
    keep, x = quantised(got.column(1).combine_chunks())
    ids = got.column(0).to_numpy()[keep].astype(np.int64)
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    first = Best(ids, x, k)
    if len(ids):
        first.scan(ids, x)
    # in a partition, a row that only ties with this floor may still win by its id, so it passes
    shared = rows.sparkSession.sparkContext.broadcast((ids, x, first.least))

    def run(parts):
        ids, x, least = shared.value
        best = Best(ids, x, k)
        best.floor, best.least = least, least.copy()
        for part in parts:
            keep, c = quantised(part.column(1))
            if len(keep) and len(ids):
                best.scan(part.column(0).to_numpy()[keep], c)
        yield _batch(best, np.arange(len(ids)))

    return rows.mapInArrow(tidied(run), _SCHEMA)


def _celled(rows: DataFrame, wanted: DataFrame, n: int, k: int, block: int) -> DataFrame:
    down = -(-n // max(1, block // 2))
    across = max(1, -(-rows.sparkSession.sparkContext.defaultParallelism // down))
    place = F.monotonically_increasing_id()  # rows that repeat an id are dealt apart
    q = wanted.withColumn("r", place).select(F.pmod(F.xxhash64("r"), F.lit(down)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("j"), F.lit(0).alias("side"), "r", "id", "v")
    c = rows.withColumn("r", place).select(F.explode(F.expr(f"sequence(0L, {down - 1}L)")).alias("i"), F.pmod(F.xxhash64("r"), F.lit(across)).cast("int").alias("j"), F.lit(1).alias("side"), "r", "id", "v")
    cell = (F.col("i") * across + F.col("j")).cast("int")
    dealt = q.unionByName(c).repartitionById(down * across, cell).sortWithinPartitions("side").select("side", "r", "id", "v")

    def run(parts):
        numbers, ids, xs, best = [], [], [], None
        for part in parts:
            side = part.column(0).to_numpy()
            keep, x = quantised(part.column(3))
            side, r, own = side[keep], part.column(1).to_numpy()[keep], part.column(2).to_numpy()[keep].astype(np.int64)
            head = side == 0
            if head.any():
                numbers.append(r[head]), ids.append(own[head]), xs.append(x[head])
            if not head.all() and ids:
                if best is None:
                    width = max(a.shape[1] for a in xs)
                    best = Best(np.concatenate(ids), np.concatenate([_fit(a, width) for a in xs]), k)
                best.scan(own[~head], x[~head])
        if best is not None:
            yield _batch(best, np.concatenate(numbers))

    return dealt.mapInArrow(tidied(run), _SCHEMA)
