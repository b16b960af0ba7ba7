"""Sequence packing by Karmarkar-Karp multiway differencing.

Each partition tokenises its documents as they stream by (no shuffle) and gathers groups of tokens that
fill `windows` sequences. A document longer than a piece is cut; the last document of a group is cut
where the group is full, and its rest opens the next group. Within a group, differencing merges partial
partitions: the two partitions with the widest spread are added so that the fullest windows of one meet
the emptiest of the other. When the fullest window then exceeds the capacity, the number of windows rises
by one and the group is partitioned again. The end of a partition, less than a group, is partitioned the
same way, and its last incomplete sequence is cut into sequences of powers of two, which need no padding.

Null text is an empty document, one end token. Repeated rows and ids are packed as rows of their own. A
sequence id is (partition << 32) + counter: unique, and the same when a lost partition is computed anew.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sequences in a group, tokens in a piece at most, and tokens a window that a group leaves free for imbalance.
WINDOWS, PIECE, SPARE = 256, 256, 2.0


def differencing(lengths: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp partition of the items into k windows; lists of item numbers.

    A partial partition holds its non-empty windows, fullest first; windows that it doesn't list are empty.
    """
    if not lengths:
        return [[] for _ in range(k)]
    heap: list[tuple] = [(-n if k > 1 else 0, i, [n], [[i]]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    fresh = len(lengths)
    while len(heap) > 1:
        _, _, a, items_a = heapq.heappop(heap)
        _, _, b, items_b = heapq.heappop(heap)
        shared = len(a) + len(b) - k
        if shared > 0:  # the emptiest of b meet the emptiest listed of a in opposite order
            lo, lo_b = len(a) - shared, len(b) - shared
            sums = a[:lo] + [x + y for x, y in zip(a[lo:], reversed(b[lo_b:]), strict=True)] + b[:lo_b]
            items = items_a[:lo] + [x + y for x, y in zip(items_a[lo:], reversed(items_b[lo_b:]), strict=True)] + items_b[:lo_b]
        else:
            sums, items = a + b, items_a + items_b
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums, items = [sums[i] for i in order], [items[i] for i in order]
        least = sums[-1] if len(sums) == k else 0
        heapq.heappush(heap, (least - sums[0], fresh, sums, items))
        fresh += 1
    items = heap[0][3]
    return items + [[] for _ in range(k - len(items))]


def partition(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most `capacity` each; their number rises until differencing fits."""
    k = max(1, -(-sum(lengths) // capacity))
    while True:
        windows = differencing(lengths, k)
        if max((sum(lengths[i] for i in w) for w in windows), default=0) <= capacity:
            return [w for w in windows if w]
        k += 1


class Packer:
    """Turns a stream of (document, ids) into rows of pieces."""

    def __init__(self, first_sequence: int, capacity: int = 2048, windows: int = WINDOWS, piece: int = PIECE):
        self.sequence, self.capacity, self.piece = first_sequence, capacity, min(piece, capacity)
        self.room = int(windows * (capacity - SPARE)) if windows > 1 else capacity
        self.cuts: list[tuple] = []  # (doc, start, ids as bytes, tokens of the document)
        self.size = 0

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        total, start = len(ids) // 4, 0
        while start < total:
            n = min(self.piece, total - start, self.room - self.size)
            self.cuts.append((doc, start, ids[4 * start : 4 * (start + n)], total))
            start += n
            self.size += n
            if self.size == self.room:
                yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        cuts, self.cuts, self.size = self.cuts, [], 0
        for w in partition([len(c[2]) // 4 for c in cuts], self.capacity):
            yield from self.emit([cuts[i] for i in w])

    def emit(self, cuts: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in cuts:
            yield doc, start, len(ids) // 4, zlib.crc32(ids), total, self.sequence, at
            at += len(ids) // 4
        self.sequence += 1

    def finish(self) -> Iterator[tuple]:
        """The rest: whole sequences by differencing, what is left over in powers of two."""
        over = self.size % self.capacity
        tail: list[tuple] = []
        while over:
            doc, start, ids, total = self.cuts.pop()
            n = min(over, len(ids) // 4)
            keep = len(ids) // 4 - n
            if keep:
                self.cuts.append((doc, start, ids[: 4 * keep], total))
            tail.insert(0, (doc, start + keep, ids[4 * keep :], total))
            over -= n
        self.size = 0
        yield from self.flush()
        left = sum(len(c[2]) // 4 for c in tail)
        while left:
            size = 1 << (left.bit_length() - 1)
            own, got = [], 0
            while got < size:
                doc, start, ids, total = tail.pop(0)
                n = min(size - got, len(ids) // 4)
                own.append((doc, start, ids[: 4 * n], total))
                if n < len(ids) // 4:
                    tail.insert(0, (doc, start + n, ids[4 * n :], total))
                got += n
            yield from self.emit(own)
            left -= size


def pack(docs: DataFrame, vocab_path: str, end_id: int = 1, capacity: int = 2048, windows: int = WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: document, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    from pathlib import Path

    import pyarrow as pa

    from . import bpe
    from ._common import ship, tidied

    spark = docs.sparkSession
    ship(spark)
    vocab = spark.sparkContext.broadcast(Path(vocab_path).read_bytes())
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(parts):
        enc, packer, end = bpe.loaded(vocab.value), None, np.array([end_id], "<u4").tobytes()

        def rows(found, kind):
            cols = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

        kind = None
        for part in parts:
            if not part.num_rows:
                continue
            kind = part.schema.field(0).type
            packer = packer or Packer(part.column(2)[0].as_py() << 32, capacity, windows)
            ids = part.column(0).to_pylist()
            for start, texts in bpe.batches(part.column(1).to_pylist()):
                found = [r for i, blob in enumerate(enc.encode_batch(texts), start) for r in packer.add(ids[i], blob + end)]
                if found:
                    yield rows(found, kind)
        if packer and (found := list(packer.finish())):
            yield rows(found, kind)

    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.spark_partition_id().cast("long").alias("part"))
    return out.mapInArrow(tidied(run), f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", id_col)
