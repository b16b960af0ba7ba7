"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles. Each shingle toggles one bit of a sketch, so the
Hamming distance of two sketches is a lower bound of the symmetric difference of the sets. Two sets that
link differ in at most (a + b) * (1 - t) / (1 + t) shingles. A pair belongs to the size band of its larger
set; a document takes part in its own band and in those that a larger partner can be in. A band's sketches
are cut into m segments, FINE times the band's largest difference d and more. Linked sketches differ in d
segments at most, so of any order that all documents share, each one's first d + 1 segments hold one that
both have: the pigeonhole join publishes these only, by the XOR fingerprint of their bits. The order puts
segments of rare shingles first (by counts over all documents, in a table of fixed size that is broadcast),
so that passages that many documents share are hardly ever joined on.

What is joined are distinct sets, named by 128-bit hashes, so a text that a third of all rows repeat is one
member. Keys travel once, packed by bucket. A task publishes a key once however many of its sets have it; its
other sets meet the first one by a key of their own, so a key that very many sets share doesn't land in one
task. In a group, members are compared with one pivot, by parity sketches whose length follows the set's size
and then by the sets themselves. Links become components; groups that still hold several go on with the
member with most links as the pivot. In those left after that, every member outside the largest component
meets every other member, in blocks of MEMBERS rows each: first by sketches, where nothing but the members
with a near partner comes out, then by their sets, where nothing but the links that join components do. So no
link between components is missed, no task holds more than two blocks, and pairs are never emitted all.

Verification compares sets of 64-bit hashes of shingles, whose collisions could make a wrong pair of nearly
equal size; nothing else is approximate. Null or empty text, or text of white space, has the empty set: it
links with nothing. Rows that share a doc_id are one node. Rows without doc_id link with nothing and get a
null component. Ids may be of any type that can be ordered. Nothing is collected to the driver but the counts
of fixed size. Intermediate tables go to the shared folder and are deleted, but for the result's own.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialise, release, ship, tidied
from .graph import components

#: Ratio of a band's limits, and how many segments there are for each that linked sketches may differ in.
RATIO, FINE = 2.0, 3
#: Rows of a block in which the members of a group that star comparisons left open meet.
MEMBERS = 1000
#: Slots of the counts of shingles (a power of two), in blocks; bytes of published keys a task groups.
SLOTS, BLOCK, TASK = 1 << 22, 1 << 16, 24 << 20
#: Keys that a task gathers before it sends them on; bits of the shortest sketch.
BATCH, SHORT = 250_000, 1024
#: A set may repeat without being published again among so many that a task remembers.
REMEMBER = 200_000
#: Share of all rows from which on a set's rows don't take part in a shuffle by set: at most 1 / HOT sets have it.
HOT = 1000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))  # fixed values of splitmix64


def mix(x: np.ndarray) -> np.ndarray:
    x = x + _A
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; A-Z in lower case, words between ASCII white space."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode().lower().split()  # of bytes, both know ASCII only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    span = min(k, n)
    salt = mix(np.arange(1, span + 1, dtype=np.uint64)) | np.uint64(1)
    h = np.full(n - span + 1, span, np.uint64)
    for i in range(span):
        h += w[i : n - span + 1 + i] * salt[i]
    return np.unique(mix(h))


def name_of(h: np.ndarray) -> bytes:
    """128-bit name of a set."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(h.tobytes())


@functools.lru_cache(1)
def _limits() -> np.ndarray:
    """First size of each band."""
    out = [1]
    while out[-1] <= 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return np.array(out)


@functools.lru_cache(65536)
def shape(n: int, num: int, den: int) -> tuple[tuple[int, int, int], ...]:
    """(band, segments, segments to publish) of a set of n shingles in each band that it takes part in.

    Bands where only equal sets link are left out, as these are one set already.
    """
    limits, out = _limits(), []
    top = n * den // num
    for band in range(int(np.searchsorted(limits, n, "right")) - 1, int(np.searchsorted(limits, top, "right"))):
        last = int(limits[band + 1]) - 1
        widest = 2 * last * (den - num) // (den + num)
        own = (n + min(last, top)) * (den - num) // (den + num)
        if own:
            out.append((band, FINE * (widest + 1), own + 1))
    return tuple(out)


def keys(h: np.ndarray, num: int, den: int, ranks: np.ndarray | None = None) -> np.ndarray:
    """Join keys of a set: its first segments of each band in the order of `ranks` (by slot of a shingle), then of the key.

    The lowest bit of a key is free.
    """
    n = len(h)
    if not n:
        return np.empty(0, np.uint64)
    prefix = np.r_[np.uint64(0), np.bitwise_xor.accumulate(mix(h))]
    top = h >> np.uint64(32)
    rank = np.zeros(n, np.uint64) if ranks is None else ranks[(h & np.uint64(len(ranks) - 1)).astype(np.int64)].astype(np.uint64)
    out = []
    for band, m, most in shape(n, num, den):
        # h is sorted, and so are the segments that its high bits name
        own = (top * np.uint64(m)) >> np.uint64(32)
        start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        place = mix((np.uint64(band) << np.uint64(40)) + own[start])
        found = mix((prefix[np.r_[start[1:], n]] ^ prefix[start]) ^ place)
        if len(start) > most:  # a segment is as rare as the rarest of its shingles
            order = (np.minimum.reduceat(rank, start) << np.uint64(56)) | (found >> np.uint64(8))
            found = found[np.argpartition(order, most - 1)[:most]]
        elif len(start) < most:  # then empty segments count as well
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), own[start], assume_unique=True)
            blank = mix(mix((np.uint64(band) << np.uint64(40)) + empty))
            found = np.r_[found, np.sort(blank)[: most - len(start)]]
        out.append(found)
    return np.concatenate(out) & ~np.uint64(1) if out else np.empty(0, np.uint64)


def sketch(h: np.ndarray) -> bytes:
    """Parity bits of a set, four a shingle at least and a power of two in all: each hash toggles one."""
    width = max(SHORT, 1 << (4 * len(h) - 1).bit_length()) if len(h) else SHORT
    bits = np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of bytes) at a shorter width: parities of halves add up."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def apart(x: bytes, y: bytes) -> int:
    """Hamming distance: no more than the difference of the sets."""
    width = min(len(x), len(y))
    a, b = (folded(np.frombuffer(z, np.uint8), width) for z in (x, y))
    return int(np.bitwise_count(a ^ b).sum())


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if not len(a) or not len(b) or den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return den * same >= num * (len(a) + len(b) - same)


def near(sizes_a, bits_a, sizes_b, bits_b, num: int, den: int) -> np.ndarray:
    """Matrix of the pairs whose sizes and sketches let them link."""
    n, m = np.asarray(sizes_a, np.int64), np.asarray(sizes_b, np.int64)
    out = np.zeros((len(n), len(m)), bool)
    wide_a, wide_b = np.array([len(x) for x in bits_a]), np.array([len(x) for x in bits_b])
    for u in np.unique(wide_a):
        for v in np.unique(wide_b):
            width = min(u, v)
            if max(u, v) * num > 2 * width * den:
                continue  # sizes too far from one another
            i, j = np.flatnonzero(wide_a == u), np.flatnonzero(wide_b == v)
            a = folded(np.frombuffer(b"".join(bits_a[x] for x in i), np.uint8).reshape(len(i), u), width).copy().view(np.uint64)
            b = folded(np.frombuffer(b"".join(bits_b[x] for x in j), np.uint8).reshape(len(j), v), width).copy().view(np.uint64)
            step = max(1, (16 << 20) // (width * len(j)))
            for s in range(0, len(i), step):
                own = i[s : s + step]
                d = np.bitwise_count(a[s : s + step, None, :] ^ b[None]).sum(2, dtype=np.int64)
                total = n[own, None] + m[None, j]
                low, high = np.minimum(n[own, None], m[None, j]), np.maximum(n[own, None], m[None, j])
                out[np.ix_(own, j)] = (d * (num + den) <= total * (den - num)) & (den * low >= num * high)
    return out


def _names(raw: np.ndarray):
    """Arrow column of 16-byte names from rows of bytes."""
    import pyarrow as pa

    raw = np.ascontiguousarray(raw, np.uint8).reshape(-1, 16)
    ends = np.arange(len(raw) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(raw)])


def _measured(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, sig, published) of each row, and rows (slots, counts) with a task's counts of shingles by slot."""
    import pyarrow as pa

    slots, block = SLOTS, BLOCK

    def run(parts):
        id_type, counts = None, np.zeros(slots, np.uint32)
        names = ["doc_id", "n", "sig", "published", "slots", "counts"]
        for part in parts:
            id_type = part.column(0).type
            for start in range(0, part.num_rows, 1000):
                own = part.slice(start, 1000)
                sets = [shingles(t, k) for t in own.column(1).to_pylist()]
                n = [len(h) for h in sets]
                if any(n):
                    flat = np.concatenate(sets) & np.uint64(slots - 1)
                    np.add.at(counts, flat.astype(np.int64), 1)
                sent = [sum(x[2] for x in shape(len(h), num, den)) for h in sets]
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(n, pa.int64()), pa.array([name_of(h) for h in sets], pa.binary()), pa.array(sent, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        if id_type is None:
            return
        used = [b for b in range(slots // block) if counts[b * block : (b + 1) * block].any()]
        packed = [zlib.compress(np.minimum(counts[b * block : (b + 1) * block], 65535).astype(np.uint16).tobytes(), 1) for b in used]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(used), id_type), pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.binary()), pa.nulls(len(used), pa.int64()), pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {kind}, n long, sig binary, published long, slots int, counts binary")


def _ranks(measured: DataFrame) -> np.ndarray:
    """Of each slot, a rank of 0 to 255 by its count over all documents: SLOTS bytes, whatever the input."""
    import pyarrow as pa

    block = BLOCK

    def run(parts):
        total: dict[int, np.ndarray] = {}
        for part in parts:
            for b, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(raw), np.uint16).astype(np.int64)
                total[b] = total[b] + own if b in total else own
        packed = [np.minimum(t, (1 << 32) - 1).astype(np.uint32).tobytes() for t in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(packed, pa.binary())], ["slots", "counts"])

    rows = measured.where("slots IS NOT NULL").select("slots", "counts").repartition(16, "slots")
    found = rows.mapInArrow(tidied(run), "slots int, counts binary").collect()  # 4 * SLOTS bytes
    # levels of about 1 %, of which 255 are kept that part the slots evenly, and evenly by size beyond 98 % of them
    level = lambda raw: (64 * np.log2(np.frombuffer(raw, np.uint32).astype(np.float32) + 1)).astype(np.int32)
    spread = np.zeros(64 * 33, np.int64)
    for r in found:
        spread += np.bincount(level(r["counts"]), minlength=len(spread))
    upto = np.cumsum(spread) / max(spread.sum(), 1)
    rank = np.minimum(upto / 0.98, 1) * 170 + np.arange(len(spread)) * 85 / len(spread) * (upto > 0.98)
    table = np.maximum.accumulate(rank).astype(np.uint8)
    out = np.zeros(SLOTS, np.uint8)
    for r in found:
        out[r["slots"] * block : (r["slots"] + 1) * block] = table[level(r["counts"])]
    return out


def _published(docs: DataFrame, k: int, num: int, den: int, ranks: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, keys, names, pivots): packed keys of the sets; the lowest bit tells that the task has more sets of the key.

    These others come with their key, themselves and the task's first set of the key, in buckets of the task's own choice.
    """
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # SLOTS bytes

    def packed(where: np.ndarray, *columns: np.ndarray) -> list:
        order = np.argsort(where, kind="stable")
        ends = np.searchsorted(where[order], np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(ends)).astype(np.int32)
        out = [pa.array(used)]
        for c in columns:
            raw = np.ascontiguousarray(c[order])
            each = raw.dtype.itemsize * (raw.shape[1] if raw.ndim > 1 else 1)
            cuts = np.r_[ends[used], ends[-1]].astype(np.int32) * each
            out.append(pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(cuts), pa.py_buffer(raw)]))
        return out

    def sent(found: list, names: list, seed: int):
        k_, own = np.concatenate(found), np.repeat(np.arange(len(names)), [len(f) for f in found])
        name = np.frombuffer(b"".join(names), np.uint8).reshape(-1, 16)
        order = np.argsort(k_, kind="stable")
        k_, own = k_[order], own[order]
        start = np.flatnonzero(np.r_[True, k_[1:] != k_[:-1]])
        size = np.diff(np.r_[start, len(k_)])
        lead = k_[start]
        cols = packed(mix(lead) % np.uint64(buckets), lead | (size > 1).astype(np.uint64), name[own[start]])
        yield pa.RecordBatch.from_arrays([*cols, pa.array([b""] * len(cols[0]), pa.binary())], ["bucket", "keys", "names", "pivots"])
        many = np.repeat(size > 1, size)
        if many.any():
            first = np.repeat(own[start], size)[many]
            yield pa.RecordBatch.from_arrays(packed(mix(k_[many] ^ np.uint64(seed)) % np.uint64(buckets), k_[many], name[own[many]], name[first]), ["bucket", "keys", "names", "pivots"])

    def run(parts):
        rank, met, found, names, waiting = shared.value, set(), [], [], 0
        for part in parts:
            for start in range(0, part.num_rows, 500):
                own = part.slice(start, 500)
                for i, t in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True):
                    h = shingles(t, k)
                    name = name_of(h)
                    if i is None or not len(h) or name in met:
                        continue
                    if len(met) >= REMEMBER:
                        met.clear()
                    met.add(name)
                    found.append(keys(h, num, den, rank))
                    names.append(name)
                    waiting += len(found[-1])
                    if waiting >= BATCH:
                        yield from sent(found, names, int.from_bytes(names[0][:8]))
                        found, names, waiting = [], [], 0
        if waiting:
            yield from sent(found, names, int.from_bytes(names[0][:8]))

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "bucket int, keys binary, names binary, pivots binary")


def _met(published: DataFrame, buckets: int) -> DataFrame:
    """Rows (a, b) of sets that share a key, each with its group's pivot, and rows (key, a) of groups of three and more."""
    import pyarrow as pa

    def run(parts):
        lead, others = ([], []), ([], [], [])
        for part in parts:
            for row in zip(*(part.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                for col, raw in zip(others if row[2] else lead, row, strict=False):
                    col.append(raw)
        pairs, group_keys, group_names = [], [], []
        if lead[0]:
            k = np.frombuffer(b"".join(lead[0]), np.uint64)
            name = np.frombuffer(b"".join(lead[1]), ">u8").reshape(-1, 2)
            more, k = (k & np.uint64(1)) == 1, k >> np.uint64(1)
            order = np.lexsort((name[:, 1], name[:, 0], k))
            k, name, more = k[order], name[order], more[order]
            again = np.r_[False, (k[1:] == k[:-1]) & (name[1:] == name[:-1]).all(1)]
            start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            open_ = np.logical_or.reduceat(more, start)
            group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(k)]))
            keep = ~again
            k, name, group = k[keep], name[keep], group[keep]
            size = np.bincount(group, minlength=len(start))
            first = np.searchsorted(group, np.arange(len(start)))
            rest = np.r_[False, group[1:] == group[:-1]]
            pairs.append(np.hstack((name[first[group[rest]]], name[rest])))
            # groups of the same members need one key
            mark = np.zeros(len(start), np.uint64)
            np.add.at(mark, group, mix(name[:, 0].astype(np.uint64) ^ mix(name[:, 1].astype(np.uint64))))
            one = np.zeros(len(start), bool)
            one[np.unique(mark, return_index=True)[1]] = True
            wanted = ((size > 2) & one & ~open_) | (open_ & (size > 1))
            inside = wanted[group]
            group_keys.append(k[inside])
            group_names.append(name[inside])
        if others[0]:
            k = np.frombuffer(b"".join(others[0]), np.uint64) >> np.uint64(1)
            name, pivot = (np.frombuffer(b"".join(c), ">u8").reshape(-1, 2) for c in others[1:])
            apart_ = (name != pivot).any(1)
            pairs.append(np.hstack((pivot[apart_], name[apart_])))
            group_keys.append(k)
            group_names.append(name)
        names = ["key", "a", "b"]
        if pairs:
            both = np.concatenate(pairs).astype(">u8")  # joined arrays come in the machine's order
            both = np.unique(np.ascontiguousarray(both).view(np.uint8).reshape(-1, 32), axis=0)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(both), pa.int64()), _names(both[:, :16]), _names(both[:, 16:])], names)
        if group_keys:
            k, name = np.concatenate(group_keys), np.concatenate(group_names).astype(">u8")
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), _names(np.ascontiguousarray(name).view(np.uint8)), pa.nulls(len(k), pa.binary())], names)

    return published.repartitionById(buckets, F.col("bucket")).mapInArrow(tidied(run), "key long, a binary, b binary")


def _with_sketches(rows: DataFrame, k: int) -> DataFrame:
    """(node, n, bits, text) of rows (sig, text); a row whose text isn't that of sig goes."""
    import pyarrow as pa

    def run(parts):
        for part in parts:
            for start in range(0, part.num_rows, 500):
                own = part.slice(start, 500)
                found = []
                for sig, t in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True):
                    h = shingles(t, k)
                    if name_of(h) == sig:
                        found.append((sig, len(h), sketch(h), t))
                cols = list(zip(*found, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.binary(), pa.int64(), pa.binary(), pa.string()), strict=True)], ["node", "n", "bits", "text"])

    return rows.mapInArrow(tidied(run), "node binary, n long, bits binary, text string")


def _near(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose parity sketches let them link: texts of the others needn't meet."""
    import pyarrow as pa

    def run(parts):
        for part in parts:
            a, b, n, x, m, y = (c.to_pylist() for c in part.columns)
            keep = [i for i in range(len(a)) if den * min(n[i], m[i]) >= num * max(n[i], m[i]) and apart(x[i], y[i]) * (num + den) <= (n[i] + m[i]) * (den - num)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), part.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    one = texts.select(F.col("node").alias("a"), "n", F.col("bits").alias("x"))
    other = texts.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
    return pairs.join(other, "b").join(one, "a").select("a", "b", "n", "x", "m", "y").mapInArrow(tidied(run), "a binary, b binary")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) that link."""
    import pyarrow as pa

    def run(parts):
        for part in parts:
            sets: dict = {}
            keep = []
            for i, (s, t) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                if s not in sets:
                    if len(sets) > 200:
                        sets.clear()
                    sets[s] = shingles(s, k)
                if linked(sets[s], shingles(t, k), num, den):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), part.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("t")), "b")
    both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("s")), "a")
    return both.select("a", "b", "s", "t").mapInArrow(tidied(run), "a binary, b binary")


def _cells(parts):
    """Rows of one cell (its first three columns) at a time, of sorted batches: lists of the other columns."""
    now, held = None, []
    for part in parts:
        for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if row[:3] != now:
                if held:
                    yield now, [list(c) for c in zip(*held, strict=True)]
                now, held = row[:3], []
            held.append(row[3:])
    if held:
        yield now, [list(c) for c in zip(*held, strict=True)]


def _settled(left: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that join components, of open groups (key, node, component): all that lie outside a group's largest component meet all others.

    A group's members are dealt over blocks of MEMBERS rows; a cell (key, i, j) holds block i of the outer members
    and block j of all. Sketches first leave those with a near partner, whose sets then decide.
    """
    import pyarrow as pa

    sizes = left.groupBy("key", "component").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("all"))
    rows = left.join(largest, "key").withColumn("outer", F.col("component") != F.col("top.component"))
    h, blocks = F.xxhash64("node"), lambda c: F.greatest(F.lit(1), F.ceil(c / MEMBERS)).cast("int")
    rows = rows.select("key", "node", "component", "outer", h.alias("h"), blocks(F.col("all") - F.col("top.c")).alias("p"), blocks(F.col("all")).alias("q"))
    inner = rows.select("key", F.explode(F.expr("sequence(0, p - 1)")).alias("i"), F.expr("CAST(pmod(h, q) AS INT)").alias("j"), "node", "component", F.lit(False).alias("outer"))
    outer = rows.where("outer").select("key", F.expr("CAST(pmod(h, p) AS INT)").alias("i"), F.explode(F.expr("sequence(0, q - 1)")).alias("j"), "node", "component", "outer")
    cells = inner.unionByName(outer)

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def partners(parts):
        for cell, (node, component, out, n, bits) in _cells(parts):
            a, b = ([i for i, o in enumerate(out) if o == side] for side in (True, False))
            if not a or not b:
                continue
            meet = near([n[i] for i in a], [bits[i] for i in a], [n[i] for i in b], [bits[i] for i in b], num, den)
            label = np.unique(np.array(component, object), return_inverse=True)[1]
            meet &= label[a][:, None] != label[b][None]
            keep = [a[i] for i in np.flatnonzero(meet.any(1))] + [b[i] for i in np.flatnonzero(meet.any(0))]
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array([cell[0]] * len(keep), pa.int64()), pa.array([cell[1]] * len(keep), pa.int32()), pa.array([cell[2]] * len(keep), pa.int32()), pa.array([node[i] for i in keep], pa.binary()), pa.array([component[i] for i in keep], pa.binary()), pa.array([out[i] for i in keep], pa.bool_())], ["key", "i", "j", "node", "component", "outer"])

    def links(parts):
        for _, (node, component, out, text) in _cells(parts):
            sets = [shingles(t, k) for t in text]
            a, b = ([i for i, o in enumerate(out) if o == side] for side in (True, False))
            up = {c: c for c in component}

            def root(c, up=up):
                while up[c] != c:
                    up[c] = up[up[c]]
                    c = up[c]
                return c

            meet = near([len(sets[i]) for i in a], [sketch(sets[i]) for i in a], [len(sets[i]) for i in b], [sketch(sets[i]) for i in b], num, den)
            found = []
            for x, y in zip(*(z.tolist() for z in np.nonzero(meet)), strict=True):
                r, s = root(component[a[x]]), root(component[b[y]])
                if r != s and linked(sets[a[x]], sets[b[y]], num, den):
                    up[r] = s
                    found.append((node[a[x]], node[b[y]]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], ["a", "b"])

    met = dealt(cells.join(texts.select("node", "n", "bits"), "node").select("key", "i", "j", "node", "component", "outer", "n", "bits"))
    some = materialise(met.mapInArrow(tidied(partners), "key long, i int, j int, node binary, component binary, outer boolean"), "partners")
    exact = dealt(some.join(texts.select("node", "text"), "node").select("key", "i", "j", "node", "component", "outer", "text"))
    out = materialise(exact.mapInArrow(tidied(links), "a binary, b binary"), "links")
    discard(some)
    return out


def _open(groups: DataFrame, merged: DataFrame) -> DataFrame:
    """(key, node, component) of the groups (key, node) that hold several components; of groups with the same members, one."""
    label = groups.join(merged, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    held = label.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark")).where("lo < hi")
    one = held.groupBy("size", "mark").agg(F.min("key").alias("key")).select("key")
    return materialise(label.join(one, "key"), "left")


def classes(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text).

    Sets link when den * intersection >= num * union.
    """
    spark = docs.sparkSession
    ship(spark)
    measured = materialise(_measured(docs, words, num, den), "measured")
    seen = measured.where("slots IS NULL").select("doc_id", "n", "sig", "published")
    rows, sent = seen.agg(F.count("*"), F.coalesce(F.sum("published"), F.lit(0))).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sent * 25 // TASK))
    met = materialise(_met(_published(docs, words, num, den, _ranks(measured), buckets), buckets), "met")
    release(spark)
    own = seen.where("n > 0 AND doc_id IS NOT NULL")
    sets = own.groupBy("sig").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    # sets that share a doc_id are linked by it
    several = own.groupBy("doc_id").agg(F.min("sig").alias("b"), F.max("sig").alias("c")).where("b < c")
    known = own.select("doc_id", F.col("sig").alias("a")).distinct().join(several, "doc_id").where("a <> b").select("a", "b")
    pairs = materialise(met.where("key IS NULL").select("a", "b").distinct(), "pairs")
    groups = met.where("key IS NOT NULL").select("key", F.col("a").alias("node"))

    need = pairs.select(F.explode(F.array("a", "b")).alias("sig")).unionByName(groups.select(F.col("node").alias("sig"))).distinct()
    chosen = sets.join(need, "sig").select("sig", F.col("first").alias("doc_id"))
    found = docs.select("doc_id", "text").join(chosen, "doc_id").select("sig", "text")
    if not own.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        found = found.dropDuplicates(["sig", "text"])  # rows that repeat an id
    texts = materialise(_with_sketches(found, words), "texts")
    release(spark)

    links, merged, left, turn = None, None, groups, 0
    while True:
        close = materialise(_near(pairs, texts, num, den), "near")
        new = materialise(_verified(close, texts, words, num, den), "links")
        discard(close)
        discard(pairs)
        links = new if links is None else links.unionByName(new)
        before, edges = merged, known if merged is None else merged.select(F.col("node").alias("a"), F.col("component").alias("b"))
        merged = components(edges.unionByName(new))
        if before is not None:
            discard(before)
        release(spark)
        last, left = left, _open(left.select("key", "node"), merged)
        if turn:
            discard(last)
        if turn or left.isEmpty():
            break
        degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        ranked = left.join(degree, "node", "left").select("key", F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), "node", "component").alias("rank"))
        best = ranked.groupBy("key").agg(F.max("rank").alias("rank")).select("key", F.col("rank.node").alias("a"), F.col("rank.component").alias("of"))
        pairs = materialise(left.join(best, "key").where("component <> of").select("a", F.col("node").alias("b")).distinct(), "pairs")
        turn += 1
    if not left.isEmpty():
        before, new = merged, _settled(left, texts, words, num, den)
        merged = components(before.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new))
        discard(before)
        discard(new)
    for made in (met, texts, left, links):
        discard(made)

    label = sets.join(merged.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "first", "rows", F.coalesce("component", "sig").alias("component"))
    least = label.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("sets"), F.max("rows").alias("most")).where("sets > 1 OR most > 1")
    table = materialise(label.join(least, "component").select("sig", "rows", "component_id"), "table")
    # a set that many rows have would be one task's work in a join: there are at most HOT of these
    many = table.where(F.col("rows") * HOT > rows).select("sig", "component_id")
    few = table.where(F.col("rows") * HOT <= rows).select("sig", "component_id")
    spread = own.join(F.broadcast(many.select("sig")), "sig", "left_anti").join(few, "sig", "left")
    alone = seen.where("n = 0 OR doc_id IS NULL").withColumn("component_id", F.col("doc_id"))
    whole = own.join(F.broadcast(many), "sig").unionByName(spread).unionByName(alone)
    out = materialise(whole.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), "classes")
    for made in (measured, table, merged):
        discard(made)
    release(spark)
    return out


def keep_first(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each class stays: that of the least doc_id. Rows without doc_id stay.

    Of several rows with that id, the one whose text sorts first stays (null last), then the one whose other
    columns do, as JSON. All columns stay, whatever their names.
    """
    found = classes(docs, words, num, den).where("doc_id IS NOT NULL")
    again = found.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    gone = found.where("doc_id <> component_id").select("doc_id")
    kept = docs.join(gone.unionByName(again).distinct(), "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return kept
    several = docs.join(again.join(gone, "doc_id", "left_anti"), "doc_id", "left_semi")
    order = F.struct(F.col("text").isNull(), F.col("text"), F.to_json(F.struct(*docs.columns)))
    row = several.groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]), order).alias("_row"))
    return kept.unionByName(row.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)]))
