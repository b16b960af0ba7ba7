import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomspark.llm import bpe, media, packing

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = [" ", "  ", "\n", "\t", "'s", "'ll", "'", "a", "B", "é", "é", "ß", "İ", "Σ", "1", "²", "中", "😀", "!", "...", "\x1c", "\x85", " ", "<|endoftext|>", "<|", "aaaa", "lolol", "\x00", "_", "ﬁ", "word", "tion,"]


def texts(n=400):
    rng = random.Random(4)
    return ["", " ", "aaaaaaa " * 3000, *("".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n))]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_are_those_of_the_library(path):
    mine = bpe.loaded(open(path, "rb").read())
    theirs = Tokenizer.from_file(path)
    for text, blob in zip(texts(), mine.encode_batch(texts()), strict=True):
        assert np.frombuffer(blob, "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, text


def test_decoding_is_that_of_the_library():
    mine, theirs = bpe.loaded(open(BYTES, "rb").read()), Tokenizer.from_file(BYTES)
    rng = random.Random(1)
    for text in texts(100):
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert mine.decode(ids) == theirs.decode(ids, skip_special_tokens=False) == text
    for _ in range(50):  # ids that cut characters in two
        ids = [rng.randrange(50257) for _ in range(12)]
        assert mine.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_a_merge_index_equals_merging_word_by_word():
    letters = bpe.byte_alphabet()
    vocab = {letters[b]: b for b in range(256)}
    merges = [("a", "a"), ("aa", "a"), ("b", "a"), ("aa", "aa"), ("ba", "aa")]
    for a, b in merges:
        vocab[a + b] = len(vocab)
    table = bpe.MergeTable(vocab, merges)

    def naive(word):
        s = [letters[c] for c in word]
        while True:
            found = [(merges.index(p), i) for i, p in enumerate(zip(s, s[1:], strict=False)) if p in merges]
            if not found:
                return [vocab[x] for x in s]
            i = min(found)[1]
            s[i : i + 2] = [s[i] + s[i + 1]]

    rng = random.Random(2)
    words = [bytes(rng.choice(b"aab") for _ in range(rng.randint(1, 15))) for _ in range(300)]
    ids, counts = table.encode(words)
    ends = np.cumsum(counts)
    for w, a, b in zip(words, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == naive(w), w
    assert table.encode([])[0].size == 0


def test_digests_of_a_table(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello  world's é", "x"), (3, "Hello  world's é", "x"), (None, "ab", "y"), (5, "z" * 200_000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string")
    got = bpe.digests(df, BYTES).collect()
    t = Tokenizer.from_file(BYTES)
    want = []
    for i, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.digests(df.limit(0), BYTES).collect() == []


def test_round_trip_of_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "ünï 中")], "doc_id long, text string")
    enc = bpe.encode(df, BYTES)
    assert {r["doc_id"]: r["text"] for r in bpe.decode(enc, BYTES).collect()} == {1: "a b", 2: "", 3: "ünï 中"}


# --- packing ---


def rebuilt(rows):
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    return docs, seqs


def test_pieces_cover_documents_and_sequences(spark):
    rng = random.Random(3)
    rows = [(i, None if i == 7 else " ".join(rng.choice(["token", "piece", "wörd"]) + str(rng.randrange(99)) for _ in range(rng.choice([0, 3, 40, 700, 6000])))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = packing.pack(df, WORDS).collect()
    t, docs, seqs = Tokenizer.from_file(WORDS), *rebuilt(out)
    total = padding = 0
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for start, n, crc, whole in sorted(docs[i]):
            assert (start, whole) == (at, len(ids))
            assert crc == zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())
            at += n
        assert at == len(ids)
        total += at
    for own in seqs.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n > 0
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.03 * total


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (None, "c", 6)], "doc_id long, text string, offset int").coalesce(1)
    out = packing.pack(df, WORDS).collect()
    assert sum(r["length"] for r in out) == 3 + 3 + 2
    assert packing.pack(df.limit(0), WORDS).collect() == []


def test_differencing_balances_and_the_number_of_windows_rises():
    rng = random.Random(5)
    sizes = [rng.randint(1, 256) for _ in range(600)]
    windows = packing.differencing(sizes, 32)
    assert sorted(i for w in windows for i in w) == list(range(600))
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert max(sums) - min(sums) <= 8
    two = [8, 7, 6, 5, 4]  # by hand: 8 - 7 and 6 - 5, then 4 - 1, then 3 - 1
    assert sorted(sum(two[i] for i in w) for w in packing.differencing(two, 2)) == [14, 16]
    assert len(packing.partition([3, 3, 3], 4)) == 3  # two windows of 4.5 would do, if sizes could be cut
    assert packing.partition([], 4) == []


# --- media ---


@pytest.mark.parametrize("raw", [b"", b"a", b"b" * 576, b"c" * 577, bytes(range(256)) * 900])
def test_media_round_trip(raw):
    payload = media.pad(raw)
    data = media.mux(payload)
    (track,) = media.demux(data)
    assert track.payload(data) == payload and payload.startswith(raw) and set(payload[len(raw) :]) <= {255}
    assert track.codec == "raw " and track.duration == len(payload) // 576 == len(track.sizes)
    for k, (a, b) in zip(track.keys, track.key_ranges(), strict=True):
        assert data[a:b] == payload[k * 576 : (k + 1) * 576]


def test_other_tables_and_boxes():
    full, box = media.full, media.box
    import struct

    body = bytes(range(200))
    ftyp = box(b"ftyp", b"isom")
    mdat = struct.pack(">I4sQ", 1, b"mdat", len(body) + 16) + body  # a 64-bit size
    first = len(ftyp) + 16
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), box(b"mp4a", bytes(28))),
        full(b"stts", struct.pack(">IIIII", 2, 2, 10, 3, 5)),
        full(b"ctts", struct.pack(">IIII", 1, 2, 7, 0)[:12]),
        full(b"stsc", struct.pack(">I", 2), struct.pack(">III", 1, 2, 1), struct.pack(">III", 2, 3, 1)),
        full(b"stz2", bytes(3), bytes([8]), struct.pack(">I", 5), bytes([10, 20, 5, 6, 7])),
        full(b"co64", struct.pack(">IQQ", 2, first, first + 100)),
    )
    mdhd = full(b"mdhd", struct.pack(">QQIQHH", 0, 0, 1000, 35, 0, 0), version=1)
    data = ftyp + mdat + box(b"moov", box(b"trak", box(b"mdia", mdhd, box(b"minf", stbl)))) + struct.pack(">I4s", 0, b"free")
    (t,) = media.demux(data)
    assert (t.codec, t.timescale, t.duration) == ("mp4a", 1000, 35)
    assert t.sizes.tolist() == [10, 20, 5, 6, 7]
    assert (t.offsets - first).tolist() == [0, 10, 100, 105, 111]
    assert t.times.tolist() == [7, 17, 20, 25, 30]
    assert t.keys.tolist() == [0, 1, 2, 3, 4]  # no stss: all samples are keyframes
    assert t.payload(data) == body[0:30] + body[100:118]
    assert media.demux(b"") == media.demux(b"\0\0\0\4abcd") == []


def test_media_of_a_table(spark):
    rows = [(1, None), (2, "é" * 500), (2, "é" * 500), (None, "x" * 100_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, codec string")
    got = {(r["doc_id"], r["n_bytes"]): r for r in media.containers(df, keep_media=True).collect()}
    assert len(got) == 3
    for i, text in rows:
        raw = (text or "").encode()
        r, payload = got[i, len(raw)], media.pad(raw)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["payload_bytes"] == len(payload)
        assert r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])
    assert media.containers(df.limit(0)).collect() == []


def fragmented(payload, size=100, each=7):
    """A file of samples of equal size in fragments of `each`, keyframes first in each, and their ranges by hand."""
    box, full = media.box, media.full
    entry = box(b"avc1", bytes(78))
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", bytes(4)), full(b"stsc", bytes(4)), full(b"stsz", bytes(8)), full(b"stco", bytes(4)))
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0)), full(b"hdlr", struct.pack(">I4s", 0, b"vide"), bytes(13)), box(b"minf", stbl))
    trak = box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, 9, 0, 0), bytes(60)), mdia)
    out = box(b"ftyp", b"isom", bytes(4)) + box(b"moov", trak, box(b"mvex", full(b"trex", struct.pack(">IIIII", 9, 1, 40, size, 0x10000))))
    samples = [payload[i : i + size] for i in range(0, len(payload), size)]
    keys = []
    for i in range(0, len(samples), each):
        own = samples[i : i + each]
        sizes = b"".join(struct.pack(">I", len(s)) for s in own)
        for place in (0, 1):  # the offset of the data is known once the header's length is
            head = box(b"moof", full(b"mfhd", struct.pack(">I", i)), box(b"traf", full(b"tfhd", struct.pack(">I", 9), flags=0x20000), full(b"tfdt", struct.pack(">I", 40 * i)), full(b"trun", struct.pack(">IiI", len(own), place, 0), sizes, flags=0x205)))
            place = len(head) + 8
            head = box(b"moof", full(b"mfhd", struct.pack(">I", i)), box(b"traf", full(b"tfhd", struct.pack(">I", 9), flags=0x20000), full(b"tfdt", struct.pack(">I", 40 * i)), full(b"trun", struct.pack(">IiI", len(own), place, 0), sizes, flags=0x205)))
        keys.append((len(out) + len(head) + 8, len(out) + len(head) + 8 + len(own[0])))
        out += head + box(b"mdat", *own)
    return out, keys


def test_fragments_are_resolved():
    payload = bytes(i * 7 % 256 for i in range(2350))
    data, keys = fragmented(payload)
    (t,) = media.demux(data)
    assert t.payload(data) == payload and t.key_ranges() == keys and t.codec == "avc1" and t.duration == 24 * 40


def test_files_of_a_column(spark):
    import random

    payload = media.pad(b"abc" * 9000)
    whole, (frag, keys) = media.mux(payload), fragmented(b"x" * 900)
    start = whole.index(b"mdat") + 4
    rows = [(1, whole), (2, frag), (3, None), (4, b""), (5, b"no media here"), (1, whole)]
    rng = random.Random(5)
    at = whole.index(b"moov")
    for i in range(150):  # damaged: bytes of the tables changed, or the file cut
        data = bytearray(whole)
        for _ in range(rng.randint(1, 6)):
            data[rng.randrange(at, len(data))] = rng.choice([0, 1, 255, rng.randrange(256)])
        rows.append((100 + i, bytes(data[: rng.randrange(at, len(data) + 1)])))
    df = spark.createDataFrame([(*r, "k") for r in rows], "id long, media binary, track string")
    got = media.tracks(df, "id").collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r)
    assert set(by) == {r[0] for r in rows}
    first = by[1][0]
    assert len(by[1]) == 2 and first["codec"] == "raw " and first["error"] is None and first["duration_s"] == len(payload) / 576 / 25
    assert [tuple(k) for k in first["key_ranges"]] == [(start + i * 576, start + (i + 1) * 576) for i in range(0, len(payload) // 576, 25)]
    assert [tuple(k) for k in by[2][0]["key_ranges"]] == keys
    assert by[3][0]["error"] == "no file" and by[4][0]["error"] == by[5][0]["error"] == "no tracks"
    for r in got:
        assert (r["codec"] is None) == (r["error"] is not None)
        if r["error"] is None:
            size = len(dict(rows)[r["id"]])
            assert all(0 <= a <= b <= size for a, b in r["key_ranges"])
    assert media.tracks(df.limit(0), "id").collect() == []
