"""Byte-pair encoding and decoding through a pair occurrence index.

All distinct words of a batch lie side by side in one symbol array. An index maps every adjacent pair
that the merge table knows (by its rank) to all positions where it occurs. A heap of active ranks gives
the lowest; all its occurrences are merged at once, and only the lists of the pairs left and right of a
merged position are extended. Positions that went stale meanwhile are dropped when their rank comes up.
Words never influence one another, so the result is that of merging each word on its own.

Nulls and empty texts encode to no ids. Texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import regex


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeTable:
    """Merges of a byte-level vocabulary as sorted arrays."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        product = np.array([vocab[a + b] for a, b in pairs], np.int32)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.left, self.right, self.product = left.astype(np.int32), right.astype(np.int32), product
        letters = byte_alphabet()
        self.base = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int32)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the pair never merges."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int32)
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the number of ids of each word. No word may be empty."""
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum(lens)
        first, final = end - lens, end - 1
        sym = self.base[raw]
        sym[final] = self.last[raw[final]]
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[final], before[first] = -1, -1
        alive = np.ones(n, bool)

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def put(positions: np.ndarray, ranks: np.ndarray) -> None:
            known = ranks >= 0
            if not known.all():
                positions, ranks = positions[known], ranks[known]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, own in zip(ranks[np.r_[0, cuts]].tolist(), np.split(positions, cuts), strict=True):
                if r in index:
                    index[r].append(own)
                else:
                    index[r] = [own]
                    heapq.heappush(active, r)

        at = np.flatnonzero(after >= 0)
        put(at, self.rank_of(sym[at], sym[at + 1]))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            a, b, new = self.left[r], self.right[r], self.product[r]
            p = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            p = p[alive[p] & (sym[p] == a) & (after[p] >= 0)]
            p = p[sym[after[p]] == b]
            if a == b and len(p) > 1:  # of overlapping occurrences, every other one from the left
                start = np.r_[True, after[p[:-1]] != p[1:]]
                i = np.arange(len(p))
                p = p[(i - np.maximum.accumulate(np.where(start, i, 0))) % 2 == 0]
            if not len(p):
                continue
            gone = after[p]
            beyond = after[gone]
            sym[p] = new
            alive[gone] = False
            after[p] = beyond
            some = beyond >= 0
            before[beyond[some]] = p[some]
            q = before[p]
            q = q[q >= 0]
            s = p[some]
            at = np.concatenate((q, s))
            put(at, self.rank_of(sym[at], sym[after[at]]))
        counts = np.add.reduceat(alive.astype(np.int64), first)
        return sym[alive], counts


class ByteBpe:
    """Encoder and decoder for both kinds of vocabulary file that the tokenizers library writes.

    `spec` is the parsed JSON. The kind follows from the file: with a word-end suffix, text is normalised,
    lower-cased and stripped of white space; without, white space belongs to the tokens.
    """

    GPT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    SPACED, SPACED_FAST = regex.compile(r"\s*\S+|\s+"), re.compile(r"\s*\S+|\s+")
    SOLID = regex.compile(r"\S+")
    #: A mark that ends a word: a word of its own to the pattern, so the word before it can be one piece wherever it stands.
    CLOSED = re.compile(r"(?<=[^\W_])([,.;:!?])(?=\s)")
    #: Distinct pieces whose encodings a worker keeps; beyond it only those of the batch at hand stay, so memory is bounded.
    KEEP = 1_000_000

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.words = bool(suffix)
        self.merges = MergeTable(vocab, model["merges"], suffix)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.any_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        plain = {c: b for b, c in byte_alphabet().items()}
        cut = len(suffix)
        self.bytes_of: dict[int, bytes] = {}
        for token, i in vocab.items():
            body, tail = (token[:-cut], b" ") if cut and token.endswith(suffix) else (token, b"")
            self.bytes_of[i] = bytes(plain[c] for c in body) + tail
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """Runs of text that are encoded independently of what stands around them."""
        if self.special and "<|" in text and self.any_special.search(text):
            out: list[str] = []
            for part in self.any_special.split(text):
                out += [f" {part}"] if part in self.special else self._runs(part)  # no run begins so
            return out
        return self._runs(text)

    def _runs(self, text: str) -> list[str]:
        odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text  # white space to str and re only
        if not self.words:
            return (self.SPACED if odd else self.SPACED_FAST).findall(text)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        low = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)  # str.lower looks around that letter
        low = self.CLOSED.sub(r" \1", low)
        return self.SOLID.findall(low) if odd else low.split()

    def _words(self, piece: str) -> list[str]:
        """The words of a piece that is more than one run of letters; a special token has none."""
        if piece[0] == " " and piece[1:] in self.special:
            return []
        return (self.WORD if self.words else self.GPT).findall(piece)

    def learn(self, texts: Iterable[list[str]]) -> None:
        """Encode all pieces of the batch that are not kept yet, together."""
        now = set().union(*texts)
        if len(self.known) > self.KEEP:
            self.known = {m: self.known[m] for m in now & self.known.keys()}
        known = self.known
        missing = list(now - known.keys())
        # most pieces are one word; the words of the others are kept as well, as each is a piece of its own
        one = str.isalpha if self.words else lambda m: m[0] == " " and m[1:].isalpha()
        need = [m for m in missing if one(m)]
        split = [(m, self._words(m)) for m in missing if not one(m)]
        need += list({w for _, ws in split for w in ws if w not in known}.difference(need))
        ids, counts = self.merges.encode([w.encode() for w in need])
        blob = ids.astype("<u4").tobytes()
        end = (4 * np.cumsum(counts)).tolist()
        known.update(zip(need, [blob[first:last] for first, last in zip([0, *end[:-1]], end, strict=True)] if end else [], strict=True))
        for m, ws in split:
            known[m] = known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws])
        for m, i in self.special.items():
            if f" {m}" in known:
                known[f" {m}"] = np.array([i], "<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self.pieces(t or "") for t in texts]
        self.learn(pieces)
        of = self.known.__getitem__
        return [b"".join(map(of, ps)) for ps in pieces]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids, special tokens included; bytes that are no UTF-8 become the replacement character."""
        out = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return out.rstrip(" ") if self.words else out


_LOADED: dict[int, ByteBpe] = {}


def loaded(blob: bytes) -> ByteBpe:
    """The encoder of a vocabulary file's bytes, built once in each worker."""
    key = hash(blob)
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(json.loads(blob))
    return _LOADED[key]


def batches(texts: list[str | None], most: int = 10_000_000) -> Iterable[tuple[int, list[str]]]:
    """Slices of a column with about `most` characters; a longer text is a slice of its own."""
    start, size, own = 0, 0, []
    for i, t in enumerate(texts):
        own.append(t or "")
        size += len(own[-1])
        if size >= most:
            yield start, own
            start, size, own = i + 1, 0, []
    if own:
        yield start, own


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs, vocab_path: str, id_col: str = "doc_id", text_col: str = "text"):
    """One row per document: its number of ids and the digests of its ids and of their decoding.

    The vocabulary file (bounded, a few MB) is read on the driver and broadcast. One narrow pass, no
    shuffle. Null text counts as empty; repeated rows and ids give repeated rows; other columns are ignored.
    """
    import hashlib
    from pathlib import Path

    import pyarrow as pa

    from ._common import ship, tidied

    spark = docs.sparkSession
    ship(spark)
    vocab = spark.sparkContext.broadcast(Path(vocab_path).read_bytes())
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(parts):
        enc = loaded(vocab.value)
        for part in parts:
            ids = part.column(0)
            for start, texts in batches(part.column(1).to_pylist()):
                n, a, b = [], [], []
                for blob in enc.encode_batch(texts):
                    own = np.frombuffer(blob, "<u4").tolist()
                    n.append(len(own))
                    a.append(hashlib.sha256(",".join(map(enc.text_of.__getitem__, own)).encode()).hexdigest())
                    b.append(hashlib.sha256(enc.decode(own).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(texts)), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(tidied(run), f"id {id_type}, {DIGEST}").withColumnRenamed("id", id_col)


def encode(docs, vocab_path: str, id_col: str = "doc_id", text_col: str = "text"):
    """One row per document with its ids as an array; the general form of the operator."""
    from pathlib import Path

    import pyarrow as pa

    from ._common import ship, tidied

    spark = docs.sparkSession
    ship(spark)
    vocab = spark.sparkContext.broadcast(Path(vocab_path).read_bytes())
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(parts):
        enc = loaded(vocab.value)
        for part in parts:
            for start, texts in batches(part.column(1).to_pylist()):
                ids = pa.array([np.frombuffer(x, "<i4") for x in enc.encode_batch(texts)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0).slice(start, len(texts)), ids], ["id", "ids"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(tidied(run), f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids"):
    """The texts of encoded documents; null ids give null."""
    from pathlib import Path

    import pyarrow as pa

    from ._common import ship, tidied

    spark = encoded.sparkSession
    ship(spark)
    vocab = spark.sparkContext.broadcast(Path(vocab_path).read_bytes())
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(parts):
        enc = loaded(vocab.value)
        for part in parts:
            texts = [None if x is None else enc.decode(x) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")).mapInArrow(tidied(run), f"id {id_type}, text string").withColumnRenamed("id", id_col)
