"""Byte-pair encoding with a segment tree over adjacent pair ranks, and decoding.

A pre-token's symbols form a linked list. Leaf i of the tree holds (rank, i) for the pair that
symbol i makes with its right neighbour; the root is the leftmost pair of the lowest rank. A
merge changes three leaves, so a pre-token of n bytes takes O(n log n), however long it is.
Pre-tokens repeat: their ids are kept in a cache of bounded size.

Cases: null and empty texts have no ids; special tokens in a text are ids of their own, as the
library does by default; repeated rows each get a row; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import TwoGenerationCache, documents
from .tokens import BYTE_PATTERN, ChunkedEncoder, byte_chars, pre_tokens

NONE = 1 << 62
#: Bytes of a cache of ids; it goes with its task.
CACHE = 128 << 20


class ByteLevelBPE:
    """A byte-level vocabulary with its merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        byte_of = {c: b for b, c in enumerate(byte_chars())}
        as_bytes = lambda s: bytes(byte_of[c] for c in s)
        ids = model["vocab"]
        self.of_byte = [ids[c] for c in byte_chars()]
        #: (left id << 32 | right id) -> (rank << 32 | merged id)
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(ids[a] << 32 | ids[b], rank << 32 | ids[a + b])
        self.bytes_of = [b""] * (1 + max([*ids.values(), *[t["id"] for t in spec["added_tokens"]]]))
        for s, i in ids.items():
            self.bytes_of[i] = as_bytes(s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.keys = np.array(sorted(self.merges), np.int64)
        self.values = np.array([self.merges[k] for k in self.keys.tolist()], np.int64)
        self._find = regex.compile(BYTE_PATTERN).findall
        self._split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self._pieces = TwoGenerationCache(self._merged, CACHE)
        self.encoder = ChunkedEncoder(self._chunks, spaced=True, most=CACHE)

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def merge(self, raw: bytes) -> list[int]:
        """The ids of one pre-token."""
        of, merges = self.of_byte, self.merges
        ids = [of[b] for b in raw]
        n = len(ids)
        if n < 2:
            return ids
        size = 1 << max(1, (n - 2).bit_length())
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            m = merges.get(ids[i] << 32 | ids[i + 1])
            if m is not None:
                tree[size + i] = (m >> 32) << 32 | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                least = a if a < b else b
                if tree[k] == least:
                    return
                tree[k] = least
                k >>= 1

        while tree[1] != NONE:
            i = tree[1] & 0xFFFFFFFF
            j = right[i]
            ids[i] = merges[ids[i] << 32 | ids[j]] & 0xFFFFFFFF
            ids[j] = -1
            k = right[i] = right[j]
            if j < n - 1:
                put(j, NONE)
            if k < n:
                left[k] = i
                m = merges.get(ids[i] << 32 | ids[k])
                put(i, NONE if m is None else (m >> 32) << 32 | i)
            else:
                put(i, NONE)
            h = left[i]
            if h >= 0:
                m = merges.get(ids[h] << 32 | ids[i])
                put(h, NONE if m is None else (m >> 32) << 32 | h)
        return [x for x in ids if x >= 0]

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 32 | merged id of pairs of ids, or NONE."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def merge_many(self, raws: list[bytes], width: int) -> list[bytes]:
        """merge() of pre-tokens of at most ``width`` bytes (a power of two, 256 at most), a
        tree a row: the same point updates, for all rows that can still merge at once."""
        n = np.array([len(r) for r in raws])
        rows = np.arange(len(raws))
        ids = np.full((len(raws), width + 1), -1, np.int64)
        ids[:, :width][np.arange(width) < n[:, None]] = np.array(self.of_byte, np.int64)[np.frombuffer(b"".join(raws), np.uint8)]
        right = np.tile(np.arange(1, width + 2), (len(raws), 1))
        left = np.tile(np.arange(-1, width), (len(raws), 1))
        tree = np.full((len(raws), 2 * width), NONE, np.int64)
        pos = np.arange(width)
        r, p = np.nonzero(pos[None, :] + 1 < n[:, None])

        def leaf(r, p, q):
            pair = self._pair(ids[r, p], ids[r, q])
            return np.where(pair == NONE, NONE, (pair >> 32) << 8 | p)

        tree[r, width + p] = leaf(r, p, p + 1)
        k = width
        while k > 1:
            tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k //= 2
        by_rank = np.zeros(int((self.values >> 32).max(initial=0)) + 1, np.int64)
        by_rank[self.values >> 32] = self.values & 0xFFFFFFFF
        while len(rows := rows[tree[rows, 1] != NONE]):
            root = tree[rows, 1]
            i = root & 0xFF
            j = right[rows, i]
            k = right[rows, j]
            h = left[rows, i]
            ids[rows, i] = by_rank[root >> 8]
            ids[rows, j] = -1
            right[rows, i] = k
            left[rows, np.minimum(k, width)] = i
            tree[rows, width + j] = NONE
            tree[rows, width + i] = NONE
            more = k < n[rows]
            tree[rows[more], width + i[more]] = leaf(rows[more], i[more], k[more])
            before = h >= 0
            tree[rows[before], width + h[before]] = leaf(rows[before], h[before], i[before])
            r, at = np.r_[rows, rows, rows[before]], width + np.r_[i, j, h[before]]
            while at[0] > 1:
                at = at >> 1
                tree[r, at] = np.minimum(tree[r, 2 * at], tree[r, 2 * at + 1])
        alive = ids >= 0
        flat = ids[alive].astype("<u4").tobytes()
        ends = (4 * np.cumsum(alive.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _merged(self, new: list[str]) -> list[bytes]:
        raws, out = [p.encode("utf-8") for p in new], [b""] * len(new)
        sizes = np.array([len(r) for r in raws])
        for lo, width in ((0, 8), (8, 16), (16, 32), (32, 64)):
            own = np.flatnonzero((sizes > lo) & (sizes <= width))
            for s in range(0, len(own), 20_000):
                part = own[s : s + 20_000].tolist()
                for i, x in zip(part, self.merge_many([raws[i] for i in part], width), strict=True):
                    out[i] = x
        for i in np.flatnonzero(sizes > 64).tolist():
            out[i] = self._pack(self.merge(raws[i]))
        return out

    def _chunks(self, new: list[str]) -> list[bytes]:
        special = self.special
        has = {c for c in new if self._split and any(s in c for s in special)}
        split = [[p for part in self._split(c) for p in ([part] if part in special else self._find(part))] if c in has else pre_tokens(c, self._find) for c in new]
        self._pieces.fetch(set().union(*split) - special.keys())
        known = {s: self._pack([i]) for s, i in special.items()}
        get = self._pieces.__getitem__
        return [b"".join([known[p] if p in known else get(p) for p in x]) if c in has else b"".join(map(get, x)) for c, x in zip(new, split, strict=True)]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4") for x in self.encoder.encode_many(texts)]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def release(self) -> None:
        self._pieces.release()
        self.encoder.release()

    def decode(self, ids) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "replace")


@functools.cache
def load(path: str) -> ByteLevelBPE:
    return ByteLevelBPE(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            ids = bpe.encode_many(b.column(1).to_pylist())
            ends = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"])
        bpe.release()

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of a table with doc_id and ids (array of int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoding and then decoding each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        decimal = [str(i).encode() for i in range(len(bpe.bytes_of))]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            n, of_ids, of_text = [], [], []
            for lo in range(0, b.num_rows, 200):
                for x in bpe.encode_many(b.column(1).slice(lo, 200).to_pylist()):
                    ids = x.tolist()
                    n.append(len(ids))
                    of_ids.append(sha(b",".join(map(decimal.__getitem__, ids))))
                    of_text.append(sha(bpe.decode(ids).encode("utf-8")))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.release()

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
