"""Byte-level BPE encoding and decoding with a two-tier lookup.

First tier: a minimal perfect hash resolves a whole pre-token that is in the vocabulary. Second tier: for the others,
a heap of mergeable pairs over linked bytes, lowest rank first, the leftmost of equals first.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import held, small_batches
from .units import UnitMemory, by_pieces, gather

_GOLD = 0x9E3779B97F4A7C15


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """A minimal perfect hash: levels of bit arrays, each for the keys that collided on the level before; a key's index is the number of bits before its own."""

    def __init__(self, keys: list[bytes], room: float = 2.0) -> None:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        if len(np.unique(hashes)) != len(keys):
            raise ValueError("two keys have one hash")
        self.sizes: list[int] = []
        bits: list[np.ndarray] = []
        rest = hashes
        while len(rest):
            size = max(1, int(room * len(rest)))
            at = self._slot(rest, len(self.sizes), size)
            n = np.bincount(at, minlength=size)
            bits.append(n == 1)
            self.sizes.append(size)
            rest = rest[n[at] > 1]
        self.bits = np.concatenate(bits) if bits else np.zeros(0, bool)
        self.before = np.cumsum(self.bits) - self.bits
        self.base = np.cumsum([0, *self.sizes])
        self.keys: list[bytes] = [b""] * len(keys)
        for key, i in zip(keys, self.index(hashes).tolist(), strict=True):
            self.keys[i] = key

    @staticmethod
    def _slot(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        x = hashes + np.uint64((level + 1) * _GOLD & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def index(self, hashes: np.ndarray) -> np.ndarray:
        """The index of each hash, -1 where no level has it; the key at an index must still be compared."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        left = np.arange(len(hashes))
        for level, size in enumerate(self.sizes):
            at = self.base[level] + self._slot(hashes[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.before[at[hit]]
            left = left[~hit]
        return out

    def find(self, wanted: list[bytes]) -> list[int]:
        at = self.index(np.fromiter(map(xxhash.xxh3_64_intdigest, wanted), np.uint64, len(wanted))).tolist()
        keys = self.keys
        return [i if i >= 0 and keys[i] == w else -1 for i, w in zip(at, wanted, strict=True)]


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token by merging. ``end[i]`` is where the part that begins at i ends, 0 once it has been merged away."""
    n = len(piece)
    end, prev, get = list(range(1, n + 1)), list(range(-1, n - 1)), ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, e = heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != e:
            continue
        end[i], end[j] = e, 0
        if e < n:
            prev[e] = i
            if (r := get(piece[i : end[e]])) is not None:
                heappush(heap, (r, i, end[e]))
        if (p := prev[i]) >= 0 and (r := get(piece[p:e])) is not None:
            heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """encode and decode for a rank table and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.hash = PerfectHash(list(ranks))
        self.id_at = np.fromiter((ranks[k] for k in self.hash.keys), np.int64, len(ranks)).tolist()
        #: The bytes of all ids one after another, where each begins, and its length.
        by_id = {i: b for b, i in ranks.items()}
        top = max(by_id, default=-1) + 1
        self.bytes_length = np.fromiter((len(by_id.get(i, b"")) for i in range(top)), np.int64, top)
        self.bytes_start = np.cumsum(self.bytes_length) - self.bytes_length
        self.bytes_flat = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(top)), np.uint8)
        self.memory: UnitMemory | None = None

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "pattern": self.pattern.pattern}

    def __setstate__(self, s: dict) -> None:
        self.__init__(s["ranks"], s["pattern"])

    def encode_words(self, words: list[str]) -> list[bytes]:
        raw = [w.encode("utf-8") for w in words]
        ranks = self.ranks
        return [array("I", [self.id_at[i]] if i >= 0 else merged(w, ranks)).tobytes() for w, i in zip(raw, self.hash.find(raw), strict=True)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.memory is None:
            self.memory = UnitMemory(by_pieces(self.pattern.findall, self.encode_words))
        return self.memory.ids(texts)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids one after another, and how many each id has."""
        ids = ids.astype(np.int64)
        length = self.bytes_length[ids]
        return gather(self.bytes_flat, self.bytes_start[ids], length), length


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, digests: bool = True) -> DataFrame:
    """For each row: doc_id, n_tokens, and as asked for ids (the token ids), ids_sha256 and decoded_sha256.

    A null or empty text has no ids, and its digests are those of no bytes. Every match of the pattern is encoded separately and
    no special token is known. Each row is encoded by itself, so ties and repeated rows give equal results; other columns,
    whatever their names, are not read. Whole texts are encoded, however long. The rank table has a bounded size (the
    vocabulary's) and is broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    key = hashlib.sha256(repr((len(ranks), pattern, sorted(ranks.items())[:100])).encode()).hexdigest()
    shipped = spark.sparkContext.broadcast((ranks, pattern))
    id_type = docs.schema[id_col].dataType.simpleString()
    kind = f"doc_id {id_type}, n_tokens bigint" + ", ids array<int>" * keep_ids + ", ids_sha256 string, decoded_sha256 string" * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held(f"bpe-{key}", lambda: Codec(*shipped.value))
        for batch in batches:
            flat, per = codec.encode(batch.column(1))
            ends = np.cumsum(per)
            columns = [batch.column(0), pa.array(per, pa.int64())]
            names = ["doc_id", "n_tokens"]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.astype(np.int32))))
                names.append("ids")
            if digests:
                raw, length = codec.decode(flat)
                at = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], ends])].tolist()
                ids, text, cut = memoryview(flat.astype("<u4").tobytes()), memoryview(raw.tobytes()), [0, *ends.tolist()]
                columns += [pa.array([hashlib.sha256(ids[4 * a : 4 * b]).hexdigest() for a, b in zip(cut, cut[1:], strict=False)], pa.string()), pa.array([hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)], pa.string())]
                names += ["ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(id_col, text_col).mapInArrow(run, kind)
