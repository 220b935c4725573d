"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.llm.common import table

#: Pre-tokens of a worker's cache; when full it is emptied, which changes speed only.
CACHE = 400_000
#: Text bytes encoded into one output batch, and tokens held as Python objects at once.
BATCH_BYTES, STEP = 4_000_000, 200_000


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys, n slots (hash, displace).

    Keys fall into buckets; large buckets first, each gets the first displacement that puts its
    keys into free slots. Buckets of one key name their slot directly, as a negative number.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 4)
        groups: dict[int, list[tuple[int, int]]] = {}
        for i, k in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(k)
            groups.setdefault(h % self.buckets, []).append((h >> 16, i))
        self.moves, self.order, free = [0] * self.buckets, [-1] * n, bytearray(b"\x01" * n)
        singles = []
        for bucket, members in sorted(groups.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                singles.append((bucket, members[0][1]))
                continue
            for d in itertools.count(1):
                slots = [(h ^ (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFF)) % n for h, _ in members]
                if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                    break
            self.moves[bucket] = d
            for s, (_, i) in zip(slots, members, strict=True):
                free[s], self.order[s] = 0, i
        empty = (s for s in range(n) if free[s])
        for bucket, i in singles:
            s = next(empty)
            self.moves[bucket], self.order[s] = -s - 1, i

    def slot(self, key: bytes) -> int:
        """The key's slot; of another string any slot, so the caller compares."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.moves[h % self.buckets]
        return -d - 1 if d < 0 else ((h >> 16) ^ (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFF)) % self.n


class Encoder:
    """Encodes and decodes with the ranks of a .tiktoken file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.key_at = [keys[i] for i in self.hash.order]
        self.id_at = [ranks[k] for k in self.key_at]
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        size = max(ranks.values()) + 1
        words = [b""] * size
        for k, i in ranks.items():
            words[i] = k
        self.words = words
        self.blob = np.frombuffer(b"".join(words), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        self._find = self._cache = self._pairs = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_find": None, "_cache": None, "_pairs": None}

    @property
    def pairs(self) -> dict[int, int]:
        """Every merge: two ids, as one number, and the id of their bytes together. Fixed by the vocabulary."""
        if self._pairs is None:
            ids = dict(zip(self.key_at, self.id_at, strict=True))
            splits = ((ids.get(k[:c]), ids.get(k[c:]), i) for k, i in ids.items() for c in range(1, len(k)))
            self._pairs = {a << 32 | b: i for a, b, i in splits if a is not None and b is not None}
        return self._pairs

    @property
    def cache(self) -> dict[str, bytes]:
        """The ids of pre-tokens met so far by this process: a worker keeps them from task to task."""
        if self._cache is None:
            self._cache = _Cache(self)
        return self._cache

    def rank(self, key: bytes) -> int:
        """The id of a whole string of the vocabulary, or -1."""
        s = self.hash.slot(key)
        return self.id_at[s] if self.key_at[s] == key else -1

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: its own if it is in the vocabulary, else those left by the
        merges in the order of rank, then place. Bytes are linked; the heap holds possible merges.
        """
        whole = self.rank(piece)
        if whole >= 0:
            return [whole]
        n, merged = len(piece), self.pairs.get
        ids = [self.byte_ids[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []  # the rank of a merge and its place, as one number
        for i in range(n - 1):
            r = merged(ids[i] << 32 | ids[i + 1], -1)
            if r >= 0:
                heap.append(r << 32 | i)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            i, r = r & 0xFFFFFFFF, r >> 32
            j = after[i]
            if ids[i] < 0 or j >= n or merged(ids[i] << 32 | ids[j], -1) != r:
                continue  # one of the two has been merged with another
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                x = merged(r << 32 | ids[k], -1)
                if x >= 0:
                    heapq.heappush(heap, x << 32 | i)
            h = before[i]
            if h >= 0:
                x = merged(ids[h] << 32 | r, -1)
                if x >= 0:
                    heapq.heappush(heap, x << 32 | h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str, cache: dict[str, bytes]) -> np.ndarray:
        """The ids of a whole text, each match of the pattern separately."""
        if self._find is None:
            self._find = regex.compile(self.pattern)
        if len(text) < STEP:
            parts = [self._find.findall(text)]
        else:
            found = (m.group() for m in self._find.finditer(text))
            parts = iter(lambda: list(itertools.islice(found, STEP)), [])
        out = [b"".join([cache[p] for p in part]) for part in parts]
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        out = []
        for low in range(0, len(ids), STEP):
            part = ids[low : low + STEP]
            first = self.starts[part]
            sizes = self.starts[part + 1] - first
            ends = np.cumsum(sizes)
            out.append(self.blob[np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


class _Cache(dict):
    """The ids, as bytes, of the pre-tokens met so far."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = np.array(self.encoder.encode_piece(piece.encode()), np.int32).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def load(path: str, pattern: str) -> Encoder:
    """An encoder of the vocabulary at path (lines of base64 and rank). Read on the driver only."""
    with open(path, "rb") as lines:
        return Encoder({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}, pattern)


def encode_documents(docs: DataFrame, encoder: Encoder) -> DataFrame:
    """docs plus ids (array of int) and decoded (binary, the ids decoded again).

    Null text counts as empty: no ids, nothing decoded. Whole texts are encoded without special
    tokens. Repeated rows keep their rows, columns of docs named ids or decoded are replaced, an
    empty table gives an empty result.

    A map over batches without a shuffle. The vocabulary, of a fixed size, is broadcast. Output
    batches hold about BATCH_BYTES of text, long texts are matched in steps.
    """
    names = ("ids", "decoded")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    schema = T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.BinaryType())])
    shared = docs.sparkSession.sparkContext.broadcast(encoder)
    column = kept.columns.index("text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = shared.value
        cache = e.cache
        for batch in batches:
            low = 0
            while low < len(batch):
                ids, decoded, size, high = [], [], 0, low
                while high < len(batch) and size < BATCH_BYTES:
                    text = batch.column(column)[high].as_py() or ""
                    ids.append(e.encode(text, cache))
                    decoded.append(e.decode(ids[-1]))
                    size += len(decoded[-1])
                    high += 1
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))
                rows = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*rows.columns, lists, pa.array(decoded, pa.binary())], names=[*rows.schema.names, *names])
                low = high

    return kept.mapInArrow(encode, schema)


def digests() -> list[Column]:
    """Of encoded documents: n_tokens and the SHA-256 of the ids and of the decoded bytes."""
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]


def public_encoder() -> Encoder:
    """The multilingual public vocabulary."""
    import public_tokenizers

    return load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_encoder()).select("doc_id", *digests())
