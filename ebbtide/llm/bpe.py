"""Byte-level BPE: texts to token ids and back, with a hierarchical-bitmap rank queue.

A pre-token is a linked list of tokens. Each pair of neighbours whose bytes have a rank waits in the bucket of that rank.
Which buckets are in use is kept in a bitmap of two levels, so the lowest rank is found with two find-first-set steps
however long the pre-token is. A merge changes two neighbouring pairs; entries of pairs that no longer stand are left
where they are and skipped when they come up. Encoding a pre-token of n bytes takes O(n log n) steps at most.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ebbtide.llm.common import small_batches

CACHE_ENTRIES = 400_000
"""Pre-tokens in each of the two generations a worker remembers. Forgetting changes no result."""
CACHE_CHARS = 40
"""Longer pre-tokens are encoded each time."""


class RankQueue:
    """Positions by rank; ``pop`` gives the leftmost position of the lowest rank.

    Bit r of the leaves says that rank r's bucket is in use, bit w of ``top`` that leaf w has a bit set. ``Encoder.merge``
    takes these two steps in place, on the leaves and buckets kept here: a call would cost as much as the step.
    """

    __slots__ = ("buckets", "leaves", "top")
    BITS = tuple(1 << i for i in range(256))

    def __init__(self, n_ranks: int) -> None:
        self.leaves = [0] * ((n_ranks >> 8) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        leaf = rank >> 8
        if not self.leaves[leaf]:
            self.top |= 1 << leaf
        self.leaves[leaf] |= self.BITS[rank & 255]

    def pop(self) -> tuple[int, int]:
        top, leaves = self.top, self.leaves
        leaf = (top & -top).bit_length() - 1
        word = leaves[leaf]
        first = word & -word
        rank = leaf << 8 | first.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        leaves[leaf] = word = word ^ first
        if not word:
            self.top = top & (top - 1)
        return rank, bucket[0]


class Recent(dict):
    """Packed ids of the pre-tokens met of late; one it does not hold is looked up by its encoder."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        return self.encoder.recall(piece)


class Encoder:
    """Encoding and decoding by a rank file, one base64 token and its rank a line."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.longest = max(map(len, ranks))
        self.by_rank: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.by_rank[rank] = token
        self.queue = RankQueue(len(self.by_rank))
        self.young, self.old = Recent(self), {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        get, longest, n = self.ranks.get, self.longest, len(piece)
        leaves, buckets, bits, top = self.queue.leaves, self.queue.buckets, RankQueue.BITS, 0
        end = list(range(1, n + 2))  # the token at i is piece[i:end[i]]; the next one starts at end[i]
        before = list(range(-1, n))
        waits = [-1] * n  # rank of the pair that starts at i, as it stands now
        for i in range(n - 1):
            rank = get(piece[i:i + 2])
            if rank is not None:
                waits[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)  # positions rise here, so the bucket stays a heap
                else:
                    buckets[rank] = [i]
                    top |= 1 << (rank >> 8)
                    leaves[rank >> 8] |= bits[rank & 255]
        while top:
            leaf = (top & -top).bit_length() - 1
            word = leaves[leaf]
            first = word & -word
            rank = leaf << 8 | first.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                leaves[leaf] = word = word ^ first
                if not word:
                    top &= top - 1
            if waits[i] != rank:
                continue  # stale: one of its tokens has been merged since
            j = end[i]
            stop = end[i] = end[j]
            waits[j] = waits[i] = -1
            if stop < n:
                before[stop] = i
                if end[stop] - i <= longest and (rank := get(piece[i:end[stop]])) is not None:
                    waits[i] = rank
                    if rank in buckets:
                        heappush(buckets[rank], i)
                    else:
                        buckets[rank] = [i]
                        top |= 1 << (rank >> 8)
                        leaves[rank >> 8] |= bits[rank & 255]
            left = before[i]
            if left >= 0:
                waits[left] = -1
                if stop - left <= longest and (rank := get(piece[left:stop])) is not None:
                    waits[left] = rank
                    if rank in buckets:
                        heappush(buckets[rank], left)
                    else:
                        buckets[rank] = [left]
                        top |= 1 << (rank >> 8)
                        leaves[rank >> 8] |= bits[rank & 255]
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i:end[i]]])
            i = end[i]
        return ids

    def recall(self, piece: str) -> bytes:
        """Packed ids of a pre-token that the young generation does not hold."""
        ids = self.old.get(piece)
        if ids is None:
            found = self.merge(piece.encode())
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= CACHE_CHARS:
            if len(self.young) >= CACHE_ENTRIES:
                self.old, self.young = self.young, Recent(self)
            self.young[piece] = ids
        return ids

    def packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.young.__getitem__, self.split.findall(text)))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.by_rank.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Encoder:
    with open(path, "rb") as f:
        return Encoder({base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}, pattern)


def encode(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its ``key`` and ``token_ids``, the ids as little-endian unsigned 32-bit integers.

    A null text has no ids, as an empty one. Repeated rows and null keys are kept as they are; other columns of ``docs``
    are not read. ``vocabulary`` is the path of a rank file that every executor has installed.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load(vocabulary, pattern)
        for b in batches:
            yield pd.DataFrame({"_key": b["_key"], "token_ids": [encoder.packed(t) for t in b["_text"]]})

    given = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = given.schema["_key"].dataType.simpleString()
    return given.mapInPandas(run, f"_key {kind}, token_ids binary").withColumnRenamed("_key", key)


def decode(encoded: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """``key``, ``token_ids`` and ``decoded``: the bytes that the ids stand for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load(vocabulary, pattern)
        for b in batches:
            yield b.assign(decoded=[encoder.decode(np.frombuffer(x, "<u4")) for x in b["token_ids"]])

    given = encoded.select(F.col(key).alias("_key"), "token_ids")
    kind = given.schema["_key"].dataType.simpleString()
    return given.mapInPandas(run, f"_key {kind}, token_ids binary, decoded binary").withColumnRenamed("_key", key)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """``key``, n_tokens, ids_sha256, decoded_sha256 and, unless left out, token_ids: texts encoded and their ids decoded, in one pass.

    Rows as in ``encode``. The digests are of the packed ids and of the bytes that those ids stand for.
    """
    small_batches(docs.sparkSession)
    given = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    out = T.StructType([given.schema["_key"], *T._parse_datatype_string("n_tokens long, ids_sha256 string, decoded_sha256 string")])
    out = out.add("token_ids", "binary") if with_ids else out
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(vocabulary, pattern)
        for b in batches:
            ids, n, coded, decoded = [], [], [], []
            for t in b["_text"]:
                packed = encoder.packed(t.as_py())
                n.append(len(packed) // 4)
                coded.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(encoder.decode(np.frombuffer(packed, "<u4"))).hexdigest())
                if with_ids:
                    ids.append(packed)
            columns = [b["_key"], pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, schema=schema)

    return given.mapInArrow(run, out).withColumnRenamed("_key", key)
