"""Token ids of a corpus by a public byte-level BPE vocabulary.

Each pre-token is merged with a rank queue made for very long pre-tokens:

* symbols form a linked list over byte positions;
* every merge rank has a bucket of positions whose pair has that rank, and a
  three-level bitmap of 64-bit words says which buckets hold something;
* find-first-set on the levels gives the lowest rank, the bucket its leftmost
  position; entries whose pair has changed since are stale and skipped.

A merge costs O(log n) whatever the length.  Pre-tokens met before are taken from
a bounded memo of earlier results of the same routine.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.runtime import need

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-token pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO = 1 << 18


def load_ranks(path: str = VOCABULARY) -> list[bytes]:
    """Tokens in rank order from a rank file ('base64 rank' a line)."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, r in pairs:
        out[int(r)] = base64.b64decode(token)
    return out


class RankQueue:
    """Positions by merge rank: buckets under a hierarchical bitmap."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        words = (ranks >> 6) + 1
        self.low = [0] * words
        self.mid = [0] * ((words >> 6) + 1)
        self.top = 0

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [at]
            w = rank >> 6
            self.low[w] |= 1 << (rank & 63)
            self.mid[w >> 6] |= 1 << (w & 63)
            self.top |= 1 << (w >> 6)
        else:
            heappush(bucket, at)

    def pop(self) -> tuple[int, int] | None:
        """Lowest rank and its leftmost position."""
        if not self.top:
            return None
        t = (self.top & -self.top).bit_length() - 1
        m = self.mid[t]
        w = (t << 6) + (m & -m).bit_length() - 1
        b = self.low[w]
        rank = (w << 6) + (b & -b).bit_length() - 1
        bucket = self.buckets[rank]
        at = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[w] &= b - 1
            if not self.low[w]:
                self.mid[t] &= m - 1
                if not self.mid[t]:
                    self.top &= self.top - 1
        return rank, at


class Encoder:
    """Byte-level BPE without special tokens."""

    def __init__(self, tokens: list[bytes], pattern: str = PATTERN):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self.byte_id = [self.rank[bytes([b])] for b in range(256)]
        self.find = regex.compile(pattern).findall
        self.pairs: dict[tuple[int, int], int] = {}
        self.memo: dict[str, list[int]] = {}

    def pair_rank(self, a: int, b: int) -> int:
        """Rank of the merge of two symbols, -1 if they don't merge."""
        r = self.pairs.get((a, b))
        if r is None:
            if len(self.pairs) >= 4 * MEMO:
                self.pairs.clear()
            r = self.pairs[a, b] = self.rank.get(self.tokens[a] + self.tokens[b], -1)
        return r

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        n = len(piece)
        ids = [self.byte_id[b] for b in piece]
        if n == 1:
            return ids
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        pending = [-1] * n  # rank of the pair that starts here now
        queue = RankQueue(len(self.tokens))
        for i in range(n - 1):
            r = self.pair_rank(ids[i], ids[i + 1])
            if r >= 0:
                pending[i] = r
                queue.push(r, i)
        while (entry := queue.pop()) is not None:
            r, i = entry
            if pending[i] != r:
                continue  # stale
            j = after[i]
            k = after[j]
            ids[i] = r
            ids[j] = -1
            pending[j] = -1
            after[i] = k
            pending[i] = -1
            if k < n:
                before[k] = i
                x = self.pair_rank(r, ids[k])
                if x >= 0:
                    pending[i] = x
                    queue.push(x, i)
            h = before[i]
            if h >= 0:
                x = self.pair_rank(ids[h], r)
                if x != pending[h]:
                    pending[h] = x
                    if x >= 0:
                        queue.push(x, h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        memo, merge = self.memo, self.merge
        for piece in self.find(text):
            got = memo.get(piece)
            if got is None:
                got = merge(piece.encode("utf-8"))
                if len(piece) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = got
            out += got
        return out


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """The encoder of this Python worker, made once per broadcast vocabulary."""
    key = shared._jbroadcast.id() if hasattr(shared, "_jbroadcast") and shared._jbroadcast is not None else id(shared.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value)
    return _ENCODERS[key]


def _share(spark: SparkSession, path: str):
    """The vocabulary (one file, about 1 MB) for all executors."""
    return spark.sparkContext.broadcast(load_ranks(path))


def encode_corpus(df: DataFrame, id_col: str, text_col: str, path: str = VOCABULARY) -> DataFrame:
    """``<id_col>, ids ARRAY<INT>``: one row per row of ``df``, no special tokens.

    Texts are taken exactly as they are.  Null and empty text give an empty list;
    a blank text has ids like any other.  Repeated rows come out repeated, a null
    id stays null, further columns aren't read.  Narrow: no shuffle.
    """
    need(df, id_col, text_col)
    shared = _share(df.sparkSession, path)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared).encode
        for batch in batches:
            flat, ends = array("i"), [0]
            done = 0
            for i, text in enumerate(batch.column(1)):
                s = text.as_py()
                if s:
                    flat.extend(encode(s))
                ends.append(len(flat))
                if len(flat) > 4_000_000:  # very long texts: pass on what there is
                    yield _ids(batch, done, i + 1, flat, ends)
                    flat, ends, done = array("i"), [0], i + 1
            if done < batch.num_rows:
                yield _ids(batch, done, batch.num_rows, flat, ends)

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return out.mapInArrow(run, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def _ids(batch: pa.RecordBatch, start: int, stop: int, flat: array, ends: list[int]) -> pa.RecordBatch:
    values = pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.array([], np.int32), pa.int32())
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
    return pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), lists], names=["id", "ids"])


def token_counts(df: DataFrame, text_col: str, name: str = "n_tokens", path: str = VOCABULARY) -> DataFrame:
    """``df`` with the number of token ids of a text column; 0 for null and empty."""
    need(df, text_col)
    shared = _share(df.sparkSession, path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text_col)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode: Callable[[str], list[int]] = _encoder(shared).encode
        for batch in batches:
            n = [len(encode(s)) if (s := t.as_py()) else 0 for t in batch.column(at)]
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            names = [c for i, c in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64())], names=[*names, name])

    return df.mapInArrow(run, f"{schema}, `{name}` bigint")
