"""Byte-level BPE in numpy: whole matrices of pieces are merged at once.

A text is split by the pattern; each distinct piece becomes a row of byte ids in the matrix of its length bucket. In a
round every row merges its leftmost pair of minimum rank: pairs are looked up in a hash table, the merged cell is
dropped by compaction, and only the two pairs beside it are looked up again. Rows without a pair to merge leave.
Pieces beyond LONG bytes are merged one by one with a heap, to the same result, as a matrix would take a round a merge.

Defined cases: a null text is empty and has no ids; equal texts give equal ids; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import gather, raw, ship, slices
from vellum.llm.tokens import ChunkMemo, chunked, odd_spacing, rest

NONE = np.int32(2**31 - 1)
LONG = 512

#: White space in the sense of Unicode, which is what the rank files' own library means by \s.
WHITE = r"\t-\r \x85\xa0  -     　"


def compile_pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"[^\s", rf"[^{WHITE}").replace(r"\S", rf"[^{WHITE}]").replace(r"\s", rf"[{WHITE}]"))


class PairTable:
    """Rank of the merge of two ids, by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(2 * len(rank)).bit_length())
        self.mask = np.uint64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = todo[self.keys[slot[todo]] == np.uint64(2**64 - 1)]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.ranks[slot[put]] = key[put], rank[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where there is no merge or a side is padding (below 0)."""
        shape = left.shape
        left, right = left.reshape(-1), right.reshape(-1)
        out = np.full(len(left), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = (left[todo].astype(np.uint64) << np.uint64(32)) | right[todo].astype(np.uint64)
        slot = self._slot(key)
        while len(todo):
            seen = self.keys[slot]
            hit = seen == key
            out[todo[hit]] = self.ranks[slot[hit]]
            go = ~hit & (seen != np.uint64(2**64 - 1))
            todo, key, slot = todo[go], key[go], (slot[go] + np.uint64(1)) & self.mask
        return out.reshape(shape)


class Ranks:
    """A rank file with its pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = compile_pattern(pattern)
        left, right, rank = [], [], []
        for token, r in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(rank, np.int32))
        self.byte_ids = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        size = max(self.rank.values()) + 1
        held = [b""] * size
        for token, r in self.rank.items():
            held[r] = token
        self.bytes_of = pa.array(held, pa.binary())
        self.decimal = pa.array([str(i) for i in range(size)], pa.string())
        self.memo = ChunkMemo(self.spaced, self.texts)

    # -- merging -------------------------------------------------------------------------------------------------

    def merge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces given as bytes and offsets: flat ids and their number a piece."""
        size = np.diff(offsets)
        rows, ids, counts = [], [], []
        for low, high in [(1, 4), (5, 8), (9, 16), (17, 32), (33, 64), (65, 128), (129, 256), (257, LONG)]:
            own = np.flatnonzero((size >= low) & (size <= high))
            for at in range(0, len(own), max(1, (1 << 20) // high)):
                part = own[at : at + max(1, (1 << 20) // high)]
                for done, got, n in self._rounds(data, offsets[part], size[part], high):
                    rows.append(part[done])
                    ids.append(got)
                    counts.append(n)
        for i in np.flatnonzero(size > LONG):
            got = self._heap(self.byte_ids[data[offsets[i] : offsets[i + 1]]].tolist())
            rows.append(np.array([i]))
            ids.append(np.array(got, np.int32))
            counts.append(np.array([len(got)]))
        lengths = np.zeros(len(size), np.int64)
        if not rows:
            return np.empty(0, np.int32), lengths
        row, flat, n = np.concatenate(rows), np.concatenate(ids), np.concatenate(counts)
        lengths[row] = n
        starts = np.zeros(len(size), np.int64)
        starts[row] = np.cumsum(n) - n
        return gather(flat, starts, lengths), lengths

    def _rounds(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, width: int):
        """Yields row numbers, flat ids and their number for the rows that are merged to the end."""
        cell = np.arange(width)
        inside = cell < size[:, None]
        m = np.where(inside, self.byte_ids[data[np.where(inside, starts[:, None] + cell, 0)]], np.int32(-1))
        row = np.arange(len(m))
        rank = self.pairs.get(m[:, :-1], m[:, 1:])
        while len(m):
            if m.shape[1] == 1:
                best, value = None, np.full(len(m), NONE)
            else:
                best = rank.argmin(axis=1)
                value = rank[np.arange(len(m)), best]
            done = value == NONE
            if done.any():
                ended = m[done]
                real = ended >= 0
                yield row[done], ended[real], real.sum(axis=1)
                go = ~done
                m, row = m[go], row[go]
                if not len(m):
                    return
                rank, best, value = rank[go], best[go], value[go]
            every = np.arange(len(m))
            m[every, best] = value
            keep = np.ones(m.shape, bool)
            keep[every, best + 1] = False
            m = m[keep].reshape(len(m), -1)
            keep = np.ones(rank.shape, bool)
            keep[every, best] = False
            rank = rank[keep].reshape(len(m), -1)
            if m.shape[1] > 1:
                before = np.flatnonzero(best > 0)
                at = best[before] - 1
                rank[before, at] = self.pairs.get(m[before, at], m[before, at + 1])
                after = np.flatnonzero(best < m.shape[1] - 1)
                at = best[after]
                rank[after, at] = self.pairs.get(m[after, at], m[after, at + 1])

    def _heap(self, ids: list[int]) -> list[int]:
        """The same merges of one long piece, by a heap over a linked list."""
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        one = lambda a, b: int(self.pairs.get(np.array([a]), np.array([b]))[0])
        first = self.pairs.get(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        memo: dict[tuple[int, int], int] = {}
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = r, False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    key = (ids[x], ids[y])
                    got = memo.get(key)
                    if got is None:
                        got = memo[key] = one(*key)
                    if got != NONE:
                        heapq.heappush(heap, (got, x, *key))
        return [v for v, live in zip(ids, alive, strict=True) if live]

    # -- texts ---------------------------------------------------------------------------------------------------

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces; each distinct piece is merged once. A piece that is a token is that token."""
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        data, offsets = raw(coded.dictionary)
        ids, lengths = self.merge(data, offsets)
        starts = np.cumsum(lengths) - lengths
        whole = [(i, r) for i, p in enumerate(coded.dictionary.cast(pa.binary()).to_pylist()) if (r := self.rank.get(p)) is not None]
        if whole:
            at = np.array([i for i, _ in whole])
            ids[starts[at]] = [r for _, r in whole]
            lengths[at] = 1
        code = coded.indices.to_numpy()
        return gather(ids, starts[code], lengths[code]), lengths[code]

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.pattern.findall(t) for t in texts]
        ids, lengths = self.pieces([p for f in found for p in f])
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)])

    def spaced(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks with a space before each: the pattern runs over all at once."""
        found = self.pattern.findall(" " + " ".join(chunks))
        opens = np.fromiter((p[0] == " " for p in found), bool, len(found))
        if int(opens.sum()) != len(chunks):
            return self.texts([" " + c for c in chunks])
        ids, lengths = self.pieces(found)
        return ids, np.add.reduceat(lengths, np.flatnonzero(opens))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.fill_null("") if texts.null_count else texts
        return chunked(texts, self.memo, odd_spacing(texts), self.texts)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The bytes of each run of ids."""
        tokens = self.bytes_of.take(pa.array(ids))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), tokens), pa.scalar(b"", pa.binary()))

    def decimals(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), self.decimal.take(pa.array(ids))), " ")


_LOADED: dict[tuple[str, str], Ranks] = {}


def load(path: str, pattern: str) -> Ranks:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Ranks(path, pattern)
    return _LOADED[path, pattern]


def encode_texts(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids of a text column as array<int>, by the rank file at path; a column of that name is replaced."""
    ship(df.sparkSession)
    df = df.drop(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(path, pattern)
        for b in slices(batches, text):
            flat, offsets = own.encode(b.column(text))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))], names=[*b.schema.names, ids])

    return df.mapInArrow(run, df.withColumn(ids, F.lit(None).cast("array<int>")).schema)


def decode_ids(df: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "bytes") -> DataFrame:
    """df with the decoded bytes of a column of ids."""
    ship(df.sparkSession)
    df = df.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(path, pattern)
        for b in batches:
            lists = b.column(ids)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            got = own.decode(lists.flatten().to_numpy(), offsets - offsets[0])
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*b.schema.names, text])

    return df.mapInArrow(run, df.withColumn(text, F.lit(None).cast("binary")).schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by a space) and decoded_sha256 (of the decoded bytes)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(path, pattern)
        sha = lambda column: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column])
        for b in slices(batches, "text"):
            ids, offsets = own.encode(b.column("text"))
            columns = [b.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), sha(own.decimals(ids, offsets)), sha(own.decode(ids, offsets))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        rest(own.memo)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")



