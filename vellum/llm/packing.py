"""Harmonic packing of documents into sequences of fixed capacity C.

A document longer than C gives its full sequences first. What is left of it, r tokens, belongs to the reciprocal-capacity class
k with C/(k+1) < r <= C/k, and every bin of class k takes k such documents whole. The space that is left in the bins is
filled to the last token: the longest documents are set aside as fillers, just enough of them for the space of
the bins made of the rest, and cut where a bin ends. So a document stays whole or is cut in few, long pieces, and there is no padding.
Every worker fills its own bins: none waits for another and nothing is shuffled. What is open at a worker's end is laid
end to end; its last, shorter sequence is split into lengths that are powers of two, which need no padding.

Defined cases: a null text is empty and gives the end id alone; a null doc_id is kept; equal rows are packed
each; an empty table gives no pieces; other columns are ignored; texts of any length are cut as they come.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import tokens
from vellum.llm.common import fixed_binary, gather, ship, slices

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


@dataclass
class Plan:
    """Bins over documents sorted by length, longest first: the first ``fillers`` are cut to fill them."""

    fillers: int
    whole: np.ndarray  # documents placed whole, bin after bin
    bin: np.ndarray  # their bins
    space: np.ndarray  # what they leave of each bin


def plan(lengths: np.ndarray, capacity: int) -> Plan:
    """The plan with the fewest fillers for lengths (1 to capacity, descending)."""
    n = len(lengths)
    k = capacity // lengths
    total = np.concatenate([[0], np.cumsum(lengths)])
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if n else np.empty(0, np.int64)
    last, each = np.append(first[1:], n), k[first]

    def classes(fillers: int) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of bins of each class of the documents after the fillers."""
        start = np.maximum(first, fillers)
        return start, np.maximum(last - start, 0) // each

    def is_enough(fillers: int) -> bool:
        start, bins = classes(fillers)
        return total[fillers] >= capacity * bins.sum() - (total[start + bins * each] - total[start]).sum()

    low, high = 0, n
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if is_enough(middle) else (middle + 1, high)
    while not is_enough(low):  # with all documents as fillers there is no bin to fill
        low += 1
    start, bins = classes(low)
    whole = gather(np.arange(n), start, bins * each)
    of = np.repeat(np.arange(int(bins.sum())), np.repeat(each, bins))
    held = np.bincount(of, weights=lengths[whole], minlength=int(bins.sum())).astype(np.int64)
    return Plan(low, whole, of, capacity - held)


def cut(lengths: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents laid end to end, cut at ends (ascending, up to their total at most): document, start in it, length, interval
    and start in that of each piece."""
    until = np.cumsum(lengths)
    limit = int(ends[-1]) if len(ends) else 0
    marks = np.unique(np.concatenate([[0], until[until < limit], ends]))
    begin, size = marks[:-1], np.diff(marks)
    doc, interval = np.searchsorted(until, begin, side="right"), np.searchsorted(ends, begin, side="right")
    opens = np.concatenate([[0], ends])[interval]
    return doc, begin - (until[doc] - lengths[doc]), size, interval, begin - opens


class Bins:
    """The bins of one worker; its sequences are numbered part * 2**40 + counter."""

    def __init__(self, capacity: int, part: int):
        if capacity < 1 or capacity & (capacity - 1):
            raise ValueError("the capacity must be a power of two")
        self.capacity, self.next = capacity, part << 40
        # documents that wait, or what is left of them: doc_id, start, length and doc_tokens, and their ids
        self.about = pa.record_batch([pa.array([], pa.int64())] * 4, names=["doc_id", "start", "length", "doc_tokens"])
        self.flat = np.empty(0, "<u4")

    def _pieces(self, doc, start, length, sequence, offset) -> pa.RecordBatch:
        """Rows of pieces of the waiting documents; start counts from what is left of the document."""
        size = self.about.column("length").to_numpy()
        held = gather(self.flat, (np.cumsum(size) - size)[doc] + start, length)
        at = pa.array(doc)
        columns = [self.about.column("doc_id").take(at), pa.array(self.about.column("start").to_numpy()[doc] + start), pa.array(length), self.about.column("doc_tokens").take(at)]
        columns += [pa.array(self.next + sequence), pa.array(offset), fixed_binary(held, np.concatenate([[0], np.cumsum(length)]))]
        return pa.record_batch([c.cast(pa.int64()) if i < 6 else c for i, c in enumerate(columns)], names=NAMES)

    def _keep(self, doc: np.ndarray, start: np.ndarray) -> None:
        """What still waits: these documents from start on."""
        size = self.about.column("length").to_numpy()
        at, left = pa.array(doc), size[doc] - start
        self.flat = gather(self.flat, (np.cumsum(size) - size)[doc] + start, left)
        columns = [self.about.column("doc_id").take(at), pa.array(self.about.column("start").to_numpy()[doc] + start), pa.array(left), self.about.column("doc_tokens").take(at)]
        self.about = pa.record_batch(columns, names=self.about.schema.names)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Packs documents with those that wait; what fills no bin waits on, less than a sequence a class."""
        lengths = np.diff(offsets)
        old, self.flat = self.about, np.concatenate([self.flat, ids])
        new = pa.record_batch([doc_ids, pa.array(np.zeros(len(lengths), np.int64)), pa.array(lengths), pa.array(lengths)], names=old.schema.names)
        self.about = pa.concat_batches([old, new])
        size = self.about.column("length").to_numpy()

        full = size // self.capacity
        doc = np.repeat(np.arange(len(size)), full)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)) * self.capacity
        if len(doc):
            yield self._pieces(doc, start, np.full(len(doc), self.capacity), np.arange(len(doc)), np.zeros(len(doc), np.int64))
            self.next += len(doc)
        rest = np.flatnonzero(size % self.capacity)
        self._keep(rest, full[rest] * self.capacity)

        size = self.about.column("length").to_numpy()
        order = np.argsort(-size, kind="stable")
        made = plan(size[order], self.capacity)
        if not len(made.space):
            return
        whole, fillers = order[made.whole], order[: made.fillers]
        before = np.cumsum(size[whole]) - size[whole]
        firsts = np.flatnonzero(np.concatenate([[True], made.bin[1:] != made.bin[:-1]]))
        offset = before - before[firsts][made.bin]
        doc, start, length, bins, inside = cut(size[fillers], np.cumsum(made.space))
        n = len(whole)
        yield self._pieces(
            np.concatenate([whole, fillers[doc]]),
            np.concatenate([np.zeros(n, np.int64), start]),
            np.concatenate([size[whole], length]),
            np.concatenate([made.bin, bins]),
            np.concatenate([offset, inside + self.capacity - made.space[bins]]),
        )
        self.next += len(made.space)
        used = np.zeros(len(size), np.int64)
        used[whole] = size[whole]
        np.add.at(used, fillers[doc], length)
        left = np.flatnonzero(used < size)
        self._keep(left, used[left])

    def close(self) -> Iterator[pa.RecordBatch]:
        """Full sequences of what waits, end to end; the rest in sequences whose lengths are powers of two."""
        size = self.about.column("length").to_numpy()
        total, out = int(size.sum()), []
        if not total:
            return
        out = [self.capacity] * (total // self.capacity) + [1 << b for b in range(self.capacity.bit_length() - 1, -1, -1) if total % self.capacity >> b & 1]
        yield self._pieces(*cut(size, np.cumsum(out)))
        self.next += len(out)
        self._keep(np.empty(0, np.int64), np.empty(0, np.int64))


def _pack(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, bins = tokens.load(tokens.WordLevel, path), Bins(capacity, TaskContext.get().partitionId())
        for batch in slices(batches, "text", tokens.SLICE):
            ids, offsets = lib.encode(batch.column("text"))
            ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
            yield from bins.add(batch.column("doc_id"), ids, offsets + np.arange(len(offsets)))
        yield from bins.close()
        tokens.rest(lib.memo)

    return run


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 4096, then=None, schema: str = PIECES) -> DataFrame:
    """Pieces of docs(doc_id, text): doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian uint32).

    The pieces of a sequence lie in it without gaps from offset 0. One pass over the input, no shuffle.
    then: a function of Arrow batches that the packing task applies to the pieces; schema: what it gives.
    """
    ship(docs.sparkSession)
    run = _pack(vocabulary, end_id, capacity)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow((lambda batches: then(run(batches))) if then else run, schema)


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces ids by their unsigned crc32."""
    for b in batches:
        crc = pa.array([zlib.crc32(x.as_buffer()) for x in b.column("ids")], pa.int64())
        yield pa.record_batch([*(b.column(c) for c in ("doc_id", "start", "length")), crc, *(b.column(c) for c in ("doc_tokens", "sequence_id", "offset"))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


DIGEST = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
