"""Removal of word windows that repeat anywhere in the corpus, with a count-min prefilter.

1. The texts are written once to the shared folder in chunks of some MB, so that both passes see the same chunks.
2. Each chunk sketches its window hashes: two rows of cells, many more than windows, of which it sends those it uses, as
   sorted gaps. The sketches are merged slice by slice, a slice of a row's cells a task, and a slice answers every chunk
   with a bit for each cell that the chunk sent: is it used more than once? A window's count is never above the
   smaller of its two cells, so none that repeats is lost. The sketch is never in one place: its cells grow with the input, and
   its share of windows let through by chance does not.
3. In the second pass a chunk meets its answers. Windows that both rows hold for repeated go on, with their place and over 100
   bits of two hashes made from two independent hashes of each word: they are grouped first in the task (a
   window found twice there needs no place any more: it is repeated) and then, in buckets by hash, over all tasks. So however
   often a window occurs, a task hands on one entry for it at most.
4. The places of repeated windows are gathered by document, joined to the texts, and the words they cover removed.

Defined cases: a null text has no words; rows with equal doc_id and text are separate places and lose the same words; a
null doc_id is a value like others; texts shorter than a window stay; an empty table stays empty; extra columns are
carried along, those named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import mix, raw, ship, slices, stage, window_hashes, word_hashes, word_spans

#: Cells of a row for each byte of text: about twelve for each window.
CELLS_PER_BYTE = 2
#: Bytes of text in a chunk, bytes of text whose windows one slice of a row counts, and bytes of text for each bucket and each task.
CHUNK_BYTES, SLICE_BYTES, BUCKET_BYTES, TASK_BYTES = 16 << 20, 48 << 20, 16 << 20, 256 << 20
#: Compression of a chunk's texts, which are written once and shuffled once.
LEVEL = 6
#: Windows after which a task hands on what it holds.
FLUSH = 2_000_000
#: Spans up to this size are broadcast to the texts; beyond, texts and spans are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: A window: its hash (h, of which a bucket's blob keeps 48 bits, and g), first word and document. A document is written as
#: task << 32 | number in the task, which compresses better than its key; KEY rows translate it.
ENTRY = np.dtype([("h", "<u8"), ("g", "<u4"), ("at", "<i4"), ("doc", "<i8")])
PLACE = np.dtype([("doc", "<i8"), ("at", "<i4")])
KEY = np.dtype([("doc", "<i8"), ("k1", "<i8"), ("k2", "<i8")])
KEPT = {"h": 6}  # bytes of a field that a blob keeps, from the lowest
RESULT = ["n_words", "n_removed", "kept_text"]


def windows(column: pa.Array, size: int, both: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """Two independent hashes (or the first alone), row and start word of every window of each text."""
    data, offsets = raw(column)
    starts, ends, before = word_spans(data, offsets)
    row = np.repeat(np.arange(len(column), dtype=np.int32), np.diff(before))
    if len(starts) < size:
        none = np.empty(0, np.uint64)
        return none, none, row[:0], row[:0]
    inside = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :])
    row = row[inside]
    hashed = [window_hashes(word_hashes(data, starts, ends, seed), size, seed)[inside] for seed in ((1, 2) if both else (1,))]
    return hashed[0], hashed[1] if both else None, row, (inside - before[row]).astype(np.int32)


def all_windows(texts: pa.RecordBatch, size: int, both: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """windows() of a chunk's texts, of some MB at a time."""
    found, at = [], 0
    for part in slices(iter([texts]), "text"):
        h, g, row, start = windows(part.column("text"), size, both)
        found.append((h, g, row + np.int32(at), start))
        at += part.num_rows
    h, g, row, start = zip(*found, strict=True)
    return np.concatenate(h), np.concatenate(g) if both else None, np.concatenate(row), np.concatenate(start)


@dataclass(frozen=True)
class Sketch:
    """Two rows of ``cells`` cells, each cut in ``slices`` slices of ``width`` cells (numbered row by row)."""

    cells: int
    slices: int

    @property
    def width(self) -> int:
        return -(-self.cells // self.slices)

    def rows(self, h: np.ndarray) -> list[np.ndarray]:
        """The cell of each hash in both rows."""
        return [x % np.uint64(self.cells) for x in (h, mix(h ^ np.uint64(0x9E3779B97F4A7C15)))]

    def bounds(self, cells: np.ndarray) -> np.ndarray:
        """Where each slice begins in the sorted cells of a row; slices + 1 values."""
        return np.searchsorted(cells, np.arange(self.slices + 1, dtype=np.uint64) * np.uint64(self.width))


def _chunk(size: int):
    """Texts by chunks: key hashes and text of its rows as one compressed table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held, count, number = zstandard.ZstdCompressor(level=LEVEL), [], 0, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            nonlocal held, count, number
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, held[0].schema) as writer:
                for b in held:
                    writer.write_batch(b)
            row = pa.record_batch([pa.array([number], pa.int64()), pa.array([coder.compress(out.getvalue())], pa.binary())], names=["chunk", "data"])
            held, count, number = [], 0, number + 1
            return row

        for batch in slices(batches, "text", CHUNK_BYTES):
            more = batch.column("text").nbytes
            if held and count + more > CHUNK_BYTES:
                yield flush()
            held.append(batch)
            count += more
        if held:
            yield flush()

    return run


def _open(data: pa.Scalar, coder: zstandard.ZstdDecompressor) -> pa.RecordBatch:
    table = pa.ipc.open_stream(coder.decompress(data.as_buffer())).read_all()
    return table.combine_chunks().to_batches()[0]


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as four planes of bytes."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _sketch(size: int, sketch: Sketch):
    """The cells that a chunk uses, by slices: sorted, those used more than once in the chunk twice, as gaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, down = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for b in batches:
            for chunk, data in zip(b.column("chunk").to_pylist(), b.column("data"), strict=True):
                h = all_windows(_open(data, down), size, False)[0]
                out = []
                for row, cells in enumerate(sketch.rows(h) if len(h) else []):
                    cells.sort()
                    # the third and later use of a cell says no more than the second
                    keep = np.ones(len(cells), bool)
                    keep[2:] = cells[2:] != cells[:-2]
                    cells = cells[keep]
                    bounds = sketch.bounds(cells)
                    for s in np.flatnonzero(np.diff(bounds)).tolist():
                        own = (cells[bounds[s] : bounds[s + 1]] - np.uint64(s * sketch.width)).astype(np.uint32)
                        out.append((row * sketch.slices + s, up.compress(_planes(np.diff(own, prepend=np.uint32(0))))))
                if out:
                    number, held = zip(*out, strict=True)
                    yield pa.record_batch([pa.array(number, pa.int64()), pa.array([chunk] * len(out), pa.int64()), pa.array(held, pa.binary())], names=["slice", "chunk", "data"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the sketches of each slice; gives each chunk a bit for each of its distinct cells. Rows come sorted by slice."""
    up, down = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    now, chunks, held = None, [], []

    def done() -> pa.RecordBatch:
        cells = [np.cumsum(_numbers(down.decompress(x)), dtype=np.uint32) for x in held]
        merged = np.sort(np.concatenate(cells))
        again = np.append(np.unique(merged[1:][merged[1:] == merged[:-1]]), np.uint32(0xFFFFFFFF))
        out = []
        for chunk, own in zip(chunks, cells, strict=True):
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            hit = again[np.searchsorted(again, own)] == own
            if hit.any():
                out.append((chunk, up.compress(len(own).to_bytes(8, "little") + np.packbits(hit).tobytes())))
        to, bits = zip(*out, strict=True) if out else ((), ())
        return pa.record_batch([pa.array(to, pa.int64()), pa.array([now] * len(out), pa.int64()), pa.array(bits, pa.binary())], names=["chunk", "slice", "data"])

    for b in batches:
        for s, chunk, data in zip(b.column("slice").to_pylist(), b.column("chunk").to_pylist(), b.column("data").to_pylist(), strict=True):
            if s != now:
                if held:
                    yield done()
                now, chunks, held = s, [], []
            chunks.append(chunk)
            held.append(data)
    if held:
        yield done()


class _Chunk:
    """The windows of a chunk and what its answers say of their cells."""

    def __init__(self, texts: pa.RecordBatch, size: int, sketch: Sketch):
        self.texts, self.sketch = texts, sketch
        self.h, self.g, self.row, self.at = all_windows(texts, size)
        self.rows = []
        for cells in sketch.rows(self.h) if len(self.h) else []:
            own, inverse, count = np.unique(cells, return_inverse=True, return_counts=True)
            self.rows.append((sketch.bounds(own), inverse, count > 1))

    def hear(self, number: int, answer: bytes) -> None:
        row, s = divmod(number, self.sketch.slices)
        bounds, _, again = self.rows[row]
        low, high = int(bounds[s]), int(bounds[s + 1])
        if int.from_bytes(answer[:8], "little") != high - low:
            raise RuntimeError("a chunk's cells changed between the passes")
        again[low:high] |= np.unpackbits(np.frombuffer(answer[8:], np.uint8), count=high - low).astype(bool)

    def hits(self) -> np.ndarray:
        out = np.ones(len(self.h), bool)
        for _, inverse, again in self.rows:
            out &= again[inverse]
        return np.flatnonzero(out)


def _blob(values: np.ndarray, coder: zstandard.ZstdCompressor) -> bytes:
    """A structured array by byte columns, compressed."""
    columns = []
    for f in values.dtype.names:
        planes = np.ascontiguousarray(values[f]).view(np.uint8).reshape(len(values), -1).T
        columns.append(planes[: KEPT.get(f, len(planes))].tobytes())
    return coder.compress(b"".join(columns))


def _unblob(data: bytes, kind: np.dtype, coder: zstandard.ZstdDecompressor) -> np.ndarray:
    flat = np.frombuffer(coder.decompress(data), np.uint8)
    kept = {f: KEPT.get(f, kind[f].itemsize) for f in kind.names}
    n = len(flat) // sum(kept.values())
    out, at = np.empty(n, kind), 0
    for f, w in kept.items():
        planes = np.zeros((kind[f].itemsize, n), np.uint8)
        planes[:w] = flat[at : at + n * w].reshape(w, n)
        out[f] = np.ascontiguousarray(planes.T).view(kind[f]).reshape(-1)
        at += n * w
    return out


def _by_bucket(values: np.ndarray, bucket: np.ndarray, base: int, coder, mark: bytes = b"") -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    values, bucket = values[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(values) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield base + int(bucket[a]), mark + _blob(values[a:b], coder)


def _hash_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (doc.view(np.uint64) % np.uint64(buckets)).astype(np.int64)


def _rows(pairs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([k for k, _ in pairs], pa.int64()), pa.array([v for _, v in pairs], pa.binary())], names=["bucket", "held"])


def _candidates(size: int, sketch: Sketch, buckets: int):
    """Second pass: rows come sorted by chunk and slice, the chunk's texts (slice -1) before its answers. Buckets 0 to buckets - 1
    take entries by hash, the next as many (by document) take places of windows that are repeated here already (marked p) and the
    documents' keys (marked k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, down, held, count, keys = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor(), [], 0, []
        task, n_docs, now = TaskContext.get().partitionId() << 32, 0, None

        def flush() -> pa.RecordBatch:
            nonlocal held, count, keys
            e = np.concatenate(held)
            named = np.concatenate(keys)
            held, count, keys = [], 0, []
            e = e[np.lexsort((e["g"], e["h"]))]
            first = np.concatenate([[True], (e["h"][1:] != e["h"][:-1]) | (e["g"][1:] != e["g"][:-1])])
            group = np.cumsum(first) - 1
            here = np.bincount(group)[group] > 1
            places = np.empty(int(here.sum()), PLACE)
            places["doc"], places["at"] = e["doc"][here], e["at"][here]
            places = places[np.lexsort((places["at"], places["doc"]))]
            e = e[first]
            again = here[first]
            e["at"][again], e["doc"][again] = -1, 0
            e = e[np.lexsort((e["at"], e["doc"]))]
            out = list(_by_bucket(e, _hash_bucket(e["h"], buckets), 0, coder))
            out += _by_bucket(places, _doc_bucket(places["doc"], buckets), buckets, coder, b"p")
            return _rows(out + list(_by_bucket(named, _doc_bucket(named["doc"], buckets), buckets, coder, b"k")))

        def finish() -> None:
            nonlocal count, n_docs
            hit = now.hits()
            if len(hit):
                e = np.empty(len(hit), ENTRY)
                e["h"], e["g"], e["at"] = now.h[hit], (now.g[hit] >> np.uint64(32)).astype(np.uint32), now.at[hit]
                e["doc"] = task | (n_docs + now.row[hit].astype(np.int64))
                held.append(e)
                own = np.unique(now.row[hit])
                named = np.empty(len(own), KEY)
                named["doc"] = task | (n_docs + own.astype(np.int64))
                for k in ("k1", "k2"):
                    named[k] = now.texts.column(k).to_numpy()[own]
                keys.append(named)
                count += len(e)
            n_docs += now.texts.num_rows

        for b in batches:
            for s, data in zip(b.column("slice").to_pylist(), b.column("data"), strict=True):
                if s >= 0:
                    now.hear(s, down.decompress(data.as_buffer()))
                    continue
                if now is not None:
                    finish()
                if count >= FLUSH:
                    yield flush()
                now = _Chunk(_open(data, down), size, sketch)
        if now is not None:
            finish()
        if count:
            yield flush()

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Values of each bucket; rows come sorted by bucket."""
    now, held = None, []
    for b in batches:
        for k, v in zip(b.column("bucket").to_pylist(), b.column("held").to_pylist(), strict=True):
            if k != now and held:
                yield now, held
                held = []
            now = k
            held.append(v)
    if held:
        yield now, held


def _resolve(buckets: int):
    """Exact grouping of a hash bucket's entries; gives the places of repeated windows by document bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        down, up = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for bucket, held in _grouped(batches):
            if bucket >= buckets:
                yield _rows([(bucket, v) for v in held])
                continue
            e = np.concatenate([_unblob(v, ENTRY, down) for v in held])
            e = e[np.lexsort((e["g"], e["h"]))]
            first = np.concatenate([[True], (e["h"][1:] != e["h"][:-1]) | (e["g"][1:] != e["g"][:-1])])
            group = np.cumsum(first) - 1
            own = e["at"] >= 0
            repeated = (np.bincount(group) > 1) | (np.bincount(group, weights=~own) > 0)
            e = e[repeated[group] & own]
            places = np.empty(len(e), PLACE)
            places["doc"], places["at"] = e["doc"], e["at"]
            places = places[np.lexsort((places["at"], places["doc"]))]
            out = list(_by_bucket(places, _doc_bucket(places["doc"], buckets), buckets, up, b"p"))
            if out:
                yield _rows(out)

    return run


def _spans(size: int):
    """Merged word spans (start, end pairs) of each document of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        down = zstandard.ZstdDecompressor()
        for _, held in _grouped(batches):
            places = [_unblob(v[1:], PLACE, down) for v in held if v[:1] == b"p"]
            if not places:
                continue
            p = np.concatenate(places)
            names = np.concatenate([_unblob(v[1:], KEY, down) for v in held if v[:1] == b"k"])
            names = names[np.argsort(names["doc"], kind="stable")]
            p = p[np.lexsort((p["at"], p["doc"]))]
            fresh = np.concatenate([[True], p["doc"][1:] != p["doc"][:-1]])
            opens = fresh | np.concatenate([[True], p["at"][1:] > p["at"][:-1] + size])
            starts = np.flatnonzero(opens)
            ends = np.append(starts[1:], len(p)) - 1
            pair = np.stack([p["at"][starts], p["at"][ends] + size], axis=1).astype("<i4")
            docs = p["doc"][starts]
            cut = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
            own = names[np.searchsorted(names["doc"], docs[cut])]
            yield pa.record_batch([pa.array(own["k1"]), pa.array(own["k2"]), pa.array([x.tobytes() for x in np.split(pair, cut[1:])], pa.binary())], names=["k1", "k2", "spans"])

    return run


def candidates(docs: DataFrame, size: int = 35, cells: int | None = None) -> tuple[DataFrame, int, int]:
    """What the second pass hands on (bucket, held), the number of buckets and of tasks for them. cells: of each of the sketch's rows."""
    spark = docs.sparkSession
    ship(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // TASK_BYTES))
    buckets = max(2 * parts, int(total // BUCKET_BYTES))
    sketch = Sketch(int(cells or max(total * CELLS_PER_BYTE, 1 << 16)), max(parts, int(total // SLICE_BYTES)))
    if sketch.width >= 1 << 32:
        raise ValueError("a slice has 2**32 cells at most")
    has_windows = docs.where(F.octet_length("text") >= 2 * size - 1).select("k1", "k2", "text")
    chunks = stage(has_windows.mapInArrow(_chunk(size), "chunk long, data binary"), "chunks", "none")
    sent = chunks.mapInArrow(_sketch(size, sketch), "slice long, chunk long, data binary")
    answers = sent.repartition(parts, "slice").sortWithinPartitions("slice").mapInArrow(_answer, "chunk long, slice long, data binary")
    met = chunks.select("chunk", F.lit(-1).cast("long").alias("slice"), "data").union(answers).repartition(parts, "chunk").sortWithinPartitions("chunk", "slice")
    return met.mapInArrow(_candidates(size, sketch, buckets), "bucket long, held binary"), buckets, parts


def repeated_spans(docs: DataFrame, size: int = 35, cells: int | None = None) -> DataFrame:
    """k1 and k2 (of a doc_id and text, as below) and spans: word ranges (pairs of int32) that repeated windows cover."""
    found, buckets, parts = candidates(docs, size, cells)
    found = found.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_resolve(buckets), "bucket long, held binary")
    spans = found.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_spans(size), "k1 long, k2 long, spans binary")
    # equal rows have equal spans, perhaps from two buckets
    return stage(spans.groupBy("k1", "k2").agg(F.first("spans").alias("spans")), "spans")


def keyed(docs: DataFrame, *more) -> DataFrame:
    """text and two hashes of each row's doc_id and text."""
    return docs.select(*more, "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(11), "text", "doc_id").alias("k2"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "_text"):
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(b.column("_text"), b.column("_spans"), strict=True):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            n_words.append(len(words))
            if spans.is_valid:
                keep = np.ones(len(words), bool)
                for a, e in np.frombuffer(spans.as_buffer(), "<i4").reshape(-1, 2).tolist():
                    keep[a:e] = False
                words = list(compress(words, keep.tolist()))
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays([b.column("_row"), *made], names=["_row", *RESULT])


def remove_repeated(docs: DataFrame, size: int = 35, cells: int | None = None) -> DataFrame:
    """docs with n_words, n_removed and kept_text (the kept words joined by one space)."""
    docs = docs.drop(*RESULT)
    columns = docs.columns
    others = [c for c in columns if c != "text"]
    rows = keyed(docs, F.struct(*[docs[f"`{c}`"] for c in others]).alias("_row"))
    spans = repeated_spans(rows, size, cells).withColumnRenamed("spans", "_spans")
    total = spans.agg(F.sum(F.octet_length("_spans") + 40)).first()[0] or 0
    spans = F.broadcast(spans) if total <= BROADCAST_BYTES else spans
    joined = rows.join(spans, ["k1", "k2"], "left").select(F.struct("_row", "text").alias("_row"), F.col("text").alias("_text"), "_spans")
    schema = joined.select("_row").withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "kept_text": F.lit("")}).schema
    out = joined.mapInArrow(_cut, schema)
    field = lambda c: F.col("_row.text") if c == "text" else F.col("_row._row").getField(c)
    return out.select(*[field(c).alias(c) for c in columns], *RESULT)
