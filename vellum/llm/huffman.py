"""Token-id output as canonical length-limited Huffman code, in independent blocks with bit-offset checkpoints.

``write_ids`` tokenises documents, counts ids over all of them, and writes ``<path>/code`` (id, bits) and
``<path>/blocks``: Parquet files whose names ascend with doc_id, one row a block. A block holds whole documents:
``part, block, start`` (ids of the part before it), ``doc_ids``, ``doc_lengths``, ``payload`` (the bits, most
significant first) and ``checkpoints`` (bit offset of every CHECKPOINT-th id). A block needs only the code table to be
decoded, and all its checkpoints are decoded side by side by table look-up. ``read_ids`` reads the files back.

Defined cases: a null text is empty and has the end id only; a null doc_id sorts first; rows with equal doc_id are
ordered by text; an empty table gives no blocks; other columns are ignored; a long text makes a block of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import tokens
from vellum.llm.common import fixed_binary, ship, slices, stage

#: Ids in a block at most, but for one longer document; ids between two checkpoints.
BLOCK, CHECKPOINT = 1 << 16, 256

BLOCKS = "part int, block long, start long, n long, doc_ids binary, doc_nulls binary, doc_lengths binary, payload binary, checkpoints binary"


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most limit bits (package-merge); 0 for a symbol that does not occur.

    A single symbol gets one bit.
    """
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    weights, levels = leaf, []
    for _ in range(limit - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaf, pairs])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < len(leaf))
        weights = merged[rank]
    take, lengths = 2 * len(leaf) - 2, np.zeros(len(leaf), np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[:take] += 1
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then by symbol."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    codes = np.zeros(len(lengths), np.uint64)
    if len(order):
        top = int(size[-1])
        steps = np.left_shift(1, top - size)
        codes[order] = (np.cumsum(steps) - steps) >> (top - size)
    return codes


def left_codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code lengths and codes, shifted to the top of 64 bits."""
    size = lengths.astype(np.int64)
    return size, canonical(lengths) << (64 - np.maximum(size, 1)).astype(np.uint64)


def pack(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of the ids' codes (both from left_codes) and the bit offset of every CHECKPOINT-th id."""
    size = sizes[ids]
    ends = np.cumsum(size)
    at = ends - size
    value = codes[ids] >> (at & 31).astype(np.uint64)
    word = at >> 5
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    last = np.append(first[1:], len(ids)) - 1
    out = np.zeros(int(ends[-1] + 31 >> 5) + 2, np.uint32)
    out[word[first]] = np.add.reduceat(value >> np.uint64(32), first).astype(np.uint32)
    out[word[last] + 1] |= (value[last] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out.astype(">u4").tobytes()[: int(ends[-1] + 7 >> 3)], at[::CHECKPOINT].astype(np.uint32)


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For every value of the next bits: symbol << 5 | length."""
    codes, width = canonical(lengths), int(lengths.max(initial=1))
    table = np.zeros(1 << width, np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(codes[used] << (width - lengths[used]).astype(np.uint64), kind="stable")]
    repeat = np.left_shift(1, width - lengths[order].astype(np.int64))
    table[: int(repeat.sum())] = np.repeat((order.astype(np.uint32) << np.uint32(5)) | lengths[order].astype(np.uint32), repeat)
    return table, width


def unpack(blocks: list[tuple[bytes, np.ndarray, int]], table: np.ndarray, width: int) -> list[np.ndarray]:
    """The ids of blocks (payload, checkpoints, ids): each step reads one id at every checkpoint of all blocks."""
    data = np.frombuffer(b"".join(p + b"\0" * 8 for p, _, _ in blocks), np.uint8).astype(np.uint64)
    base = np.cumsum([0] + [len(p) + 8 for p, _, _ in blocks])[:-1] * 8
    at = np.concatenate([c.astype(np.int64) + b for (_, c, _), b in zip(blocks, base.tolist(), strict=True)])
    out = np.zeros((CHECKPOINT, len(at)), np.uint32)
    wide = (data[:-4] << np.uint64(32)) | (data[1:-3] << np.uint64(24)) | (data[2:-2] << np.uint64(16)) | (data[3:-1] << np.uint64(8)) | data[4:]
    mask, most = np.uint64((1 << width) - 1), len(wide) - 1
    for step in range(min(CHECKPOINT, max(n for _, _, n in blocks))):
        got = table[(wide[np.minimum(at >> 3, most)] >> (np.uint64(40 - width) - (at & 7).astype(np.uint64))) & mask]
        out[step] = got >> np.uint32(5)
        at += got & np.uint32(31)
    flat, lane, ids = np.ascontiguousarray(out.T).reshape(-1), 0, []
    for _, c, n in blocks:
        ids.append(flat[lane * CHECKPOINT : lane * CHECKPOINT + n])
        lane += len(c)
    return ids


def squeeze(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Ids between two stages, a row a document: low and high bytes apart, compressed; wider ids stay as 32 bits."""
    coder, out, cuts = zstandard.ZstdCompressor(level=1), [], offsets.tolist()
    if len(ids) and int(ids.max()) > 0xFFFF:
        wide = ids.astype("<u4")
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            out.append(b"4" + coder.compress(wide[a:b].tobytes()))
    else:
        low, high = (ids & 0xFF).astype(np.uint8), (ids >> 8).astype(np.uint8)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            out.append(b"2" + coder.compress(low[a:b].tobytes() + high[a:b].tobytes()))
    return pa.array(out, pa.binary())


def spread(held: pa.BinaryScalar, coder: zstandard.ZstdDecompressor) -> np.ndarray:
    data = held.as_buffer().to_pybytes()
    got = np.frombuffer(coder.decompress(data[1:]), np.uint8)
    if data[:1] == b"4":
        return got.view("<u4")
    half = len(got) // 2
    return got[:half] | (got[half:].astype(np.uint32) << np.uint32(8))


def _tokenise(path: str, end_id: int):
    """A row a document, and a last row that holds the task's count of every id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, total = tokens.load(tokens.ByteLevel, path), np.zeros(0, np.int64)
        names = ["doc_id", "tie", "ids", "counts"]
        for batch in slices(batches, "text", tokens.SLICE):
            ids, offsets = lib.encode(batch.column("text"))
            ids = np.insert(ids, offsets[1:], end_id)
            offsets = offsets + np.arange(len(offsets))
            got = np.bincount(ids, minlength=len(total))
            got[: len(total)] += total
            total = got
            yield pa.record_batch([batch.column("doc_id"), batch.column("tie"), squeeze(ids, offsets), pa.nulls(len(offsets) - 1, pa.binary())], names=names)
        held = zstandard.ZstdCompressor().compress(total.astype("<i8").tobytes())
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([held])], names=names)
        tokens.rest(lib.memo)

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for held in batch.column("counts").to_pylist():
            total = np.frombuffer(zstandard.ZstdDecompressor().decompress(held), "<i8")
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["id", "n"])


def _encode(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.release()
        (sizes, codes), part, coder = left_codes(lengths), TaskContext.get().partitionId(), zstandard.ZstdDecompressor()
        block = start = held = 0
        docs: list[tuple[int | None, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, start, held, docs
            ids = np.concatenate([x for _, x in docs])
            payload, checks = pack(ids, sizes, codes)
            row = [part, block, start, len(ids), np.array([d or 0 for d, _ in docs], "<i8").tobytes(), np.array([d is None for d, _ in docs], np.uint8).tobytes(), np.array([len(x) for _, x in docs], "<i8").tobytes(), payload, checks.tobytes()]
            block, start, held, docs = block + 1, start + len(ids), 0, []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5], strict=True)], names=["part", "block", "start", "n", "doc_ids", "doc_nulls", "doc_lengths", "payload", "checkpoints"])

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids = spread(ids, coder)
                if docs and held + len(ids) > BLOCK:
                    yield flush()
                docs.append((doc, ids))
                held += len(ids)
        if docs:
            yield flush()

    return run


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, limit: int = 18) -> None:
    """Tokenises docs(doc_id, text) and writes their ids to path, in ascending doc_id order."""
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    held = stage(src.mapInArrow(_tokenise(vocabulary, end_id), "doc_id long, tie long, ids binary, counts binary"), "ids")
    ids = held.where("ids IS NOT NULL").drop("counts")
    counts = held.where("counts IS NOT NULL").select("counts").mapInArrow(_count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    lengths = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.int64)
    lengths[counts["id"].to_numpy()] = counts["n"].to_numpy()
    lengths = code_lengths(lengths, limit)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, bits int").coalesce(1).write.parquet(f"{path}/code")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ids.rdd.getNumPartitions())
    ordered = ids.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.mapInArrow(_encode(lengths), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read_code(spark: SparkSession, path: str) -> np.ndarray:
    """Code lengths by id; as many rows as the vocabulary at most."""
    got = spark.read.parquet(f"{path}/code").toPandas()
    lengths = np.zeros(int(got["id"].max()) + 1 if len(got) else 1, np.uint8)
    lengths[got["id"].to_numpy()] = got["bits"].to_numpy()
    return lengths


def _decoded(batch: pa.RecordBatch, table: np.ndarray, width: int) -> Iterator[tuple[dict, np.ndarray]]:
    """Rows of blocks with their ids, some blocks at once."""
    at = 0
    while at < batch.num_rows:
        held, n = [], 0
        while at < batch.num_rows and (not held or n < 32 * BLOCK):
            held.append(batch.slice(at, 1).to_pylist()[0])
            n += held[-1]["n"]
            at += 1
        blocks = [(r["payload"], np.frombuffer(r["checkpoints"], np.uint32), r["n"]) for r in held]
        yield from zip(held, unpack(blocks, table, width), strict=True)


def _decode(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, width = decode_table(lengths)
        for batch in batches:
            for r, ids in _decoded(batch, table, width):
                size = np.frombuffer(r["doc_lengths"], "<i8")
                doc_ids, nulls = np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["doc_nulls"], np.uint8)
                ends = np.cumsum(size)
                yield pa.record_batch(
                    [pa.array(np.full(len(size), r["part"]), pa.int32()), pa.array(doc_ids, pa.int64(), mask=nulls.astype(bool)), pa.array(r["start"] + ends - size, pa.int64()), pa.array(size, pa.int64()), fixed_binary(ids, np.concatenate([[0], ends]))],
                    names=["part", "doc_id", "start_in_part", "n_tokens", "ids"],
                )

    return run


IDS = "doc_id long, start long, n_tokens long, ids binary"


def read_ids(spark: SparkSession, path: str, then=None, schema: str = IDS) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit), from the files.

    then: a function of Arrow batches that the decoding task applies to them; schema: what it gives.
    """
    ship(spark)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sizes = blocks.groupBy("part").agg(F.sum("n").alias("n")).toPandas().sort_values("part")  # a row a written file
    base = dict(zip(sizes["part"].tolist(), (sizes["n"].cumsum() - sizes["n"]).tolist(), strict=True))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _decode(lengths)(batches):
            start = pc.add(b.column("start_in_part"), pa.scalar(base[b.column("part")[0].as_py()], pa.int64()))
            yield pa.record_batch([b.column("doc_id"), start, b.column("n_tokens"), b.column("ids")], names=["doc_id", "start", "n_tokens", "ids"])

    lengths = read_code(spark, path)
    return blocks.mapInArrow((lambda batches: then(placed(batches))) if then else placed, schema)


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces ids by their unsigned crc32."""
    for b in batches:
        crc = pa.array([zlib.crc32(x.as_buffer()) for x in b.column("ids")], pa.int64())
        yield pa.record_batch([b.column("doc_id"), b.column("start"), b.column("n_tokens"), crc], names=["doc_id", "start", "n_tokens", "ids_crc32"])
