"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

Bands and rows follow from a target recall at the threshold (``plan_bands``). Texts are joined, not documents: copies are
one node with a count. Texts that share a band hash (a bucket) are linked to the least of them, never to each other, and the
connected components of these links are groups. A group is verified whole: its n-gram sets are compared block by block by
counting common n-grams in matrix products; or, where that sends fewer rows (of a long chain of texts, say), bucket by bucket,
where a pair counts in the first band that it shares. So a text is sent no more often than there are blocks in its buckets. No
pair is ever a row.
Verified links are counted per text, and a spanning forest of them makes the classes.

Words are as in ``[^\\x20\\x09-\\x0D]+``, n-grams are held as 64-bit hashes. A text of fewer words than n has one n-gram: all
of its words.

Hot keys: copies of a text meet in partial aggregation; a text with very many copies, a bucket or a component with very many
texts is joined by a broadcast of its one row (``join_split``).

Defined cases: a null text is an empty one; texts without words have no n-gram, so their copies form a class and have no
links; equal rows are copies; a null doc_id takes part under a key made of its text; of rows with equal doc_id and
different texts each text is a node of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import join_split, mix, raw, ship, slices, stage, window_hashes, word_hashes, word_spans
from vellum.llm.components import connected_components

#: Texts, and n-grams, of a block in the comparison of a group.
BLOCK_TEXTS, BLOCK_GRAMS = 128, 1 << 19


#: Hash functions of a signature at most.
HASHES = 320


def plan_bands(threshold: float, recall: float, most: int = HASHES) -> tuple[int, int]:
    """Bands and rows such that a pair at the threshold shares a band with at least the given probability.

    Of all that do so within a number of hash functions, the one with the most rows: it has the fewest false candidates.
    """
    if threshold >= 1:
        return 1, most
    plans = [(math.ceil(math.log1p(-recall) / math.log1p(-(threshold**rows))), rows) for rows in range(1, 33)]
    return max((p for p in plans if p[0] * p[1] <= most), key=lambda p: p[1], default=plans[0])


def gram_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted set of n-gram hashes of each text."""
    data, offsets = raw(column)
    starts, ends, before = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    grams = window_hashes(words, n)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(window_hashes(words[a:b], b - a, 7) if b > a else np.empty(0, np.uint64))
    return out


def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(5))
    return (rng.integers(1, 1 << 32, k, dtype=np.uint64) | 1).astype(np.uint32), rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32)


def band_hashes(grams: np.ndarray, a: np.ndarray, b: np.ndarray, bands: int) -> np.ndarray:
    """A hash of each band of the MinHash signature of a set."""
    low, high = (grams & np.uint64(0xFFFFFFFF)).astype(np.uint32), (grams >> np.uint64(32)).astype(np.uint32)
    signature = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(grams), 512):  # blocks that stay in cache
        value = low[at : at + 512] * a[:, None]
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x2C1B3C6D)
        value += high[at : at + 512] * b[:, None]
        np.minimum(signature, value.min(axis=1), out=signature)
    rows = signature.reshape(bands, -1).astype(np.uint64)
    out = np.arange(bands, dtype=np.uint64)
    for r in range(rows.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
    return out


def _signatures(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients(bands * rows)
        for batch in slices(batches, "text"):
            sets = gram_sets(batch.column("text"), n)
            held = pa.array([band_hashes(s, a, b, bands).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "h1", "h2")), held, pa.array([len(s) for s in sets], pa.int64())], names=["doc_id", "h1", "h2", "bands", "grams"])

    return run


def _sets(n: int):
    """The n-gram set of each text, once a task for equal rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            fresh = []
            for i, node in enumerate(batch.column("node").to_pylist()):
                if node not in seen:
                    seen.add(node)
                    fresh.append(i)
            batch = batch.take(pa.array(fresh, pa.int64()))
            held = pa.array([s.tobytes() for s in gram_sets(batch.column("text"), n)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("about"), held], names=["node", "about", "grams"])

    return run


def common_counts(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Common n-grams of each set of one list with each of the other (None: the same list), by matrix products."""
    sets = left + (right or [])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1  # n-grams of a single set count for no pair
    owner, column = owner[shared], column[shared]
    n, m = len(left), len(sets) if right is None else len(right)
    out = np.zeros((n, m if right is not None else n), np.int64)
    if not len(column):
        return out
    column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
    for low in range(0, int(column[-1]) + 1, 4096):
        part = slice(*np.searchsorted(column, [low, low + 4096]))
        dense = np.zeros((len(sets), min(4096, int(column[-1]) + 1 - low)), np.float32)
        dense[owner[part], column[part] - low] = 1
        other = dense if right is None else dense[n:]
        out += (dense[:n] @ other.T).astype(np.int64)
    return out


def _verify(threshold: float):
    """Rows come sorted by (part, i, j); a part's band is -1, or the one whose bucket it is, and pairs that share an earlier band
    are left out. Gives links and linked documents of each node, and edges of a spanning forest."""

    def compare(rows: pa.Table, i: int, j: int) -> pa.RecordBatch | None:
        node, at = np.unique(rows.column("node").to_numpy(), return_index=True)
        block, copies = rows.column("block").to_numpy()[at], rows.column("copies").to_numpy()[at]
        grams = rows.column("grams").combine_chunks()
        sets = [np.frombuffer(grams[int(x)].as_buffer(), "<u8") for x in at]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right) or (i == j and len(left) < 2):
            return None
        both = common_counts([sets[x] for x in left], None if i == j else [sets[x] for x in right])
        lengths = np.array([len(x) for x in sets])
        size = lengths[left][:, None] + lengths[right][None, :] - both
        linked = (both > 0) & (both >= threshold * size - 1e-9)
        if i == j:
            np.fill_diagonal(linked, False)
        band = rows.column("band")[0].as_py()
        if band > 0:
            held = rows.column("bands").combine_chunks()
            bands = np.stack([held[int(x)].values.to_numpy()[:band] for x in at])
            for k in range(band):  # an earlier band owns these pairs
                linked &= bands[left, k][:, None] != bands[right, k][None, :]
        links, docs = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        links[left], docs[left] = linked.sum(axis=1), linked @ copies[right]
        if i != j:
            links[right], docs[right] = linked.sum(axis=0), copies[left] @ linked
        parent = list(range(len(node)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        a, b = [], []
        for x in range(len(left)):
            for y in np.flatnonzero(linked[x]).tolist():
                p, q = root(int(left[x])), root(int(right[y]))
                if p != q:
                    parent[p] = q
                    a.append(int(node[left[x]]))
                    b.append(int(node[right[y]]))
        has = np.flatnonzero(links)
        if not len(has):
            return None
        zero = [0] * len(a)
        return pa.record_batch(
            [pa.array(node[has].tolist() + a, pa.int64()), pa.array([None] * len(has) + b, pa.int64()), pa.array(links[has].tolist() + zero, pa.int64()), pa.array(docs[has].tolist() + zero, pa.int64())],
            names=["a", "b", "links", "docs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(c).to_numpy() for c in ("part", "hash", "band", "i", "j")]
            changes = np.zeros(b.num_rows, bool)
            for k in keys:
                changes[1:] |= k[1:] != k[:-1]
            cuts = [0, *np.flatnonzero(changes).tolist(), b.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(int(k[low]) for k in keys)
                if key != now:
                    if held and (got := compare(pa.Table.from_batches(held), *now[3:])) is not None:
                        yield got
                    now, held = key, []
                held.append(b.slice(low, high - low))
        if held and (got := compare(pa.Table.from_batches(held), *now[3:])) is not None:
            yield got

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and two 64-bit hashes of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(11), text).alias("h2"))


def _blocks(n, grams):
    return F.greatest(F.ceil(F.col(n) / BLOCK_TEXTS), F.ceil(F.col(grams) / BLOCK_GRAMS)).cast("int")


def classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, whole: bool | None = None) -> DataFrame:
    """A row a distinct text: h1, h2, least (doc_id, of a null one h1), copies, n_links, n_linked_docs, class_id and is_first (of its class).

    whole: groups are verified whole, or by buckets (None: each by what sends fewer rows).
    """
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bands, rows = plan_bands(threshold, recall)
    src = keyed(docs)
    signed = src.mapInArrow(_signatures(n, bands, rows), "doc_id long, h1 long, h2 long, bands array<long>, grams long")
    texts = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("grams").alias("grams"))
    # numbered once, and written with the numbers
    texts = texts.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", F.col("least").alias("doc_id"), F.coalesce("least", "h1").alias("least"), "copies", "bands", "grams")
    texts = stage(texts, "texts")

    members = texts.where("bands is not null").select("node", F.posexplode("bands").alias("band", "hash"), "grams")
    per_bucket = members.groupBy("band", "hash").agg(F.min("node").alias("hub"), F.count("*").alias("n"), F.sum("grams").alias("w"))
    buckets = stage(per_bucket.where("n > 1"), "buckets")
    total = buckets.agg(F.sum("n")).first()[0] or 0
    stars = join_split(members.select("node", "band", "hash"), buckets.select("band", "hash", "hub", "n"), ["band", "hash"], "n", total)
    groups = connected_components(stars.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")))

    sized = groups.join(texts.select("node", "grams"), "node")
    sizes = sized.groupBy("component").agg(F.count("*").alias("n"), F.sum("grams").alias("w"))
    by_bucket = buckets.join(groups.withColumnRenamed("node", "hub"), "hub").groupBy("component").agg(F.sum(F.col("n") * _blocks("n", "w")).alias("sent"))
    is_whole = (F.col("n") * F.col("blocks") <= F.col("sent")) if whole is None else F.lit(whole)
    sizes = sizes.join(by_bucket, "component").withColumn("blocks", _blocks("n", "w")).select("component", "n", "blocks", is_whole.alias("whole"))
    n_grouped = groups.count()
    sized = stage(join_split(groups, sizes, ["component"], "n", n_grouped), "groups")

    # parts of the comparison: part, hash and band (-1: a whole group) with the blocks of each
    small = sized.where("whole")
    about = small.select("node", F.array(F.struct(F.col("component").alias("part"), F.lit(0).cast("long").alias("hash"), F.lit(-1).alias("band"), "blocks")).alias("parts"))
    large = sized.where("not whole").select("node")
    shared = buckets.select("band", "hash", "n", _blocks("n", "w").alias("blocks"))
    own = join_split(members.join(large, "node").select("node", "band", "hash"), shared, ["band", "hash"], "n", total)
    own = own.groupBy("node").agg(F.collect_list(F.struct(F.lit(-1).cast("long").alias("part"), "hash", "band", "blocks")).alias("parts"))
    about = stage(about.unionByName(own).join(texts.select("node", "h1", "h2", "doc_id", "copies", "bands"), "node"), "parts")
    send = about.select("h1", "h2", "doc_id", "node", F.struct("copies", "parts", F.when(F.col("parts")[0]["band"] >= 0, F.col("bands")).alias("bands")).alias("about"))
    # one row of each text, the one with the least doc_id; of rows equal to it each task sends one, and they are met again by node
    held = src.join(send, (src["h1"] == send["h1"]) & (src["h2"] == send["h2"]) & src["doc_id"].eqNullSafe(send["doc_id"])).select("node", "about", "text")
    kind = held.select("node", "about").withColumn("grams", F.lit(b"")).schema
    sets = held.mapInArrow(_sets(n), kind).select("node", "grams", F.explode("about.parts").alias("p"), "about.copies", "about.bands")
    sets = sets.select("p.part", "p.hash", "p.band", "p.blocks", "node", "copies", "grams", "bands")
    sets = sets.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["part", "hash", "band", "i", "j"]
    sets = sets.select("part", "hash", "band", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "node", "copies", "block", "grams", "bands")
    checked = sets.repartition(parts, *key).sortWithinPartitions(*key)
    verified = stage(checked.mapInArrow(_verify(threshold), "a long, b long, links long, docs long"), "links")

    links = verified.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"), F.sum("docs").alias("n_linked_docs"))
    found = connected_components(verified.where("b is not null").select("a", "b"))
    first = found.join(texts.select("node", "least", "h1", "h2"), "node").groupBy("component")
    first = first.agg(F.min(F.struct("least", "h1", "h2")).alias("first"), F.count("*").alias("n"))
    named = join_split(found, stage(first, "classes"), ["component"], "n", found.count()).drop("component")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = texts.select("h1", "h2", "node", "least", "copies").join(links, "node", "left").join(named, "node", "left")
    is_first = F.coalesce(F.col("first") == F.struct("least", "h1", "h2"), F.lit(True)).alias("is_first")
    return stage(out.select("h1", "h2", "least", "copies", zero("n_links"), zero("n_linked_docs"), F.coalesce("first.least", "least").alias("class_id"), is_first), "about")


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, whole: bool | None = None) -> DataFrame:
    """A row a document: doc_id, class_id, text_id, n_copies, n_links, n_linked_docs.

    class_id is the least doc_id of the documents connected by links; text_id the least of the copies of its text; n_links counts
    other texts of similarity threshold or more, n_linked_docs the documents that hold these.
    """
    about = classes(docs, n, threshold, recall, whole).withColumn("n_copies", F.col("copies")).drop("is_first")
    total = about.agg(F.sum("copies")).first()[0] or 0
    rows = join_split(keyed(docs).select("doc_id", "h1", "h2"), about, ["h1", "h2"], "copies", total)
    return rows.select("doc_id", "class_id", F.col("least").alias("text_id"), "n_copies", "n_links", "n_linked_docs")


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """One document of each class of texts: one with the least doc_id, and of its texts in the class the one with the least hash.

    Rows of one doc_id and different texts are judged each; of rows equal in both one stays.
    """
    columns = docs.columns
    keys = keyed(docs.select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(11), text).alias("h2"))
    rows = rows.withColumn("_id", F.coalesce("_id", "h1"))
    kept = classes(keys, n, threshold, recall).where("is_first").select(F.col("least").alias("_id"), "h1", "h2")
    first = F.row_number().over(Window.partitionBy("_id", "h1", "h2").orderBy(F.lit(0)))
    chosen = rows.join(kept, ["_id", "h1", "h2"]).withColumn("_n", first).where("_n = 1")
    return chosen.select(*[F.col("_row").getField(c).alias(c) for c in columns])
