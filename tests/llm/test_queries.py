"""The registered queries that no SQL can repeat, on the smallest documents, against the libraries."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from vellum.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def ids_of(rows, file, end):
    t = Tokenizer.from_file(P.path(file))
    return {r["doc_id"]: np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, end], "<u4") for r in rows}


def test_op1(spark, rows):
    want, start = [], 0
    for doc, ids in sorted(ids_of(rows, "byte_bpe_50k.json", 0).items()):
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r)[:4] for r in QUERIES["op1_huffman"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_op3(spark, rows):
    ids, sequences, seen = ids_of(rows, "word_bpe_49k.json", 2), defaultdict(list), defaultdict(list)
    for r in QUERIES["op3_packing"](spark, SF).collect():
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(own.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["doc_id"]].append((r["start"], r["length"]))
    for held, sizes in ((sequences, None), (seen, ids)):
        for k, parts in held.items():
            ends = np.cumsum([0] + [n for _, n in sorted(parts)])
            assert [a for a, _ in sorted(parts)] == ends[:-1].tolist()
            assert ends[-1] == len(sizes[k]) if sizes else ends[-1] <= 4096
    assert set(seen) == set(ids)
    assert sum(map(len, seen.values())) <= 1.6 * len(ids)  # few documents are cut
    total, full = sum(map(len, ids.values())), sum(sum(n for _, n in b) == 4096 for b in sequences.values())
    assert total - 4096 * full < 4096 * len({s >> 40 for s in sequences})


def test_op4(spark, rows):
    got = QUERIES["op4_sharding"](spark, SF).collect()
    size = lambda t: len((t or "").encode()) + 1
    want = Counter((r["doc_id"], size(r["text"]), zlib.crc32((r["text"] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
