"""The stages of the corpus pipeline on the smallest documents, each held against its operator's meaning."""

import re
from collections import Counter

import corpus_pipeline
import public_tokenizers as P
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, docs.collect()
    by_name = dict(corpus_pipeline.STAGES)

    kept = by_name["quality_rules"](spark, docs, SF)
    assert kept.columns == columns
    long = {r["doc_id"] for r in rows if len(WORDS.findall(r["text"])) >= 50}
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids <= long and len(ids) > 0.7 * len(rows)

    one = by_name["near_duplicates"](spark, kept, SF)
    left = one.collect()
    assert one.columns == columns and len({r["text"] for r in left}) == len(left)
    texts = {r["text"] for r in kept.collect()}
    assert 0.5 * len(texts) < len(left) <= len(texts)

    cut = by_name["substring_dedup"](spark, one, SF)
    assert cut.columns == columns
    count = Counter(tuple(w[i : i + 35]) for r in left for w in [WORDS.findall(r["text"])] for i in range(len(w) - 34))
    clean = {r["doc_id"]: r["text"] for r in left if not any(count[tuple(w[i : i + 35])] > 1 for w in [WORDS.findall(r["text"])] for i in range(len(w) - 34))}
    after = {r["doc_id"]: r for r in cut.collect()}
    assert set(after) == {r["doc_id"] for r in left} and all(after[i]["text"] == t for i, t in clean.items())
    assert all(r["n_chars"] == len(r["text"]) for i, r in after.items() if i not in clean)

    packed = by_name["packing"](spark, cut, SF).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert sum(r["length"] for r in packed) == sum(len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in after.values())


def test_run_and_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 100
    spark.read.parquet(f"{SF}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    with_line = F.concat(F.lit("our line of "), (F.col("doc_id") % 10).cast("string"), F.lit(" and more\n"), F.col("text"))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 4 > 0, with_line).otherwise(F.col("text"))).withColumn("source", F.lit("one"))
    by_name, words = dict(corpus_pipeline.STAGES), lambda r: WORDS.findall(r["text"] or "")

    rows = docs.collect()
    norm = lambda x: re.sub("[1-9]", "0", " ".join(WORDS.findall(x))).lower()
    lines = lambda r: [x for x in (r["text"] or "").split("\n") if WORDS.findall(x)]
    seen = Counter((s, x) for s, t in {(r["source"], r["text"]) for r in rows} for x in {norm(y) for y in (t or "").split("\n") if WORDS.findall(y)})
    hosts = Counter(s for s, _ in {(r["source"], r["text"]) for r in rows})
    want = []
    for r in rows:
        w = words(r)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        frequent = lambda x, r=r: bool(WORDS.findall(x)) and seen[r["source"], norm(x)] > max(20, 0.02 * hosts[r["source"]])
        gone = sum(len(WORDS.findall(x)) for x in lines(r) if frequent(x))
        if len(w) >= 50 and 2 * len(covered) <= len(w) and len(w) - gone >= 0.5 * len(w):
            text = "\n".join(x for x in r["text"].split("\n") if not frequent(x))
            want.append(tuple((r.asDict() | ({"text": text, "n_chars": len(text)} if gone else {})).values()))
    assert any(w[1] not in {r["text"] for r in rows} for w in want)
    kept = by_name["quality_rules"](spark, docs, SF)
    rows = kept.collect()
    assert Counter(map(tuple, rows)) == Counter(want)

    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for r in rows for w in [words(r)]]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if rows[a]["text"] == rows[b]["text"] or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                root = [root[b] if x == root[a] else x for x in root]
    least = {c: min(r["doc_id"] for r, x in zip(rows, root, strict=True) if x == c) for c in root}
    one = by_name["near_duplicates"](spark, kept, SF)
    want = [tuple(r) for r, x in zip(rows, root, strict=True) if r["doc_id"] == least[x]]
    rows = one.collect()
    assert Counter(map(tuple, rows)) == Counter(want)

    count = Counter(tuple(w[i : i + 35]) for r in rows for w in [words(r)] for i in range(len(w) - 34))
    want = {}
    for r in rows:
        w = words(r)
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want[r["doc_id"]] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else r["text"]
    cut = by_name["substring_dedup"](spark, one, SF).collect()
    assert {r["doc_id"]: r["text"] for r in cut} == want and len(cut) == len(want)
