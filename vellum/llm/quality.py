"""Quality rules with cross-document line frequency, with expressions only.

Base rules look at one document. The method's rule looks at all: a line's normal form (trimmed, lower case, digits as 0,
white space as one space) is hashed, the distinct documents that hold it are counted per host, and lines held by more than
``max(min_docs, share * documents of the host)`` are removed: ``cleaned_text`` is the text without them. A document that
is left with less than ``keep_share`` of its words by this is depleted and rejected. Copies of a text count once
(``copies_count_once``), or else a text that was copied often enough would lose all of its lines.

Rows of one frequent line never meet in one task: counts are pre-aggregated in each task. A host has fewer than
(lines a document) / share frequent lines, so their list is short; up to BROADCAST_LINES lines in all it is broadcast and
intersected with a document's lines by hash, and joined to the documents' lines under a salt beyond that.

Windows of three words are hashed to 64 bits and sorted with their position in one long (43 bits of hash, 20 of
position); documents with more windows, or whose 43 bits clash where 64 do not, are sorted as pairs instead.

Defined cases: a null text has no words (base_failed) and stays null in cleaned_text; a text without a frequent line is its
own cleaned_text; a null source is a host of its own; rows of equal doc_id, source
and text are judged alike, so all kept or all rejected; an empty table stays empty; extra columns are carried along,
those named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import stage

SPACES = r"[\x20\x09-\x0D]+"
SALTS = 16
HASH_BITS = 43  # with 20 bits of position and the sign a long
BROADCAST_LINES = 200_000
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VERDICT = ["base_failed", "n_line_words_removed", "kept", "cleaned_text"]


def words(text: Column) -> Column:
    """Maximal runs outside [\\x20\\x09-\\x0D]."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def _covered(starts: Column, size: int) -> Column:
    """Words covered by windows at sorted starts."""
    following = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.lit(2**31 - 1)))
    gaps = F.zip_with(starts, following, lambda a, b: F.least(b - a, F.lit(size)))
    return F.when(F.size(starts) == 0, 0).otherwise(F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g))


def base_features(rows: DataFrame) -> DataFrame:
    """rows(text, ...) with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    t = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = rows.withColumn("_w", words(t)).withColumn("_lines", lines)
    out = out.withColumn("n_words", F.size("_w").cast("long"))
    grams = F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    out = out.withColumn("_h", F.when(F.col("n_words") >= 3, grams).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("_distinct", F.size(F.array_distinct("_h")))

    short = F.transform("_h", lambda h: h.bitwiseAND(F.lit((1 << HASH_BITS) - 1)))
    out = out.withColumn("_short", F.when(F.size("_h") > F.col("_distinct"), short))
    fits = (F.size("_h") < (1 << 20)) & (F.size(F.array_distinct("_short")) == F.col("_distinct"))
    sorted_longs = F.sort_array(F.transform("_short", lambda h, i: F.shiftleft(h, 20).bitwiseOR(i.cast("long"))))
    out = out.withColumn("_longs", F.when(fits, sorted_longs))
    pairs = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_pairs", F.when(F.col("_short").isNotNull() & F.col("_longs").isNull(), pairs))

    def near(array: str, key):
        def keep(x, j):
            a = F.get(array, j - 1)
            b = F.get(array, j + 1)
            return F.coalesce(key(a) == key(x), F.lit(False)) | F.coalesce(key(b) == key(x), F.lit(False))

        return F.filter(array, keep)

    longs = F.transform(near("_longs", lambda x: F.shiftright(x, 20)), lambda x: x.bitwiseAND(F.lit((1 << 20) - 1)).cast("int"))
    paired = F.transform(near("_pairs", lambda x: x["h"]), lambda x: x["i"])
    out = out.withColumn("_starts", F.sort_array(F.coalesce(longs, paired, F.array().cast("array<int>"))))
    return out.select(
        *rows.columns,
        "n_words",
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("_starts"), 3).cast("long").alias("n_repeat_words"),
    )


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, "[1-9]", "0"), SPACES, " ")))


def _host() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def _line_hashes() -> Column:
    """Hashes of the distinct lines with a word."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(normal_line(x))))


def frequent_lines(docs: DataFrame, min_docs: int = 20, share: float = 0.02, copies_count_once: bool = True) -> DataFrame:
    """_host and _line of lines above the limit. copies_count_once: documents of a host with one text are one document."""
    texts = docs.select(_host().alias("_host"), "text")
    if copies_count_once:
        own = [F.xxhash64("text").alias("_text"), F.xxhash64(F.lit(11), "text").alias("_text2")]
        lines = texts.select("_host", *own, F.explode(_line_hashes()).alias("_line")).distinct()
        texts = texts.select("_host", *own).distinct()
    else:
        lines = texts.select("_host", F.explode(_line_hashes()).alias("_line"))
    counted = lines.groupBy("_host", "_line").agg(F.count("*").alias("_n")).where(F.col("_n") > min_docs)
    hosts = texts.groupBy("_host").agg(F.count("*").alias("_docs"))
    return counted.join(hosts, "_host").where(F.col("_n") > F.col("_docs") * share).select("_host", "_line")


def judge(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, min_docs: int = 20, share: float = 0.02, keep_share: float = 0.5, copies_count_once: bool = True) -> DataFrame:
    """docs with the base features, base_failed, n_line_words_removed, kept and cleaned_text."""
    docs = docs.drop(*FEATURES, *VERDICT)
    columns = docs.columns
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("_row"), "doc_id", "source", "text").withColumn("_host", _host())
    frequent = stage(frequent_lines(docs, min_docs, share, copies_count_once), "lines")
    if frequent.count() <= BROADCAST_LINES:
        by_host = F.broadcast(frequent.groupBy("_host").agg(F.collect_list("_line").alias("_frequent")))
        hit = F.when(F.col("_frequent").isNotNull(), F.array_intersect(_line_hashes(), "_frequent"))
        rows = rows.join(by_host, "_host", "left").withColumn("_hit", hit)
    else:
        rows = _hits_by_join(rows, frequent)
    rows = rows.withColumn("_hit", F.when(F.size("_hit") > 0, F.col("_hit")))
    gone = lambda x: F.array_contains("_hit", F.xxhash64(normal_line(x)))
    split = F.split("text", "\n")
    lost = F.aggregate(F.filter(split, gone), F.lit(0), lambda acc, x: acc + F.size(words(x)))
    left_over = F.array_join(F.filter(split, lambda x: ~gone(x)), "\n")
    rows = rows.withColumn("_removed", F.when(F.col("_hit").isNotNull(), lost).otherwise(0))
    rows = rows.withColumn("_cleaned", F.when(F.col("_hit").isNotNull(), left_over).otherwise(F.col("text")))
    out = base_features(rows)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.col("_removed")
    verdict = F.struct(
        *FEATURES,
        failed.alias("base_failed"),
        F.col("_removed").cast("long").alias("n_line_words_removed"),
        (~failed & (left >= keep_share * F.col("n_words"))).alias("kept"),
        F.col("_cleaned").alias("cleaned_text"),
    )
    # a generator keeps a filter on the verdict from being pushed down, which would copy the expressions many times over
    out = out.select("_row", F.explode(F.array(verdict)).alias("_v"))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in columns], "_v.*")


def _hits_by_join(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """rows with _hit, a document's frequent lines, by a salted join of the documents' lines with the frequent ones."""
    key = ["_doc", "_doc2"]
    rows = rows.withColumn("_doc", F.xxhash64("doc_id", "source", "text")).withColumn("_doc2", F.xxhash64(F.lit(11), "text", "doc_id"))
    lines = rows.select(*key, "_host", F.explode(_line_hashes()).alias("_line")).withColumn("_salt", F.pmod("_doc", F.lit(SALTS)).cast("int"))
    salted = frequent.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = lines.join(salted, ["_host", "_line", "_salt"]).groupBy(*key).agg(F.collect_set("_line").alias("_hit"))
    return rows.join(hits, key, "left").drop(*key)
