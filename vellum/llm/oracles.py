"""The queries of this package in SQL for an outside engine, where SQL has them.

Tokenisers (1, 3, 9), random draws (4) have no SQL form; tests hold them against brute force.
"""

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35) t),
r AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM s JOIN r USING (g)),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM p ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE t AS (SELECT text, min(doc_id) AS node, count(*) AS copies FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) x GROUP BY text),
w AS (SELECT node, {_WORDS} AS w FROM t),
g AS (
    SELECT DISTINCT node, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT node, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5) x
    UNION SELECT node, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT node, count(*) AS n FROM g GROUP BY node),
p AS (SELECT a.node AS a, b.node AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.node <> b.node GROUP BY a.node, b.node),
l AS (SELECT a, b FROM p JOIN n x ON x.node = a JOIN n y ON y.node = b WHERE shared >= 0.8 * (x.n + y.n - shared) - 1e-9),
c AS (SELECT node, node AS reach FROM t UNION SELECT c.node, l.b FROM c JOIN l ON l.a = c.reach),
m AS (SELECT node, min(reach) AS class_id FROM c GROUP BY node),
k AS (SELECT a AS node, count(*) AS n_links, CAST(sum(copies) AS BIGINT) AS n_linked_docs FROM l JOIN t ON t.node = l.b GROUP BY a)
SELECT doc_id, class_id, t.node AS text_id, copies AS n_copies, coalesce(n_links, 0) AS n_links, coalesce(n_linked_docs, 0) AS n_linked_docs
FROM documents JOIN t ON t.text = coalesce(documents.text, '') JOIN m ON m.node = t.node LEFT JOIN k ON k.node = t.node
"""

TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM e q JOIN e c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

CHAT = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos,
             coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), 'start') AS before FROM c)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(24 + length(replace(replace(role, '\\', '\\\\'), '<|', '<\\|')) + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|'))) AS BIGINT) AS formatted_chars,
    min(pos) FILTER (WHERE before || ' ' || role NOT IN ('start system', 'start user', 'system user', 'user assistant', 'assistant user')) AS broken_turn
FROM o GROUP BY conv_id
"""

_ARTICLE = "regexp_extract(html, '(?s)<article>(.*)</article>', 1)"
_TEXT = f"regexp_replace(regexp_replace({_ARTICLE}, '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g')"
_PLAIN = f"replace(replace(replace(replace(replace({_TEXT}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"

#: What the method deduces, written out for the one form of page that the tables hold.
PAGES = f"SELECT page_id, url, text, length(text) AS n_chars FROM (SELECT page_id, url, trim(regexp_replace({_PLAIN}, '\\s+', ' ', 'g')) AS text FROM pages) t"

QUALITY = f"""
WITH d AS (SELECT doc_id, source, text, {_WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
t AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3) x),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM t JOIN (SELECT doc_id, g FROM t GROUP BY 1, 2 HAVING count(*) > 1) x USING (doc_id, g)) y GROUP BY doc_id),
l AS (SELECT doc_id, source, text, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
m AS (SELECT doc_id, source, text, pos, line AS own, len({_WORDS.replace("text", "line")}) AS n, trim(regexp_replace(translate(lower(translate(line, '123456789', '000000000')), chr(9) || chr(11) || chr(12) || chr(13), '    '), ' +', ' ', 'g')) AS line FROM l),
h AS (SELECT source, count(DISTINCT text) AS docs FROM documents GROUP BY source),
f AS (SELECT source, line FROM (SELECT source, line, count(DISTINCT text) AS n FROM m WHERE n > 0 GROUP BY 1, 2) x JOIN h USING (source) WHERE n > 20 AND n > docs * 0.02),
gone AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM m SEMI JOIN f USING (source, line) WHERE n > 0 GROUP BY doc_id),
stay AS (SELECT doc_id, string_agg(own, chr(10) ORDER BY pos) AS t FROM m LEFT JOIN (SELECT source, line, 1 AS hit FROM f) y USING (source, line) WHERE n = 0 OR hit IS NULL GROUP BY doc_id),
b AS (
    SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(list_filter(ls, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
        coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_line_words_removed,
        sha256(coalesce(stay.t, '')) AS cleaned_sha256
    FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id) LEFT JOIN stay USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND n_words - n_line_words_removed >= 0.5 * n_words AS kept FROM v
"""

ORACLES = {
    "op2_substring_dedup": SUBSTRINGS,
    "op5_jaccard_join": JACCARD,
    "op6_topk": TOPK,
    "op7_chat": CHAT,
    "op8_main_text": PAGES,
    "op10_quality": QUALITY,
}
