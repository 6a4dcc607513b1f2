"""The queries of the training-data operators and their SQL where SQL can say it."""

from __future__ import annotations

from larkspan.llm.fuzzy_lines import op6_fuzzy_lines
from larkspan.llm.minhash import op10_bbit_minhash
from larkspan.llm.packing import op2_slack_packing
from larkspan.llm.pii import op4_contextual_pii
from larkspan.llm.pivot_index import op3_pivot_search
from larkspan.llm.quality import op1_rule_ledger
from larkspan.llm.sharding import op5_ring_shards
from larkspan.llm.token_counts import op7_prefix_token_counts
from larkspan.llm.transducer import op8_piece_transducer
from larkspan.llm.warc import op9_archive_merge

QUERIES = {
    f.__name__: f
    for f in (
        op1_rule_ledger,
        op2_slack_packing,
        op3_pivot_search,
        op4_contextual_pii,
        op5_ring_shards,
        op6_fuzzy_lines,
        op7_prefix_token_counts,
        op8_piece_transducer,
        op9_archive_merge,
        op10_bbit_minhash,
    )
}

#: exact search over whole tables by brute force
OP3_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

#: measurements, failure bits and both verdicts of every text
OP1_SQL = """
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT row_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
lines AS (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM d),
counted AS (SELECT row_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY row_id),
each AS (SELECT row_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM words),
starts AS (SELECT row_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS d, lead(a, 4) OVER o AS e FROM each WINDOW o AS (PARTITION BY row_id ORDER BY i)),
windows AS (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, a, b, c, d, e) AS n FROM starts WHERE e IS NOT NULL),
repeated AS (SELECT row_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT row_id, unnest(range(i, i + 5)) AS j FROM windows WHERE n > 1) GROUP BY row_id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d JOIN words USING (row_id) LEFT JOIN counted USING (row_id) LEFT JOIN repeated USING (row_id)
), b AS (
  SELECT *, ((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (100 * n_symbols > 10 * word_chars)::INT
    + 8 * (100 * n_dup_lines > 60 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 40 * n_words)::INT)::BIGINT AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, fail_bits, '1' AS policy FROM b
"""

#: what reading the archives back must give
OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
x AS (SELECT page_id, octet_length(encode(html))::BIGINT AS n, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM x
"""

#: all pairs of distinct sets that share a shingle, and what can be reached over links
OP10_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN w ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END)) AS s FROM words
), kinds AS (SELECT min(doc_id) AS k, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
each AS (SELECT k, n, unnest(s) AS g FROM kinds),
pairs AS (SELECT a.k AS a, b.k AS b, a.n AS na, b.n AS nb, count(*) AS c FROM each a JOIN each b ON a.g = b.g AND a.k < b.k AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 80 * (na + nb - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT k, k AS to_ FROM kinds UNION SELECT r.k, e.b FROM reach r JOIN edges e ON e.a = r.to_),
comp AS (SELECT k, min(to_) AS component_id FROM reach GROUP BY k)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(comp.component_id, sets.doc_id) AS component_id, coalesce(comp.component_id, sets.doc_id) = sets.doc_id AS kept
FROM sets LEFT JOIN kinds ON kinds.s = sets.s LEFT JOIN comp ON comp.k = kinds.k
"""

ORACLE_SQL: dict[str, str] = {"op1_rule_ledger": OP1_SQL, "op3_pivot_search": OP3_SQL, "op9_archive_merge": OP9_SQL, "op10_bbit_minhash": OP10_SQL}
