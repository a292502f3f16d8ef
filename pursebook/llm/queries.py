"""The numbered queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pursebook.llm.bpe import op4_byte_bpe
from pursebook.llm.decontaminate import op1_benchmark_decontamination
from pursebook.llm.exact_search import op12_exact_topk
from pursebook.llm.filter_audit import op11_filter_audit
from pursebook.llm.html_text import op2_html_extraction
from pursebook.llm.language import op9_language_id
from pursebook.llm.line_dedup import op8_line_dedup
from pursebook.llm.media import op3_media_columns
from pursebook.llm.near_dup import op7_minhash_near_dedup
from pursebook.llm.periodic import op13_periodic_runs
from pursebook.llm.quality import op6_quality_classifier
from pursebook.llm.toxicity import op10_toxicity
from pursebook.llm.warc import op5_warc

QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_html_extraction": op2_html_extraction,
    "op3_media_columns": op3_media_columns,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_warc": op5_warc,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_language_id": op9_language_id,
    "op10_toxicity": op10_toxicity,
    "op11_filter_audit": op11_filter_audit,
    "op12_exact_topk": op12_exact_topk,
    "op13_periodic_runs": op13_periodic_runs,
}

#: Words of the decontamination contract.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Words of the run and of the filter contract.
_PLAIN_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: crc32 of an id as text, byte by byte over a table of 256 remainders.
_CRC = """
     t AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) AS tab FROM range(256) AS x(n)),
     h AS (SELECT doc_id, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                  lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295) AS h FROM documents, t)"""

ORACLE_SQL = {
    "op1_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
     p AS (SELECT DISTINCT item_id, m, array_to_string(w[k:k + m - 1], ' ') AS s
           FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
     g AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m),
     h AS (SELECT doc_id, k, g.m, item_id FROM g JOIN p ON p.m = g.m AND p.s = array_to_string(w[k:k + g.m - 1], ' ')),
     c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS q FROM h) GROUP BY 1),
     n AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op5_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to,
       CAST(NULL AS VARCHAR) AS error
FROM f
""",
    "op8_line_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
     w AS (SELECT doc_id, k, l[k] || chr(10) || l[k + 1] || chr(10) || l[k + 2] AS s
           FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS k FROM d WHERE len(l) >= 3)),
     r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS n FROM w),
     g AS (SELECT DISTINCT doc_id, unnest(range(k, k + 3)) AS k FROM r WHERE n > 1),
     a AS (SELECT doc_id, k, l[k] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM d)),
     t AS (SELECT a.doc_id, count(g.k) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY a.k) FILTER (WHERE g.k IS NULL), '') AS kept
           FROM a LEFT JOIN g ON g.doc_id = a.doc_id AND g.k = a.k GROUP BY 1)
SELECT d.doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE len(l) END AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, sha256(kept) AS text_sha256
FROM d JOIN t USING (doc_id)
""",
    "op11_filter_audit": f"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_PLAIN_WORDS} AS w FROM documents),
     l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
     m AS (SELECT doc_id, part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
                + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
                + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM w),
     n AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
     f(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
     o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
     s AS (SELECT filter_order, step, bits[step] AS b, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS p FROM o, range(1, 6) AS r(step)),
     r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, b,
                  coalesce(sum(n) FILTER (WHERE mask & (p | b) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & p = 0 AND mask & b > 0), 0) AS removed,
                  coalesce(sum(n) FILTER (WHERE mask & p > 0 AND mask & b > 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = b), 0) AS unique_fails,
                  coalesce(sum(good) FILTER (WHERE mask & p = 0 AND mask & b > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & p = 0 AND mask & b > 0), 0) AS toxic_lost
           FROM n, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley FROM r
""",
    "op12_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op13_periodic_runs": f"""
WITH {_CRC[6:]},
     o AS (SELECT doc_id, h, h // 10 AS g, {_PLAIN_WORDS} AS w, len({_PLAIN_WORDS}) AS n FROM h),
     p AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM o WHERE h % 10 = 0 AND n > 0),
     d AS (SELECT doc_id, list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) AS w FROM p
           UNION ALL SELECT doc_id, w FROM o WHERE NOT (h % 10 = 0 AND n > 0)),
     x AS (SELECT doc_id, w[i + 1] AS x, i FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d)),
     e AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i),
     i AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e) GROUP BY doc_id, q, k),
     r AS (SELECT doc_id, s, m, min(q) AS q FROM i WHERE m >= 12 AND m >= 2 * q GROUP BY 1, 2, 3),
     c AS (SELECT doc_id, count(*) AS n_runs, arg_min([s, m, q], [-m, s, q]) AS top, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY 1),
     z AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + m)) AS i FROM r),
     k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM x ANTI JOIN z USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(top[1] AS BIGINT) AS start, CAST(top[2] AS BIGINT) AS length, CAST(top[3] AS BIGINT) AS period,
       CAST(1000 * top[2] // top[3] AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
""",
}
