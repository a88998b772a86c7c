"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, decontam, exact_dedup, html_extract, langid, line_dedup, ngram_join, packing, periodic_runs, pii, quality, token_counts, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": line_dedup.op1,
        "op2_html_text": html_extract.op2,
        "op3_language_id": langid.op3,
        "op4_exact_dedup": exact_dedup.op4,
        "op5_quality": quality.op5,
        "op6_warc": warc.op6,
        "op7_ngram_join": ngram_join.op7,
        "op8_pii": pii.op8,
        "op9_pack": packing.op9,
        "op10_decontaminate": decontam.op10,
        "op11_centroids": centroids.op11,
        "op12_token_counts": token_counts.op12,
        "op13_periodic_runs": periodic_runs.op13,
        # The operator of op9 on whole examples, under all three limits.
        "pack_conversations": packing.pack_conversations,
    }


#: Lines of whole texts: those that at least three documents hold stay only in the largest of them.
OP1 = r"""
WITH lines AS (
  SELECT doc_id, i, line, lower_az, length(lower_az) >= 20 AS long_line
  FROM (SELECT doc_id, i, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az
        FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
              FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)))
), often AS (
  SELECT lower_az, max(doc_id) AS last_doc FROM lines WHERE long_line GROUP BY lower_az HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.i, l.line, o.last_doc IS NOT NULL AND l.doc_id <> o.last_doc AS gone
  FROM lines l LEFT JOIN often o ON l.long_line AND l.lower_az = o.lower_az
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP4 = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
g AS (SELECT body, count(*) AS group_size, (min((-n, doc_id)))[2] AS keep_id FROM t GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM t JOIN g USING (body)
"""


#: Of equal large payloads the last page is the response.
OP6 = r"""
WITH t AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT body, max(page_id) AS last_page FROM t GROUP BY body)
SELECT page_id, n AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last_page THEN last_page END AS refers_to
FROM t JOIN g USING (body)
"""


#: All pairs of five-word shingle sets at a Jaccard similarity of 0.8 or more, and the components that they make.
OP7 = r"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), placed AS (
  SELECT doc_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t WHERE len(w) > 0
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5_number_lower(concat_ws(' ', x, lead(x, 1) OVER p, lead(x, 2) OVER p, lead(x, 3) OVER p, lead(x, 4) OVER p)) AS g
  FROM placed WINDOW p AS (PARTITION BY doc_id ORDER BY i) QUALIFY i = 1 OR i <= n - 4
), s AS MATERIALIZED (
  SELECT doc_id, count(*) AS n, sum(CAST(g AS HUGEINT)) AS h, min(g) AS low, max(g) AS high FROM shingles GROUP BY doc_id
), member AS MATERIALIZED (
  SELECT doc_id, min(doc_id) OVER c AS copy_of, count(*) OVER c AS copies, n FROM s WINDOW c AS (PARTITION BY n, h, low, high)
), each AS MATERIALIZED (
  SELECT doc_id AS k, n, copies, g FROM member JOIN shingles USING (doc_id) WHERE doc_id = copy_of
), pairs AS MATERIALIZED (
  SELECT a.k AS a, b.k AS b, any_value(a.copies) AS a_copies, any_value(b.copies) AS b_copies FROM each a JOIN each b ON a.g = b.g AND a.k < b.k AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  GROUP BY a.k, b.k, a.n, b.n HAVING 10 * count(*) >= 8 * (a.n + b.n - count(*))
), ways AS MATERIALIZED (SELECT a, b, b_copies AS copies FROM pairs UNION ALL SELECT b, a, a_copies FROM pairs
), walk AS (
  SELECT DISTINCT a AS root, a AS node FROM ways UNION SELECT w.root, p.b FROM walk w JOIN ways p ON p.a = w.node
), classes AS (SELECT root AS k, min(node) AS class_id FROM walk GROUP BY root
), sums AS (SELECT a AS k, count(*) AS n_texts, CAST(sum(copies) AS BIGINT) AS n_rows FROM ways GROUP BY a)
SELECT m.doc_id, coalesce(c.class_id, m.copy_of) AS class_id, m.copy_of, m.copies - 1 + coalesce(n_rows, 0) AS n_links, coalesce(n_texts, 0) AS n_texts
FROM member m LEFT JOIN classes c ON c.k = m.copy_of LEFT JOIN sums ON sums.k = m.copy_of
UNION ALL SELECT doc_id, doc_id, doc_id, 0, 0 FROM t WHERE len(w) = 0
"""

#: Every run of as many words as a benchmark window has, held against the windows.
OP10 = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS MATERIALIZED (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), phrases AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, md5_number_lower(array_to_string(w[i:i + 12], ' ')) AS h
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM phrases
), placed AS MATERIALIZED (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM docs
), grams AS (
  SELECT r, i, size, md5_number_lower(array_to_string(w[i:i + size - 1], ' ')) AS h
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs JOIN sizes ON len(w) >= size)
), hits AS MATERIALIZED (SELECT r, i, size, item_id FROM grams JOIN phrases USING (size, h)
), words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS k FROM hits) GROUP BY r
), found AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""




def op11_sql(rounds: int = 3) -> str:
    """Plain rounds of assignment and means: every vector against every centroid, component by component."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""d{k} AS MATERIALIZED (
  SELECT r, k, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{k} c USING (i) GROUP BY r, k
), a{k} AS MATERIALIZED (SELECT r, min_by(k, (d, k)) AS k, min(d) AS d FROM d{k} GROUP BY r)""")
        if k < rounds:
            steps.append(f"""m{k} AS (
  SELECT k, i, sum(v) AS s, count(*) AS n FROM a{k} JOIN x USING (r) GROUP BY k, i
), c{k + 1} AS MATERIALIZED (
  SELECT c.k, c.i, coalesce((s - ((s % n) + n) % n) // n, c.v) AS v FROM c{k} c LEFT JOIN m{k} m ON m.k = c.k AND m.i = c.i
)""")
    return f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = 64
), raw AS (SELECT r, vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM e
), x AS MATERIALIZED (
  SELECT r, vec_id, i, CAST(floor(64 * CAST(v AS DOUBLE)) AS BIGINT) AS v FROM raw QUALIFY count(*) FILTER (WHERE v IS NOT NULL AND isfinite(v)) OVER (PARTITION BY r) = 64
), seed AS (
  SELECT r, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, w) - 1 AS k FROM (SELECT r, vec_id, list(v ORDER BY i) AS w FROM x GROUP BY r, vec_id) QUALIFY k < 16
), c0 AS MATERIALIZED (SELECT k, i, v FROM seed JOIN x USING (r)
), {", ".join(steps)},
named AS (SELECT k, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN e USING (r) JOIN named USING (k)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1, "op4_exact_dedup": OP4, "op6_warc": OP6, "op7_ngram_join": OP7, "op10_decontaminate": OP10, "op11_centroids": op11_sql()}
