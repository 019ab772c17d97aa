"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

OP11 = r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)
), turns AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), sized AS (
  SELECT conv_id, own, CAST(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
         lambda c, x: xor(c // 256, t[(xor(c, x) % 256) + 1])), 4294967295) % 6 AS BIGINT) AS h FROM turns, crc_table
), whole AS (
  SELECT s.conv_id, list_concat(coalesce(list_slice(b.own, 1, s.h), []), list_slice(s.own, s.h + 1, len(s.own))) AS seq
  FROM sized s LEFT JOIN turns b ON b.conv_id = s.conv_id - s.conv_id % 100
), path AS (
  SELECT conv_id, len(seq) = d AS is_end, d, list_slice(seq, 1, d) AS node FROM (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS d FROM whole)
), node AS (
  SELECT node, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256
  FROM path GROUP BY node
), child AS (
  SELECT list_slice(node, 1, depth - 1) AS node, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1
), full_node AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(n.node[depth].text) END AS own
  FROM node n LEFT JOIN child c ON c.node = n.node
), below AS (
  SELECT list_slice(node, 1, d) AS node, sum(own) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM full_node) GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
       CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_node n JOIN below b ON b.node = n.node LEFT JOIN node p ON n.depth > 0 AND p.node = list_slice(n.node, 1, n.depth - 1)
"""

OP13 = r"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS row_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), item AS (
  SELECT item_id, row_number() OVER () AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM benchmark
), total AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(terms)) AS BIGINT) AS words FROM doc WHERE len(terms) > 0
), posting AS (
  SELECT row_id, doc_id, n, term, count(*) AS tf
  FROM (SELECT row_id, doc_id, len(terms) AS n, unnest(terms) AS term FROM doc) GROUP BY ALL
), asked AS (
  SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(terms) AS term FROM item) GROUP BY ALL
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM posting, total GROUP BY term
), scored AS (
  SELECT item, item_id, row_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score
  FROM asked JOIN posting USING (term) JOIN weight USING (term), total GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST) AS place FROM scored WHERE score > 0
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 10
"""

SQL: dict[str, str] = {"op11_prefix_trie": OP11, "op13_lexical_search": OP13}
