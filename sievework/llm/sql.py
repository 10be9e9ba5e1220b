"""SQL that says the same as the p queries, for whole tables of a small size."""

from __future__ import annotations

_FOLD = "regexp_replace(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '\\.+$', '')"
_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"

P1 = f"""
WITH p AS (SELECT DISTINCT post_id, {_WORDS.format("coalesce(title, '')")} AS t, {_WORDS.format("coalesce(body, '')")} AS b FROM corpus WHERE post_id IS NOT NULL),
     w AS (SELECT post_id, t || b AS w FROM p WHERE len(b) >= 15),
     s AS (SELECT DISTINCT post_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM w, unnest(range(1, len(w) - 1)) r(i)),
     n AS (SELECT post_id, count(*) AS n FROM s GROUP BY post_id),
     c AS (SELECT a.post_id AS x, b.post_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.post_id < b.post_id GROUP BY ALL)
SELECT x AS post_a, y AS post_b FROM c JOIN n a ON a.post_id = x JOIN n b ON b.post_id = y WHERE 3 * k >= a.n + b.n
"""

P2 = """
WITH e AS (SELECT DISTINCT post_id, embedding::DOUBLE[] AS v FROM content_embeddings WHERE dimensions = 256 AND len(embedding) = 256 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
     u AS (SELECT post_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))::DOUBLE[256] AS v FROM e),
     d AS (SELECT a.post_id AS a, b.post_id AS b, 1 - array_inner_product(a.v, b.v) AS d FROM u a JOIN u b ON a.post_id <> b.post_id),
     r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(d, 12), b) AS r FROM d WHERE d <= 0.12 + 1e-9)
SELECT DISTINCT least(a, b) AS post_a, greatest(a, b) AS post_b FROM r WHERE r <= 5
"""

P3 = f"""
WITH RECURSIVE listed AS (SELECT DISTINCT {_FOLD.format("host")} AS host FROM shared_hosts WHERE host IS NOT NULL),
     rows AS (SELECT DISTINCT candidate_id, accounts, shared_domains FROM campaign_candidates),
     named AS (SELECT DISTINCT candidate_id, account FROM (SELECT candidate_id, unnest(accounts) AS account FROM rows) WHERE account IS NOT NULL),
     dom AS (SELECT DISTINCT candidate_id, {_FOLD.format("s.domain")} AS host FROM (SELECT candidate_id, unnest(shared_domains) AS s FROM rows) WHERE s.domain IS NOT NULL),
     pts AS (SELECT DISTINCT account, {_FOLD.format("p")} AS point FROM (SELECT account, unnest(contact_points) AS p FROM post_contacts) WHERE account IS NOT NULL AND p IS NOT NULL),
     k AS (SELECT account, 'row ' || candidate_id AS key FROM named
           UNION SELECT account, 'domain ' || host FROM named JOIN dom USING (candidate_id) WHERE host NOT IN (SELECT host FROM listed)
           UNION SELECT account, 'contact ' || point FROM pts WHERE NOT (contains(point, '@') AND regexp_extract(point, '[^@]*$') IN (SELECT host FROM listed))),
     tie AS (SELECT DISTINCT a.account AS x, b.account AS y FROM k a JOIN k b USING (key)),
     closure(x, y) AS (SELECT x, y FROM tie UNION SELECT c.x, t.y FROM closure c JOIN tie t ON c.y = t.x)
SELECT x AS account, min(y) AS group_account FROM closure GROUP BY x HAVING count(*) > 1
"""

P5 = """
WITH p AS (SELECT post_id, any_value(body) AS body FROM corpus WHERE post_id IS NOT NULL AND length(body) >= 160 GROUP BY post_id),
     w AS (SELECT post_id, i, substr(body, i + 1, 160) AS t FROM p, unnest(range(0, length(body) - 159)) r(i)),
     s AS (SELECT t FROM w GROUP BY t HAVING min(post_id) <> max(post_id)),
     h AS (SELECT post_id, i FROM w SEMI JOIN s USING (t)),
     g AS (SELECT post_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY post_id ORDER BY i) + 160 THEN 0 ELSE 1 END AS new FROM h),
     n AS (SELECT post_id, i, sum(new) OVER (PARTITION BY post_id ORDER BY i) AS run FROM g)
SELECT post_id, min(i) AS span_start, max(i) + 160 AS span_end FROM n GROUP BY post_id, run
"""

_P8 = f"""
WITH t AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
     r AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS run FROM t, unnest(range(1, len(w) - 6)) x(i)),
     a AS (SELECT doc_id, i FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, run ORDER BY i) > 1),
     m AS (SELECT doc_id, count(DISTINCT i + k) AS repeated FROM a, unnest(range(8)) y(k) GROUP BY doc_id),
     s AS (SELECT doc_id, len(w) AS words, coalesce(repeated, 0) AS repeated, CASE WHEN len(w) > 0 THEN coalesce(repeated, 0) / len(w) ELSE 0.0 END AS share FROM t LEFT JOIN m USING (doc_id))
"""
P8_FOUND = _P8 + "SELECT doc_id FROM s WHERE words > 0 AND share >= 0.3 - 1e-12"
P8_SHARES = _P8 + "SELECT doc_id, words, repeated, share FROM s"
P5_SHARES = P5.replace("WITH p AS", "WITH found AS (WITH p AS", 1) + """), b AS (SELECT post_id, max(coalesce(length(body), 0)) AS characters FROM corpus WHERE post_id IS NOT NULL GROUP BY post_id),
     f AS (SELECT post_id, CAST(sum(span_end - span_start) AS BIGINT) AS shared FROM found GROUP BY post_id)
SELECT post_id, characters, coalesce(shared, 0) AS shared_characters, CASE WHEN characters > 0 THEN coalesce(shared, 0) / characters ELSE 0.0 END AS share FROM b LEFT JOIN f USING (post_id)"""

P6_ROUND_TRIP = "SELECT doc_id, length(coalesce(text, '')) AS characters, true AS same FROM documents"

ALL = {"p6_round_trip": P6_ROUND_TRIP, "p1_found": P1, "p2_found": P2, "p3_found": P3, "p5_found": P5, "p5_shares": P5_SHARES, "p8_found": P8_FOUND, "p8_shares": P8_SHARES}
