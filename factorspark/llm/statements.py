"""DuckDB SQL for the registered queries that SQL can express."""

# Case is spelt out: the SQL engine's case folding knows more than ASCII letters.
_KEYS = "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = f"({_KEYS})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
_DETECTORS = (("assign", _ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24),
              ("owned", "[A-Za-z0-9+/_=-]+", 0, 20))


def _found(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    value = f"regexp_extract_all(text, '{pattern}', {group})"
    return f"""
    SELECT number, doc_id, source, {order} AS ord, '{kind}' AS kind, gap, whole, value,
           sum(length(gap) + length(whole)) OVER (PARTITION BY number ORDER BY nth) AS stop, length(value) >= {least} AS holds
    FROM (SELECT number, doc_id, source, unnest(range(len(wholes))) AS nth, unnest(wholes) AS whole, unnest(vals) AS value,
                 unnest(gaps[1:len(wholes)]) AS gap
          FROM (SELECT number, doc_id, source, regexp_extract_all(text, '{pattern}') AS wholes, {value} AS vals,
                       string_split_regex(text, '{pattern}') AS gaps FROM docs))"""


SECRETS = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS number, doc_id, source, coalesce(text, '') AS text FROM documents),
hits AS ({" UNION ALL ".join(_found(i, *d) for i, d in enumerate(_DETECTORS))}),
placed AS MATERIALIZED (
    SELECT *, stop - length(whole) AS start,
           length(value) >= 16 AND regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]')
           AND len(list_distinct(string_split(value, ''))) >= 8
           AND NOT regexp_matches(value, '(?i)example|sample|placeholder|changeme|x{{6}}|0{{6}}|1234567') AS random
    FROM hits WHERE holds AND (ord < 3 OR (regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]')))),
candidates AS MATERIALIZED (
    SELECT * FROM placed p WHERE ord < 3 OR NOT EXISTS (
        SELECT 1 FROM placed b WHERE b.ord < 3 AND b.number = p.number AND b.start < p.stop AND b.stop > p.start)),
counted AS (
    SELECT value, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT (coalesce(source, chr(0)), coalesce(doc_id::VARCHAR, 'none'))) AS documents
    FROM candidates GROUP BY value),
owners AS (SELECT *, owners > 3 OR documents > 50 AS copied FROM counted),
spans AS (
    SELECT number, ord, start, kind || ':' || start || ':' || stop AS shown, random AND NOT copied AS live, copied, owners, documents
    FROM candidates JOIN owners USING (value) WHERE ord < 3 OR (random AND NOT copied)),
per_row AS (
    SELECT number, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
           string_agg(shown, ',' ORDER BY start, ord) FILTER (ord < 3) AS base, string_agg(shown, ',' ORDER BY start, ord) AS spans,
           count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied, max(owners) AS most_owners, max(documents) AS most_documents
    FROM spans GROUP BY number)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
       coalesce(most_owners, 0) AS most_owners, coalesce(most_documents, 0) AS most_documents
FROM docs LEFT JOIN per_row USING (number)
"""

def _usable(scale: int, more: str = "") -> str:
    """Rows with whole vectors, each with a number of its own."""
    return f"""
    SELECT row_number() OVER () AS number, *, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::HUGEINT) AS vector FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 {more}"""


def _limited(value: str) -> str:
    return f"least(greatest({value}, -9223372036854775808::HUGEINT), 9223372036854775807::HUGEINT)::BIGINT"


_PRODUCT = "coalesce(list_sum(list_transform(list_zip(q.vector, c.vector), lambda p: p[1] * p[2])), 0)::HUGEINT"

TOP_K = f"""
WITH rows AS MATERIALIZED ({_usable(1024)}),
scored AS (
    SELECT q.number, q.vec_id AS query_id, c.vec_id, {_PRODUCT} AS score
    FROM rows q JOIN rows c ON q.vec_id % 100 = 0 AND c.number <> q.number AND len(q.vector) = len(c.vector)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, {_limited("score")} AS score FROM ranked WHERE rank <= 10
"""

HARD_NEGATIVES = f"""
WITH given AS MATERIALIZED ({_usable(256, "AND label IS NOT NULL")}),
rows AS MATERIALIZED (
    SELECT number, vec_id, vector, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label FROM given),
scored AS MATERIALIZED (
    SELECT q.number, q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, {_PRODUCT} AS score
    FROM rows q JOIN rows c ON q.vec_id % 100 = 0 AND c.number <> q.number AND len(q.vector) = len(c.vector)),
positives AS MATERIALIZED (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY number ORDER BY score DESC, vec_id NULLS LAST) AS place FROM scored WHERE same)
    WHERE place <= 5),
ranked AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.number, p.place ORDER BY n.score DESC, n.vec_id NULLS LAST)::INTEGER AS rank
    FROM positives p JOIN scored n ON n.number = p.number AND NOT n.same
                                   AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, {_limited("positive_score")} AS positive_score, {_limited("negative_score")} AS negative_score
FROM ranked WHERE rank <= 5
"""


def _round(number: int) -> str:
    """Assignments to the centroids c<number>, then the centroids after them."""
    return f"""
a{number} AS MATERIALIZED ({_assigned(number)}),
s{number} AS (
    SELECT cluster, pos, sum(value) AS total, count(*) AS rows
    FROM (SELECT a.cluster, unnest(r.vector) AS value, unnest(range(64)) AS pos FROM a{number} a JOIN rows r USING (number)) GROUP BY cluster, pos),
n{number} AS (
    SELECT cluster, list((total - ((total % rows) + rows) % rows) // rows ORDER BY pos) AS vector FROM s{number} GROUP BY cluster),
c{number + 1} AS MATERIALIZED (
    SELECT c.cluster, coalesce(n.vector, c.vector) AS vector FROM c{number} c LEFT JOIN n{number} n USING (cluster)),"""


def _assigned(number: int) -> str:
    distance = "list_sum(list_transform(list_zip(r.vector, c.vector), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT"
    return f"""
    SELECT number, (best % 64)::INTEGER AS cluster, best // 64 AS distance
    FROM (SELECT r.number, min({distance} * 64 + c.cluster) AS best FROM rows r, c{number} c GROUP BY r.number)"""


CLUSTERS = f"""
WITH rows AS MATERIALIZED ({_usable(256, "AND len(embedding) = 64")}),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, embedding) - 1 AS cluster, vector
    FROM (SELECT * FROM rows ORDER BY sha256('2:' || vec_id) NULLS LAST, embedding LIMIT 40)),
{"".join(_round(i) for i in range(5))}
last AS MATERIALIZED ({_assigned(5)}),
inertias AS (SELECT cluster, sum(distance) AS inertia FROM last GROUP BY cluster),
hashes AS (SELECT cluster, sha256(array_to_string(list_transform(vector, lambda x: x::VARCHAR), ',')) AS hash FROM c5)
SELECT r.vec_id, l.cluster, {_limited("l.distance")} AS distance, {_limited("i.inertia")} AS cluster_inertia,
       {_limited("(SELECT sum(inertia) FROM inertias)")} AS inertia, h.hash AS centroid_sha256
FROM last l JOIN rows r USING (number) JOIN inertias i USING (cluster) JOIN hashes h USING (cluster)
"""
