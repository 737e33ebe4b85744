"""DuckDB SQL of the training-data queries that SQL can express, over whole tables."""

from __future__ import annotations

_DAY = "CAST(DATE '2024-01-01' + CAST({n} AS INTEGER) AS DATE)"
_HOST = r"regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)"
_SEGMENT = r"regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1)"


def _day(n: str) -> str:
    return _DAY.format(n=n)


OP2 = rf"""
WITH own AS (SELECT page_id, url, {_day("page_id % 366")} AS fetched, CASE WHEN length({_HOST}) > 253 THEN '' ELSE coalesce({_HOST}, '') END AS host, coalesce({_SEGMENT}, '') AS segment,
  regexp_replace(regexp_replace(coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), ''), '/+', '/', 'g'), '^/|/$', '', 'g') AS path FROM pages),
hosts AS (SELECT host AS pattern, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS code FROM (SELECT DISTINCT host FROM own WHERE host <> '')),
domains AS (SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 6) AS BIGINT) AS code FROM (SELECT DISTINCT regexp_extract(host, '([^.]*\.[^.]*)$', 1) AS pattern FROM own) WHERE pattern <> ''),
prefixes AS (SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 6) AS BIGINT) AS code FROM (SELECT DISTINCT host || '/' || segment AS pattern FROM own WHERE host <> '' AND segment <> '')),
entries AS (
  SELECT pattern, 'add' AS action, {_day("code % 200")} AS since_day FROM hosts WHERE code % 3 = 0
  UNION ALL SELECT pattern, 'remove', {_day("code % 200 + 60")} FROM hosts WHERE code % 3 = 0
  UNION ALL SELECT pattern, 'add', {_day("code % 200 + 150")} FROM hosts WHERE code % 6 = 0
  UNION ALL SELECT pattern, 'add', {_day("100 + code % 50")} FROM domains
  UNION ALL SELECT pattern, 'remove', {_day("160 + code % 50")} FROM domains
  UNION ALL SELECT pattern, 'add', {_day("code % 300")} FROM prefixes WHERE code % 5 = 0),
by_day AS (SELECT pattern, since_day, min(action) AS action FROM entries GROUP BY 1, 2),
latest AS (
  SELECT c.page_id, c.url, c.fetched, e.pattern, arg_max(e.action, e.since_day) AS action
  FROM own c JOIN (SELECT *, split_part(pattern, '/', 1) AS domain, substr(pattern, length(split_part(pattern, '/', 1)) + 2) AS lead FROM by_day) e
    ON e.since_day <= c.fetched AND (c.host = e.domain OR ends_with(c.host, '.' || e.domain)) AND (e.lead = '' OR c.path = e.lead OR starts_with(c.path, e.lead || '/'))
  GROUP BY 1, 2, 3, 4),
active AS (SELECT page_id, url, fetched, arg_max(pattern, (length(pattern), pattern)) AS pattern FROM latest WHERE action = 'add' GROUP BY 1, 2, 3),
since AS (
  SELECT a.page_id, a.url, a.fetched, a.pattern, max(e.since_day) AS listed_since FROM active a
  JOIN (SELECT pattern, since_day, action, lag(action) OVER (PARTITION BY pattern ORDER BY since_day) AS was FROM by_day) e
    ON e.pattern = a.pattern AND e.since_day <= a.fetched AND e.action = 'add' AND (e.was IS NULL OR e.was = 'remove') GROUP BY 1, 2, 3, 4)
SELECT o.page_id, o.url, CAST(o.fetched AS VARCHAR) AS fetched, o.host, s.pattern IS NOT NULL AS blocked, s.pattern, CAST(s.listed_since AS VARCHAR) AS listed_since, CAST(count(*) AS BIGINT) AS copies
FROM own o LEFT JOIN since s ON s.page_id = o.page_id AND s.url = o.url AND s.fetched = o.fetched GROUP BY 1, 2, 3, 4, 5, 6, 7
"""

OP3 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + CASE WHEN role IN ('user', 'assistant', 'system') THEN length(role) ELSE 1 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) END + 2 + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) + 8) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

_URN = "'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12) || '>'"
_CRLF = "chr(13) || chr(10)"
_TEXT = r"regexp_replace(regexp_replace(regexp_replace(html || '<!----></script></style></head>', '(?is)<script[^<>]*>.*?</script>|<style[^<>]*>.*?</style>|<head[^<>]*>.*?</head>|<!--.*?-->', '', 'g'), '(?i)</?(?:p|br|div|h[1-6]|li|ul|ol|tr|td|th|table|article|nav|section|body|html)(?:[\s/][^<>]*)?>', chr(10), 'g'), '<[^<>]*>', '', 'g')"
for _entity, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _TEXT = f"replace({_TEXT}, '{_entity}', '{_char}')"
_TEXT = rf"trim(regexp_replace(regexp_replace({_TEXT}, '[ \t\r\f]*\n[ \t\r\f\n]*', chr(10), 'g'), '[ \t\r\f]+', ' ', 'g'), ' ' || chr(10))"

OP4 = rf"""
WITH src AS (
  SELECT page_id, url AS target_uri, coalesce(html, '') AS html, strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * CAST(page_id * 61 AS BIGINT), '%Y-%m-%dT%H:%M:%SZ') AS warc_date,
    {_URN.format(h="md5('response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, ''))")} AS refers_to, 'sha256:' || sha256(coalesce(html, '')) AS source_digest FROM pages),
derived AS (
  SELECT page_id, 'metadata' AS warc_type, {_URN.format(h="md5('metadata|' || refers_to)")} AS record_id, refers_to, target_uri, warc_date, source_digest, 'application/warc-fields' AS content_type,
    'title: ' || regexp_replace(coalesce(regexp_extract(html, '(?is)<title[^<>]*>(.*?)</title>', 1), ''), '\s+', ' ', 'g') || {_CRLF} || 'outlinks: ' || len(regexp_extract_all(html, '<[aA]\s')) || {_CRLF} || 'source-payload-length: ' || strlen(html) || {_CRLF}
      || 'source-http-headers: HTTP/1.1 200 OK | Content-Type: text/html; charset=utf-8 | Content-Length: ' || strlen(html) AS block FROM src
  UNION ALL
  SELECT page_id, 'conversion', {_URN.format(h="md5('conversion|' || refers_to)")}, refers_to, target_uri, warc_date, source_digest, 'text/plain; charset=utf-8', {_TEXT} FROM src)
SELECT page_id, warc_type, record_id, refers_to, target_uri, warc_date, source_digest, content_type, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length, block,
  sha256('WARC/1.1' || {_CRLF} || 'WARC-Type: ' || warc_type || {_CRLF} || 'WARC-Record-ID: ' || record_id || {_CRLF} || 'WARC-Refers-To: ' || refers_to || {_CRLF}
    || coalesce('WARC-Refers-To-Target-URI: ' || target_uri || {_CRLF}, '') || 'WARC-Refers-To-Date: ' || warc_date || {_CRLF} || coalesce('WARC-Target-URI: ' || target_uri || {_CRLF}, '')
    || 'WARC-Date: ' || warc_date || {_CRLF} || 'X-Source-Payload-Digest: ' || source_digest || {_CRLF} || 'WARC-Block-Digest: sha256:' || sha256(block) || {_CRLF}
    || 'Content-Type: ' || content_type || {_CRLF} || 'Content-Length: ' || strlen(block) || {_CRLF} || {_CRLF} || block) AS record_sha256
FROM derived
"""

#: Not by winnowing: every window of over 50 words, by its text, and the lines that lie in one seen earlier.
OP6 = r"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
every AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM raw),
lines AS (SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM every),
placed AS (SELECT doc_id, pos, line, n, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS stop FROM lines WHERE n > 0),
spans AS (
  SELECT doc_id, pos AS a, max(pos) OVER f AS b, sum(n) OVER f AS total, md5(string_agg(md5(line), '') OVER f) AS content FROM (SELECT *, stop - n AS start FROM placed)
  WINDOW f AS (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND 50 FOLLOWING)
  UNION
  SELECT doc_id, min(pos) OVER f, pos, sum(n) OVER f, md5(string_agg(md5(line), '') OVER f) FROM placed
  WINDOW f AS (PARTITION BY doc_id ORDER BY stop RANGE BETWEEN 50 PRECEDING AND CURRENT ROW)),
long AS (SELECT * FROM spans WHERE total > 50),
origin AS (SELECT content, min((doc_id, a)) AS first FROM long GROUP BY 1),
later AS (SELECT DISTINCT doc_id, a, b FROM long JOIN origin USING (content) WHERE (doc_id, a) <> first),
gone AS (SELECT DISTINCT e.doc_id, e.pos FROM every e JOIN later l ON l.doc_id = e.doc_id AND e.pos BETWEEN l.a AND l.b),
kept AS (SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.pos) AS text FROM every e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.pos = e.pos GROUP BY 1),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT r.doc_id, CAST(len(r.parts) AS INTEGER) AS n_lines, CAST(coalesce(g.n, 0) AS INTEGER) AS removed_lines,
  CAST(length(CASE WHEN r.text IS NOT NULL THEN coalesce(k.text, '') END) AS INTEGER) AS kept_chars, md5(CASE WHEN r.text IS NOT NULL THEN coalesce(k.text, '') END) AS kept_md5
FROM raw r LEFT JOIN kept k USING (doc_id) LEFT JOIN removed g USING (doc_id)
"""

OP7 = """
WITH codes AS (
  SELECT vec_id, CAST(sum(CASE WHEN x > 0 THEN CAST(1 AS HUGEINT) << i ELSE 0 END) AS HUGEINT) AS code
  FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) WHERE i < 64 GROUP BY 1),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, CAST(bit_count(xor(q.code, c.code)) AS INTEGER) AS distance FROM codes q JOIN codes c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM pairs)
SELECT query_id, neighbour_id, distance, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10
"""

#: Not by prefixes: all shared shingles are counted.
OP10 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(list_slice(words, i, i + 4), ' ') END AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN sizes z USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) m USING (doc_id)
"""


def _kmeans(rounds: int) -> str:
    """Brute force: all distances in every round."""
    near = """near{r} AS MATERIALIZED (
  SELECT vec_id, row_id, min((d, c)) AS best FROM (SELECT v.vec_id, v.row_id, m.c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM v JOIN mid{r} m ON m.pos = v.pos GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
    move = """mid{next} AS MATERIALIZED (
  SELECT m.c, m.pos, CASE WHEN t.n IS NULL THEN m.x ELSE (t.s - (((t.s % t.n) + t.n) % t.n)) // t.n END AS x FROM mid{r} m LEFT JOIN (
    SELECT near{r}.best[2] AS c, v.pos, sum(v.x) AS s, count(*) AS n FROM near{r} JOIN v USING (row_id) GROUP BY 1, 2) t ON t.c = m.c AND t.pos = m.pos)"""
    steps = [(near + ",\n" + move).format(r=r, next=r + 1) for r in range(rounds)]
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS row_id, vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS MATERIALIZED (SELECT row_id, vec_id, unnest(range(64)) AS pos, CAST(floor(1024 * CAST(unnest(embedding) AS DOUBLE)) AS HUGEINT) AS x FROM kept),
start AS (SELECT row_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM kept ORDER BY sha256('3:' || vec_id) LIMIT 8),
mid0 AS MATERIALIZED (SELECT c, pos, x FROM start JOIN v USING (row_id)),
{",\n".join(steps)},
{near.format(r=rounds)},
names AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM mid{rounds} GROUP BY 1)
SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, CAST(best[1] AS BIGINT) AS distance, CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia, CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM near{rounds} JOIN names ON c = best[2]
"""


OP11 = _kmeans(10)

#: All scores of every anchor.
OP13 = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
parts AS (SELECT vec_id, label, unnest(range(len(v))) AS pos, unnest(v) AS x FROM kept),
scores AS (
  SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS own, CAST(sum(a.x * o.x) AS BIGINT) AS score
  FROM parts a JOIN parts o ON a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id AND a.pos = o.pos GROUP BY 1, 2, 3),
positive AS (SELECT * FROM scores WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
negative AS (
  SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS rank, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positive p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.own AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_hard_negatives": OP13, "op11_centroid_clustering": OP11, "op2_url_list_asof": OP2, "op3_chat_formatting": OP3, "op4_warc_derivatives": OP4, "op6_line_dedup": OP6, "op7_hamming_top_k": OP7, "op10_ngram_jaccard_join": OP10}
