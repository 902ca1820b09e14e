"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

OP1 = """
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
),
s AS (
  SELECT DISTINCT rid, doc_id, unnest(CASE
    WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle
  FROM w
),
n AS (SELECT rid, count(*) AS size FROM s GROUP BY rid),
common AS (SELECT a.rid AS a, b.rid AS b, a.doc_id AS ia, b.doc_id AS ib, count(*) AS met FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT DISTINCT ia, ib FROM common JOIN n x ON x.rid = a JOIN n y ON y.rid = b
  WHERE 100 * met >= 80 * (x.size + y.size - met)
),
reach AS (SELECT DISTINCT doc_id AS node, doc_id AS seen FROM w WHERE doc_id IS NOT NULL UNION SELECT node, ib FROM reach JOIN links ON ia = seen),
least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT doc_id, CAST(coalesce(n.size, 0) AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM w LEFT JOIN n USING (rid) LEFT JOIN least ON node = doc_id
"""


def op10(damping: float = 0.85, least: float = 1e-15) -> str:
    """The rules, and the two walks: what restarts flows on, round by round, until nothing above `least` is on its way."""
    walks = ""
    for name, verdict, src, dst in (("t", "allow", "src", "dst"), ("d", "block", "dst", "src")):
        walks += f""",
{name}_share AS (SELECT {src} AS a, {dst} AS b, links / sum(links) OVER (PARTITION BY {src}) AS share FROM edges),
{name}_walk AS (
  SELECT host, pages / sum(pages) OVER () * (1 - {damping}) AS x FROM seeds WHERE by_rule = '{verdict}'
  UNION ALL
  SELECT b AS host, sum(x * share * {damping}) AS x FROM {name}_walk JOIN {name}_share ON a = host GROUP BY b HAVING sum(x * share * {damping}) > {least}
),
{name} AS (SELECT host, sum(x) AS score FROM {name}_walk GROUP BY host)"""
    return f"""
WITH RECURSIVE h AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(html, '') AS html
  FROM pages
),
j AS (
  SELECT page_id, host, path, html, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM h
),
k AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS by_rule FROM j),
seeds AS (SELECT host, by_rule, count(*) AS pages FROM k WHERE by_rule IS NOT NULL AND host <> '' GROUP BY ALL),
found AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']?\\s*(?:https?:)?//([^/?#"''\\s>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM k),
edges AS (SELECT src, dst, count(*) AS links FROM found WHERE src <> dst AND src <> '' GROUP BY ALL){walks}
SELECT page_id, k.host AS host, path, rule,
  coalesce(by_rule, CASE WHEN coalesce(d.score, 0) - coalesce(t.score, 0) > 0 THEN 'block' ELSE 'allow' END) AS verdict,
  by_rule IS NOT NULL AS ruled, round(coalesce(t.score, 0), 9) AS trust, round(coalesce(d.score, 0), 9) AS distrust
FROM k LEFT JOIN t ON t.host = k.host LEFT JOIN d ON d.host = k.host
"""


OP4 = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(q.w, c.w), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 50 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 5
"""


def op12(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The rounds written out: assign every part, replace entries by floored means, assign again."""
    steps = ""
    for i in range(rounds + 1):
        steps += f""",
a{i} AS (
  SELECT rid, p, arg_min(e, d * {entries} + e) AS e, min(d) AS d, any_value(w) AS w
  FROM (SELECT rid, p, w, e, list_sum(list_transform(list_zip(w, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN b{i} USING (p)) GROUP BY rid, p
)"""
        if i < rounds:
            steps += f""",
m{i} AS (
  SELECT p, e, list(v ORDER BY i) AS c
  FROM (SELECT p, e, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS v FROM (SELECT p, e, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM a{i}) GROUP BY p, e, i) GROUP BY p, e
),
b{i + 1} AS (SELECT p, e, coalesce(m{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN m{i} USING (p, e))"""
    return f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w, len(embedding) // {parts} AS size
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
x AS (SELECT rid, p, w[p * size + 1:(p + 1) * size] AS w FROM v, (SELECT unnest(range({parts})) AS p)),
b0 AS (SELECT p, rid AS e, w AS c FROM x WHERE rid < {entries}){steps},
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS digest FROM b{rounds}),
r AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} JOIN v USING (rid) GROUP BY rid, vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM r, h
"""


OP13 = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN d.doc_id > least THEN 'E' ELSE '' END AS fails
  FROM d JOIN f USING (t) LEFT JOIN l ON l.doc_id = d.doc_id
),
k AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails, contains(fails, own) AS failed, before <> '' AND regexp_matches(fails, '[' || before || '-]') AS gone
  FROM k, s
),
g AS (
  SELECT part, filter_order, step, any_value(own) AS own, sum(CASE WHEN NOT failed AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN failed AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failed AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN failed AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN failed AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM r GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM g
"""


OP11 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT rid, doc_id, t, string_split(t, chr(10)) AS lines FROM d),
l AS (SELECT rid, doc_id, t, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM s),
k AS (
  SELECT rid, doc_id, t, line, i,
    translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
),
common AS (SELECT key, true AS often FROM (SELECT DISTINCT key, doc_id, t FROM k WHERE key <> '') GROUP BY key HAVING count(*) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(often) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (often IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN common USING (key) GROUP BY rid
"""
