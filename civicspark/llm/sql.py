"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: Words of a text: everything between ASCII white space.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
starts AS (
  SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 33, 1))) AS i FROM w)),
again AS (SELECT win FROM starts GROUP BY win HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, p
  FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM starts WHERE win IN (SELECT win FROM again))),
each AS (SELECT doc_id, words[p] AS word, p FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM w)),
kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) AS txt, count(*) AS n
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p WHERE g.p IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(txt, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""

NEAR_DEDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
reach(id, root) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT CASE WHEN l.x = r.id THEN l.y ELSE l.x END, r.root FROM reach r JOIN links l ON r.id = l.x OR r.id = l.y),
least AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN least ON id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

_PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
    "entropy": "[A-Za-z0-9+/_=-]{20,}",
}
#: A candidate without what is allowed in it.
_FREE = "m"
for _allowed in ("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "EXAMPLE|example|XXXXXX|xxxxxx|000000", "abcdefgh|ABCDEFGH|01234567"):
    _FREE = f"regexp_replace({_FREE}, '{_allowed}', ' ', 'g')"
_KEPT = {
    "assign": "length(v) >= 6",
    "access": "length(m) >= 20",
    "hex": "length(m) >= 24",
    "entropy": " OR ".join(
        f"""len(list_filter(regexp_extract_all({_FREE}, '{run}'), lambda r: NOT regexp_matches(regexp_replace(r, '[A-Z]?[a-z]{{2,}}|[A-Z]{{2,}}|[-+/_=]', ' ', 'g'), '^ *[0-9]{{0,4}} *$')
          AND list_max(list_transform(range(1, length(r) - 18), lambda i: list_aggregate(string_split(substring(r, i, 20), ''), 'entropy'))) >= {bits})) > 0"""
        for run, bits in (("[0-9A-Fa-f]{20,}", 2.90), ("[a-z0-9]{20,}", 3.40), ("[A-Z0-9]{20,}", 3.40), ("[A-Za-z0-9+/_=-]{20,}", 3.64))
    ),
}
_EACH = "\nUNION ALL\n".join(
    f"""SELECT doc_id, {i} AS k, '{kind}' AS kind, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e FROM (
      SELECT doc_id, m, v, sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
      FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{_PATTERNS[kind]}', 0)) AS m, unnest(regexp_extract_all(t, '{_PATTERNS[kind]}', {int(kind == "assign")})) AS v,
          unnest(string_split_regex(t, '{_PATTERNS[kind]}')[:len(regexp_extract_all(t, '{_PATTERNS[kind]}', 0))]) AS gap,
          unnest(range(len(regexp_extract_all(t, '{_PATTERNS[kind]}', 0)))) AS pos FROM d)
      WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE ({_KEPT[kind]})"""
    for i, kind in enumerate(_PATTERNS)
)
SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({_EACH}),
lists AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (kind <> 'entropy') AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN lists l ON l.doc_id = d.doc_id
"""

LINE_DEDUP = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line, regexp_extract_all(lines[i], '[^\x20\x09-\x0D]+') AS ws
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
big AS (SELECT doc_id, line, list_sort(list_distinct(ws)) AS k FROM l WHERE len(ws) > 0),
s AS (SELECT k, min(struct_pack(d := doc_id, l := line)) AS f, len(k) AS n FROM big GROUP BY k),
t AS (SELECT f, n, unnest(k) AS w FROM s),
later AS (
  SELECT DISTINCT f FROM (
    SELECT x.f AS f, y.f AS g FROM t x JOIN t y ON x.w = y.w AND y.f < x.f AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
    GROUP BY x.f, y.f, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*)))),
stay AS (SELECT f FROM s WHERE f NOT IN (SELECT f FROM later)),
gone AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS removed
  FROM big WHERE struct_pack(d := doc_id, l := line) NOT IN (SELECT f FROM stay) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE CAST(len(string_split(text, chr(10))) AS BIGINT) END AS n_lines,
  coalesce(n, 0) AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN gone g ON g.doc_id = d.doc_id
"""

#: CRC-32 of each distinct word: a table of 256 remainders, by eight steps each, then a step for each byte.
RESAMPLING = r"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce([b] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY b) AS t
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT doc_id, unnest(ws) AS w FROM d),
bw AS (SELECT unnest(ws) AS w FROM b),
bytes AS (
  SELECT w, list_transform(range(1, length(hex(encode(w))), 2), lambda i: CAST(16 * (strpos('0123456789ABCDEF', substr(hex(encode(w)), i, 1)) - 1) + strpos('0123456789ABCDEF', substr(hex(encode(w)), i + 1, 1)) - 1 AS BIGINT)) AS l
  FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
h AS (
  SELECT w, xor(list_reduce([CAST(4294967295 AS BIGINT)] || l, lambda c, x: xor(CAST(t[CAST(xor(c % 256, x) AS INTEGER) + 1] AS BIGINT), c // 256)), CAST(4294967295 AS BIGINT)) % 10000 AS bucket
  FROM bytes, tab),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN h USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN h USING (w) GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
v AS (SELECT doc_id, sum(gain) AS weight FROM dw JOIN h USING (w) JOIN g USING (bucket) GROUP BY doc_id),
o AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN v USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM o WHERE n_features >= 20)
SELECT o.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM r) THEN rank END AS rank
FROM o LEFT JOIN r USING (doc_id)
"""

SQL = {"op12_importance_resampling": RESAMPLING, "op9_line_dedup": LINE_DEDUP, "op1_secret_scans": SECRETS, "op8_minhash_near_dedup": NEAR_DEDUP, "op2_substring_dedup": SUBSTRING_DEDUP}
