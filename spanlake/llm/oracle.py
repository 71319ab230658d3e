"""DuckDB twins of the queries that SQL can express."""

RULE_ROWS = "('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/')"
UP, DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _key(url: str) -> str:
    rest = f"substr({url}, strpos({url}, '://') + 3)"
    host = f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{UP}', '{DOWN}')"
    path = f"regexp_extract({rest}, '(?s)^[^/?#]*([^?#]*)', 1)"
    bare = f"regexp_replace(regexp_replace({path}, '\\.html?$', ''), '/+$', '')"
    query = f"regexp_extract(string_split({url}, '#')[1], '(?s)\\?(.*)$', 1)"
    kept = (f"array_to_string(list_filter(string_split({query}, '&'), "
            "lambda q: q <> '' AND NOT regexp_matches(q, '(?i)^(utm_[a-z]+|ref|gclid|fbclid)(=|$)')), '&')")
    return (f"CASE WHEN strpos({url}, '://') > 0 THEN regexp_replace({host}, '^(www|m)\\.', '') || {bare} || "
            f"CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END END")


URL_FILTER = f"""
WITH RECURSIVE rules(action, host, path) AS (VALUES {RULE_ROWS}),
base AS (SELECT row_number() OVER () AS rid, page_id, url, html,
  CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT rid, page_id, url, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UP}', '{DOWN}') AS host,
  regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path, {_key('url')} AS k FROM base),
hit AS (SELECT p.rid, r.action, r.host || r.path AS rule FROM parts p JOIN rules r
  ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  QUALIFY row_number() OVER (PARTITION BY p.rid ORDER BY length(r.host || r.path) DESC, r.action) = 1),
judged AS (SELECT p.*, h.action, h.rule FROM parts p LEFT JOIN hit h USING (rid)),
tags AS (SELECT k AS a, url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM parts WHERE k IS NOT NULL),
raw AS (SELECT a, url, CASE WHEN regexp_matches(tag, '(?is)\\srel\\s*=\\s*(?:["''][^"''>]*\\bcanonical\\b|canonical\\b)')
    THEN regexp_extract(tag, '(?is)\\shref\\s*=\\s*["'']?([^"''\\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)\\shttp-equiv\\s*=\\s*["'']?refresh\\b')
    THEN regexp_extract(tag, '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>;]+)', 1) END AS t FROM tags),
base_of AS (SELECT a, t, split_part(url, '://', 1) AS scheme, regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1) AS authority,
  regexp_extract(substr(url, strpos(url, '://') + 3), '(?s)^[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(t, '(?s)^([^?#]*)', 1) AS own, regexp_extract(t, '(?s)^[^?#]*(.*)$', 1) AS tail FROM raw WHERE t <> ''),
whole AS (SELECT *, regexp_replace(CASE WHEN starts_with(own, '/') THEN own ELSE regexp_extract(path, '(?s)^(.*)/[^/]*$', 1) || '/' || own END, '^/', '') AS w FROM base_of),
found AS (SELECT a, CASE WHEN starts_with(t, '#') THEN NULL WHEN starts_with(t, '//') THEN scheme || ':' || t
    WHEN regexp_matches(t, '(?s)^[A-Za-z][A-Za-z0-9+.-]*:') THEN CASE WHEN strpos(t, '://') > 0 THEN t END
    WHEN starts_with(t, '?') THEN scheme || '://' || authority || path || t
    ELSE scheme || '://' || authority || list_reduce(list_prepend('', string_split(w, '/')), lambda done, x:
      CASE WHEN x = '.' THEN done WHEN x = '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || x END) || tail END AS t FROM whole),
one AS (SELECT DISTINCT a, {_key('t')} AS b FROM found WHERE t IS NOT NULL),
edges AS (SELECT a, b FROM one WHERE b IS NOT NULL AND a <> b UNION SELECT b, a FROM one WHERE b IS NOT NULL AND a <> b),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
comp AS (SELECT a AS k, least(a, min(b)) AS c FROM reach GROUP BY a),
member AS (SELECT j.*, coalesce(comp.c, j.k) AS c FROM judged j LEFT JOIN comp ON j.k = comp.k),
bad AS (SELECT c FROM member WHERE c IS NOT NULL GROUP BY c HAVING bool_or(coalesce(action = 'block', false)) AND NOT bool_or(coalesce(action = 'allow', false)))
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN c IN (SELECT c FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM member
"""

COLLOCATIONS = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UP}', '{DOWN}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: list_slice(w, i, i + k - 1))) AS p
  FROM words CROSS JOIN range(1, 5) t(k)),
counted AS (SELECT lang, k, p, count(*) AS f FROM grams GROUP BY ALL HAVING k = 1 OR count(*) >= 30),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang),
cuts AS (SELECT c.lang, c.k, c.p, c.f, j, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.f) // (x.f + y.f))::BIGINT AS score
  FROM (SELECT lang, k, p, f, j, list_slice(p, 1, j) AS head, list_slice(p, j + 1, k) AS tail FROM counted CROSS JOIN range(1, 4) t(j) WHERE j < k) c
  JOIN counted x ON x.lang = c.lang AND x.p = c.head JOIN counted y ON y.lang = c.lang AND y.p = c.tail),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
parts AS (SELECT lang, f, list_slice(p, i, i + m - 1) AS part FROM counted CROSS JOIN range(1, 4) t(i) CROSS JOIN range(2, 4) u(m)
  WHERE k > m AND i + m - 1 <= k),
inside AS (SELECT DISTINCT b.lang, b.p FROM parts c JOIN counted b ON b.lang = c.lang AND b.p = c.part AND 100 * c.f >= 80 * b.f),
ranked AS (SELECT lang, array_to_string(p, ' ') AS phrase, f AS a, l, r, score,
  row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, array_to_string(p, ' ')) AS rank
  FROM lowest ANTI JOIN inside USING (lang, p))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

CRC_STEP = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
SPELLING = f"""
WITH RECURSIVE steps(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, {CRC_STEP} FROM steps WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (SELECT doc_id, translate(w, '{UP}', '{DOWN}') AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents)),
per AS (SELECT doc_id, w, count(*) AS m, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM runs GROUP BY ALL),
summed AS (SELECT w, m, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
  lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]), 4294967295::BIGINT), 4294967295) AS h FROM per CROSS JOIN crc),
made AS (SELECT m, CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word FROM summed),
words AS MATERIALIZED (SELECT word, sum(m)::BIGINT AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(m) >= 3),
less AS MATERIALIZED (SELECT DISTINCT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
shorter AS (SELECT DISTINCT l.word, l.n, v.word AS near, v.n AS near_n FROM less l JOIN words v ON v.word = l.d),
pairs AS (SELECT word, near, near_n FROM shorter UNION ALL SELECT near, word, n FROM shorter
  UNION ALL SELECT a.word, b.word, b.n FROM less a JOIN less b ON a.i = b.i AND a.d = b.d AND a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
told AS MATERIALIZED (SELECT w.word, CASE WHEN near_n >= 2 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near,
  CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at, form FROM told UNION ALL SELECT c.word, t.word, t.form FROM chain c JOIN told t ON t.word = c.form)
SELECT t.word, t.form, c.at AS root, t.n, t.n_near, t.form_n FROM told t JOIN chain c ON c.word = t.word AND c.form IS NULL
"""
