"""DuckDB SQL for those training-data queries that SQL can express."""

_WORDS = r"'[^\x20\x09-\x0D]+'"

JACCARD = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS x FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE a = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)"""

SUBSTRINGS = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d)),
m AS (SELECT x, min(doc_id) AS m FROM x GROUP BY x),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS j FROM x JOIN m USING (x) WHERE m < doc_id),
t AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS j FROM d),
k AS (SELECT t.doc_id, count(g.j) AS gone, string_agg(word, ' ' ORDER BY t.j) FILTER (WHERE g.j IS NULL) AS kept FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.j = t.j GROUP BY t.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

URLS = r"""WITH p AS (SELECT page_id, regexp_extract(CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END, '^([^?#]*)', 1) AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substring(rest, length(regexp_extract(rest, '^([^/]*)', 1)) + 1) AS path FROM p),
r AS (SELECT *, '.' || host AS h, CASE WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/' WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/' WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/' WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
  regexp_extract_all(replace(host || path, '/', '//'), '/(login|signin|signup|cart|checkout|casino|porn|xxx|search)(/|\.|$)', 1) AS tokens FROM q),
s AS (SELECT *, list_sort(list_transform(tokens, lambda t: lpad(length(t)::VARCHAR, 3, '0') || t), 'DESC')[1][4:] AS token FROM r)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN token END AS pattern, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN token IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict FROM s"""


#: CRC-32 of a decimal number, digit by digit and bit by bit.
_CRC = "xor(list_reduce([4294967295] || list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda z, y: xor(z >> 1, 3988292384 * (z & 1)))), 4294967295)"

TRIE = rf"""WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT *, {_CRC} % 6 AS h FROM (SELECT c, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS w FROM t GROUP BY c)),
r AS (SELECT a.c, coalesce(b.w[1:a.h], []) || a.w[a.h + 1:] AS w FROM s a LEFT JOIN s b ON b.c = a.c - a.c % 100),
m AS (SELECT c, len(w) AS size, d, w[1:d] AS p FROM (SELECT c, w, unnest(generate_series(0, len(w))) AS d FROM r)),
g AS (SELECT p, d, min(c) AS conv_id, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (size = d), '') AS ends FROM m GROUP BY p, d),
k AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS kids FROM g WHERE d > 0 GROUP BY ALL),
f AS (SELECT g.*, coalesce(kids, 0) AS kids, CASE WHEN g.d > 0 THEN (n - 1) * length(g.p[g.d].text) ELSE 0 END AS saved FROM g LEFT JOIN k ON k.d = g.d AND k.p = g.p),
u AS (SELECT p[1:d2] AS p, d2 AS d, sum(saved) AS saved, count_if(kids = 0) AS leaves FROM (SELECT *, unnest(generate_series(0, d)) AS d2 FROM f) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, q.conv_id AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, u.leaves AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN u ON u.d = f.d AND u.p = f.p LEFT JOIN g q ON q.d = f.d - 1 AND q.p = f.p[1:f.d - 1]"""

PHRASES = r"""WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
x AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM w WHERE len(w) > 0),
g AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS c FROM x, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT *, string_split(phrase, ' ') AS s FROM g WHERE c >= 30),
c AS (SELECT lang, phrase, c AS a, k, s, unnest(generate_series(1, k - 1)) AS cut FROM f WHERE k > 1),
d AS (SELECT c.lang, c.phrase, a, cut, l.c AS l, r.c AS r, (2000000::HUGEINT * a // (l.c + r.c))::BIGINT AS score FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.s[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.s[cut + 1:], ' ')),
b AS (SELECT lang, phrase, a, l, r, score FROM d QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
h AS (SELECT DISTINCT q.lang, p.phrase FROM f p JOIN f q ON p.lang = q.lang AND q.k > p.k AND p.k > 1 AND 100::HUGEINT * q.c >= 80::HUGEINT * p.c AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' '))
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank, b.phrase, a, l, r, n, score FROM b JOIN n ON n.lang = b.lang ANTI JOIN h ON h.lang = b.lang AND h.phrase = b.phrase QUALIFY rank <= 2000"""
