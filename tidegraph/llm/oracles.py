"""DuckDB SQL for the operators that SQL can express."""

RULES = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS s,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT r, list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
win AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM t)),
twice AS (SELECT r, g FROM win GROUP BY ALL HAVING count(*) > 1),
hit AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest(range(i, i + 8)) AS p FROM win JOIN twice USING (r, g)) GROUP BY r),
adj AS (
  SELECT r, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n FROM t),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(s, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(s, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(hit.n, 0)::BIGINT AS n_repeat_words,
         len(l) AS n_lines, adj.n AS adjacent,
         length(regexp_replace(s, '[^A-Z]', '', 'g')) AS upper,
         length(regexp_replace(s, '[^A-Za-z]', '', 'g')) AS letters
  FROM t JOIN lines USING (r) LEFT JOIN hit USING (r) JOIN adj USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words
            OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines
            OR 100 * upper > 50 * greatest(letters, 1) OR 100 * adjacent > 25 * n_words
            OR word_chars > 20 * n_words OR word_chars < 2 * n_words) AS kept
FROM base
"""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 12))::BIGINT AS u
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight::DOUBLE, source) AS k,
         (SELECT sum(source_size) FROM s)::DOUBLE AS total FROM s),
steps AS (
  SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
         sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM o),
lv AS (
  SELECT arg_min((total - fixed) / free, k) AS level FROM steps
  WHERE 3 * source_size >= weight * ((total - fixed) / free)),
t AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, weight * coalesce(level, 0)::DOUBLE) AS target FROM s CROSS JOIN lv),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(least(round(target / source_size, 9), 3))::BIGINT ELSE 0 END AS whole FROM t),
run AS (
  SELECT doc_id, d.source, size, u, source_size, target, whole, target - whole * source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY u) AS upto
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
lim AS (
  SELECT source, coalesce(max(u) FILTER (rest > 0 AND size > 0 AND upto - size / 2.0 <= rest), -1) AS last FROM run GROUP BY source)
SELECT doc_id, run.source, size, source_size, target,
       whole + (whole < 3 AND size > 0 AND u <= last)::BIGINT AS n_copies,
       size * (whole + (whole < 3 AND size > 0 AND u <= last)::BIGINT) AS taken
FROM run JOIN lim ON run.source IS NOT DISTINCT FROM lim.source
"""

DECONTAMINATE = r"""
WITH norm AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM item WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM norm CROSS JOIN lens WHERE len(w) >= n)),
hit AS (SELECT r, i, dw.n, item FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(cov.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(cov.n, 0) > 0 AND 20 * coalesce(cov.n, 0) >= len(w) AS contaminated
FROM norm LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""

WARC = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""

JACCARD = r"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT r, g FROM (
    SELECT r, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)
    UNION ALL SELECT r, array_to_string(w, ' ') FROM t WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 5 * k >= 4 * (p.n + q.n - k)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
least_id AS (SELECT a AS r, min(doc_id) AS class_id FROM reach JOIN t ON t.r = b GROUP BY a),
deg AS (SELECT a AS r, count(*) AS n FROM e GROUP BY a)
SELECT doc_id, coalesce(least(class_id, doc_id), doc_id) AS class_id, coalesce(deg.n, 0)::BIGINT AS n_links
FROM t LEFT JOIN least_id USING (r) LEFT JOIN deg USING (r)
"""


def licenses() -> str:
    """The license scan from its fixed texts: postings joined to the words of every document."""
    from tidegraph.llm.op10_license import AGREE, ANCHORS, BASE, RARE, TEMPLATES, key_place

    values = ", ".join(f"({t}, '{label}', '{text}', '{key}', {key_place(text, key)})" for t, (label, text, key) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{phrase}', '{label}')" for phrase, label in BASE.items())
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
tmpl(t, label, body, phrase, ahead) AS (VALUES {values}),
tw AS (SELECT t, unnest(string_split(body, ' ')) AS word, unnest(range(len(string_split(body, ' ')))) AS p FROM tmpl),
df AS (SELECT word, count(DISTINCT r) AS n FROM places WHERE word IN (SELECT word FROM tw) GROUP BY word),
total AS (SELECT count(*) AS n FROM d),
wt AS (
  SELECT DISTINCT tw.word, coalesce(df.n, 0) AS seen, ln((total.n + 1.0::DOUBLE) / (coalesce(df.n, 0) + 1)) + 0.001::DOUBLE AS weight, total.n AS texts
  FROM tw CROSS JOIN total LEFT JOIN df ON df.word = tw.word),
held AS (
  SELECT t, word FROM (SELECT DISTINCT t, word FROM tw) JOIN wt USING (word)
  QUALIFY row_number() OVER (PARTITION BY t ORDER BY weight DESC, word) <= {ANCHORS} OR {RARE} * seen <= texts),
posts AS (
  SELECT t, p, tw.word, weight / sum(weight) OVER (PARTITION BY t) AS share FROM tw JOIN held USING (t, word) JOIN wt ON wt.word = tw.word),
begins AS (SELECT DISTINCT r, t, i - p AS s FROM places JOIN posts USING (word)),
stands AS (
  SELECT b.r, b.t, b.s FROM begins b JOIN tmpl USING (t) JOIN d USING (r)
  WHERE b.s + ahead >= 0 AND array_to_string(w[b.s + ahead + 1:b.s + ahead + len(string_split(phrase, ' '))], ' ') = phrase),
agree AS (
  SELECT st.r, st.t, st.s, sum(share) AS share FROM stands st JOIN posts USING (t) JOIN d ON d.r = st.r
  WHERE st.s + p >= 0 AND st.s + p < len(w) AND w[st.s + p + 1] = posts.word GROUP BY ALL HAVING sum(share) >= {AGREE} - 1e-9),
base(phrase, label) AS (VALUES {phrases}),
hits AS (
  SELECT r, label, i FROM (SELECT r, w, unnest(range(len(w))) AS i FROM d WHERE list_contains(w, 'license')) CROSS JOIN base
  WHERE array_to_string(w[i + 1:i + len(string_split(phrase, ' '))], ' ') = phrase),
b AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hits GROUP BY r),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM hits UNION ALL SELECT r, label FROM agree JOIN tmpl USING (t)) GROUP BY r),
g AS (SELECT r, max(share) AS share FROM agree GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
       round(greatest(least(coalesce(g.share, 0), 1), CASE WHEN b.n > 0 THEN 0.5 ELSE 0 END), 6)::DOUBLE AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN l USING (r) LEFT JOIN g USING (r)
"""


LICENSES = licenses()
