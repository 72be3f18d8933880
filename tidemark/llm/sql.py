"""DuckDB twins of the corpus queries that SQL can express."""

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', '17', doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 15))::BIGINT AS key
  FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS turn FROM t),
v AS (SELECT *, CASE (turn - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM w),
f AS (SELECT *, (3 * source_size)::DOUBLE / weight AS fill FROM v),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0))::DOUBLE
                / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
      FROM f WINDOW b AS (ORDER BY fill, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT level AS common FROM l WHERE fill > level ORDER BY fill, turn LIMIT 1),
s AS (SELECT source, turn, source_size, CASE WHEN fill > level THEN weight * (SELECT common FROM c) ELSE (3 * source_size)::DOUBLE END AS target FROM l),
p AS (SELECT d.doc_id, d.size, s.turn, s.source_size, s.target,
             row_number() OVER o AS place, sum(d.size) OVER o AS upto
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
      WINDOW o AS (PARTITION BY s.turn ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)),
k AS (SELECT turn, place, size, target, e * source_size + upto AS upto FROM p, (VALUES (0), (1), (2)) AS x(e) WHERE size > 0),
g AS (SELECT turn, place, size, sum(size) OVER (ORDER BY upto::DOUBLE / target, turn, upto ROWS UNBOUNDED PRECEDING) AS running
      FROM k WHERE upto - size < target),
y AS (SELECT turn, place, sum(size)::BIGINT AS taken FROM g WHERE running <= (SELECT sum(size) FROM d) GROUP BY turn, place)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM p LEFT JOIN y USING (turn, place)
"""

OP5 = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT *, translate(trim(line, {BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND doc_id <> keeper AS dropped FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP6 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM n WINDOW g AS (PARTITION BY body)
"""

OP7 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT *, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p),
b AS (SELECT *, list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             1 + ((('0x' || substr(hex, 5 * (i // 4)::INT + 1, 5))::BIGINT >> (5 * (3 - i % 4))::INT) & 31)::INT, 1)) AS letters FROM h)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, array_to_string(letters, '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""

OP8 = r"""
WITH r(kind, turn, pattern) AS (VALUES
  ('assign', 0, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
  ('access', 1, 'AKIA[A-Z0-9]+'),
  ('hex', 2, '[0-9a-f]+')),
p AS (SELECT doc_id, kind, turn, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos
      FROM (SELECT doc_id, kind, turn, string_split(regexp_replace(coalesce(text, ''), '(' || pattern || ')', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS parts
            FROM documents, r)),
m AS (SELECT *, (sum(length(part)) OVER (PARTITION BY doc_id, kind ORDER BY pos))::BIGINT AS stop FROM p),
s AS (SELECT doc_id, kind, turn, stop - length(part) AS start, stop FROM m
      WHERE pos % 2 = 0 AND CASE kind WHEN 'access' THEN length(part) >= 20 WHEN 'hex' THEN length(part) >= 24
        ELSE length(regexp_extract(part, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6 END),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, turn) AS spans
      FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)
"""

OP11 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
             unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
           FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
g AS (SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))) AS phrase
      FROM w, range(1, 5) AS s(size)),
f AS (SELECT lang, phrase, size, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS words FROM f WHERE size > 1 AND a >= 30),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
x AS (SELECT k.lang, k.phrase, k.a, k.k, h.a AS l, t.a AS r, ((2000000::HUGEINT * k.a) // (h.a + t.a))::BIGINT AS score
      FROM k JOIN f h ON h.lang = k.lang AND h.phrase = array_to_string(words[1:k], ' ') JOIN f t ON t.lang = k.lang AND t.phrase = array_to_string(words[k + 1:], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM x),
i AS (SELECT lang, array_to_string(words[s:s + m - 1], ' ') AS phrase, max(a) AS longer FROM c, range(2, 4) AS sizes(m), range(1, 4) AS starts(s)
      WHERE m < size AND s + m - 1 <= size GROUP BY ALL),
r AS (SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
      FROM b LEFT JOIN i USING (lang, phrase) WHERE place = 1 AND coalesce(longer * 100 < a * 80, true))
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN n USING (lang) WHERE rank <= 2000
"""

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, sha256('42:' || doc_id) AS hex,
             regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
h AS (SELECT *, len(units) AS n, ('0x' || hex[1:8])::BIGINT AS h1, ('0x' || hex[9:16])::BIGINT AS h2, ('0x' || hex[17:24])::BIGINT AS h3, ('0x' || hex[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN body = '' OR regexp_matches(body, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(prefix || middle || suffix) AS restored_sha256
FROM p
"""
