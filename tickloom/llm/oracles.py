"""DuckDB SQL for the queries of this subpackage that SQL can express.

The others cannot be: they need trained models (1, 8), XXH64 or CRC-32 (6, 2), match positions
and checksums over them (7), a tree walk (9), a tokeniser (10) or return an approximation (5).
"""

MIXING = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    coalesce(greatest(0.1::double, 1::double - 4::double * len(regexp_extract_all(text, '[^\p{L}\p{M}\s.,;:!?''"()-]')) / greatest(length(text), 1)), 0.1::double) AS w,
    md5('0:' || coalesce(doc_id::varchar, '')) AS m FROM documents),
k AS (SELECT doc_id, source, size, -ln((('0x' || m[1:8])::bigint * 1048576 + (('0x' || m[9:16])::bigint // 4096) + 0.5::double) / 4503599627370496::double) / greatest(w, 0.001::double) AS e FROM d),
s AS (SELECT source, sum(size)::bigint AS source_size FROM k GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS turn, 2.0::double * source_size AS cap FROM s),
t AS (SELECT *, CASE turn % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::double AS weight, 1.5::double * sum(source_size) OVER () AS total FROM n),
-- fill the most limited source first; what is left sets the level for the rest
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, turn) AS step FROM t),
f AS (SELECT 0::bigint AS step, (SELECT max(total) FROM o) AS rest, (SELECT sum(weight) FROM o) AS free, false AS done UNION ALL
  SELECT o.step, CASE WHEN o.cap / o.weight <= f.rest / f.free THEN f.rest - o.cap ELSE f.rest END, CASE WHEN o.cap / o.weight <= f.rest / f.free THEN f.free - o.weight ELSE f.free END, NOT o.cap / o.weight <= f.rest / f.free
  FROM f JOIN o ON o.step = f.step + 1 WHERE NOT f.done),
l AS (SELECT step, rest / free AS level FROM f WHERE done),
g AS (SELECT o.*, CASE WHEN l.step IS NULL OR o.step < l.step THEN cap ELSE least(cap, l.level * weight) END AS target FROM o LEFT JOIN l ON true),
r AS (SELECT doc_id, k.source, size, source_size, target, e, coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY e, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source),
x AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM r),
y AS (SELECT *, (whole + CASE WHEN start + size / 2 <= target - whole * source_size THEN 1 ELSE 0 END)::bigint AS epochs FROM x)
SELECT doc_id, size::bigint AS size, source_size, target, (epochs * size)::bigint AS taken, source, epochs FROM y
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = f"""
WITH iw AS (SELECT coalesce(item_id::varchar, '') AS item, {_WORDS} AS w FROM benchmark),
ix AS (SELECT DISTINCT item, n, array_to_string(w[a:a + n - 1], ' ') AS grams FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS a FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, row_number() OVER () AS row, {_WORDS} AS w FROM documents),
dx AS (SELECT row, n, a, array_to_string(w[a:a + n - 1], ' ') AS grams FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS a FROM dw, (SELECT DISTINCT n FROM ix) WHERE len(w) >= n)),
h AS MATERIALIZED (SELECT row, n, a, item FROM dx JOIN ix USING (n, grams)),
c AS (SELECT row, a, max(n) AS n FROM h GROUP BY 1, 2),
u AS (SELECT DISTINCT row, unnest(range(a, a + n)) AS place FROM c),
-- runs of hit words, from 0, stop exclusive
v AS (SELECT row, min(place) - 1 AS start, max(place) AS stop, count(*) AS words FROM (SELECT row, place, place - row_number() OVER (PARTITION BY row ORDER BY place) AS run FROM u) GROUP BY row, run),
p AS (SELECT row, sum(words)::bigint AS n_hit FROM v GROUP BY 1),
q AS (SELECT row, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY 1)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(len(items), 0)::bigint AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN p USING (row) LEFT JOIN q USING (row)
"""

_PIECES = r"regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')"
COLLOCATIONS = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest({_PIECES}), '[^\x20\x09]+') AS w FROM documents),
o AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM o GROUP BY 1, 2, 3),
t AS (SELECT lang, sum(f)::bigint AS n FROM f WHERE m = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= 30),
x AS (SELECT c.lang, array_to_string(c.w[i:i + k - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, m - k + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS k) WHERE k < m) c GROUP BY 1, 2),
k AS (SELECT c.lang, c.phrase, c.m, c.a, c.w, unnest(range(1, c.m)) AS k FROM c LEFT JOIN x ON x.lang = c.lang AND x.phrase = c.phrase WHERE NOT coalesce(100::hugeint * longer >= 80::hugeint * a, false)),
s AS (SELECT k.lang, k.phrase, k.k, a, lf.f AS l, rf.f AS r, ((2000000::hugeint * a) // (lf.f::hugeint + rf.f))::bigint AS score FROM k
  JOIN f lf ON lf.lang = k.lang AND lf.phrase = array_to_string(k.w[1:k.k], ' ') AND lf.m = k.k JOIN f rf ON rf.lang = k.lang AND rf.phrase = array_to_string(k.w[k.k + 1:], ' ') AND rf.m = k.m - k.k),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b) JOIN t USING (lang) WHERE rank <= 2000
"""

#: The same marks and escapes; lengths and texts come from the rows, not from a formatted string.
_BROKEN = r"regexp_replace(replace({}, '\', '\\'), '([<\[])(<SYS>>|</SYS>>|INST\]|/INST\]|s>|/s>|ROLE\]|SAYS\]|/ROLE\]|NEXT\])', '\1\\\2', 'g')"
CHATS = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL
  SELECT -7, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) x(t))),
o AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w IS DISTINCT FROM role AS opens, length({_BROKEN.format('text')}) AS chars FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text)))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::bigint AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars + CASE WHEN NOT opens THEN 6 WHEN role = 'system' THEN 15 WHEN role = 'user' THEN 13 WHEN role = 'assistant' THEN 7 ELSE 19 + length({_BROKEN.format('role')}) END)::bigint AS formatted_chars,
  count(*) FILTER (WHERE opens) AS n_merged
FROM o GROUP BY 1
"""

ORACLE_SQL: dict[str, str] = {"op12_chat_formatting": CHATS, "op13_collocations": COLLOCATIONS, "op3_mixing": MIXING, "op4_decontamination": DECONTAMINATION}
