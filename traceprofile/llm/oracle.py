"""DuckDB SQL with the results of the corpus queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_MIX = f"""
WITH sized AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 16) AS place
  FROM documents),
total AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source),
lim AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS lim
  FROM total),
lev AS (
  SELECT *,
    ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(lim) OVER (ORDER BY lim / weight, rank
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(weight) OVER (ORDER BY lim / weight, rank
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM lim),
target AS (
  SELECT source, source_size,
    greatest(least(lim, coalesce(weight * (
      SELECT level FROM lev WHERE lim >= level * weight ORDER BY lim / weight, rank LIMIT 1), lim)),
      0.0::DOUBLE) AS target
  FROM lev),
state AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS repeats
  FROM target),
run AS (
  SELECT s.source, s.place, sum(s.size) AS words,
         sum(sum(s.size)) OVER (PARTITION BY s.source ORDER BY s.place) AS upto
  FROM sized s WHERE s.size > 0 GROUP BY s.source, s.place),
cut AS (
  SELECT r.source, r.place,
    CASE WHEN r.upto <= t.target - t.repeats * t.source_size THEN 1
         WHEN r.upto - r.words <= t.target - t.repeats * t.source_size
           AND (t.target - t.repeats * t.source_size - (r.upto - r.words)) * 2 > r.words THEN 1
         ELSE 0 END AS more
  FROM run r JOIN state t ON r.source IS NOT DISTINCT FROM t.source)
SELECT s.doc_id, s.size, t.source_size, t.target,
       (s.size * (t.repeats + coalesce(c.more, 0)))::BIGINT AS taken
FROM sized s
JOIN state t ON s.source IS NOT DISTINCT FROM t.source
LEFT JOIN cut c ON s.source IS NOT DISTINCT FROM c.source AND s.place = c.place
"""

_LINES = f"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
line AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM doc),
keyed AS (
  SELECT *, trim({_LOWER.format('line')}, {_SPACE}) AS key FROM line),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
kept AS (
  SELECT k.r, k.line, k.pos, s.key IS NULL OR k.doc_id = s.keeper AS stays
  FROM keyed k LEFT JOIN shared s ON k.key = s.key),
text AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '') AS kept
  FROM kept GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM text JOIN doc USING (r)
"""

_SUBSTRINGS = f"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
win AS (
  SELECT r, unnest(range(1, len(w) - 33)) AS p, w FROM doc WHERE len(w) >= 35),
keyed AS (
  SELECT r, p, array_to_string(w[p:p + 34], ' ') AS k FROM win),
hit AS (
  SELECT r, p FROM keyed WHERE k IN (SELECT k FROM keyed GROUP BY k HAVING count(*) > 1)),
gone AS (
  SELECT DISTINCT r, unnest(range(p, p + 35)) AS i FROM hit),
word AS (
  SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM doc),
kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY i) AS kept, count(*) AS n
  FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (r)
"""

_SUFFIXES = """
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h,
         octet_length(encode(coalesce(text, ''))) AS n
  FROM documents),
win AS (
  SELECT r, doc_id, p, substr(h, 2 * p + 1, 100) AS k
  FROM (SELECT r, doc_id, h, unnest(range(0, n - 49)) AS p FROM doc WHERE n >= 50)),
hit AS (
  SELECT r, p FROM (SELECT r, p, doc_id, min(doc_id) OVER (PARTITION BY k) AS least FROM win)
  WHERE doc_id > least),
gone AS (
  SELECT DISTINCT r, unnest(range(p, p + 50)) AS i FROM hit),
span AS (
  SELECT r, count(*) AS n_removed, count(*) FILTER (before IS DISTINCT FROM i - 1) AS n_spans
  FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM gone) GROUP BY r),
kept AS (
  SELECT r, string_agg(substr(h, 2 * i + 1, 2), '' ORDER BY i) AS kept
  FROM (SELECT r, h, unnest(range(0, n)) AS i FROM doc) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM doc LEFT JOIN span USING (r) LEFT JOIN kept USING (r)
"""

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_LIST = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERMS}')"

_SEARCH = f"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERM_LIST} AS t FROM documents),
item AS (
  SELECT row_number() OVER () AS i, item_id, {_TERM_LIST} AS t FROM benchmark),
wanted AS (
  SELECT DISTINCT i, unnest(t) AS term FROM item),
total AS (
  SELECT count(*) FILTER (len(t) > 0)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM doc),
held AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM doc)
  WHERE term IN (SELECT term FROM wanted) GROUP BY r, term),
weighted AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w
  FROM held, total GROUP BY term, n_docs),
sized AS (
  SELECT r, doc_id, (10 + ((90 * len(t)::BIGINT * n_docs) // n_terms))::BIGINT AS m FROM doc, total),
scored AS (
  SELECT i, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM wanted JOIN weighted USING (term) JOIN held USING (term) JOIN sized USING (r) GROUP BY i, r),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank
  FROM scored JOIN sized USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked JOIN item USING (i) WHERE rank <= 10
"""

# CRC-32 bit by bit: a byte is added once, followed by seven steps without one
_CRC = """xor(list_reduce(
    list_concat([4294967295::BIGINT],
      flatten(list_transform(string_split({0}, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)), 4294967295)"""

_REPAIR = f"""
WITH RECURSIVE src AS (
  SELECT conv_id, dense_rank() OVER (ORDER BY conv_id) AS cid, turn,
    {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fault,
    coalesce(role, ' ') AS role, coalesce(text, ' ') AS text
  FROM conversations),
damaged AS (
  SELECT cid, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM src WHERE fault <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         rtrim(text, {_SPACE}) AS bare
  FROM damaged),
rated AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(role) OVER (PARTITION BY cid ORDER BY i) AS before
  FROM placed),
counted AS (
  SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au'))
      AS illegal, max(i) AS n
  FROM rated GROUP BY cid),
gap(q, x, edits, lines) AS (VALUES
  ('', '', '', ''), ('', 'u', 'I', chr(10) || 'user:'),
  ('', 'a', 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('s', 's', '', ''), ('s', 'u', 'I', chr(10) || 'user:'),
  ('s', 'a', 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('u', 'u', '', ''), ('u', 'a', 'I', chr(10) || 'assistant:'),
  ('u', 'u', 'II', chr(10) || 'assistant:' || chr(10) || 'user:'),
  ('a', 'a', '', ''), ('a', 'u', 'I', chr(10) || 'user:'),
  ('a', 'a', 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
edit AS (
  SELECT gap.*, e, CASE WHEN e = 'D' THEN x WHEN e = 'S' THEN 's' WHEN x = 'u' THEN 'a' ELSE 'u' END AS y,
    5 * length(edits) + CASE e WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END AS cost
  FROM gap, (VALUES ('D'), ('K'), ('S'), ('R')) AS t(e) WHERE e <> 'S' OR x = ''),
dp(cid, i, q, best) AS (
  SELECT DISTINCT cid, 0::BIGINT, '', struct_pack(cost := 0::BIGINT, audit := '', said := '') FROM src
  UNION ALL
  SELECT dp.cid, dp.i + 1, y, min(struct_pack(
      cost := (best.cost + cost + CASE WHEN e <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END)::BIGINT,
      audit := best.audit || edits || CASE e WHEN 'S' THEN 'K' ELSE e END,
      said := best.said || lines || CASE WHEN e = 'D' THEN ''
        ELSE chr(10) || CASE WHEN e <> 'R' THEN role WHEN y = 'u' THEN 'user' ELSE 'assistant' END
             || ':' || text END))
  FROM dp JOIN rated r ON r.cid = dp.cid AND r.i = dp.i + 1 JOIN edit ON edit.q = dp.q
  WHERE e = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (e = 'R' OR left(role, 1) = y))
  GROUP BY dp.cid, dp.i, y),
finished AS (
  SELECT dp.cid, min(struct_pack(
      cost := best.cost + CASE q WHEN 's' THEN 10 WHEN 'u' THEN 5 ELSE 0 END,
      audit := best.audit || CASE q WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END,
      said := best.said || CASE q WHEN 's' THEN chr(10) || 'user:' || chr(10) || 'assistant:'
        WHEN 'u' THEN chr(10) || 'assistant:' ELSE '' END)) AS best
  FROM dp JOIN counted ON counted.cid = dp.cid AND dp.i = n GROUP BY dp.cid)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, cid FROM src) LEFT JOIN counted USING (cid) LEFT JOIN finished USING (cid)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_suffix_dedup": _SUFFIXES,
        "op6_mix_sources": _MIX,
        "op9_substring_dedup": _SUBSTRINGS,
        "op10_line_dedup": _LINES,
        "op11_lexical_search": _SEARCH,
        "op12_repair_conversations": _REPAIR,
    }
