"""DuckDB SQL for the operators that SQL can express, from their definitions."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from .chat import CONTROL, END, SEP, START

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"


def _escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


CHAT = rf"""WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(START) + len(SEP) + len(END)} + length({_escaped("role")}) + length({_escaped("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

SUBSTRING = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
  p AS (SELECT r, w, unnest(range(len(w) - 34)) AS i FROM d WHERE len(w) >= 35),
  k AS (SELECT r, i, md5(array_to_string(w[i + 1:i + 35], ' ')) AS h FROM p),
  rep AS (SELECT r, i FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(*) > 1)),
  gone AS (SELECT DISTINCT r, i + j AS pos FROM rep CROSS JOIN (SELECT unnest(range(35)) AS j)),
  words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d),
  kept AS (SELECT r, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, pos) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""

JACCARD = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')")} AS w FROM documents),
  s AS (SELECT DISTINCT r, array_to_string(w[i + 1:i + 5], ' ') AS g FROM (SELECT r, w, unnest(range(len(w) - 4)) AS i FROM d WHERE len(w) >= 5) UNION ALL SELECT r, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
  n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
  common AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
  links AS (SELECT x, y FROM common JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 100*c >= 80*(p.n + q.n - c)),
  reach(x, y) AS (SELECT r, r FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (r)
  JOIN (SELECT x, min(e.doc_id) AS component_id FROM reach JOIN d e ON e.r = reach.y GROUP BY x) m ON m.x = d.r"""

BACKOFF = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
  words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
  t AS (SELECT r, word AS c, lag(word, 1) OVER p AS b, lag(word, 2) OVER p AS a FROM words WINDOW p AS (PARTITION BY r ORDER BY pos)),
  n1 AS (SELECT c AS x, count(*) AS f FROM t GROUP BY 1), n2 AS (SELECT b AS x, c AS y, count(*) AS f FROM t WHERE b IS NOT NULL GROUP BY 1, 2),
  n3 AS (SELECT a AS x, b AS y, c AS z, count(*) AS f FROM t WHERE a IS NOT NULL GROUP BY 1, 2, 3),
  s AS (SELECT t.r, log10(CASE WHEN n3.f >= 2 THEN n3.f::DOUBLE/p2.f WHEN q2.f >= 2 THEN (CASE WHEN a IS NULL THEN 1 ELSE 0.4 END)*q2.f::DOUBLE/p1.f ELSE pow(0.4, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT)*q1.f::DOUBLE/(SELECT count(*) FROM words) END) AS v
    FROM t JOIN n1 q1 ON q1.x = c LEFT JOIN n1 p1 ON p1.x = b LEFT JOIN n2 q2 ON q2.x = b AND q2.y = c LEFT JOIN n2 p2 ON p2.x = a AND p2.y = b LEFT JOIN n3 ON n3.x = a AND n3.y = b AND n3.z = c),
  g AS (SELECT r, sum(v) AS v FROM s GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(v, 0), 3) AS log_score, round(v/nullif(len(w), 0), 5) AS word_score FROM d LEFT JOIN g USING (r)"""
