"""DuckDB SQL for the collocation query: all phrases counted at once."""


def collocations_oracle(least: int = 10, cover: int = 50, top: int = 2000) -> str:
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists WHERE len(w) > 0),
grams AS (
  SELECT lang, 1 AS level, w[i] AS phrase FROM places
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM places WHERE i + 1 <= len(w)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM places WHERE i + 2 <= len(w)),
total AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
f AS (SELECT lang, level, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {least}),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE level > 1),
cuts AS (SELECT lang, level, phrase, a, w, unnest(range(1, level)) AS k FROM c),
scored AS (
  SELECT cuts.lang, cuts.level, cuts.phrase, cuts.a, k, h.a AS l, t.a AS r,
         CAST((1000000::HUGEINT * cuts.a * cuts.a) // (h.a::HUGEINT * t.a) AS BIGINT) AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = array_to_string(w[1:k], ' ')
            JOIN f t ON t.lang = cuts.lang AND t.phrase = array_to_string(w[k + 1:cuts.level], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
cover AS (
  SELECT lang, phrase, max(a) AS covered FROM (
    SELECT lang, a, w[1] || ' ' || w[2] AS phrase FROM c WHERE level = 3
    UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM c WHERE level = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN cover o ON o.lang = b.lang AND o.phrase = b.phrase
         WHERE o.covered IS NULL OR 100 * o.covered < {cover} * b.a)
SELECT k.lang, CAST(row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank,
       phrase, a, l, r, n, score
FROM kept k JOIN total t ON t.lang = k.lang
QUALIFY row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) <= {top}
"""
