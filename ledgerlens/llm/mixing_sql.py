"""DuckDB SQL for the taken words of a mix: an independent route that lists a
source's slots directly, without the draws (they only decide the shard)."""

from __future__ import annotations

from ledgerlens.llm.mixing import EPOCHS, ROUNDS, WEIGHTS


def _number(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def _rounds(name: str, keep: str, seed: int, order) -> str:
    out, last = [], name
    for r in order:
        pair = f"((({_number(f"'{seed}|k|' || sk || '|' || epoch || '|{r}'")} % nb) - pos) % nb + nb) % nb"
        out.append(f"{name}_p{r} AS (SELECT {keep}, sk, epoch, nb, pos, {pair} AS pair FROM {last}),\n"
                   f"{name}_r{r} AS (SELECT {keep}, sk, epoch, nb, CASE WHEN "
                   f"{_number(f"'{seed}|b|' || sk || '|' || epoch || '|{r}|' || greatest(pos, pair)")} % 2 = 1 "
                   f"THEN pair ELSE pos END AS pos FROM {name}_p{r})")
        last = f"{name}_r{r}"
    return ",\n".join(out) + f",\n{name}_done AS (SELECT * FROM {last})"


def mixing_oracle(block: int = 256, seed: int = 7) -> str:
    weight = " ".join(f"WHEN {i} THEN {w}::DOUBLE" for i, w in enumerate(WEIGHTS))
    h = _number(f"'{seed}|o|' || coalesce(doc_id::VARCHAR, 'null') || '|' || size")
    return rf"""
WITH sizes AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS sk,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT sk, min(source) AS source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY sk),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {weight} END AS weight FROM s0),
s2 AS (SELECT *, {EPOCHS} * source_size::DOUBLE AS cap, {EPOCHS} * source_size::DOUBLE / weight AS ratio FROM s1),
s3 AS (SELECT *, sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
         sum(weight) OVER (ORDER BY ratio, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share,
         row_number() OVER (ORDER BY ratio, sk) AS k FROM s2),
stop AS (SELECT k AS k1, room AS room1, share AS share1 FROM s3 WHERE room <= ratio * share ORDER BY k LIMIT 1),
s4 AS (SELECT *, CASE WHEN k < k1 THEN cap ELSE least(cap, room1 * weight / share1) END AS target FROM s3, stop),
s5 AS (SELECT sk, source_size, target, floor(target + 0.5)::BIGINT AS words, (source_size + {block - 1}) // {block} AS nb FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS epochs FROM s5),
b0 AS (SELECT sk, epochs AS epoch, nb, nb - 1 AS pos FROM s6 WHERE nb > 0),
{_rounds("b0", "1 AS one", seed, reversed(range(ROUNDS)))},
s7 AS (SELECT s6.*, coalesce(b.pos, -1) AS pos, words - epochs * source_size AS rest, {block} * s6.nb - source_size AS short
       FROM s6 LEFT JOIN b0_done b USING (sk)),
s8 AS (SELECT *, CASE WHEN rest <= 0 THEN 0 ELSE (rest + {block - 1}) // {block}
         + CASE WHEN pos < (rest + {block - 1}) // {block} AND (rest + {block - 1}) // {block} * {block} - short < rest THEN 1 ELSE 0 END END AS k FROM s7),
s9 AS (SELECT *, epochs * nb + k AS n,
         CASE WHEN k > 0 THEN rest - ((k - 1) * {block} - CASE WHEN pos < k - 1 THEN short ELSE 0 END) ELSE {block} END AS last_words FROM s8),
j0 AS (SELECT sk, j, j // nb AS epoch, nb, j % nb AS pos FROM (SELECT sk, nb, unnest(range(n)) AS j FROM s9 WHERE n > 0)),
{_rounds("j0", "j", seed, range(ROUNDS))},
slots AS (SELECT t.sk, t.pos AS block, CASE WHEN t.j = s9.n - 1 THEN last_words ELSE {block} END AS words FROM j0_done t JOIN s9 USING (sk)),
d0 AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id) AS uid, {h} AS h FROM sizes),
d1 AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY sk ORDER BY h, doc_id, uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d0),
p AS (SELECT uid, sk, block, greatest(start, block * {block}) AS a, least(start + size, (block + 1) * {block}) AS b
      FROM (SELECT *, unnest(range(start // {block}, (start + size - 1) // {block} + 1)) AS block FROM d1 WHERE size > 0)),
t AS (SELECT uid, sum(greatest(0, least(b, block * {block} + words) - a)) AS taken FROM p JOIN slots USING (sk, block) GROUP BY uid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM d1 JOIN s5 USING (sk) LEFT JOIN t USING (uid)
"""
