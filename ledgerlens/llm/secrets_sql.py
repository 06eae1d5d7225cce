"""DuckDB SQL of the secret scan."""

from __future__ import annotations

from ledgerlens.llm.secrets import BASE, COMPLETES, KINDS, SCOPE, WEAK, search_pattern


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secrets_oracle(scope: int = SCOPE) -> str:
    found = []
    for rank, kind in enumerate(KINDS):
        _, least, group = {**BASE, **WEAK}[kind]
        p = _quote(search_pattern(kind))
        ok = f"length(c) >= {least}"
        if kind == "key":
            ok += " AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')"
        found.append(
            f"SELECT uid, {rank} AS rank, sum(length(g) + length(m)) OVER (PARTITION BY uid ORDER BY i) AS stop, length(m) AS n, {ok} AS ok"
            f" FROM (SELECT uid, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(gs[:len(ms)]) AS g, unnest(cs) AS c"
            f" FROM (SELECT uid, regexp_extract_all(t, {p}) AS ms, string_split_regex(t, {p}) AS gs,"
            f" regexp_extract_all(t, {p}, {group}) AS cs FROM d) WHERE len(ms) > 0)")
    rank = {k: i for i, k in enumerate(KINDS)}
    # complementary parts that end within the scope before a part, or start within it after
    near = lambda kind: (f"EXISTS (SELECT 1 FROM r AS o WHERE o.uid = r.uid AND o.rank IN ({', '.join(str(rank[k]) for k in COMPLETES[kind])})"  # noqa: E731
                         f" AND o.stop >= r.start - {scope} AND o.start <= r.stop + {scope})")
    name = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS))
    said = f"(CASE rank {name} END) || ':' || start || ':' || stop"
    listed = lambda where: f"coalesce(string_agg({said}, ',' ORDER BY start, rank) FILTER ({where}), '')"
    count = lambda k: f"count(*) FILTER (rank = {rank[k]})"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS uid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(found)}),
p AS (SELECT uid, rank, (stop - n)::BIGINT AS start, stop::BIGINT AS stop FROM f WHERE ok),
q AS (SELECT *, max(CASE WHEN rank < {len(BASE)} THEN stop END) OVER (PARTITION BY uid ORDER BY start, rank
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS inside FROM p),
r AS (SELECT uid, rank, start, stop FROM q WHERE rank < {len(BASE)} OR inside IS NULL OR inside <= start),
k AS (SELECT *, CASE rank WHEN {rank['key']} THEN {near('key')}
        WHEN {rank['endpoint']} THEN {near('endpoint')} ELSE true END AS keep FROM r)
SELECT d.doc_id, {count('assign')} AS n_assign, {count('access')} AS n_access, {count('hex')} AS n_hex,
       sha256({listed(f'rank < {len(BASE)}')}) AS base_sha256, {listed('rank IS NOT NULL')} AS spans,
       count(*) FILTER (rank >= {len(BASE)}) AS n_linked
FROM d LEFT JOIN (SELECT * FROM k WHERE keep) USING (uid) GROUP BY uid, d.doc_id
"""
