"""DuckDB SQL for the ranked search: all documents scored for all items."""


def search_oracle(k: int = 10) -> str:
    terms = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS uid, doc_id, {terms} AS w FROM documents),
size AS (SELECT count(*) AS total, CAST(sum(len(w)) AS BIGINT) AS words FROM docs WHERE len(w) > 0),
items AS (SELECT row_number() OVER () AS q, item_id, {terms} AS w FROM benchmark),
asked AS (SELECT q, item_id, term, count(*) AS c FROM (SELECT q, item_id, unnest(w) AS term FROM items) GROUP BY ALL),
tf AS (SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest(w) AS term FROM docs)
       WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS weight
            FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), size),
lengths AS (SELECT uid, doc_id, 100 - 75 + ((75 * len(w) * total) // words) AS m FROM docs, size),
scored AS (SELECT q, item_id, doc_id, CAST(sum(c * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
           FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (uid) GROUP BY q, item_id, uid, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) <= {k}
"""
