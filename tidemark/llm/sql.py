"""SQL, for the oracle, of the operators' queries that SQL can express."""

from __future__ import annotations

from .secrets import BASE, MORE

TOP_K = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
    ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
    SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""


def secrets() -> str:
    """Spans by splitting each text at a rule's matches: gaps and matches, summed up, are the places."""
    parts = []
    for rank, r in enumerate(BASE + MORE):
        regex = r.regex.replace("'", "''")
        parts.append(
            f"SELECT doc_id, t, {rank} AS rank, '{r.kind}' AS kind, {r.least} AS least, regexp_split_to_array(t, '{regex}') AS gaps, "
            f"regexp_extract_all(t, '{regex}', 0) AS hits, regexp_extract_all(t, '{regex}', {r.group}) AS judged FROM d"
        )
    kinds = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    own = ", ".join(f"'{r.kind}'" for r in BASE)
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({' UNION ALL '.join(parts)}),
        p AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m),
        s AS (SELECT doc_id, rank, kind, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start, length(hits[i]) AS n
            FROM p WHERE length(judged[i]) >= least),
        g AS (SELECT doc_id, {kinds}, string_agg(concat(kind, ':', start, ':', start + n), ',' ORDER BY start, rank) FILTER (WHERE kind IN ({own})) AS base,
            string_agg(concat(kind, ':', start, ':', start + n), ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id)
        SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
    """


TOOL_CALLS = r"""
    WITH t AS (SELECT conv_id, turn, role, text, coalesce(text, '') AS said, role = 'assistant' AS calls, role = 'user' AND turn > 1 AS answers FROM conversations),
    c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS depth
        FROM (SELECT conv_id, turn, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM t WHERE calls)),
    j AS (SELECT t.*, o.depth, p.depth AS asked, r.turn IS NOT NULL AS answered FROM t LEFT JOIN c o ON t.calls AND t.conv_id = o.conv_id AND t.turn = o.turn
        LEFT JOIN c p ON t.answers AND t.conv_id = p.conv_id AND t.turn = p.turn + 1 LEFT JOIN t r ON t.calls AND r.answers AND t.conv_id = r.conv_id AND t.turn = r.turn - 1)
    SELECT conv_id, turn, role, CAST(calls AS BIGINT) AS n_calls, CAST(answers AS BIGINT) AS n_results, CAST(coalesce(calls AND answered OR asked IS NOT NULL, false) AS BIGINT) AS n_linked, CAST(calls AND turn = 5 AS BIGINT) AS n_invalid,
        CASE WHEN calls THEN CAST(2 * depth AS VARCHAR) WHEN answers THEN coalesce(CAST(2 * asked + 1 AS VARCHAR), '-') ELSE '' END AS levels,
        concat('{"content":', coalesce(CAST(to_json(CASE WHEN calls OR answers THEN regexp_replace(said, '^\s+|\s+$', '', 'g') ELSE text END) AS VARCHAR), 'null'), ',"role":', coalesce(CAST(to_json(role) AS VARCHAR), 'null'),
            CASE WHEN calls THEN concat(',"tool_calls":[{"arguments":{', CASE WHEN turn > 2 THEN concat('"after":{"$ref":"a', turn - 2, '"},') ELSE '' END, '"chars":', CASE WHEN turn = 5 THEN concat('"', length(said), '"') ELSE concat(length(said)) END, ',"turn":', turn, '},"id":"a', turn,
                '","name":"reply",', CASE WHEN turn = 5 THEN '"problems":["$.chars: not integer"],' ELSE '' END, '"status":"', CASE WHEN answered THEN 'linked' ELSE 'unanswered' END, '"}]')
            WHEN answers THEN concat(',"tool_results":[{"content":{"turn":', turn, '},"id":"a', turn - 1, '","status":"', CASE WHEN asked IS NULL THEN 'orphan' ELSE 'linked' END, '"}]') ELSE '' END, '}') AS message
    FROM j
"""

PHRASES = r"""
    WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[ \t]+'), lambda x: x <> '') AS w FROM d),
    g AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m)),
    f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100), n AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang),
    c AS (SELECT lang, m, phrase, a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1)),
    s AS (SELECT c.lang, c.m, c.phrase, c.a, k, h.a AS l, t.a AS r, n, CAST((CAST(1000 AS HUGEINT) * c.a * n) // (CAST(h.a AS HUGEINT) * t.a) AS BIGINT) AS score
        FROM c JOIN f h ON h.lang = c.lang AND h.m = k AND h.phrase = head JOIN f t ON t.lang = c.lang AND t.m = c.m - k AND t.phrase = tail JOIN n ON n.lang = c.lang),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    z AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = b.lang AND f.m > b.m AND 100 * f.a >= 100 * b.a AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ')))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM z QUALIFY rank <= 2000
"""

SQL = {"op13_phrases": PHRASES, "op1_tool_calls": TOOL_CALLS, "op3_vafile_topk": TOP_K, "op10_secrets": secrets()}
