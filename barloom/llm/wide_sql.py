"""SQL of the divergence audit, decontamination and centroid clustering."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DIVERGENCE = rf"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS t FROM documents),
    w AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
    c AS MATERIALIZED (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
    v AS (SELECT lang, count(*)::HUGEINT AS terms, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
    g AS MATERIALIZED (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
    p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * v.terms) AS p,
                 1 + (1000000000::HUGEINT * (k.n + 5)) // (v.total + 5 * v.terms) AS q
          FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
              LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
    parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
              UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
    SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM parts) WHERE part = 'pair' OR rank <= 50
"""

CONTAMINATION = rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    i AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, s, s + 9), ' ') AS k
          FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
    x AS (SELECT r, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k
          FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM i))),
    m AS (SELECT DISTINCT r, s, n, item_id FROM x JOIN i USING (k, n)),
    hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS place FROM m) GROUP BY r),
    ids AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)
"""


def _clustering(rounds: int = 5, k: int = 40) -> str:
    """One pair of table expressions a round; inner products of whole numbers are exact in doubles."""
    steps = [
        f"""e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: coalesce(isfinite(x::DOUBLE), false))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY mark, v) - 1 AS cluster, v FROM (SELECT sha256('2:' || vec_id) AS mark, v FROM e ORDER BY mark NULLS LAST, v LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT r, min((list_inner_product(e.v, e.v) - 2 * list_inner_product(e.v, c.v) + list_inner_product(c.v, c.v), c.cluster)) AS best FROM e, c{n} c GROUP BY r),
            p{n} AS MATERIALIZED (SELECT r, best[1]::BIGINT AS distance, best[2]::BIGINT AS cluster FROM a{n})""")
        if n < rounds:
            steps.append(f"""s{n} AS (SELECT cluster, place, floor(sum(x) / count(*)) AS x FROM (SELECT cluster, unnest(generate_series(1, 64)) AS place, unnest(v) AS x FROM p{n} JOIN e USING (r)) GROUP BY cluster, place),
            c{n + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (SELECT cluster, list(x ORDER BY place) AS v FROM s{n} GROUP BY cluster) m USING (cluster))""")
    return f"""WITH {', '.join(steps)}
        SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
        FROM p{rounds} p JOIN e USING (r) JOIN c{rounds} c USING (cluster)"""


CLUSTERING = _clustering()
