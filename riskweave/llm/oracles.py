"""DuckDB SQL for the rows of operators that plain SQL can express, by comparing all rows with all; ids are unique there."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

TOPK = """WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS g
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.g, c.g), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0)
SELECT * FROM (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
WHERE rank <= 20"""

COMPONENTS = rf"""WITH RECURSIVE worded AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM worded),
single AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM single x JOIN single y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
linked AS (
  SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reached(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.a, w.b FROM reached r JOIN ways w ON r.b = w.a)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) USING (doc_id)"""


def clusters(rounds: int = 3) -> str:
    """Plain Lloyd rounds: every vector is compared with every centroid each time."""
    steps = [
        """kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS g FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0)""",
        "c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, g) - 1 AS INTEGER) AS cluster, g FROM (SELECT sha256('1:' || vec_id) AS h, g FROM kept WHERE vec_id IS NOT NULL ORDER BY h, g LIMIT 16))",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, any_value(g) AS g, arg_min(cluster, (distance, cluster)) AS cluster, CAST(min(distance) AS BIGINT) AS distance FROM (
  SELECT r, k.vec_id, k.g, c.cluster, list_sum(list_transform(list_zip(k.g, c.g), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM (SELECT row_number() OVER () AS r, * FROM kept) k CROSS JOIN c{i} c) GROUP BY r, vec_id)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.g, c.g) AS g FROM c{i} c LEFT JOIN (SELECT cluster, list(v ORDER BY d) AS g FROM (
  SELECT cluster, d, CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS v FROM (SELECT cluster, unnest(g) AS v, generate_subscripts(g, 1) AS d FROM a{i}) GROUP BY cluster, d) GROUP BY cluster) m USING (cluster))""")
    last = f"a{rounds}"
    return f"""WITH {", ".join(steps)}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.g, ',')) AS centroid_sha256
FROM {last} JOIN c{rounds} c USING (cluster)"""


_H = lambda i: f"CAST('0x' || substr(sha256('42:' || doc_id), {8 * i + 1}, 8) AS BIGINT)"
INFILL = rf"""WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, {_H(0)} AS h1, {_H(1)} AS h2, {_H(2)} AS h3, {_H(3)} AS h4 FROM documents),
placed AS (
  SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts"""
