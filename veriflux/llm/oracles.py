"""DuckDB SQL for the queries that SQL can express."""

from .secrets import RULES

#: A-Z alone in lower case; lower() would also change other letters.
AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT = f"""
WITH n AS (SELECT doc_id, {AZ} AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM n"""

NEAR = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({AZ}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
c AS (SELECT x, min(y) AS m FROM r GROUP BY x)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c.m AS component_id, s.doc_id = c.m AS kept
FROM s JOIN c ON s.doc_id = c.x"""

VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
c AS (SELECT x, min(y) AS m FROM r GROUP BY x),
n AS (SELECT x, count(*) AS k FROM p GROUP BY x)
SELECT c.x AS vec_id, coalesce(n.k, 0) AS n_links, c.m AS component_id, c.x = c.m AS kept FROM c LEFT JOIN n ON n.x = c.x"""


def _centroid_oracle(rounds: int = 3) -> str:
    """Every round spelt out: assignments a0.., centroids c0.."""
    steps = ["""v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(64 * x) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, e FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16)"]
    for k in range(rounds + 1):
        steps.append(f"""d{k} AS (SELECT vec_id, v.e, c, CAST(list_sum(list_transform(list_zip(v.e, c{k}.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{k}),
a{k} AS (SELECT vec_id, e, unnest(arg_min({{'c': c, 'd': d}}, {{'d': d, 'c': c}})) FROM d{k} GROUP BY vec_id, e)""")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{k}) GROUP BY c, i),
c{k + 1} AS (SELECT c{k}.c, coalesce(m.e, c{k}.e) AS e FROM c{k} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM s{k} GROUP BY c) m ON m.c = c{k}.c)""")
    return f"""WITH {', '.join(steps)}
SELECT vec_id, CAST(a{rounds}.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(c{rounds}.e, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = a{rounds}.c"""


def _secret_oracle() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    columns, keep = [], []
    for i, rule in enumerate(RULES):
        p = quote(rule.pattern)
        columns.append(f"string_split_regex(body, {p}) AS p{i}, regexp_extract_all(body, {p}) AS m{i}")
        size = f"length(regexp_extract(m{i}[j], {p}, {rule.group}))"
        start = f"CAST(list_sum(list_transform(p{i}[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m{i}[1:j-1], lambda x: length(x))), 0) AS BIGINT)"
        keep.append(f"list_transform(list_filter(range(1, len(m{i}) + 1), lambda j: {size} >= {rule.least}), lambda j: {{'s': {start}, 'o': {i}, 't': '{rule.kind}:' || {start} || ':' || ({start} + length(m{i}[j]))}}) AS k{i}")
    base = [i for i, r in enumerate(RULES) if r.base]
    text = lambda ks: f"coalesce(array_to_string(list_transform(list_sort(flatten([{', '.join(f'k{i}' for i in ks)}])), lambda x: x.t), ','), '')"
    counts = ", ".join(f"CAST(len(k{i}) AS BIGINT) AS n_{RULES[i].kind}" for i in base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
m AS (SELECT doc_id, {', '.join(columns)} FROM d),
k AS (SELECT doc_id, {', '.join(keep)} FROM m)
SELECT doc_id, {counts}, sha256({text(base)}) AS base_sha256, {text(range(len(RULES)))} AS spans FROM k"""


ORACLES = {"op4_secrets": _secret_oracle(), "op5_embedding_dedup": VECTORS, "op6_exact_dedup": EXACT, "op9_minhash": NEAR, "op12_centroids": _centroid_oracle()}
