"""SQL that says the same as the corpus queries, over whole tables, where SQL can."""

from __future__ import annotations


def clustering(k: int = 40, rounds: int = 5, seed: int = 2, width: int = 64) -> str:
    """Rounds unrolled: every vector against every centroid."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS c, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        squared = "list_sum(list_transform(list_zip(e.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v, m.c AS c, m.d AS d FROM (SELECT vec_id, e.v AS v, min({{'d': {squared}, 'c': c.c}}) AS m FROM kept e, c{r} c GROUP BY vec_id, e.v))")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.v, o.v) AS v FROM c{r} o LEFT JOIN (
  SELECT c, list(fdiv(s, n)::BIGINT ORDER BY i) AS v FROM (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, {width + 1}) t(i) GROUP BY c, i) GROUP BY c) n ON n.c = o.c)""")
    return f"""WITH {', '.join(steps)}
SELECT a.vec_id, a.c AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
  sum(a.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(o.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} o ON o.c = a.c"""


def substrings(length: int = 200) -> str:
    """Digest of every window of every document, counted; covered bytes as runs of windows; what is left, as hex."""
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS MATERIALIZED (SELECT r, doc_id, hex(b) AS x, octet_length(b) AS n FROM d),
w AS MATERIALIZED (SELECT r, p, md5(substr(x, 2 * p + 1, {2 * length})) AS m FROM (SELECT r, x, unnest(range(n - {length - 1})) AS p FROM h WHERE n >= {length})),
twice AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
hit AS (SELECT r, p FROM w SEMI JOIN twice USING (m)),
edge AS (SELECT r, p, p - lag(p) OVER (PARTITION BY r ORDER BY p) > {length} IS NOT FALSE AS fresh FROM hit),
run AS (SELECT r, min(p) AS a, max(p) + {length} AS z FROM (SELECT r, p, sum(fresh::INT) OVER (PARTITION BY r ORDER BY p) AS g FROM edge) GROUP BY r, g),
gap AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS z FROM run
  UNION ALL SELECT r, max(z), NULL FROM run GROUP BY r),
kept AS (SELECT r, string_agg(substr(x, 2 * g.a + 1, 2 * (coalesce(g.z, n) - g.a)), '' ORDER BY g.a) AS x FROM gap g JOIN h USING (r) GROUP BY r),
cut AS (SELECT r, count(*) AS n_spans, sum(z - a) AS n_removed FROM run GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept.x, h.x))) AS kept_sha256
FROM h LEFT JOIN kept USING (r) LEFT JOIN cut USING (r)"""


def resampling(percent: int = 5, seed: int = 42, least_words: int = 20, buckets: int = 10_000) -> str:
    """CRC-32 byte by byte over the bytes in hexadecimal, its table of 256 steps worked out in SQL, for each distinct feature."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""WITH RECURSIVE turn(b, c, k) AS (SELECT i, i::BIGINT, 0 FROM range(256) t(i) UNION ALL SELECT b, {step}, k + 1 FROM turn WHERE k < 8),
step AS (SELECT list(c ORDER BY b) AS s FROM turn WHERE k = 8),
txt AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{word}') AS w FROM documents),
aim AS MATERIALIZED (SELECT regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{word}') AS w FROM benchmark),
f AS MATERIALIZED (SELECT r, array_to_string(w[i:i + k - 1], ' ') AS f FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM txt, range(1, 4) t(k))),
g AS MATERIALIZED (SELECT array_to_string(w[i:i + k - 1], ' ') AS f FROM (SELECT w, k, unnest(range(1, len(w) - k + 2)) AS i FROM aim, range(1, 4) t(k))),
code AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(s[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) % {buckets} AS bucket
  FROM (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM f UNION SELECT f FROM g)), step),
fb AS MATERIALIZED (SELECT r, bucket, count(*) AS n FROM f JOIN code USING (f) GROUP BY r, bucket),
src AS (SELECT bucket, sum(n) AS s FROM fb GROUP BY bucket),
tgt AS (SELECT bucket, count(*) AS t FROM g JOIN code USING (f) GROUP BY bucket),
total AS (SELECT (SELECT coalesce(sum(s), 0) FROM src) AS s, (SELECT coalesce(sum(t), 0) FROM tgt) AS t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(tgt.t, 0) + 1)::DOUBLE * (total.s + {buckets})::DOUBLE / ((src.s + 1)::DOUBLE * (total.t + {buckets})::DOUBLE)))::BIGINT AS g
  FROM src LEFT JOIN tgt USING (bucket), total),
weighed AS (SELECT r, sum(n)::BIGINT AS n, sum(n * g)::BIGINT AS weight FROM fb JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM txt LEFT JOIN weighed USING (r)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY words >= {least_words} ORDER BY score DESC, doc_id) AS k, count(*) FILTER (words >= {least_words}) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= {least_words} AND k <= {percent} * able // 100 THEN k END AS rank FROM ranked"""


def _components(edges: str, nodes: str) -> str:
    """Least node reachable: pairs (node, reached) closed under the links, both ways."""
    return f"""hop(a, b) AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}),
reach(a, b) AS (SELECT a, a FROM {nodes} UNION SELECT reach.a, hop.b FROM reach JOIN hop ON hop.a = reach.b),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)"""


def near_vectors(cosine: float = 0.98) -> str:
    """Every pair of one label."""
    return f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS x,
    coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda z: z IS NULL OR isnan(z) OR isinf(z))) = 0 AND list_max(list_transform(embedding, lambda z: abs(z))) > 0, false) AS ok FROM embeddings),
u AS MATERIALIZED (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS n FROM v WHERE ok AND label IS NOT NULL),
l AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.label = q.label AND p.vec_id < q.vec_id AND len(p.x) = len(q.x)
  WHERE list_dot_product(p.x, q.x) / (p.n * q.n) >= {cosine}::DOUBLE),
k AS (SELECT a AS id, count(*) AS n FROM (SELECT a FROM l UNION ALL SELECT b FROM l) t(a) GROUP BY a),
{_components('l', '(SELECT vec_id AS a FROM v) q')}
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, c::BIGINT AS component_id, vec_id = c AS kept FROM v JOIN least ON least.a = vec_id LEFT JOIN k ON k.id = vec_id"""


def ngram_join(n: int = 4, percent: int = 85) -> str:
    """Shingles of every document, joined with those of every other."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + {n - 1}], ' ')) AS s, md5(array_to_string(w[i:i + {n - 1}], ' ')) AS m FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {n - 2}, 2))) AS i FROM w WHERE len(w) > 0)),
z AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.s = q.s AND p.m = q.m AND p.doc_id < q.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
{_components('l', '(SELECT doc_id AS a FROM w) q')}
SELECT doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, c::BIGINT AS component_id FROM w JOIN least ON least.a = doc_id LEFT JOIN z USING (doc_id)"""
