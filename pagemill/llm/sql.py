"""What the three exact operators over whole tables return, said in SQL from their definitions, without their methods."""

from __future__ import annotations

import math

from pagemill.llm import clusters, licenses


def annulus() -> str:
    """Every vector against every centroid, round after round."""
    k, rounds, dims = clusters.K, clusters.ROUNDS, clusters.DIMS
    parts = [
        f"x AS (SELECT vec_id, list_transform(embedding, lambda c: floor({clusters.SCALE} * c::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dims})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{clusters.SEED}:' || vec_id)) - 1 AS j, v FROM x ORDER BY sha256('{clusters.SEED}:' || vec_id) LIMIT {k})",
    ]
    far = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    near = lambda i: f"a{i} AS (SELECT vec_id, v, min(struct_pack(d := d, j := j)) AS near FROM (SELECT x.vec_id, x.v, c.j, {far} AS d FROM x, c{i} AS c) GROUP BY vec_id, v)"
    for i in range(rounds):
        parts.append(near(i))
        parts.append(f"s{i} AS (SELECT near.j AS j, place, sum(c)::BIGINT AS total, count(*) AS n FROM (SELECT near, unnest(v) AS c, generate_subscripts(v, 1) AS place FROM a{i}) GROUP BY 1, 2)")
        parts.append(f"m{i} AS (SELECT j, list((total - ((total % n) + n) % n) // n ORDER BY place) AS v FROM s{i} GROUP BY j)")
        parts.append(f"c{i + 1} AS (SELECT j, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (j))")
    parts.append(near(rounds))
    return f"""WITH {", ".join(parts)}
SELECT vec_id, near.j::INTEGER AS cluster, near.d AS distance, (sum(near.d) OVER (PARTITION BY near.j))::BIGINT AS cluster_inertia, (sum(near.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON near.j = c{rounds}.j"""


def license_scan(threshold: float = licenses.THRESHOLD) -> str:
    """Every block's shared words with every template, counted; phrases as consecutive words."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    templates, sizes = [], []
    for t, (label, text) in enumerate(licenses.TEMPLATES):
        own = licenses.words(text)
        half, n = 1 << max(0, len(own) - 1).bit_length(), len(set(own))
        sizes.append(f"({t}, {quoted(label)}, {half}, {n}, {max(1, math.ceil(threshold * n - 1e-9))})")
        templates += [f"({t}, {quoted(w)})" for w in sorted(set(own))]
    phrases = [f"({quoted(label)}, [{', '.join(map(quoted, p.split()))}])" for p, label in licenses.PHRASES.items()]
    return f"""
WITH size(t, label, half, n, need) AS (VALUES {", ".join(sizes)}), template(t, word) AS (VALUES {", ".join(templates)}), phrase(label, ws) AS (VALUES {", ".join(phrases)}),
d AS (SELECT doc_id, regexp_extract_all({low}, '{licenses.WORD}') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS p FROM d),
places AS (SELECT doc_id, label, p FROM w JOIN phrase ON w.word = phrase.ws[1] JOIN d USING (doc_id) WHERE d.ws[p + 1 : p + len(phrase.ws)] = phrase.ws),
base AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list_distinct(list(label)) AS labels FROM places GROUP BY doc_id),
hit AS (SELECT DISTINCT doc_id, t, block, word FROM (SELECT doc_id, t, word, unnest(CASE WHEN p // half > 0 THEN [p // half - 1, p // half] ELSE [0] END) AS block FROM w JOIN template USING (word) JOIN size USING (t))),
met AS (SELECT doc_id, t, half, block, label, list(word) AS shared, count(*) / n AS share FROM hit JOIN size USING (t) GROUP BY doc_id, t, half, block, label, n, need HAVING count(*) >= need),
own AS (SELECT DISTINCT doc_id, label FROM met WHERE NOT EXISTS (SELECT 1 FROM met AS o WHERE o.doc_id = met.doc_id AND o.half * o.block < met.half * (met.block + 2) AND met.half * met.block < o.half * (o.block + 2) AND len(o.shared) > len(met.shared) AND list_has_all(o.shared, met.shared))),
m AS (SELECT doc_id, max(share) AS share, list_distinct(list(label)) AS labels FROM met GROUP BY doc_id), o AS (SELECT doc_id, list(label) AS labels FROM own GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(o.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score, array_to_string(list_sort(coalesce(m.labels, [])), ',') AS met_labels
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN o USING (doc_id)"""


def prefix_trie() -> str:
    """Each conversation's prefixes as lists, grouped; a subtree as what has the node's list as a prefix. crc32 bit by bit."""
    bits = "flatten(list_transform(range(1, length(s) + 1), lambda i: [ascii(s[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))"
    crc = f"xor(list_reduce({bits}, lambda a, b: {step}, 4294967295), 4294967295)"
    return f"""
WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % 100 AS base, {crc} % 6 AS h FROM (SELECT DISTINCT c, c::VARCHAR AS s FROM o)),
t AS (SELECT h.c, 0 AS part, o.i, role, text FROM h JOIN o ON o.c = h.base AND o.i < h.h UNION ALL SELECT h.c, 1, o.i, role, text FROM h JOIN o ON o.c = h.c AND o.i >= h.h),
r AS (SELECT h.c, coalesce(list(struct_pack(role := role, text := text) ORDER BY part, i) FILTER (text IS NOT NULL), []) AS turns FROM h LEFT JOIN t ON t.c = h.c GROUP BY h.c),
p AS (SELECT c, unnest(range(0, len(turns) + 1)) AS depth, turns FROM r),
q AS (SELECT c, depth, turns[1:depth] AS key, len(turns) = depth AS ends FROM p),
n AS (SELECT depth, key, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256, CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * length(key[depth].text) END AS saved FROM q GROUP BY depth, key),
k AS (SELECT n.*, up.conv_id AS parent_conv_id FROM n LEFT JOIN n AS up ON up.depth = n.depth - 1 AND up.key = n.key[1:n.depth - 1]),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM k WHERE depth > 0 GROUP BY 1, 2),
g AS (SELECT k.*, coalesce(n_children, 0) AS n_children FROM k LEFT JOIN kids USING (conv_id, depth)),
up AS (SELECT key, unnest(range(0, depth + 1)) AS above, saved, n_children FROM g),
s AS (SELECT above AS depth, key[1:above] AS key, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM up GROUP BY 1, 2)
SELECT conv_id::BIGINT AS conv_id, depth::BIGINT AS depth, parent_conv_id::BIGINT AS parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM g JOIN s USING (depth, key)"""
