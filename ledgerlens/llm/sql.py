"""DuckDB twins of the queries that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP8 = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
  row_number() OVER (ORDER BY source NULLS LAST) AS k, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
c AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT *, coalesce(max(CASE WHEN level >= 0 AND level * weight <= cap THEN level END) OVER (), max(cap / weight) OVER ()) AS lv FROM c),
t AS (SELECT source, source_size, least(cap, lv * weight) AS target, ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST) AS i FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(i * rate + u) - floor((i - 1) * rate + u)))::BIGINT AS taken FROM r
"""

OP10 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id NULLS LAST)
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("text, ''", _LOWER + ", ''")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS m FROM d),
e AS (SELECT doc_id, len(m) AS n, unnest(m) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, len(m)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON s.doc_id = c.a
"""

OP7 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x FROM p),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS m FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM f WHERE m < doc_id),
a AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM a ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""

OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT *, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS top FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to FROM m
"""

OP9_PAIRS = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
b AS (SELECT doc_id, i, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM t),
u AS (SELECT word, count(*) AS c FROM t GROUP BY word),
g AS (SELECT prev, word, count(*) AS c FROM b WHERE prev IS NOT NULL GROUP BY prev, word HAVING count(*) >= 2),
s AS (SELECT b.doc_id, CASE WHEN b.prev IS NULL THEN ln(u.c / n.n) WHEN g.c IS NOT NULL THEN ln(g.c / p.c) ELSE ln(u.c / n.n) + ln(0.4) END AS x
  FROM b JOIN u USING (word) LEFT JOIN g ON g.prev = b.prev AND g.word = b.word LEFT JOIN u p ON p.word = b.prev CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM t) n),
a AS (SELECT doc_id, sum(x) AS x FROM s GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(x, 0.0), 4) AS log_score, CASE WHEN len(w) > 0 THEN round(x / len(w), 6) END AS mean_log_score FROM d LEFT JOIN a USING (doc_id)
"""

#: As OP9_PAIRS, with three words in a row where they stand there twice or more.
OP9 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
b AS (SELECT doc_id, i, word, lag(word) OVER v AS prev, lag(word, 2) OVER v AS prev2 FROM t WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
u AS (SELECT word, count(*) AS c FROM t GROUP BY word),
g AS (SELECT prev, word, count(*) AS c FROM b WHERE prev IS NOT NULL GROUP BY prev, word HAVING count(*) >= 2),
h AS (SELECT prev2, prev, word, count(*) AS c FROM b WHERE prev2 IS NOT NULL GROUP BY prev2, prev, word HAVING count(*) >= 2),
s AS (SELECT b.doc_id, CASE WHEN h.c IS NOT NULL THEN ln(h.c / q.c) ELSE CASE WHEN b.prev2 IS NULL THEN 0.0 ELSE ln(0.4) END
  + CASE WHEN b.prev IS NULL THEN ln(u.c / n.n) WHEN g.c IS NOT NULL THEN ln(g.c / p.c) ELSE ln(u.c / n.n) + ln(0.4) END END AS x
  FROM b JOIN u USING (word) LEFT JOIN g ON g.prev = b.prev AND g.word = b.word LEFT JOIN u p ON p.word = b.prev
  LEFT JOIN h ON h.prev2 = b.prev2 AND h.prev = b.prev AND h.word = b.word LEFT JOIN g q ON q.prev = b.prev2 AND q.word = b.prev
  CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM t) n),
a AS (SELECT doc_id, sum(x) AS x FROM s GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(x, 0.0), 4) AS log_score, CASE WHEN len(w) > 0 THEN round(x / len(w), 6) END AS mean_log_score FROM d LEFT JOIN a USING (doc_id)
"""



def _op11(k: int = 8, rounds: int = 10) -> str:
    distance = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT"
    nearest = (f"SELECT v.row, arg_min(c.cluster, (d, c.cluster)) AS cluster, min(d) AS distance FROM (SELECT v.row, c.cluster, {distance} AS d FROM v CROSS JOIN %s c) AS c JOIN v USING (row) GROUP BY v.row")
    parts = [r"""v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::INT AS cluster, x FROM v ORDER BY sha256('3:' || vec_id) LIMIT {k})"]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({nearest % f'c{r}'})")
        parts.append(f"""s{r} AS MATERIALIZED (SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v.x) AS x, unnest(range(1, 65)) AS i FROM a{r} JOIN v USING (row)) GROUP BY cluster, i)""")
        parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{r} GROUP BY cluster) m USING (cluster))""")
    return f"""WITH {", ".join(parts)}, f AS MATERIALIZED ({nearest % f'c{rounds}'})
SELECT v.vec_id, f.cluster, f.distance, sum(f.distance) OVER (PARTITION BY f.cluster)::BIGINT AS cluster_inertia, sum(f.distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM f JOIN v USING (row) JOIN c{rounds} c USING (cluster)"""


OP11 = _op11()

ORACLES = {"op11_centroids": OP11, "op5_warc": OP5, "op9_lm_score": OP9, "op6_near_dedup": OP6, "op7_substring_dedup": OP7, "op8_mixing": OP8, "op10_exact_dedup": OP10}

#: Of the queries in ``queries.FURTHER``.
FURTHER_ORACLES = {"op9_lm_score_pairs": OP9_PAIRS}
