"""DuckDB SQL that gives the same rows as the queries."""

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

SHINGLES = """SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w"""


def near_duplicates(docs: str = "documents", percent: int = 85) -> str:
    """CTEs up to `nd` (doc_id, n_shingles, component_id)."""
    return f"""w AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM {docs}),
s AS MATERIALIZED ({SHINGLES}),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
least_of AS (SELECT a, min(b) AS b FROM r GROUP BY a),
nd AS (SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(least_of.b, d.doc_id)) AS component_id
  FROM {docs} d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_of ON least_of.a = d.doc_id)"""


NEAR_DUPLICATES = f"WITH RECURSIVE {near_duplicates()} SELECT *, doc_id = component_id AS kept FROM nd"

LOWER_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+')"


def contaminated(docs: str = "documents", items: str = "benchmark") -> str:
    """CTEs up to `hit` (doc_id, item_id, item_shingles, shared, containment)."""
    split = SHINGLES.replace("FROM w", "FROM {}")
    return f"""dw AS (SELECT doc_id, {LOWER_WORDS} AS w FROM {docs}),
bw AS (SELECT item_id AS doc_id, {LOWER_WORDS} AS w FROM {items}),
bs AS MATERIALIZED ({split.format("bw")}),
bn AS (SELECT doc_id, count(*) AS n FROM bs GROUP BY doc_id),
ds AS MATERIALIZED (SELECT * FROM ({split.format("dw")}) WHERE sh IN (SELECT sh FROM bs)),
hit AS (SELECT ds.doc_id, bs.doc_id AS item_id, any_value(n) AS item_shingles, count(*) AS shared, count(*) / any_value(n) AS containment
  FROM ds JOIN bs ON ds.sh = bs.sh JOIN bn ON bn.doc_id = bs.doc_id GROUP BY ds.doc_id, bs.doc_id HAVING count(*) / any_value(n) >= 0.8)"""


CONTAMINATED = f"WITH {contaminated()} SELECT doc_id, item_id, item_shingles, shared, containment FROM hit"

CHATS = r"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
c AS (SELECT conv_id, count(*) AS n_turns, bool_or(contains(text, '</turn>') OR contains(role, '</turn>') OR contains(role, ': ')) AS esc,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length(role) + length(text) + 19) AS raw_chars,
    sum(4 + 2 * length(text) - length(replace(replace(text, '\', ''), '<', '')) - length(text)
      + 2 * length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), ':', '')) - length(role)) AS more_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(CASE WHEN esc THEN raw_chars + more_chars ELSE raw_chars END AS BIGINT) AS formatted_chars
FROM c"""

ARCHIVE = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
k AS (SELECT html, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY html)
SELECT page_id, payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k ON k.html = p.html"""

EXACT_DUPLICATES = r"""WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
r AS (SELECT doc_id, h, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM t
  WINDOW w AS (PARTITION BY h ORDER BY points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, h AS text_sha256 FROM r"""


def centroids(rounds: int = 5) -> str:
    """Clusters of whole vectors; c0, c1, ... are the centroids of each round."""
    assign = """a{k} AS MATERIALIZED (SELECT r, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d FROM (
  SELECT v.r, m.c, CAST(list_sum(list_transform(list_zip(v.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{k} m) GROUP BY r)"""
    move = """c{n} AS MATERIALIZED (SELECT m.c, coalesce(f.v, m.v) AS v FROM c{k} m LEFT JOIN (SELECT c, list(q ORDER BY i) AS v FROM (
    SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS q FROM (SELECT a{k}.c, i, CAST(sum(v.v[i]) AS BIGINT) AS s, count(*) AS n FROM a{k} JOIN v USING (r), range(1, 65) t(i) GROUP BY ALL)) GROUP BY c) f ON f.c = m.c)"""
    steps = [x for k in range(rounds) for x in (assign.format(k=k), move.format(k=k, n=k + 1))] + [assign.format(k=rounds)]
    return """WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT v, sha256('2:' || vec_id) AS h FROM v ORDER BY h LIMIT 40)),
""" + ",\n".join(steps) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} m ON m.c = a.c"""


CENTROIDS = centroids()
