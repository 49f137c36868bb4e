"""DuckDB SQL of the queries that SQL can express over whole tables.

The others (64-bit shingle hashes, byte-pair merges, fitted models and scans
with learnt cut-offs) are tested against plain Python in ``tests/llm``.
"""

_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
p AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT *, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS s FROM i WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT m FROM p),
g AS (
  SELECT doc_id, m, s, array_to_string(w[s : s + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS s FROM d, lengths WHERE len(w) >= m)
),
found AS (SELECT doc_id, s, g.m, item FROM g JOIN p USING (m, g)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(generate_series(s, s + m - 1)) AS k FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_SUBSTRINGS = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS s FROM d WHERE len(w) >= 20)
),
later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS nth FROM g) WHERE nth > 1
),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS k FROM later),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY 1
)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
             list_transform(string_split(sha1(h), ''), lambda c: instr('0123456789abcdef', c) - 1) AS d FROM p),
y AS (
  SELECT page_id, payload_bytes, list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((d[5 * i // 4 + 1] * 16 + d[5 * i // 4 + 2]) >> (3 - 5 * i % 4)) & 31) + 1, 1)) AS b
  FROM x
),
r AS (SELECT page_id, payload_bytes, array_to_string(b, '') AS payload_digest FROM y),
l AS (SELECT payload_digest, max(page_id) AS latest FROM r GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN latest IS NOT NULL AND page_id IS DISTINCT FROM latest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM latest THEN latest END AS refers_to
FROM r JOIN l USING (payload_digest)
"""

_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
    AND len(list_filter(embedding, lambda y: y <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.98
),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(least(vec_id, low.b), vec_id) AS component_id,
       coalesce(least(vec_id, low.b), vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.a = vec_id
"""



def _codes() -> str:
    """Product codes: whole numbers below 2^53 throughout, so DOUBLE products
    are exact."""
    assigned = """a{k} AS (
  SELECT vec_id, p, min(CAST(list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c) AS BIGINT) * 64 + e) AS m
  FROM x JOIN b{k} USING (p) GROUP BY ALL
)"""
    moved = """b{n} AS (
  SELECT p, e, coalesce(c2, c) AS c FROM b{k} LEFT JOIN (
    SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS c2
    FROM (
      SELECT p, m % 64 AS e, i, sum(CAST(v[i] AS BIGINT)) AS s, count(*) AS n
      FROM (SELECT *, unnest(generate_series(1, len(v))) AS i FROM x JOIN a{k} USING (vec_id, p)) GROUP BY ALL
    ) GROUP BY ALL
  ) USING (p, e)
)"""
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda y: floor(256 * CAST(y AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
),
x AS (SELECT vec_id, p, q[p * len(q) // 16 + 1 : (p + 1) * len(q) // 16] AS v FROM kept, range(16) AS t(p)),
b0 AS (SELECT p, e, v AS c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) USING (vec_id) WHERE e < 64),
{assigned.format(k=0)}, {moved.format(k=0, n=1)}, {assigned.format(k=1)}, {moved.format(k=1, n=2)}, {assigned.format(k=2)},
coded AS (
  SELECT vec_id, lower(string_agg(printf('%02x', m % 64), '' ORDER BY p)) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a2 GROUP BY 1
),
books AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, unnest(c) AS y, generate_subscripts(c, 1) AS i FROM b2))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM coded JOIN kept USING (vec_id), books
"""


_DIVERGENCE = """
WITH d AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
),
t AS (SELECT lang, source, term, count(*) AS c, count(DISTINCT d) AS docs FROM (SELECT *, unnest(w) AS term FROM d) GROUP BY ALL),
l AS (SELECT lang, term, CAST(sum(c) AS BIGINT) AS c FROM t GROUP BY ALL HAVING sum(docs) >= 3),
ln AS (SELECT lang, count(*) AS v, CAST(sum(c) AS BIGINT) AS n FROM l GROUP BY ALL),
g AS (
  SELECT lang, source, CAST(coalesce(sum(c), 0) AS BIGINT) AS n
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT t.lang, t.source, t.c FROM t JOIN l USING (lang, term)) USING (lang, source) GROUP BY ALL
),
p AS (
  SELECT lang, source, term, coalesce(t.c, 0) AS c, 1 + 1000000000 * (coalesce(t.c, 0) + 1) // (g.n + v) AS p, 1 + 1000000000 * (l.c + 1) // (ln.n + v) AS q
  FROM g JOIN l USING (lang) JOIN ln USING (lang) LEFT JOIN t USING (lang, source, term)
),
pairs AS (
  SELECT lang, source, item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source)
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  ) USING (lang, source, item)
),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE c > 0 AND p > q),
ranked AS (
  SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT *, 'pair' AS part FROM pairs UNION ALL BY NAME SELECT *, 'term' AS part FROM terms)
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""



def _chats() -> str:
    """Formatted length: both parts, the three marks of a turn, and one escape
    for each control string and escape inside."""
    from flowtally.llm.chat_format import BODY, CONTROL, END, ESCAPE, TURN

    inside = " + ".join(f"(len({{0}}) - len(replace({{0}}, '{c}', ''))) // {len(c)}" for c in (*CONTROL, ESCAPE))
    grown = " + ".join(f"len({c}) + {inside.format(c)}" for c in ("role", "text"))
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(k, r)
),
s AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss, {len(TURN + BODY + END)} + {grown} AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(len(loss)) AS BIGINT) AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM s GROUP BY 1
"""


ORACLE_SQL = {
    "op2_warc": _WARC,
    "op3_decontamination": _DECONTAMINATION,
    "op6_embedding_dedup": _VECTORS,
    "op8_substring_dedup": _SUBSTRINGS,
    "op11_vector_codes": _codes(),
    "op12_source_divergence": _DIVERGENCE,
    "op13_chat_format": _chats(),
}
