"""DuckDB SQL with the same results as the registered queries that SQL can express.

The network of op4, the edit join of op5 and the automaton's labels of op6 have no SQL form; tests hold these against
brute force.
"""

NGRAM_JACCARD = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(
    range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' ')))) END AS s
  FROM texts
), classes AS (
  SELECT min(doc_id) AS rep, s FROM sets WHERE len(s) > 0 GROUP BY s
), cells AS (
  SELECT rep, len(s) AS n, unnest(s) AS shingle FROM classes
), links AS (
  SELECT a.rep AS a, b.rep AS b FROM cells a JOIN cells b ON a.shingle = b.shingle AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(node, other) AS (
  SELECT rep, rep FROM classes
  UNION
  SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other
), components AS (
  SELECT node, min(other) AS component FROM reach GROUP BY node
)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component, sets.doc_id) AS component_id
FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN components ON components.node = classes.rep
"""

# The patterns of ``secrets.KINDS`` and ``OWN_KINDS``, with their ranks and least lengths.
SECRET_SCAN = r"""
WITH kinds(rank, kind, pattern, least) AS (VALUES
  (0, 'assign', '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+', 6),
  (1, 'access', 'AKIA[A-Z0-9]+', 20),
  (2, 'hex', '[0-9a-f]+', 24),
  (3, 'prefixed', '(?:gh[opsur]_|glpat-|xox[abprs]-|sk-|sk_live_|AIza)[A-Za-z0-9_-]{16,}', 1),
  (4, 'jwt', 'eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', 1),
  (5, 'pem', '-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\x0A\x0D\\]*', 16),
  (6, 'bearer', '[Bb][Ee][Aa][Rr][Ee][Rr]\x20+[A-Za-z0-9+/_.=-]{20,}', 1)
), rows AS (
  SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text FROM documents
), matches AS (
  SELECT id, doc_id, source, rank, kind, least, regexp_extract_all(text, pattern) AS m, regexp_split_to_array(text, pattern) AS p
  FROM rows, kinds WHERE regexp_matches(text, pattern)
), places AS (
  SELECT id, doc_id, source, rank, kind, least, unnest(m) AS m, unnest(list_transform(p[: len(m)], lambda x: length(x))) AS gap,
    generate_subscripts(m, 1) AS i
  FROM matches
), spans AS (
  SELECT id, doc_id, source, rank, kind, least, m, stop - length(m) AS start, stop
  FROM (SELECT *, sum(gap + length(m)) OVER (PARTITION BY id, rank ORDER BY i) AS stop FROM places)
), vals AS (
  SELECT *, CASE WHEN rank = 0 THEN regexp_extract(m, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)
    WHEN rank = 6 THEN regexp_extract(m, '^.{6}\x20+(.*)$', 1)
    WHEN rank = 5 THEN regexp_replace(m, '^.*PRIVATE KEY-----|[\x0A\x0D\\]', '', 'g') ELSE m END AS v
  FROM spans
), kept AS (
  SELECT * FROM vals WHERE length(v) >= least
), owners AS (
  SELECT v, count(*) AS n FROM (SELECT DISTINCT v, source FROM kept) GROUP BY v
), repositories AS (
  SELECT v, count(*) AS held FROM (SELECT DISTINCT v, doc_id FROM kept) GROUP BY v
), judged AS (
  SELECT id, rank, kind, start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span, n < 3 AND held < 50 AS live, n, held
  FROM kept JOIN owners USING (v) JOIN repositories USING (v)
), found AS (
  SELECT id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
    string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3 OR live) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied, max(n) AS most_owners, max(held) AS most_repositories
  FROM judged GROUP BY id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
  coalesce(n_copied, 0) AS n_copied, coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories
FROM rows LEFT JOIN found USING (id)
"""

WARC = """
WITH payloads AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""

BLOCK_NEIGHBOURS = """
WITH vectors AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), usable AS (
  SELECT vec_id, v FROM vectors
  WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score
  FROM usable q JOIN usable c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""

MIX_SOURCES = r"""
WITH docs AS (
  SELECT *, count(*) OVER (PARTITION BY source, class) AS n FROM (
    SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS class FROM (
      SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 8) AS BIGINT) AS lot
      FROM documents))
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source
), weighed AS (
  SELECT source, source_size, source_size * 3.0::DOUBLE AS cap, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM sizes
), sums AS (
  SELECT *, cap / weight AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(weight) OVER () AS all_weight,
    sum(cap) OVER upto AS caps, sum(weight) OVER upto AS weights
  FROM weighed WINDOW upto AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), levels AS (
  SELECT *, (total - (caps - cap)) / (all_weight - weights + weight) AS level FROM sums
), opened AS (
  SELECT *, max(CASE WHEN ratio > level THEN level END) OVER () AS opening FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN opening IS NULL OR ratio <= level THEN cap ELSE weight * opening END AS target FROM opened
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
    CAST(CAST('0x' || substr(md5('mix:' || CASE WHEN source IS NULL THEN '1' ELSE '0' || source END), 1, 5) AS BIGINT) AS DOUBLE) / 1048576.0::DOUBLE AS start
  FROM targets
), ranked AS (
  SELECT docs.doc_id, docs.size, rates.source_size, rates.target, rates.rate, rates.start, row_number() OVER (
      PARTITION BY docs.source ORDER BY class, lot % CAST(ceil(n / 4096.0) AS BIGINT), size, doc_id NULLS LAST) AS rank
  FROM docs JOIN rates ON docs.source IS NOT DISTINCT FROM rates.source
)
SELECT doc_id, size, source_size, target,
  least(CAST(floor(start + rank * rate) - floor(start + (rank - 1) * rate) AS BIGINT), 3) * size AS taken
FROM ranked
"""

DECONTAMINATE = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE doc_id IS NOT NULL
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM windows
), starts AS (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size
), found AS (
  SELECT doc_id, i, s.size, item_id FROM starts s
  JOIN windows ON windows.size = s.size AND windows.win = array_to_string(s.w[s.i : s.i + s.size - 1], ' ')
), hits AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM found) GROUP BY doc_id
), owned AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
), counted AS (
  SELECT doc_id, max(CAST(len(w) AS BIGINT)) AS n_words FROM docs GROUP BY doc_id
)
SELECT doc_id, n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM counted LEFT JOIN hits USING (doc_id) LEFT JOIN owned USING (doc_id)
"""

# The template of ``chat_tree``: an escaped role and text between marks.
CHAT_TREE = r"""
WITH turns AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), rendered AS (
  SELECT *, length('<turn role=' || replace(replace(role, '\', '\\'), '>', '\>') || '>') + 1
    + length(replace(replace(replace(text, '\', '\\'), '<turn', '\<turn'), '</turn', '\</turn')) + length('</turn>') + 1 AS chars
  FROM turns
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS spelled,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
  FROM rendered GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(spelled) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars
FROM whole
"""

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": NGRAM_JACCARD,
    "op2_secret_scan": SECRET_SCAN,
    "op3_warc": WARC,
    "op7_block_neighbours": BLOCK_NEIGHBOURS,
    "op8_mix_sources": MIX_SOURCES,
    "op9_decontaminate": DECONTAMINATE,
    "op10_chat_tree": CHAT_TREE,
}
