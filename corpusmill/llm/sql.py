"""DuckDB SQL for those queries that SQL can express."""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept
FROM n JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) m ON m.x = n.doc_id
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

COPIES = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII string: bit by bit, as DuckDB has no function for it."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ord(substr({text}, CAST(i AS INTEGER), 1)) AS BIGINT))"
    step = "list_reduce(range(8), lambda b, y: xor(b >> 1, CAST(3988292384 AS BIGINT) * (b & 1)), xor(a, x))"
    return f"xor(list_reduce({codes}, lambda a, x: {step}, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


def _field(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


PROOFS = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
    CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS claimed
  FROM documents),
l AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS row_no
  FROM d),
low(tree, level, place, n, h) AS (
  SELECT tree, 0, place, n, leaf FROM l
  UNION ALL
  SELECT tree, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM low WHERE n > 1 GROUP BY tree, level, place // 2, n),
trees AS (SELECT tree, h, count(*) OVER () AS m FROM low WHERE n = 1),
top(level, place, n, h) AS (
  SELECT 0, tree, m, h FROM trees
  UNION ALL
  SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM top WHERE n > 1 GROUP BY level, place // 2, n),
-- Each level with several nodes is a step; its sibling, marked by the side on which it stands, or nothing.
heights AS (SELECT DISTINCT tree, level FROM low WHERE n > 1),
steps AS (
  SELECT l.row_no, k.level AS step, l.place >> k.level & 1 AS odd, s.h
  FROM l JOIN heights k ON k.tree = l.tree LEFT JOIN low s ON s.tree = l.tree AND s.level = k.level AND s.place = xor(l.place >> k.level, 1)
  UNION ALL
  SELECT l.row_no, 1000 + k.level, l.tree >> k.level & 1, s.h
  FROM l CROSS JOIN (SELECT DISTINCT level FROM top WHERE n > 1) k LEFT JOIN top s ON s.level = k.level AND s.place = xor(l.tree >> k.level, 1)),
proofs AS (
  SELECT row_no, sha256(coalesce(string_agg(h, '' ORDER BY step), '')) AS proof, list(CASE WHEN h IS NULL THEN 'N' WHEN odd = 1 THEN 'L' || h ELSE 'R' || h END ORDER BY step) AS path
  FROM steps GROUP BY row_no),
folded AS (
  SELECT l.*, coalesce(p.proof, sha256('')) AS proof, list_reduce(coalesce(p.path, []),
    lambda a, x: CASE x[1] WHEN 'N' THEN sha256(a) WHEN 'L' THEN sha256(x[2:] || a) ELSE sha256(a || x[2:]) END, claimed) AS fold
  FROM l LEFT JOIN proofs p USING (row_no))
SELECT f.doc_id, f.leaf, t.h AS subroot, r.h AS root, f.proof AS proof_sha256, f.fold AS folded_root, f.fold = r.h AS verified
FROM folded f JOIN trees t USING (tree) CROSS JOIN (SELECT h FROM top WHERE n = 1) r
"""

REPAIRS = rf"""
WITH RECURSIVE filled AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
kinds AS (SELECT *, {_crc32("k")} % 20 AS kind FROM filled),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds CROSS JOIN (VALUES (1), (2)) c(copy) WHERE kind > 0 AND (copy = 1 OR kind = 3)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM damaged),
marked AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again, lag(role) OVER (PARTITION BY conv_id ORDER BY place) AS before
  FROM ordered),
r AS (
  SELECT conv_id, turn, role, text, place, blank, again AND NOT blank AS duplicate, cut AND NOT blank AND NOT again AS truncated,
    coalesce(left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AND place > 0, false) AS illegal,
    CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS kind
  FROM marked),
-- What stands after none, system, user, assistant (0 to 3) and some inserted turns; one due role follows each.
chains(last, inserts, then_, due) AS (VALUES (0, 0, 0, 2), (0, 1, 2, 3), (0, 2, 3, 2), (1, 0, 1, 2), (1, 1, 2, 3), (1, 2, 3, 2), (2, 0, 2, 3), (2, 1, 3, 2), (2, 2, 2, 3), (3, 0, 3, 2), (3, 1, 2, 3), (3, 2, 3, 2)),
ways(conv_id, place, last, way) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, {{'cost': CAST(0 AS BIGINT), 'audit': ''}} FROM r
  UNION ALL
  SELECT w.conv_id, w.place + 1, CASE e.edit WHEN 'D' THEN c.then_ WHEN 'K' THEN r.kind ELSE c.due END AS last, min({{
      'cost': CAST(w.way.cost + 2 * c.inserts + CASE e.edit WHEN 'D' THEN 3 WHEN 'K' THEN 0 ELSE 2 END + CASE WHEN e.edit <> 'D' AND r.truncated THEN 1 ELSE 0 END AS BIGINT),
      'audit': w.way.audit || repeat('I', c.inserts) || e.edit}})
  FROM ways w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.place = w.place JOIN chains c ON c.last = w.last CROSS JOIN (VALUES ('D'), ('K'), ('R')) e(edit)
  WHERE e.edit = 'D' OR NOT r.blank AND NOT r.duplicate AND (e.edit = 'R' OR r.kind = c.due OR r.kind = 1 AND c.then_ = 0)
  GROUP BY w.conv_id, w.place, CASE e.edit WHEN 'D' THEN c.then_ WHEN 'K' THEN r.kind ELSE c.due END),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM r GROUP BY conv_id),
best AS (
  SELECT w.conv_id, min({{'cost': w.way.cost + 2 * c.inserts, 'audit': w.way.audit || repeat('I', c.inserts)}}) AS way
  FROM ways w JOIN counts n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.place JOIN chains c ON c.last = w.last
  WHERE c.then_ IN (0, 3) GROUP BY w.conv_id),
-- An edit's row is the number of edits before it that take one; its role is due by its place among what stays.
edits AS (SELECT conv_id, way.audit AS audit, unnest(range(1, length(way.audit) + 1)) AS i FROM best),
letters AS (
  SELECT conv_id, i, audit[i] AS edit, length(replace(left(audit, i - 1), 'I', '')) AS place, length(replace(left(audit, i - 1), 'D', '')) AS stay FROM edits),
stays AS (
  SELECT l.conv_id, l.i, l.edit, l.stay, r.role, r.text,
    max(CASE WHEN l.stay = 0 AND l.edit = 'K' AND r.kind = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS opened
  FROM letters l LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.place = l.place AND l.edit <> 'I' WHERE l.edit <> 'D'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (stay - opened) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY i) AS repaired
  FROM stays GROUP BY conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
  coalesce(c.illegal, 0) AS illegal, coalesce(b.way.cost, 0) AS cost, coalesce(b.way.audit, '') AS audit, sha256(coalesce(t.repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""
