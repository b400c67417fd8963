"""SQL texts for the queries that SQL can express, written from their rules."""

from __future__ import annotations

WORD = "[^\\x20\\x09-\\x0D]+"

OP2 = """
WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
marked AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\\\<#]', '', 'g')) + length(role) + length(regexp_replace(role, '[^\\\\<#:]', '', 'g')) + 14 AS chars FROM rows_)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

TOKENS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP5 = f"""
WITH it AS (SELECT item_id, {TOKENS} AS w FROM benchmark), iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM it WHERE len(w) > 0)),
dw AS (SELECT doc_id, {TOKENS} AS w FROM documents), sizes AS (SELECT DISTINCT n FROM iw),
dn AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM dw JOIN sizes ON len(w) >= n)),
hits AS (SELECT doc_id, dn.n, k, item_id FROM dn JOIN iw ON iw.win = dn.win AND iw.n = dn.n),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN places ON places.doc_id = dw.doc_id LEFT JOIN ids ON ids.doc_id = dw.doc_id
"""

OP6 = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, pos, line, [CASE WHEN regexp_matches(t, '[0-9@]') THEN '<*>' ELSE t END FOR t IN string_split_regex(line, '[ \\t\\r\\f\\x0B]+') IF t <> ''] AS w
  FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM l)),
long AS (SELECT doc_id, pos, w, len(w) AS n, w[1:3] AS lead FROM x WHERE len(w) >= 3),
leaf AS (SELECT n, lead FROM long GROUP BY n, lead HAVING count(*) >= 5),
lines AS (SELECT long.* FROM long JOIN leaf ON leaf.n = long.n AND leaf.lead = long.lead),
counts AS (SELECT n, lead, array_to_string(w, ' ') AS masked, count(*) AS c FROM lines GROUP BY ALL),
model AS (SELECT n, lead, string_split(arg_max(masked, (c, masked)), ' ') AS m FROM counts GROUP BY n, lead),
same AS (SELECT lines.*, m, len([1 FOR i IN range(1, len(w) + 1) IF w[i] = m[i]]) AS equal FROM lines JOIN model ON model.n = lines.n AND model.lead = lines.lead),
own AS (SELECT doc_id, pos, n, lead, CASE WHEN equal = n OR (equal >= 5 AND 100 * equal >= 75 * n) THEN m ELSE w END AS template FROM same),
often AS (SELECT n, lead, template, min((doc_id, pos)) AS first FROM own GROUP BY n, lead, template HAVING count(DISTINCT doc_id) >= 5),
gone AS (SELECT own.doc_id, own.pos FROM own JOIN often ON often.n = own.n AND often.lead = own.lead AND often.template = own.template WHERE (own.doc_id, own.pos) <> first),
left_ AS (SELECT x.doc_id, string_agg(line, chr(10) ORDER BY x.pos) FILTER (gone.pos IS NULL) AS kept, count(gone.pos) AS n_dropped FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.pos = x.pos GROUP BY x.doc_id)
SELECT l.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(n_dropped > 0 AND NOT regexp_matches(coalesce(kept, ''), '[^\\x20\\x09-\\x0D]'), false) AS emptied,
  md5(coalesce(kept, '')) AS text_md5
FROM l LEFT JOIN left_ ON left_.doc_id = l.doc_id
"""

OP9 = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
    greatest(0.05::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * coalesce((length(text) - length(translate(text, '#*$%&|<>', '')))::DOUBLE / nullif(length(text), 0)::DOUBLE, 0.0::DOUBLE)) AS quality,
    (CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM s),
lv AS (SELECT *, row_number() OVER o AS k, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WINDOW o AS (ORDER BY cap / weight, i)),
f AS (SELECT min(k) AS k0, arg_min(level, k) AS level0 FROM lv WHERE level * weight <= cap),
t AS (SELECT source, source_size, CASE WHEN k0 IS NULL OR k < k0 THEN cap ELSE level0 * weight END AS target FROM lv, f),
r AS (SELECT d.doc_id, size, source_size, target, coalesce(floor(target / nullif(source_size, 0)), 0) AS whole,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / quality, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN target - whole * source_size > 0 AND before + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""

def field(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR), '-')"


#: Parity of the CRC-32 of a number's decimals, bit by bit.
EVEN_CRC = """xor(list_reduce([4294967295] || [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')],
    lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 2 = 0"""

OP13 = f"""
WITH RECURSIVE d AS (SELECT *, sha256({field("doc_id")} || {field("source")} || {field("lang")} || {field("n_chars")} || {field("text")}) AS leaf,
    CASE WHEN {EVEN_CRC} THEN replace(text, chr(10), '') ELSE text END AS copy FROM documents),
p AS (SELECT *, sha256({field("doc_id")} || {field("source")} || {field("lang")} || {field("n_chars")} || {field("copy")}) AS claim,
    row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, row_number() OVER () AS doc FROM d),
s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM p)),
l AS (SELECT doc, doc_id, tree, pos, n, leaf, claim FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source),
nodes AS (SELECT tree, 0 AS level, pos AS idx, n AS width, leaf AS h FROM l
  UNION ALL SELECT tree, level + 1, idx // 3, (max(width) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE width > 1 GROUP BY tree, level, idx // 3),
sub AS (SELECT tree, level AS height, h FROM nodes WHERE width = 1),
top AS (SELECT 0 AS level, tree AS idx, count(*) OVER () AS width, h FROM sub
  UNION ALL SELECT level + 1, idx // 3, (max(width) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE width > 1 GROUP BY level, idx // 3),
steps AS (SELECT doc, level AS step, idx, h, idx < pos // CAST(pow(3, level) AS BIGINT) AS before
  FROM l JOIN nodes ON nodes.tree = l.tree AND nodes.width > 1 AND idx // 3 = pos // CAST(pow(3, level + 1) AS BIGINT)
  UNION ALL SELECT doc, height + level, idx, top.h, idx < l.tree // CAST(pow(3, level) AS BIGINT)
  FROM l JOIN sub ON sub.tree = l.tree JOIN top ON top.width > 1 AND idx // 3 = l.tree // CAST(pow(3, level + 1) AS BIGINT)),
sides AS (SELECT doc, step, string_agg(h, '' ORDER BY idx) FILTER (before) AS a, string_agg(h, '' ORDER BY idx) FILTER (NOT before AND NOT own) AS b
  FROM (SELECT steps.*, idx = CASE WHEN step < height THEN pos // CAST(pow(3, step) AS BIGINT) ELSE l.tree // CAST(pow(3, step - height) AS BIGINT) END AS own FROM steps JOIN l USING (doc) JOIN sub ON sub.tree = l.tree) GROUP BY doc, step),
fold AS (SELECT doc, 0 AS step, claim AS h FROM l
  UNION ALL SELECT fold.doc, fold.step + 1, sha256(coalesce(a, '') || h || coalesce(b, '')) FROM fold JOIN sides ON sides.doc = fold.doc AND sides.step = fold.step),
folded AS (SELECT doc, arg_max(h, step) AS folded_root FROM fold GROUP BY doc),
proofs AS (SELECT doc, sha256(string_agg(coalesce(a, '') || coalesce(b, ''), '' ORDER BY step)) AS proof FROM sides GROUP BY doc)
SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = top.h AS verified
FROM l JOIN sub ON sub.tree = l.tree JOIN top ON top.width = 1 JOIN folded USING (doc) LEFT JOIN proofs USING (doc)
"""

OP11 = """
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, m, w[k:k + m - 1] AS ws FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM p JOIN (VALUES (1), (2), (3)) t(m) ON len(w) >= m)),
f AS (SELECT lang, m, ws, count(*) AS f FROM g GROUP BY lang, m, ws HAVING count(*) >= 10),
cuts AS (SELECT c.lang, c.m, c.ws, c.f AS a, k, a.f AS l, b.f AS r, CAST(1000000::HUGEINT * c.f * c.f // (a.f::HUGEINT * b.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) c JOIN f a ON a.lang = c.lang AND a.ws = c.ws[1:k] JOIN f b ON b.lang = c.lang AND b.ws = c.ws[k + 1:]),
best AS (SELECT lang, m, ws, a, arg_min({'l': l, 'r': r, 'score': score}, (score, k)) AS s FROM cuts GROUP BY ALL),
inside AS (SELECT lang, ws, max(a) AS a FROM (SELECT lang, ws[1:2] AS ws, a FROM best WHERE m = 3 UNION ALL SELECT lang, ws[2:3], a FROM best WHERE m = 3) GROUP BY lang, ws),
kept AS (SELECT best.*, array_to_string(best.ws, ' ') AS phrase FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.ws = best.ws WHERE inside.a IS NULL OR 100 * inside.a < 50 * best.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY s.score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, s.l AS l, s.r AS r, n, s.score AS score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {"op2_reply_trees": OP2, "op5_decontamination": OP5, "op6_template_lines": OP6, "op9_source_mixing": OP9, "op11_phrase_quicksort": OP11, "op13_octopus_manifest": OP13}
