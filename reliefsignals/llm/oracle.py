"""DuckDB SQL for the registered queries that SQL can express.

The others are tested against brute force, exact round trips or held-out accuracy
(``tests/llm``): trained models, sketches, checksums and passages byte by byte are not for SQL.
"""

from __future__ import annotations

from reliefsignals.llm import audit, licences, merkle, mixing

_RATES = f"""
counts AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {mixing.TEMPERATURE}::DOUBLE) AS weight FROM documents GROUP BY source),
sums AS (SELECT sum(weight) AS weights, sum(n)::DOUBLE AS total FROM counts),
rates AS (SELECT source, total * weight / weights / n::DOUBLE AS rate FROM counts, sums),
parts AS (SELECT source, ceil(rate / {mixing.PART})::INT AS parts, rate / ceil(rate / {mixing.PART}) AS r FROM rates),
cdf AS (
  SELECT source, parts, list_transform(range(0, (ceil(r + 10 * sqrt(r) + 20))::BIGINT + 1), lambda k: list_sum(
    list_transform(range(0, k + 1), lambda j: exp(-r + j * ln(r) - lgamma(j + 1))))) AS c FROM parts)
"""

_MIXING = f"""
WITH {_RATES},
drawn AS (
  SELECT d.*, list_sum(list_transform(range(1, parts + 1), lambda p: len(list_filter(c, lambda x:
    x <= ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || p), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
  )))) AS m
  FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source),
rows AS (SELECT doc_id, source, unnest(range(1, m::BIGINT + 1))::INT AS copy, lang, n_chars, text FROM drawn WHERE m > 0)
SELECT doc_id, source, copy, md5('{mixing.SEED}:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy) AS mix_key, lang, n_chars, text FROM rows
"""

_CONTAMINATION = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') FROM benchmark),
runs AS (SELECT DISTINCT least(len(w), 5) AS k FROM words WHERE side = 'i' AND len(w) > 0),
shingles AS (
  SELECT DISTINCT side, id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM words JOIN runs ON len(w) >= k AND (side = 'd' OR k = least(len(w), 5))),
sizes AS (SELECT id, count(*) AS n_item FROM shingles WHERE side = 'i' GROUP BY id),
shared AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
  FROM shingles d JOIN shingles i ON d.s = i.s AND d.side = 'd' AND i.side = 'i' GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared::DOUBLE / n_item::DOUBLE AS containment
FROM shared JOIN sizes ON item_id = sizes.id WHERE n_shared >= 0.75 * n_item
"""

_JACCARD = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(s) AS n FROM (SELECT doc_id FROM documents) d LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * m >= 75 * (x.n + y.n - m)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sizes
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, n AS n_shingles, (SELECT min(b) FROM reach WHERE a = doc_id) AS component_id FROM sizes
"""


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)


_LICENCES = rf"""
WITH known(id, sentence) AS (VALUES {_values(list(licences.SENTENCES.items()))}),
rules(rule, licence, pattern, n_sentences, head) AS (
  VALUES {_values([(n, x, f",{','.join(map(str, ids))},", len(ids), ids[0]) for n, x, ids in licences.RULES])}),
cut AS (
  SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?;:])\s+', '\1' || chr(1), 'g'), '\x01|\n\s*\n') AS all_s FROM documents),
numbered AS (SELECT doc_id, unnest(range(0, len(all_s))) AS i, unnest(all_s) AS s FROM cut),
lined AS (SELECT doc_id, i, CASE WHEN contains(s, chr(10)) THEN list_concat([s], string_split(s, chr(10))) ELSE [s] END AS l FROM numbered),
lines AS (SELECT doc_id, i, unnest(range(0, len(l))) AS j, unnest(l) AS s FROM lined),
plain AS (
  SELECT doc_id, i, j, regexp_replace(regexp_replace(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')), '{licences.COPYRIGHT}', 'copyright notice'),
    '{licences.HOLDER}', '{licences.ANY_HOLDER}') AS sentence
  FROM lines),
hits AS (SELECT DISTINCT doc_id, i, j, id FROM plain JOIN known USING (sentence)),
stepped AS (SELECT *, lag(id) OVER (PARTITION BY doc_id ORDER BY i, j, id) AS before FROM hits),
sequences AS (
  SELECT doc_id, ',' || string_agg(id::VARCHAR, ',' ORDER BY i, j, id) || ',' AS sequence
  FROM stepped WHERE before IS DISTINCT FROM id GROUP BY doc_id),
firsts AS (SELECT doc_id, id, min(i) AS first_sentence FROM hits GROUP BY ALL),
matched AS (
  SELECT s.doc_id, r.*, f.first_sentence::INT AS first_sentence FROM sequences s JOIN rules r ON contains(s.sequence, r.pattern)
  JOIN firsts f ON f.doc_id = s.doc_id AND f.id = r.head)
SELECT doc_id, rule, licence, n_sentences::INT AS n_sentences, first_sentence FROM matched m
WHERE NOT EXISTS (
  SELECT 1 FROM matched o WHERE o.doc_id = m.doc_id AND o.n_sentences > m.n_sentences AND contains(o.pattern, m.pattern))
"""

_LEAF = " || ".join(
    f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END" for c in ("doc_id", "source", "lang", "n_chars")
)
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0})::VARCHAR || ':' || {0} END"

#: CRC-32 of short ASCII texts, bit by bit: eight steps for each byte.
_CRC = """
crc(k, i, c) AS (
  SELECT DISTINCT doc_id::VARCHAR, 0, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT k, i + 1, list_reduce(list_prepend(xor(c, ascii(k[i + 1])::BIGINT), range(8)),
    lambda x, s: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)
  FROM crc WHERE i < length(k)),
tampered AS (SELECT k FROM crc WHERE i = length(k) AND xor(c, 4294967295::BIGINT) % 5 = 0)
"""

# A node's key is tree, level and place; the lowest nodes of tree -1 are the subroots of trees 0, 1, ...
_MERKLE = rf"""
WITH RECURSIVE {_CRC},
rows AS (
  SELECT doc_id, source, sha256({_LEAF} || {_FIELD.format('text')}) AS leaf,
    CASE WHEN doc_id::VARCHAR IN (FROM tampered) THEN sha256({_LEAF} || {_FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS changed
  FROM documents),
leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST)::BIGINT - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
  FROM rows),
below(tree, level, idx, n, hash) AS (
  SELECT tree, 0, idx, n, leaf FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // {merkle.FAN}, (any_value(n) + {merkle.FAN - 1}) // {merkle.FAN}, sha256(string_agg(hash, '' ORDER BY idx))
  FROM below WHERE n > 1 GROUP BY tree, level, idx // {merkle.FAN}),
subroots AS (SELECT tree, hash FROM below WHERE n = 1),
above(level, idx, n, hash) AS (
  SELECT 0, tree, (SELECT count(*) FROM subroots), hash FROM subroots
  UNION ALL
  SELECT level + 1, idx // {merkle.FAN}, (any_value(n) + {merkle.FAN - 1}) // {merkle.FAN}, sha256(string_agg(hash, '' ORDER BY idx))
  FROM above WHERE n > 1 GROUP BY level, idx // {merkle.FAN}),
nodes AS (
  SELECT tree, level, idx, hash, tree AS up_tree, idx // {merkle.FAN} AS run FROM below WHERE n > 1
  UNION ALL SELECT -1, level, idx, hash, -1, idx // {merkle.FAN} FROM above WHERE n > 1),
steps(row, step, tree, level, idx, n) AS (
  SELECT struct_pack(doc_id, leaf), 0, CASE WHEN n = 1 THEN -1 ELSE tree END, 0, CASE WHEN n = 1 THEN tree ELSE idx END,
    CASE WHEN n = 1 THEN (SELECT count(*) FROM subroots) ELSE n END FROM (SELECT DISTINCT doc_id, leaf, tree, idx, n FROM leaves)
  UNION ALL
  SELECT row, step + 1, CASE WHEN tree >= 0 AND (n + 15) // 16 = 1 THEN -1 ELSE tree END,
    CASE WHEN tree >= 0 AND (n + 15) // 16 = 1 THEN 0 ELSE level + 1 END, CASE WHEN tree >= 0 AND (n + 15) // 16 = 1 THEN tree ELSE idx // 16 END,
    CASE WHEN tree >= 0 AND (n + 15) // 16 = 1 THEN (SELECT count(*) FROM subroots) ELSE (n + 15) // 16 END
  FROM steps WHERE n > 1),
segments AS (
  SELECT s.row, s.step, coalesce(string_agg(x.hash, '' ORDER BY x.idx) FILTER (x.idx < s.idx), '') AS l,
    coalesce(string_agg(x.hash, '' ORDER BY x.idx) FILTER (x.idx > s.idx), '') AS r
  FROM steps s JOIN nodes x ON x.tree = s.tree AND x.level = s.level AND x.run = s.idx // 16 WHERE s.n > 1 GROUP BY ALL),
proofs AS (SELECT row, list(struct_pack(l, r) ORDER BY step) AS p, string_agg(l || r, '' ORDER BY step) AS siblings FROM segments GROUP BY row),
folded(doc_id, leaf, subroot, siblings, p, i, acc) AS (
  SELECT doc_id, leaf, s.hash, coalesce(siblings, ''), coalesce(p, []), 0, coalesce(changed, leaf)
  FROM leaves JOIN subroots s USING (tree) LEFT JOIN proofs ON row = struct_pack(doc_id, leaf)
  UNION ALL
  SELECT doc_id, leaf, subroot, siblings, p, i + 1, sha256(p[i + 1].l || acc || p[i + 1].r) FROM folded WHERE i < len(p)),
root AS (SELECT hash AS root FROM above WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM folded, root WHERE i = len(p)
"""

_AUDIT = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
marked AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
rows AS (
  SELECT part, [('A', len(w) < {audit.LEAST_WORDS}), ('B', 100 * list_unique(w) < {audit.LEAST_DISTINCT} * len(w)),
    ('C', 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {audit.MOST_CAPITALS} * length(text)),
    ('D', regexp_matches(text, '[{audit.MARKS}]')), ('E', coalesce(doc_id > first, false))] AS checked, good, toxic
  FROM texts LEFT JOIN marked USING (doc_id)),
failing AS (SELECT part, list_transform(list_filter(checked, lambda c: c[2]), lambda c: c[1]) AS fails, good, toxic FROM rows),
cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM failing GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
counted AS (
  SELECT part, filter_order, step, filter_order[step] AS filter,
    coalesce(sum(n) FILTER (len(list_intersect(fails, string_split(filter_order[:step], ''))) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (here), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (list_contains(fails, filter_order[step]) AND NOT here), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = [filter_order[step]]), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (here), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (here), 0)::BIGINT AS toxic_lost
  FROM (SELECT *, list_contains(fails, filter_order[step])
      AND len(list_intersect(fails, string_split(filter_order[:step - 1], ''))) = 0 AS here FROM cells, steps)
  GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM counted
"""

ORACLE: dict[str, str] = {
    "op3_licence_scan": _LICENCES,
    "op7_source_mixing": _MIXING,
    "op8_jaccard_join": _JACCARD,
    "op10_decontamination": _CONTAMINATION,
    "op12_merkle_manifest": _MERKLE,
    "op13_filter_audit": _AUDIT,
}
