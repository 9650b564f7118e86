"""DuckDB equivalents of the queries SQL can express."""

from __future__ import annotations

from semproxy.llm.quality import RULES, RiskControl

def mixed(docs: str) -> str:
    """CTEs up to ``running``: water-filling in closed form, sources sorted by the level at which
    they reach their cap, and the running words of a source in seeded order."""
    return rf"""
sized AS (
  SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         substr(md5('42:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 15) AS key
  FROM {docs}),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 3 * source_size / weight AS level FROM sources),
steps AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER earlier, 0) AS words,
         sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS weights,
         row_number() OVER (ORDER BY level, source NULLS LAST) AS step
  FROM levels
  WINDOW earlier AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (
  SELECT step, words, weights FROM steps WHERE words * weight <= 3 * source_size * weights
  ORDER BY step LIMIT 1),
targets AS (
  SELECT s.source, s.source_size,
         CASE WHEN s.step < f.step THEN (3 * s.source_size)::DOUBLE
              ELSE (s.weight * f.words)::DOUBLE / f.weights::DOUBLE END AS target
  FROM steps s, final f),
goals AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole,
         round(target)::BIGINT AS goal
  FROM targets),
running AS (
  SELECT d.*, g.source_size, g.target, g.whole,
         g.goal - g.whole * g.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                           ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)"""


MIX = f"""
WITH {mixed('documents').strip()}
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * whole + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM running
"""

def phrase_hits(docs: str) -> str:
    """CTEs up to ``hits`` and ``ids``: windows as joined words, and every window of a document
    looked up among them."""
    return rf"""
doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM {docs}),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
cut AS (
  SELECT item_id, least(10, len(words)) AS width, words, unnest(range(len(words) - least(10, len(words)) + 1)) AS s
  FROM item WHERE len(words) > 0),
windows AS (
  SELECT DISTINCT item_id, width, array_to_string(words[s + 1 : s + width], ' ') AS phrase FROM cut),
widths AS (SELECT DISTINCT width FROM windows),
starts AS (
  SELECT doc_id, words, width, unnest(range(len(words) - width + 1)) AS s FROM doc, widths WHERE len(words) >= width),
occurrences AS (
  SELECT d.doc_id, w.item_id, d.s, d.width
  FROM starts d JOIN windows w
    ON w.width = d.width AND w.phrase = array_to_string(d.words[d.s + 1 : d.s + d.width], ' ')),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest(range(s, s + width)) AS p FROM occurrences) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS list
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM occurrences) GROUP BY doc_id)"""


PHRASES = f"""
WITH {phrase_hits('documents').strip()}
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit,
       coalesce(i.n, 0)::BIGINT AS n_items, sha256(coalesce(i.list, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hits h USING (doc_id) LEFT JOIN ids i USING (doc_id)
"""

def borders(keys: str) -> str:
    """CTEs up to ``placed``: the shard of every key of ``keys(h, doc_id, size)``. A border is exact
    or lies at the nearer edge of a group of equal hashes, if that is near enough."""
    return f"""
totals AS (SELECT sum(size)::BIGINT AS total, floor(0.02::DOUBLE * sum(size) / 8)::BIGINT * 8 AS near FROM {keys}),
groups AS (
  SELECT h, sum(size) AS size, sum(sum(size)) OVER (ORDER BY h ROWS UNBOUNDED PRECEDING) - sum(size) AS before
  FROM {keys} GROUP BY h),
edges AS (
  SELECT i, i * total - before * 8 AS short, (before + size) * 8 - i * total AS long, before, size, total, near
  FROM groups, totals, range(1, 8) r(i) WHERE before * 8 < i * total AND (before + size) * 8 >= i * total),
marks AS (
  SELECT CASE WHEN least(short, long) > near THEN i * total WHEN short < long THEN before * 8
    ELSE (before + size) * 8 END AS mark FROM edges),
ordered AS (
  SELECT h, doc_id, sum(size) OVER (ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS before FROM {keys}),
placed AS (
  SELECT h, doc_id, (SELECT count(*) FROM marks WHERE ordered.before * 8 >= mark)::INTEGER AS shard FROM ordered)"""


# A CRC table of 256 entries from its polynomial.
SHARDS = rf"""
WITH crc_table AS (SELECT list(v ORDER BY n) AS t FROM (
  SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END) AS v
  FROM (SELECT unnest(range(256)) AS n))),
measured AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, text,
         substr(md5(coalesce(text, '')), 1, 15) AS h FROM documents),
{borders('measured').strip()},
sharded AS (SELECT * FROM measured JOIN placed USING (h, doc_id))
SELECT doc_id, size,
  CASE WHEN text IS NOT NULL THEN xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'),
      lambda b: ('0x' || b)::BIGINT)),
    lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256))) END AS text_crc32,
  'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1 AS slot,
  NULL::INTEGER AS grown_shard
FROM sharded, crc_table
"""

# Every 50-byte string (100 hexadecimal digits) with the smallest id that has it.
REPEATS = r"""
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS owner FROM (
    SELECT doc_id, unnest(range(1, len(h) // 2 - 48)) - 1 AS i,
           unnest(list_transform(range(1, len(h) // 2 - 48), lambda p: substr(h, 2 * p - 1, 100))) AS s
    FROM bytes WHERE len(h) >= 100)),
gone AS (
  SELECT doc_id, i, CASE WHEN i > lag(i) OVER w + 50 THEN 1 ELSE 0 END AS gap
  FROM strings WHERE owner < doc_id WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (
  SELECT doc_id, min(i) AS first, max(i) + 50 AS last FROM (
    SELECT doc_id, i, sum(gap) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM gone)
  GROUP BY doc_id, run),
cuts AS (
  SELECT doc_id, first, last, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY first), 0) AS kept_from
  FROM runs),
kept AS (
  SELECT c.doc_id, count(*) AS n_spans, sum(last - first) AS n_removed, max(last) AS tail,
         string_agg(substr(h, 2 * kept_from + 1, 2 * (first - kept_from)), '' ORDER BY first) AS k
  FROM cuts c JOIN bytes USING (doc_id) GROUP BY c.doc_id)
SELECT b.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k || substr(h, 2 * tail + 1), h))) AS kept_sha256
FROM bytes b LEFT JOIN kept USING (doc_id)
"""

FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
INDEX_WORDS = rf"regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
PLAIN_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def classes(docs: str) -> str:
    """CTEs up to ``found``: per distinct text its class, links, copies and n-grams."""
    return f"""
texts AS (
  SELECT coalesce(text, '') AS text, min(doc_id) AS id, count(*) AS copies FROM {docs} GROUP BY ALL),
cut_words AS (SELECT id, copies, text, {INDEX_WORDS} AS words FROM texts),
gram_lists AS (
  SELECT id, copies, text, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct(list_transform(
    range(1, greatest(len(words) - 4, 1) + 1), lambda p: array_to_string(words[p : p + 4], ' '))) END AS grams
  FROM cut_words),
grams AS (SELECT id, unnest(grams) AS gram FROM gram_lists),
shared AS (
  SELECT a.id AS a, b.id AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.id <> b.id
  GROUP BY ALL),
links AS (
  SELECT a, b, y.copies AS others FROM shared JOIN gram_lists x ON x.id = a JOIN gram_lists y ON y.id = b
  WHERE n >= 0.8 * (len(x.grams) + len(y.grams) - n) - 1e-9),
reached(a, b) AS (
  SELECT id, id FROM texts UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
roots AS (SELECT a AS id, min(b) AS class_id FROM reached GROUP BY a),
found AS (
  SELECT g.id, g.text, class_id, copies AS n_copies, len(grams)::BIGINT AS n_grams,
         (coalesce((SELECT sum(others) FROM links WHERE a = g.id), 0) + copies - 1)::BIGINT AS n_links
  FROM gram_lists g JOIN roots USING (id))"""


JOIN = f"""
WITH RECURSIVE {classes('documents').strip()}
SELECT doc_id, class_id, n_links, n_copies, n_grams
FROM documents d JOIN found f ON coalesce(d.text, '') = f.text
"""

# Fixed: the rules and grids of the quality module, as SQL values.
RULE_ROWS = ", ".join(
    f"('{rule}', {number}, {float(cutoff)}::DOUBLE)"
    for rule, (_, grid) in RULES.items()
    for number, cutoff in enumerate(grid, 1)
)
RULE_SCORES = ", ".join(f"('{rule}', ({score})::DOUBLE)" for rule, (score, _) in RULES.items())


def judged(docs: str) -> str:
    """CTEs up to ``judged``: counts, base verdict and verdict per row of ``docs``."""
    return rf"""
counted AS (
  SELECT *, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines
  FROM (SELECT *, {PLAIN_WORDS} AS words, list_filter(string_split(coalesce(text, ''), chr(10)),
    lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM {docs})),
word_windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 6)) AS p,
    unnest(list_transform(range(1, len(words) - 6), lambda p: array_to_string(words[p : p + 7], ' '))) AS w
  FROM counted WHERE len(words) > 8),
again AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (
    SELECT doc_id, unnest(range(p, p + 8)) AS q FROM (
      SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS times FROM word_windows) WHERE times > 1)
  GROUP BY doc_id),
features AS (
  SELECT c.* EXCLUDE (words, lines), coalesce(n, 0)::BIGINT AS n_repeat_words,
    n_words < 20 OR 100 * coalesce(n, 0) > 30 * n_words AS base_failed, coalesce(lang, '') AS stratum
  FROM counted c LEFT JOIN again USING (doc_id)),
scored AS (
  SELECT f.*, r.rule, r.score FROM features f, LATERAL (SELECT col0 AS rule, col1 AS score FROM
    (VALUES {RULE_SCORES.replace('n_words', 'greatest(f.n_words, 1)').replace('n_symbols', 'f.n_symbols')
             .replace('n_dup_lines', 'f.n_dup_lines').replace('greatest(n_lines', 'greatest(f.n_lines')
             .replace('n_repeat_words', 'f.n_repeat_words').replace('word_chars', 'f.word_chars')})) r),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1),
grid(rule, place, cutoff) AS (VALUES {RULE_ROWS}),
tested AS (
  SELECT stratum, rule, place, cutoff, count(*) AS n, count(*) FILTER (score > cutoff) AS k
  FROM scored JOIN grid USING (rule) WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)
  GROUP BY ALL),
level AS (SELECT {RiskControl().delta}::DOUBLE / count(*) AS delta, {RiskControl().alpha}::DOUBLE / {len(RULES)} AS a FROM (SELECT DISTINCT stratum, rule FROM tested)),
tails AS (
  SELECT tested.*, delta, CASE WHEN k >= n THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(a) + (n - i) * ln(1 - a)))) END AS p
  FROM tested, level),
cutoffs AS (
  SELECT stratum, rule, arg_max(cutoff, place) AS cutoff FROM (
    SELECT *, sum(CASE WHEN p > delta THEN 1 ELSE 0 END) OVER (PARTITION BY stratum, rule ORDER BY place) AS failed
    FROM tails) WHERE failed = 0 GROUP BY ALL),
rejected AS (
  SELECT DISTINCT doc_id FROM scored JOIN cutoffs USING (stratum, rule) WHERE score > cutoff),
judged AS (
  SELECT *, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept FROM features)"""


QUALITY = f"""
WITH {judged('documents').strip()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged
"""

# The stages one after the other; repeated rows of one document stay in one shard.
PIPELINE = rf"""
WITH RECURSIVE {judged('documents').strip()},
passed AS (SELECT doc_id, text, lang, source, n_chars FROM judged WHERE kept),
{classes('passed').strip()},
single AS (
  SELECT p.* FROM passed p JOIN found f ON coalesce(p.text, '') = f.text AND p.doc_id = f.id
  WHERE f.class_id = f.id),
{phrase_hits('single').strip()},
clean AS (SELECT * FROM single WHERE doc_id NOT IN (SELECT doc_id FROM hits)),
{mixed('clean').strip()},
parts AS (
  SELECT *, greatest(0, least(size, rest - before)) AS part,
         regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS pieces
  FROM running WHERE size > 0),
taken AS (
  SELECT doc_id, text, lang, source, n_chars FROM (
    SELECT *, unnest(range((whole + CASE WHEN part = size THEN 1 ELSE 0 END)::BIGINT)) FROM parts)
  UNION ALL
  SELECT doc_id, t, lang, source, length(t) FROM (
    SELECT *, array_to_string(pieces[1 : part], '') AS t FROM parts WHERE part > 0 AND part < size)),
keyed AS (SELECT *, strlen(text) + 1 AS bytes, substr(md5(text), 1, 15) AS h FROM taken),
keys AS (SELECT h, doc_id, sum(bytes)::BIGINT AS size FROM keyed GROUP BY h, doc_id),
{borders('keys').strip()}
SELECT doc_id, text, lang, source, n_chars, shard,
       row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1 AS slot
FROM keyed JOIN placed USING (h, doc_id)
"""

# Sketches of 128 hashes of five words; the next document is the one with the next smaller id.
FINGERPRINTS = r"""
WITH edited AS (
  SELECT doc_id, text, substr(text, 1, length(text) - length(text) // 3) || substr(next, 1, length(text) // 3) AS edited
  FROM (SELECT doc_id, coalesce(text, '') AS text,
          coalesce(lead(text) OVER falling, first_value(text) OVER falling, '') AS next
        FROM documents WINDOW falling AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))),
cut AS (
  SELECT doc_id, which, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM (SELECT doc_id, 0 AS which, text AS t FROM edited UNION ALL SELECT doc_id, 1, edited FROM edited)),
hashes AS (
  SELECT DISTINCT doc_id, which, substr(md5(array_to_string(words[s : s + 4], ' ')), 1, 16) AS h
  FROM (SELECT doc_id, which, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS s FROM cut WHERE len(words) > 0)),
kept AS (
  SELECT doc_id, which, list(h ORDER BY h) AS hs
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, which ORDER BY h) AS place FROM hashes) WHERE place <= 128
  GROUP BY doc_id, which),
sketches AS (
  SELECT e.doc_id, e.text, e.edited, coalesce(a.hs, []) AS a, coalesce(b.hs, []) AS b
  FROM edited e LEFT JOIN kept a ON a.doc_id = e.doc_id AND a.which = 0
  LEFT JOIN kept b ON b.doc_id = e.doc_id AND b.which = 1),
neighbours AS (
  SELECT *, coalesce(lead(a) OVER falling, first_value(a) OVER falling) AS c FROM sketches
  WINDOW falling AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
unions AS (
  SELECT *, list_sort(list_distinct(a || b))[1 : 128] AS ab, list_sort(list_distinct(a || c))[1 : 128] AS ac FROM neighbours)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
  array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
  CASE WHEN len(ab) = 0 THEN 1.0::DOUBLE
    ELSE len(list_filter(ab, lambda x: list_contains(a, x) AND list_contains(b, x)))::DOUBLE / len(ab) END AS near_edited,
  CASE WHEN len(ac) = 0 THEN 1.0::DOUBLE
    ELSE len(list_filter(ac, lambda x: list_contains(a, x) AND list_contains(c, x)))::DOUBLE / len(ac) END AS near_next,
  CASE WHEN len(a) < 128 THEN len(a)::DOUBLE
    ELSE 127.0::DOUBLE * 4503599627370496.0::DOUBLE / greatest(('0x' || substr(a[128], 1, 13))::BIGINT, 1)::DOUBLE END AS n_shingles
FROM unions
"""

# A CRC table of 256 entries from its polynomial, and the CRC of the UTF-8 bytes of a text with it.
CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY n) AS t FROM (
  SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END) AS v
  FROM (SELECT unnest(range(256)) AS n)))"""


def crc(text: str) -> str:
    return f"""xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT)),
      lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256)))"""


# Paths are the digests of the turns one after the other, 32 digits each.
TRIE = f"""
WITH {CRC_TABLE},
turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS tid,
    strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {crc('c::VARCHAR')} % 9 AS h FROM (SELECT DISTINCT c FROM turns), crc_table),
rebuilt AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth, tid, bytes FROM (
    SELECT v.c, 0 AS part, b.pos, b.tid, b.bytes FROM convs v JOIN turns b ON b.c = v.c - v.c % 5 WHERE b.pos < v.h
    UNION ALL
    SELECT v.c, 1, o.pos, o.tid, o.bytes FROM convs v JOIN turns o ON o.c = v.c WHERE o.pos >= v.h)),
members AS (
  SELECT c, depth, bytes, string_agg(tid, '') OVER (PARTITION BY c ORDER BY depth) AS path FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM convs),
nodes AS (
  SELECT path, depth, min(c) AS conv_id, count(*) AS n, max(bytes) AS bytes FROM members GROUP BY path, depth),
tree AS (
  SELECT n.*, p.conv_id AS parent_conv_id, count(k.path) AS children
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, (n.depth - 1) * 32)
  LEFT JOIN nodes k ON k.depth = n.depth + 1 AND left(k.path, n.depth * 32) = n.path
  GROUP BY ALL),
above AS (
  SELECT left(path, d * 32) AS path, sum((n - 1) * bytes)::BIGINT AS saved, count(*) FILTER (children = 0) AS leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM tree) GROUP BY 1),
ends AS (
  SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids
  FROM (SELECT * FROM members QUALIFY row_number() OVER (PARTITION BY c ORDER BY depth DESC) = 1) GROUP BY path)
SELECT conv_id, depth, parent_conv_id, n AS n_convs, children AS n_children, leaves AS n_leaves,
  saved AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM tree JOIN above USING (path) LEFT JOIN ends USING (path)
"""


def _edited(state: str, cost: str, letter: str, line: str = "") -> str:
    """A way of a repair with one more edit, NULL where there is no way to ``state``."""
    lines = f"{state}.lines || [{line}]" if line else f"{state}.lines"
    way = f"{{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}', 'lines': {lines}}}"
    return f"CASE WHEN {state} IS NOT NULL THEN {way} END"


def _best(*ways: str) -> str:
    """The cheapest way, of equal ones that with the least audit."""
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"


def _live(state: str, initial: str, role: str) -> tuple[str, str]:
    """A row kept, if it has the ``initial``, or turned to ``role``."""
    keep = _edited(state, "extra", "K", "role || ':' || text")
    turn = _edited(state, "(extra + 3)", "R", f"'{role}:' || text")
    return f"CASE WHEN live AND initial = '{initial}' THEN {keep} END", f"CASE WHEN live THEN {turn} END"


def _ways(states: str) -> str:
    """``states`` 0 to 3: nothing yet, after system, user, assistant; then turns are put in."""
    user = _best("n2", *[_edited(f"n{q}", "3", "I", "'user:'") for q in (0, 1, 3)])
    put = f"SELECT conv_id, i, n0 AS s0, n1 AS s1, {user} AS s2, n3 FROM ({states})"
    return f"SELECT conv_id, i, s0, s1, s2, {_best('n3', _edited('s2', '3', 'I', chr(39) + 'assistant:' + chr(39)))} AS s3 FROM ({put})"


_NOTHING = "{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}"
_NO_WAY = "NULL::STRUCT(cost BIGINT, audit VARCHAR, lines VARCHAR[])"
_AFTER_ROW = f"""SELECT w.conv_id, w.i + 1 AS i, {_edited('s0', '4', 'D')} AS n0,
  {_best(_edited('s1', '4', 'D'), f"CASE WHEN live AND initial = 's' THEN {_edited('s0', 'extra', 'K', "role || ':' || text")} END")} AS n1,
  {_best(_edited('s2', '4', 'D'), *_live('s0', 'u', 'user'), *_live('s1', 'u', 'user'), *_live('s3', 'u', 'user'))} AS n2,
  {_best(_edited('s3', '4', 'D'), *_live('s2', 'a', 'assistant'))} AS n3
  FROM ways w JOIN judged r ON r.conv_id = w.conv_id AND r.i = w.i + 1"""

REPAIR = f"""
WITH RECURSIVE {CRC_TABLE},
damaged AS (
  SELECT conv_id, turn, unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy,
    CASE WHEN f = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text
  FROM (SELECT *, {crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f
        FROM conversations, crc_table) WHERE f > 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, copy) AS i FROM damaged),
faults AS (
  SELECT *, left(role, 1) AS initial,
    CASE WHEN rest = '' THEN 'blank' WHEN earlier > 1 THEN 'duplicate'
      WHEN right(rest, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS rest,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS earlier FROM ordered)),
judged AS (
  SELECT *, fault NOT IN ('blank', 'duplicate') AS live, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM faults),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS last
  FROM judged GROUP BY conv_id),
ways AS (
  {_ways(f"SELECT DISTINCT conv_id, 0::BIGINT AS i, {_NOTHING} AS n0, {_NO_WAY} AS n1, {_NO_WAY} AS n2, {_NO_WAY} AS n3 FROM conversations")}
  UNION ALL
  {_ways(_AFTER_ROW)}),
done AS (
  SELECT w.conv_id, {_best('s0', 's3')} AS way, c.* EXCLUDE (conv_id)
  FROM ways w LEFT JOIN counts c ON c.conv_id = w.conv_id WHERE w.i = coalesce(c.last, 0))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, way.cost AS cost, way.audit AS audit,
  sha256(array_to_string(way.lines, chr(10))) AS repaired_sha256
FROM done
"""

ORACLES = {
    "op1_histogram_shards": SHARDS,
    "op3_mix_sources": MIX,
    "op6_suffix_dedup": REPEATS,
    "op7_ngram_join": JOIN,
    "op8_benchmark_phrases": PHRASES,
    "op9_quality_rules": QUALITY,
    "op11_document_fingerprints": FINGERPRINTS,
    "op12_conversation_trie": TRIE,
    "op13_conversation_repair": REPAIR,
}
