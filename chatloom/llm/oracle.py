"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

SQL = {}

SQL["op10_source_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
),
weighed AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight,
    row_number() OVER (ORDER BY source NULLS LAST) AS source_no
  FROM sources
),
lined AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source_no) AS k FROM weighed
),
steps AS (
  SELECT *,
    CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS left_over,
    CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS weights
  FROM lined
),
first_open AS (
  SELECT k AS open_k, left_over AS open_left, weights AS open_weights
  FROM steps WHERE 3 * source_size / weight > left_over / weights ORDER BY k LIMIT 1
),
targets AS (
  SELECT source, source_size,
    CASE WHEN open_k IS NULL OR k < open_k THEN CAST(3 * source_size AS DOUBLE)
         ELSE open_left * weight / open_weights END AS target
  FROM steps LEFT JOIN first_open ON true
),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS words,
    CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(concat('mix:', s.doc_id)), s.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE CAST(
    greatest(0, least(size, words - start)) + greatest(0, least(size, words - start - source_size))
    + greatest(0, least(size, words - start - 2 * source_size)) AS BIGINT) END AS taken
FROM placed
"""

SQL["op5_embedding_near_dedup"] = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
),
reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links,
  CAST(least(e.vec_id, coalesce(l.b, e.vec_id)) AS BIGINT) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counted c ON c.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id
"""

SQL["op6_revisit_resolution"] = r"""
WITH sites AS (
  SELECT *, concat(regexp_extract(url, '^[a-z]+://[^/]+', 0), '/page', page_id % 3) AS site, page_id * 60 AS sent,
    page_id * 60 + CASE WHEN page_id % 7 = 0 THEN -30 ELSE 90 END + page_id % 11 * 300 AS seen
  FROM pages
),
versions AS (
  SELECT *, CAST(floor(sent / 6000) AS BIGINT) AS sent_version, CAST(floor(seen / 6000) AS BIGINT) AS seen_version FROM sites
),
records AS (
  SELECT page_id * 2 AS record_id, site AS url, sent AS fetched_at, 'response' AS kind, concat('"', sent_version, '"') AS etag,
    CASE WHEN page_id % 4 < 2 THEN CAST(sent_version * 6000 AS VARCHAR) END AS changed, CAST(sent AS VARCHAR) AS date, html AS page
  FROM versions
  UNION ALL
  SELECT page_id * 2 + 1, CASE page_id % 3 WHEN 0 THEN concat(site, '/#again') WHEN 1 THEN regexp_replace(site, '^http:', 'https:')
      ELSE concat(site, '?utm_source=x') END,
    seen, 'revisit', CASE page_id % 5 WHEN 0 THEN '"other"' WHEN 1 THEN NULL ELSE concat('"', seen_version, '"') END,
    CASE WHEN page_id % 2 = 0 THEN CAST(seen_version * 6000 AS VARCHAR) END, CAST(seen AS VARCHAR), NULL
  FROM versions
),
bared AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS bare FROM records),
split AS (
  SELECT *,
    regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), ':(80|443)$', ''), '^(www|m)\.', '') AS host,
    regexp_replace(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
      lambda q: q <> '' AND lower(split_part(q, '=', 1)) NOT IN ('fbclid', 'gclid', 'ref', 'utm_campaign', 'utm_content', 'utm_medium', 'utm_source', 'utm_term'))), '&') AS tail
  FROM bared
),
named AS (
  SELECT record_id, fetched_at, kind, etag, changed, date, page,
    CASE WHEN host <> '' THEN concat('https://', host, path, CASE WHEN tail <> '' THEN concat('?', tail) ELSE '' END) END AS address
  FROM split
),
latest AS (
  SELECT r.record_id, arg_max(f.record_id, (f.fetched_at, f.record_id)) AS source_id
  FROM named r JOIN named f ON f.kind = 'response' AND f.address = r.address AND (f.fetched_at, f.record_id) < (r.fetched_at, r.record_id)
  WHERE r.kind = 'revisit' GROUP BY r.record_id
),
joined AS (
  SELECT r.*, a.source_id, f.etag AS etag0, f.changed AS changed0, f.page AS page0,
    coalesce(r.etag = f.etag, false) AS same_tag, coalesce(r.changed = f.changed, false) AS same_time,
    coalesce(r.etag <> f.etag, false) AS other_tag, coalesce(r.changed <> f.changed, false) AS other_time
  FROM named r LEFT JOIN latest a USING (record_id) LEFT JOIN named f ON f.record_id = a.source_id
),
judged AS (
  SELECT *, CASE WHEN kind = 'response' THEN 'full' WHEN source_id IS NULL THEN 'unresolved'
    WHEN other_tag OR (other_time AND NOT same_tag) THEN 'mismatch' WHEN same_tag OR same_time THEN 'resolved' ELSE 'unverified' END AS outcome
  FROM joined
)
SELECT record_id, address, source_id, outcome,
  CASE outcome WHEN 'full' THEN concat_ws(';', 'content-type=text/html', 'date=' || date, 'etag=' || etag, 'expires=0', 'last-modified=' || changed)
    WHEN 'resolved' THEN concat_ws(';', 'content-type=text/html', 'date=' || date, 'etag=' || coalesce(etag, etag0), 'expires=0',
      'last-modified=' || coalesce(changed, changed0))
    ELSE concat_ws(';', 'date=' || date, 'etag=' || etag, 'last-modified=' || changed, 'server=cache') END AS headers,
  CASE outcome WHEN 'full' THEN page WHEN 'resolved' THEN page0 END AS page
FROM judged
"""

SQL["op9_line_templates"] = r"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, md5(text) AS th, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM split),
tokens AS (
  SELECT doc_id, th, pos, list_transform(string_split(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), ' '),
    lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tk
  FROM lines
),
parsed AS (
  SELECT doc_id, th, pos, len(tk) AS n, tk[1:3] AS lead, array_to_string(tk, ' ') AS template FROM tokens WHERE len(tk) >= 3
),
counts AS (
  SELECT template, lead, n, CASE WHEN n >= 50 THEN 2 ELSE 3 END AS needed, count(DISTINCT th) AS texts, min(doc_id) AS first
  FROM parsed GROUP BY ALL
),
shared AS (SELECT lead, n FROM counts WHERE n >= 7 GROUP BY lead, n, needed HAVING count(*) > 1 AND sum(texts) >= needed),
contested AS (
  SELECT c.*, string_split(c.template, ' ') AS tk, least(8, c.n - 3) AS k, c.n - 3 AS rest FROM counts c JOIN shared USING (lead, n)
),
placed AS (
  SELECT template, lead, n, texts, k, j AS place,
    array_to_string(tk[4 + CAST(floor(j * rest / k) AS BIGINT) : 3 + CAST(floor((j + 1) * rest / k) AS BIGINT)], ' ') AS token
  FROM contested, unnest(range(k)) AS t(j)
),
votes AS (SELECT lead, n, place, token, sum(texts) AS votes FROM placed GROUP BY ALL),
best AS (SELECT lead, n, place, max(votes) AS votes FROM votes GROUP BY ALL),
usual AS (
  SELECT lead, n, place, min(token) AS token FROM votes JOIN best USING (lead, n, place, votes)
  GROUP BY lead, n, place HAVING count(*) = 1
),
agreeing AS (
  SELECT p.template, p.lead, p.n FROM placed p JOIN usual u USING (lead, n, place)
  GROUP BY p.template, p.lead, p.n, p.k HAVING sum(CASE WHEN p.token = u.token THEN 1 ELSE 0 END) >= 0.75 * p.k
),
grouped AS (
  SELECT a.lead, a.n, min(p.doc_id) AS first FROM parsed p JOIN agreeing a USING (template)
  GROUP BY a.lead, a.n HAVING count(DISTINCT p.th) >= CASE WHEN a.n >= 50 THEN 2 ELSE 3 END
),
fielded AS (
  SELECT template, lead, n, needed, texts, k, list_transform(range(k), lambda j: array_to_string(
    tk[4 + CAST(floor(j * rest / k) AS BIGINT) : 3 + CAST(floor((j + 1) * rest / k) AS BIGINT)], ' ')) AS fields
  FROM contested
),
subsets AS (
  SELECT template, lead, n, needed, texts, mask,
    list_transform(list_filter(range(k), lambda j: (mask >> j) & 1 = 1), lambda j: fields[j + 1]) AS same
  FROM (SELECT *, unnest(range(CAST(power(2, k) AS BIGINT))) AS mask FROM fielded)
  WHERE bit_count(mask) = CAST(ceil(0.75 * k) AS BIGINT)
),
families AS (
  SELECT lead, n, mask, same FROM subsets GROUP BY lead, n, needed, mask, same HAVING count(*) > 1 AND sum(texts) >= needed
),
kin AS (SELECT DISTINCT s.template, s.lead, s.n, s.mask, s.same FROM subsets s JOIN families f USING (lead, n, mask, same)),
related AS (
  SELECT k.lead, k.n, k.mask, k.same, min(p.doc_id) AS first FROM parsed p JOIN kin k USING (template)
  GROUP BY k.lead, k.n, k.mask, k.same HAVING count(DISTINCT p.th) >= CASE WHEN k.n >= 50 THEN 2 ELSE 3 END
),
recurring AS (
  SELECT template, min(first) AS first FROM (
    SELECT template, first FROM counts WHERE texts >= needed
    UNION ALL SELECT a.template, g.first FROM agreeing a JOIN grouped g USING (lead, n)
    UNION ALL SELECT k.template, r.first FROM kin k JOIN related r USING (lead, n, mask, same)
  ) GROUP BY template
),
drops AS (
  SELECT p.doc_id, list(DISTINCT p.pos) AS gone FROM parsed p JOIN recurring r USING (template)
  WHERE p.doc_id > r.first GROUP BY p.doc_id
)
SELECT d.doc_id,
  CASE WHEN x.gone IS NULL THEN d.text ELSE
    array_to_string(list_filter(string_split(d.text, chr(10)), lambda v, i: NOT list_contains(x.gone, i)), chr(10)) END AS text,
  CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(x.gone), 0) AS BIGINT) AS n_dropped
FROM documents d LEFT JOIN drops x ON x.doc_id = d.doc_id
"""

CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY n) AS crc FROM (
    SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS n))
)"""


def _codes(text: str) -> str:
    """Code points of a text."""
    return f"list_transform(range(1, length({text}) + 1), lambda i: CAST(unicode(substr({text}, CAST(i AS INTEGER), 1)) AS BIGINT))"


def _crc_on(start: str, codes: str) -> str:
    """The CRC-32 remainder after a list of bytes; begin with 4294967295 and invert at the end."""
    return f"list_reduce({codes}, lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]), {start})"


def _edit(rest: str, cost: str, edit: str, line: str = "''") -> str:
    """A way as text, ``<12 digits of cost><edits>|<lines>``, with one edit in front.

    Ways of equal cost are compared by their edits, which never begin with one another.
    """
    return (
        f"(lpad(CAST(CAST(left({rest}, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || '{edit}' || "
        f"substr({rest}, 13, instr({rest}, '|') - 12) || {line} || substr({rest}, instr({rest}, '|') + 1))"
    )


def _repair_step() -> str:
    """The ways from each state in front of a row ``r``, from those behind it, ``a``."""
    asked = {0: 2, 1: 2, 2: 3, 3: 2}
    kept = {0: {0: 1, 1: 2}, 1: {1: 2}, 2: {2: 3}, 3: {1: 2}}
    said = lambda state: "assistant" if state == 2 else "user"
    line = lambda role: f"chr(10) || {role} || ':' || r.said"
    blank = lambda state: f"chr(10) || '{said(state)}:'"
    plain = []
    for state in range(4):
        ways = [_edit(f"a.s{state}", "3", "D")]
        ways += [
            f"CASE WHEN NOT r.must AND r.initial = {initial} THEN {_edit(f'a.s{then}', 'r.cut', 'K', line('r.role'))} END"
            for initial, then in kept[state].items()
        ]
        again = line(f"'{said(state)}'")
        ways.append(f"CASE WHEN NOT r.must THEN {_edit(f'a.s{asked[state]}', '(2 + r.cut)', 'R', again)} END")
        plain.append(f"n{state}: least({', '.join(ways)})")
    ends = []
    for state in range(4):
        ways = [f"n.n{state}", _edit(f"n.n{asked[state]}", "2", "I", blank(state))]
        if state < 2:
            ways.append(_edit(_edit("n.n3", "2", "I", blank(2)), "2", "I", blank(state)))
        ends.append(f"s{state}: least({', '.join(ways)})")
    row = "initial: r.initial, must: r.must, cut: r.cut, role: r.role, said: r.said"
    return f"list_transform([{{{', '.join(plain)}}}], lambda n: {{{row}, {', '.join(ends)}}})[1]"


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL["op13_conversation_repair"] = f"""
WITH {CRC_TABLE},
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS said,
    concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS key
  FROM conversations
),
fated AS (SELECT *, xor({_crc_on('4294967295', _codes('key'))}, 4294967295) % 20 AS fate FROM given, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(said, '[.!?]', '', 'g') ELSE said END AS said,
    unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS time
  FROM fated WHERE fate <> 0
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(said)) AS place FROM damaged
),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, said ORDER BY place) > 1 AS again,
    rtrim(said, {_SPACES}) AS visible, left(role, 1) AS first,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before
  FROM placed
),
marked AS (
  SELECT *, visible = '' AS blank, visible <> '' AND again AS duplicate,
    visible <> '' AND NOT again AND right(visible, 1) NOT IN ('.', '!', '?') AS truncated
  FROM seen
),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
    count_if(duplicate) AS duplicate, count_if(truncated) AS truncated,
    count_if(before IS NOT NULL AND concat(before, first) NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{initial: CASE first WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END, must: blank OR duplicate,
      cut: CASE WHEN truncated THEN 1 ELSE 0 END, role: role, said: said,
      s0: '', s1: '', s2: '', s3: ''}} ORDER BY place DESC) AS rows
  FROM marked GROUP BY conv_id
),
solved AS (
  SELECT * EXCLUDE (rows), list_reduce(rows, lambda a, r: {_repair_step()},
    {{initial: 3, must: false, cut: 0, role: '', said: '', s0: '000000000000|',
      s1: '000000000004II|' || chr(10) || 'user:' || chr(10) || 'assistant:', s2: '000000000002I|' || chr(10) || 'assistant:',
      s3: '000000000000|'}}).s0 AS way
  FROM counted
),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(left(way, 12), '0') AS BIGINT) AS cost,
  coalesce(substr(way, 13, instr(way, '|') - 13), '') AS audit,
  sha256(coalesce(substr(way, instr(way, '|') + 2), '')) AS repaired_sha256
FROM every e LEFT JOIN solved s ON e.conv_id IS NOT DISTINCT FROM s.conv_id
"""

SQL["op12_spelling_variants"] = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents
),
lowered AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM runs),
times AS (SELECT id, word, count(*) AS n FROM lowered WHERE length(word) >= 6 GROUP BY id, word),
ids AS (SELECT id, {_crc_on('4294967295', _codes("concat(id, ':')"))} AS begun FROM (SELECT DISTINCT id FROM times), crc_table),
hashed AS (
  SELECT word, n, xor({_crc_on('begun', "flatten(list_transform(" + _codes('word') + ", lambda c: CASE WHEN c < 128 THEN [c] ELSE [195, c - 64] END))")}, 4294967295) AS h
  FROM times JOIN ids USING (id), crc_table
),
slipped AS (
  SELECT CASE WHEN h % 199 = 0 THEN concat(left(word, CAST(h % length(word) AS INTEGER)), substr(word, CAST(h % length(word) + 2 AS INTEGER))) ELSE word END AS word, n
  FROM hashed
),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
short AS (
  SELECT word, n, gone, concat(left(word, CAST(gone - 1 AS INTEGER)), substr(word, CAST(gone + 1 AS INTEGER))) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS gone FROM words)
),
near AS (
  SELECT a.word, b.word AS other, b.n FROM short a JOIN short b ON a.rest = b.rest AND a.gone = b.gone AND a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM short s JOIN words w ON w.word = s.rest
  UNION SELECT w.word, s.word, s.n FROM short s JOIN words w ON w.word = s.rest
),
best AS (
  SELECT word, count(*) AS n_near, max(n) AS most, arg_min(other, (-n, other)) AS form FROM near GROUP BY word
),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 5 * w.n THEN b.most END AS form_n,
    CASE WHEN b.most >= 5 * w.n THEN b.form END AS form
  FROM words w LEFT JOIN best b USING (word)
),
up(word, root) AS (
  SELECT word, form FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT u.word, f.form FROM up u JOIN formed f ON f.word = u.root WHERE f.form IS NOT NULL
),
ends AS (SELECT u.word, u.root FROM up u JOIN formed f ON f.word = u.root WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM formed f LEFT JOIN ends e USING (word)
"""
