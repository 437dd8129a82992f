"""SQL texts (DuckDB) of the queries that SQL can express, written from their definitions.

They take the plain way: all windows, all shared shingles, all prefixes, without fingerprints, signatures or trees.
"""

from __future__ import annotations

from gridloom.llm.fingerprint import K
from gridloom.llm.fixity import RECORDS_PER_FILE
from gridloom.llm.hosts import RULES, SECOND_LEVEL
from gridloom.llm.line_dedup import MIN_WORDS
from gridloom.llm.quality import BOILERPLATE, NAVIGATION, SENTENCE_MARKS
from gridloom.llm.secrets import BASE, MORE

WORD = r"[^\x20\x09-\x0D]+"
LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS ws FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 3)) AS i)),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM dup, (SELECT unnest(range(5)) AS o) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM d),
m AS (SELECT *, len(regexp_extract_all(line, '{WORD}')) AS n,
        length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS sym, len(regexp_extract_all(line, '!!')) AS shout,
        len(regexp_extract_all(line, '(^|[\\x20\\x09])[|»›•·>]([\\x20\\x09]|$)')) AS sep FROM ln),
f AS (SELECT *, n > 0 AND ((sym >= 0.5 * n AND sym >= 3) OR shout >= greatest(0.3 * n, 1)
            OR (n >= 20 AND NOT regexp_matches(line, {quoted(SENTENCE_MARKS)})) OR sep >= greatest(2, 0.25 * n)
            OR (n <= 3 AND lower(trim(line)) IN ({', '.join(map(quoted, NAVIGATION))}))) AS noise,
        n > 0 AND n <= 40 AND ({' OR '.join(f'contains(lower(line), {quoted(p)})' for p in BOILERPLATE)}) AS boiler FROM m),
l AS (SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines,
        count(*) FILTER (noise OR boiler) AS n_removed_lines, coalesce(sum(n) FILTER (noise OR boiler), 0) AS n_removed_words,
        coalesce(sum(n) FILTER (noise), 0) AS n_noise,
        coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT (noise OR boiler)), '') AS cleaned FROM f GROUP BY doc_id),
b AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, l.* EXCLUDE (doc_id), coalesce(rep.n, 0) AS n_repeat_words
      FROM w JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    n_repeat_words::BIGINT AS n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR n_noise > 0.5 * n_words OR n_removed_words = n_words) AS kept,
    n_removed_lines::BIGINT AS n_removed_lines, n_removed_words::BIGINT AS n_removed_words, sha256(cleaned) AS cleaned_sha256
FROM b"""

LINES = f"""
WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
            FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, i, line, regexp_extract_all({LOW.format('line')}, '{WORD}') AS ws FROM ln),
v AS (SELECT doc_id, i, len(ws) AS n, array_to_string(ws, ' ') AS norm, row_number() OVER d AS j,
        sum(len(ws)) OVER (d ROWS UNBOUNDED PRECEDING) AS upto FROM k WHERE len(ws) > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
whole AS (SELECT doc_id, list(norm ORDER BY j) AS norms FROM v GROUP BY doc_id),
runs AS (SELECT a.doc_id, a.j AS s, b.j AS e, array_to_string(whole.norms[a.j:b.j], chr(10)) AS body
         FROM v a JOIN v b ON a.doc_id = b.doc_id AND b.j BETWEEN a.j AND a.j + {MIN_WORDS} JOIN whole ON whole.doc_id = a.doc_id
         WHERE b.upto - a.upto + a.n >= {MIN_WORDS} AND (b.upto - b.n - a.upto + a.n < {MIN_WORDS} OR b.upto - a.upto < {MIN_WORDS})),
later AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, s) > 1),
cut AS (SELECT DISTINCT v.doc_id, v.i FROM later JOIN v ON v.doc_id = later.doc_id AND v.j BETWEEN s AND e),
isl AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM cut),
rng AS (SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS removed
        FROM (SELECT doc_id, g, min(i) AS a, max(i) AS b FROM isl GROUP BY doc_id, g) GROUP BY doc_id),
txt AS (SELECT ln.doc_id, count(*) AS n_lines, count(cut.i) AS n_removed,
            coalesce(string_agg(line, chr(10) ORDER BY ln.i) FILTER (cut.i IS NULL), '') AS left_over
        FROM ln LEFT JOIN cut ON cut.doc_id = ln.doc_id AND cut.i = ln.i GROUP BY ln.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed_lines, coalesce(removed, '') AS removed,
    sha256(CASE WHEN n_removed > 0 THEN left_over ELSE d.text END) AS deduped_sha256
FROM documents d LEFT JOIN txt ON txt.doc_id = d.doc_id LEFT JOIN rng ON rng.doc_id = d.doc_id"""

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BENCHMARK = f"""
WITH bw AS (SELECT item_id, regexp_extract_all({LOW.format('text')}, '{ALNUM}') AS ws FROM benchmark),
bl AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM bw WHERE len(ws) > 0),
bwin AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS body
         FROM bl, LATERAL (SELECT unnest(range(1, len(ws) - k + 2)) AS i)),
dw AS (SELECT doc_id, regexp_extract_all({LOW.format("coalesce(text, '')")}, '{ALNUM}') AS ws FROM documents),
dwin AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS body
         FROM dw, (SELECT DISTINCT k FROM bl), LATERAL (SELECT unnest(range(1, len(ws) - k + 2)) AS i)),
hit AS (SELECT doc_id, item_id, k, i FROM dwin JOIN bwin USING (k, body)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(cov.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
    sha256(coalesce(its.s, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov ON cov.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id"""

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOW.format("coalesce(text, '')")}, '{WORD}') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
       FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 3, 2))) AS i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
joint AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
edge AS (SELECT u, v FROM joint JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT a, v FROM reach JOIN edge ON b = u)
SELECT r.a AS doc_id, coalesce(min(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id, min(r.b) = r.a AS kept
FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a"""

# Holds where no conversation passes the size of one part.
CHAT = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, list(role || chr(31) || text ORDER BY turn, role, text) AS turns,
        string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), ''
            ORDER BY turn, role, text) AS rendered FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT k, array_to_string(turns[1:k], chr(30)) AS body FROM c, LATERAL (SELECT unnest(range(1, len(turns))) AS k)),
f AS (SELECT conv_id, turns, rendered, array_to_string(turns, chr(30)) AS body FROM c),
o AS (SELECT conv_id, len(turns) AS n, rendered, p.k IS NULL AND row_number() OVER (PARTITION BY len(turns), f.body ORDER BY conv_id) = 1 AS kept
      FROM f LEFT JOIN p ON p.k = len(turns) AND p.body = f.body)
SELECT conv_id, n::BIGINT AS n_turns, kept, 0::BIGINT AS part, CASE WHEN kept THEN rendered END AS rendered FROM o"""

RECORD = (r"""'WARC/1.1' || e || 'WARC-Type: response' || e || 'WARC-Target-URI: ' || coalesce(url, '') || e || 'Content-Type: text/html' || e ||
    'Content-Length: ' || strlen(coalesce(html, '')) || e || e || coalesce(html, '') || e || e""")
FIXITY = f"""
WITH a AS (SELECT page_id, url, html, chr(13) || chr(10) AS e, substr(md5(coalesce(url, '')), 1, 2) AS x FROM pages),
r AS (SELECT page_id, url, html, {RECORD} AS rec, x FROM a),
b AS (SELECT page_id, {RECORD} AS rec FROM (SELECT * REPLACE (CASE WHEN x IN ('0b', '0c') THEN '?' || substr(html, 2) ELSE html END AS html)
      FROM a WHERE x <> 'a7')),
o AS (SELECT page_id, page_id // {RECORDS_PER_FILE} AS file_no, rec,
        coalesce(sum(strlen(rec)) OVER (PARTITION BY page_id // {RECORDS_PER_FILE} ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM r),
q AS (SELECT page_id, rec, coalesce(sum(strlen(rec)) OVER (
        PARTITION BY page_id // {RECORDS_PER_FILE} ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM b)
SELECT o.page_id, file_no, o.at::BIGINT AS record_offset, strlen(o.rec)::BIGINT AS record_length, sha256(o.rec) AS record_sha256,
    CASE WHEN q.page_id IS NULL THEN 'missing' WHEN q.rec <> o.rec THEN 'changed' WHEN q.at <> o.at THEN 'moved' ELSE 'ok' END AS status
FROM o LEFT JOIN q ON q.page_id = o.page_id"""


def _secrets() -> str:
    parts = []
    for rank, r in enumerate([*BASE, *MORE]):
        p = quoted(r.pattern)
        parts.append(f"""
SELECT doc_id, {rank} AS k, '{r.kind}' AS kind, list_sum(list_transform(gaps[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS a, length(found[i]) AS size
FROM (SELECT doc_id, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS found, regexp_extract_all(text, {p}, {r.group}) AS part
      FROM documents WHERE regexp_matches(text, {p})), LATERAL (SELECT unnest(range(1, len(found) + 1)) AS i)
WHERE length(part[i]) >= {r.least}""")
    base = len(BASE)
    spans = "kind || ':' || a::BIGINT || ':' || (a + size)::BIGINT"
    return f"""
WITH s AS ({' UNION ALL '.join(parts)}),
g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (k = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))},
        string_agg({spans}, ',' ORDER BY a, k) FILTER (k < {base}) AS base, string_agg({spans}, ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256,
    coalesce(spans, '') AS spans FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id"""


def _hosts() -> str:
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)
    clip = "least(greatest(CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0 THEN (sum((k - n * m) * (k - n * m)) - sum(n * m * (1 - m))) / " \
           "sum(n * (n - 1) * m * (1 - m)) ELSE 0.0 END, 0.001), 0.5)"
    post = "(k + s * m) / (n + s)"
    return f"""
WITH rules(verdict, rule, tail, head) AS (VALUES {rules}),
p AS (SELECT page_id, {LOW.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')")} AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
        replace(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '&amp;', '&') AS txt FROM pages),
fit AS (SELECT page_id, arg_max(verdict, length(rule)) AS verdict, arg_max(rule, length(rule)) AS rule
        FROM p JOIN rules ON (host = tail OR ends_with(host, '.' || tail)) AND starts_with(path, head) GROUP BY page_id),
j AS (SELECT p.*, verdict, rule, len(regexp_extract_all(txt, '{WORD}')) AS nw, len(regexp_extract_all(txt, '[#*$%&|!]')) AS ns
      FROM p LEFT JOIN fit ON fit.page_id = p.page_id),
lab AS (SELECT host, CASE WHEN verdict = 'block' THEN 1 WHEN verdict = 'allow' THEN 0 WHEN nw > 0 AND ns * 4 >= nw THEN 1
        WHEN nw >= 20 AND ns * 50 <= nw THEN 0 END AS bad FROM j),
h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k, string_split(host, '.') AS parts FROM lab GROUP BY host),
h2 AS (SELECT host, n, k, parts[-1] AS suffix, array_to_string(parts[-(CASE WHEN length(parts[-1]) = 2 AND len(parts) >= 2
        AND parts[-2] IN ({', '.join(map(quoted, SECOND_LEVEL))}) THEN 3 ELSE 2 END):], '.') AS domain FROM h),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h2 GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
s1 AS (SELECT *, (sum(k) OVER () + 0.5) / (sum(n) OVER () + 1.0) AS m FROM s),
s2 AS (SELECT suffix, {post} AS m FROM s1, (SELECT (1 - {clip}) / {clip} AS s FROM s1)),
d1 AS (SELECT d.*, m FROM d JOIN s2 USING (suffix)),
d2 AS (SELECT domain, {post} AS m FROM d1, (SELECT (1 - {clip}) / {clip} AS s FROM d1)),
h3 AS (SELECT h2.*, m FROM h2 JOIN d2 USING (domain)),
h4 AS (SELECT host, {post} AS r, n + s AS t FROM h3, (SELECT (1 - {clip}) / {clip} AS s FROM h3))
SELECT page_id, j.host, path, rule, coalesce(verdict, CASE WHEN r - 1.645 * sqrt(r * (1 - r) / (t + 1)) > 0.3 THEN 'block' ELSE 'allow' END) AS verdict
FROM j JOIN h4 ON h4.host = j.host"""


DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {LOW.format("coalesce(text, '')")} AS t FROM documents),
w AS MATERIALIZED (SELECT doc, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
cell AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL),
cs AS (SELECT lang, source, sum(n) AS n FROM cell GROUP BY ALL),
grp AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(n, 0)::HUGEINT AS n FROM g LEFT JOIN v ON v.lang = g.lang LEFT JOIN cs ON cs.lang = g.lang AND cs.source = g.source),
p AS MATERIALIZED (SELECT grp.lang, grp.source, k.term, coalesce(cell.n, 0) AS c, (1 + (1000000000::HUGEINT * (coalesce(cell.n, 0) + 5)) // (grp.n + 5 * v))::BIGINT AS p
      FROM grp JOIN k ON k.lang = grp.lang LEFT JOIN cell ON cell.lang = grp.lang AND cell.source = grp.source AND cell.term = k.term),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q
      FROM cell GROUP BY lang, term),
sums AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p - q)::BIGINT AS value FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE c > 0 AND p > q),
both_ AS (SELECT * FROM pair UNION ALL SELECT * FROM term)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM both_ QUALIFY part = 'pair' OR rank <= 50"""

_SKETCH = f"""list_sort(list_distinct(list_transform(range(1, greatest(len({{0}}) - 4, least(len({{0}}), 1)) + 1),
        lambda i: md5(array_to_string({{0}}[i:i + 4], ' '))[1:16])))[1:{K}]"""
_LIKE = f"""CASE WHEN len({{0}}) + len({{1}}) = 0 THEN 1.0 ELSE len(list_filter(list_sort(list_distinct(list_concat({{0}}, {{1}})))[1:{K}],
        lambda z: list_contains({{0}}, z) AND list_contains({{1}}, z)))::DOUBLE / len(list_sort(list_distinct(list_concat({{0}}, {{1}})))[1:{K}]) END"""
_SIZE = f"CASE WHEN len({{0}}) < {K} THEN len({{0}})::DOUBLE ELSE {K - 1} / ((('0x' || {{0}}[-1][1:13])::BIGINT::DOUBLE + 1) / {float(2**52)}) END"

FINGERPRINTS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, md5(coalesce(text, '')) AS h FROM documents),
o AS (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nxt FROM d WHERE doc_id IS NOT NULL WINDOW w AS (ORDER BY doc_id, h ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
      UNION ALL SELECT NULL, t, '' FROM d WHERE doc_id IS NULL),
e AS (SELECT doc_id, t, nxt, substring(t, 1, length(t) - length(t) // 2) || substring(nxt, 1, length(t) // 2) AS ed FROM o),
w AS (SELECT doc_id, t, ed, regexp_extract_all({LOW.format("t")}, '{WORD}') AS wt, regexp_extract_all({LOW.format("nxt")}, '{WORD}') AS wn,
        regexp_extract_all({LOW.format("ed")}, '{WORD}') AS we FROM e),
s AS (SELECT doc_id, t, ed, {_SKETCH.format("wt")} AS a, {_SKETCH.format("wn")} AS b, {_SKETCH.format("we")} AS x FROM w),
r AS (SELECT *, list_sort(list_distinct(list_concat(a, x)))[1:{K}] AS u, {_LIKE.format("a", "x")} AS near_edited, {_LIKE.format("a", "b")} AS near_next FROM s)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(ed) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(x, '') AS edited_fingerprint,
  near_edited, near_next, {_SIZE.format("a")} AS n_distinct,
  CASE WHEN len(a) > 0 THEN least(1.0, near_edited * ({_SIZE.format("u")}) / ({_SIZE.format("a")})) ELSE 1.0 END AS kept_share FROM r"""

PHRASES = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, {LOW.format("coalesce(text, '')")} AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, 5)) AS m)),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY ALL),
cand AS MATERIALIZED (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND a >= 30),
often AS MATERIALIZED (SELECT * FROM f WHERE a >= 30),
cuts AS (SELECT lang, phrase, ws, m, a, unnest(range(1, m)) AS k FROM cand),
ends AS MATERIALIZED (SELECT lang, phrase, m, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail FROM cuts),
cut AS (SELECT e.lang, e.phrase, e.m, e.a, k, x.a AS l, y.a AS r, ((2000000::HUGEINT * e.a) // (x.a + y.a))::BIGINT AS score
        FROM ends e JOIN often x ON x.lang = e.lang AND x.phrase = head JOIN often y ON y.lang = e.lang AND y.phrase = tail),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase, m ORDER BY score, k) = 1),
part AS (SELECT lang, s, unnest(list_transform(range(1, len(ws) - s + 2), lambda i: array_to_string(ws[i:i + s - 1], ' '))) AS phrase, a
         FROM cand, (SELECT unnest(range(2, 4)) AS s) WHERE s < m),
inside AS (SELECT lang, s, phrase, max(a) AS longer FROM part GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside ON inside.lang = best.lang AND s = m AND inside.phrase = best.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score, k::INT AS k
FROM kept JOIN n ON n.lang = kept.lang QUALIFY rank <= 2000"""

TEXTS: dict[str, str] = {
    "op1_quality_rules": QUALITY, "op2_line_dedup": LINES, "op4_decontaminate": BENCHMARK, "op5_near_dup": NEAR, "op6_chat_format": CHAT,
    "op8_warc_fixity": FIXITY, "op9_secrets": _secrets(), "op10_url_filter": _hosts(),
    "op11_source_divergence": DIVERGENCE, "op12_fingerprints": FINGERPRINTS, "op13_phrases": PHRASES,
}
