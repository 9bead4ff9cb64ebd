"""DuckDB SQL for the queries of this subpackage that SQL can express. Each is written from the contract, not from the operator."""

from __future__ import annotations

from emberframe.llm import quality_rules, url_filter

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i + 1:i + least(10, len(w))], ' ') AS s FROM b, UNNEST(range(len(w) - least(10, len(w)) + 1)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT rid, i, n, array_to_string(w[i + 1:i + n], ' ') AS s FROM d, (SELECT DISTINCT n FROM bw) AS ns, UNNEST(range(greatest(0, len(w) - n + 1))) AS t(i)),
h AS (SELECT rid, i, dw.n, item FROM dw JOIN bw ON bw.n = dw.n AND bw.s = dw.s),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, i, n FROM h) AS q, UNNEST(range(i, i + n)) AS t(p) GROUP BY rid),
k AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (rid) LEFT JOIN k USING (rid)
"""

JACCARD = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT key, min(doc_id) AS least, any_value(w) AS w, row_number() OVER (ORDER BY key) AS n FROM (SELECT doc_id, array_to_string(w, ' ') AS key, w FROM d WHERE len(w) > 0) GROUP BY key),
s AS (SELECT DISTINCT n, array_to_string(w[i + 1:i + 5], ' ') AS g FROM t, UNNEST(range(greatest(1, len(w) - 4))) AS u(i)),
z AS (SELECT n, count(*) AS size FROM s GROUP BY n),
p AS (SELECT a.n AS a, b.n AS b, count(*) AS c FROM s a JOIN s b ON b.g = a.g AND a.n <> b.n GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN z x ON x.n = p.a JOIN z y ON y.n = p.b WHERE 5 * c >= 4 * (x.size + y.size - c)),
r AS (SELECT n AS a, n AS b FROM t UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT r.a AS n, min(least) AS class_id FROM r JOIN t ON t.n = r.b GROUP BY 1),
l AS (SELECT a AS n, count(*) AS links FROM e GROUP BY 1)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(links, 0) AS n_links FROM d LEFT JOIN t ON t.key = array_to_string(d.w, ' ') AND len(d.w) > 0 LEFT JOIN m ON m.n = t.n LEFT JOIN l ON l.n = t.n
"""


def _url_filter() -> str:
    def fits(rule: str) -> str:
        name, _, rest = rule.partition("/")
        return f"(host = '{name}' OR host LIKE '%.{name}') AND starts_with(path, '/{rest}')"

    rules = " ".join(f"WHEN {fits(r)} THEN '{r}'" for r in sorted(url_filter.RULES, key=len, reverse=True))
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in url_filter.RULES.items())
    host = r"regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1)"
    d, n = url_filter.DAMPING, url_filter.ITERATIONS

    def spread(name: str, verdict: str, src: str, dst: str) -> str:
        return f"""{name}_seeds AS (SELECT host, count(*) * 1e0 / sum(count(*)) OVER () AS rank FROM j WHERE ruled = '{verdict}' GROUP BY host),
{name}_flow AS (SELECT {src} AS src, {dst} AS dst, n * 1e0 / sum(n) OVER (PARTITION BY {src}) AS w FROM edges),
{name}_ranks AS (SELECT 0 AS k, host, rank FROM {name}_seeds UNION ALL SELECT k + 1, host, sum(x) FROM (SELECT k, dst AS host, rank * w * {d} AS x FROM {name}_ranks JOIN {name}_flow ON src = host WHERE k < {n}
  UNION ALL SELECT k, s.host, s.rank * {1 - d:.2f} FROM {name}_seeds s, (SELECT DISTINCT k FROM {name}_ranks WHERE k < {n}) AS ks) AS q GROUP BY k, host)"""

    lower = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE u AS (SELECT page_id, html, coalesce({lower.format(host.format("url"))}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
j0 AS (SELECT *, CASE {rules} END AS rule FROM u),
j AS (SELECT *, CASE rule {verdicts} END AS ruled FROM j0),
links AS (SELECT host AS src, {lower.format(host.format("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END"))} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)', 1)) AS link FROM u WHERE host <> '') AS q),
edges AS (SELECT src, dst, count(*) AS n FROM links WHERE dst <> '' AND dst <> src GROUP BY ALL),
{spread("t", "allow", "src", "dst")},
{spread("b", "block", "dst", "src")},
sc AS (SELECT coalesce(a.host, c.host) AS host, coalesce(a.rank, 0) AS trust, coalesce(c.rank, 0) AS distrust FROM (SELECT * FROM t_ranks WHERE k = {n}) a FULL JOIN (SELECT * FROM b_ranks WHERE k = {n}) c ON c.host = a.host)
SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN distrust > {url_filter.THRESHOLD} * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict, round(coalesce(trust, 0), 9) AS trust, round(coalesce(distrust, 0), 9) AS distrust FROM j LEFT JOIN sc ON sc.host = j.host
"""


def _quality() -> str:
    q = quality_rules
    rules = list(q.RULES)
    cuts = ", ".join(f"{c!r}e0" for c in q.CUTOFFS)
    never, size = len(rules) * len(q.CUTOFFS), len(q.CUTOFFS)
    ratios = " UNION ALL ".join(f"SELECT rid, {i} AS rule, {r.replace('/', '* 1e0 /')} AS ratio FROM st WHERE NOT base_failed" for i, r in enumerate(q.RULES.values()))
    tail = f"ln(list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({q.ALPHA!r}e0) + (n - i) * ln(1 - {q.ALPHA!r}e0)))))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS g, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tri AS (SELECT rid, i, array_to_string(w[i + 1:i + 3], ' ') AS s FROM d, UNNEST(range(greatest(0, len(w) - 2))) AS u(i)),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM tri) AS q WHERE c > 1) AS q2, (VALUES (0), (1), (2)) AS v(o) GROUP BY rid),
ln_ AS (SELECT rid, x FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) AS q WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
li AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT x) AS dup FROM ln_ GROUP BY rid),
s0 AS (SELECT d.rid, doc_id, g, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines FROM d LEFT JOIN li ON li.rid = d.rid LEFT JOIN rep ON rep.rid = d.rid),
st AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s0),
lab AS (SELECT st.rid, g, quality FROM st JOIN (SELECT DISTINCT doc_id, quality FROM labels WHERE quality IN (0, 1)) AS l ON l.doc_id = st.doc_id),
fi AS (SELECT rid, rule, len(list_filter([{cuts}], lambda c: ratio <= c)) AS f FROM ({ratios}) AS q),
rk AS (SELECT r.rule, row_number() OVER (ORDER BY coalesce(hits, 0) DESC, r.rule) - 1 AS place FROM (VALUES {", ".join(f"({i})" for i in range(len(rules)))}) AS r(rule)
  LEFT JOIN (SELECT rule, count(*) AS hits FROM fi JOIN lab ON lab.rid = fi.rid WHERE quality = 0 AND f < {size} GROUP BY rule) AS h ON h.rule = r.rule),
sp AS (SELECT rid, min(CASE WHEN f < {size} THEN place * {size} + f ELSE {never} END) AS step FROM fi JOIN rk ON rk.rule = fi.rule GROUP BY rid),
se AS (SELECT DISTINCT step AS setting FROM sp JOIN lab ON lab.rid = sp.rid WHERE quality = 0 AND step < {never}),
gd AS (SELECT g, coalesce(step, {never}) AS step FROM lab LEFT JOIN sp ON sp.rid = lab.rid WHERE quality = 1),
sz AS (SELECT g, count(*) AS n FROM gd GROUP BY g HAVING (1 - {q.ALPHA!r}e0) ** count(*) <= {q.DELTA!r}e0),
k AS (SELECT sz.g, n, setting, (SELECT count(*) FROM gd WHERE gd.g = sz.g AND gd.step <= se.setting) AS k FROM sz CROSS JOIN se),
ok AS (SELECT *, CASE WHEN k >= n * {q.ALPHA!r}e0 THEN false ELSE {tail} <= ln({q.DELTA!r}e0 / (SELECT count(*) FROM sz)) END AS good FROM k),
ch AS (SELECT g, max(setting) AS last FROM ok AS a WHERE NOT EXISTS (SELECT 1 FROM ok AS b WHERE b.g = a.g AND b.setting <= a.setting AND NOT b.good) GROUP BY g)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(step <= last, false) AS kept FROM st LEFT JOIN sp ON sp.rid = st.rid LEFT JOIN ch ON ch.g = st.g
"""


ORACLE_SQL = {"op4_url_filter": _url_filter(), "op6_jaccard_join": JACCARD, "op7_decontamination": DECONTAMINATION, "op8_quality_rules": _quality()}
