"""SQL with the rows of the queries in tables.py and rule_tables.py."""

from tessella.plans import rule_tables

_H = "sha256({})[1:16]"
_FLAT = r"trim(regexp_replace({}, '[ \t\n\r\f]+', ' ', 'g'), ' ')"
_GROUPS = f"""
WITH e AS (SELECT doc_id, {_H.format(_FLAT.format('text'))} AS hash, lpad(doc_id::VARCHAR, 12, '0') AS f, doc_id % 3 <> 0 AS ok FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY f) AS rn, count(*) OVER (PARTITION BY hash) AS n FROM e)
"""
_DIAG = "d AS (SELECT 'src/u' || user_id AS file, event_type AS rule_id, CASE WHEN value >= 90 THEN 'error' WHEN value >= 40 THEN 'warning' ELSE 'info' END AS severity, floor(value)::INT AS line, event_id AS seq FROM events)"
_LINES = f"""
l AS (SELECT doc_id AS block, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10)))))::INT AS pos FROM documents),
s AS (SELECT block, pos, {_H.format('line')} AS h, length(line) AS size FROM l WHERE trim(line, ' ') <> ''),
pair AS (SELECT a.block AS ab, b.block AS bb, a.pos AS ap, b.pos AS bp, b.pos - a.pos AS dia FROM s a JOIN s b ON a.h = b.h AND (a.block <> b.block OR a.pos <> b.pos)),
isl AS (SELECT *, ap - row_number() OVER (PARTITION BY ab, bb, dia ORDER BY ap) AS i FROM pair),
runs AS (SELECT ab, bb, min(ap) AS ap, min(bp) AS bp, count(*)::INT AS n FROM isl GROUP BY ab, bb, dia, i HAVING count(*) >= 3)
"""
ORACLES = {
    "dup_file": _GROUPS + "SELECT hash, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY f) AS doc_ids FROM r WHERE n >= 2 GROUP BY hash",
    "report_target": _GROUPS
    + """, t AS (SELECT hash, coalesce(min(CASE WHEN ok AND rn >= 2 THEN rn END), min(CASE WHEN ok THEN rn END)) AS pick FROM r WHERE n >= 2 GROUP BY hash)
SELECT r.hash, max(CASE WHEN rn = pick THEN doc_id END) AS host, string_agg(f, ', ' ORDER BY f) FILTER (WHERE rn <> pick) AS others FROM r JOIN t ON r.hash = t.hash WHERE pick IS NOT NULL GROUP BY r.hash""",
    "first_reportable": _GROUPS + "SELECT hash, min(doc_id) AS host FROM r WHERE n >= 2 AND ok GROUP BY hash",
    "near_dup": r"""SELECT sha256(norm)[1:16] AS line_hash, count(*) AS n, count(DISTINCT line) AS n_texts, min(doc_id) AS first_doc FROM (
SELECT *, regexp_replace(lower(trim(regexp_replace(line, '[^\p{L}0-9]+', ' ', 'g'))), '[0-9]+', '#', 'g') AS norm FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
WHERE length(norm) >= 32 GROUP BY norm HAVING count(DISTINCT line) > 1""",
    "normalized_body": r"""WITH a AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(text, '"(?:[^"\\]|\\.)*"', '"__STR__"', 'g'), '''(?:[^''\\]|\\.)*''', '"__STR__"', 'g'), '`(?:[^`\\]|\\.)*`', '"__STR__"', 'g') AS x FROM conversations),
b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(x, '\b\d+(?:\.\d+)?\b', '__NUM__', 'g'), '\bde\b', '$0', 'g'), '\bthe\b', '$1', 'g') AS y FROM a),
c AS (SELECT *, regexp_replace(regexp_replace(y, '\bthis\s*\.\s*', '$_.', 'g'), '\$\d+\s*\.\s*', '$_.', 'g') AS z FROM b)
SELECT conv_id, turn, sha256(trim(regexp_replace(z, '[\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g'), ' '))[1:16] AS normalized_hash,
(length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')))::INT AS body_len FROM c""",
    "near_dup_url": "SELECT regexp_replace(url, '[0-9]+', 'N', 'g') AS shape, count(DISTINCT url) AS n_urls, min(page_id) AS first_page FROM pages GROUP BY 1 HAVING count(DISTINCT url) > 1",
    "name_collision": "SELECT p_name AS name, count(*) AS n_parts, count(DISTINCT p_brand) AS n_brands FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1",
    "name_segments": r"""WITH n AS (SELECT DISTINCT name FROM (SELECT event_type AS name FROM events UNION ALL SELECT replace(p_type, ' ', '_') FROM part)),
p AS (SELECT DISTINCT name, lower(x) AS x FROM (SELECT name, unnest(string_split(regexp_replace(name, '([a-z])([A-Z])', '\1_\2', 'g'), '_')) AS x FROM n) WHERE x <> '')
SELECT name, string_agg(x, ',' ORDER BY x) AS segments FROM p GROUP BY name""",
    "maximal_runs": f"""WITH {_LINES},
sets AS (SELECT ab, ap, len, list_sort(list_distinct(list_append(list(bb::VARCHAR || ':' || bp), ab::VARCHAR || ':' || ap))) AS q, list_sort(list_append(list({{'b': bb, 'p': bp}}), {{'b': ab, 'p': ap}})) AS o
  FROM (SELECT *, unnest(range(3, n + 1)) AS len FROM runs) GROUP BY ab, ap, len),
kept AS (SELECT DISTINCT x.len, x.q, x.o FROM sets x LEFT JOIN sets y ON x.ab = y.ab AND x.ap = y.ap AND y.len = x.len + 1 WHERE y.q IS NULL OR len(y.q) <> len(x.q)),
top AS (SELECT * FROM kept k WHERE NOT EXISTS (SELECT 1 FROM kept m WHERE m.len = k.len AND len(m.q) > len(k.q) AND list_has_all(m.q, k.q))),
big AS (SELECT t.len, t.o FROM top t JOIN s ON s.block = t.o[1].b AND s.pos >= t.o[1].p AND s.pos < t.o[1].p + t.len GROUP BY t.len, t.o HAVING sum(size) >= 128)
SELECT len AS length, array_to_string(list_transform(o, lambda e: e.b::VARCHAR || ':' || e.p), ',') AS places FROM big""",
    "repeated_literal": f"SELECT {_H.format('value')} AS value_hash, count(DISTINCT source) AS n_scopes, count(DISTINCT lang) AS n_keys, min(doc_id) AS first_doc FROM (SELECT source, lang, doc_id, unnest(string_split(text, chr(10))) AS value FROM documents) WHERE length(value) > 20 GROUP BY value HAVING count(DISTINCT source) >= 5 AND count(DISTINCT lang) <> 1",
    "return_shape": "SELECT shape, count(*) AS n, min(o_custkey) AS first_customer FROM (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS shape, count(DISTINCT o_orderpriority) AS k FROM orders GROUP BY o_custkey) WHERE k >= 2 GROUP BY shape HAVING count(*) >= 3",
    "shape_hash": f"SELECT event_type, {_H.format(chr(39) + '{' + chr(39) + ' || string_agg(DISTINCT k || ' + chr(39) + '?:any' + chr(39) + ', ' + chr(39) + ';' + chr(39) + ' ORDER BY k || ' + chr(39) + '?:any' + chr(39) + ') || ' + chr(39) + '}' + chr(39))} AS shape FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events) GROUP BY event_type",
    "constant_arg": """WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linestatus) AS s, min(l_linestatus) AS st, count(DISTINCT l_returnflag) AS r, min(l_returnflag) AS rf FROM lineitem GROUP BY 1 HAVING count(*) >= 3)
SELECT l_orderkey, 'l_linestatus' AS param, st AS value, n FROM g WHERE s = 1 UNION ALL SELECT l_orderkey, 'l_returnflag', rf, n FROM g WHERE r = 1""",
    "arg_never_used": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 2 AND max(l_discount) = 0",
    "arg_always_used": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 2 AND min(l_tax) > 0",
    "unused_export": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "dead_overload": """WITH f AS (SELECT c_custkey AS o_custkey, p.o_orderpriority FROM customer, (SELECT DISTINCT o_orderpriority FROM orders) p), u AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders),
m AS (SELECT f.*, u.o_custkey IS NOT NULL AS hit, count(u.o_custkey) OVER (PARTITION BY f.o_custkey) AS live FROM f LEFT JOIN u ON f.o_custkey = u.o_custkey AND f.o_orderpriority = u.o_orderpriority)
SELECT o_custkey, o_orderpriority, live FROM m WHERE NOT hit AND live > 0""",
    "explicit_null_arg": "SELECT event_id, event_type FROM events WHERE json_extract_string(props, '$.k') = '0'",
    "name_collision_unlinked": """WITH g AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) >= 2),
x AS (SELECT DISTINCT o_custkey, o_orderpriority FROM (SELECT o_custkey, o_orderpriority, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL HAVING count(DISTINCT o_orderkey) > 1))
SELECT g.* FROM g ANTI JOIN x ON g.o_custkey = x.o_custkey AND g.o_orderpriority = x.o_orderpriority""",
    "edges": """SELECT target, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) GROUP BY target""",
    "heritage": "SELECT a.o_orderkey AS child, b.o_orderkey AS ancestor FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderkey < a.o_orderkey",
    "policy_resolve": """WITH r AS (SELECT DISTINCT event_type AS rule_id FROM events), v AS (SELECT rule_id, CASE WHEN substr(rule_id, 1, 1) = 's' THEN 'error' WHEN rule_id = 'purchase' THEN 'info' WHEN rule_id LIKE 'c%' THEN 'error' WHEN rule_id = 'view' THEN 'off' ELSE 'warning' END AS severity FROM r)
SELECT * FROM v WHERE severity <> 'off'""",
    "overrides": f"""WITH {_DIAG}, o AS (SELECT rule_id, CASE WHEN file = 'src/u22' AND rule_id = 'view' THEN 'error' WHEN file LIKE 'src/u2%' THEN 'info' WHEN file LIKE 'src/u1%' AND rule_id = 'click' THEN 'off' ELSE severity END AS severity FROM d)
SELECT rule_id, severity, count(*) AS n FROM o WHERE severity <> 'off' GROUP BY ALL""",
    "dedupe": f"WITH {_DIAG} SELECT file, line, rule_id, severity, seq FROM (SELECT *, row_number() OVER (PARTITION BY file, line, rule_id ORDER BY seq) AS rn FROM d) WHERE rn = 1",
    "baseline_ratchet": "SELECT doc_id, source, lang FROM (SELECT *, count(*) OVER (PARTITION BY source, lang) AS n FROM documents) WHERE n > CASE WHEN lang = 'en' THEN 30 ELSE 9 END",
    "make_baseline": f"WITH {_DIAG} SELECT file, rule_id, count(*)::INT AS allowed FROM d GROUP BY ALL",
    "exit_code": f"""WITH {_DIAG}, t AS (SELECT rule_id, max(CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END) AS top FROM d GROUP BY 1), f AS (SELECT unnest(['none', 'error', 'warning', 'info']) AS fail_on)
SELECT rule_id, fail_on, CASE WHEN fail_on = 'none' THEN 0 WHEN top = 3 THEN 2 WHEN fail_on = 'error' THEN 0 WHEN fail_on = 'warning' AND top = 1 THEN 0 ELSE 1 END::INT AS exit_code FROM t, f""",
    "summary": f"WITH {_DIAG} SELECT rule_id, count(*) AS n FROM d GROUP BY 1",
    "flat_report": f"WITH {_DIAG} SELECT seq, file || ':' || line || ':1 ' || severity || ' [' || rule_id || '] seen' AS value FROM d",
    "suppression": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "annotation": f"SELECT a.conv_id, a.turn::INT AS turn, {_H.format('u.text')} AS annotation FROM conversations a LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user' WHERE a.role = 'assistant'",
    "incremental": f"SELECT doc_id, {_H.format('text')} AS content_hash FROM documents WHERE source = 'src3' OR lang = 'de' OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "nearest_group": """WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?:/', ''), '[?#].*$', '') AS file FROM pages), f AS (SELECT folder FROM (SELECT regexp_replace(file, '/[^/]*$', '') AS folder FROM p) GROUP BY 1 HAVING count(*) >= 2)
SELECT page_id, (SELECT max_by(folder, length(folder)) FROM f WHERE starts_with(p.file, f.folder || '/')) AS folder FROM p""",
    "path_filters": r"""WITH p AS (SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages)
SELECT regexp_extract(path, '^([^/]*)', 1) AS host, count(*) AS n FROM p
WHERE NOT (CASE WHEN regexp_matches(path, '^blog\.[^/]*/fr/.*$') THEN true WHEN regexp_matches(path, '^(?:.*/)?[^/]*5\.html$') THEN false WHEN regexp_matches(path, '\.html$') THEN true WHEN regexp_matches(path, '^(.*/)?m\.[^/]*/.*$') THEN true ELSE false END) GROUP BY 1""",
    **rule_tables.ORACLES,
}
