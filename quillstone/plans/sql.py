"""The same adapters and queries in portable SQL, for an outside check."""

from __future__ import annotations

TYPES = """types AS (SELECT lower(r_name) || '/' || lower(n_name) AS import_path,
  (CASE WHEN o_orderkey % 3 = 0 THEN 'svc' ELSE 'Svc' END) || o_orderkey || (CASE o_orderkey % 7 WHEN 0 THEN 'Reader' WHEN 1 THEN 'Writer' WHEN 2 THEN 'Handler' WHEN 3 THEN 'Processor' WHEN 4 THEN 'Service' WHEN 5 THEN 'Controller' ELSE 'Impl' END) AS name,
  CASE o_orderkey % 4 WHEN 0 THEN 'interface' WHEN 1 THEN 'type' ELSE 'struct' END AS kind,
  o_orderkey % 3 <> 0 AS is_exported, o_orderkey AS type_id, o_orderpriority AS doc
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
METHODS = """methods AS (SELECT DISTINCT l_orderkey AS type_id, (CASE WHEN l_orderkey % 3 = 0 THEN '*' ELSE '' END) || 'T' || l_orderkey AS receiver_type,
  CASE p_type WHEN 'SMALL' THEN 'Read' WHEN 'LARGE' THEN 'Write' ELSE p_type END AS name,
  CASE WHEN p_size < 35 THEN '(x int) error' ELSE '(x string) error' END AS signature
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
TYPED = TYPES + ", " + METHODS + """, tm AS (SELECT import_path, types.name AS type_name, methods.name, signature, type_id FROM methods JOIN types USING (type_id))"""
_UP = "upper(substr({0}, 1, 1)) || substr({0}, 2)"
_N = "replace(p_name, ' ', '')"
_PKG = "lower(p_type) || '/' || lower(replace(p_brand, '#', ''))"
FUNCTIONS = f"""functions AS (SELECT {_PKG} AS import_path, {_PKG} || '/f' || (p_size % 5) || '.go' AS file_path, p_partkey AS ord,
  (CASE WHEN p_partkey % 2 = 0 THEN {_UP.format(_N)} ELSE {_N} END) || (p_size % 7) AS name, p_partkey % 2 = 0 AS is_exported, p_size % 5 = 0 AS is_method,
  CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS doc, p_size FROM part)"""
TESTS = f"""tests AS (SELECT import_path, name, min(body) AS body FROM (SELECT {_PKG} AS import_path,
  CASE WHEN p_size % 13 = 0 THEN 'TestNothing' ELSE 'Test' || {_UP.format(_N)} || ((p_size * 3 + 1) % 7) || (CASE p_size % 4 WHEN 0 THEN 'Success' WHEN 1 THEN 'Zzz' ELSE '' END) END AS name,
  CASE p_partkey % 6 WHEN 0 THEN 'testCases := []struct{{ name string }}{{}}' WHEN 1 THEN 't.Parallel()' WHEN 2 THEN 'given := 1 // when then' WHEN 3 THEN 'x := 1' WHEN 4 THEN 'cases := map[string]int{{}}' || chr(10) || 't.Parallel()' ELSE 'assert(x)' END AS body
  FROM part) GROUP BY import_path, name)"""
BENCHMARKS = f"""benchmarks AS (SELECT DISTINCT {_PKG} AS import_path, 'Benchmark' || {_UP.format(_N)} || ((p_size * 5 + 2) % 7) AS name FROM part)"""
MAP = """mapped AS (SELECT import_path, test_name, function_name, tier FROM (SELECT t.import_path, t.name AS test_name, f.name AS function_name,
  CASE WHEN f.name = substr(t.name, 5) THEN 1 WHEN f.name = lower(substr(t.name, 5, 1)) || substr(t.name, 6) THEN 2 ELSE 3 END AS tier,
  row_number() OVER (PARTITION BY t.import_path, t.name ORDER BY CASE WHEN f.name = substr(t.name, 5) THEN 1 WHEN f.name = lower(substr(t.name, 5, 1)) || substr(t.name, 6) THEN 2 ELSE 3 END, length(f.name) DESC, f.name) AS rn
  FROM tests t JOIN (SELECT DISTINCT import_path, name FROM functions) f ON t.import_path = f.import_path AND starts_with(lower(substr(t.name, 5)), lower(f.name))) WHERE rn = 1)"""
ALLTESTS = ", ".join([FUNCTIONS, TESTS, BENCHMARKS, MAP])
CLASSES = r"""classes AS (SELECT import_path, name, substr(name, 5) AS target, regexp_matches(body, '(?i)(table|test(case|data)s?|cases|fixtures|scenarios|inputs|examples).*(\[\]|\bmap\b)') AS is_table_test,
  regexp_matches(body, 't\.Parallel\(\)') AS is_parallel, regexp_matches(body, '(?i)(given|when|then|should|expect|assert)') AS is_bdd FROM tests)"""
HASBENCH = """hb AS (SELECT t.import_path, t.name, EXISTS (SELECT 1 FROM benchmarks b WHERE b.import_path = t.import_path AND starts_with(b.name, 'Benchmark' || substr(t.name, 5))) AS has_benchmark FROM tests t)"""
VARIABLES = """variables AS (SELECT lower(c_mktsegment) AS import_path, 'f' || (c_custkey % 10) || '.go' AS file_path, c_custkey AS ord,
  (CASE WHEN c_custkey % 2 = 0 THEN 'V' ELSE 'v' END) || (c_custkey % 50) AS name, lower(c_mktsegment) AS type, c_custkey::VARCHAR AS value, c_custkey % 2 = 0 AS is_exported, '' AS doc FROM customer)"""
ELEMENTS = """elements AS (SELECT source AS file_path, doc_id AS ord, CASE doc_id % 5 WHEN 0 THEN 'type' WHEN 1 THEN 'function' WHEN 2 THEN 'variable' WHEN 3 THEN 'constant' ELSE 'import' END AS kind, doc_id % 5 AS rk,
  doc_id::VARCHAR AS name, (sum(n_chars) OVER w - n_chars + 1)::BIGINT AS start_pos, (sum(n_chars) OVER w + 200)::BIGINT AS end_pos FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))"""
PROBES = "probes AS (SELECT event_id AS probe, 'src' || (event_id % 20) AS file_path, event_id * 37 + 1 AS pos FROM events)"
LOGS = """logs AS (SELECT user_id, string_agg('--- ' || (CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'PASS' END) || ': Test' || upper(substr(event_type, 1, 1)) || substr(event_type, 2) || event_id || ' (0.00s)', chr(10) ORDER BY event_id) AS output FROM events GROUP BY user_id)"""
IMPORTS = """imports AS (SELECT 'p' || (page_id % 10) AS import_path, page_id AS ord, regexp_extract(url, 'https?://([^/]+)', 1) AS path, CASE page_id % 4 WHEN 0 THEN '_' WHEN 1 THEN 'alias' ELSE '' END AS name, page_id % 4 = 0 AS is_blank FROM pages)"""
DEPENDENCIES = "dependencies AS (SELECT DISTINCT 'mod/' || o_orderpriority AS path, 'v' || (o_custkey % 10) AS version, o_orderstatus = 'P' AS indirect FROM orders)"
COMMON = """common AS (SELECT name, signature, string_agg(DISTINCT receiver_type, ',' ORDER BY receiver_type) AS types, count(DISTINCT receiver_type) AS n FROM methods GROUP BY name, signature HAVING count(DISTINCT receiver_type) > 1)"""
PATTERNS = """bytype AS (SELECT import_path, type_name, string_agg(DISTINCT name || signature, ';' ORDER BY name || signature) AS signatures, count(DISTINCT name || signature) AS n_sig FROM tm GROUP BY import_path, type_name),
  pat AS (SELECT signatures, n_sig, count(*) AS n_types, string_agg(type_name, ',' ORDER BY import_path, type_name) AS types, min(import_path) AS target_package,
    (CASE WHEN 2 * count(*) FILTER (ends_with(type_name, 'Reader')) >= count(*) THEN 'Reader' WHEN 2 * count(*) FILTER (ends_with(type_name, 'Writer')) >= count(*) THEN 'Writer'
      WHEN 2 * count(*) FILTER (ends_with(type_name, 'Handler')) >= count(*) THEN 'Handler' WHEN 2 * count(*) FILTER (ends_with(type_name, 'Processor')) >= count(*) THEN 'Processor'
      WHEN 2 * count(*) FILTER (ends_with(type_name, 'Service')) >= count(*) THEN 'Service' WHEN 2 * count(*) FILTER (ends_with(type_name, 'Controller')) >= count(*) THEN 'Controller'
      ELSE split_part(signatures, '(', 1) || (CASE WHEN ends_with(split_part(signatures, '(', 1), 'e') THEN 'r' ELSE 'er' END) END) AS interface_name
    FROM bytype GROUP BY signatures, n_sig HAVING count(*) >= 2)"""
_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '''', '&#39;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;')"


def esc(x: str) -> str:
    return _ESC.format(x)


def _code(x: str) -> str:
    out = esc(x)
    for k in ("func", "type", "struct", "interface", "package", "import", "const", "var", "return"):
        out = f"replace({out}, '{k} ', '<span class=\"keyword\">{k}</span> ')"
    return f"""array_to_string(list_transform(string_split({out}, '"'), lambda v, i: CASE WHEN i % 2 = 0 THEN '<span class="string">"' || v || '"</span>' ELSE v END), '')"""


_ANCHOR = "replace(replace(replace(lower({0}), ' ', '-'), '.', '-'), '/', '-')"


def q(with_: str, body: str) -> str:
    return f"WITH {with_} {body}"


CONSTANTS = """constants AS (SELECT 'nations/n' || (s_nationkey % 5) AS import_path, 'n' || s_nationkey || '.go' AS file_path, s_suppkey::INT AS ord, (CASE WHEN s_suppkey % 3 = 0 THEN 'C' ELSE 'c' END) || s_suppkey AS name,
  CASE WHEN s_suppkey % 2 = 0 THEN 'int' ELSE '' END AS type, (s_suppkey * 7)::VARCHAR AS value, s_suppkey % 3 = 0 AS is_exported, CASE WHEN s_suppkey % 4 = 0 THEN 'A constant' || chr(10) || 'of two lines' ELSE '' END AS doc FROM supplier)"""
#: The tables as one module: mt, mf, mv, mc (types, functions, variables, constants), and its packages.
MODEL = ", ".join([TYPES, FUNCTIONS, VARIABLES, CONSTANTS]) + """, mt AS (SELECT import_path, 't' || (type_id % 10) || '.go' AS file_path, type_id::INT AS ord, name, kind, is_exported, doc FROM types),
  mf AS (SELECT import_path, file_path, ord::INT AS ord, name, '(x int) error' AS signature, is_exported, doc FROM functions WHERE NOT is_method), mv AS (SELECT * REPLACE (ord::INT AS ord) FROM variables), mc AS (SELECT * FROM constants),
  files AS (SELECT import_path, file_path FROM mt UNION SELECT import_path, file_path FROM mf UNION SELECT import_path, file_path FROM mv UNION SELECT import_path, file_path FROM mc),
  packages AS (SELECT DISTINCT import_path, regexp_replace(regexp_extract(import_path, '[^/]*$'), '[^0-9A-Za-z_]', '', 'g') AS package, 'About ' || import_path AS documentation FROM files)"""


def _text(*parts: str) -> str:
    """Parts in a row: Python texts with a leading '=' are SQL, others literal."""
    return " || ".join(p[1:] if p.startswith("=") else "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" for p in parts)


def _if(condition: str, text: str) -> str:
    return f"=(CASE WHEN {condition} THEN {text} ELSE '' END)"


def _comment(doc: str) -> str:
    return _if(f"{doc} <> ''", f"'// ' || replace({doc}, chr(10), chr(10) || '// ') || chr(10)")


def _html(anchor: str, css: str, title: str, doc: str, code: str, word: str, part: str) -> str:
    note = _if(f"{doc} <> ''", _text('  <div class="doc-comment">', f"=replace({esc(doc)}, chr(10), '<br>')", "</div>\n"))
    return _text('<div id="', "=" + _ANCHOR.format(anchor), '" class="', "=" + css, f'">\n  <h4 class="{word}-name">', "=" + esc(title), "</h4>\n", note, f'  <div class="{word}-{part}">\n    <pre class="code">', "=" + _code(code), "</pre>\n  </div>\n</div>\n")


def _value(word: str, kind: str) -> str:
    code = _text(f"{word} ", "=name", _if("type <> ''", "' ' || type"), " = ", "=value")
    return _html("import_path || '.' || name", f"'{kind}'", f"'{word} ' || name", "doc", code, kind, "def")


_CSS = "'type type-' || (CASE kind WHEN 'type' THEN 'other' ELSE kind END)"
H_TYPE = _html("import_path || '.' || name", _CSS, "'type ' || name", "doc", "'type ' || name || ' ' || kind", "type", "def")
H_FUNCTION = "(" + _html("import_path || '.' || name", "'function'", "'func ' || name", "doc", "{0}", "function", "signature") + ")"
H_METHOD = _html("import_path || '.T<K>.' || name", "'method'", "'func (T<K>) ' || name", "doc", "'(x int)'", "method", "signature")
INDENTED = "'  ' || replace(left({0}, length({0}) - 1), chr(10), chr(10) || '  ') || chr(10)"


def _members(exported: str, t: str, f: str, v: str, c: str) -> str:
    return " UNION ALL ".join(f"SELECT import_path, {k} AS section, name, {x} AS text FROM {table} {exported}" for k, table, x in ((3, "mt", t), (4, "mf", f), (5, "mv", v), (6, "mc", c)))


_PARA = _if("doc <> ''", "doc || chr(10) || chr(10)")
MD_TYPE = _text("### Type: ", "=name", " (", "=kind", ")\n\n", _PARA, "```go\ntype ", "=name", " ", "=kind", "\n```\n\n")
MD_FUNCTION = _text("### Function: ", "=name", "\n\n", _PARA, "**Signature:** `", "=signature", "`\n\n```go\nfunc ", "=name", "=signature", "\n```\n\n")
MD_VARIABLE = _text("### Variable: ", "=name", "\n\n", _PARA, "**Type:** ", "=type", "\n\n```go\nvar ", "=name", " ", "=type", "\n```\n\n")
MD_CONSTANT = _text("### Constant: ", "=name", "\n\n", _PARA, "**Type:** ", "=type", "\n\n**Value:** ", "=value", "\n\n```go\nconst ", "=name", " ", "=type", " = ", "=value", "\n```\n\n")
_LINK = _if("is_exported", _text('        <li><a href="#', "=" + _ANCHOR.format("import_path || '.' || name"), '">', "=" + esc("name"), "</a></li>\n"))[1:]


def _section(kind: str, title: str, table: str) -> str:
    return f"{kind}s_list AS (SELECT import_path, " + _text(f'    <div class="{kind}s-section">\n      <h3>{title}</h3>\n      <ul class="{kind}-list">\n') + f" || string_agg({_LINK}, '' ORDER BY name, {_LINK}) || " + _text("      </ul>\n    </div>\n") + f" AS list FROM {table} GROUP BY import_path)"


_SOURCE = {
    "mc": _text(_comment("doc"), "const ", "=name", _if("type <> ''", "' ' || type"), " = ", "=value", "\n\n"),
    "mv": _text("var ", "=name", " ", "=type", " = ", "=value", "\n\n"),
    "mt": _text(_comment("doc"), "type ", "=name", " ", "=(CASE kind WHEN 'type' THEN 'string' ELSE kind || ' {' || chr(10) || '}' END)", "\n\n"),
    "mf": _text(_comment("doc"), "func ", "=name", "=signature", " {\n\treturn nil\n}\n\n"),
}
_DECLARED = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, import_path, file_path, name, {text} AS text, is_exported, {{doc}} AS doc FROM {table}"
    for kind, table, text in (("type", "mt", "kind"), ("function", "mf", "signature"), ("variable", "mv", "{value}"), ("constant", "mc", "{value}"))
)
_LAST = ", ".join(f"{x}last AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY import_path, name ORDER BY file_path DESC, ord DESC) AS rn FROM {x}) WHERE rn = 1)" for x in ("mt", "mf", "mv", "mc"))


RENAMED = """renamed AS (SELECT * EXCLUDE (hit, rn) FROM (SELECT *, row_number() OVER (PARTITION BY import_path, name ORDER BY hit DESC, file_path DESC, ord DESC) AS rn FROM
  (SELECT * REPLACE (CASE WHEN name = 'V4' THEN 'Global' ELSE name END AS name, CASE WHEN name = 'V4' THEN true ELSE is_exported END AS is_exported), (name = 'V4')::INT AS hit FROM variables)) WHERE name <> 'Global' OR rn = 1)"""

SQL = {
    "structure_summary": q(TYPES, "SELECT import_path, kind, count(*) AS total, count(*) FILTER (is_exported) AS exported FROM types GROUP BY import_path, kind"),
    "structure_exported": q(TYPES, "SELECT import_path, name, name || ' ' || kind AS line FROM types WHERE is_exported"),
    "structure_all": q(TYPES, "SELECT import_path, name, name || ' ' || kind || (CASE WHEN is_exported THEN '' ELSE ' (unexported)' END) AS line FROM types"),
    "interfaces_list": q(TYPES, "SELECT import_path, name, '' AS implementors FROM types WHERE kind = 'interface'"),
    "find_type": q(TYPES, "SELECT import_path, name, kind, doc FROM types WHERE import_path || '.' || name = (SELECT min(import_path || '.' || name) FROM types)"),
    "find_function": q(FUNCTIONS, "SELECT import_path, name, file_path, ord FROM functions WHERE import_path || '.' || name = (SELECT min(import_path || '.' || name) FROM functions) ORDER BY file_path, ord LIMIT 1"),
    "get_variable": q(VARIABLES, "SELECT import_path, file_path, name, value FROM variables WHERE import_path || '.' || name = (SELECT min(import_path || '.' || name) FROM variables)"),
    "associate_methods": q(TYPED, "SELECT import_path, type_name, name, signature FROM tm"),
    "types_without_methods": q(TYPES + ", " + METHODS, "SELECT import_path, name FROM types WHERE type_id NOT IN (SELECT type_id FROM methods)"),
    "receivers_grouped": q(METHODS, "SELECT receiver_type, ltrim(receiver_type, '*') AS base_type, starts_with(receiver_type, '*') AS is_pointer, count(*) AS n_methods, string_agg(name, ',' ORDER BY name) AS methods FROM methods GROUP BY receiver_type"),
    "receiver_summary": q(METHODS, "SELECT count(*) AS total_methods, count(DISTINCT receiver_type) AS receiver_types, count(*) FILTER (starts_with(receiver_type, '*')) AS pointer_methods, count(*) FILTER (NOT starts_with(receiver_type, '*')) AS value_methods FROM methods"),
    "methods_per_type": q(METHODS, "SELECT receiver_type, count(*) AS n_methods FROM methods GROUP BY receiver_type"),
    "base_type_groups": q(METHODS, "SELECT ltrim(receiver_type, '*') AS base_type, count(*) AS n_methods FROM methods GROUP BY 1"),
    "common_methods": q(METHODS + ", " + COMMON, "SELECT DISTINCT m.name, m.signature, receiver_type FROM methods m JOIN common USING (name, signature)"),
    "common_by_name": q(METHODS + ", " + COMMON, "SELECT name, signature, n AS n_types FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, signature) AS rn FROM common) WHERE rn = 1"),
    "extract_interfaces": q(METHODS + ", " + COMMON + """, rw AS (SELECT receiver_type, max(signature) FILTER (name = 'Read') AS r, max(signature) FILTER (name = 'Write') AS w FROM methods GROUP BY receiver_type HAVING count(*) FILTER (name = 'Read') > 0 AND count(*) FILTER (name = 'Write') > 0),
      joint AS (SELECT count(*) AS n, arg_min(r, receiver_type) AS r, arg_min(w, receiver_type) AS w FROM rw), best AS (SELECT name, signature FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, signature) AS rn FROM common) WHERE rn = 1 AND NOT (name IN ('Read', 'Write') AND (SELECT n FROM joint) > 1))""",
      """SELECT 'ReadWriter' AS interface_name, 'Read' || j.r || '; Write' || j.w AS methods, receiver_type AS source_type FROM rw, joint j WHERE n > 1
      UNION ALL SELECT DISTINCT m.name || 'er', m.name || m.signature, receiver_type FROM methods m JOIN best USING (name, signature)"""),
    "interface_code": q(TYPED + ", " + PATTERNS, "SELECT signatures, '// ' || interface_name || ' represents common behavior implemented by: ' || replace(types, ',', ', ') || chr(10) || 'type ' || interface_name || ' interface {' || chr(10) || chr(9) || replace(signatures, ';', chr(10) || chr(9)) || chr(10) || '}' AS code FROM pat"),
    "method_signatures": q(METHODS, "SELECT name, max(signature) AS signature FROM methods WHERE receiver_type = 'T1' GROUP BY name"),
    "method_patterns": q(TYPED + ", " + PATTERNS, "SELECT signatures, types, n_types FROM pat"),
    "pattern_names": q(TYPED + ", " + PATTERNS, "SELECT signatures, interface_name FROM pat"),
    "pattern_targets": q(TYPED + ", " + PATTERNS, "SELECT signatures, CASE WHEN EXISTS (SELECT 1 FROM tm WHERE import_path = 'asia/nation_2') THEN 'asia/nation_2' ELSE target_package END AS target_package FROM pat"),
    "extract_new_interfaces": q(TYPED + ", " + PATTERNS, "SELECT target_package, interface_name, signatures FROM (SELECT *, row_number() OVER (PARTITION BY target_package, interface_name ORDER BY n_types DESC, signatures) AS rn FROM pat p WHERE NOT EXISTS (SELECT 1 FROM types t WHERE t.kind = 'interface' AND t.import_path = p.target_package AND t.name = p.interface_name)) WHERE rn = 1"),
    "naming_default": q(TYPED + ", " + PATTERNS, "SELECT signatures, regexp_replace(regexp_replace(split_part(types, ',', 1), 'Impl$', ''), 'Implementation$', '') || 'Interface' AS interface_name FROM pat"),
    "naming_prefix": q(TYPED + ", " + PATTERNS, "SELECT signatures, upper(substr(regexp_extract(signatures, '[A-Za-z0-9]+'), 1, 1)) || substr(regexp_extract(signatures, '[A-Za-z0-9]+'), 2) || 'er' AS interface_name FROM pat"),
    "naming_suffix": q(TYPED + ", " + PATTERNS, "SELECT signatures, coalesce(nullif(regexp_extract(types || ',', '(Handler|Service|Repository),', 1), ''), 'Interface') AS interface_name FROM pat"),
    "exclude_filters": q(TYPED, "SELECT import_path, type_name, name FROM tm WHERE import_path NOT IN ('asia/nation_2', 'africa/nation_0') AND type_name NOT IN ('Svc1Writer') AND name NOT IN ('PROMO')"),
    "test_classify": q(ALLTESTS + ", " + CLASSES, "SELECT * FROM classes"),
    "test_map": q(ALLTESTS, "SELECT import_path, test_name, function_name, tier FROM mapped"),
    "test_unmapped": q(ALLTESTS, "SELECT t.import_path, t.name FROM tests t WHERE NOT EXISTS (SELECT 1 FROM mapped m WHERE m.import_path = t.import_path AND m.test_name = t.name)"),
    "has_benchmark": q(ALLTESTS + ", " + HASBENCH, "SELECT import_path, name, has_benchmark FROM hb"),
    "missing_tests": q(ALLTESTS, "SELECT DISTINCT import_path, name FROM functions f WHERE NOT is_method AND NOT regexp_matches(name, '^(Test|Benchmark)') AND NOT EXISTS (SELECT 1 FROM mapped m WHERE m.import_path = f.import_path AND m.function_name = f.name)"),
    "test_summary": q(ALLTESTS + ", " + CLASSES + """, c AS (SELECT import_path, count(*) AS total_tests, count(*) FILTER (is_table_test) AS table_tests, count(*) FILTER (is_parallel) AS parallel_tests FROM classes GROUP BY 1),
      b AS (SELECT import_path, count(*) AS benchmarks FROM benchmarks GROUP BY 1), m AS (SELECT import_path, count(DISTINCT function_name) AS tested FROM mapped GROUP BY 1),
      n AS (SELECT import_path, count(DISTINCT name) AS testable FROM functions WHERE NOT is_method AND NOT regexp_matches(name, '^(Test|Benchmark)') GROUP BY 1)""",
      """SELECT import_path, coalesce(total_tests, 0) AS total_tests, coalesce(table_tests, 0) AS table_tests, coalesce(parallel_tests, 0) AS parallel_tests, coalesce(benchmarks, 0) AS benchmarks, coalesce(tested, 0) AS tested, coalesce(testable, 0) AS testable,
      CASE WHEN coalesce(testable, 0) > 0 THEN round(coalesce(tested, 0)::DOUBLE / testable * 100, 6) ELSE 0.0::DOUBLE END AS coverage FROM c FULL JOIN b USING (import_path) FULL JOIN m USING (import_path) FULL JOIN n USING (import_path)"""),
    "test_patterns": q(ALLTESTS + ", " + CLASSES + ", " + HASBENCH + """, flat AS (SELECT name, import_path, unnest(['Table-Driven Tests', 'Parallel Tests', 'Functions with Benchmarks', 'BDD-Style Tests']) AS pattern, unnest([is_table_test, is_parallel, has_benchmark, is_bdd]) AS yes FROM classes JOIN hb USING (import_path, name)),
      r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY name, import_path) AS rn FROM flat WHERE yes)""", "SELECT pattern, count(*) AS n_tests, string_agg(name, ',' ORDER BY rn) FILTER (rn <= 3) AS examples FROM r GROUP BY pattern"),
    "test_template": q(ALLTESTS + """, want AS (SELECT DISTINCT import_path, name FROM functions f WHERE NOT is_method AND NOT regexp_matches(name, '^(Test|Benchmark)') AND NOT EXISTS (SELECT 1 FROM mapped m WHERE m.import_path = f.import_path AND m.function_name = f.name)),
      f AS (SELECT DISTINCT import_path, name, p_size % 2 = 0 AS p, p_size % 3 <> 2 AS r, '(' || (CASE WHEN p_size % 2 = 0 THEN 'a int' ELSE '' END) || ')' || (CASE p_size % 3 WHEN 0 THEN ' error' WHEN 1 THEN ' (int, error)' ELSE '' END) AS sig,
        CASE p_size % 3 WHEN 0 THEN 'error' WHEN 1 THEN '(int, error)' ELSE '' END AS result FROM functions JOIN want USING (import_path, name) WHERE NOT is_method),
      g AS (SELECT *, chr(9) || '// func ' || name || sig || chr(10) || chr(9) || '// ' || name || ': arrange, act, assert.' || chr(10) AS said, (CASE WHEN p OR r THEN '// got := ' ELSE '// ' END) || name || (CASE WHEN p THEN '(...)' ELSE '()' END) || chr(10) AS run FROM f)""",
      "SELECT import_path, name, min(code) AS code, kind FROM (" + " UNION ALL ".join(
        [f"SELECT import_path, name, '{k}' AS kind, " + _text("func Test", "=name", "(t *testing.T) {\n", "=said", "\t", "=run", _if("r", _text("\t// compare got with want, a ", "=result", "\n")), '\tt.Fatal("not written yet")\n}\n') + " AS code FROM g" for k in ("basic", "unknown")]
        + [f"SELECT import_path, name, '{k}', " + _text("func Test", "=name", "(t *testing.T) {\n" + own, "=said", "\tfor _, row := range []struct{ name string", _if("result = 'error'", "'; want error'"), ' }{{name: "first"}} {\n\t\tt.Run(row.name, func(t *testing.T) {\n' + inner + "\t\t\t", "=run",
            "=(CASE result WHEN 'error' THEN repeat(chr(9), 3) || '// compare got with row.want' || chr(10) WHEN '' THEN '' ELSE repeat(chr(9), 3) || '// compare what comes back' || chr(10) END)", '\t\t\tt.Fatal("not written yet")\n\t\t})\n\t}\n}\n') + " FROM g" for k, own, inner in (("table", "", ""), ("parallel", "\tt.Parallel()\n", "\t\t\tt.Parallel()\n"))]
      ) + ") GROUP BY import_path, name, kind"),
    "position_lookup": q(ELEMENTS + ", " + PROBES, "SELECT probe, kind, name FROM (SELECT probe, kind, name, row_number() OVER (PARTITION BY probe ORDER BY rk, ord) AS rn FROM probes p JOIN elements e ON p.file_path = e.file_path AND pos BETWEEN start_pos AND end_pos) WHERE rn = 1"),
    "position_string": q(ELEMENTS, "SELECT name, CASE WHEN ord % 7 = 0 THEN '<unknown position>' WHEN ord % 3 = 0 THEN file_path || ':' || start_pos || ':' || (ord % 80) ELSE file_path || ':' || start_pos || ':' || (ord % 80) || '-' || end_pos || ':' || (ord % 80) END AS position FROM elements"),
    "line_column": """SELECT doc_id, p AS pos, len(string_split(substr(text, 1, p - 1), chr(10)))::INT AS line, (p - coalesce(length(substr(text, 1, p - 1)) - nullif(strpos(reverse(substr(text, 1, p - 1)), chr(10)), 0) + 1, 0))::BIGINT AS col FROM (SELECT doc_id, text, CASE WHEN text IS NOT NULL THEN 1 + coalesce(doc_id * 31 % nullif(length(text), 0), 0) END AS p FROM documents)""",
    "test_log_parse": q(LOGS, r"SELECT user_id, array_to_string(regexp_extract_all(output, '--- (PASS|FAIL): (Test\w+)', 2), ',') AS tests, len(regexp_extract_all(output, '--- PASS: '))::BIGINT AS passed, len(regexp_extract_all(output, '--- FAIL: '))::BIGINT AS failed FROM logs"),
    "last_wins": q(VARIABLES, "SELECT import_path, name, value FROM (SELECT *, row_number() OVER (PARTITION BY import_path, name ORDER BY file_path DESC, ord DESC) AS rn FROM variables) WHERE rn = 1"),
    "rename_variable": q(VARIABLES + ", " + RENAMED, "SELECT import_path, file_path, name, value, is_exported FROM renamed"),
    "rename_changes": q(VARIABLES, "SELECT import_path, file_path, 0 AS line_number, 'V4' AS original, 'Global' AS new FROM variables WHERE name = 'V4'"),
    "chained_transform": q(VARIABLES, "SELECT DISTINCT file_path FROM variables WHERE name IN ('V4', 'v7')"),
    "html_escape": f"SELECT page_id, {esc('html')} AS escaped FROM pages",
    "doc_comment": f"SELECT doc_id, replace({esc('text')}, chr(10), '<br>') AS doc FROM documents",
    "format_code": "SELECT item_id, " + _code("'func F' || item_id || ' () { return \"' || text || '\" }'") + " AS code FROM benchmark",
    "sanitize_anchor": "SELECT page_id, " + _ANCHOR.format("url") + " AS anchor FROM pages",
    "kind_class": q(TYPES, "SELECT name, CASE kind WHEN 'struct' THEN 'type-struct' WHEN 'interface' THEN 'type-interface' WHEN 'alias' THEN 'type-alias' ELSE 'type-other' END AS css FROM types"),
    "split_csv": "SELECT doc_id, CASE WHEN text <> '' THEN array_to_string(list_transform(string_split(text, ','), lambda x: trim(x, ' ')), '|') END AS parts FROM documents",
    "env_vars": "SELECT page_id, array_to_string(list_filter(list_transform(string_split(url || ', A=1,,B=2 ', ','), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') AS env FROM pages",
    "relative_path": q(TYPES, "SELECT name, CASE WHEN starts_with(import_path, 'asia') THEN regexp_replace(substr(import_path, 5), '^/', '') ELSE import_path END AS path FROM types"),
    "exported": q(VARIABLES, "SELECT ord, regexp_matches(name, '^[A-Z]') AS exported FROM variables"),
    "signature_build": "SELECT p_partkey, '(' || (CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'a int' WHEN 2 THEN 'a int, b ...string' ELSE 'string' END) || ')' || (CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN ' error' WHEN 2 THEN ' n int' WHEN 3 THEN ' (int, error)' ELSE ' (n int, err error)' END) AS signature FROM part",
    "set_intersect": "SELECT p_partkey, array_to_string(list_filter([p_size % 3, p_size % 5, p_size % 3], lambda x: list_contains([1, 2], x)), ',') AS kept FROM part",
    "set_except": q(FUNCTIONS + ", " + BENCHMARKS, "SELECT import_path, name FROM functions EXCEPT SELECT import_path, substr(name, 10) FROM benchmarks"),
    "walk_counts": q(TYPES + ", " + METHODS + ", " + FUNCTIONS + ", " + VARIABLES + ", " + IMPORTS, """SELECT 'type' AS kind, count(*) AS visits FROM types WHERE is_exported UNION ALL SELECT 'field', count(*) FROM part WHERE p_size % 2 = 0 OR p_size % 3 = 0
      UNION ALL SELECT 'method', count(*) FROM methods UNION ALL SELECT 'function', count(*) FROM functions WHERE is_exported AND NOT is_method UNION ALL SELECT 'variable', count(*) FROM variables WHERE is_exported
      UNION ALL SELECT 'constant', count(*) FROM variables WHERE NOT is_exported AND false UNION ALL SELECT 'import', count(*) FROM imports"""),
    "render_markdown": q(MODEL, "SELECT import_path, string_agg(text, '' ORDER BY section, name, text) AS document FROM (SELECT import_path, 1 AS section, '' AS name, " + _text("## Package ", "=package", "\n\n", "=documentation", "\n\n") + " AS text FROM packages UNION ALL " + _members("WHERE is_exported", MD_TYPE, MD_FUNCTION, MD_VARIABLE, MD_CONSTANT) + ") GROUP BY import_path"),
    "render_html": q(MODEL + ", " + _section("type", "Types", "mt") + ", " + _section("function", "Functions", "mf"), "SELECT import_path, string_agg(text, '' ORDER BY section, name, text) AS document FROM (SELECT import_path, 1 AS section, '' AS name, "
      + _text('  <div id="', "=" + _ANCHOR.format("import_path"), '" class="package">\n    <h2 class="package-name">Package ', "=" + esc("package"), '</h2>\n    <div class="doc-comment">', "=" + esc("documentation"), "</div>\n", "=coalesce(t.list, '')", "=coalesce(f.list, '')", "  </div>\n")
      + " AS text FROM packages LEFT JOIN types_list t USING (import_path) LEFT JOIN functions_list f USING (import_path) UNION ALL SELECT import_path, section, name, " + INDENTED.format("text") + " FROM (" + _members("WHERE is_exported", H_TYPE, H_FUNCTION.replace("{0}", "signature"), _value("var", "variable"), _value("const", "constant")) + ")) GROUP BY import_path"),
    "render_go_source": q(MODEL, "SELECT import_path, file_path, import_path AS folder, 'package ' || any_value(package) || chr(10) || chr(10) || string_agg(text, '' ORDER BY section, ord) AS source, true AS changed FROM (" + " UNION ALL ".join(f"SELECT import_path, file_path, {k} AS section, ord, {_SOURCE[x]} AS text FROM {x}" for k, x in ((2, "mc"), (3, "mv"), (4, "mt"), (5, "mf"))) + ") JOIN packages USING (import_path) GROUP BY import_path, file_path"),
    "render_gomod": q(DEPENDENCIES, "SELECT 'demo' AS module_path, " + _text("module demo\n\ngo 1.23\n\nrequire (\n") + " || string_agg(chr(9) || p || ' ' || version || (CASE WHEN indirect THEN ' // indirect' ELSE '' END) || chr(10), '' ORDER BY p) || ')' || chr(10) AS text FROM (SELECT *, path || '@' || version || '@' || indirect AS p FROM dependencies)"),
    "parse_go_source": q(MODEL, _DECLARED.format(doc="trim(replace(doc, chr(10), ' '))", value="type || ' ' || value")),
    "json_roundtrip": q(MODEL + ", " + _LAST, _DECLARED.format(doc="doc", value="value").replace(" FROM mt", " FROM mtlast").replace(" FROM mf", " FROM mflast").replace(" FROM mv", " FROM mvlast").replace(" FROM mc", " FROM mclast")),
    "visit_counts": q(MODEL, "SELECT 'package' AS kind, count(*) AS visits FROM packages UNION ALL SELECT 'file', count(*) FROM files UNION ALL SELECT 'import', 0 UNION ALL SELECT 'field', 0 UNION ALL SELECT 'method', 0 UNION ALL " + " UNION ALL ".join(f"SELECT '{k}', count(*) FROM {x} WHERE is_exported" for k, x in (("type", "mt"), ("function", "mf"), ("variable", "mv"), ("constant", "mc")))),
    "structure_report": q(MODEL + ", named AS (SELECT DISTINCT import_path, name, is_exported FROM mf)", "SELECT import_path, 0 AS section, '' AS name, '  ' || import_path AS line FROM packages UNION ALL SELECT import_path, 1, '', '    Types (' || count(*) || '):' FROM mt GROUP BY import_path UNION ALL SELECT import_path, 2, name, '      ' || name || ' ' || kind || (CASE WHEN is_exported THEN '' ELSE ' (unexported)' END) FROM mt UNION ALL SELECT import_path, 3, '', '    Functions (' || count(*) || '):' FROM named GROUP BY import_path UNION ALL SELECT import_path, 4, name, '      ' || name || (CASE WHEN is_exported THEN '' ELSE ' (unexported)' END) FROM named"),
    "markdown_members": q(", ".join([FUNCTIONS, VARIABLES, CONSTANTS]), "SELECT CASE WHEN is_method THEN 'method' ELSE 'function' END AS kind, ord, CASE WHEN is_method THEN " + _text("### Method: ", _if("is_exported", "'(T) '"), "=name", "\n\n", _PARA, _if("ord % 3 <> 0", _text("**Signature:** `(x int)`\n\n```go\nfunc ", _if("is_exported", "'(T) '"), "=name", "(x int)\n```\n\n"))) + " ELSE " + _text("### Function: ", "=name", "\n\n", _PARA, _if("ord % 3 <> 0", _text("**Signature:** `(x int)`\n\n")))
      + f" END AS text FROM functions UNION ALL SELECT 'variable', ord, {MD_VARIABLE} FROM variables UNION ALL SELECT 'constant', ord, {MD_CONSTANT} FROM constants"),
    "html_members": q(", ".join([FUNCTIONS, VARIABLES, CONSTANTS]), "SELECT CASE WHEN is_method THEN 'method' ELSE 'function' END AS kind, ord, CASE WHEN is_method THEN " + H_METHOD + " ELSE " + H_FUNCTION.replace("{0}", "'(x int)'") + " END AS html FROM functions UNION ALL SELECT 'variable', ord, " + _value("var", "variable") + " FROM variables UNION ALL SELECT 'constant', ord, " + _value("const", "constant") + " FROM constants"),
    "receiver_texts": "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' ELSE (CASE WHEN p_size % 2 = 0 THEN 'r ' ELSE '' END) || (CASE WHEN p_size % 3 = 0 THEN '*' ELSE '' END) || p_type END AS receiver FROM part",
    "signature_split": q(METHODS, "SELECT type_id, CASE WHEN type_id % 5 = 0 THEN name ELSE name || signature END AS \"full\", name, CASE WHEN type_id % 5 = 0 THEN '' ELSE signature END AS rest FROM methods"),
    "visible_files": q(FUNCTIONS, "SELECT import_path, file_path, ord FROM functions WHERE ord % 3 <> 0 AND ord % 4 <> 0"),
    "struct_methods": q(TYPED, "SELECT tm.import_path, type_name, tm.name, signature FROM tm JOIN types USING (type_id) WHERE kind = 'struct'"),
    "test_report": q(ALLTESTS + ", " + CLASSES + """, c AS (SELECT import_path, count(*) AS total_tests, count(*) FILTER (is_table_test) AS table_tests, count(*) FILTER (is_parallel) AS parallel_tests FROM classes GROUP BY 1),
      b AS (SELECT import_path, count(*) AS benchmarks FROM benchmarks GROUP BY 1), m AS (SELECT import_path, count(DISTINCT function_name) AS tested FROM mapped GROUP BY 1),
      n AS (SELECT import_path, count(DISTINCT name) AS testable FROM functions WHERE NOT is_method AND NOT regexp_matches(name, '^(Test|Benchmark)') GROUP BY 1), s AS (SELECT * FROM c FULL JOIN b USING (import_path) FULL JOIN m USING (import_path) FULL JOIN n USING (import_path))""",
      "SELECT import_path, 'summary' AS part, k AS name, coalesce(v, 0)::VARCHAR AS value FROM (SELECT import_path, unnest(['total_tests', 'table_tests', 'parallel_tests', 'benchmarks', 'tested', 'testable']) AS k, unnest([total_tests, table_tests, parallel_tests, benchmarks, tested, testable]) AS v FROM s) UNION ALL SELECT import_path, 'map', test_name, function_name FROM mapped UNION ALL SELECT t.import_path, 'unmapped', t.name, '' FROM tests t WHERE NOT EXISTS (SELECT 1 FROM mapped m WHERE m.import_path = t.import_path AND m.test_name = t.name)"),
    "list_contains": "SELECT p_partkey, p_size % 2 = 0 AS short, true AS verbose, p_brand AS types, '' AS \"none\", 'A,' || p_type || ',B,C' AS sources FROM part",
    "parents": q(MODEL, "SELECT import_path, name, ord, file_path AS file_name, package AS package_name, 'demo' AS module_path FROM mv JOIN packages USING (import_path)"),
    "upserted": q(MODEL, "SELECT import_path, file_path, name, ord, value FROM mv WHERE name NOT IN ('V4', 'v7') UNION ALL SELECT import_path, file_path, name, ord, 'new' FROM (SELECT *, row_number() OVER (PARTITION BY import_path, name ORDER BY ord DESC) AS rn FROM mv WHERE name IN ('V4', 'v7')) WHERE rn = 1"),
    "chain_dry_run": q(VARIABLES, "SELECT import_path, file_path, 0 AS line_number, 'V4' AS original, 'Global' AS new FROM variables WHERE name = 'V4' UNION ALL SELECT import_path, file_path, 0, 'v7', 'local' FROM variables WHERE name = 'v7'"),
}
