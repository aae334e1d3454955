"""The rules over fact tables made of the generic tables, whole tables each, with the SQL that gives the same rows.

Facts are arithmetic on keys: `x % m % n` reads the same in Spark and in DuckDB, so
one specification makes the columns of both. Every query runs the rules' own
code (operators/rules_node.py, operators/rules_cross.py); the SQL states what a
rule means over the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import rules_cross, rules_node
from tessella.schema import EXPR_FACTS

QUERIES, ORACLES = {}, {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def pick_spark(k: int, m: int, values: list[str | None]) -> str:
    return f"element_at(array({', '.join('cast(NULL as string)' if v is None else quoted(v) for v in values)}), cast(1 + (x * {k}) % {m} % {len(values)} as int))"


def pick_duck(k: int, m: int, values: list[str | None]) -> str:
    return f"([{', '.join(map(quoted, values))}])[(1 + (x * {k}) % {m} % {len(values)})::INT]"


# --- per-node rules --------------------------------------------------------

KINDS = ["AsExpression", "TypeAssertion", "AnyKeyword", "PropertyAccess", "ElementAccess", "CallExpression", "Binary", "Conditional", "NonNull", "DoubleNegation", "Await", "BindingDefault", "Condition", "IfReturn"]
TYPES = ["string", "string-literal", "number", "number-literal", "boolean", "boolean-literal", "null", "undefined", "void", "any", "unknown", "type-parameter", "object", "array", "symbol"]
FLAGS = (
    "is_const src_to_tgt tgt_to_src target_concrete empty_array flow_to_target is_identifier declared_to_target in_then_branch has_qdot rhs_literal numeric_coercion lookup_shaped test_nullish branch_nullish rhs_undefined_type "
    "callee_user_declared return_has_null return_has_undefined optional_chain length_guarded split_first in_boolean_context bitwise has_then source_typed property_optional extends_target simple_condition target_has_literal tuple_slot_present"
).split()
ATTRS = {
    "target_kind": ["any", "never", "unknown", "Shape"], "parent_kind": ["AsExpression", None, "TypeReference"], "inner_target": ["unknown", None, "Shape"], "root_symbol": ["s0", "s1", None], "enclosing_test_symbol": ["s0", "s1", None], "rhs_text": ["0", "1", None], "guard_ident": ["g0", "g1", None], "rhs_root": ["g0", "g1"],
    "test": ["truthy", "typeof", "instanceof", "predicate"], "typeof_literal": ["string", "number", "object", "function", "undefined"], "then_value": ["true", "false", "x"], "else_value": ["true", "false", "y"], "callee_kind": ["import", "name"], "qdot_start": ["1"], "qdot_end": ["3"], "default_start": ["1"], "default_end": ["3"],
}
_FLAG = {f: f"(x * {2 * i + 101}) % 1009 % 2 = 0" for i, f in enumerate(FLAGS)}
_ATTR = {a: (2 * i + 57, 911, v) for i, (a, v) in enumerate(ATTRS.items())}
_OPS, _LITERALS = ["??", "||", "&&"], [None, "", "x", "0"]


def node_facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(expr_facts with a row for each line item, group_options of three groups)."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_orderkey * 31 + l_linenumber * 17 + l_partkey * 5 AS x")
    part = lambda name, literal: f"named_struct('flag', {name}, 'n_props', 0, 'n_calls', cast(x % 2 as int), 'n_constructs', 0, 'has_str_index', false, 'has_num_index', false, 'literal', {literal})"
    parts = lambda a, b, literal: f"CASE WHEN x % 11 = 0 THEN array() WHEN (x * 29) % 103 % 3 = 0 THEN array({part(pick_spark(a, 907, TYPES), literal)}, {part(pick_spark(b, 887, TYPES), literal)}) ELSE array({part(pick_spark(a, 907, TYPES), literal)}) END"
    flags = f"map_filter(map({', '.join(f'{quoted(f)}, {e}' for f, e in _FLAG.items())}), (k, v) -> v OR (k = 'tuple_slot_present' AND x % 3 = 0))"
    attrs = f"map({', '.join(f'{quoted(a)}, {pick_spark(*p)}' for a, p in _ATTR.items())})"
    facts = rows.selectExpr(
        "concat('g', cast(x % 3 as string)) AS group_id", "cast(l_orderkey as string) AS file", "'n' AS node_id", "'p' AS parent_id", f"{pick_spark(7, 1013, KINDS)} AS kind", f"{pick_spark(13, 499, _OPS)} AS op", "0 AS start", "9 AS `end`", "cast(l_linenumber as int) AS line", "1 AS col", "'t' AS text", "'o' AS operand_text",
        f"{parts(11, 37, 'cast(NULL as string)')} AS type_parts", f"{parts(53, 59, pick_spark(61, 77, _LITERALS))} AS declared_type_parts", "'t' AS type_text", "CASE WHEN x % 4 = 0 THEN x % 8 = 0 END AS is_nullable", "(x * 41) % 53 % 4 = 0 AS unchecked_index_read", "(x * 43) % 59 % 4 = 0 AS ambient_declared", "(x * 47) % 61 % 5 = 0 AS decl_in_node_modules",
        f"{flags} AS flags", f"{attrs} AS attrs",
    )
    from pyspark.sql.types import StructType

    full = StructType.fromDDL(EXPR_FACTS)
    options = spark.createDataFrame([("g0", True, True), ("g1", False, True), ("g2", True, False)], "group_id string, strict_null_checks boolean, no_unchecked_indexed_access boolean")
    return facts.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in full]), options


_NODE_BASE = f"""
WITH b AS (SELECT l_orderkey::VARCHAR AS file, l_linenumber::INT AS line, l_orderkey * 31 + l_linenumber * 17 + l_partkey * 5 AS x FROM lineitem),
c AS (SELECT *, {pick_duck(7, 1013, KINDS)} AS kind, {pick_duck(13, 499, _OPS)} AS op, x % 3 <> 1 AS strict, x % 3 <> 2 AS nou,
  CASE WHEN x % 11 = 0 THEN [] WHEN (x * 29) % 103 % 3 = 0 THEN [{pick_duck(11, 907, TYPES)}, {pick_duck(37, 887, TYPES)}] ELSE [{pick_duck(11, 907, TYPES)}] END AS tp,
  CASE WHEN x % 11 = 0 THEN [] WHEN (x * 29) % 103 % 3 = 0 THEN [{pick_duck(53, 907, TYPES)}, {pick_duck(59, 887, TYPES)}] ELSE [{pick_duck(53, 907, TYPES)}] END AS dp, {pick_duck(61, 77, _LITERALS)} AS lit,
  CASE WHEN x % 4 = 0 THEN x % 8 = 0 END AS is_nullable, (x * 41) % 53 % 4 = 0 AS unch, (x * 43) % 59 % 4 = 0 AS amb, (x * 47) % 61 % 5 = 0 AS dnm,
  {', '.join(f'{e} AS {f}' for f, e in _FLAG.items())}, {', '.join(f'{pick_duck(*p)} AS {a}' for a, p in _ATTR.items())} FROM b),
d AS (SELECT *, coalesce(is_nullable, list_has_any(tp, ['null', 'undefined', 'void'])) AS nul, list_has_any(tp, ['any', 'unknown']) AS loose,
  list_transform(dp, lambda t: CASE WHEN t IN ('object', 'array') THEN CASE WHEN x % 2 > 0 THEN ['function'] ELSE ['object'] END WHEN t IN ('string', 'string-literal') THEN ['string'] WHEN t IN ('number', 'number-literal') THEN ['number'] WHEN t IN ('boolean', 'boolean-literal') THEN ['boolean'] WHEN t = 'symbol' THEN ['symbol'] WHEN t IN ('undefined', 'void') THEN ['undefined'] WHEN t = 'null' THEN ['object']
    ELSE ['string', 'number', 'boolean', 'bigint', 'symbol', 'undefined', 'object', 'function'] END) AS may FROM c)
"""
_CAST, _OPT = "kind IN ('AsExpression', 'TypeAssertion')", "has_qdot AND NOT nul AND NOT unch AND strict"
#: rule: (condition, whether it has a fix).
NODE_SQL = {
    "no-any-cast": ("kind = 'AsExpression' AND target_kind = 'any'", 0), "no-explicit-any-annotation": ("kind = 'AnyKeyword' AND parent_kind IS DISTINCT FROM 'AsExpression'", 0), "no-inline-type-assertion": (f"{_CAST} AND target_has_literal", 0),
    "no-type-assertion": ("kind = 'AsExpression' AND inner_target = 'unknown'", 0), "no-never-cast": ("kind = 'AsExpression' AND target_kind = 'never'", 0), "no-redundant-cast": (f"{_CAST} AND NOT is_const AND NOT list_contains(tp, 'any') AND src_to_tgt AND tgt_to_src", 1),
    "no-unvalidated-cast": (f"{_CAST} AND NOT is_const AND loose AND target_concrete AND NOT empty_array", 0), "redundant-narrowing-then-cast": (f"{_CAST} AND NOT is_const AND flow_to_target AND ((is_identifier AND NOT declared_to_target) OR (root_symbol = enclosing_test_symbol AND in_then_branch))", 1),
    "no-optional-property-access": (f"kind = 'PropertyAccess' AND {_OPT}", 1), "no-optional-element-access": (f"kind = 'ElementAccess' AND {_OPT}", 1), "no-optional-call": (f"kind = 'CallExpression' AND {_OPT}", 1),
    "no-nullish-coalescing": ("kind = 'Binary' AND op = '??' AND NOT nul AND NOT unch AND (x % 3 <> 0 AND NOT tuple_slot_present OR tuple_slot_present) AND strict", 1),
    "no-logical-or-fallback": ("kind = 'Binary' AND op = '||' AND rhs_literal AND NOT numeric_coercion AND NOT (len(tp) > 0 AND list_has_all(['string', 'string-literal'], tp)) AND ((list_has_any(tp, ['number', 'number-literal']) AND rhs_text IS DISTINCT FROM '0') OR (lookup_shaped AND nul)) AND strict", 0),
    "no-null-ternary-normalization": ("kind = 'Conditional' AND test_nullish AND branch_nullish AND NOT unch AND strict", 0),
    "no-coalesce-undefined": ("kind = 'Binary' AND op = '??' AND rhs_undefined_type AND list_has_any(tp, ['undefined', 'void']) AND NOT list_has_any(tp, ['null', 'any', 'unknown', 'type-parameter']) AND strict", 1),
    "no-await-coalesce": ("kind = 'Binary' AND op = '??' AND callee_user_declared AND (return_has_null OR (return_has_undefined AND NOT optional_chain)) AND strict", 0), "no-non-null-assertion": ("kind = 'NonNull' AND nul AND NOT dnm AND NOT length_guarded AND NOT split_first AND strict", 0),
    "no-double-negation-coercion": ("kind = 'DoubleNegation' AND ((len(tp) = 1 AND list_has_all(['boolean', 'boolean-literal'], tp)) OR (in_boolean_context AND NOT bitwise))", 1), "no-redundant-existence-guard": ("kind = 'Binary' AND op = '&&' AND guard_ident = rhs_root AND NOT nul AND strict", 0),
    "no-useless-await": ("kind = 'Await' AND NOT loose AND NOT list_contains(tp, 'type-parameter') AND NOT has_then", 1), "redundant-destructure-default": ("kind = 'BindingDefault' AND source_typed AND NOT property_optional AND NOT loose AND NOT list_contains(tp, 'undefined') AND strict", 1),
    "no-dead-narrowing": ("kind = 'Condition' AND strict AND ((test = 'truthy' AND nou AND len(dp) > 0 AND NOT amb AND len(list_filter(dp, lambda t: t IN ('object', 'array', 'symbol') OR (t IN ('string-literal', 'number-literal', 'boolean-literal') AND lit IS NOT NULL AND lit NOT IN ('', '0')))) = len(dp)) OR (test = 'typeof' AND len(dp) > 0 AND NOT amb AND (len(list_filter(may, lambda s: list_contains(s, typeof_literal))) = 0 OR len(list_filter(may, lambda s: len(s) = 1 AND list_contains(s, typeof_literal))) = len(may))) OR (test = 'instanceof' AND extends_target) OR (test = 'predicate' AND declared_to_target AND NOT amb))", 0),
    "redundant-boolean-branch": ("kind IN ('Conditional', 'IfReturn') AND len(tp) > 0 AND list_has_all(['boolean', 'boolean-literal'], tp) AND then_value IN ('true', 'false') AND else_value IN ('true', 'false') AND then_value <> else_value AND (then_value = 'true' OR simple_condition)", 1),
    "no-dynamic-import": ("kind = 'CallExpression' AND callee_kind = 'import'", 0),
}


def node_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every rule about one node reports on node_facts(), from one scan."""
    facts, options = node_facts(spark, sf_dir)
    return rules_node.fused(facts, None, options).select("rule_id", "file", "line", F.col("fix").isNotNull().alias("has_fix"))


QUERIES["node_rules"] = node_rules
ORACLES["node_rules"] = _NODE_BASE + " UNION ALL ".join(f"SELECT '{r}' AS rule_id, file, line, {'true' if fix else 'false'} AS has_fix FROM d WHERE {when}" for r, (when, fix) in NODE_SQL.items())


# --- rules that relate nodes -------------------------------------------------

def related_facts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """expr_facts of line items in small blocks: an order is a file and a block, the ship order of its lines their positions; kinds and flags follow x."""
    from pyspark.sql.types import StructType

    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_orderkey * 31 + l_linenumber * 17 + l_partkey * 5 AS x")
    attrs = {"symbol": "concat('s', cast(x % 2 as string))", "name": "concat('s', cast(x % 2 as string))", "block": "'b'", "pos": "cast(l_linenumber * 100000 + l_partkey % 100000 as string)", "empty": pick_spark(3, 41, ["null", "undefined"]), "guard": pick_spark(5, 43, ["null", "undefined"]), "function": "concat('f', cast(x % 2 as string))", "use": pick_spark(9, 47, ["read", "assign-default", "guard-throw"]), "iface": "'I'", "method": "concat('m', cast(x % 5 as string))", "index": "cast(l_linenumber as string)"}
    facts = rows.selectExpr(
        "'g' AS group_id", "cast(l_orderkey as string) AS file", "cast(l_linenumber as string) AS node_id", "cast(1 + x % 7 as string) AS parent_id", f"{pick_spark(7, 1013, _RELATED)} AS kind", "cast(l_linenumber as int) AS line", "1 AS col",
        f"map({', '.join(f'{quoted(f)}, {e}' for f, e in _RELATED_FLAGS)}) AS flags", f"map({', '.join(f'{quoted(a)}, {e}' for a, e in attrs.items())}) AS attrs",
    )
    full = StructType.fromDDL(EXPR_FACTS)
    return {"expr_facts": facts.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in facts.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in full])}


_RELATED = ["ArrayBinding", "ReturnIdentifier", "BindingUse", "CoalesceBinding", "GuardIf", "Reassign", "Catch", "HandlerUse", "ThrowNew", "BooleanFunction", "Return", "OptionalParam", "ParamUse", "ImplParam", "PortParam"]
_RELATED_FLAGS = [(f, f"(x * {2 * i + 3}) % 97 % 2 = 0") for i, f in enumerate("non_tuple lacks_undefined is_reassign is_nullish_guard refs_error has_cause one_wide_param is_narrowing has_default required".split())]
_RELATED_RULES = ("return-type-widens-via-destructure", "no-coalesce-then-guard", "no-swallowed-catch", "no-error-rewrap", "prefer-type-predicate", "optional-param-coerced-in-body", "no-defaulted-required-port-arg")


def related_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every rule that relates nodes reports on related_facts()."""
    from tessella.operators.catalogue import all_rules

    facts, rules = related_facts(spark, sf_dir), all_rules()
    found = [rules[r].run(facts).select("rule_id", "file", "line") for r in _RELATED_RULES]
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out


QUERIES["related_rules"] = related_rules
ORACLES["related_rules"] = f"""
WITH d AS (SELECT *, {pick_duck(7, 1013, _RELATED)} AS kind, 's' || (x % 2) AS sym, 'f' || (x % 2) AS fn, (1 + x % 7)::INT AS parent, {pick_duck(3, 41, ['null', 'undefined'])} AS empty, {pick_duck(5, 43, ['null', 'undefined'])} AS guard, {pick_duck(9, 47, ['read', 'assign-default', 'guard-throw'])} AS use, 'm' || (x % 5) AS method, {', '.join(f'{e} AS {f}' for f, e in _RELATED_FLAGS)}
  FROM (SELECT l_orderkey::VARCHAR AS file, l_linenumber::INT AS line, l_linenumber * 100000 + l_partkey % 100000 AS pos, l_orderkey * 31 + l_linenumber * 17 + l_partkey * 5 AS x FROM lineitem)),
ev AS (SELECT file, sym, line, pos, CASE kind WHEN 'CoalesceBinding' THEN 0 WHEN 'GuardIf' THEN 1 ELSE 2 END AS what, CASE kind WHEN 'CoalesceBinding' THEN empty WHEN 'GuardIf' THEN guard END AS val FROM d WHERE kind IN ('CoalesceBinding', 'GuardIf', 'Reassign')),
gd AS (SELECT g.file, g.val, (SELECT max(p.pos) FROM ev p WHERE p.file = g.file AND p.sym = g.sym AND p.pos < g.pos AND p.what <> 1) AS prev, g.sym FROM ev g WHERE g.what = 1),
pu AS (SELECT file, fn, sym, arg_min(line, pos) AS first, arg_min(use, pos) AS use FROM d WHERE kind = 'ParamUse' GROUP BY ALL)
SELECT 'return-type-widens-via-destructure' AS rule_id, r.file, r.line FROM d r JOIN d b ON b.kind = 'ArrayBinding' AND b.non_tuple AND b.file = r.file AND b.sym = r.sym AND b.pos < r.pos
  WHERE r.kind = 'ReturnIdentifier' AND r.lacks_undefined AND NOT EXISTS (SELECT 1 FROM d s WHERE s.kind = 'BindingUse' AND (s.is_reassign OR s.is_nullish_guard) AND s.file = r.file AND s.sym = r.sym AND s.pos > b.pos AND s.pos < r.pos)
UNION ALL SELECT DISTINCT 'no-coalesce-then-guard', e.file, e.line FROM gd JOIN ev e ON e.file = gd.file AND e.sym = gd.sym AND e.pos = gd.prev WHERE e.what = 0 AND e.val = gd.val
UNION ALL SELECT 'no-swallowed-catch', file, line FROM d c WHERE kind = 'Catch' AND NOT EXISTS (SELECT 1 FROM d u WHERE u.kind = 'HandlerUse' AND u.file = c.file AND u.parent = c.line)
UNION ALL SELECT 'no-error-rewrap', file, line FROM d t WHERE kind = 'ThrowNew' AND refs_error AND NOT has_cause AND EXISTS (SELECT 1 FROM d c WHERE c.kind = 'Catch' AND c.file = t.file AND c.line = t.parent)
UNION ALL SELECT 'prefer-type-predicate', file, line FROM d f WHERE kind = 'BooleanFunction' AND one_wide_param AND EXISTS (SELECT 1 FROM d r WHERE r.kind = 'Return' AND r.file = f.file AND r.parent = f.line) AND NOT EXISTS (SELECT 1 FROM d r WHERE r.kind = 'Return' AND r.file = f.file AND r.parent = f.line AND NOT r.is_narrowing)
UNION ALL SELECT 'optional-param-coerced-in-body', pu.file, pu.first FROM pu WHERE EXISTS (SELECT 1 FROM d p WHERE p.kind = 'OptionalParam' AND pu.file = p.file AND pu.fn = p.fn AND pu.sym = p.sym) AND pu.use IN ('assign-default', 'guard-throw')
UNION ALL SELECT DISTINCT 'no-defaulted-required-port-arg', i.file, i.line FROM d i WHERE i.kind = 'ImplParam' AND i.has_default AND EXISTS (SELECT 1 FROM d p WHERE p.kind = 'PortParam' AND p.required AND p.method = i.method AND p.line = i.line)
"""


# --- comments and aliases ----------------------------------------------------


def directive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as comments with directives, parts as aliases: no-ts-ignore, no-ts-expect-error, trivial-type-alias."""
    e = table(spark, sf_dir, "events").selectExpr("cast(user_id as string) AS file", "cast(event_id as int) AS start_line", "CASE event_type WHEN 'click' THEN 'ignore' WHEN 'view' THEN 'expect' END AS directive")
    t = table(spark, sf_dir, "part").selectExpr("p_brand AS file", "cast(p_partkey as int) AS line", "1 AS col", "p_name AS name", "CASE WHEN p_size % 2 = 0 THEN 'TypeReference' ELSE 'UnionType' END AS node_kind", "p_size % 3 AS n_type_params", "p_size % 5 % 2 AS n_type_args")
    return rules_node.no_ts_ignore({"comments": e}).union(rules_node.no_ts_expect_error({"comments": e})).union(rules_node.trivial_type_alias({"types": t})).select("rule_id", "file", "line", "message")


QUERIES["directive_rules"] = directive_rules
ORACLES["directive_rules"] = """
SELECT 'no-ts-ignore' AS rule_id, user_id::VARCHAR AS file, event_id::INT AS line, 'Compiler errors are ignored' AS message FROM events WHERE event_type = 'click'
UNION ALL SELECT 'no-ts-expect-error', user_id::VARCHAR, event_id::INT, 'A compiler error is expected' FROM events WHERE event_type = 'view'
UNION ALL SELECT 'trivial-type-alias', p_brand, p_partkey::INT, 'Another name for a type: ' || p_name FROM part WHERE p_size % 2 = 0 AND p_size % 3 = 0 AND p_size % 5 % 2 = 0
"""


# --- cross-file rules: groups ------------------------------------------------


def _host_sql(rule: str, entries: str, keys: str, having: str, at: int = 2, then: str = "") -> str:
    """The entry that hosts the report of every group: the second by file and line where every file may (or the first), as the rules choose it."""
    return f"SELECT '{rule}' AS rule_id, file, line FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY file, line) AS rn FROM ({entries})) r JOIN (SELECT {keys} FROM ({entries}) GROUP BY {keys} HAVING {having}) g USING ({keys}) WHERE rn = {at} {then}"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "'g' AS group_id", "concat('/p/f', lpad(cast(p_partkey % 37 as string), 2, '0')) AS file", "cast(p_partkey as int) AS line", "1 AS col", "p_name AS name", "concat(p_brand, '|', cast(p_size % 7 as string)) AS hash", "p_partkey", "p_size", "p_type", "p_brand", "cast(p_partkey as int) AS seq"
    )


_PARTS = "SELECT '/p/f' || lpad((p_partkey % 37)::VARCHAR, 2, '0') AS file, p_partkey::INT AS line, p_name AS name, p_brand || '|' || (p_size % 7) AS hash, p_partkey, p_size, p_type, p_brand FROM part"


def _files(spark: SparkSession) -> DataFrame:
    return spark.range(37).selectExpr("'g' AS group_id", "concat('/p/f', lpad(cast(id as string), 2, '0')) AS file", "concat('w', cast(id % 30 as string)) AS ws_hash", "true AS reportable", "cast(id % 2 as string) AS package_root")


def group_facts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Parts as types, functions, constants, parameter types and imports of 37 files."""
    p = _parts(spark, sf_dir)
    return {
        "files": _files(spark),
        "types": p.selectExpr("group_id", "file", "line", "col", "name", "hash", "CASE WHEN p_size % 3 = 0 THEN 'TypeReference' ELSE 'InterfaceDeclaration' END AS node_kind", "p_size % 4 AS n_members", "p_size % 2 = 0 AS exported"),
        "functions": p.selectExpr("group_id", "file", "line", "col", "name", "hash", "p_type AS normalized_hash", "p_size AS norm_body_len", "p_size % 5 = 0 AS has_control_flow", "p_size % 4 AS n_top_stmts", "p_size % 4 = 0 AS single_statement", "p_size % 3 = 0 AS exported", "seq"),
        "constants": p.selectExpr("group_id", "file", "line", "col", "concat(name, '_', cast(p_partkey % 5 as string)) AS name", "hash AS value_hash", "'v' AS value_text"),
        "inline_param_types": p.selectExpr("group_id", "file", "line", "col", "hash", "p_type AS type_text"),
        "imports": p.where("p_size % 10 = 0").selectExpr("group_id", "file", "concat('./f', lpad(cast(p_partkey % 31 as string), 2, '0')) AS source"),
    }


_GROUP_RULES = ("duplicate-file", "duplicate-type-declaration", "duplicate-type-name", "duplicate-function-declaration", "duplicate-function-name", "duplicate-constant-declaration", "duplicate-inline-type-in-params", "near-duplicate-function")


def group_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the duplicate rules report on group_facts()."""
    from tessella.operators.catalogue import all_rules

    facts, rules = group_facts(spark, sf_dir), all_rules()
    out = None
    for r in _GROUP_RULES:
        found = rules[r].run(facts).select("rule_id", "file", "line")
        out = found if out is None else out.unionAll(found)
    return out


_FILES_SQL = "SELECT '/p/f' || lpad(i::VARCHAR, 2, '0') AS file, 1 AS line, 'w' || (i % 30) AS ws FROM range(37) t(i)"
_NAMED = f"SELECT *, ((p_partkey % 37) % 2)::VARCHAR AS pkg FROM ({_PARTS})"
QUERIES["group_rules"] = group_rules
ORACLES["group_rules"] = f"""
WITH edge AS (SELECT DISTINCT '/p/f' || lpad((p_partkey % 37)::VARCHAR, 2, '0') AS src, '/p/f' || lpad((p_partkey % 31)::VARCHAR, 2, '0') AS dst FROM part WHERE p_size % 10 = 0),
linked AS (SELECT DISTINCT src, dst FROM (SELECT * FROM edge UNION ALL SELECT a.src, b.dst FROM edge a JOIN edge b ON a.dst = b.src) WHERE src <> dst),
fn AS ({_NAMED} WHERE p_size % 3 = 0),
exempt AS (SELECT DISTINCT a.pkg, a.name FROM fn a JOIN fn b ON a.pkg = b.pkg AND a.name = b.name JOIN linked l ON l.src = a.file AND l.dst = b.file),
seg AS (SELECT hash FROM (SELECT hash, file, p_partkey, unnest(list_distinct(list_filter(string_split(lower(regexp_replace(name || '_' || (p_partkey % 5), '([a-z])([A-Z])', '\\1_\\2', 'g')), '_'), lambda s: s <> ''))) AS s FROM ({_PARTS})) GROUP BY hash, s HAVING count(*) > 1)
{_host_sql('duplicate-file', _FILES_SQL, 'ws', 'count(*) >= 2')}
UNION ALL {_host_sql('duplicate-type-declaration', _PARTS, 'hash', "count(DISTINCT file) >= 2 AND NOT bool_and(p_size % 3 <> 0 AND p_size % 4 <= 1)")}
UNION ALL {_host_sql('duplicate-type-name', f'{_NAMED} WHERE p_size % 2 = 0', 'pkg, name', 'count(DISTINCT file) >= 2 AND count(DISTINCT hash) > 1 AND bool_and(p_size % 3 <> 0)')}
UNION ALL {_host_sql('duplicate-function-declaration', _PARTS, 'hash', 'count(*) >= 2 AND NOT arg_min(p_size % 4 = 0, p_partkey)')}
UNION ALL {_host_sql('duplicate-function-name', f'{_NAMED} WHERE p_size % 3 = 0', 'pkg, name', 'count(DISTINCT file) >= 2 AND count(DISTINCT hash) > 1', then='AND (pkg, name) NOT IN (SELECT (pkg, name) FROM exempt)')}
UNION ALL {_host_sql('duplicate-constant-declaration', _PARTS, 'hash', 'count(DISTINCT file) >= 2', then='AND hash IN (SELECT hash FROM seg)')}
UNION ALL {_host_sql('duplicate-inline-type-in-params', _PARTS, 'hash', 'count(*) >= 2')}
UNION ALL {_host_sql('near-duplicate-function', _PARTS, 'p_type', 'count(*) >= 2 AND count(DISTINCT hash) > 1 AND NOT bool_and(p_size < 32) AND NOT bool_and(p_size % 5 <> 0 AND p_size % 4 <= 2)')}
"""


# --- cross-file rules: literals and shapes -----------------------------------


def shape_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as literal properties, orders of a customer as returned shapes: repeated-literal-property, repeated-return-shape."""
    props = table(spark, sf_dir, "lineitem").selectExpr("'g' AS group_id", "concat('s', cast(l_suppkey % 50 as string)) AS file", "cast(l_orderkey as int) AS line", "l_returnflag AS key", "concat('v', cast(l_partkey % 211 as string)) AS value", "l_linestatus = 'F' AND l_linenumber = 1 AS is_as_const", "cast(l_orderkey % 9 as int) AS scope_id")
    orders = table(spark, sf_dir, "orders")
    per = orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("props"))
    shapes = per.selectExpr("'g' AS group_id", "concat('f', lpad(cast(o_custkey % 40 as string), 2, '0')) AS file", "cast(o_custkey as int) AS fn_line", "cast(o_custkey as string) AS fn_name", "props")
    types = per.where("o_custkey % 25 = 0 AND size(props) < 5").selectExpr("'g' AS group_id", "props AS prop_names")
    a = rules_cross.repeated_literal_property({"literal_props": props})
    b = rules_cross.repeated_return_shape({"return_shapes": shapes, "types": types})
    return a.union(b).select("rule_id", "file", "line")


QUERIES["shape_rules"] = shape_rules
ORACLES["shape_rules"] = """
WITH per AS (SELECT o_custkey AS k, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS shape, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1),
s AS (SELECT 'f' || lpad((k % 40)::VARCHAR, 2, '0') AS file, k::INT AS line, shape FROM per WHERE n >= 2 AND shape NOT IN (SELECT shape FROM per WHERE k % 25 = 0 AND n BETWEEN 2 AND 4))
SELECT 'repeated-literal-property' AS rule_id, file, min(line) AS line FROM (SELECT 's' || (l_suppkey % 50) AS file, l_orderkey::INT AS line, l_returnflag AS key, l_partkey % 211 AS value, l_linestatus = 'F' AND l_linenumber = 1 AS c, l_orderkey % 9 AS scope FROM lineitem)
  GROUP BY file, value HAVING count(DISTINCT key) <> 1 AND count(DISTINCT scope) >= CASE WHEN bool_or(c) THEN 3 ELSE 5 END
UNION ALL SELECT 'repeated-return-shape', file, line FROM (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY file, line) AS rn, count(*) OVER (PARTITION BY shape) AS n FROM s) JOIN (SELECT shape FROM s GROUP BY shape HAVING count(DISTINCT file) >= 2) USING (shape) WHERE rn = 1 AND n >= 3
"""


# --- cross-file rules: calls ---------------------------------------------------


def call_facts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers as functions of two optional parameters, orders as their calls with one to three arguments, order priorities as overloads of a customer's segment."""
    param = "struct<name:string,optional:boolean,has_default:boolean,type_text:string>"
    fn = table(spark, sf_dir, "customer").selectExpr(
        "'g' AS group_id", "concat('/p/c', lpad(cast(c_custkey % 61 as string), 2, '0')) AS file", "cast(c_custkey as int) AS line", "concat('n', cast(c_custkey as string)) AS name", "cast(c_custkey as string) AS fn_id", "cast(c_custkey as string) AS symbol_id", "concat('d', cast(c_custkey as string)) AS decl_id",
        "c_nationkey % 7 = 0 AS implements_interface", "c_nationkey % 11 = 0 AS has_rest", "c_custkey % 3 = 0 AS exported", "c_custkey % 12 = 0 AS exported_default", "CASE WHEN c_custkey % 5 = 0 THEN concat('K', cast(c_custkey % 20 as string)) END AS class_name", "cast(c_custkey as int) AS seq",
        f"cast(array(named_struct('name', 'a', 'optional', false, 'has_default', false, 'type_text', ''), named_struct('name', 'b', 'optional', c_nationkey % 2 = 0, 'has_default', false, 'type_text', ''), named_struct('name', 'c', 'optional', false, 'has_default', true, 'type_text', '')) as array<{param}>) AS params",
        "CASE WHEN c_custkey % 4 = 0 THEN cast(c_custkey * 10 as string) END AS sole_call_id", "CASE WHEN c_custkey % 8 = 0 THEN array('a', 'b', 'c') ELSE array('a') END AS sole_call_args", "0 AS n_type_params", "c_custkey % 9 = 0 AS is_predicate",
    )
    arg = "named_struct('kind', {}, 'text', {})".format
    calls = table(spark, sf_dir, "orders").selectExpr(
        "'g' AS group_id", "cast(o_orderkey as string) AS file", "cast(o_orderkey as int) AS line", "cast(o_orderkey as string) AS call_id", "concat('n', cast(o_custkey as string)) AS callee_name", "cast(CASE WHEN o_custkey % 6 = 0 THEN 3 WHEN o_custkey % 6 = 1 THEN 1 ELSE 1 + o_orderkey % 3 END as int) AS arg_count", "o_custkey % 13 = 0 AND o_orderkey % 2 = 0 AS has_spread", "o_orderkey % 7 = 0 AS has_type_args",
        f"array({arg(quoted('number'), 'cast(o_custkey % 2 * (o_orderkey % 2) as string)')}, {arg('''CASE WHEN o_orderpriority = '5-LOW' THEN 'null' WHEN o_orderstatus = 'P' THEN 'undefined' ELSE 'string' END''', 'o_orderstatus')}) AS args",
        "CASE WHEN o_orderkey % 17 > 0 THEN cast(o_custkey as string) END AS symbol_id", "concat('n', cast(o_custkey as string)) AS symbol_name", "CASE WHEN o_orderkey % 4 = 0 THEN concat('/p/c', lpad(cast(o_custkey % 61 as string), 2, '0')) END AS decl_file", "CASE WHEN o_orderkey % 8 = 1 THEN concat('d', cast(o_custkey as string)) END AS decl_id", "concat(cast(o_custkey as string), o_orderpriority) AS resolved_decl_id",
    )
    names = table(spark, sf_dir, "orders").select("o_orderpriority").distinct()
    over = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])).alias("p"))
    over = over.join(names, F.col("p") == F.col("o_orderpriority"), "left_semi").selectExpr("'g' AS group_id", "cast(c_custkey as string) AS file", "cast(c_custkey as string) AS family_id", "cast(c_custkey as string) AS name", "concat(cast(c_custkey as string), p) AS decl_id", "cast(substring(p, 1, 1) as int) AS line", "p = '3-MEDIUM' AS is_implementation", "false AS cascade_hint")
    return {"functions": fn, "call_sites": calls, "overloads": over}


_CALL_RULES = ("optional-arg-always-used", "optional-arg-never-used", "constant-argument", "explicit-null-arg", "trivial-wrapper", "dead-overload")


def call_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules about calls report on call_facts()."""
    from tessella.operators.catalogue import all_rules

    facts, rules = call_facts(spark, sf_dir), all_rules()
    out = None
    for r in _CALL_RULES:
        found = rules[r].run(facts).select("rule_id", "file", "line", "message")
        out = found if out is None else out.unionAll(found)
    return out


QUERIES["call_rules"] = call_rules
_CALLS = """
fn AS (SELECT c_custkey AS k, '/p/c' || lpad((c_custkey % 61)::VARCHAR, 2, '0') AS file, c_custkey::INT AS line, c_nationkey AS nk FROM customer),
calls AS (SELECT *, CASE WHEN o_custkey % 6 = 0 THEN 3 WHEN o_custkey % 6 = 1 THEN 1 ELSE 1 + o_orderkey % 3 END AS args, o_custkey % 13 = 0 AND o_orderkey % 2 = 0 AS spread, (o_custkey % 2 * (o_orderkey % 2))::VARCHAR AS a0, CASE WHEN o_orderpriority = '5-LOW' THEN 'null' WHEN o_orderstatus = 'P' THEN 'undefined' ELSE 'string' END AS k1 FROM orders),
linked AS (SELECT * FROM calls WHERE o_orderkey % 17 > 0),
agg AS (SELECT o_custkey AS k, count(*) AS n, min(args) AS least, max(args) AS most, count(DISTINCT a0) AS d0, min(a0) AS v0,
  count(CASE WHEN k1 = 'null' THEN o_orderstatus WHEN k1 = 'string' THEN o_orderstatus END) AS l1, count(DISTINCT CASE WHEN k1 <> 'undefined' THEN o_orderstatus END) AS d1, min(CASE WHEN k1 <> 'undefined' THEN o_orderstatus END) AS v1 FROM linked GROUP BY 1 HAVING count(*) >= 2 AND NOT bool_or(spread)),
site AS (SELECT fn.*, agg.* EXCLUDE (k) FROM fn JOIN agg USING (k) WHERE nk % 7 <> 0 AND nk % 11 <> 0)
"""
ORACLES["call_rules"] = f"""
WITH {_CALLS}, used AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS p FROM orders),
over AS (SELECT k, p, EXISTS (SELECT 1 FROM used u WHERE u.k = fn.k AND u.p = o.p) AS hit FROM fn, (SELECT DISTINCT o_orderpriority AS p FROM orders) o WHERE p <> '3-MEDIUM')
SELECT 'optional-arg-always-used' AS rule_id, file, line, 'All ' || n || ' calls pass b: it need not be optional' AS message FROM site WHERE nk % 2 = 0 AND least > 1
UNION ALL SELECT 'optional-arg-always-used', file, line, 'All ' || n || ' calls pass c: it need not be optional' FROM site WHERE least > 2
UNION ALL SELECT 'optional-arg-never-used', file, line, 'No call passes ' || CASE WHEN nk % 2 = 0 AND most <= 1 THEN 'b, c' ELSE 'c' END FROM site WHERE most <= 2
UNION ALL SELECT 'constant-argument', file, line, 'Every call gives a the value ' || v0 FROM site WHERE n >= 3 AND d0 = 1
UNION ALL SELECT 'constant-argument', file, line, 'Every call gives b the value ' || v1 FROM site WHERE n >= 3 AND d1 = 1 AND l1 = n
UNION ALL SELECT 'explicit-null-arg', o_orderkey::VARCHAR, o_orderkey::INT, 'Passes ' || k1 || ' to n' || o_custkey || ' as argument 2' FROM linked WHERE k1 <> 'string'
UNION ALL SELECT 'trivial-wrapper', file, line, 'n' || k || ' only passes its arguments on to n' || o_custkey FROM fn JOIN linked ON o_orderkey = k * 10 WHERE k % 8 = 0 AND k % 9 <> 0 AND nk % 11 <> 0 AND NOT spread AND o_orderkey % 7 <> 0 AND o_custkey <> k
UNION ALL SELECT 'dead-overload', k::VARCHAR, p[1]::INT, 'No call resolves to this signature of ' || k FROM (SELECT *, count(*) FILTER (WHERE hit) OVER (PARTITION BY k) AS live FROM over) WHERE NOT hit AND live > 0
"""


def unused_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as exported functions, suppliers as types and nations as constants, nations' imports: what unused-export reports."""
    facts = call_facts(spark, sf_dir)
    s = table(spark, sf_dir, "supplier").selectExpr("'g' AS group_id", "concat('/p/c', lpad(cast(s_suppkey % 61 as string), 2, '0')) AS file", "concat('t', cast(s_suppkey as string)) AS name", "cast(s_suppkey as int) AS line", "s_suppkey % 2 = 0 AS exported", "cast(s_suppkey as int) AS seq")
    n = table(spark, sf_dir, "nation").selectExpr("'g' AS group_id", "'/p/index.ts' AS file", "n_name AS name", "cast(n_nationkey as int) AS line", "true AS exported", "cast(n_nationkey as int) AS seq")
    i = table(spark, sf_dir, "nation").selectExpr("'g' AS group_id", "concat('/q/i', cast(n_nationkey as string)) AS file", "CASE n_nationkey % 3 WHEN 0 THEN '*' WHEN 1 THEN 'default' ELSE concat('K', cast(n_nationkey as string)) END AS imported_name", "concat('/p/c', lpad(cast(n_nationkey as string), 2, '0')) AS resolved_file")
    ident = table(spark, sf_dir, "customer").selectExpr("'g' AS group_id", "concat('/p/c', lpad(cast(c_custkey % 61 as string), 2, '0')) AS file", "concat('n', cast(c_custkey as string)) AS ident", "cast(c_custkey % 10 as int) AS n").where("n in (0, 1, 2)")
    files = table(spark, sf_dir, "customer").selectExpr("'g' AS group_id", "concat('/p/c', lpad(cast(c_custkey % 61 as string), 2, '0')) AS file").distinct().selectExpr("*", "file <> '/p/c07' AS reportable")
    return rules_cross.unused_export(facts | {"types": s, "constants": n, "imports": i, "ident_counts": ident, "files": files}).select("rule_id", "file", "line", "message")


QUERIES["unused_exports"] = unused_exports
ORACLES["unused_exports"] = """
WITH i AS (SELECT '/q/i' || n_nationkey AS i_file, CASE n_nationkey % 3 WHEN 0 THEN '*' WHEN 1 THEN 'default' ELSE 'K' || n_nationkey END AS what, '/p/c' || lpad(n_nationkey::VARCHAR, 2, '0') AS file FROM nation),
calls AS (SELECT DISTINCT '/p/c' || lpad((o_custkey % 61)::VARCHAR, 2, '0') AS file, 'n' || o_custkey AS name FROM orders WHERE o_orderkey % 4 = 0),
used AS (SELECT * FROM calls UNION SELECT file, what FROM i WHERE what <> '*'),
c AS (SELECT '/p/c' || lpad((c_custkey % 61)::VARCHAR, 2, '0') AS file, 'n' || c_custkey AS name, c_custkey::INT AS line, c_custkey % 12 = 0 AS dft, CASE WHEN c_custkey % 5 = 0 THEN 'K' || (c_custkey % 20) END AS class, c_custkey AS k FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey % 7 <> 0
  UNION ALL SELECT '/p/c' || lpad((s_suppkey % 61)::VARCHAR, 2, '0'), 't' || s_suppkey, s_suppkey::INT, false, NULL, NULL FROM supplier WHERE s_suppkey % 2 = 0)
SELECT 'unused-export' AS rule_id, file, line, 'Nothing imports or calls ' || name AS message FROM c WHERE file <> '/p/c07' AND file IN (SELECT '/p/c' || lpad((c_custkey % 61)::VARCHAR, 2, '0') FROM customer) AND file NOT IN (SELECT file FROM i WHERE what = '*') AND (file, name) NOT IN (SELECT (file, name) FROM used)
  AND (k IS NULL OR k % 10 <> 2) AND (k IS NULL OR k NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 8 = 1)) AND NOT (dft AND file IN (SELECT file FROM i WHERE what = 'default'))
  AND (class IS NULL OR NOT EXISTS (SELECT 1 FROM i WHERE i.what = c.class AND i.i_file <> c.file)) AND (class IS NULL OR (file, class) NOT IN (SELECT (file, name) FROM used))
"""
