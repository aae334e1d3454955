"""The per-node rules: predicates over expr_facts, all evaluated in one scan.

A row of expr_facts is a candidate node. Facts that only a compiler or a parser
can know come as named booleans (flags) and strings (attrs); a missing flag is
false. Rules that look at one node are Catalyst predicates, and fused() explodes
one array of all their hits per row, so the table is scanned once however many
rules are active. Rules that relate nodes are joins, windows or aggregates.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.catalogue import rule
from tessella.operators.groups import diagnostics
from tessella.schema import FIX
from tessella.storage import write_table

Facts = dict[str, DataFrame]
ANYTHING = ("any", "unknown")
NULLISH = ("null", "undefined", "void")


def flag(name: str) -> Column:
    return F.coalesce(F.col("flags")[name], F.lit(False))  # unlike element_at, of a map made in the plan only this entry is computed


def attr(name: str) -> Column:
    return F.col("attrs")[name]


def has(parts: str, *kinds: str) -> Column:
    """Whether any member of the type has one of the flags."""
    return F.coalesce(F.exists(F.col(parts), lambda p: p["flag"].isin(*kinds)), F.lit(False))


def only(parts: str, *kinds: str) -> Column:
    """Whether the type has members and all have one of the flags."""
    return F.coalesce((F.size(F.col(parts)) > 0) & F.forall(F.col(parts), lambda p: p["flag"].isin(*kinds)), F.lit(False))


def nullable() -> Column:
    """A null, undefined or void member; any and unknown don't count."""
    return F.coalesce(F.col("is_nullable"), has("type_parts", *NULLISH))


def unchecked() -> Column:
    return F.coalesce(F.col("unchecked_index_read"), F.lit(False))


def kind(*names: str) -> Column:
    return F.col("kind").isin(*names)


def edit(start: Column | str, end: Column | str, text: Column | str) -> Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.struct(c(start).cast("int").alias("start"), c(end).cast("int").alias("end"), (F.lit(text) if isinstance(text, str) else text).alias("text")).cast(FIX)


def replace_by_operand() -> Column:
    return edit("start", "end", F.col("operand_text"))


@dataclass(frozen=True)
class NodeRule:
    rule_id: str
    severity: str
    when: Callable[[], Column]
    message: Callable[[], Column]
    fix: Callable[[], Column] | None = None
    strict_null: bool = False


NODE_RULES: dict[str, NodeRule] = {}


def node_rule(rule_id: str, severity: str, category: str, tags: str, when: Callable[[], Column], message: str | Callable[[], Column], fix: Callable[[], Column] | None = None, confidence: str = "proven", typed: bool = False, strict_null: bool = False) -> None:
    says = (lambda m=message: F.lit(m)) if isinstance(message, str) else message
    NODE_RULES[rule_id] = NodeRule(rule_id, severity, when, says, fix, strict_null)
    rule(rule_id, severity, category, tags, confidence, ("expr_facts",), typed or strict_null, strict_null)(lambda facts, r=rule_id: fused(facts["expr_facts"], [r], facts.get("group_options")))


def fused(expr_facts: DataFrame, rule_ids: list[str] | None = None, group_options: DataFrame | None = None) -> DataFrame:
    """Diagnostics of all the named node rules (by default every one) from one scan.

    group_options (group_id, strict_null_checks, no_unchecked_indexed_access) is a
    dimension of one row per project group; rules that need strict null checks are
    silent in groups without them.
    """
    rows = expr_facts
    if group_options is not None:
        o = group_options.select(F.col("group_id").alias("o_group"), "strict_null_checks", "no_unchecked_indexed_access")
        rows = rows.join(F.broadcast(o), F.col("group_id") == F.col("o_group"), "left")  # else all rows of a group go to one task
    else:
        rows = rows.withColumns({"strict_null_checks": F.lit(True), "no_unchecked_indexed_access": F.lit(False)})
    hits = []
    for r in NODE_RULES.values():
        if rule_ids is not None and r.rule_id not in rule_ids:
            continue
        test = r.when() & F.coalesce("strict_null_checks", F.lit(True)) if r.strict_null else r.when()
        fix = r.fix() if r.fix else F.lit(None).cast(FIX)
        hits.append(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), r.message().alias("message"), fix.alias("fix"))))
    # The array is a column of its own: within array_compact, or explode, its expressions would be interpreted.
    found = rows.select("file", "line", "col", F.array(*hits).alias("hits")).select("file", "line", "col", F.explode(F.array_compact("hits")).alias("h"))
    return found.select("h.rule_id", "h.severity", "h.message", "file", F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("col"), F.lit(None).cast("string").alias("annotation"), "h.fix")


# --- type evasion ---------------------------------------------------------

_AS = lambda: kind("AsExpression")
node_rule("no-any-cast", "error", "type-evasion", "safety", lambda: _AS() & (attr("target_kind") == "any"), "Cast to any")
node_rule("no-explicit-any-annotation", "error", "type-evasion", "safety", lambda: kind("AnyKeyword") & (F.coalesce(attr("parent_kind"), F.lit("")) != "AsExpression"), "Written any")
node_rule("no-inline-type-assertion", "error", "type-evasion", "safety", lambda: kind("AsExpression", "TypeAssertion") & flag("target_has_literal"), "Assertion to an object type written in place")
node_rule("no-type-assertion", "error", "type-evasion", "safety", lambda: _AS() & (attr("inner_target") == "unknown"), "Assertion through unknown")
node_rule("no-never-cast", "warning", "type-evasion", "safety", lambda: _AS() & (attr("target_kind") == "never"), "Cast to never")
node_rule("no-redundant-cast", "error", "type-evasion", "type-aware", lambda: kind("AsExpression", "TypeAssertion") & ~flag("is_const") & ~has("type_parts", "any") & flag("src_to_tgt") & flag("tgt_to_src"), "The expression has this type already", replace_by_operand, typed=True)
node_rule("no-unvalidated-cast", "error", "type-evasion", "safety type-aware", lambda: kind("AsExpression", "TypeAssertion") & ~flag("is_const") & has("type_parts", *ANYTHING) & flag("target_concrete") & ~flag("empty_array"), "An unchecked value is given a concrete type", typed=True)
node_rule(
    "redundant-narrowing-then-cast", "warning", "type-evasion", "type-aware",
    lambda: kind("AsExpression", "TypeAssertion") & ~flag("is_const") & flag("flow_to_target") & ((flag("is_identifier") & ~flag("declared_to_target")) | (attr("root_symbol").isNotNull() & (attr("root_symbol") == attr("enclosing_test_symbol")) & flag("in_then_branch"))),
    "The test above has narrowed this already", replace_by_operand, typed=True,
)

# --- defensive code -------------------------------------------------------

_OPTIONAL = lambda k: kind(k) & flag("has_qdot") & ~nullable() & ~unchecked()
_QDOT = lambda text: (lambda: edit(attr("qdot_start"), attr("qdot_end"), text))
node_rule("no-optional-property-access", "warning", "defensive-code", "type-aware", lambda: _OPTIONAL("PropertyAccess"), "The receiver is never null or undefined", _QDOT("."), strict_null=True)
node_rule("no-optional-element-access", "warning", "defensive-code", "type-aware", lambda: _OPTIONAL("ElementAccess"), "The receiver is never null or undefined", _QDOT(""), strict_null=True)
node_rule("no-optional-call", "warning", "defensive-code", "type-aware", lambda: _OPTIONAL("CallExpression"), "The callee is never null or undefined", _QDOT(""), strict_null=True)
node_rule("no-nullish-coalescing", "warning", "defensive-code", "type-aware", lambda: kind("Binary") & (F.col("op") == "??") & ~nullable() & ~unchecked() & F.coalesce(F.col("flags")["tuple_slot_present"], F.lit(True)), "The left side is never null or undefined", replace_by_operand, strict_null=True)
node_rule(
    "no-logical-or-fallback", "warning", "defensive-code", "type-aware",
    lambda: kind("Binary") & (F.col("op") == "||") & flag("rhs_literal") & ~flag("numeric_coercion") & ~(only("type_parts", "string", "string-literal")) & ((has("type_parts", "number", "number-literal") & (F.coalesce(attr("rhs_text"), F.lit("")) != "0")) | (flag("lookup_shaped") & nullable())),
    lambda: F.when(has("type_parts", "number", "number-literal"), "A zero on the left is replaced as well").otherwise("Empty values on the left are replaced as well"), strict_null=True,
)
node_rule("no-null-ternary-normalization", "warning", "defensive-code", "type-aware", lambda: kind("Conditional") & flag("test_nullish") & flag("branch_nullish") & ~unchecked(), lambda: F.when(nullable(), "One empty value is turned into another").otherwise("The tested value is never null or undefined"), strict_null=True)
node_rule("no-coalesce-undefined", "warning", "defensive-code", "type-aware", lambda: kind("Binary") & (F.col("op") == "??") & flag("rhs_undefined_type") & has("type_parts", "undefined", "void") & ~has("type_parts", "null", *ANYTHING, "type-parameter"), "The fallback is what the left side has anyway", replace_by_operand, strict_null=True)
node_rule("no-await-coalesce", "warning", "defensive-code", "type-aware", lambda: kind("Binary") & (F.col("op") == "??") & flag("callee_user_declared") & (flag("return_has_null") | (flag("return_has_undefined") & ~flag("optional_chain"))), "The call's failure is folded into a fallback", confidence="heuristic", strict_null=True)
node_rule("no-non-null-assertion", "warning", "defensive-code", "type-aware", lambda: kind("NonNull") & nullable() & ~F.coalesce("decl_in_node_modules", F.lit(False)) & ~flag("length_guarded") & ~flag("split_first"), "Null or undefined is asserted away", strict_null=True)
node_rule("no-double-negation-coercion", "warning", "defensive-code", "readability", lambda: kind("DoubleNegation") & ((only("type_parts", "boolean", "boolean-literal") & (F.size("type_parts") == 1)) | (flag("in_boolean_context") & ~flag("bitwise"))), "The value is read as a boolean anyway", replace_by_operand, typed=True)
node_rule("no-redundant-existence-guard", "warning", "defensive-code", "type-aware", lambda: kind("Binary") & (F.col("op") == "&&") & attr("guard_ident").isNotNull() & (attr("guard_ident") == attr("rhs_root")) & ~nullable(), "The guarded value is never null or undefined", strict_null=True)
node_rule("no-useless-await", "warning", "defensive-code", "readability type-aware", lambda: kind("Await") & ~has("type_parts", *ANYTHING, "type-parameter") & ~flag("has_then"), "The operand is no promise", replace_by_operand, typed=True)
node_rule("redundant-destructure-default", "warning", "defensive-code", "type-aware", lambda: kind("BindingDefault") & flag("source_typed") & ~flag("property_optional") & ~has("type_parts", "undefined", *ANYTHING), "The property is always there", lambda: edit(attr("default_start"), attr("default_end"), ""), strict_null=True)

#: typeof results a member of a type may have.
_TYPEOF = {"string": "string", "string-literal": "string", "number": "number", "number-literal": "number", "enum": "number", "boolean": "boolean", "boolean-literal": "boolean", "bigint": "bigint", "symbol": "symbol", "undefined": "undefined", "void": "undefined", "null": "object"}


def typeof_sets(parts: Column) -> Column:
    """For each member the typeof results it may have; an open member may have any."""
    known = F.create_map(*[F.lit(x) for kv in _TYPEOF.items() for x in kv])
    every = F.array(*[F.lit(x) for x in ("string", "number", "boolean", "bigint", "symbol", "undefined", "object", "function")])
    one = lambda p: F.when(p["flag"].isin("object", "array", "tuple"), F.when(p["n_calls"] + p["n_constructs"] > 0, F.array(F.lit("function"))).otherwise(F.array(F.lit("object")))).when(known[p["flag"]].isNotNull(), F.array(known[p["flag"]])).otherwise(every)
    return F.transform(parts, one)


def _always_truthy() -> Column:
    return F.forall("declared_type_parts", lambda p: p["flag"].isin("object", "array", "tuple", "symbol", "non-primitive") | (p["flag"].isin("string-literal", "number-literal", "bigint-literal", "boolean-literal") & ~p["literal"].isin("", "0", "-0", "0n", "false", "NaN") & p["literal"].isNotNull())) & (F.size("declared_type_parts") > 0)


def _dead_typeof() -> Column:
    sets = typeof_sets(F.col("declared_type_parts"))
    may = F.exists(sets, lambda s: F.array_contains(s, attr("typeof_literal")))
    must = F.forall(sets, lambda s: (F.size(s) == 1) & F.array_contains(s, attr("typeof_literal")))
    return (attr("test") == "typeof") & (F.size("declared_type_parts") > 0) & (~may | must)


_FOREIGN = lambda: F.coalesce(F.col("ambient_declared"), F.lit(False))
node_rule(
    "no-dead-narrowing", "warning", "defensive-code", "type-aware safety",
    lambda: kind("Condition") & (((attr("test") == "truthy") & F.coalesce("no_unchecked_indexed_access", F.lit(False)) & _always_truthy() & ~_FOREIGN()) | (_dead_typeof() & ~_FOREIGN()) | ((attr("test") == "instanceof") & flag("extends_target")) | ((attr("test") == "predicate") & flag("declared_to_target") & ~_FOREIGN())),
    "The outcome of this test is known from the declared type", strict_null=True,
)
node_rule(
    "redundant-boolean-branch", "warning", "defensive-code", "readability type-aware",
    lambda: kind("Conditional", "IfReturn") & only("type_parts", "boolean", "boolean-literal") & attr("then_value").isin("true", "false") & attr("else_value").isin("true", "false") & (attr("then_value") != attr("else_value")) & ((attr("then_value") == "true") | flag("simple_condition")),
    "The branches only repeat the condition",
    lambda: edit("start", "end", F.concat(F.when(kind("IfReturn"), "return ").otherwise(""), F.when(attr("then_value") == "false", "!").otherwise(""), F.col("operand_text"), F.when(kind("IfReturn"), ";").otherwise(""))), typed=True,
)

# --- interfaces and imports -----------------------------------------------

node_rule("no-dynamic-import", "warning", "imports", "safety", lambda: kind("CallExpression") & (attr("callee_kind") == "import"), "Import at run time", confidence="heuristic")


def heritage(edges: DataFrame, depth: int | None = 50) -> DataFrame:
    """(child, ancestor) over extends edges (child, parent), up to a depth or, where that is None, all of them.

    Paths double: pairs whose shortest path has k edges are joined with all pairs of
    at most k, which gives those of at most 2k. Only pairs that are new are written,
    so neither diamonds nor cycles multiply paths; it ends when there are none.
    """
    found = write_table(edges.select("child", "parent").where("child is not null and parent is not null").distinct().select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("dist")), "heritage")
    k = 1
    while depth is None or k < depth:
        mid, rest = found.where(F.col("dist") == k).select("child", F.col("ancestor").alias("mid")), found.select(F.col("child").alias("mid"), "ancestor", F.col("dist").alias("d"))
        new = mid.join(rest, "mid").groupBy("child", "ancestor").agg((F.min("d") + k).alias("dist")).join(found, ["child", "ancestor"], "left_anti")
        new = write_table(new if depth is None else new.where(F.col("dist") <= depth), "heritage")
        if new.isEmpty():
            break
        found, k = found.unionAll(new), 2 * k
    return found.select("child", "ancestor")


def with_heritage(expr_facts: DataFrame, edges: DataFrame) -> DataFrame:
    """expr_facts whose instanceof conditions know whether the declared class extends the tested one (attrs declared_class, tested_class)."""
    up = heritage(edges).select(F.col("child").alias("_c"), F.col("ancestor").alias("_a"), F.lit(True).alias("_up"))
    joined = expr_facts.join(up, (attr("declared_class") == F.col("_c")) & (attr("tested_class") == F.col("_a")) & (attr("test") == "instanceof"), "left")
    known = F.coalesce(F.col("_up"), attr("declared_class") == attr("tested_class"), F.lit(False)) | flag("extends_target")
    return joined.withColumn("flags", F.map_concat(F.map_filter(F.coalesce("flags", F.create_map().cast("map<string,boolean>")), lambda k, v: k != "extends_target"), F.create_map(F.lit("extends_target"), known))).select(*expr_facts.columns)


@rule("no-ts-ignore", "error", "type-evasion", "safety", needs=("comments",))
def no_ts_ignore(facts: Facts) -> DataFrame:
    return diagnostics(facts["comments"].where("directive = 'ignore'"), "no-ts-ignore", "error", F.lit("Compiler errors are ignored"), line="start_line")


@rule("no-ts-expect-error", "warning", "type-evasion", "safety", needs=("comments",))
def no_ts_expect_error(facts: Facts) -> DataFrame:
    return diagnostics(facts["comments"].where("directive = 'expect'"), "no-ts-expect-error", "warning", F.lit("A compiler error is expected"), line="start_line")


@rule("trivial-type-alias", "info", "interface-design", "api readability", "heuristic", ("types",))
def trivial_type_alias(facts: Facts) -> DataFrame:
    t = facts["types"].where("node_kind = 'TypeReference' and n_type_params = 0 and n_type_args = 0")
    return diagnostics(t, "trivial-type-alias", "info", F.concat(F.lit("Another name for a type: "), F.col("name")), col=F.col("col"))


# --- rules that relate nodes ----------------------------------------------


def _of(facts: Facts, name: str) -> DataFrame:
    return facts["expr_facts"].where(F.col("kind") == name)


def _strict(rows: DataFrame, facts: Facts) -> DataFrame:
    """rows of groups with strict null checks; where no options are known, all."""
    if "group_options" not in facts:
        return rows
    loose = facts["group_options"].where(~F.coalesce("strict_null_checks", F.lit(True))).select("group_id")
    return rows.join(F.broadcast(loose), "group_id", "left_anti")


_BLOCK, _POS = lambda: attr("block"), lambda: attr("pos").cast("int")


@rule("return-type-widens-via-destructure", "warning", "type-evasion", "type-aware safety", needs=("expr_facts",), typed=True, strict_null=True)
def return_type_widens(facts: Facts) -> DataFrame:
    """Kinds ArrayBinding (attrs symbol, block, pos; flag non_tuple), ReturnIdentifier (symbol, block, pos; flag lacks_undefined) and BindingUse (symbol, block, pos; flags is_reassign, is_nullish_guard)."""
    sym = lambda n: _of(facts, n).select("group_id", "file", attr("symbol").alias("symbol"), _BLOCK().alias("block"), _POS().alias("pos"), "line", "col", "flags")
    bind = sym("ArrayBinding").where(flag("non_tuple")).select("group_id", "file", "symbol", "block", F.col("pos").alias("b_pos"))
    ret = _strict(sym("ReturnIdentifier").where(flag("lacks_undefined")), facts)
    stop = sym("BindingUse").where(flag("is_reassign") | flag("is_nullish_guard")).select("group_id", "file", "symbol", "block", F.col("pos").alias("s_pos"))
    keys = ["group_id", "file", "symbol", "block"]
    pairs = ret.join(bind, keys).where("b_pos < pos")
    bad = pairs.alias("p").join(stop.alias("s"), (F.col("p.group_id") == F.col("s.group_id")) & (F.col("p.file") == F.col("s.file")) & (F.col("p.symbol") == F.col("s.symbol")) & (F.col("p.block") == F.col("s.block")) & (F.col("s.s_pos") > F.col("p.b_pos")) & (F.col("s.s_pos") < F.col("p.pos")), "left_anti")
    return diagnostics(bad, "return-type-widens-via-destructure", "warning", F.lit("The element may be missing though the return type says otherwise"), col=F.col("col"))


@rule("no-coalesce-then-guard", "warning", "defensive-code", "readability", needs=("expr_facts",))
def no_coalesce_then_guard(facts: Facts) -> DataFrame:
    """Kinds CoalesceBinding (attrs name, block, pos, empty), GuardIf (name, block, pos, guard: the empty value tested) and Reassign (name, block, pos): the first guard after the binding with no reassignment between."""
    at = lambda n, *more: _of(facts, n).select("group_id", "file", attr("name").alias("name"), _BLOCK().alias("block"), _POS().alias("pos"), "line", "col", *more)
    events = at("CoalesceBinding", F.lit(0).alias("what"), attr("empty").alias("value")).union(at("GuardIf", F.lit(1).alias("what"), attr("guard").alias("value"))).union(at("Reassign", F.lit(2).alias("what"), F.lit(None).cast("string").alias("value")))
    w = Window.partitionBy("group_id", "file", "block", "name").orderBy("pos", "what").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("what") != 1, F.struct("what", "value", "line", "col")), ignorenulls=True).over(w)
    hit = events.withColumn("prev", last).where("what = 1 and prev.what = 0 and prev.value = value").select("group_id", "file", F.col("prev.line").alias("line"), F.col("prev.col").alias("col")).distinct()
    return diagnostics(hit, "no-coalesce-then-guard", "warning", F.lit("The fallback is tested for right after"), col=F.col("col"))


@rule("no-swallowed-catch", "warning", "error-handling", "safety", needs=("expr_facts",), typed=True)
def no_swallowed_catch(facts: Facts) -> DataFrame:
    """Catch rows without a HandlerUse (throw, returned binding, binding passed to a call) of their own: parent_id is the catch."""
    use = _of(facts, "HandlerUse").select("group_id", "file", F.col("parent_id").alias("node_id")).distinct()
    return diagnostics(_of(facts, "Catch").join(use, ["group_id", "file", "node_id"], "left_anti"), "no-swallowed-catch", "warning", F.lit("The error goes no further"), col=F.col("col"))


@rule("no-error-rewrap", "error", "error-handling", "safety", needs=("expr_facts",))
def no_error_rewrap(facts: Facts) -> DataFrame:
    """ThrowNew rows inside a Catch (parent_id) that mention its binding and pass no cause."""
    inside = _of(facts, "Catch").select("group_id", "file", F.col("node_id").alias("parent_id"))
    t = _of(facts, "ThrowNew").where(flag("refs_error") & ~flag("has_cause")).join(inside, ["group_id", "file", "parent_id"], "left_semi")
    return diagnostics(t, "no-error-rewrap", "error", F.lit("The first error is lost: pass it as cause"), col=F.col("col"))


@rule("prefer-type-predicate", "warning", "interface-design", "api type-aware", "heuristic", ("expr_facts",), typed=True)
def prefer_type_predicate(facts: Facts) -> DataFrame:
    """BooleanFunction rows (flag one_wide_param) all of whose Return rows (parent_id) narrow."""
    r = _of(facts, "Return").groupBy("group_id", "file", F.col("parent_id").alias("node_id")).agg(F.bool_and(flag("is_narrowing")).alias("every"), F.count(F.lit(1)).alias("n"))
    f = _of(facts, "BooleanFunction").where(flag("one_wide_param")).join(r.where("every and n > 0"), ["group_id", "file", "node_id"])
    return diagnostics(f, "prefer-type-predicate", "warning", F.lit("A type predicate would carry this test to its callers"), col=F.col("col"))


@rule("optional-param-coerced-in-body", "warning", "interface-design", "api", needs=("expr_facts",))
def optional_param_coerced(facts: Facts) -> DataFrame:
    """OptionalParam rows (attrs function, name) whose first ParamUse (function, name, pos, use) is a coercion: assign-default or guard-throw."""
    at = F.struct(attr("use").alias("use"), F.col("line").alias("line"), F.col("col").alias("col"))
    first = _of(facts, "ParamUse").groupBy("group_id", "file", attr("function").alias("fn"), attr("name").alias("name")).agg(F.min_by(at, _POS()).alias("first")).where(F.col("first.use").isin("assign-default", "guard-throw"))
    p = _of(facts, "OptionalParam").select("group_id", "file", attr("function").alias("fn"), attr("name").alias("name")).distinct().join(first, ["group_id", "file", "fn", "name"])
    p = p.select("group_id", "file", "name", "first.line", "first.col")
    return diagnostics(p, "optional-param-coerced-in-body", "warning", F.concat(F.lit("The body does not accept a missing "), F.col("name")), col=F.col("col"))


@rule("no-defaulted-required-port-arg", "warning", "interface-design", "api type-aware", needs=("expr_facts",), typed=True)
def no_defaulted_required_port_arg(facts: Facts) -> DataFrame:
    """ImplParam (attrs iface, method, index; flag has_default) against PortParam (same keys; flag required)."""
    keys = lambda d: d.select("group_id", attr("iface").alias("iface"), attr("method").alias("method"), attr("index").alias("index"), "file", "line", "col")
    port = keys(_of(facts, "PortParam").where(flag("required"))).select("group_id", "iface", "method", "index").distinct()
    p = keys(_of(facts, "ImplParam").where(flag("has_default"))).join(port, ["group_id", "iface", "method", "index"], "left_semi").select("file", "line", "col").distinct()
    return diagnostics(p, "no-defaulted-required-port-arg", "warning", F.lit("The interface requires this argument"), col=F.col("col"))
