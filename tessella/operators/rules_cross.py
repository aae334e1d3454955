"""The cross-file rules: aggregates, semi and anti joins over fact tables.

Every rule takes the fact tables by name and returns diagnostics. Groups never
cross group_id, except the usage side of unused-export. A files table with
column reportable tells which files may host a report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators.catalogue import rule
from tessella.operators.groups import diagnostics, grouped, report_groups, report_target
from tessella.operators.runs import maximal_runs

Facts = dict[str, DataFrame]


def _with_reportable(entries: DataFrame, facts: Facts) -> DataFrame:
    """Adds whether an entry's file may host a report; every file may where there is no files table."""
    if "files" not in facts:
        return entries.withColumn("reportable", F.lit(True))
    f = facts["files"].select(F.col("group_id").alias("_g"), F.col("file").alias("_f"), F.col("reportable")).distinct()
    return entries.join(f, (F.col("group_id") == F.col("_g")) & (F.col("file") == F.col("_f")), "left").drop("_g", "_f").withColumn("reportable", F.coalesce("reportable", F.lit(False)))


def _package(entries: DataFrame, facts: Facts) -> DataFrame:
    f = facts["files"].select(F.col("group_id").alias("_g"), F.col("file").alias("_f"), "package_root").distinct()
    return entries.join(f, (F.col("group_id") == F.col("_g")) & (F.col("file") == F.col("_f")), "left").drop("_g", "_f").withColumn("package_root", F.coalesce("package_root", F.lit("")))


_may = lambda e: e["reportable"]
_named = lambda e: F.concat(e["name"], F.lit(" ("), e["file"], F.lit(":"), e["line"].cast("string"), F.lit(")"))
_placed = lambda e: F.concat(e["file"], F.lit(":"), e["line"].cast("string"))
_every = lambda entries, f: F.forall(entries, f)


def _says(verb: str):
    return lambda host, others, size: F.concat(F.lit(f"{verb} "), host["name"], F.lit(": also "), others)


@rule("duplicate-file", "warning", "cross-file", "duplicate", "heuristic", ("files",))
def duplicate_file(facts: Facts) -> DataFrame:
    f = facts["files"].select("group_id", "file", F.lit(1).alias("line"), F.col("ws_hash").alias("hash"), "reportable")
    return report_groups(grouped(f, ["group_id", "hash"]), "duplicate-file", "warning", lambda e: e["file"], lambda h, o, n: F.concat(F.lit("Same content as "), o), _may)


@rule("duplicate-type-declaration", "warning", "cross-file", "duplicate", "heuristic", ("types", "files"))
def duplicate_type_declaration(facts: Facts) -> DataFrame:
    t = _with_reportable(facts["types"], facts).select("group_id", "file", "line", "col", "name", "hash", "node_kind", "n_members", "reportable")
    trivial = lambda e: e["node_kind"].isin("InterfaceDeclaration", "TypeLiteral") & (e["n_members"] <= 1)
    g = grouped(t, ["group_id", "hash"]).where("n_files >= 2").where(~_every("entries", trivial))
    return report_groups(g, "duplicate-type-declaration", "warning", _named, _says("Type shape repeated by"), _may)


@rule("duplicate-type-name", "warning", "cross-file", "duplicate", "heuristic", ("types", "files"))
def duplicate_type_name(facts: Facts) -> DataFrame:
    t = _package(_with_reportable(facts["types"].where("exported"), facts), facts).select("group_id", "package_root", "name", "file", "line", "col", "hash", "node_kind", "reportable")
    shaped = lambda e: e["node_kind"].isin("InterfaceDeclaration", "TypeLiteral")
    g = grouped(t, ["group_id", "package_root", "name"], carry=["col", "hash", "node_kind", "reportable"]).where("n_files >= 2").where(F.size(F.array_distinct(F.transform("entries", lambda e: e["hash"]))) > 1).where(_every("entries", shaped))
    return report_groups(g, "duplicate-type-name", "warning", _placed, lambda h, o, n: F.concat(F.lit("Exported type name with another shape at "), o), _may)


@rule("duplicate-function-declaration", "warning", "cross-file", "duplicate", "heuristic", ("functions", "files"))
def duplicate_function_declaration(facts: Facts) -> DataFrame:
    """The first entry in insertion order decides about single statements; entries may share a file."""
    f = _with_reportable(facts["functions"], facts).select("group_id", "file", "line", "col", "name", "hash", "single_statement", "seq", "reportable")
    g = grouped(f, ["group_id", "hash"])
    first = F.array_min(F.transform("entries", lambda e: F.struct(e["seq"].alias("seq"), e["single_statement"].alias("s"))))
    return report_groups(g.where(~F.coalesce(first["s"], F.lit(False))), "duplicate-function-declaration", "warning", _named, _says("Body repeated by"), _may)


@rule("duplicate-function-name", "warning", "cross-file", "duplicate", "heuristic", ("functions", "imports", "files"))
def duplicate_function_name(facts: Facts) -> DataFrame:
    """Anti-joins groups two of whose files are linked by relative imports in at most two hops."""
    f = _package(_with_reportable(facts["functions"].where("exported"), facts), facts).select("group_id", "package_root", "name", "file", "line", "col", "hash", "reportable")
    g = grouped(f, ["group_id", "package_root", "name"], carry=["col", "hash", "reportable"]).where("n_files >= 2").where(F.size(F.array_distinct(F.transform("entries", lambda e: e["hash"]))) > 1)
    base = T.resolve_relative(F.col("file"), F.col("source"))
    edge = facts["imports"].where(F.col("source").startswith(".")).select("group_id", F.col("file").alias("src"), F.explode(T.module_candidates(base, T.LINK_EXTENSIONS)).alias("c")).select("group_id", "src", F.col("c.path").alias("dst")).distinct()
    known = facts["files"].select("group_id", F.col("file").alias("dst"))
    edge = edge.join(known, ["group_id", "dst"], "left_semi")
    hop = edge.select("group_id", "src", F.col("dst").alias("mid")).join(edge.select("group_id", F.col("src").alias("mid"), "dst"), ["group_id", "mid"]).select("group_id", "src", "dst")
    linked = edge.select("group_id", "src", "dst").union(hop).where("src <> dst").distinct()
    files = g.select("group_id", "package_root", "name", F.explode(F.array_distinct(F.transform("entries", lambda e: e["file"]))).alias("file"))
    a, b = files.select("group_id", "package_root", "name", F.col("file").alias("src")), files.select("group_id", "package_root", "name", F.col("file").alias("dst"))
    exempt = a.join(b, ["group_id", "package_root", "name"]).where("src <> dst").join(linked, ["group_id", "src", "dst"], "left_semi").select("group_id", "package_root", "name").distinct()
    g = g.join(exempt, ["group_id", "package_root", "name"], "left_anti")
    return report_groups(g, "duplicate-function-name", "warning", _placed, lambda h, o, n: F.concat(F.lit("Exported function name with another body at "), o), _may)


@rule("duplicate-constant-declaration", "info", "cross-file", "duplicate", "heuristic", ("constants", "files"))
def duplicate_constant_declaration(facts: Facts) -> DataFrame:
    """Keeps groups two members of which share a part of their names."""
    c = _with_reportable(facts["constants"], facts).select("group_id", "file", "line", "col", "name", "value_hash", "value_text", "reportable")
    g = grouped(c, ["group_id", "value_hash"]).where("n_files >= 2")
    parts = F.flatten(F.transform("entries", lambda e: T.name_segments(e["name"])))
    g = g.where(F.size(parts) > F.size(F.array_distinct(parts)))
    return report_groups(g, "duplicate-constant-declaration", "info", _named, _says("Constant value repeated by"), _may)


@rule("duplicate-inline-type-in-params", "warning", "cross-file", "duplicate api", "heuristic", ("inline_param_types", "files"))
def duplicate_inline_type(facts: Facts) -> DataFrame:
    t = _with_reportable(facts["inline_param_types"], facts).select("group_id", "file", "line", "col", "hash", "type_text", "reportable")
    return report_groups(grouped(t, ["group_id", "hash"]), "duplicate-inline-type-in-params", "warning", _placed, lambda h, o, n: F.concat(F.lit("Parameter type "), h["type_text"], F.lit(" also written at "), o), _may)


@rule("near-duplicate-function", "warning", "cross-file", "duplicate", "heuristic", ("functions", "files"))
def near_duplicate_function(facts: Facts, least_body: int = 32) -> DataFrame:
    f = _with_reportable(facts["functions"], facts).withColumn("simple", ~F.col("has_control_flow") & (F.col("n_top_stmts") <= 2))
    f = f.select("group_id", "file", "line", "col", "name", "normalized_hash", "hash", "norm_body_len", "simple", "reportable")
    g = grouped(f, ["group_id", "normalized_hash"]).where(F.size(F.array_distinct(F.transform("entries", lambda e: e["hash"]))) > 1)
    g = g.where(~_every("entries", lambda e: e["norm_body_len"] < least_body)).where(~_every("entries", lambda e: e["simple"]))
    return report_groups(g, "near-duplicate-function", "warning", _named, _says("But for names and literals the same as"), _may)


@rule("duplicate-statement-sequence", "warning", "cross-file", "duplicate", "heuristic", ("statements", "files"))
def duplicate_statement_sequence(facts: Facts) -> DataFrame:
    s = facts["statements"]
    runs = maximal_runs(s).withColumn("run", F.monotonically_increasing_id())
    at = s.select("group_id", F.col("block_id").alias("b"), F.col("pos").alias("p"), "file", "line", "col")
    entries = _with_reportable(runs.select("run", "group_id", "length", F.explode("participants").alias("x")).join(at.withColumnRenamed("group_id", "g2"), (F.col("group_id") == F.col("g2")) & (F.col("x.block") == F.col("b")) & (F.col("x.pos") == F.col("p"))).select("run", "group_id", "length", "file", "line", "col"), facts)
    return report_groups(grouped(entries, ["group_id", "run"], carry=["length", "col", "reportable"]), "duplicate-statement-sequence", "warning", _placed, lambda h, o, n: F.concat(h["length"].cast("string"), F.lit(" statements repeated at "), o), _may)


@rule("repeated-literal-property", "warning", "interface-design", "duplicate readability", "heuristic", ("literal_props",))
def repeated_literal_property(facts: Facts, scopes: int = 5, const_scopes: int = 3) -> DataFrame:
    p = facts["literal_props"]
    g = p.groupBy("group_id", "file", "value").agg(
        F.count_distinct("scope_id").alias("n_scopes"), F.bool_or("is_as_const").alias("is_const"), F.count_distinct(F.when(F.col("key") != "", F.col("key"))).alias("n_keys"), F.array_sort(F.collect_list("line")).alias("lines")
    )
    g = g.where("n_keys <> 1").where(F.col("n_scopes") >= F.when(F.col("is_const"), const_scopes).otherwise(scopes))
    also = F.array_join(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(1))), ", ")
    return diagnostics(g, "repeated-literal-property", "warning", F.concat(F.to_json(F.struct("value")), F.lit(" in "), F.col("n_scopes").cast("string"), F.lit(" scopes; further lines "), also), "file", F.get("lines", F.lit(0)))


@rule("repeated-return-shape", "warning", "interface-design", "duplicate readability", "heuristic", ("return_shapes", "types", "files"))
def repeated_return_shape(facts: Facts, functions: int = 3, least_keys: int = 2, files: int = 2) -> DataFrame:
    r = facts["return_shapes"].withColumn("names", F.array_distinct("props")).where(F.size("names") >= least_keys).withColumn("key", T.shape_key(F.col("names")))
    r = _with_reportable(r.select("group_id", "key", "file", F.col("fn_line").alias("line"), F.col("fn_name").alias("name")).dropDuplicates(["group_id", "key", "file", "line"]), facts)
    known = facts["types"].where(F.size("prop_names") >= least_keys).select("group_id", T.shape_key(F.array_distinct("prop_names")).alias("key")).distinct()
    g = grouped(r.join(known, ["group_id", "key"], "left_anti"), ["group_id", "key"]).where((F.col("size") >= functions) & (F.col("n_files") >= files))
    return report_groups(g, "repeated-return-shape", "warning", _named, lambda h, o, n: F.concat(F.lit("Unnamed object shape returned by "), n.cast("string"), F.lit(" functions, also "), o), _may, prefer_copy=False)


def _sites(facts: Facts, least: int) -> DataFrame:
    """Functions whose signature may change, with an aggregate of their call sites: one equi join on the symbol."""
    c = facts["call_sites"].where("symbol_id is not null").groupBy("group_id", F.col("symbol_id").alias("s_id")).agg(
        F.count(F.lit(1)).alias("n_sites"), F.min("arg_count").alias("least_args"), F.max("arg_count").alias("most_args"), F.bool_or("has_spread").alias("spread")
    ).where(F.col("n_sites") >= least).where("not spread")
    f = facts["functions"].where("symbol_id is not null and not implements_interface and not has_rest")
    return f.join(c.withColumnRenamed("group_id", "g2"), (F.col("group_id") == F.col("g2")) & (F.col("symbol_id") == F.col("s_id")))


@rule("optional-arg-always-used", "warning", "cross-file", "api", "heuristic", ("functions", "call_sites"), typed=True)
def optional_arg_always_used(facts: Facts) -> DataFrame:
    each = _sites(facts, 2).select("file", "line", "name", "n_sites", "least_args", F.posexplode("params").alias("i", "p")).where("(p.optional or p.has_default) and least_args > i")
    return diagnostics(each, "optional-arg-always-used", "warning", F.concat(F.lit("All "), F.col("n_sites").cast("string"), F.lit(" calls pass "), F.col("p.name"), F.lit(": it need not be optional")))


@rule("optional-arg-never-used", "warning", "cross-file", "api", "heuristic", ("functions", "call_sites"), typed=True)
def optional_arg_never_used(facts: Facts) -> DataFrame:
    numbered = F.transform("params", lambda p, i: F.struct(p["name"].alias("name"), ((p["optional"] | p["has_default"]) & (F.col("most_args") <= i)).alias("unused")))
    each = _sites(facts, 2).withColumn("names", F.transform(F.filter(numbered, lambda x: x["unused"]), lambda x: x["name"])).where(F.size("names") > 0)
    return diagnostics(each, "optional-arg-never-used", "warning", F.concat(F.lit("No call passes "), F.array_join("names", ", ")))


@rule("constant-argument", "warning", "cross-file", "api", "heuristic", ("functions", "call_sites"), typed=True)
def constant_argument(facts: Facts) -> DataFrame:
    fns = _sites(facts, 3).select("group_id", "file", "line", "fn_id", "symbol_id", "n_sites", F.posexplode("params").alias("i", "p"))
    args = facts["call_sites"].where("symbol_id is not null").select(F.col("group_id").alias("g2"), F.col("symbol_id").alias("s_id"), F.posexplode("args").alias("j", "a")).withColumn("lit", T.literal_arg(F.col("a")))
    same = args.groupBy("g2", "s_id", "j").agg(F.count("lit").alias("n_lit"), F.count_distinct("lit").alias("n_texts"), F.min("lit").alias("lit")).where("n_texts = 1")
    hit = fns.join(same, (F.col("group_id") == F.col("g2")) & (F.col("symbol_id") == F.col("s_id")) & (F.col("i") == F.col("j")) & (F.col("n_lit") == F.col("n_sites")))
    return diagnostics(hit, "constant-argument", "warning", F.concat(F.lit("Every call gives "), F.col("p.name"), F.lit(" the value "), F.col("lit")))


@rule("explicit-null-arg", "warning", "cross-file", "api", "heuristic", ("functions", "call_sites"), typed=True)
def explicit_null_arg(facts: Facts) -> DataFrame:
    own = facts["functions"].where("symbol_id is not null").select("group_id", "symbol_id").distinct()
    nullish = F.filter(F.transform("args", lambda a, i: F.struct(i.alias("i"), a["kind"].alias("kind"))), lambda a: a["kind"].isin("null", "undefined"))
    c = facts["call_sites"].join(own, ["group_id", "symbol_id"], "left_semi").withColumn("first", F.get(nullish, F.lit(0))).where("first is not null")
    return diagnostics(c, "explicit-null-arg", "warning", F.concat(F.lit("Passes "), F.col("first.kind"), F.lit(" to "), F.col("callee_name"), F.lit(" as argument "), (F.col("first.i") + 1).cast("string")))


@rule("trivial-wrapper", "warning", "cross-file", "duplicate", "heuristic", ("functions", "call_sites"), typed=True)
def trivial_wrapper(facts: Facts) -> DataFrame:
    f = facts["functions"].where("sole_call_id is not null and n_type_params = 0 and not is_predicate and not has_rest")
    f = f.where(F.col("sole_call_args") == F.transform("params", lambda p: p["name"]))
    c = facts["call_sites"].where("not has_type_args and not has_spread and symbol_id is not null").select(F.col("group_id").alias("g2"), F.col("call_id"), F.col("symbol_id").alias("callee"), "callee_name")
    own = facts["functions"].where("symbol_id is not null").select(F.col("group_id").alias("g2"), F.col("symbol_id").alias("callee")).distinct()
    c = c.join(own, ["g2", "callee"], "left_semi")
    hit = f.join(c, (F.col("group_id") == F.col("g2")) & (F.col("sole_call_id") == F.col("call_id"))).where(F.col("symbol_id").isNull() | (F.col("symbol_id") != F.col("callee")))
    return diagnostics(hit, "trivial-wrapper", "warning", F.concat(F.col("name"), F.lit(" only passes its arguments on to "), F.col("callee_name")))


@rule("dead-overload", "warning", "cross-file", "api type-evasion", "heuristic", ("overloads", "call_sites"), typed=True)
def dead_overload(facts: Facts) -> DataFrame:
    o = facts["overloads"].where("not is_implementation")
    called = facts["call_sites"].where("resolved_decl_id is not null").select(F.col("group_id"), F.col("resolved_decl_id").alias("decl_id")).distinct().withColumn("hit", F.lit(1))
    family = Window.partitionBy("group_id", "family_id")
    o = o.join(called, ["group_id", "decl_id"], "left").withColumn("live", F.sum(F.coalesce("hit", F.lit(0))).over(family)).withColumn("total", F.count(F.lit(1)).over(family))
    dead = o.where("hit is null and live > 0")
    hint = F.when((F.col("live") == 1) & (F.col("total") == 2) & F.col("cascade_hint"), F.lit("; without it the other signature can stand alone")).otherwise(F.lit(""))
    return diagnostics(dead, "dead-overload", "warning", F.concat(F.lit("No call resolves to this signature of "), F.col("name"), hint))


@rule("unused-export", "warning", "cross-file", "api", "heuristic", ("functions", "types", "constants", "imports", "call_sites", "ident_counts", "files"), typed=True)
def unused_export(facts: Facts) -> DataFrame:
    """Exports that no group uses: one plan of anti joins; the usage side drops the group."""
    calls = facts["call_sites"].where("decl_file is not null and symbol_name is not null").select(F.col("decl_file").alias("file"), F.col("symbol_name").alias("name"))
    imported = facts["imports"].where("resolved_file is not null").select(F.col("resolved_file").alias("file"), F.col("imported_name").alias("name"))
    used = calls.union(imported.where("name <> '*'")).distinct()
    whole = imported.where("name = '*'").select("file").distinct()
    by_default = imported.where("name = 'default'").select("file").distinct()
    imported_names = facts["imports"].select(F.col("file").alias("i_file"), F.col("imported_name").alias("class_name")).distinct()
    decls = facts["call_sites"].where("decl_id is not null").select("decl_id").distinct()
    none = F.lit(None).cast("string")
    fn = facts["functions"].where("exported and not implements_interface").select("group_id", "file", "name", "line", F.lit(0).alias("kind"), "exported_default", "class_name", "decl_id", "seq")
    ty = facts["types"].where("exported").select("group_id", "file", "name", "line", F.lit(1).alias("kind"), F.lit(False).alias("exported_default"), none.alias("class_name"), none.alias("decl_id"), "seq")
    co = facts["constants"].where("exported").select("group_id", "file", "name", "line", F.lit(2).alias("kind"), F.lit(False).alias("exported_default"), none.alias("class_name"), none.alias("decl_id"), "seq")
    c = _with_reportable(fn.union(ty).union(co), facts).where("reportable").where(~T.is_entry_point(F.col("file")))
    c = c.withColumn("short", F.element_at(F.split("name", r"\."), -1))
    c = c.join(whole, "file", "left_anti").join(used, ["file", "name"], "left_anti")
    c = c.join(facts["ident_counts"].where("n > 1").select("group_id", "file", F.col("ident").alias("short")), ["group_id", "file", "short"], "left_anti")
    c = c.join(decls, "decl_id", "left_anti")
    c = c.join(by_default.withColumn("exported_default", F.lit(True)), ["file", "exported_default"], "left_anti")
    c = c.alias("c").join(imported_names.alias("i"), (F.col("c.class_name") == F.col("i.class_name")) & (F.col("c.file") != F.col("i.i_file")), "left_anti")
    c = c.join(used.select(F.col("file"), F.col("name").alias("class_name")), ["file", "class_name"], "left_anti")
    first = c.withColumn("rn", F.row_number().over(Window.partitionBy("file", "name").orderBy("kind", "group_id", "seq"))).where("rn = 1")
    return diagnostics(first, "unused-export", "warning", F.concat(F.lit("Nothing imports or calls "), F.col("name")))
