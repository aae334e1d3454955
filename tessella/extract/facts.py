"""Fact tables from source files: one Python pass, everything after it in Catalyst."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella import schema
from tessella.extract.parser import extract
from tessella.functions import text as T

_MEMBER = "struct<name:string,optional:boolean,type_text:string,method:boolean>"
_PARAM = "struct<name:string,optional:boolean,has_default:boolean,type_text:string>"
_RAW = {
    "types": f"name string, line int, col int, members array<{_MEMBER}>, shape_text string, node_kind string, n_members int, prop_names array<string>, exported boolean, n_type_params int, n_type_args int, seq int",
    "functions": f"fn_id string, name string, line int, col int, tokens string, params array<{_PARAM}>, exported boolean, exported_default boolean, class_name string, implements_interface boolean, has_rest boolean, node_kind string, n_top_stmts int, is_expr_body boolean, has_control_flow boolean, is_predicate boolean, n_type_params int, sole_call_id string, sole_call_args array<string>, single_statement boolean, seq int",
    "constants": "name string, line int, col int, value_text string, exported boolean, seq int",
    "inline_param_types": f"line int, col int, members array<{_MEMBER}>, type_text string, seq int",
    "call_sites": "call_id string, line int, callee_name string, arg_count int, has_spread boolean, has_type_args boolean, args array<struct<kind:string,text:string>>",
    "imports": "local_name string, imported_name string, source string",
    "statements": "block_id string, pos int, tokens string, line int, col int, end_line int",
    "comments": "kind string, value string, start int, `end` int, start_line int, end_line int, directive string",
    "literal_props": "line int, key string, value string, is_as_const boolean, scope_id int",
    "return_shapes": "fn_line int, fn_name string, props array<string>",
    "ident_counts": "ident string, n int",
    "expr_facts": "node_id string, parent_id string, kind string, op string, start int, `end` int, line int, col int, text string, operand_text string, type_parts " + schema._PARTS + ", flags map<string,boolean>, attrs map<string,string>",
}


def _struct(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()


def raw_facts(files: DataFrame, needs: list[str] | None = None) -> DataFrame:
    """One row per file: group_id, file and one array of rows for each needed table.

    needs prunes the Python stage's output; files of one project that no rule
    needs are pruned by the caller. A text that is null has no facts.
    """
    wanted = [t for t in _RAW if needs is None or t in needs]
    fields = {t: [f.split()[0].strip("`") for f in _fields(_RAW[t])] for t in wanted}
    out = "group_id string, file string" + "".join(f", {t} array<{_struct(_RAW[t])}>" for t in wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [extract(s) for s in pdf["source"]]
            yield pd.DataFrame({"group_id": pdf["group_id"], "file": pdf["file"], **{t: [[{k: row.get(k) for k in fields[t]} for row in x[t]] for x in found] for t in wanted}})

    return files.select("group_id", "file", "source").mapInPandas(run, out)


def _fields(ddl: str) -> list[str]:
    from pyspark.sql.types import StructType

    return [f.name for f in StructType.fromDDL(ddl)]


def shape_hash(members, shape_text=None):
    """The shape hash of extracted members; other types by their text."""
    texts = F.transform(members, lambda m: F.when(m["method"], m["name"]).otherwise(F.concat(m["name"], F.when(m["optional"], "?").otherwise(""), F.lit(":"), F.coalesce(m["type_text"], F.lit("any")))))
    shaped = F.concat(F.lit("{"), F.array_join(F.array_sort(texts), ";"), F.lit("}"))
    return T.hash_text(shaped if shape_text is None else F.coalesce(shaped, shape_text))


def fact_tables(raw: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """The fact tables of schema.TABLES that raw holds, by name. raw should be written or cached: each table is one explode of it."""
    out: dict[str, DataFrame] = {"files": files}
    have = raw.columns

    def rows(name: str) -> DataFrame:
        return raw.select("group_id", "file", F.explode(name).alias("r")).select("group_id", "file", "r.*")

    none = F.lit(None).cast("string")
    if "types" in have:
        out["types"] = rows("types").withColumn("hash", shape_hash(F.col("members"), F.col("shape_text"))).select(*_fields(schema.TYPES))
    if "functions" in have:
        fid = T.hash_text(F.concat_ws("\x00", "file", "fn_id"))
        f = rows("functions").withColumns(T.analyze_body(F.col("tokens"), F.transform("params", lambda p: p["name"])))
        f = f.where(~(F.col("node_kind").isin("ArrowFunction", "FunctionExpression") & (F.col("name").startswith("<anonymous>") | F.col("name").contains(".$arg")) & (F.col("body_len") < 64)))
        call = F.when(F.col("sole_call_id").isNotNull(), T.hash_text(F.concat_ws("\x00", "file", "sole_call_id")))
        out["functions"] = f.withColumns({"symbol_id": fid, "decl_id": fid, "fn_id": fid, "sole_call_id": call}).select(*_fields(schema.FUNCTIONS))
    if "constants" in have:
        out["constants"] = rows("constants").withColumn("value_hash", T.hash_text(F.col("value_text"))).select(*_fields(schema.CONSTANTS))
    if "inline_param_types" in have:
        out["inline_param_types"] = rows("inline_param_types").withColumn("hash", shape_hash(F.col("members"))).select(*_fields(schema.INLINE_PARAM_TYPES))
    if "statements" in have:
        s = rows("statements").withColumns({"hash": T.hash_text(F.col("tokens")), "norm_len": T.utf16_length(T.normalize_tokens(F.col("tokens"))), "block_id": F.concat_ws("#", "file", "block_id")})
        out["statements"] = s.select(*_fields(schema.STATEMENTS))
    if "comments" in have:
        out["comments"] = rows("comments").select(*_fields(schema.COMMENTS))
    if "imports" in have:
        i = rows("imports").withColumn("i_id", F.monotonically_increasing_id())
        found = i.where(F.col("source").startswith(".")).select("group_id", "file", "source").distinct()
        found = found.select("group_id", "file", "source", F.explode(T.module_candidates(T.resolve_relative(F.col("file"), F.col("source")))).alias("c"))
        known = files.select(F.col("group_id").alias("kg"), F.col("file").alias("kf"))
        hit = found.join(known, (F.col("group_id") == F.col("kg")) & (F.col("c.path") == F.col("kf"))).groupBy("group_id", "file", "source").agg(F.min_by("kf", "c.priority").alias("resolved_file"))
        out["imports"] = i.join(hit, ["group_id", "file", "source"], "left").select(*_fields(schema.IMPORTS))
    if "call_sites" in have:
        c = rows("call_sites").withColumn("call_id", T.hash_text(F.concat_ws("\x00", "file", "call_id")))
        out["call_sites"] = c.withColumns({k: none for k in ("symbol_id", "symbol_name", "decl_file", "decl_id", "resolved_decl_id")}).select(*_fields(schema.CALL_SITES))
        if "functions" in out and "imports" in out:
            out["call_sites"] = link_calls(out["call_sites"], out["functions"], out["imports"])
    for t, ddl in (("literal_props", schema.LITERAL_PROPS), ("return_shapes", schema.RETURN_SHAPES), ("ident_counts", schema.IDENT_COUNTS)):
        if t in have:
            out[t] = rows(t).select(*_fields(ddl))
    if "expr_facts" in have:
        from pyspark.sql.types import StructType

        e = rows("expr_facts")
        full = StructType.fromDDL(schema.EXPR_FACTS)
        out["expr_facts"] = e.select(*[F.col(f.name) if f.name in e.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in full])
    return out


def link_calls(calls: DataFrame, functions: DataFrame, imports: DataFrame) -> DataFrame:
    """Calls of plain names linked to the function of the same file, or to the one that the file imports by that name.

    That is as far as text goes: members, re-exports and shadowed names need an
    external resolver, whose columns replace these.
    """
    own = functions.where(~F.col("name").contains(".")).groupBy("group_id", "file", "name").agg(F.count(F.lit(1)).alias("n"), F.first("symbol_id").alias("s"), F.first("decl_id").alias("d")).where("n = 1")
    here = own.select("group_id", "file", F.col("name").alias("callee_name"), F.col("s").alias("s1"), F.col("d").alias("d1"))
    named = imports.where("resolved_file is not null").select("group_id", "file", F.col("local_name").alias("callee_name"), "imported_name", "resolved_file").dropDuplicates(["group_id", "file", "callee_name"])
    there = own.select(F.col("group_id").alias("g2"), F.col("file").alias("f2"), F.col("name").alias("n2"), F.col("s").alias("s2"), F.col("d").alias("d2"))
    there = named.join(there, (F.col("group_id") == F.col("g2")) & (F.col("resolved_file") == F.col("f2")) & (F.col("imported_name") == F.col("n2"))).select("group_id", "file", "callee_name", "s2", "d2", "n2", "f2")
    keys = ["group_id", "file", "callee_name"]
    both = calls.drop("symbol_id", "symbol_name", "decl_file", "decl_id").join(here, keys, "left").join(there, keys, "left")
    return both.select(*[
        F.coalesce("s1", "s2").alias(c) if c == "symbol_id" else F.coalesce(F.when(F.col("s1").isNotNull(), F.col("callee_name")), F.col("n2")).alias(c) if c == "symbol_name" else F.coalesce(F.when(F.col("s1").isNotNull(), F.col("file")), F.col("f2")).alias(c) if c == "decl_file"
        else F.coalesce("d1", "d2").alias(c) if c == "decl_id" else F.col(c) for c in _fields(schema.CALL_SITES)
    ])
