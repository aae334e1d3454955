"""Column types of the fact tables."""

from __future__ import annotations

FILES = "group_id string, file string, source string, ws_hash string, reportable boolean, package_root string"
TYPES = "group_id string, file string, name string, line int, col int, hash string, node_kind string, n_members int, prop_names array<string>, exported boolean, n_type_params int, n_type_args int, seq int"
FUNCTIONS = (
    "group_id string, file string, fn_id string, name string, line int, col int, hash string, normalized_hash string, body_len int, norm_body_len int, "
    "params array<struct<name:string,optional:boolean,has_default:boolean,type_text:string>>, exported boolean, exported_default boolean, symbol_id string, decl_id string, class_name string, "
    "implements_interface boolean, has_rest boolean, node_kind string, n_top_stmts int, is_expr_body boolean, has_control_flow boolean, is_predicate boolean, n_type_params int, "
    "sole_call_id string, sole_call_args array<string>, single_statement boolean, seq int"
)
CONSTANTS = "group_id string, file string, name string, line int, col int, value_hash string, value_text string, exported boolean, seq int"
INLINE_PARAM_TYPES = "group_id string, file string, line int, col int, hash string, type_text string, seq int"
CALL_SITES = "group_id string, file string, call_id string, line int, callee_name string, arg_count int, has_spread boolean, has_type_args boolean, args array<struct<kind:string,text:string>>, symbol_id string, symbol_name string, decl_file string, decl_id string, resolved_decl_id string"
IMPORTS = "group_id string, file string, local_name string, imported_name string, source string, resolved_file string"
STATEMENTS = "group_id string, file string, block_id string, pos int, hash string, line int, col int, end_line int, norm_len int"
COMMENTS = "file string, kind string, value string, start int, `end` int, start_line int, end_line int, directive string"
OVERLOADS = "group_id string, file string, family_id string, name string, decl_id string, line int, is_implementation boolean, cascade_hint boolean"
LITERAL_PROPS = "group_id string, file string, line int, key string, value string, is_as_const boolean, scope_id int"
RETURN_SHAPES = "group_id string, file string, fn_line int, fn_name string, props array<string>"
IDENT_COUNTS = "group_id string, file string, ident string, n int"
FIX = "struct<start:int,`end`:int,text:string>"
DIAGNOSTICS = f"rule_id string, severity string, message string, file string, line int, col int, annotation string, fix {FIX}"
FINGERPRINTS = "file string, size bigint, mtime_ns bigint, content_hash string"

_PARTS = "array<struct<flag:string,n_props:int,n_calls:int,n_constructs:int,has_str_index:boolean,has_num_index:boolean,literal:string>>"
#: The ingestion contract for type-aware rules: one row per candidate node, facts as named booleans and strings.
EXPR_FACTS = (
    "group_id string, file string, node_id string, parent_id string, kind string, op string, start int, `end` int, line int, col int, text string, operand_text string, "
    f"type_parts {_PARTS}, declared_type_parts {_PARTS}, type_text string, is_nullable boolean, unchecked_index_read boolean, ambient_declared boolean, decl_in_node_modules boolean, "
    "flags map<string,boolean>, attrs map<string,string>"
)

TABLES = {
    "files": FILES, "types": TYPES, "functions": FUNCTIONS, "constants": CONSTANTS, "inline_param_types": INLINE_PARAM_TYPES, "call_sites": CALL_SITES, "imports": IMPORTS,
    "statements": STATEMENTS, "comments": COMMENTS, "overloads": OVERLOADS, "literal_props": LITERAL_PROPS, "return_shapes": RETURN_SHAPES, "ident_counts": IDENT_COUNTS, "expr_facts": EXPR_FACTS,
}

SEVERITIES = ("info", "warning", "error")
