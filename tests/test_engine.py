"""Own TypeScript snippets through the whole scan: `// @expect rule` marks the lines to be reported, and no other line may be."""

from __future__ import annotations

import json
import re

import pytest

from tessella.operators.catalogue import all_rules
from tessella.plans import engine

CASES = {
    "no-any-cast": "const a = f() as any; // @expect no-any-cast\nconst b = f() as anything;\nconst c: any = 1;\n",
    "no-explicit-any-annotation": "let a: any = 1; // @expect no-explicit-any-annotation\nfunction g(x: Array<any>) { return x; } // @expect no-explicit-any-annotation\nconst any = 3; const q = any + 1; const r = z as any;\n",
    "no-inline-type-assertion": "const a = f() as { x: number }; // @expect no-inline-type-assertion\nconst b = f() as Shape;\n",
    "no-type-assertion": "const a = v as unknown as Shape; // @expect no-type-assertion\nconst b = v as unknown;\n",
    "no-never-cast": "const a = v as never; // @expect no-never-cast\nlet b: never;\n",
    "no-ts-ignore": "// @ts-ignore @expect no-ts-ignore // @expect no-ts-ignore\nf();\n// say @ts-ignore later\n",
    "no-coalesce-then-guard": "function f(m) {\n  const a = m ?? null; // @expect no-coalesce-then-guard\n  if (null !== a) return a;\n}\nfunction g(m) {\n  let b = m ?? null;\n  b = other();\n  if (b === null) return 1;\n}\nfunction h(m) {\n  const c = m ?? []; // @expect no-coalesce-then-guard\n  use(1);\n  if (0 < c.length) return c;\n  const d = m ?? 5;\n  if (!d) return 1;\n}\n",
    "no-swallowed-catch": "function a() {\n  try { go(); } catch (e) { // @expect no-swallowed-catch\n    return 1;\n    log(e);\n  }\n}\nfunction b() {\n  try { go(); } catch (e) { return { ok: false, e }; }\n}\nfunction c() {\n  try { go(); } catch (e) { log({ why: e }); }\n}\nfunction d() {\n  try { go(); } catch (e) { log({ e: 1 }); } // @expect no-swallowed-catch\n}\nfunction h() { return work().catch(() => 0); } // @expect no-swallowed-catch\nfunction i() { return work().catch((x) => ({ x })); }\nfunction j() { return work().catch(onError); }\nfunction k() {\n  try { go(); } catch (e) { // @expect no-swallowed-catch\n    later(() => { throw e; });\n  }\n}\n",
    "no-error-rewrap": "try { go(); } catch (e) {\n  throw new Error(`bad ${e}`); // @expect no-error-rewrap\n}\ntry { go(); } catch (e) {\n  throw new Error('bad', { cause: e });\n}\n",
    "optional-param-coerced-in-body": "function f(a?: string) {\n  a ??= 'x'; // @expect optional-param-coerced-in-body\n  return a;\n}\nfunction g(a?: string) {\n  use(a);\n  a = a ?? 'x';\n}\nfunction h(a?: string) {\n  if (null == a) { throw new Error('a'); } // @expect optional-param-coerced-in-body\n}\n",
    "trivial-type-alias": "type A = B; // @expect trivial-type-alias\ntype C<T> = B;\ntype D = B<string>;\ntype E = B | C;\n",
    "no-dynamic-import": "const m = await import('./x'); // @expect no-dynamic-import\nimport y from './y';\n",
}

#: Types that a file tells by itself.
TYPED = {
    "no-non-null-assertion": "function f(a: string | null, b?: number, c: string) {\n  use(a!.length); // @expect no-non-null-assertion\n  use(c!.length);\n  if (b) { use(b!); }\n}\nfunction g(a: Other | null) { use(a!); }\n",
    "no-nullish-coalescing": "function f(a: string, b: string | undefined, c: Other, d: any) {\n  const x = a ?? 'x'; // @expect no-nullish-coalescing\n  const y = b ?? 'y';\n  const z = c ?? 'z';\n  return d ?? x;\n}\nconst size = 5;\nuse(size ?? 6); // @expect no-nullish-coalescing\nfunction g(size) { return size ?? 6; }\n",
    "no-optional-property-access": "interface Box { v: number }\nfunction f(a: Box, b: Box | null, c: string[]) {\n  use(a?.v); // @expect no-optional-property-access\n  use(b?.v);\n  use(c?.length); // @expect no-optional-property-access\n}\n",
    "no-optional-element-access": "function f(a: number[], b?: number[]) {\n  use(a?.[0]); // @expect no-optional-element-access\n  use(b?.[0]);\n}\n",
    "no-useless-await": "async function f(a: number, b: Promise<number>, c: unknown) {\n  await a; // @expect no-useless-await\n  await b;\n  await c;\n  await a.then();\n}\n",
    "no-double-negation-coercion": "function f(a: boolean, b: string) {\n  const x = !!a; // @expect no-double-negation-coercion\n  return [x, !!b];\n}\n",
    "no-logical-or-fallback": "function f(a: number, b: string) {\n  const x = a || 10; // @expect no-logical-or-fallback\n  const y = a || 0;\n  return b || 'none';\n}\n",
    "no-redundant-existence-guard": "class Box { v = 1 }\nfunction f(a: Box, b: Box | undefined) {\n  use(a && a.v); // @expect no-redundant-existence-guard\n  use(b && b.v);\n}\n",
    "no-ts-expect-error": "// @ts-expect-error why // @expect no-ts-expect-error\nf();\n",
}

CROSS = {
    "duplicate-file": {"/p/a.ts": "export const first = go( 1 );\n", "/p/b.ts": "export  const first = go( 1 ); // @expect duplicate-file\n".replace(" // @expect duplicate-file", ""), "/p/c.ts": "export const other = go(2);\n"},
    "duplicate-type-declaration": {"/p/a.ts": "export interface Point { x: number; y: number }\n", "/p/b.ts": "type Place = { y: number; x: number }; // @expect duplicate-type-declaration\ntype Third = { y?: number; x: number };\n"},
    "duplicate-function-declaration": {"/p/a.ts": "export function one(q: string) { const t = q.trim(); go(t); return t.length; }\n", "/p/b.ts": "export function two(q: string) { const t = q.trim(); go(t); return t.length; } // @expect duplicate-function-declaration\n"},
    "near-duplicate-function": {"/p/a.ts": "export function one(q) { if (q) { go('a', q); } stop(q, 1); return q; }\n", "/p/b.ts": "export function two(w) { if (w) { go('b', w); } stop(w, 2); return w; } // @expect near-duplicate-function\n"},
    "duplicate-constant-declaration": {"/p/a.ts": "const RETRY_LIMIT = 42;\nconst SIZE = 7;\n", "/p/b.ts": "const maxRetry = 42; // @expect duplicate-constant-declaration\nconst WIDTH = 7;\n"},
    "unused-export": {"/p/a.ts": "export function used() { return 1; }\nexport function idle() { return 2; } // @expect unused-export\nexport function near() { return 3; }\nexport const x = near();\n", "/p/b.ts": "import { used, x } from './a';\nuse(used(), x);\n", "/p/index.ts": "export function entry() { return 4; }\n"},
}


def expected(files):
    return {(f, n + 1, rule) for f, s in files.items() for n, line in enumerate(s.split("\n")) for rule in re.findall(r"// @expect (\S+)", line)}


def scan(spark, files, rule, **options):
    df = spark.createDataFrame(list(files.items()), "file string, source string").repartition(3)
    return engine.scan_sources(spark, df, engine.ScanOptions(rules=[rule], **options), "/p")


@pytest.mark.parametrize("rule", CASES)
def test_node_rules(spark, rule):
    files = {"/p/case.ts": CASES[rule]}
    got = {(r["file"], r["line"], r["rule_id"]) for r in scan(spark, files, rule).diagnostics.collect()}
    assert got == expected(files) and got


@pytest.mark.parametrize("rule", TYPED)
def test_rules_on_local_types(spark, rule):
    files = {"/p/case.ts": TYPED[rule]}
    got = {(r["file"], r["line"], r["rule_id"]) for r in scan(spark, files, rule).diagnostics.collect()}
    assert got == expected(files) and got


def test_heritage_over_diamonds(spark):
    from tessella.operators.rules_node import heritage

    edges = [(f"n{i}", f"{side}{i}") for i in range(18) for side in "lr"] + [(f"{side}{i}", f"n{i + 1}") for i in range(18) for side in "lr"]
    got = heritage(spark.createDataFrame(edges, "child string, parent string"))
    assert got.where("child = 'n0'").count() == 18 * 3  # 2 ** 18 paths lead to the last


def test_strict_gate_holds_for_joins(spark):
    from tessella.plans.rule_tables import related_facts

    facts = {"expr_facts": related_facts(spark, "/root/testdata/sf0.001")["expr_facts"]}
    options = lambda on: spark.createDataFrame([("g", on, False)], "group_id string, strict_null_checks boolean, no_unchecked_indexed_access boolean")
    run = all_rules()["return-type-widens-via-destructure"].run
    assert run(facts | {"group_options": options(False)}).count() == 0 < run(facts | {"group_options": options(True)}).count() == run(facts).count()


@pytest.mark.parametrize("rule", CROSS)
def test_cross_file_rules(spark, rule):
    files = CROSS[rule]
    got = {(r["file"], r["line"], r["rule_id"]) for r in scan(spark, files, rule).diagnostics.collect()}
    assert got == (expected(files) or {("/p/b.ts", 1, rule)})


def test_every_rule_runs_on_nothing(spark):
    df = spark.createDataFrame([("/p/a.ts", ""), ("/p/b.ts", None)], "file string, source string")
    r = engine.scan_sources(spark, df, engine.ScanOptions(rules=list(all_rules())), "/p")
    assert r.visible.count() == 0 and r.exit_code == 0


def test_execute_reads_config_ignores_and_baseline(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name in ("src/a.ts", "src/skip.ts", "node_modules/x.ts", "src/t.d.ts"):
        (tmp_path / name).write_text("const a = f() as any;\nconst b = g() as any;\n")
    (tmp_path / ".gitignore").write_text("skip.ts\n")
    (tmp_path / "tessella.config.json").write_text(json.dumps({"rules": {"no-any-cast": "warning"}, "failOn": "warning"}))
    root = str(tmp_path)
    r = engine.execute(spark, root)
    rows = r.visible.collect()
    assert {(x["file"].removeprefix(root), x["line"], x["severity"]) for x in rows} == {("/src/a.ts", 1, "warning"), ("/src/a.ts", 2, "warning")} and r.exit_code == 1 and r.file_count == 1
    base = f"{root}/base.json"
    assert engine.write_baseline(r, base, root) == 1
    again = engine.execute(spark, root, engine.ScanOptions(baseline=engine.read_baseline(spark, base)))
    assert again.visible.count() == 0 and again.exit_code == 0
    assert engine.execute(spark, root, engine.ScanOptions(rule_policy=[("no-any-cast", "off")])).visible.count() == 0
    with pytest.raises(ValueError, match="unknown"):
        engine.execute(spark, root, engine.ScanOptions(rules=["nothing"]))


def test_typed_rules_read_facts_from_outside(spark):
    from tessella import schema

    part = lambda flag, literal=None: (flag, 0, 0, 0, False, False, literal)
    row = lambda kind, line, op=None, parts=(), flags=None, attrs=None, nullable=None: ("", "/p/a.ts", f"{kind}:{line}", None, kind, op, 0, 6, line, 1, "x ?? y", "x", list(parts), list(parts), None, nullable, False, False, False, flags or {}, attrs or {})
    facts = spark.createDataFrame([
        row("Binary", 1, "??", [part("string")]), row("Binary", 2, "??", [part("string"), part("null")]), row("Await", 3, parts=[part("number")]), row("Await", 4, parts=[part("any")]), row("Await", 5, parts=[part("object")], flags={"has_then": True}),
        row("NonNull", 6, parts=[part("object"), part("undefined")]), row("NonNull", 7, parts=[part("object")]), row("PropertyAccess", 8, parts=[part("object")], flags={"has_qdot": True}, attrs={"qdot_start": "1", "qdot_end": "3"}),
        row("DoubleNegation", 9, parts=[part("boolean")]), row("AsExpression", 10, parts=[part("unknown")], flags={"target_concrete": True}), row("AsExpression", 11, parts=[part("unknown")], flags={"target_concrete": True, "empty_array": True}),
    ], schema.EXPR_FACTS)
    df = spark.createDataFrame([("/p/a.ts", "\n" * 20)], "file string, source string")
    rules = ["no-nullish-coalescing", "no-useless-await", "no-non-null-assertion", "no-optional-property-access", "no-double-negation-coercion", "no-unvalidated-cast"]
    r = engine.scan_sources(spark, df, engine.ScanOptions(rules=rules), "/p", extra={"expr_facts": facts})
    got = {(x["line"], x["rule_id"]): x["fix"] for x in r.diagnostics.collect()}
    assert set(got) == {(1, "no-nullish-coalescing"), (3, "no-useless-await"), (6, "no-non-null-assertion"), (8, "no-optional-property-access"), (9, "no-double-negation-coercion"), (10, "no-unvalidated-cast")}
    assert tuple(got[1, "no-nullish-coalescing"]) == (0, 6, "x") and tuple(got[8, "no-optional-property-access"]) == (1, 3, ".")
    loose = spark.createDataFrame([("", False, False)], "group_id string, strict_null_checks boolean, no_unchecked_indexed_access boolean")
    r = engine.scan_sources(spark, df, engine.ScanOptions(rules=rules, group_options=loose), "/p", extra={"expr_facts": facts})
    assert {x["rule_id"] for x in r.diagnostics.collect()} == {"no-useless-await", "no-double-negation-coercion", "no-unvalidated-cast"}
