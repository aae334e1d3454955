"""Policy, suppression, overrides, baseline, visibility, exit codes and fixes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella import schema
from tessella.operators import annotate, fixes, policy
from tessella.operators.catalogue import all_rules, metadata, rules_table

ROW = schema.DIAGNOSTICS + ", seq int"


def diags(spark, rows):
    return spark.createDataFrame([(r, s, "m", f, l, c, None, None, i) for i, (r, s, f, l, c) in enumerate(rows)], ROW)


def resolved(spark, rows, **options):
    p = spark.createDataFrame([(i, s, v) for i, (s, v) in enumerate(rows)], policy.POLICY)
    return {r["rule_id"]: r["severity"] for r in policy.resolve_rules(rules_table(spark), p, **options).collect()}


def test_catalogue_has_all_rules(spark):
    rules = all_rules()
    assert len(rules) == 52 and sum(r.confidence == "heuristic" for r in rules.values()) == 22
    with pytest.raises(KeyError):
        metadata("no-such-rule")


def test_policy(spark):
    assert resolved(spark, [])["no-any-cast"] == "error"
    got = resolved(spark, [("category:type-evasion", "info"), ("no-never-*", "off"), ("tag:readability", "warning"), ("no-any-cast", "warning"), ("no-any-cast", "error")])
    assert got["no-any-cast"] == "error" and "no-never-cast" not in got and got["no-type-assertion"] == "info"
    assert set(resolved(spark, [("no-any-cast", "off")], strict=True).values()) == {"error"}
    assert "no-any-cast" not in resolved(spark, [("no-any-cast", "off")], strict=True)
    audit = resolved(spark, [], mode="audit")
    assert "unused-export" in audit and "no-any-cast" not in audit and len(audit) == 22
    assert resolved(spark, [("confidence:heuristic", "info")], only=["unused-export", "no-any-cast"]) == {"unused-export": "info", "no-any-cast": "error"}


def test_overrides_come_last_and_stay_inside_the_root(spark):
    d = diags(spark, [("no-any-cast", "error", "src/a.ts", 1, 1), ("no-any-cast", "error", "../b.ts", 1, 1), ("no-never-cast", "error", "src/gen/c.ts", 2, 1)])
    rows = [(0, "src/**", "*", "info"), (1, "src/gen/", "no-never-cast", "off"), (2, "**/*.ts", "tag:nothing", "off")]
    got = {r["file"]: r["severity"] for r in policy.apply_overrides(d, rows, rules_table(spark), F.col("file")).collect()}
    assert got == {"src/a.ts": "info", "../b.ts": "error"}


def test_baseline_is_all_or_nothing(spark):
    d = diags(spark, [("r", "info", "a", i, 1) for i in range(3)] + [("r", "info", "b", i, 1) for i in range(2)] + [("q", "info", "a", 1, 1)])
    base = spark.createDataFrame([("a", "r", 2), ("b", "r", 2), ("zz", "r", 9)], policy.BASELINE)
    got = policy.apply_baseline(d, base).groupBy("file", "rule_id").count().collect()
    assert {(r["file"], r["rule_id"], r["count"]) for r in got} == {("a", "r", 3), ("a", "q", 1)}
    assert policy.apply_baseline(d, policy.make_baseline(d)).count() == 0


def test_dedupe_keeps_the_first_of_a_line(spark):
    d = diags(spark, [("r", "info", "a", 1, 9), ("r", "error", "a", 1, 2), ("q", "info", "a", 1, 1)])
    assert sorted((r["rule_id"], r["col"]) for r in policy.dedupe(d).collect()) == [("q", 1), ("r", 9)]


@pytest.mark.parametrize(("on", "codes"), [("none", (0, 0, 0, 0)), ("info", (0, 1, 1, 2)), ("warning", (0, 0, 1, 2)), ("error", (0, 0, 0, 2))])
def test_exit_codes(spark, on, codes):
    got = [spark.range(1).select(policy.exit_code(F.lit(top).cast("int"), on).alias("c")).first()["c"] for top in (None, 1, 2, 3)]
    assert tuple(got) == codes


def test_suppression_and_annotation(spark):
    comments = spark.createDataFrame(
        [("a", "Line", " @allow r why", 0, 9, 1, 1), ("a", "Line", " more", 10, 20, 2, 2), ("a", "Line", " text about it", 50, 60, 5, 5), ("a", "Block", "*\n * first\n * second\n ", 70, 99, 8, 11), ("a", "Line", " @allow other", 120, 130, 20, 20)],
        "file string, kind string, value string, start int, `end` int, start_line int, end_line int",
    )
    d = diags(spark, [("r", "warning", "a", n, 1) for n in (1, 2, 3, 4, 5, 12, 20, 21)] + [("r", "error", "a", 3, 1)])
    kept = annotate.suppress(d, comments)
    assert sorted((r["line"], r["severity"]) for r in kept.collect()) == [(3, "error"), *[(n, "warning") for n in (4, 5, 12, 20, 21)]]
    note = {r["line"]: r["annotation"] for r in annotate.attach(kept, comments).collect()}
    assert note[5] == "text about it" and note[12] == "first\nsecond" and note[4] is None and note[20] is None


def test_fixes_skip_overlaps(spark):
    assert fixes.splice("abcdef", [(0, 1, "X"), (1, 2, "Y"), (1, 3, "no"), (4, 6, "")]) in [("XYcd", 3), ("Xnod", 3)]
    assert fixes.splice("a😀b", [(3, 4, "c")]) == ("a😀c", 1)
    files = spark.createDataFrame([("a", "x ?? y"), ("b", "same")], "file string, source string")
    d = spark.createDataFrame([("r", "info", "m", "a", 1, 1, None, (0, 6, "x"))], schema.DIAGNOSTICS)
    assert [tuple(r) for r in fixes.apply_fixes(files, d).collect()] == [("a", "x", 1)]


@pytest.mark.parametrize(("glob", "path", "hit"), [("dist", "a/dist/b.ts", True), ("/dist", "a/dist/b.ts", False), ("*.ts", "a/b.ts", True), ("a/**/z.ts", "a/z.ts", True), ("a/**/z.ts", "a/b/c/z.ts", True), ("a/", "a/b.ts", True), ("a/", "ba/b.ts", False), ("b?.ts", "bc.ts", True), ("[!x].ts", "x.ts", False)])
def test_globs(spark, glob, path, hit):
    assert spark.range(1).select(F.lit(path).rlike(policy.glob_regex(glob)).alias("h")).first()["h"] is hit


def test_last_ignore_pattern_wins(spark):
    f = lambda p: spark.range(1).select(policy.ignored(F.lit(p), ["# no", "*.log", "!keep.log", ""]).alias("h")).first()["h"]
    assert f("a/x.log") and not f("keep.log") and not f("x.ts")
