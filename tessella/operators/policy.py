"""From raw diagnostics to an exit code: rule policy, overrides, baseline, visibility.

Policies, overrides and rules are small dimension tables joined by theta
conditions; the diagnostics side is never shuffled for them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.text import wildcard

POLICY = "ord int, selector string, severity string"
OVERRIDES = "ord int, glob string, selector string, severity string"
BASELINE = "file string, rule_id string, allowed int"


def matches(selector: Column, rule_id: Column, category: Column, tags: Column, confidence: Column) -> Column:
    """Whether a selector (category:, tag:, confidence:, an id, or a pattern with *) covers a rule."""
    rest = lambda p: F.substring(selector, len(p) + 1, 1 << 20)
    return (
        F.when(selector.startswith("category:"), category == rest("category:"))
        .when(selector.startswith("tag:"), F.array_contains(tags, rest("tag:")))
        .when(selector.startswith("confidence:"), confidence == rest("confidence:"))
        .when(selector == rule_id, F.lit(True))
        .when(selector.contains("*"), F.regexp_like(rule_id, wildcard(selector)))
        .otherwise(F.lit(False))
    )


def resolve_rules(rules: DataFrame, policy: DataFrame, mode: str = "scan", only: list[str] | None = None, strict: bool = False) -> DataFrame:
    """The active rules with their final severity.

    rules: rule_id, severity, category, tags, confidence. scan takes the proven
    tier, audit the heuristic one, an explicit list both. Of matching policy
    rows the greatest ord wins; off takes the rule out, and strict makes what is
    left an error.
    """
    chosen = rules.where(F.col("rule_id").isin(*only)) if only else rules.where(F.col("confidence") == ("proven" if mode == "scan" else "heuristic"))
    p = policy.select(F.col("ord").alias("p_ord"), F.col("selector").alias("p_selector"), F.col("severity").alias("p_severity"))
    hit = matches(F.col("p_selector"), F.col("rule_id"), F.col("category"), F.col("tags"), F.col("confidence"))
    joined = chosen.join(p, hit, "left").groupBy("rule_id", "severity", "category", "tags", "confidence").agg(F.max_by("p_severity", "p_ord").alias("p"))
    final = F.coalesce("p", "severity")
    return joined.where(final != "off").select("rule_id", (F.lit("error") if strict else final).alias("severity"), "category", "tags", "confidence")


def glob_regex(glob: str) -> str:
    """A gitignore pattern as a regular expression on relative paths."""
    body = glob.rstrip()
    only_dir = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        if body[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif body[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            out, i = out + "[" + ("^" + body[i + 2 : end] if body[i + 1] in "!^" else body[i + 1 : end]).replace("\\", "\\\\") + "]", end + 1
        elif body[i] == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if only_dir else "(?:/.*)?$")


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last gitignore pattern that matches a relative path ignores it; ! takes back."""
    out = F.lit(False)
    for raw in patterns:
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        out = F.when(path.rlike(glob_regex(line[negated:])), F.lit(not negated)).otherwise(out)
    return out


def apply_overrides(diagnostics: DataFrame, overrides: list[tuple[int, str, str, str]], rules: DataFrame, rel_path: Column) -> DataFrame:
    """Severities by file: of the override rows (ord, glob, selector, severity) that match, the greatest ord wins; off drops.

    Paths outside the root (../) never match. Overrides come after strict and may
    lower an error.
    """
    if not overrides:
        return diagnostics
    meta = F.broadcast(rules.select(F.col("rule_id").alias("m_id"), "category", "tags", "confidence"))  # the rule catalogue: fixed size
    joined = diagnostics.join(meta, F.col("rule_id") == F.col("m_id"), "left")
    severity = F.col("severity")
    for _, glob, selector, new in sorted(overrides):
        hit = rel_path.rlike(glob_regex(glob)) & ~rel_path.startswith("..") & F.coalesce(matches(F.lit(selector), F.col("rule_id"), F.col("category"), F.col("tags"), F.col("confidence")), F.lit(False))
        severity = F.when(hit, F.lit(new)).otherwise(severity)
    return joined.withColumn("severity", severity).where("severity <> 'off'").select(*diagnostics.columns)


def apply_baseline(diagnostics: DataFrame, baseline: DataFrame) -> DataFrame:
    """Drops every (file, rule) group with no more rows than the baseline allows; larger groups stay whole."""
    allowed = baseline.select(F.col("file").alias("b_file"), F.col("rule_id").alias("b_rule"), "allowed")
    counted = diagnostics.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("file", "rule_id")))
    joined = counted.join(allowed, (F.col("file") == F.col("b_file")) & (F.col("rule_id") == F.col("b_rule")), "left")
    return joined.where(F.col("_n") > F.coalesce("allowed", F.lit(0))).select(*diagnostics.columns)


def make_baseline(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("file", "rule_id").agg(F.count(F.lit(1)).cast("int").alias("allowed"))


def visible(diagnostics: DataFrame, severities: list[str] | None) -> DataFrame:
    return diagnostics if not severities else diagnostics.where(F.col("severity").isin(*severities))


def severity_ord(severity: Column) -> Column:
    return F.when(severity == "error", 3).when(severity == "warning", 2).when(severity == "info", 1).otherwise(0)


def exit_code(top: Column, fail_on: str | Column) -> Column:
    """The exit code from the greatest severity_ord (null: no rows)."""
    top, on = F.coalesce(top, F.lit(0)), F.lit(fail_on) if isinstance(fail_on, str) else fail_on
    return (
        F.when(on == "none", 0)
        .when(top == 3, 2)
        .when((on == "error") | (top == 0), 0)
        .when((on == "warning") & (top == 1), 0)
        .otherwise(1)
    )


def dedupe(diagnostics: DataFrame, seq: str = "seq") -> DataFrame:
    """The first row by seq of each (file, line, rule_id); the column plays no part."""
    rest = [c for c in diagnostics.columns if c not in ("file", "line", "rule_id")]
    best = diagnostics.groupBy("file", "line", "rule_id").agg(F.min_by(F.struct(*rest), F.col(seq)).alias("r"))
    return best.select(*[F.col(c) if c in ("file", "line", "rule_id") else F.col(f"r.{c}").alias(c) for c in diagnostics.columns])


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
