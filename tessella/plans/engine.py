"""From options to diagnostics: the scan lifecycle as one plan."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import schema
from tessella.extract.facts import fact_tables, raw_facts
from tessella.functions.text import relative_path
from tessella.operators import annotate, policy, rules_node
from tessella.operators.catalogue import all_rules, rules_table
from tessella.sources.files import files_table, merged_options, packages, place, project_configs, read_sources, scanned_paths
from tessella.streaming import incremental

VERSION = "0.2"
#: Below the root: the snapshots of facts that make scans of unchanged files cheap.
CACHE_FOLDER = ".tessella-cache"
CONFIG_NAMES = ("tessella.config.json", ".tessellarc.json")


@dataclass(frozen=True)
class ScanOptions:
    """What to scan and how; field defaults are the defaults of the options.

    concurrency is not one of them: parallelism is the session's. rule_policy is
    an ordered list of (selector, severity) or a mapping; overrides a list of
    {"files": [globs], "rules": policy}.
    """

    paths: list[str] = field(default_factory=lambda: ["."])
    mode: str = "scan"
    strict: bool = False
    rules: list[str] | None = None
    ignore: list[str] = field(default_factory=list)
    rule_policy: list[tuple[str, str]] | dict[str, str] = field(default_factory=list)
    overrides: list[dict] = field(default_factory=list)
    show_severities: list[str] | None = None
    fail_on: str = "info"
    use_gitignore: bool = True
    cache: bool = True
    baseline: DataFrame | None = None
    group_options: DataFrame | None = None

    def check(self) -> ScanOptions:
        bad = [s for _, s in _pairs(self.rule_policy) if s not in (*schema.SEVERITIES, "off")]
        if bad:
            raise ValueError(f"unknown severity {bad[0]!r}")
        if self.fail_on not in (*schema.SEVERITIES, "none") or self.mode not in ("scan", "audit"):
            raise ValueError("fail_on is one of none, info, warning, error and mode one of scan, audit")
        for r in self.rules or []:
            if r not in all_rules():
                raise ValueError(f"unknown rule {r!r}")
        return self


@dataclass
class ScanResult:
    """diagnostics are raw; visible ones have overrides, baseline and the severity filter applied.

    warnings are for people. read is the number of files whose facts were extracted
    anew. close() frees the tables that the scan cached, when its rows are no longer
    needed.
    """

    diagnostics: DataFrame
    visible: DataFrame
    effective: DataFrame
    file_count: int
    exit_code: int
    warnings: list[str] = field(default_factory=list)
    read: int | None = None
    held: list[DataFrame] = field(default_factory=list)

    def close(self) -> None:
        for df in self.held:
            df.unpersist()


def _pairs(p: list | dict) -> list[tuple[str, str]]:
    return list(p.items()) if isinstance(p, dict) else [tuple(x) for x in p]


def read_config(root: str, path: str | None = None) -> dict:
    """The JSON configuration named, or the first of CONFIG_NAMES in root; {} if there is none. Known keys are checked, others are let be."""
    names = [path] if path else [os.path.join(root, n) for n in CONFIG_NAMES]
    for name in names:
        if not os.path.exists(name):
            continue
        with open(name, encoding="utf-8") as f:
            data = json.load(f)
        if not isinstance(data, dict):
            raise ValueError("the configuration is no object")
        kinds = {"paths": list, "ignore": list, "rules": (dict, list), "overrides": list, "failOn": str, "severity": list, "cache": bool}
        for k, kind in kinds.items():
            if k in data and not isinstance(data[k], kind):
                raise ValueError(f"configuration key {k} has the wrong type")
        return data
    if path:
        raise FileNotFoundError(path)
    return {}


def with_config(options: ScanOptions, config: dict) -> ScanOptions:
    """options on top of a configuration: given paths replace, ignores add up, given policies come after and so win. An audit takes no failOn from it."""
    rules = config.get("rules", {})
    default = ScanOptions()
    return replace(
        options,
        paths=options.paths if options.paths != default.paths else config.get("paths", default.paths),
        ignore=[*config.get("ignore", []), *options.ignore], rule_policy=[*_pairs(rules), *_pairs(options.rule_policy)], overrides=[*config.get("overrides", []), *options.overrides],
        fail_on=options.fail_on if options.fail_on != default.fail_on or options.mode == "audit" else config.get("failOn", default.fail_on),
        show_severities=options.show_severities or config.get("severity"), cache=options.cache and config.get("cache", True),
    )


def active_rules(spark: SparkSession, options: ScanOptions) -> dict[str, str]:
    """Final severity by rule id; the catalogue is 52 rows, so it is settled on the driver."""
    p = spark.createDataFrame([(i, s, v) for i, (s, v) in enumerate(_pairs(options.rule_policy))], policy.POLICY)
    return {r["rule_id"]: r["severity"] for r in policy.resolve_rules(rules_table(spark), p, options.mode, options.rules, options.strict).collect()}


def needed_tables(rule_ids: list[str]) -> list[str]:
    """The fact tables that the rules read; comments always, for annotations."""
    out = {"comments"}
    for r in rule_ids:
        out |= set(all_rules()[r].needs)
    if "call_sites" in out or "unused-export" in rule_ids:
        out |= {"functions", "imports"}
    return [t for t in schema.TABLES if t in out]


def run_rules(facts: dict[str, DataFrame], severities: dict[str, str], group_options: DataFrame | None = None) -> DataFrame:
    """Diagnostics of the active rules with their order in seq: all node rules in one scan, then each rule on its own.

    A rule whose tables are missing is left out.
    """
    catalogue = all_rules()
    node = [r for r in severities if r in rules_node.NODE_RULES]
    parts = []
    if node and "expr_facts" in facts:
        parts.append(rules_node.fused(facts["expr_facts"], node, group_options))
    more = facts if group_options is None else facts | {"group_options": group_options}
    for r in severities:
        rule = catalogue[r]
        if r not in node and all(t in facts for t in rule.needs):
            parts.append(rule.run(more))
    if not parts:
        spark = next(iter(facts.values())).sparkSession
        return spark.createDataFrame([], schema.DIAGNOSTICS + ", seq string")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = F.create_map(*[F.lit(x) for i, r in enumerate(catalogue) for x in (r, i)])
    final = F.create_map(*[F.lit(x) for kv in severities.items() for x in kv])
    seq = F.struct(order[F.col("rule_id")].alias("rule"), F.col("line"), F.col("col"), F.col("message"))
    return found.withColumns({"severity": final[F.col("rule_id")], "seq": seq})


def finish(found: DataFrame, facts: dict[str, DataFrame], keyword: str = annotate.KEYWORD) -> DataFrame:
    """Reportable rows, suppressed and annotated by comments, one per (file, line, rule)."""
    ok = facts["files"].where("reportable").select("file").distinct()
    kept = annotate.suppress(found.join(ok, "file", "left_semi").select(*found.columns), facts["comments"], keyword)
    return policy.dedupe(annotate.attach(kept, facts["comments"], keyword)).drop("seq")


def settle(diagnostics: DataFrame, options: ScanOptions, root: str, file_count: int) -> ScanResult:
    """Overrides, baseline (not in an audit), the visible rows, and the exit code, which the severity filter doesn't touch."""
    spark = diagnostics.sparkSession
    rows = [(i, glob, s, v) for i, (glob, s, v) in enumerate((g, s, v) for o in options.overrides for g in o["files"] for s, v in _pairs(o["rules"]))]
    effective = policy.apply_overrides(diagnostics, rows, rules_table(spark), relative_path(F.col("file"), root))
    if options.baseline is not None and options.mode == "scan":
        relative = effective.withColumns({"_abs": F.col("file"), "file": relative_path(F.col("file"), root)})
        effective = policy.apply_baseline(relative, options.baseline).withColumn("file", F.col("_abs")).drop("_abs")
    top = effective.agg(F.max(policy.severity_ord(F.col("severity"))).alias("top")).select(policy.exit_code(F.col("top"), options.fail_on).alias("c")).first()["c"]
    return ScanResult(diagnostics, policy.visible(effective, options.show_severities), effective, file_count, int(top))


def fresh(df: DataFrame) -> DataFrame:
    """df cached anew: an equal plan that an earlier scan cached, of files that may have changed since, is dropped first."""
    df.unpersist()
    return df.cache()


def scan_sources(spark: SparkSession, sources: DataFrame, options: ScanOptions, root: str = "/", scanned: DataFrame | None = None, extra: dict[str, DataFrame] | None = None, cache: str | None = None) -> ScanResult:
    """Runs the active rules on a table of sources (file, source; optionally group_id and package_root).

    scanned (file) says which files may be reported, the others are context. cache
    is a folder of fact snapshots: files that are there as they are now are not
    extracted again.

    extra holds fact tables from outside, such as typed expr_facts: they are added
    to the extracted rows, or replace call_sites and overloads.
    """
    severities = active_rules(spark, options.check())
    files = fresh(files_table(sources, scanned))
    needs, read = needed_tables(list(severities)), None
    if cache is None:
        raw = fresh(raw_facts(files, needs))
    else:
        raw, read = incremental.refresh(spark, files, cache, incremental.cache_key(VERSION, {}, {"needs": needs}), needs)
        raw = fresh(raw)
    facts = fact_tables(raw, files)
    for name, table in (extra or {}).items():
        facts[name] = facts[name].unionByName(table) if name == "expr_facts" and name in facts else table
    found = finish(run_rules(facts, severities, options.group_options), facts)
    result = settle(found, options, root, files.where("reportable").count())
    return replace(result, warnings=loose_groups(severities, options.group_options), read=read, held=[files, raw])


def loose_groups(severities: dict[str, str], group_options: DataFrame | None) -> list[str]:
    """A warning for every group in which active rules are silent because null checks are off."""
    rules = [r for r in severities if all_rules()[r].strict_null]
    if not rules or group_options is None:
        return []
    loose = group_options.where(~F.coalesce("strict_null_checks", F.lit(True))).select("group_id").orderBy("group_id")
    return [f"strictNullChecks is off in {r['group_id'] or 'the default group'}: {len(rules)} rules report nothing there" for r in loose.toLocalIterator()]


def execute(spark: SparkSession, root: str, options: ScanOptions | None = None, config_path: str | None = None, extra: dict[str, DataFrame] | None = None) -> ScanResult:
    """Scans the source files below root under its configuration file and the given options.

    Files are grouped by the nearest compiler configuration above them, and its
    null-check options apply to the group unless options.group_options is given.
    options.paths and the ignores say which files are reported; every other source
    file below root is context for the rules that compare files. With
    options.cache, facts are kept in CACHE_FOLDER.
    """
    options = with_config(options or ScanOptions(), read_config(root, config_path)).check()
    lines: list[str] = []
    if options.use_gitignore and os.path.exists(os.path.join(root, ".gitignore")):
        with open(os.path.join(root, ".gitignore"), encoding="utf-8") as f:
            lines = f.read().splitlines()
    configs = fresh(project_configs(spark, root))
    sources = place(read_sources(spark, root), configs, packages(spark, root))
    scanned = scanned_paths(spark, root, options.paths, options.ignore, lines)
    if options.group_options is None and not configs.isEmpty():
        options = replace(options, group_options=merged_options(configs))
    result = scan_sources(spark, sources, options, root, scanned, extra, f"{root.rstrip('/')}/{CACHE_FOLDER}" if options.cache else None)
    result.held.append(configs)
    return result


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """A JSON baseline {file: {rule: count}} as rows (file, rule_id, allowed)."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if not isinstance(data, dict) or not all(isinstance(v, dict) and all(isinstance(n, int) and not isinstance(n, bool) and n >= 0 for n in v.values()) for v in data.values()):
        raise ValueError("a baseline maps files to rules to counts")
    return spark.createDataFrame([(f, r, n) for f, v in data.items() for r, n in v.items()], policy.BASELINE)


def write_baseline(result: ScanResult, path: str, root: str) -> int:
    """Writes the visible rows' counts as a JSON baseline; returns the number of (file, rule) groups."""
    counts: dict[str, dict[str, int]] = {}
    made = policy.make_baseline(result.visible.withColumn("file", relative_path(F.col("file"), root)))
    for r in made.orderBy("file", "rule_id").toLocalIterator():
        counts.setdefault(r["file"], {})[r["rule_id"]] = r["allowed"]
    with open(path, "w", encoding="utf-8") as f:
        json.dump(counts, f, indent=2, ensure_ascii=False)
    return sum(map(len, counts.values()))
