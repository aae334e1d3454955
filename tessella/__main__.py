"""python -m tessella [scan|audit|baseline] [options] [paths ...]"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import relative_path
from tessella.operators import fixes
from tessella.plans import engine
from tessella.sources import sinks

COMMANDS = ("scan", "audit", "baseline")
BASELINE_FILE = "tessella.baseline.json"


def rule_pair(text: str) -> tuple[str, str]:
    """selector=severity; without an equals sign the last colon parts them."""
    selector, found, severity = text.partition("=") if "=" in text else text.rpartition(":")
    if not found or not selector or not severity:
        raise ValueError(f"not selector=severity: {text!r}")
    return selector.strip(), severity.strip()


def many(values: list[str]) -> list[str]:
    return [x.strip() for v in values for x in v.split(",") if x.strip()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessella")
    p.add_argument("paths", nargs="*")
    p.add_argument("--strict", action="store_true", help="every active rule is an error")
    p.add_argument("--filter", help="one rule only")
    p.add_argument("--fix", action="store_true", help="apply edits in place")
    p.add_argument("--format", choices=("grouped", "flat", "json"), default="grouped")
    p.add_argument("--severity", action="append", default=[], help="show these only")
    p.add_argument("--ignore", action="append", default=[])
    p.add_argument("--rule", action="append", default=[], metavar="SELECTOR=SEVERITY")
    p.add_argument("--config")
    p.add_argument("--fail-on", choices=("none", "info", "warning", "error"))
    p.add_argument("--concurrency", type=int, help="local threads of the session")
    p.add_argument("--no-baseline", action="store_true")
    p.add_argument("--no-cache", action="store_true", help="extract the facts of every file anew")
    p.add_argument("--version", action="version", version=engine.VERSION)
    p.add_argument("--root", default=os.getcwd())
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = list(sys.argv[1:] if argv is None else argv)
    command = args.pop(0) if args and args[0] in COMMANDS else "scan"
    try:
        a = parser().parse_args(args)
        options = engine.ScanOptions(
            paths=a.paths or ["."], mode="audit" if command == "audit" else "scan", strict=a.strict, rules=[a.filter] if a.filter else None, ignore=many(a.ignore),
            rule_policy=[rule_pair(r) for r in a.rule], show_severities=many(a.severity) or None, fail_on=a.fail_on or "info", cache=not a.no_cache,
        ).check()
        engine.read_config(a.root, a.config)
    except SystemExit as e:
        return 0 if e.code == 0 else 1
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.master(f"local[{a.concurrency or '*'}]").config("spark.ui.enabled", "false").getOrCreate()
    root, kept = os.path.abspath(a.root), os.path.join(os.path.abspath(a.root), BASELINE_FILE)
    if command == "scan" and not a.no_baseline and os.path.exists(kept):
        options = engine.replace(options, baseline=engine.read_baseline(spark, kept))
    result = engine.execute(spark, root, options, a.config)
    for w in result.warnings:
        print(w, file=sys.stderr)
    if command == "baseline":
        n = engine.write_baseline(result, kept, root)
        print(f"{n} groups in {BASELINE_FILE}")
        return 0
    visible, code, fixed = result.visible, result.exit_code, None
    if a.fix:
        fixed = write_fixes(spark, visible)
        result = engine.execute(spark, root, options, a.config)
        visible, code = result.visible, result.exit_code
    shown = visible.withColumn("file", relative_path(F.col("file"), root))
    if a.format == "json":
        print(sinks.json_report(shown, result.file_count, code, fixed))
    elif a.format == "flat":
        for r in shown.orderBy("file", "line", "col", "rule_id").select(sinks.flat_text(F.col("file")).alias("v")).toLocalIterator():
            print(r["v"])
    else:
        print(sinks.grouped_text(shown))
        for r in sinks.summary(shown).toLocalIterator():
            print(f"{r['n']:6} {r['rule_id']}")
    result.close()
    return code


def write_fixes(spark: SparkSession, diagnostics) -> int:
    """Writes every file with edits; returns the number of edits. Runs where the files are, on one machine."""
    edited = diagnostics.where("fix is not null")
    paths = [r["file"] for r in edited.select("file").distinct().toLocalIterator()]
    if not paths:
        return 0
    texts = []
    for p in paths:
        with open(p, encoding="utf-8", newline="") as f:
            texts.append((p, f.read()))
    total = 0
    for r in fixes.apply_fixes(spark.createDataFrame(texts, "file string, source string"), edited).toLocalIterator():
        with open(r["file"], "w", encoding="utf-8", newline="") as f:
            f.write(r["source"])
        total += r["applied"]
    return total


if __name__ == "__main__":
    sys.exit(main())
