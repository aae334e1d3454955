from __future__ import annotations

import json

import pytest

from tessella.__main__ import main, rule_pair


@pytest.fixture
def project(tmp_path):
    for p in ("a", "b"):
        (tmp_path / p).mkdir()
        (tmp_path / p / "package.json").write_text("{}")
        (tmp_path / p / "tsconfig.json").write_text('{ // why\n "compilerOptions": { "strict": true, "target": "' + p + '", }, }')
        (tmp_path / p / "one.ts").write_text("export function run(x) { const y = go(x); stop(y); return y; }\nconst v = f() as any;\n")
    return tmp_path


def test_formats_baseline_and_codes(spark, project, capsys):
    root = ["--root", str(project)]
    assert main(["scan", "--format", "json", *root], spark) == 2
    report = json.loads(capsys.readouterr().out)
    assert report["fileCount"] == 2 and report["exitCode"] == 2 and [d["file"] for d in report["diagnostics"]] == ["a/one.ts", "b/one.ts"]
    assert main(["--format", "flat", "--rule", "no-any-cast:info", "--fail-on", "warning", "a", *root], spark) == 0
    assert capsys.readouterr().out.splitlines() == ["a/one.ts:2:11 info [no-any-cast] Cast to any"]
    assert main(["baseline", *root], spark) == 0 and json.loads((project / "tessella.baseline.json").read_text())["a/one.ts"] == {"no-any-cast": 1}
    assert main(root, spark) == 0
    assert main(["--no-baseline", "--severity", "info", *root], spark) == 2


def test_groups_and_packages_keep_duplicates_apart(spark, project):
    from tessella.plans import engine

    r = engine.execute(spark, str(project), engine.ScanOptions(rules=["duplicate-file", "duplicate-function-declaration"]))
    assert r.visible.count() == 0  # two configurations that differ are two groups
    (project / "b" / "tsconfig.json").write_text((project / "a" / "tsconfig.json").read_text())
    r = engine.execute(spark, str(project), engine.ScanOptions(rules=["duplicate-file", "duplicate-function-name"]))
    assert {x["rule_id"] for x in r.visible.collect()} == {"duplicate-file"}


def test_wrong_arguments():
    assert main(["--rule", "nothing"]) == 1 and main(["--filter", "no-such-rule"]) == 1 and main(["--format", "xml"]) == 1 and main(["--help"]) == 0
    assert rule_pair("category:imports=off") == ("category:imports", "off") and rule_pair("tag:safety:info") == ("tag:safety", "info")


def test_one_file_is_reported_against_the_whole_project(spark, project):
    from tessella.plans import engine

    (project / "a" / "two.ts").write_text("import { run } from './one';\nexport function idle() { return 1; }\nrun(1);\n")
    scan = lambda *paths: {(x["file"].removeprefix(str(project)), x["line"]) for x in engine.execute(spark, str(project), engine.ScanOptions(paths=list(paths), rules=["unused-export"])).visible.collect()}
    assert scan("a/one.ts") == set()  # two.ts imports it, though it isn't scanned
    assert scan("a/two.ts") == {("/a/two.ts", 2)} and scan("b") == {("/b/one.ts", 1)}


def test_unchanged_files_are_not_extracted_again(spark, project):
    from tessella.plans import engine

    go = lambda **o: engine.execute(spark, str(project), engine.ScanOptions(rules=["no-any-cast"], **o))
    assert go().read == 2 and go().read == 0
    (project / "b" / "one.ts").write_text("const w = 1 as any;\n")
    r = go()
    assert r.read == 1 and {(x["file"].removeprefix(str(project)), x["line"]) for x in r.visible.collect()} == {("/a/one.ts", 2), ("/b/one.ts", 1)}
    r.close()
    assert go(cache=False).read is None


def test_extended_configurations_and_loose_groups(spark, project):
    from tessella.plans import engine

    (project / "tsconfig.base.json").write_text('{"compilerOptions": {"strict": true, "target": "es2022"}}')
    (project / "a" / "tsconfig.json").write_text('{"extends": "../tsconfig.base", "compilerOptions": {"strictNullChecks": false}}')
    (project / "b" / "tsconfig.json").write_text('{"extends": ["../tsconfig.base.json"]}')
    r = engine.execute(spark, str(project), engine.ScanOptions(rules=["no-non-null-assertion", "duplicate-file"]))
    assert len(r.warnings) == 1 and r.warnings[0].startswith("strictNullChecks is off in") and "/a" in r.warnings[0]
    from tessella.sources.files import project_configs

    got = {x["folder"].rsplit("/", 1)[1]: (x["strict_null_checks"], json.loads(x["options_key"])["target"]) for x in project_configs(spark, str(project)).collect()}
    assert got == {"a": (False, "es2022"), "b": (True, "es2022")}


def test_bodies_of_excluded_files_are_not_read(spark, project):
    from tessella.sources.files import read_sources

    (project / "node_modules").mkdir()
    (project / "node_modules" / "big.ts").write_bytes(b"x" * 5_000_000)
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000000")
    try:
        assert read_sources(spark, str(project)).select("file", "source").collect().__len__() == 2
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)


def test_the_version_is_told(capsys):
    assert main(["--version"]) == 0 and capsys.readouterr().out.strip()
