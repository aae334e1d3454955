"""Queries on tables of shapes that only larger data has."""

from __future__ import annotations

import random

import __spark_entry__ as entry


def sql_rows(tables: dict[str, str], name: str) -> list[tuple]:
    import duckdb

    con = duckdb.connect()
    for t, path in tables.items():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    return sorted(tuple(str(v) for _, v in sorted(zip(names, r, strict=True))) for r in cur.fetchall())


def spark_rows(df) -> list[tuple]:
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


def written(spark, folder, **tables) -> dict[str, str]:
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return {name: f"{folder}/{name}.parquet/*.parquet" for name in tables}


def test_heritage_of_long_chains(spark, tmp_path):
    """A customer of 130 orders, one of one, one of two and orders without a customer."""
    keys = [(i, 1) for i in range(130)] + [(500, 2), (501, 3), (503, 3), (600, None), (601, None)]
    random.Random(1).shuffle(keys)
    at = written(spark, tmp_path, orders=spark.createDataFrame(keys, "o_orderkey long, o_custkey long"))
    got = spark_rows(entry.queries()["heritage"](spark, str(tmp_path)))
    assert got == sql_rows(at, "heritage") and len(got) == 130 * 129 // 2 + 1


def test_heritage_of_cycles_and_a_depth(spark):
    from tessella.operators.rules_node import heritage

    ring = spark.createDataFrame([(i, (i + 1) % 7) for i in range(7)] + [(9, 9), (10, 0), (11, None)], "child int, parent int")
    assert sorted(map(tuple, heritage(ring, depth=None).collect())) == sorted([(a, b) for a in [*range(7), 10] for b in range(7)] + [(9, 9)])
    chain = spark.createDataFrame([(i, i + 1) for i in range(90)], "child int, parent int")
    assert sorted(map(tuple, heritage(chain).collect())) == sorted((a, b) for a in range(91) for b in range(a + 1, min(a + 50, 90) + 1))
    assert heritage(ring.where("child > 90")).count() == 0


def test_rows_do_not_meet_by_their_group(spark):
    """A table of three groups must not be shuffled by group: three tasks would read it all."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan(entry.queries()["node_rules"](spark, "/root/testdata/sf0.001"))
    from tessella.operators.catalogue import all_rules
    from tessella.plans.rule_tables import node_facts, related_facts

    facts = related_facts(spark, "/root/testdata/sf0.001") | {"group_options": node_facts(spark, "/root/testdata/sf0.001")[1]}
    assert "hashpartitioning(group_id#" not in "\n".join(x for x in plan(all_rules()["return-type-widens-via-destructure"].run(facts)).split("\n") if "file" not in x)


def test_unlinked_collisions_and_their_partitions(spark, tmp_path):
    """Shared parts, a part twice in one order, no customer; partitions follow the files' size and nothing is counted distinct."""
    orders = spark.createDataFrame([(1, 7, "a"), (2, 7, "a"), (3, 8, "a"), (4, 8, "a"), (5, 8, "b"), (6, None, "a"), (7, None, "a"), (8, 9, "a")], "o_orderkey long, o_custkey long, o_orderpriority string")
    lines = spark.createDataFrame([(1, 70), (2, 70), (3, 71), (3, 71), (4, 72), (5, 71), (6, 73), (7, 73), (8, 1), (8, 1)], "l_orderkey long, l_partkey long")
    at = written(spark, tmp_path, orders=orders, lineitem=lines)
    df = entry.queries()["name_collision_unlinked"](spark, str(tmp_path))
    assert spark_rows(df) == sql_rows(at, "name_collision_unlinked")
    assert "distinct" not in df._jdf.queryExecution().executedPlan().toString().lower()
    from tessella.plans import tables

    big = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    assert tables._pieces(big, 1) > 8 > tables._pieces(big, 1024) == 4


def test_long_runs_are_not_hashed_statement_by_statement(spark):
    from tessella.operators.runs import maximal_runs

    df = spark.range(600).selectExpr("'g' AS group_id", "cast(id div 300 as int) AS block_id", "cast(id % 300 as int) AS pos", "concat('s', id % 300) AS hash", "cast(9 as int) AS norm_len")
    found = maximal_runs(df)
    assert "slice(" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r["length"], [tuple(p) for p in r["participants"]]) for r in found.collect()] == [(300, [(0, 0), (1, 0)])]
