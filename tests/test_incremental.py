from __future__ import annotations

from tessella.sources.files import files_table
from tessella.streaming import incremental

V1 = [("/a.ts", "const a = 1;"), ("/b.ts", "const b = 2;"), ("/c.ts", "const c = 3;")]


def files(spark, rows):
    return files_table(spark.createDataFrame(rows, "file string, source string"))


def test_only_changed_files_are_read_again(spark, tmp_path):
    path = str(tmp_path)
    facts, n = incremental.refresh(spark, files(spark, V1), path, "k", ["constants"])
    assert n == 3 and facts.count() == 3
    _, n = incremental.refresh(spark, files(spark, V1), path, "k", ["constants"])
    assert n == 0
    v2 = [V1[0], ("/b.ts", "const b = 22;"), ("/d.ts", "const d = 4;")]
    facts, n = incremental.refresh(spark, files(spark, v2), path, "k", ["constants"])
    assert n == 2
    assert {r["file"]: r["constants"][0]["value_text"] for r in facts.collect()} == {"/a.ts": "1", "/b.ts": "22", "/d.ts": "4"}
    _, n = incremental.refresh(spark, files(spark, v2), path, "other", ["constants"])
    assert n == 3


def test_stream_of_files(spark, tmp_path):
    schema = "group_id string, file string, source string"
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    seen = []

    def push(rows):
        spark.createDataFrame([("", f, s) for f, s in rows], schema).coalesce(1).write.mode("append").parquet(src)
        q = incremental.watch(spark.readStream.schema(schema).parquet(src), out, f"{tmp_path}/ck", lambda d, n: seen.append(sorted(r["file"] for r in d.collect()))).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    push(V1)
    push([V1[0], ("/b.ts", "changed")])
    push([("/b.ts", "changed")])
    assert [s for s in seen if s] == [["/a.ts", "/b.ts", "/c.ts"], ["/b.ts"]]
