"""The stages of the corpus pipeline, each on the result of the one before, and run() over all."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tessella.llm import decontam, langid, mixing, neardup
from tests.llm import data
from tests.llm.test_decontam import slow


def _tables(spark, folder, rows, bench):
    data.documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_take_effect_in_order(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "mix_sources"]
    rng = random.Random(2)
    words = lambda n: [rng.choice(data.WORDS["en"]) + str(rng.choice(["", "s", "ed", "ing"])) for _ in range(n)]
    text = lambda n: "\n".join(" ".join(words(10)) for _ in range(n // 10))
    rows = [(i, text(150), "en", "a" if i % 2 else "b") for i in range(60)]
    item = " ".join(words(40))
    junk = "".join(rng.choice("qxzjkwvyq ") for _ in range(900))
    near = rows[4][1].replace("\n", " ").split()
    near[10] = near[70] = "zebra"
    rows += [(100, junk, "en", "a"), (101, rows[3][1], "en", "a"), (102, " ".join(near), "en", "b"), (103, text(100) + "\n" + item + "\n" + text(100), "en", "a"), (104, None, "en", "a"), (105, "", "en", "a")]
    folder = _tables(spark, tmp_path, rows, [(1, item), (2, None)])
    docs, left = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/stage-{name}")
        docs = spark.read.parquet(f"{tmp_path}/stage-{name}")
        if k < 4:
            assert docs.columns == columns
            left.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    clean = set(range(60))
    assert left[0] == clean | {101, 102, 103}
    assert left[1] == clean | {102, 103}  # 101 holds only lines of document 3
    assert left[2] == clean | {103}  # 102 is a near copy of 4
    assert left[3] == clean
    assert docs.columns == [*columns, "copy", "shuffle_key"]
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))
    last = spark.read.parquet(f"{tmp_path}/stage-decontaminate")
    assert sorted(r["doc_id"] for r in whole.collect()) == sorted(r["doc_id"] for r in mixing.mix(last).collect())


def _brute(rows: list[tuple], bench: list[str], model) -> list[tuple]:
    """(doc_id, text, copy) of the pipeline over rows of (doc_id, text, source), each stage by the slowest means."""
    # 1: n-grams of letters, looked up one by one.
    kept = []
    for i, text, source in rows:
        raw = (" " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " ").encode()
        hits, total = [0.0] * len(model.languages), 0
        for k, n in enumerate(langid.ORDERS):
            here = [int.from_bytes(raw[j : j + n], "little") for j in range(len(raw) - n + 1)]
            total += len(here)
            slots = langid.slots(np.array(here, np.uint64), model.bits[k])
            for l in range(len(model.languages)):
                seen = sum(all(model.planes[k][l // 8][s[j]] >> (l % 8) & 1 for s in slots) for j in range(len(here)))
                rate = model.false_rates[k, l]
                hits[l] += max(0, (seen - len(here) * rate) / (1 - rate))
        if max(hits) / max(total, 1) >= model.min_rate:
            kept.append((i, text, source))
    # 2: a set of lines seen.
    seen, second = set(), []
    for i, text, source in sorted(kept):
        lines = [x for x in text.split("\n") if not x.strip() or x.strip() not in seen]
        seen |= {x.strip() for x in text.split("\n")}
        if any(x.strip() for x in lines) or len(lines) == len(text.split("\n")):
            second.append((i, "\n".join(lines), source))
    # 3: exact similarity of word pairs, all with all.
    pairs = {}
    for i, text, _ in second:
        w = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        pairs[i] = set(zip(w, w[1:], strict=False))
    group = {i: i for i in pairs}
    for i in pairs:
        for j in pairs:
            if i < j and len(pairs[i] & pairs[j]) >= 0.5 * len(pairs[i] | pairs[j]):
                a, b = group[i], group[j]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    third = [r for r in second if group[r[0]] == r[0]]
    # 4: the whole edit distance table.
    norm = [decontam.normalise(t) for t in bench]
    fourth = [r for r in third if not any(slow(t, b" " + decontam.normalise(r[1]) + b" ") <= len(t) // 10 for t in norm)]
    # 5: the distribution function step by step.
    mass = {}
    for _, text, source in fourth:
        mass[source] = mass.get(source, 0) + len(text)
    weight = {s: m**0.7 for s, m in mass.items()}
    out = []
    for i, text, source in fourth:
        digest = hashlib.md5(text.encode()).hexdigest()
        u = int(hashlib.md5(f"mix-1|{i}|{digest}".encode()).hexdigest()[:13], 16) / 2**52
        rate = weight[source] / sum(weight.values()) * sum(mass.values()) / mass[source]
        n, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            n += 1
            p *= rate / n
            c += p
        out += [(i, text, k) for k in range(1, n + 1)]
    return sorted(out)


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(11)
    words = lambda n: [rng.choice(data.WORDS["en"]) + rng.choice(["", "s", "ed", "ing", "er"]) for _ in range(n)]
    text = lambda n: "\n".join(" ".join(words(9)) for _ in range(n // 9))
    bench = [" ".join(words(rng.randint(12, 30))) for _ in range(5)]
    rows = [(i, text(rng.randint(60, 140)), rng.choice("abc")) for i in range(40)]
    for k in range(12):
        base = rows[k][1]
        near = base.replace("\n", " ").split(" ")
        near[5] = near[-5] = "zebra"
        edited = list(bench[k % 5])
        edited[len(edited) // 2] = "x"
        rows.append((100 + k, [base, " ".join(near), text(60) + "\n" + base.split("\n")[0], text(40) + " " + "".join(edited) + " " + text(30), "".join(rng.choice("qxzjkwvyq ") for _ in range(300))][k % 5], rng.choice("abc")))
    folder = _tables(spark, tmp_path, [(i, t, "en", s) for i, t, s in rows], list(enumerate(bench)))
    got = sorted((r["doc_id"], r["text"], r["copy"]) for r in corpus_pipeline.run(spark, folder).collect())
    model = langid.train(spark.read.parquet(f"{folder}/documents.parquet"))
    assert got == _brute(rows, bench, model)
    left = {i for i, *_ in got}
    assert not left & {100, 101, 103, 104} and len(left) > 15


def test_awkward_rows_and_empty_tables(spark, tmp_path):
    folder = _tables(spark, tmp_path / "a", data.awkward_rows(), [(1, None), (None, "")])
    docs = data.with_clashes(spark.read.parquet(f"{folder}/documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "mix_sources":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/w-{name}")
        docs = spark.read.parquet(f"{tmp_path}/w-{name}") if name != "mix_sources" else docs
    empty = _tables(spark, tmp_path / "b", [], [])
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    q = entry.queries()
    assert {k.split("_")[0] for k in q if k.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in q
    assert set(entry.oracle_sql()) <= set(q)


def test_short_remains_of_texts_are_found_by_a_cheap_search():
    """What line de-duplication leaves of copies is short, so most places of its sketch are empty; the search of stage 3 must not widen for that as the table grows."""
    rng = np.random.default_rng(4)
    words = rng.integers(0, 50_000, (40_000, 20))
    edited = words[:400].copy()
    edited[:, 7] = rng.integers(50_000, 60_000, 400)  # 17 of 21 word pairs stay the same
    texts = neardup.tv.as_array(pa.array([" ".join(f"w{w}" for w in t) for t in np.concatenate([words, edited])]))
    h, rows = neardup.shingles(texts)
    codes, marks = neardup.simhashes(h, rows, len(texts)), neardup.sketches(h, rows, len(texts))
    shard = neardup.Shard(np.arange(40_000), codes[:40_000], marks[:40_000])
    none, nothing = np.full(400, -1), tuple(np.zeros(0, np.int64) for _ in range(3))
    most = len(shard.links(codes[40_000:], marks[40_000:], none, None)[0])
    settings = shard.settle(codes[:0], marks[:0], none[:0], nothing, 0.95)
    assert most > 350 and 2 * settings[1] * neardup.BYTES <= 256
    assert len(shard.links(codes[40_000:], marks[40_000:], none, settings)[0]) >= 0.95 * most
