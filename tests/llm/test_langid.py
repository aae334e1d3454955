from __future__ import annotations

import numpy as np
import pyarrow as pa

from tessella.llm import langid
from tessella.llm import textvec as tv
from tests.llm import data


def _train(spark, **options):
    rows = [(i, data.prose(l, 150, i), l, "s") for i, l in enumerate(["en", "de", "fr"] * 12)]
    return langid.train(data.documents(spark, rows), min_count=2, **options)


def test_filter_has_no_false_negatives_and_the_stated_false_rate():
    rng = np.random.default_rng(3)
    found = {(l, n): rng.integers(0, 1 << 40, 30_000).astype(np.uint64) for l in range(10) for n in langid.ORDERS}
    model = langid.build([f"l{i}" for i in range(10)], found, 0.3)
    other = rng.integers(1 << 41, 1 << 42, 50_000).astype(np.uint64)
    for k, n in enumerate(langid.ORDERS):
        for l in range(10):
            plane, bit = model.planes[k][l // 8], np.uint8(1 << l % 8)
            inside = lambda g: np.logical_and.reduce([(plane[s] & bit) > 0 for s in langid.slots(g)])  # noqa: B023, E731
            assert inside(found[l, n]).all()
            assert abs(inside(other).mean() - model.false_rates[k, l]) < 0.01


def test_scores_equal_a_slow_count():
    rng = np.random.default_rng(1)
    texts = ["ab cd ef", "", None, "Über straße 12 x", "zzzz " * 20]
    found = {}
    for l in range(2):
        for n in langid.ORDERS:
            buf, off = tv.normalised(tv.as_array(pa.array(texts)), tv.LETTERS)
            g = langid.grams(buf, off, n)[0]
            found[l, n] = rng.choice(g, len(g) // 2, replace=False)
    model = langid.build(["p", "q"], found, 0.3)
    share, total = langid.scores(model, tv.as_array(pa.array(texts)))
    for row, text in enumerate(texts):
        norm = " " + " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()) + " " if (text or "").strip() else " "
        raw = norm.encode()
        want, count = np.zeros(2), 0
        for k, n in enumerate(langid.ORDERS):
            here = [int.from_bytes(raw[i : i + n], "little") for i in range(len(raw) - n + 1)]
            count += len(here)
            for l in range(2):
                slots = [langid.slots(np.array([x], np.uint64)) for x in here]
                seen = sum(all(model.planes[k][0][s[0]] >> l & 1 for s in both) for both in slots)
                rate = model.false_rates[k, l]
                want[l] += max(0, (seen - len(here) * rate) / (1 - rate))
        assert total[row] == count
        assert np.allclose(share[row], want / max(count, 1))


def test_held_out_accuracy_and_rejection(spark):
    model = _train(spark)
    rows = [(i, data.prose(l, 60, 1000 + i), l, "s") for i, l in enumerate(["en", "de", "fr"] * 20)]
    junk = [(500 + i, "".join(np.random.default_rng(i).choice(list("qxzjkwvyq "), 400)), "en", "s") for i in range(10)]
    docs = data.documents(spark, rows + junk)
    got = {r["doc_id"]: r["l"] for r in docs.select("doc_id", langid.identify(model, "text").getField("language").alias("l")).collect()}
    assert sum(got[i] == l for i, _, l, _ in rows) == len(rows)
    assert all(got[i] == "und" for i, *_ in junk)
    assert {r["doc_id"] for r in langid.keep_identified(docs, model).collect()} == {i for i, *_ in rows}


def test_awkward_rows(spark):
    model = _train(spark)
    docs = data.with_clashes(data.documents(spark, data.awkward_rows()))
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == [1, 2, 3, 8, 9, 9, 10, 10] and ids.count(None) == 1
    r = docs.where("text is null or trim(text) in ('', '?!…--')").select(langid.identify(model, "text").alias("r")).select("r.language", "r.n_grams").distinct().collect()
    assert {x["language"] for x in r} == {"und"}


def test_the_sample_holds_for_labels_of_any_size(spark):
    """Counts stand for a label of any size: with 1e9 documents the level is that of 500 of them, never under the least hash."""
    docs = data.documents(spark, [(i, f"word{i}", "big" if i % 10 else "rare", "s") for i in range(20_000)] + [(None, "same", "nulls", "s")] * 700 + [(None, None, "big", "s")])
    levels = langid.label_levels(docs, 500)
    got = {r["lang"]: r["n"] for r in langid.sample(docs, levels, 500).groupBy("d_lang").count().selectExpr("d_lang as lang", "count as n").collect()}
    assert got == {"big": 500, "rare": 500, "nulls": 500}
    want = sorted((r["h"], r["doc_id"]) for r in docs.where("lang = 'big' and text is not null").select("doc_id", langid.F.shiftrightunsigned(langid.F.xxhash64(langid.F.lit(11), "doc_id"), 1).alias("h")).collect())[:500]
    assert {r["t"] for r in langid.sample(docs, levels, 500).where("d_lang = 'big'").collect()} == {f"word{i}" for _, i in want}


def test_a_label_of_a_billion_documents_is_sampled(spark):
    """Mocked counts: at 1e9 documents a label's lowest level that holds 500 is about 2 ** 63 * 5e-7 and is not empty."""
    halves = [("huge", level, 10**9 >> (64 - level)) for level in range(34, 64)]
    counts = spark.createDataFrame([(l, v, n) for l, v, n in halves if n], "lang string, level int, n bigint")
    real, langid.F.count = langid.F.count, lambda *_: langid.F.sum("n")
    try:
        docs = counts.withColumns({"text": langid.F.lit("x"), "doc_id": langid.F.lit(1)})
        level, langid._level = langid._level, lambda _: langid.F.col("level")
        upto = langid.label_levels(docs, 500).first()["upto"]
    finally:
        langid.F.count, langid._level = real, level
    assert 500 <= sum(n for _, v, n in halves if v <= upto) <= 1500


def test_every_label_is_a_language(spark):
    rows = [(i * 3 + j, f"{chr(97 + i % 26)}{chr(97 + i // 26)}x{chr(97 + (i * 7) % 26)} " * 40, f"l{i:03}", "s") for i in range(90) for j in range(3)]
    model = langid.train(data.documents(spark, rows))
    assert len(model.languages) == 90
    assert langid.keep_identified(data.documents(spark, rows), model).count() == 270


def test_the_filter_grows_with_its_grams():
    g = np.random.default_rng(1).integers(0, 1 << 40, 400_000).astype(np.uint64)
    model = langid.build(["a", "b"], {(0, 3): g, (0, 5): g[:10]}, 0.3)
    assert model.bits == (23, langid.LEAST_BITS) and model.false_rates[0, 0] < 0.03


def test_empty_and_unlabelled_tables(spark):
    none = data.documents(spark, [])
    model = langid.train(none)
    assert model.languages == () and langid.keep_identified(none, model).count() == 0
    unlabelled = data.documents(spark, [(1, "some words", None, "s")])
    assert langid.keep_identified(unlabelled, langid.train(unlabelled)).count() == 0


def test_more_than_eight_languages(spark):
    rows = [(i, " ".join(f"{chr(97 + i)}{chr(97 + (i * 7 + j) % 26)}ol" for j in range(200)), f"x{i:02}", "s") for i in range(11)]
    docs = data.documents(spark, rows)
    model = langid.train(docs, min_count=1)
    got = {r["doc_id"]: r["l"] for r in docs.select("doc_id", langid.identify(model, "text").getField("language").alias("l")).collect()}
    assert got == {i: f"x{i:02}" for i in range(11)}
