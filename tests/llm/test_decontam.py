from __future__ import annotations

import random

import numpy as np
import pytest

from tessella.llm import decontam
from tests.llm import data


def slow(pattern: bytes, text: bytes) -> int:
    """Least edit distance of the pattern to any substring, by the full table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


@pytest.mark.parametrize("size", [1, 8, 63, 64, 65, 130, 300])
def test_myers_equals_the_table(size):
    rng = random.Random(size)
    patterns = [bytes(rng.choice(b"abc") for _ in range(size)) for _ in range(4)]
    buf, spans = b"", []
    for k in range(24):
        p = bytearray(patterns[k % 4])
        for _ in range(rng.randint(0, max(1, size // 8))):
            at = rng.randrange(len(p) + 1)
            p[at : at + rng.randint(0, 1)] = bytes([rng.choice(b"abcd")]) * rng.randint(0, 1)
        text = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 30))) + bytes(p) + b"c" * rng.randint(0, 9)
        spans.append((len(buf), len(buf) + len(text)))
        buf += text
    a, b = np.array(spans).T
    which = np.arange(24) % 4
    got, end = decontam.myers(patterns, which, np.frombuffer(buf, np.uint8), a, b)
    for k in range(24):
        assert got[k] == slow(patterns[which[k]], buf[a[k] : b[k]])
        assert slow(patterns[which[k]], buf[a[k] : end[k]]) == got[k]


def _garble(text: str, n: int, seed: int) -> str:
    rng = random.Random(seed)
    for _ in range(n):
        at = rng.randrange(len(text))
        text = rng.choice([text[:at] + text[at + 1 :], text[:at] + "q" + text[at:], text[:at] + "z" + text[at + 1 :]])
    return text


def test_all_pairs_against_brute_force(spark):
    items = [(i, data.prose(["en", "de", "fr"][i % 3], 8 + i, 50 + i).replace("\n", " ")) for i in range(12)] + [(90, "tiny"), (91, ""), (92, None), (93, "?!")]
    rng = random.Random(4)
    docs = []
    for d in range(60):
        text = data.prose("en", 30, d)
        for i, t in rng.sample(items[:12], rng.randint(0, 3)):
            text += "\n" + _garble(t, rng.randint(0, len(t) // 6), d * 100 + i).upper() + ". " + data.prose("fr", 10, d)
        docs.append((d, text + (" Tiny" if d % 9 == 0 else " tinyish"), "en", "s"))
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.find_matches(data.documents(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"), bytes_per_pass=900).collect()}
    want = {}
    for d, text, *_ in docs:
        body = b" " + decontam.normalise(text) + b" "
        for i, t in items:
            norm = decontam.normalise(t)
            if not norm:
                continue
            if len(norm) < 8:
                if b" " + norm + b" " in body:
                    want[d, i] = 0
                continue
            budget = int(len(norm) * 0.1)
            k = slow(norm, body)
            if k <= budget:
                want[d, i] = k
    assert got == want and len(want) > 20


@pytest.mark.parametrize("rate", [0.1, 0.25])
def test_items_of_few_bytes_against_brute_force(spark, rate):
    """Items of 8 to 40 bytes, with their whole budget of edits; at a quarter the pieces have 3 bytes."""
    rng = random.Random(int(rate * 100))
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    items = []
    for n in range(8, 41):
        text = ""
        while len(text) < n:
            text += word(rng.randint(2, 7)) + " "
        text = text[:n].rstrip() + word(n - len(text[:n].rstrip()))
        items.append((-n, text))
    docs = [(d, word(40) + " " + _garble(items[d % 33][1], rng.randint(0, max(1, int(len(items[d % 33][1]) * rate) + 1)), d) + " " + word(30), "en", "s") for d in range(132)]
    got = {(r["doc_id"], r["item_id"]): (r["distance"], r["error_budget"]) for r in decontam.find_matches(data.documents(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"), rate=rate).collect()}
    want = {}
    for d, text, *_ in docs:
        body = b" " + decontam.normalise(text) + b" "
        for i, t in items:
            budget = int(len(decontam.normalise(t)) * rate)
            if (k := slow(decontam.normalise(t), body)) <= budget:
                want[d, i] = k, budget
    assert got == want and len(want) > 60


def test_awkward_rows(spark):
    docs = data.with_clashes(data.documents(spark, [*data.awkward_rows(), (20, "xx " + data.prose("de", 40, 7), "de", "s"), (20, "xx " + data.prose("de", 40, 7), "de", "s"), (None, data.prose("de", 40, 7), "de", "s")]))
    bench = data.with_clashes(spark.createDataFrame([(1, data.prose("de", 40, 7)), (1, data.prose("de", 40, 7)), (None, data.prose("de", 40, 7)), (3, None), (4, "")], "item_id bigint, text string").drop("item_id").withColumn("item_id", decontam.F.lit(1).cast("bigint")))
    found = decontam.find_matches(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(20, 1), (None, 1)}
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert decontam.find_matches(docs.limit(0), bench).count() == 0
    assert decontam.find_matches(docs, bench.limit(0)).count() == 0
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == docs.count()


def test_a_null_item_id_stays_null(spark):
    bench = spark.createDataFrame([(None, data.prose("de", 40, 7))], "item_id bigint, text string")
    r = decontam.find_matches(data.documents(spark, [(1, data.prose("de", 40, 7), "de", "s")]), bench).collect()
    assert [(x["doc_id"], x["item_id"], x["distance"]) for x in r] == [(1, None, 0)]
