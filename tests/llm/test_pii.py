from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import pii
from tests.llm import data


@pytest.fixture(scope="module")
def model():
    return pii.train()


def test_viterbi_equals_every_path():
    rng = np.random.default_rng(2)
    n = len(pii.LABELS)
    m = pii.finish(np.zeros((1 << pii.FEATURE_BITS, n), np.float32), rng.normal(size=(n, n)), rng.normal(size=n), rng.normal(size=n))
    sizes = [1, 3, 2, 1, 3]
    emit = rng.normal(size=(sum(sizes), n))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    opens, closes = rng.normal(size=(5, n)), rng.normal(size=(5, n))
    got = pii.viterbi(m, emit, starts, ends, opens, closes)
    for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
        score = lambda p: opens[k, p[0]] + closes[k, p[-1]] + sum(emit[a + i, y] for i, y in enumerate(p)) + sum(m.transitions[x, y] for x, y in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = max(itertools.product(range(n), repeat=b - a), key=score)
        assert tuple(got[a:b]) == best


def test_cut_decoding_equals_whole_decoding(model):
    texts = [t for t, _ in pii.labelled_table(200, 77)] + [data.prose("fr", 300, 1)]
    buf, off = pii.tv.buffers(pii.tv.as_array(pa.array(texts)))
    t = pii.tokenise(buf, off)
    bounds = np.searchsorted(t.rows, np.arange(len(texts) + 1))
    emit = model.weights[pii.features(t, np.arange(len(t.rows)))].sum(axis=1, dtype=np.float64)
    a, b = bounds[:-1][np.diff(bounds) > 0], bounds[1:][np.diff(bounds) > 0]
    whole = pii.viterbi(model, emit, a, b, np.repeat(model.start[None], len(a), 0), np.repeat(model.end[None], len(a), 0))
    assert (pii.decode(model, t) == whole).all()


def test_held_out_accuracy(spark, model):
    table = pii.labelled_table(600, 4242)
    docs = data.documents(spark, [(i, t, "en", "s") for i, (t, _) in enumerate(table)])
    got = {}
    for r in pii.find_pii(docs, model).collect():
        got.setdefault(r["doc_id"], set()).add((r["kind"], r["start"], r["start"] + r["length"]))
    right = wrong = missed = 0
    for i, (text, spans) in enumerate(table):
        at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])])
        want = {(k, int(at[a]), int(at[b])) for a, b, k in spans}
        have = got.get(i, set())
        right, missed, wrong = right + len(want & have), missed + len(want - have), wrong + len(have - want)
    assert right / (right + missed) > 0.93 and right / (right + wrong) > 0.93


#: Written by hand, not by the table's formats: (text, data).
BY_HAND = [
    ("write to joe@site.net now", ["joe@site.net"]), ("a_b99@mail.com", ["a_b99@mail.com"]), ("or bob_smith99@mail.com.", ["bob_smith99@mail.com"]), ("(joe@site.net)", ["joe@site.net"]), ("mailto:joe@site.net", ["joe@site.net"]), ("email:joe@site.net", ["joe@site.net"]),
    ("joe@site.net,ann@x.io", ["joe@site.net", "ann@x.io"]), ("Kontakt: <h.meier@uni-bonn.de>", ["h.meier@uni-bonn.de"]), ("ip=10.0.0.1", ["10.0.0.1"]), ("at 192.168.0.1:8080 there", ["192.168.0.1"]), ("from 2001:db8::1 on", ["2001:db8::1"]), ("GB82WEST12345698765432", ["GB82WEST12345698765432"]),
    ("IBAN DE89 3704 0044 0532 0130 00", ["DE89 3704 0044 0532 0130 00"]), ("DE89370400440532013000", ["DE89370400440532013000"]), ("call 020 7946 0958 today", ["020 7946 0958"]), ("555 123 4567", ["555 123 4567"]), ("call (415) 555-2671.", ["(415) 555-2671"]), ("+1 (415) 555-0132 or", ["+1 (415) 555-0132"]), ("tel:+442079460958", ["+442079460958"]),
    ("card 4111 1111 1111 1111 ok", ["4111 1111 1111 1111"]), ("4111111111111111", ["4111111111111111"]), ("ssn 123-45-6789", ["123-45-6789"]),
    ("see 12:30:45 and 2024-01-31", []), ("version 1.2.3 of std::vector", []), ("the years 2019 2020 2021 were", []), ("order 12345678 and 1,234,567", []), ("MAC 00:1a:2b:3c:4d:5e", []), ("follow @somebody or read https://site.net/a/123", []), ("chapter 3.1 (page 20)", []), ("call f(x) or g(2)", []), ("a ratio of 3:4", []), ("$499.99, 20% off", []),
]


def test_data_written_by_hand(spark, model):
    docs = data.documents(spark, [(i, t, "en", "s") for i, (t, _) in enumerate(BY_HAND)])
    got = {}
    for r in pii.find_pii(docs, model).collect():
        got.setdefault(r["doc_id"], []).append(BY_HAND[r["doc_id"]][0].encode()[r["start"] : r["start"] + r["length"]].decode())
    wrong = {t: sorted(got.get(i, [])) for i, (t, want) in enumerate(BY_HAND) if sorted(got.get(i, [])) != sorted(want)}
    assert wrong == {}


def test_without_a_model_one_is_trained(spark):
    docs = data.documents(spark, [(1, "mail jane.doe@example.com now", "en", "s")])
    assert [r["kind"] for r in pii.find_pii(docs).collect()] == ["EMAIL"]


def test_clean_prose_has_none(spark, model):
    docs = data.documents(spark, [(i, data.prose(["en", "de", "fr"][i % 3], 200, i), "en", "s") for i in range(30)])
    assert pii.find_pii(docs, model).count() == 0


def test_awkward_rows(spark, model):
    rows = [*data.awkward_rows(), (30, "mail jane.doe@example.com now", "en", "s"), (30, "mail jane.doe@example.com now", "en", "s"), (None, "mail jane.doe@example.com now", "en", "s"), (31, data.prose("en", 40_000, 3) + " jane.doe@example.com", "en", "s")]
    docs = data.with_clashes(data.documents(spark, rows))
    got = sorted((r["doc_id"] or 0, r["kind"], r["shape"]) for r in pii.find_pii(docs, model).collect())
    assert got == [(0, "EMAIL", "aaaa.aaa@aaaaaaa.aaa"), *[(30, "EMAIL", "aaaa.aaa@aaaaaaa.aaa")] * 2, (31, "EMAIL", "aaaa.aaa@aaaaaaa.aaa")]
    assert pii.find_pii(docs.limit(0), model).count() == 0
