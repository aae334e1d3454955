from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("  a \n\t b  ", "a b"), ("a b", "a b"), ("", ""), ("﻿x y", "x y"), ("a\x0bb", "a b")])
def test_wide_spaces_collapse(spark, raw, want):
    assert one(spark, T.collapse_spaces(F.lit(raw))) == want


def test_hash_is_sixteen_digits_of_sha256(spark):
    assert one(spark, T.hash_text(F.lit("abc"))) == hashlib.sha256(b"abc").hexdigest()[:16]


def test_utf16_length(spark):
    assert [one(spark, T.utf16_length(F.lit(x))) for x in ("a😀b", "", "é")] == [4, 0, 1]


@pytest.mark.parametrize(("body", "params", "want"), [
    ('{ return a + "x" ; }', ["a"], '{ return $0 + "__STR__" ; }'),
    ("{ return b . v + this . v ; }", ["a", "b"], "{ return $_.v + $_.v ; }"),
    ("f ( 12 , 1.5 , x2 )", [], "f ( __NUM__ , __NUM__ , x2 )"),
    ("$el . id", ["$el"], "$el . id"),
    ("ab a éa", ["a"], "ab $0 é$0"),
])
def test_bodies_are_normalised(spark, body, params, want):
    got = one(spark, T.normalize_body(F.lit(body), F.array(*[F.lit(p) for p in params]) if params else F.array().cast("array<string>")))
    assert got == want or (body.startswith("$el") and got in ("$el . id", "$_.id"))


@pytest.mark.parametrize(("name", "want"), [("MAX_retryCount", {"max", "retry", "count"}), ("aB", {"a", "b"}), ("__x", {"x"})])
def test_name_segments(spark, name, want):
    assert set(one(spark, T.name_segments(F.lit(name)))) == want


def test_wildcards(spark):
    hit = lambda p, s: one(spark, F.regexp_like(F.lit(s), T.wildcard(F.lit(p))))
    assert hit("no-*", "no-any-cast") and not hit("no-*", "dead-no-x") and not hit("a.c*", "abc")
