from __future__ import annotations

import random

from tessella.llm import warc

SCHEMA = "record_id bigint, record_type string, target_uri string, ts bigint, status int, etag string, last_modified string, headers map<string,string>, payload string"


def brute(rows):
    full = {}
    for r in rows:
        if r[1] == "response" and r[4] == 200 and r[2] is not None and r[3] is not None:
            full.setdefault(canon(r[2]), {})[r[0]] = r
    out = []
    for r in rows:
        if r[1] != "revisit":
            continue
        c = canon(r[2]) if r[2] is not None else None
        earlier = [b for b in full.get(c, {}).values() if r[3] is not None and b[3] < r[3]] if c is not None else []
        b = max(earlier, key=lambda b: (b[3], b[0]), default=None)
        tag = lambda t: t.strip().removeprefix("W/") if t is not None else None
        if b is None:
            what = "no_base"
        elif r[5] is not None and b[5] is not None:
            what = "resolved" if tag(r[5]) == tag(b[5]) else "mismatch"
        elif r[6] is not None and b[6] is not None:
            what = "resolved" if r[6] == b[6] else "mismatch"
        else:
            what = "unverified"
        payload = b[8] if what == "resolved" else None
        headers = None
        if what == "resolved":
            new = {k.lower(): v for k, v in (r[7] or {}).items() if k.lower() not in warc.FIXED_HEADERS}
            headers = "\n".join(sorted(f"{k}: {v}" for k, v in ({k.lower(): v for k, v in (b[7] or {}).items()} | new).items()))
        out.append((r[0], c, r[3], what, b and b[0], b and b[3], headers, payload))
    return out


def canon(url):
    bare = url.strip().split("#")[0]
    bare = bare.split("://", 1)[1] if "://" in bare else bare
    front, _, query = bare.partition("?")
    host, slash, path = front.partition("/")
    host = host.lower()
    for p in ("www.", "m."):
        if host.startswith(p):
            host = host[len(p) :]
            break
    for p in (":80", ":443"):
        host = host.removesuffix(p)
    parts = sorted(p for p in query.split("&") if p and not p.startswith("utm_"))
    return host + (slash + path).rstrip("/") + ("?" + "&".join(parts) if parts else "")


def _rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        path = rng.randint(0, 8)
        url = rng.choice([f"http://www.Site.org/p{path}/", f"https://site.org:443/p{path}#x", f"https://m.site.org/p{path}?utm_a=1", f"https://site.org/p{path}?b=2&a=1", f"https://site.org/p{path}?a=1&b=2", None])
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        out.append((i, kind, url, rng.choice([None, *range(40)]), rng.choice([200, 200, 200, 404]) if kind == "response" else 304, rng.choice([None, '"a"', 'W/"a"', '"b"']), rng.choice([None, "d1", "d2"]),
                    rng.choice([None, {}, {"Content-Type": "t", "X-A": str(i)}, {"content-length": "3", "Date": str(i), "x-a": "new"}]), rng.choice([None, "", f"body {i}"])))
    return out


def test_against_brute_force(spark):
    rows = _rows(600, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = warc.with_payloads(warc.resolve_revisits(df), df).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, brute(rows)))
    assert {r["outcome"] for r in got} == {"no_base", "mismatch", "resolved", "unverified"}


def test_repeated_rows_empty_table_and_other_columns(spark):
    from pyspark.sql import functions as F

    rows = _rows(80, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    twice = df.union(df.where("record_type = 'response'")).withColumns({c: F.lit(1) for c in ("kind", "tag", "base", "lone", "b_id", "r_id", "canonical_uri", "outcome")})
    got = warc.with_payloads(warc.resolve_revisits(twice), twice).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, brute(rows)))
    assert warc.with_payloads(warc.resolve_revisits(df.limit(0)), df.limit(0)).count() == 0


def test_very_long_url_and_payload(spark):
    long = "https://site.org/" + "p" * 50_000
    df = spark.createDataFrame([(1, "response", long, 1, 200, '"a"', None, None, "y" * 1_000_000), (2, "revisit", long + "/", 2, 304, '"a"', None, None, None)], SCHEMA)
    r = warc.with_payloads(warc.resolve_revisits(df), df).first()
    assert r["outcome"] == "resolved" and len(r["payload"]) == 1_000_000 and r["headers"] == ""


def test_of_responses_with_one_id_the_least_payload_counts(spark):
    schema = "record_id bigint, record_type string, target_uri string, ts bigint, status int, etag string, last_modified string, headers map<string,string>, payload string"
    rows = [(1, "response", "http://a/x", 1, 200, "t", None, {"A": "1"}, p) for p in ("z", "b", "m")] + [(1, "response", "http://a/x", 1, 200, "t", None, {"A": "0"}, "b")] + [(2, "revisit", "http://a/x", 5, 304, "t", None, h, None) for h in ({"Date": "2"}, {"Date": "1"})]
    for n in (1, 5):
        records = spark.createDataFrame(rows, schema).repartition(n)
        got = warc.with_payloads(warc.resolve_revisits(records), records).collect()
        assert [(r["payload"], r["headers"]) for r in got] == [("b", "a: 0\ndate: 1")] * 2
