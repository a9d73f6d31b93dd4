import random
from datetime import datetime, timedelta, timezone

from quillmesh.llm import warc as W

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "record_id long, kind string, url string, ts timestamp, status int, headers map<string,string>, digest string"


def test_canonical_urls(spark):
    cases = {
        "HTTP://WWW.Example.org:80/a/b/?utm_source=x&b=2&a=1#frag": "example.org/a/b?a=1&b=2",
        "https://user@example.org": "example.org",
        "https://example.org/?ref=x": "example.org",
        "example.org/A": "example.org/A",
        "https://m.example.org/x?refer=1": "m.example.org/x?refer=1",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert [r[0] for r in df.select(W.canonical_url(df.u)).collect()] == list(cases.values())


def brute(rows):
    out = []
    for i, kind, url, ts, _, headers, digest in rows:
        if kind != "revisit":
            continue
        best = None
        for j, k2, u2, t2, status, h2, d2 in rows:
            if k2 == "response" and status == 200 and None not in (url, ts, u2, t2) and u2 == url and t2 < ts:
                if best is None or (t2, j) > best[0]:
                    best = ((t2, j), h2 or {}, d2)
        headers = headers or {}
        if best is None:
            out.append((i, None, "no_response", None))
            continue
        (_, j), h, d = best
        strip = lambda e: e[2:] if e and e.startswith("W/") else e
        e1, e2 = strip(headers.get("etag")), strip(h.get("etag"))
        m1, m2 = headers.get("last-modified"), h.get("last-modified")
        if e1 and e2 and e1 != e2:
            out.append((i, None, "etag", None))
        elif m1 and m2 and m1 != m2:
            out.append((i, None, "last-modified", None))
        elif digest and d and digest != d:
            out.append((i, None, "digest", None))
        else:
            merged = dict(h) | {k: v for k, v in headers.items() if k in W.PERMITTED}
            out.append((i, j, "resolved", tuple(sorted(merged.items()))))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        url = rng.choice(["hot.org/x"] * 5 + ["a.org/1", "b.org/2", None])
        ts = T0 + timedelta(hours=rng.randrange(200)) if rng.random() > 0.03 else None
        headers = rng.choice([None, {}, {"etag": rng.choice(['"1"', 'W/"1"', '"2"']), "content-type": rng.choice("xy"), "vary": str(i)}, {"last-modified": rng.choice("pq"), "date": str(i)}])
        rows.append((i, rng.choice(["response", "revisit", "request"]), url, ts, rng.choice([200, 200, 404, None]), headers, rng.choice([None, "d1", "d1", "d2"])))
    df = spark.createDataFrame([*rows, rows[1]], SCHEMA).selectExpr("*", "1 as bucket", "'x' as outcome")
    want = brute(rows) + ([r for r in brute(rows) if r[0] == 1])
    for seconds in (86400, 3 * 3600):
        got = W.resolve_revisits(df, seconds).collect()
        have = sorted([(r.record_id, r.response_id, r.outcome, tuple(sorted(r.headers.items())) if r.headers is not None else None) for r in got], key=str)
        assert have == sorted(want, key=str)
    assert {r[2] for r in want} == {"resolved", "no_response", "etag", "last-modified", "digest"}


def test_empty(spark):
    assert W.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_header_names_in_any_case(spark):
    rows = [(1, "response", "http://a/x", 0, 200, {"ETag": 'W/"1"', "Content-Type": "t", "content-type": "u"}, "d"), (2, "revisit", "http://a/x", 5, 304, {"eTaG": '"1"', "CACHE-Control": "no"}, "d"),
            (3, "revisit", "http://a/x", 6, 304, {"ETAG": '"2"'}, "d")]
    records = spark.createDataFrame(rows, "record_id long, kind string, url string, at long, status int, headers map<string,string>, digest string").selectExpr("*", "timestamp_seconds(at) as ts", "1 as bucket")
    got = {r.record_id: r for r in W.resolve_revisits(records).collect()}
    assert got[2].outcome == "resolved" and got[2].headers == {"etag": '"1"', "content-type": "u", "cache-control": "no"}
    assert got[3].outcome == "etag"
