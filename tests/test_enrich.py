import json

from quillmesh.operators import enrich

CHUNK = "def login(): checks the\n  session token with redis"


def graph(spark):
    nodes = [
        ("src/auth.py", "file", None, None), ("src/auth.py::function::login::1", "function", "src/auth.py", "login"),
        ("concept::jwt", "concept", None, "JWT"), ("src/b.py", "file", None, None),
    ]
    links = [("src/auth.py", "concept::jwt", "mentions", "extracted", None)]
    return (
        spark.createDataFrame(nodes, "id string, type string, file string, name string"),
        spark.createDataFrame(links, "source string, target string, type string, provenance string, confidence double"),
    )


def entity(name, **more):
    return {"name": name, "kind": "domain_term", "evidence": "session token", "confidence": 0.9} | more


def relation(kind, a, b, **more):
    return {"type": kind, "subject": a, "object": b, "evidence": "checks the session", "confidence": 0.5} | more


def applied(spark, payload, file="src/auth.py"):
    nodes, links = graph(spark)
    text = payload if isinstance(payload, str) else json.dumps(payload)
    replies = spark.createDataFrame([(file, text, CHUNK)], "file string, payload string, chunk string")
    n, e, counts = enrich.apply_replies(nodes, links, replies)
    old = {r.id for r in nodes.collect()}
    return {r.id: (r.name, r.kind) for r in n.collect() if r.id not in old}, {(r.source, r.type, r.target, r.provenance) for r in e.collect()}, counts


def test_entities(spark):
    bad = [
        entity("low", confidence=0.49), entity("over", confidence=1.1), entity("far", evidence="not in it"), entity("bare", evidence=""), entity(5),
        entity("  "), "text", 7, None, entity("odd", confidence="x"),
    ]
    made, edges, counts = applied(spark, {"entities": [entity(" Session Token "), entity("session-token", kind="other"), entity("Redis", kind="nonsense", confidence="0.5"), entity("jwt"), *bad]})
    assert made == {"concept::session-token": ("Session Token", "domain_term"), "concept::redis": ("Redis", None)}
    assert edges == {
        ("src/auth.py", "mentions", "concept::session-token", "extracted"), ("src/auth.py", "mentions", "concept::redis", "extracted"),
        ("src/auth.py", "mentions", "concept::jwt", "extracted"),
    }
    assert counts == {"added": 2, "dropped": len(bad)}


def test_relations(spark):
    made, edges, counts = applied(
        spark,
        {
            "relations": [
                relation("depends_on", "Late", "Early"),  # the subject does not stand yet
                relation("implements", "login", "Login flow"),
                relation("depends_on", "auth.py", "redis"),
                relation("depends_on", "JWT", "Late"),
                relation("mentions", "who?", "Cache"),
                relation("implements", "src/b.py", "Not code"),
                relation("depends_on", "late", "redis"),  # now it does
                relation("calls", "login", "redis"),
                relation("mentions", "login", None),
                relation("depends_on", "redis", "redis"),  # a loop is no edge, but no dropped item
            ]
        },
    )
    assert made["concept::redis"] == ("redis", "library") and made["concept::login-flow"] == ("Login flow", "domain_term")
    assert set(made) == {f"concept::{c}" for c in ("early", "login-flow", "redis", "late", "cache", "not-code")}
    assert {e for e in edges if e[2] != "concept::jwt"} == {
        ("src/auth.py::function::login::1", "implements", "concept::login-flow", "inferred"), ("src/auth.py", "depends_on", "concept::redis", "inferred"),
        ("concept::jwt", "depends_on", "concept::late", "inferred"), ("src/auth.py", "mentions", "concept::cache", "extracted"),
        ("concept::late", "depends_on", "concept::redis", "inferred"),
    }
    assert counts == {"added": 5, "dropped": 4}


def test_replies_without_items(spark):
    for payload in ("", "{", "[]", '{"entities": 3, "relations": {"a": 1}}', "null"):
        assert applied(spark, payload)[::2] == ({}, {"added": 0, "dropped": 0})
    # A file that the graph does not have gives concepts but no edges.
    made, edges, counts = applied(spark, {"entities": [entity("Redis")]}, "gone.py")
    assert set(made) == {"concept::redis"} and len(edges) == 1 and counts == {"added": 0, "dropped": 0}
