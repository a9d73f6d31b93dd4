"""Queries over the driver's tables, one or more for each group of operators, and their SQL."""

from pyspark.sql import functions as F

from . import api
from .functions import text as X
from .operators import edges as E
from .operators import enrich as N
from .operators import expand as G
from .operators import links as L
from .operators import merge as M
from .plans.deal import deal, tasks
from .plans.model import edge_cost, slug
from .sources import files as S


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(table, column):
    return F.concat(F.lit(f"{table}::"), F.col(column).cast("string"))


_TABLES = ("region", "nation", "customer", "supplier", "orders", "part")


def _mark(table, column):
    """The same id as one number, eight times the key and the table's place: what is sorted and shuffled is
    a third of the name. Keys of over 60 bits overflow, which raises."""
    return F.col(column).cast("long") * 8 + _TABLES.index(table)


def _named(mark):
    """The id that a mark stands for."""
    mark = F.col(mark) if isinstance(mark, str) else mark
    table = F.element_at(F.array(*[F.lit(f"{t}::") for t in _TABLES]), (mark.bitwiseAND(F.lit(7)) + 1).cast("int"))
    return F.concat(table, F.shiftright(mark, 3).cast("string"))


def nodes(spark, sf_dir, key=_key):
    """Regions and nations as directories, customers and suppliers as files, orders as headings,
    parts as concepts."""
    no = lambda kind: F.lit(None).cast(kind)

    def of(table, column, node_type, name, **more):
        columns = {"name": name, "file": no("string"), "source": no("string"), "kind": no("string"), "start_line": no("int")} | more
        return _t(spark, sf_dir, table).select(key(table, column).alias("id"), F.lit(node_type).alias("type"), *[c.alias(n) for n, c in columns.items()])

    heading = {"file": F.lit("orders.md"), "source": F.lit("markdown"), "start_line": F.col("o_orderkey").cast("int") + 1}
    all_nodes = (
        of("region", "r_regionkey", "dir", F.col("r_name"))
        .unionByName(of("nation", "n_nationkey", "dir", F.col("n_name")))
        .unionByName(of("customer", "c_custkey", "file", F.col("c_name")))
        .unionByName(of("supplier", "s_suppkey", "file", F.col("s_name")))
        .unionByName(of("orders", "o_orderkey", "heading", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), **heading))
        .unionByName(of("part", "p_partkey", "concept", F.col("p_name"), kind=F.lit("other")))
    )
    empty = {c: no(k) for c, k in (("text", "string"), ("language", "string"), ("path", "string"), ("page", "int"), ("start_sec", "double"), ("end_sec", "double"))}
    return all_nodes.select("*", *[c.alias(n) for n, c in empty.items()])


def candidate_links(spark, sf_dir):
    def of(df, source, target, kind, provenance, phase, seq, confidence=None, evidence=None):
        return df.select(
            source.alias("source"), target.alias("target"), F.lit(phase).alias("phase"), seq.cast("long").alias("seq"), F.lit(kind).alias("type"),
            F.lit(provenance).alias("provenance"), (F.lit(None).cast("double") if confidence is None else confidence).alias("confidence"),
            F.lit(evidence).cast("string").alias("evidence"),
        )

    nation, customer, supplier, orders, lineitem = (_t(spark, sf_dir, t) for t in ("nation", "customer", "supplier", "orders", "lineitem"))
    supply = deal(lineitem.select("l_suppkey", "l_partkey", "l_quantity"), "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.max("l_quantity").alias("q"))
    return (
        of(nation, _mark("region", "n_regionkey"), _mark("nation", "n_nationkey"), "contains", "extracted", 0, F.col("n_nationkey"))
        .unionByName(of(customer, _mark("nation", "c_nationkey"), _mark("customer", "c_custkey"), "contains", "extracted", 0, F.col("c_custkey")))
        .unionByName(of(supplier, _mark("nation", "s_nationkey"), _mark("supplier", "s_suppkey"), "contains", "extracted", 0, F.col("s_suppkey")))
        .unionByName(of(orders, _mark("orders", "o_orderkey"), _mark("customer", "o_custkey"), "references", "extracted", 1, F.lit(0)))
        .unionByName(of(lineitem, _mark("orders", "l_orderkey"), _mark("part", "l_partkey"), "depends_on", "inferred", 2, F.col("l_linenumber"), 1 - F.col("l_discount"), "line item"))
        .unionByName(of(supply, _mark("supplier", "l_suppkey"), _mark("part", "l_partkey"), "related_to", "inferred", 3, F.lit(0), F.col("q") / 50.0))
    )


def marked_links(spark, sf_dir):
    return E.first_edge_wins(candidate_links(spark, sf_dir))


def links(spark, sf_dir):
    return marked_links(spark, sf_dir).withColumns({c: _named(c) for c in ("source", "target")})


def settled_links(spark, sf_dir):
    """For queries that read the links again and again."""
    return G.settle(links(spark, sf_dir))


GRAPH = """
WITH raw AS (
  SELECT 'region::' || n_regionkey AS source, 'nation::' || n_nationkey AS target, 0 AS phase, CAST(n_nationkey AS BIGINT) AS seq,
         'contains' AS type, 'extracted' AS provenance, CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS evidence FROM nation
  UNION ALL SELECT 'nation::' || c_nationkey, 'customer::' || c_custkey, 0, c_custkey, 'contains', 'extracted', NULL, NULL FROM customer
  UNION ALL SELECT 'nation::' || s_nationkey, 'supplier::' || s_suppkey, 0, s_suppkey, 'contains', 'extracted', NULL, NULL FROM supplier
  UNION ALL SELECT 'orders::' || o_orderkey, 'customer::' || o_custkey, 1, 0, 'references', 'extracted', NULL, NULL FROM orders
  UNION ALL SELECT 'orders::' || l_orderkey, 'part::' || l_partkey, 2, l_linenumber, 'depends_on', 'inferred', 1 - l_discount, 'line item' FROM lineitem
  UNION ALL SELECT 'supplier::' || l_suppkey, 'part::' || l_partkey, 3, 0, 'related_to', 'inferred', max(l_quantity) / 50.0::DOUBLE, NULL
            FROM lineitem GROUP BY l_suppkey, l_partkey),
links AS (
  SELECT source, target, type, provenance, confidence, evidence FROM (
    SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY phase, seq, type, provenance, confidence) AS rn FROM raw)
  WHERE rn = 1),
nodes AS (
  SELECT 'region::' || r_regionkey AS id, 'dir' AS type, r_name AS name FROM region
  UNION ALL SELECT 'nation::' || n_nationkey, 'dir', n_name FROM nation
  UNION ALL SELECT 'customer::' || c_custkey, 'file', c_name FROM customer
  UNION ALL SELECT 'supplier::' || s_suppkey, 'file', s_name FROM supplier
  UNION ALL SELECT 'orders::' || o_orderkey, 'heading', 'Order ' || o_orderkey FROM orders
  UNION ALL SELECT 'part::' || p_partkey, 'concept', p_name FROM part),
costs AS (
  SELECT *, CASE type WHEN 'contains' THEN 2.0::DOUBLE WHEN 'depends_on' THEN 1.0::DOUBLE ELSE 1.25::DOUBLE END
         * CASE provenance WHEN 'extracted' THEN 1.0::DOUBLE ELSE 1.75::DOUBLE END
         / greatest(coalesce(confidence, 0.5::DOUBLE), 0.35::DOUBLE) AS w FROM links)
"""

_HOOD = """,
both_ways AS (SELECT source AS a, target AS b FROM links UNION SELECT target, source FROM links),
h1 AS (SELECT DISTINCT b AS id FROM both_ways WHERE a = 'region::0' AND b <> 'region::0'),
h2 AS (SELECT DISTINCT b AS id FROM both_ways WHERE a IN (SELECT id FROM h1) AND b <> 'region::0' AND b NOT IN (SELECT id FROM h1)),
reach AS (SELECT 'region::0' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2),
ranked AS (SELECT *, row_number() OVER (ORDER BY hop, id) AS rn, count(*) OVER () AS n FROM reach),
hood AS (SELECT id, hop, n > 100 AS truncated FROM ranked WHERE rn <= 100)
"""

QUERIES, ORACLES = {}, {}


def _query(sql=None):
    def add(f):
        name = f.__name__
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@_query(GRAPH + "SELECT source, target, type, provenance, round(confidence, 6) AS confidence FROM links")
def q00_first_edge_wins(spark, sf_dir):
    return links(spark, sf_dir).select("source", "target", "type", "provenance", F.round("confidence", 6).alias("confidence"))


_TYPES = ("file", "dir", "function", "class", "method", "heading", "media_text", "transcript_chunk", "concept")
_EDGES = ("contains", "references", "defines", "imports", "calls", "section_of", "mentions", "related_to", "implements", "depends_on")


@_query(
    GRAPH
    + ", k AS (SELECT unnest(["
    + ", ".join(f"'{t}'" for t in _TYPES)
    + "]) AS type), ek AS (SELECT unnest(["
    + ", ".join(f"'{t}'" for t in _EDGES)
    + """]) AS type)
SELECT 'node' AS what, k.type, count(nodes.id) AS n FROM k LEFT JOIN nodes USING (type) GROUP BY k.type
UNION ALL SELECT 'node', 'total', count(*) FROM nodes
UNION ALL SELECT 'edge', ek.type, count(links.source) FROM ek LEFT JOIN links USING (type) GROUP BY ek.type
UNION ALL SELECT 'edge', 'total', count(*) FROM links"""
)
def q01_stats(spark, sf_dir):
    return E.stats(nodes(spark, sf_dir), links(spark, sf_dir))


@_query(GRAPH + "SELECT type, count(*) AS n FROM nodes GROUP BY type")
def q01_histogram(spark, sf_dir):
    return E.histogram(nodes(spark, sf_dir))


def _hood(spark, sf_dir, hops=2, edges=None):
    found, cut = G.neighbourhood(settled_links(spark, sf_dir) if edges is None else edges, ["region::0"], hops, 100)
    return spark.createDataFrame([(i, h, cut) for i, h in found], "id string, hop int, truncated boolean")


@_query(GRAPH + _HOOD + "SELECT id, hop, truncated FROM hood")
def q02_neighbourhood(spark, sf_dir):
    return _hood(spark, sf_dir)


@_query(GRAPH + _HOOD + "SELECT id, hop, false AS truncated FROM reach WHERE hop < 2")
def q02_neighbourhood_one_hop(spark, sf_dir):
    return _hood(spark, sf_dir, 1)


@_query(GRAPH + _HOOD + "SELECT source, target, type FROM links WHERE source IN (SELECT id FROM hood) AND target IN (SELECT id FROM hood)")
def q03_induced(spark, sf_dir):
    edges = settled_links(spark, sf_dir)
    return E.induced(nodes(spark, sf_dir), edges, F.broadcast(_hood(spark, sf_dir, 2, edges)))[1].select("source", "target", "type")


@_query(
    GRAPH
    + """, fewer AS (SELECT id FROM nodes WHERE id NOT LIKE 'customer::%7' AND id NOT LIKE 'part::%3')
SELECT source, target, type, 'source' AS "end" FROM links WHERE source NOT IN (SELECT id FROM fewer)
UNION ALL SELECT source, target, type, 'target' FROM links WHERE target NOT IN (SELECT id FROM fewer)"""
)
def q03_dangling(spark, sf_dir):
    fewer = nodes(spark, sf_dir, _mark).where(~_named("id").like("customer::%7") & ~_named("id").like("part::%3"))
    return E.dangling(fewer, marked_links(spark, sf_dir)).withColumns({c: _named(c) for c in ("source", "target")})


@_query(GRAPH + "SELECT source, target, type, round(w, 6) AS cost FROM costs")
def q04_edge_cost(spark, sf_dir):
    return links(spark, sf_dir).select("source", "target", "type", F.round(edge_cost(), 6).alias("cost"))


_PATHS = """, p AS (
  SELECT c.target AS id, a.w + b.w + c.w AS cost, 'region::0 ' || a.target || ' ' || b.target || ' ' || c.target AS nodes
  FROM costs a JOIN costs b ON a.target = b.source JOIN costs c ON b.target = c.source
  WHERE a.source = 'region::0' AND c.target IN ('part::1', 'part::2', 'part::3', 'part::5', 'part::8', 'part::13', 'part::21'))
SELECT id, round(cost, 6) AS cost, 3 AS hops, nodes FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cost, nodes) AS rn FROM p) WHERE rn = 1"""


@_query(GRAPH + _PATHS)
def q05_shortest_paths(spark, sf_dir):
    ends = [f"part::{k}" for k in (1, 2, 3, 5, 8, 13, 21)]
    mark = lambda i: int(i.partition("::")[2]) * 8 + _TABLES.index(i.partition("::")[0])
    found = G.shortest_paths(marked_links(spark, sf_dir), mark("region::0"), [mark(i) for i in ends], shown=_named)
    return found.select(_named("id").alias("id"), F.round("cost", 6).alias("cost"), "hops", F.array_join("nodes", " ").alias("nodes"))


@_query(r"""
WITH n AS (SELECT name, min(item_id) AS item_id FROM (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._+-]+')) AS name FROM benchmark) GROUP BY name HAVING count(DISTINCT item_id) = 1),
d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._+-]+')) AS name FROM documents)
SELECT DISTINCT doc_id, item_id FROM d JOIN n USING (name)""")
def q06_references(spark, sf_dir):
    names = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.explode(F.regexp_extract_all("text", F.lit(L.NAME_RUN), F.lit(0))).alias("name"))
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return L.name_references(docs, names, itself=True).select(F.col("source").alias("doc_id"), F.col("target").alias("item_id"))


@_query("""
WITH a AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) AS t FROM conversations),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) AS t FROM benchmark),
s AS (SELECT conv_id, turn, item_id FROM a JOIN b USING (t) GROUP BY ALL HAVING count(*) >= 3)
SELECT conv_id || '/' || turn AS turn, min(item_id) AS item_id FROM s GROUP BY conv_id, turn HAVING count(*) = 1""")
def q07_token_overlap(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    items = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return L.token_overlap(turns, items).select(F.col("source").alias("turn"), F.col("target").alias("item_id"))


@_query(r"""
WITH b AS (SELECT item_id, substr(trim(text), 1, 240) AS e FROM benchmark),
n AS (SELECT item_id, e, trim(regexp_replace(e, '\s+', ' ', 'g')) AS ne FROM b WHERE e <> ''),
d AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS nt FROM documents)
SELECT item_id, doc_id FROM n JOIN d ON contains(text, e) OR contains(nt, ne)""")
def q08_grounded(spark, sf_dir):
    items = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return L.grounded(items, docs).select(F.col("evidence_id").alias("item_id"), F.col("chunk_id").alias("doc_id"))


@_query("""
WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, greatest(0, least(1, list_cosine_similarity(embeddings.embedding::DOUBLE[], q.e))) AS score FROM embeddings, q)
SELECT vec_id, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, vec_id LIMIT 20""")
def q09_cosine_top(spark, sf_dir):
    vectors = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    one = vectors.where("vec_id = 0").first()
    query = F.array(*[F.lit(float(x)) for x in one.embedding])
    scored = vectors.select("vec_id", X.cosine(F.col("embedding"), query).alias("score"))
    return scored.orderBy(F.round("score", 9).desc(), "vec_id").limit(20).select("vec_id", F.round("score", 6).alias("score"))


_PHRASE = "the idiot was here"


@_query(f"""
WITH q AS (SELECT list_distinct(regexp_extract_all('{_PHRASE}', '[a-z0-9_]+')) AS qt),
d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents),
s AS (SELECT doc_id, t, qt, list_distinct(regexp_extract_all(t, '[a-z0-9_]+')) AS tt FROM d, q),
r AS (SELECT doc_id,
    CASE WHEN len(tt) = 0 THEN 0.0
         WHEN len(list_intersect(qt, tt)) = len(qt) OR len(list_intersect(qt, tt)) = len(tt) THEN greatest(len(list_intersect(qt, tt)) / len(qt)::DOUBLE, 0.85)
         ELSE len(list_intersect(qt, tt)) / len(qt)::DOUBLE END AS tok,
    CASE WHEN contains(t, '{_PHRASE}') THEN 0.9 WHEN t <> '' AND contains('{_PHRASE}', t) THEN 0.8 ELSE 0.0 END AS sub FROM s)
SELECT doc_id, round(greatest(tok, sub)::DOUBLE, 6) AS score FROM r WHERE greatest(tok, sub) >= 0.4 ORDER BY greatest(tok, sub) DESC, length(CAST(doc_id AS VARCHAR)), doc_id LIMIT 20""")
def q10_lexical_top(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", X.normalize("text").alias("t"))
    q = F.lit(_PHRASE)
    nothing = F.lit("")
    forward = F.when(F.contains("t", q), 0.9).when((F.col("t") != nothing) & F.contains(q, F.col("t")), 0.8).otherwise(0.0)
    scored = docs.select("doc_id", F.greatest(X.token_score(X.tokens(q), X.tokens(F.col("t"))), forward).alias("score"))
    top = scored.where("score >= 0.4").orderBy(F.desc("score"), F.length(F.col("doc_id").cast("string")), "doc_id").limit(20)
    return top.select("doc_id", F.round("score", 6).alias("score"))


@_query()
def q11_fuzzy_top(spark, sf_dir):
    """Full fuzzy score of parts against a misspelt phrase (sequence ratios have no SQL form)."""
    # Python takes its time over each row, and a narrow table is few splits however many rows it has.
    parts = deal(nodes(spark, sf_dir).where("type = 'concept'"), "id", n=tasks(_t(spark, sf_dir, "part"), piece=256 << 10))
    scored = parts.select("id", X.fuzzy_score("smal brused brass", parts.columns).alias("score"))
    return scored.where("score >= 0.4").orderBy(F.desc("score"), F.length("id"), "id").limit(20)


@_query("""
WITH l AS (SELECT l_orderkey, l_linenumber, 1 + l_partkey % 4 AS level FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber, a.level, max(b.l_linenumber) AS parent
FROM l a LEFT JOIN l b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber < a.l_linenumber AND b.level < a.level
GROUP BY a.l_orderkey, a.l_linenumber, a.level""")
def q12_outline(spark, sf_dir):
    lines = deal(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (1 + F.col("l_partkey") % 4).alias("level")), "l_orderkey")
    return L.outline(lines, "l_orderkey", "l_linenumber", "level", 5).distinct()


@_query("""
WITH s AS (SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'untitled') AS slug FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS n FROM s)
SELECT p_partkey, slug || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS id FROM r""")
def q13_slugs(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select("p_partkey", slug(F.col("p_name")).alias("base"))
    return L.with_suffix(rows, "base", "p_partkey", "id").select("p_partkey", "id")


@_query("""
WITH p AS (SELECT list_filter(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', ''), '/'), lambda x: x <> '' AND x <> '.') AS parts FROM pages),
k AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS k FROM p)
SELECT DISTINCT CASE WHEN k = 1 THEN '.' ELSE array_to_string(parts[1:k-1], '/') END AS parent, array_to_string(parts[1:k], '/') AS child FROM k""")
def q14_directories(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://", "")
    return L.directory_chain(_t(spark, sf_dir, "pages").select(path.alias("path")))[1]


@_query("""
WITH RECURSIVE s AS (SELECT user_id, epoch_us(CAST(ts AS TIMESTAMP)) / 1e6::DOUBLE AS a, epoch_us(CAST(ts AS TIMESTAMP)) / 1e6::DOUBLE + 1 AS b, event_type || ' ' || event_id AS t FROM events),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a, b, t) AS rn FROM s),
f AS (SELECT user_id, rn, 0 AS chunk, a AS since, length(t) AS n, false AS closed FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.rn, f.chunk + CAST(f.closed AS INT), CASE WHEN f.closed THEN e.a ELSE f.since END,
    CASE WHEN f.closed THEN length(e.t) ELSE f.n + 1 + length(e.t) END, NOT f.closed AND (f.n + 1 + length(e.t) >= 60 OR e.b - f.since >= 3600)
  FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT user_id, CAST(chunk AS INT) AS ordinal, min(a) AS start_sec, max_by(b, rn) AS end_sec, string_agg(t, ' ' ORDER BY rn) AS text FROM f JOIN e USING (user_id, rn) GROUP BY user_id, chunk""")
def q15_segments(spark, sf_dir):
    """Fold of each user's events into chunks."""
    events = _t(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    segments = events.select("user_id", at.alias("start_sec"), (at + 1).alias("end_sec"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("text"))
    return L.merge_segments(segments, "user_id", 60, 3600.0)


@_query("""
SELECT count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS total_bytes,
       round(sum(CASE WHEN lang <> 'en' THEN n_chars ELSE 0 END) / sum(n_chars)::DOUBLE, 9) AS non_code_share,
       count(*) FILTER (n_chars > 10000) AS oversize FROM documents""")
def q16_scan_cost(spark, sf_dir):
    files = _t(spark, sf_dir, "documents").select(F.col("n_chars").alias("size_bytes"), "lang")
    return M.scan_cost(files, F.col("lang") == "en", 10000).withColumn("non_code_share", F.round("non_code_share", 9))


@_query(GRAPH + "SELECT 'node' AS what, id AS a, NULL AS b, type FROM nodes UNION ALL SELECT DISTINCT 'edge', source, target, type FROM links")
def q17_merge(spark, sf_dir):
    """Two whole graphs that share all nodes and the edges of two phases: each edge once."""
    n, e = nodes(spark, sf_dir, _mark), marked_links(spark, sf_dir)
    first, second = e.where("type <> 'related_to'"), e.where("type <> 'depends_on'")
    merged, edges = M.merge_graphs([(n, first), (n, second)])
    return merged.select(F.lit("node").alias("what"), _named("id").alias("a"), F.lit(None).cast("string").alias("b"), "type").unionByName(
        edges.select(F.lit("edge").alias("what"), _named("source").alias("a"), _named("target").alias("b"), "type")
    )


@_query(
    GRAPH
    + """SELECT id AS a, NULL AS b, [0, 1] AS inputs FROM nodes WHERE id LIKE '%::4'
UNION ALL SELECT source, target, [0, 1] FROM links WHERE source LIKE '%::7' AND confidence IS NOT NULL"""
)
def q17_conflicts(spark, sf_dir):
    """Nodes and edges of two whole graphs that differ: names of some nodes, confidences of some edges."""
    n, e = nodes(spark, sf_dir, _mark).select("id", "name"), marked_links(spark, sf_dir)
    other = n.withColumn("name", F.when(_named("id").like("%::4"), F.lit("changed")).otherwise(F.col("name")))
    keys = ["source", "target", "type", "provenance"]
    less = e.withColumn("confidence", F.when(_named("source").like("%::7"), F.col("confidence") / 4).otherwise(F.col("confidence")))
    of_nodes = M.conflicts(M.stack([n, other]), ["id"], ["name"], 2).select(_named("id").alias("a"), F.lit(None).cast("string").alias("b"), "inputs")
    return of_nodes.unionByName(M.conflicts(M.stack([e, less]), keys, ["confidence"], 2).select(_named("source").alias("a"), _named("target").alias("b"), "inputs"))


@_query("""
WITH h AS (SELECT doc_id, sha256(text) AS hash FROM documents), s AS (SELECT DISTINCT hash FROM h WHERE doc_id % 2 = 0)
SELECT doc_id, CASE WHEN s.hash IS NULL THEN 'miss' ELSE 'hit' END AS outcome FROM h LEFT JOIN s USING (hash)""")
def q18_cache_probe(spark, sf_dir):
    hashed = _t(spark, sf_dir, "documents").select(
        "doc_id", F.lit("ast").alias("kind"), F.sha2("text", 256).alias("key"), F.sha2("text", 256).alias("content_hash"), F.lit("s").alias("settings_hash")
    )
    store = hashed.where("doc_id % 2 = 0").drop("doc_id").withColumn("payload", F.lit("{}"))
    return M.cache_probe(hashed, store).select("doc_id", "outcome")


_PLACES = """
WITH n AS (SELECT 'r' || r_regionkey AS id FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation),
l AS (SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target, 'contains' AS type FROM nation)"""


def _places(spark, sf_dir):
    region, nation = _t(spark, sf_dir, "region"), _t(spark, sf_dir, "nation")
    name = lambda mark, key: F.concat(F.lit(mark), F.col(key).cast("string"))
    edges = nation.select(name("r", "n_regionkey").alias("source"), name("n", "n_nationkey").alias("target"), F.lit("contains").alias("type"))
    return region.select(name("r", "r_regionkey").alias("id")).unionByName(edges.select(F.col("target").alias("id"))), edges


@_query(
    _PLACES
    + r""",
a AS (SELECT c_custkey, '[edge:r' || (c_custkey % 7) || '->n' || c_nationkey || ':contains] see [n' || c_nationkey || '] and [node: r' || (c_custkey % 9) || ' ], [node:n' || c_nationkey
  || '], [node:n' || c_nationkey || '] [edge:n' || c_nationkey || '->r0:contains]' AS t FROM customer),
x AS (SELECT c_custkey, unnest(list_distinct(list_transform(regexp_extract_all(t, '\[node:([^\]]+)\]', 1), lambda v: trim(v)))) AS node_id FROM a),
y AS (SELECT c_custkey, regexp_extract_all(t, '\[edge:([^\]\-]+)->([^\]:]+):([^\]]+)\]', 1) AS s, regexp_extract_all(t, '\[edge:([^\]\-]+)->([^\]:]+):([^\]]+)\]', 2) AS d FROM a),
z AS (SELECT c_custkey, unnest(s) AS source, unnest(d) AS target FROM y)
SELECT c_custkey AS answer_id, 'node' AS kind, node_id, NULL AS source, NULL AS target FROM x WHERE node_id IN (SELECT id FROM n)
UNION ALL SELECT DISTINCT c_custkey, 'edge', NULL, z.source, z.target FROM z JOIN l USING (source, target)"""
)
def q19_citations(spark, sf_dir):
    n, e = _places(spark, sf_dir)
    key = lambda c: F.col(c).cast("string")
    nation, other, region = key("c_nationkey"), (F.col("c_custkey") % 9).cast("string"), (F.col("c_custkey") % 7).cast("string")
    said = F.concat(
        F.lit("[edge:r"), region, F.lit("->n"), nation, F.lit(":contains] see [n"), nation, F.lit("] and [node: r"), other, F.lit(" ], [node:n"), nation,
        F.lit("], [node:n"), nation, F.lit("] [edge:n"), nation, F.lit("->r0:contains]"),
    )
    answers = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), said.alias("text"))
    return M.citations(answers, n, e).select("answer_id", "kind", "node_id", "source", "target")


@_query(
    _PLACES
    + """, h AS (SELECT 'n' || s_nationkey AS id, min(s_suppkey) AS rank FROM supplier GROUP BY 1),
f AS (SELECT id, row_number() OVER (ORDER BY rank, id) - 1 AS ordinal FROM h),
t AS (SELECT *, row_number() OVER (ORDER BY source, target, type) - 1 AS ordinal FROM l WHERE source IN (SELECT id FROM h) OR target IN (SELECT id FROM h))
SELECT 'node' AS kind, ordinal, id AS node_id, NULL AS source, NULL AS target, NULL AS type FROM f WHERE ordinal < 5
UNION ALL SELECT 'edge', ordinal, NULL, source, target, type FROM t WHERE ordinal < 3"""
)
def q19_fallback(spark, sf_dir):
    hits = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("id"), F.col("s_suppkey").alias("rank"))
    found = M.fallback_citations(hits, *_places(spark, sf_dir))
    return found.withColumn("ordinal", F.col("ordinal").cast("long"))


@_query("""
SELECT event_id, round(CAST(json_extract(props, '$.k') AS DOUBLE) / 100, 6) AS confidence FROM events
WHERE CAST(json_extract(props, '$.k') AS DOUBLE) / 100 BETWEEN 0.5 AND 1""")
def q20_confidence(spark, sf_dir):
    k = F.from_json("props", "k double")["k"] / 100
    return _t(spark, sf_dir, "events").select("event_id", F.round(k, 6).alias("confidence")).where(k.between(0.5, 1))


@_query(
    GRAPH
    + """, bl AS (SELECT source, target, CASE WHEN source = 'orders::7' THEN 'unknown' ELSE type END AS type,
                  CASE WHEN target LIKE 'part::%9' THEN 'extracted' ELSE provenance END AS provenance, evidence FROM links),
bn AS (SELECT id FROM nodes WHERE id NOT LIKE 'part::%3')
SELECT 'edge_type' AS rule, source || ' -> ' || target AS what FROM bl WHERE type = 'unknown'
UNION ALL SELECT 'related_to', source || ' -> ' || target FROM bl WHERE type = 'related_to' AND provenance <> 'inferred'
UNION ALL SELECT 'claim_provenance', source || ' -> ' || target FROM bl WHERE type = 'depends_on' AND provenance <> 'inferred'
UNION ALL SELECT 'dangling_target', source || ' -> ' || target FROM bl WHERE target NOT IN (SELECT id FROM bn)
UNION ALL SELECT 'concept', id FROM nodes WHERE id LIKE 'part::%5'"""
)
def q21_violations(spark, sf_dir):
    n = nodes(spark, sf_dir, _mark).where(~_named("id").like("part::%3"))
    n = n.withColumn("name", F.when(_named("id").like("part::%5"), F.lit(" ")).otherwise(F.col("name")))
    e = marked_links(spark, sf_dir)
    e = e.withColumn("type", F.when(_named("source") == "orders::7", F.lit("unknown")).otherwise(F.col("type")))
    e = e.withColumn("provenance", F.when(_named("target").like("part::%9"), F.lit("extracted")).otherwise(F.col("provenance")))
    return M.violations(n, e, _named)


@_query(
    GRAPH
    + r"""SELECT 1 AS section, '  "' || id || '" [label="' || id || '\n(' || type || ')"];' AS line FROM nodes
UNION ALL SELECT 2, '  "' || source || '" -> "' || target || '" [label="' || type || '"];' FROM links"""
)
def q22_dot(spark, sf_dir):
    return M.dot_lines(nodes(spark, sf_dir), links(spark, sf_dir)).drop("ord")


@_query("""
WITH names AS (SELECT 'customer::' || c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS file, c_mktsegment || (c_custkey % 40) AS name FROM customer),
calls AS (SELECT 'supplier::' || s_suppkey AS caller, CAST(s_nationkey AS VARCHAR) AS file, m.seg || (s_suppkey % 40) AS name
          FROM supplier, (SELECT DISTINCT c_mktsegment AS seg FROM customer) m),
loc AS (SELECT file, name, min(id) AS near FROM names GROUP BY file, name HAVING count(*) = 1),
glo AS (SELECT name, min(id) AS far FROM names GROUP BY name HAVING count(*) = 1)
SELECT caller, coalesce(near, far) AS target FROM calls LEFT JOIN loc USING (file, name) LEFT JOIN glo USING (name) WHERE coalesce(near, far) IS NOT NULL""")
def q23_calls(spark, sf_dir):
    customer, supplier = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier")
    name = lambda seg, key: F.concat(seg, (F.col(key) % 40).cast("string"))
    names = customer.select(_key("customer", "c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("file"), name(F.col("c_mktsegment"), "c_custkey").alias("name"))
    segments = F.broadcast(customer.select("c_mktsegment").distinct())  # the table's few segments
    calls = supplier.join(segments, F.lit(True)).select(
        _key("supplier", "s_suppkey").alias("caller"), F.col("s_nationkey").cast("string").alias("file"), name(F.col("c_mktsegment"), "s_suppkey").alias("name")
    )
    return E.local_then_global(calls, names)


@_query(r"""
SELECT page_id, len(regexp_extract_all(html, '<h1[ >]')) AS n_headings, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS heading FROM pages""")
def q24_headings(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages")
    return pages.select(
        "page_id", F.regexp_count("html", F.lit("<h1[ >]")).cast("long").alias("n_headings"), F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1).alias("heading")
    )


@_query("""
WITH r AS (SELECT 'c' || o_custkey AS source, o_orderpriority AS target, o_orderstatus AS type, o_orderkey AS ord FROM orders)
SELECT source, target, type, ord FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY ord DESC) AS rn FROM r) WHERE rn = 1""")
def q25_last_link(spark, sf_dir):
    """What a load makes of ordered pairs that a document holds again and again."""
    orders = _t(spark, sf_dir, "orders")
    made = orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.col("o_orderpriority").alias("target"), F.col("o_orderstatus").alias("type"), F.col("o_orderkey").alias("ord"))
    return E.last_link_wins(made)


_SUFFIXES = (".py", ".PY", ".pyw", ".ts", ".tsx", ".mjs", ".go", ".rs", ".hpp", ".sql", ".java", ".md", "", ".tar.gz", ".cc")


@_query(
    "WITH s AS (SELECT ["
    + ", ".join(f"'{x}'" for x in _SUFFIXES)
    + """] AS s), f AS (SELECT p_partkey, 'src/' || p_size || CASE WHEN p_partkey % 5 = 0 THEN '/' ELSE '/a' END || s.s[p_partkey % 15 + 1] AS id FROM part, s),
x AS (SELECT p_partkey, regexp_extract(regexp_extract(id, '[^/]*$'), '.(\\.[^.]+)$', 1) AS x FROM f)
SELECT p_partkey, CASE WHEN x IN ('.py', '.pyw') THEN 'python' WHEN x IN ('.ts', '.tsx') THEN 'typescript' WHEN x = '.mjs' THEN 'javascript' WHEN x = '.go' THEN 'go' WHEN x = '.rs' THEN 'rust'
  WHEN x IN ('.hpp', '.cc') THEN 'cpp' WHEN x = '.sql' THEN 'sql' WHEN x = '.java' THEN 'java' END AS language FROM x"""
)
def q26_languages(spark, sf_dir):
    suffix = F.element_at(F.array(*[F.lit(x) for x in _SUFFIXES]), (F.col("p_partkey") % 15 + 1).cast("int"))
    name = F.concat(F.lit("src/"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 5 == 0, "/").otherwise("/a"), suffix)
    return _t(spark, sf_dir, "part").select("p_partkey", S.language(name).alias("language"))


@_query("""
WITH v AS (SELECT o_orderpriority AS kind, CAST(o_custkey AS VARCHAR) AS key, CAST(o_orderkey AS VARCHAR) AS payload, o_orderkey AS ord FROM orders)
SELECT kind, key, payload FROM (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY ord DESC) AS rn FROM v) WHERE rn = 1""")
def q27_cache_upsert(spark, sf_dir):
    """A cache after all orders were put into it, in two lots."""
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").cast("string").alias("payload"), F.col("o_orderkey").alias("ord"))
    middle = F.col("ord") % 2 == 0
    return M.cache_upsert(rows.where(middle), rows.where(~middle)).select("kind", "key", "payload")


@_query("""
WITH f AS (SELECT 'doc/' || p_partkey || '/' || p_brand || (p_size % 40) || '.md' AS id, lower(p_brand || (p_size % 40)) AS stem FROM part),
u AS (SELECT stem, min(id) AS target FROM f GROUP BY stem HAVING count(DISTINCT id) = 1),
m AS (SELECT DISTINCT 'img/' || upper(p_brand) || p_size || '.png' AS source, lower(p_brand) || p_size AS stem FROM part)
SELECT source, target FROM m JOIN u USING (stem)""")
def q28_media_stems(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    named = F.concat("p_brand", (F.col("p_size") % 40).cast("string"))
    files = part.select(F.concat(F.lit("doc/"), F.col("p_partkey").cast("string"), F.lit("/"), named, F.lit(".md")).alias("id"))
    media = part.select(F.concat(F.lit("img/"), F.upper("p_brand"), F.col("p_size").cast("string"), F.lit(".png")).alias("id")).distinct()
    return L.same_stem(media, files)


@_query(
    GRAPH
    + """SELECT n.id, n.type, coalesce(o.n, 0) AS links_out, coalesce(i.n, 0) AS links_in FROM nodes n
LEFT JOIN (SELECT source AS id, count(*) AS n FROM links GROUP BY source) o USING (id) LEFT JOIN (SELECT target AS id, count(*) AS n FROM links GROUP BY target) i USING (id)"""
)
def q29_evidence(spark, sf_dir):
    """What a summary says of a node: its links to both sides."""
    return E.degrees(nodes(spark, sf_dir), settled_links(spark, sf_dir)).select("id", "type", "links_out", "links_in")


@_query("""
WITH a AS (SELECT p_partkey, p_brand, p_size, unnest(['s' || (p_partkey % 150), 's' || p_size]) AS target FROM part),
f AS (SELECT p_partkey, p_brand, p_size, min(target) AS target FROM (SELECT DISTINCT * FROM a WHERE target IN (SELECT 's' || s_suppkey FROM supplier)) GROUP BY ALL HAVING count(*) = 1),
e AS (SELECT 's' || (p_partkey % 100) AS target, p_brand || (p_size % 7) AS name, 'part::' || p_partkey AS id FROM part),
y AS (SELECT f.p_partkey, min(e.id) AS id FROM f JOIN e ON e.target = f.target AND e.name = p_brand || (f.p_size % 5) GROUP BY f.p_partkey HAVING count(*) = 1)
SELECT 'f' || p_partkey AS source, coalesce(y.id, f.target) AS target FROM f LEFT JOIN y USING (p_partkey)""")
def q30_imports(spark, sf_dir):
    """Parts as statements with two candidate files each, suppliers as files, parts as their symbols."""
    part, supplier = _t(spark, sf_dir, "part"), _t(spark, sf_dir, "supplier")
    text = lambda c: c.cast("string")
    named = lambda n: F.concat("p_brand", text(F.col("p_size") % n))
    at = lambda n: F.concat(F.lit("s"), text(F.col("p_partkey") % n))
    facts = part.select(
        F.concat(F.lit("f"), text(F.col("p_partkey"))).alias("file"), F.lit("import").alias("fact"), F.col("p_partkey").cast("int").alias("seq"),
        F.array(named(5)).alias("names"), F.array(at(150), F.concat(F.lit("s"), text(F.col("p_size")))).alias("candidates"),
    )
    files = supplier.select(F.concat(F.lit("s"), text(F.col("s_suppkey"))).alias("id"), F.lit("file").alias("type"))
    symbols = part.select(at(100).alias("file"), named(7).alias("name"), _key("part", "p_partkey").alias("id"))
    return api._imports(facts, files, symbols).select("source", "target")


@_query(r"""
WITH d AS (SELECT 'd' || doc_id AS file, text, trim(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '-') AS a, trim(regexp_replace(lower(lang), '[^a-z0-9]+', '-', 'g'), '-') AS b,
  (doc_id % 10) / 10.0::DOUBLE AS ca, (doc_id % 7) / 6.0::DOUBLE AS cb FROM documents WHERE trim(substr(text, 1, 30), ' ' || chr(9) || chr(10) || chr(13)) <> '' AND source IS NOT NULL AND lang IS NOT NULL),
e AS (SELECT file AS source, 'concept::' || a AS target, 0 AS stage, 'mentions' AS type, 'extracted' AS provenance FROM d WHERE ca >= 0.5
  UNION ALL SELECT file, 'concept::' || b, 1, 'depends_on', 'inferred' FROM d WHERE cb >= 0.5)
SELECT source, target, type, provenance FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY stage) AS rn FROM e) WHERE rn = 1""")
def q31_replies(spark, sf_dir):
    """Replies that name the source of every document as a concept and its language as what it needs."""
    docs = _t(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "*")
    nodes = docs.select("id", F.lit("file").alias("type"))
    none = spark.createDataFrame([], "source string, target string, type string, provenance string, confidence double")
    seen = F.substring("text", 1, 30).alias("evidence")
    entity = F.struct(F.col("source").alias("name"), seen, ((F.col("doc_id") % 10) / 10.0).alias("confidence"))
    relation = F.struct(F.lit("depends_on").alias("type"), F.col("id").alias("subject"), F.col("lang").alias("object"), seen, ((F.col("doc_id") % 7) / 6.0).alias("confidence"))
    replies = docs.where("source is not null and lang is not null").select(F.col("id").alias("file"), F.to_json(F.struct(F.array(entity).alias("entities"), F.array(relation).alias("relations"))).alias("payload"), F.col("text").alias("chunk"))
    return N.apply_replies(nodes, none, replies)[1].select("source", "target", "type", "provenance")
