"""Queries of the file-entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import community, graph
from corpusloom.plans.book import COMMUNITIES, EDGES, ENTITIES, Book, Tables

BOOK = q = Book()
WORDS = "red widget"
MATCHED = f"""{EDGES}, {ENTITIES}, {COMMUNITIES}, tok AS (SELECT 0 AS i, 'red' AS t UNION ALL SELECT 1, 'widget'),
m1 AS (SELECT path, name, i, row_number() OVER (PARTITION BY i ORDER BY length(name), name, path) AS r FROM entities JOIN tok ON contains(lower(name), t) QUALIFY r <= 32),
m2 AS (SELECT path, name, min(i * 100 + r) AS place FROM m1 GROUP BY path, name), matched AS (SELECT path, name FROM m2 ORDER BY place, path LIMIT 32),
own AS (SELECT DISTINCT from_path AS filepath, to_path FROM edges),
direct AS (SELECT filepath, count(*) AS direct FROM own WHERE to_path IN (SELECT path FROM matched) GROUP BY filepath),
related AS (SELECT to_path, count(*) AS files FROM own WHERE filepath IN (SELECT filepath FROM direct) AND to_path NOT IN (SELECT path FROM matched) GROUP BY to_path),
near AS (SELECT filepath, count(*) AS neighbours FROM own WHERE to_path IN (SELECT to_path FROM related) GROUP BY filepath),
sizes AS (SELECT community_id, count(DISTINCT file_path) AS size FROM communities GROUP BY community_id),
weights AS (SELECT community_id, sum(direct) AS weight, any_value(size) AS size FROM communities JOIN direct ON filepath = file_path JOIN sizes USING (community_id) GROUP BY community_id),
scored AS (SELECT community_id, weight, 0.05 * weight / max(weight) OVER () - least(greatest((size - 24) / 72.0, 0), 1) * 0.03 AS s FROM weights)"""


def _matched(t: Tables):
    return graph.matched_entities(t.entities, WORDS)


def nine(name: str):
    return F.round(name, 9).alias(name)


@q("grf02_entity_match", f"WITH {MATCHED} SELECT path, name FROM matched")
def _(t: Tables):
    return _matched(t)


@q("grf03_direct_counts", f"WITH {MATCHED} SELECT filepath, direct FROM direct")
def _(t: Tables):
    return graph.direct_counts(t.edges, _matched(t))


@q("grf04_related", f"WITH {MATCHED} SELECT to_path, files FROM related")
def _(t: Tables):
    return graph.related_entities(t.edges, graph.direct_counts(t.edges, _matched(t)), _matched(t))


@q("grf05_neighbour_counts", f"WITH {MATCHED} SELECT filepath, neighbours FROM near")
def _(t: Tables):
    return graph.neighbour_counts(t.edges, graph.related_entities(t.edges, graph.direct_counts(t.edges, _matched(t)), _matched(t)))


@q("grf08_community_weights", f"WITH {MATCHED} SELECT community_id, weight, size FROM weights")
def _(t: Tables):
    return graph.community_weights(t.communities, graph.direct_counts(t.edges, _matched(t)))


@q("grf06_priors", f"""WITH {MATCHED}, c AS (SELECT file_path AS filepath, greatest(max(s), 0) AS community FROM communities JOIN scored USING (community_id) GROUP BY file_path),
f AS (SELECT concat('/orders/', o_orderkey, '.md') AS filepath FROM orders), x AS (SELECT f.filepath, coalesce(direct, 0) AS d, coalesce(neighbours, 0) AS n, coalesce(community, 0) AS c FROM f LEFT JOIN direct USING (filepath) LEFT JOIN near USING (filepath) LEFT JOIN c USING (filepath)),
p AS (SELECT filepath, least(0.15, 0.08 * d / greatest(max(d) OVER (), 1) + 0.04 * n / greatest(max(n) OVER (), 1) * CASE WHEN d > 0 THEN 1 ELSE 0.5 END + c * CASE WHEN d > 0 THEN 1 ELSE 0.5 END) AS prior FROM x)
SELECT filepath, round(prior, 9) AS prior FROM p WHERE prior > 0""")
def _(t: Tables):
    files = t.orders.select(F.concat(F.lit("/orders/"), "o_orderkey", F.lit(".md")).alias("filepath"))
    return graph.priors(t.edges, t.communities, _matched(t), files).select("filepath", nine("prior"))


@q("grf07_candidates", f"""WITH {MATCHED}, bd AS (SELECT filepath, 0 AS reason, direct FROM direct ORDER BY direct DESC, filepath LIMIT 40), bn AS (SELECT filepath, neighbours FROM near WHERE filepath NOT IN (SELECT filepath FROM direct) ORDER BY neighbours DESC, filepath LIMIT 40),
bc AS (SELECT file_path AS filepath, community_id, row_number() OVER (PARTITION BY community_id ORDER BY file_path) AS r FROM communities QUALIFY r <= 8),
bc2 AS (SELECT filepath, greatest(s, 0) AS score FROM bc JOIN scored USING (community_id) ORDER BY weight DESC, community_id, filepath LIMIT 80),
e AS (SELECT filepath, 0 AS reason, 0.08 * direct / max(direct) OVER () AS score FROM bd UNION ALL SELECT filepath, 1, 0.04 * neighbours / max(neighbours) OVER () FROM bn UNION ALL SELECT filepath, 2, score FROM bc2 WHERE score > 0),
b AS (SELECT filepath, reason, score, row_number() OVER (PARTITION BY filepath ORDER BY score DESC, reason) AS r FROM e)
SELECT filepath, reason, round(score, 9) AS score FROM b WHERE r = 1 ORDER BY round(score, 12) DESC, reason, filepath LIMIT 80""")
def _(t: Tables):
    return graph.candidates(t.edges, t.communities, _matched(t)).select("filepath", "reason", nine("score"))


#: The walk's 30 rounds, unrolled. Each round is materialised, or the planner would expand them in one another.
PPR = """both_ AS MATERIALIZED (SELECT concat('f', from_path) AS a, concat('e', to_path) AS b, count(*) AS n FROM edges GROUP BY ALL), sides AS MATERIALIZED (SELECT a, b, n FROM both_ UNION ALL SELECT b, a, n FROM both_),
deg AS MATERIALIZED (SELECT a, sum(n) AS d FROM sides GROUP BY a), walk AS MATERIALIZED (SELECT a, b, n / d AS p FROM sides JOIN deg USING (a)), st AS MATERIALIZED (SELECT a FROM deg WHERE a IN (SELECT concat('e', path) FROM matched)),
base AS MATERIALIZED (SELECT a, 0.5 / (SELECT count(*) FROM st) AS r FROM st), r0 AS MATERIALIZED (SELECT a, 2 * r AS r FROM base)"""
for _i in range(1, 31):
    PPR += f", r{_i} AS MATERIALIZED (SELECT a, sum(r) AS r FROM (SELECT b AS a, 0.5 * sum(r * p) AS r FROM walk JOIN r{_i - 1} USING (a) GROUP BY b UNION ALL SELECT a, r FROM base) GROUP BY a)"


@q("grf10_ppr", f"WITH {MATCHED}, {PPR}, f AS (SELECT substr(a, 2) AS filepath, r FROM r30 WHERE a LIKE 'f%') SELECT filepath, round(r / (SELECT max(r) FROM f), 9) AS mass FROM f")
def _(t: Tables):
    return graph.pagerank(t.edges, _matched(t)).select("filepath", nine("mass"))


@q("grf11_ppr_prior", f"""WITH {MATCHED}, {PPR}, f AS (SELECT substr(a, 2) AS filepath, r FROM r30 WHERE a LIKE 'f%'), c AS (SELECT concat('/orders/', o_orderkey, '.md') AS filepath FROM orders)
SELECT filepath, round(0.12 * coalesce(r, 0) / (SELECT max(r) FROM f), 9) AS prior, coalesce(r, 0) > 0 AS connected FROM c LEFT JOIN f USING (filepath)""")
def _(t: Tables):
    files = t.orders.select(F.concat(F.lit("/orders/"), "o_orderkey", F.lit(".md")).alias("filepath"))
    return graph.pagerank_prior(graph.pagerank(t.edges, _matched(t)), files).select("filepath", nine("prior"), "connected")


PAIRS = """own AS (SELECT DISTINCT from_path, to_path FROM edges), kept AS (SELECT to_path FROM own GROUP BY to_path HAVING count(*) BETWEEN 2 AND 64),
pairs AS (SELECT x.from_path AS a, y.from_path AS b, count(*) AS w FROM own x JOIN own y ON x.to_path = y.to_path AND x.from_path < y.from_path WHERE x.to_path IN (SELECT to_path FROM kept) GROUP BY ALL)"""


@q("grf12_projection", f"WITH {EDGES}, {PAIRS} SELECT a, b, w FROM pairs")
def _(t: Tables):
    return graph.projection(t.edges)


@q("grf13_knn_edges", """WITH s AS (SELECT x.vec_id AS k, y.vec_id AS n, round(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / sqrt(list_sum(list_transform(x.embedding, lambda z: pow(CAST(z AS DOUBLE), 2)))) / sqrt(list_sum(list_transform(y.embedding, lambda z: pow(CAST(z AS DOUBLE), 2)))), 12) AS c FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id),
t AS (SELECT k, n FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY c DESC, n) <= 6) SELECT DISTINCT least(k, n) AS a, greatest(k, n) AS b FROM t""")
def _(t: Tables):
    return graph.knn_edges(t.embeddings.withColumnRenamed("vec_id", "filepath"))


@q("grf13_densify", """WITH p AS (SELECT l_orderkey AS a, l_partkey AS b, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), n AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_returnflag = 'A')
SELECT a, b, sum(w) AS w FROM (SELECT a, b, w FROM p UNION ALL SELECT a, b, 1.0 FROM n) GROUP BY ALL""")
def _(t: Tables):
    pairs = t.lineitem.select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), "l_quantity", "l_returnflag")
    return graph.densified(pairs.groupBy("a", "b").agg(F.sum("l_quantity").alias("w")), pairs.where("l_returnflag = 'A'").select("a", "b").distinct())


@q("grf14_degrees", f"WITH {EDGES}, {PAIRS} SELECT node, sum(w) AS degree FROM (SELECT a AS node, w FROM pairs UNION ALL SELECT b, w FROM pairs) GROUP BY node")
def _(t: Tables):
    return graph.weighted_degrees(graph.projection(t.edges))


@q("grf16_louvain")
def _(t: Tables):
    return community.detect_shared(_suppliers_of_parts(t), method="louvain", split=False)


@q("grf17_leiden")
def _(t: Tables):
    return community.detect_shared(_suppliers_of_parts(t))


def _suppliers_of_parts(t: Tables):
    return graph.shared_files(t.lineitem.select(F.col("l_suppkey").alias("from_path"), F.col("l_partkey").alias("to_path")))


@q("grf18_connected", "WITH RECURSIVE e AS (SELECT DISTINCT n_regionkey AS r, n_nationkey AS k FROM nation) SELECT CAST(k AS BIGINT) AS node, CAST(min(k) OVER (PARTITION BY r) AS BIGINT) AS component FROM e")
def _(t: Tables):
    n = t.nation.select(F.col("n_nationkey").cast("long").alias("k"), "n_regionkey")
    after = F.lead("k").over(graph.Window.partitionBy("n_regionkey").orderBy("k"))
    return community.components(n.select(F.col("k").alias("a"), after.alias("b")).where("b IS NOT NULL"))


@q("grf20_dense_ids", "WITH s AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), d AS (SELECT c_nationkey, row_number() OVER (ORDER BY n DESC, c_nationkey) - 1 AS id FROM s) SELECT c_custkey AS node, id AS community FROM customer JOIN d USING (c_nationkey)")
def _(t: Tables):
    return graph.dense_ids(t.customer.select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("community"))).select("node", F.col("community").cast("long").alias("community"))


@q("grf21_modularity", f"""WITH {EDGES}, {PAIRS}, {COMMUNITIES}, i AS (SELECT sum(w) AS s FROM pairs JOIN communities x ON x.file_path = a JOIN communities y ON y.file_path = b WHERE x.community_id = y.community_id), m AS (SELECT sum(w) AS m FROM pairs),
d AS (SELECT community_id, sum(w) AS d FROM (SELECT a AS n, w FROM pairs UNION ALL SELECT b, w FROM pairs) JOIN communities ON file_path = n GROUP BY 1)
SELECT round(CAST(i.s AS DOUBLE) / m.m - (SELECT sum(CAST(d AS DOUBLE) * d) FROM d) / (4.0 * m.m * m.m), 9) AS modularity FROM i, m""")
def _(t: Tables):
    part = t.communities.select(F.col("file_path").alias("node"), F.col("community_id").alias("community"))
    return graph.projection_modularity(t.edges, part).select(nine("modularity"))


HUBS = """deg AS (SELECT to_path, count(DISTINCT from_path) AS degree FROM edges GROUP BY to_path), lim AS (SELECT degree AS l FROM (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i, count(*) OVER () AS n FROM deg) WHERE i = CAST(floor((n - 1) * 0.99) AS BIGINT)),
hubs AS (SELECT to_path, degree FROM deg, lim WHERE degree > l)"""


@q("grf22_hubs", f"WITH {EDGES}, {HUBS} SELECT to_path, degree FROM hubs")
def _(t: Tables):
    return graph.hubs(t.edges)


GODS = """own2 AS (SELECT DISTINCT from_path, to_path FROM edges), cnt AS (SELECT community_id, to_path, count(*) AS degree FROM own2 JOIN communities ON file_path = from_path WHERE to_path NOT IN (SELECT to_path FROM hubs) GROUP BY ALL),
gods AS (SELECT community_id, to_path AS entity_path, row_number() OVER (PARTITION BY community_id ORDER BY degree DESC, to_path) - 1 AS rank, degree FROM cnt QUALIFY rank < 4)"""


@q("grf23_god_nodes", f"WITH {EDGES}, {COMMUNITIES}, {HUBS}, {GODS} SELECT community_id, entity_path, rank, degree FROM gods")
def _(t: Tables):
    return graph.god_nodes(t.edges, t.communities, graph.hubs(t.edges)).withColumn("rank", F.col("rank").cast("long"))


@q("grf24_materialise", f"WITH {COMMUNITIES}, s AS (SELECT community_id, count(*) AS n FROM communities GROUP BY 1), o AS (SELECT community_id, row_number() OVER (ORDER BY n DESC, community_id) - 1 AS id FROM s) SELECT file_path, id AS community_id FROM communities JOIN o USING (community_id)")
def _(t: Tables):
    out = graph.dense_ids(t.communities.select(F.col("file_path").alias("node"), F.col("community_id").alias("community")))
    return out.select(F.col("node").alias("file_path"), F.col("community").cast("long").alias("community_id"))


@q("grf25_digest")
def _(t: Tables):
    files = t.orders.select(F.concat(F.lit("/orders/"), "o_orderkey", F.lit(".md")).alias("filepath"))
    return graph.digest(files, t.communities, graph.god_nodes(t.edges, t.communities, graph.hubs(t.edges)))


@q("grf26_graph_json")
def _(t: Tables):
    edges = t.nation.select(F.concat(F.lit("/n/"), "n_name").alias("from_path"), F.concat(F.lit("/r/"), "n_regionkey").alias("to_path"), F.lit("in").alias("edge_kind"), F.lit("INFERRED").alias("confidence"))
    entities = t.region.select(F.concat(F.lit("/r/"), "r_regionkey").alias("path"), F.col("r_name").alias("name"), F.lit("Concept").alias("kind"))
    relations = t.nation.select(F.col("n_name").alias("source"), F.col("n_regionkey").cast("string").alias("target"), F.lit("part_of").alias("relation"))
    return graph.graph_json(edges, entities, relations)


RELATIONS = "rel AS (SELECT CAST(l_orderkey AS VARCHAR) AS source, CAST(l_suppkey AS VARCHAR) AS target, CASE l_returnflag WHEN 'A' THEN 'depends_on' WHEN 'N' THEN 'mentions' ELSE 'causes' END AS relation, CASE WHEN l_linestatus = 'F' THEN 'AMBIGUOUS' ELSE 'INFERRED' END AS confidence, l_extendedprice AS confidence_score FROM lineitem)"


def _relations(t: Tables):
    kind = F.when(F.col("l_returnflag") == "A", "depends_on").when(F.col("l_returnflag") == "N", "mentions").otherwise("causes")
    return t.lineitem.select(F.col("l_orderkey").cast("string").alias("source"), F.col("l_suppkey").cast("string").alias("target"), kind.alias("relation"), F.when(F.col("l_linestatus") == "F", "AMBIGUOUS").otherwise("INFERRED").alias("confidence"), F.col("l_extendedprice").alias("confidence_score"))


@q("grf27_report", f"""WITH {EDGES}, {ENTITIES}, {RELATIONS}, d AS (SELECT 'degree' AS section, to_path AS key, CAST(count(*) AS DOUBLE) AS value FROM edges GROUP BY to_path ORDER BY value DESC, key LIMIT 12),
o AS (SELECT 'surprising' AS section, concat(source, ' -> ', target) AS key, confidence_score AS value FROM rel WHERE relation IN ('depends_on', 'causes') ORDER BY confidence_score DESC, source, target LIMIT 10)
SELECT * FROM d UNION ALL SELECT 'relations', relation, CAST(count(*) AS DOUBLE) FROM rel GROUP BY relation UNION ALL SELECT * FROM o UNION ALL SELECT 'isolated', 'entities', CAST(count(*) AS DOUBLE) FROM entities WHERE path NOT IN (SELECT to_path FROM edges)
UNION ALL SELECT 'ambiguous', 'percent', round(100.0 * sum(CASE WHEN confidence = 'AMBIGUOUS' THEN 1 ELSE 0 END) / count(*), 9) FROM rel""")
def _(t: Tables):
    return graph.report(t.edges, _relations(t), t.entities).withColumn("value", F.round("value", 9))


@q("grf28_topics")
def _(t: Tables):
    return graph.topic_listing(t.communities, graph.god_nodes(t.edges, t.communities, graph.hubs(t.edges)))


@q("grf29_slug", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", tx.slug(F.col("p_name")).alias("slug"))


@q("grf30_clean_relations", f"WITH {RELATIONS}, e AS (SELECT CAST(s_suppkey AS VARCHAR) AS name FROM supplier) SELECT source, target, relation FROM rel WHERE source <> target AND source IN (SELECT name FROM e) AND target IN (SELECT name FROM e)")
def _(t: Tables):
    return graph.clean_relations(_relations(t), t.supplier.select(F.col("s_suppkey").cast("string").alias("name"))).select("source", "target", "relation")


@q("grf31_edge_replace", f"WITH {EDGES}, n AS (SELECT DISTINCT concat('/orders/', o_orderkey, '.md') AS from_path, '/parts/0' AS to_path, o_orderstatus AS edge_kind FROM orders WHERE o_orderstatus = 'F') SELECT * FROM edges WHERE from_path NOT IN (SELECT from_path FROM n) UNION ALL SELECT * FROM n")
def _(t: Tables):
    new = t.orders.where("o_orderstatus = 'F'").select(F.concat(F.lit("/orders/"), "o_orderkey", F.lit(".md")).alias("from_path"), F.lit("/parts/0").alias("to_path"), F.col("o_orderstatus").alias("edge_kind"))
    return graph.replaced_edges(t.edges, new).select("from_path", "to_path", "edge_kind")


@q("grf31_entity_upsert", "SELECT concat('/u/', user_id) AS path, max_by(event_type, event_id) AS name, max(event_id) AS seq FROM events GROUP BY user_id")
def _(t: Tables):
    own = t.events.select(F.concat(F.lit("/u/"), "user_id").alias("path"), F.col("event_type").alias("name"), F.col("event_id").alias("seq"), "value")
    return graph.upserted_entities(own.where("value < 10").drop("value"), own.where("value >= 10 OR value IS NULL").drop("value"))


@q("grf33_nesting", """WITH d AS (SELECT c_nationkey AS file, c_custkey AS name, c_custkey AS s, c_custkey + CAST(abs(c_acctbal) AS BIGINT) % 50 AS e FROM customer), r AS (SELECT file, name AS id, s + 1 AS s, s + 3 AS e FROM d),
x AS (SELECT r.file, r.id, d.name, row_number() OVER (PARTITION BY r.file, r.id ORDER BY d.e - d.s, d.s, d.name) AS k FROM r JOIN d ON d.file = r.file AND d.s <= r.s AND d.e >= r.e AND (d.s < r.s OR d.e > r.e))
SELECT r.file, r.id, x.name AS parent FROM r LEFT JOIN x ON x.file = r.file AND x.id = r.id AND x.k = 1""")
def _(t: Tables):
    d = t.customer.select(F.col("c_nationkey").alias("file"), F.col("c_custkey").alias("name"), F.col("c_custkey").alias("start"), (F.col("c_custkey") + F.pmod(F.rint(F.abs("c_acctbal")).cast("long"), F.lit(50))).alias("end"))
    return graph.enclosing(d, d.select("file", F.col("name").alias("id"), (F.col("start") + 1).alias("start"), (F.col("start") + 3).alias("end")))


def _resolved(t: Tables, refs):
    symbols = t.part.select(F.concat(F.lit("/sym/"), "p_partkey").alias("path"), F.concat(F.lit("a.b."), "p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, "function").otherwise("class").alias("kind"))
    refs = refs.select(F.concat(F.lit("/sym/"), "p_partkey").alias("source"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, "calls").otherwise("inherits").alias("kind"))
    return graph.resolved(refs, symbols).select("source", "target", "relation", "confidence")


@q("grf34_resolve", """WITH s AS (SELECT concat('/sym/', p_partkey) AS target, p_name AS simple, CASE WHEN p_size % 2 = 0 THEN 'function' ELSE 'class' END AS kind FROM part), r AS (SELECT concat('/sym/', p_partkey) AS source, p_name AS simple, CASE WHEN p_size % 3 = 0 THEN 'calls' ELSE 'inherits' END AS relation FROM part)
SELECT DISTINCT source, target, relation, CASE WHEN relation = 'inherits' THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence FROM r JOIN s USING (simple) WHERE source <> target AND kind = CASE WHEN relation = 'calls' THEN 'function' ELSE 'class' END""")
def _(t: Tables):
    return _resolved(t, t.part)


@q("grf36_build_lane", "SELECT doc_id, CASE WHEN doc_id % 4 = 1 AND text IS NOT NULL THEN 'ast' ELSE 'llm' END AS lane FROM documents")
def _(t: Tables):
    return t.files.drop("text").join(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", graph.build_lane(F.col("filepath"), F.col("text").isNotNull()).alias("lane"))


@q("grf37_audit", f"WITH {RELATIONS} SELECT relation, confidence, count(*) AS n FROM rel GROUP BY ALL")
def _(t: Tables):
    return _relations(t).groupBy("relation", "confidence").agg(F.count("*").alias("n"))
