"""Queries of the remaining predicates, join shapes, ranking steps, extraction and tree operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import paths
from corpusloom.functions import text as tx
from corpusloom.operators import community, delivery, extraction, graph, lanes, maintenance, rank
from corpusloom.plans.book import EDGES, FILES, Book, Tables
from corpusloom.plans.search_queries import QUERY
from corpusloom.sources import files as source

BOOK = q = Book()


@q("fil04_outputs", f"WITH {FILES}, p AS (SELECT CASE WHEN lang = 'de' THEN concat('/model_output', filepath) ELSE filepath END AS filepath FROM files) SELECT filepath FROM p WHERE NOT starts_with(filepath, '/model_output/')")
def _(t: Tables):
    own = t.files.select(F.when(F.col("lang") == "de", F.concat(F.lit("/model_output"), "filepath")).otherwise(F.col("filepath")).alias("filepath"))
    return own.where(~paths.in_output(F.col("filepath")))


@q("fil05_digest", f"WITH {FILES}, p AS (SELECT filepath FROM files UNION ALL SELECT '/KNOWLEDGE_GRAPH.md') SELECT count(*) AS n FROM p WHERE filepath <> '/KNOWLEDGE_GRAPH.md'")
def _(t: Tables):
    own = t.files.select("filepath").unionByName(t.spark.createDataFrame([("/KNOWLEDGE_GRAPH.md",)], "filepath string"))
    return own.where(~paths.is_digest(F.col("filepath"))).agg(F.count("*").alias("n"))


@q("fil07_noise", "SELECT doc_id FROM documents WHERE lang NOT IN ('de', 'fr')")
def _(t: Tables):
    name = F.when(F.col("lang") == "de", "/.Trashes/501/x").when(F.col("lang") == "fr", "/a/._x").otherwise("/a/x.md")
    return t.documents.where(~paths.is_noise(name)).select("doc_id")


@q("fil08_kinds", "SELECT doc_id, doc_id % 4 = 3 AS spreadsheet, doc_id % 4 = 1 AS verbatim, false AS binary_ FROM documents")
def _(t: Tables):
    p = F.concat("filepath", F.lit(paths.EXTRACTED))
    return t.files.select("doc_id", paths.is_spreadsheet(p).alias("spreadsheet"), paths.is_verbatim(p).alias("verbatim"), paths.is_binary(F.col("filepath")).alias("binary_"))


@q("fil15_modes", "SELECT CASE p_size % 3 WHEN 0 THEN 'dir' WHEN 1 THEN 'file' ELSE 'link' END AS kind, count(*) AS n FROM part GROUP BY 1")
def _(t: Tables):
    mode = F.when(F.col("p_size") % 3 == 0, 0o40755).when(F.col("p_size") % 3 == 1, 0o100644).otherwise(0o120777)
    kind = F.when(paths.is_directory(mode), "dir").when(paths.is_regular(mode), "file").when(paths.is_symlink(mode), "link")
    return t.part.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@q("chk09_snippet", "SELECT item_id, CASE WHEN strlen(text) <= 160 THEN translate(text, chr(13) || chr(10), '  ') END AS snippet, strlen(text) > 160 AS cut FROM benchmark")
def _(t: Tables):
    s = tx.snippet(F.col("text"))
    cut = F.endswith(s, F.lit("…"))
    return t.benchmark.select("item_id", F.when(~cut, s).alias("snippet"), cut.alias("cut"))


@q("rnk10_access_log", "SELECT user_id AS filepath, max(event_id) AS last_accessed, count(*) AS accesses FROM events GROUP BY user_id")
def _(t: Tables):
    return rank.access_stats(t.events.select(F.col("user_id").alias("filepath"), F.col("event_id").alias("at")))


@q("rnk14_attach", f"WITH {FILES} SELECT filepath, md5(text) AS document_md5 FROM files ORDER BY length(text) DESC, filepath LIMIT 10")
def _(t: Tables):
    hits = lanes.ranked(t.files.select("filepath", F.length("text").alias("n")), F.desc("n"), F.col("filepath"), top=10)
    return rank.attached(hits, t.files).select("filepath", F.md5("document").alias("document_md5"))


@q("rnk15_annotate", "SELECT page_id, CASE WHEN url LIKE '%.html' THEN concat('[', url, ' is an error page: 404 Not Found]') ELSE 'fine' END AS text FROM pages WHERE url IS NOT NULL")
def _(t: Tables):
    hits = t.pages.where("url IS NOT NULL").select("page_id", F.col("url").alias("filepath"), F.when(F.endswith("url", F.lit(".html")), "<html>404 Not Found").otherwise("fine").alias("text"))
    return rank.annotated(hits).select("page_id", "text")


@q("rnk16_server_profile")
def _(t: Tables):
    from corpusloom.plans.search import Index, search

    return search(Index(t.files.select("chunk_id", "filepath", "text")), "licensed under", profile="server").select("rank", "filepath", F.round("score", 9).alias("score"))


@q("search_local_profile")
def _(t: Tables):
    """The whole search, with keyword, path, integrity and graph lanes, priors, boosts, order and limit."""
    from corpusloom.plans.search import Index, search

    index = Index(t.files.select("chunk_id", "filepath", "text"), edges=t.edges, entities=t.entities, communities=t.communities)
    return search(index, QUERY + " widget").select("rank", "filepath", F.round("score", 9).alias("score"))


@q("rnk17_counters", "SELECT count(*) AS n FROM documents")
def _(t: Tables):
    return extraction.counted(t.documents, "documents").agg(F.count("*").alias("n"))


@q("dlv05_modes", "SELECT event_id, CASE event_type WHEN 'view' THEN 'paths' WHEN 'click' THEN 'two-tier' ELSE 'inline' END AS mode FROM events")
def _(t: Tables):
    return t.events.select("event_id", delivery.render_mode(F.col("event_type") == "view", F.col("event_type") == "click").alias("mode"))


@q("grf01_tokens", "SELECT 'red' AS token UNION ALL SELECT 'widget' UNION ALL SELECT 'über'")
def _(t: Tables):
    return t.spark.createDataFrame([(x,) for x in tx.graph_tokens("Red, widget: RED of über!")], "token string")


@q("grf09_penalty", "SELECT p_partkey, round(least(greatest((p_size * 3 - 24) / 72.0, 0), 1) * 0.03, 9) AS penalty FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", F.round(graph.penalty(F.col("p_size") * 3), 9).alias("penalty"))


@q("grf19_split")
def _(t: Tables):
    groups = graph.shared_files(t.lineitem.select(F.col("l_suppkey").alias("from_path"), F.col("l_partkey").alias("to_path")))
    return community.detect_shared(groups, split=True).groupBy("community").agg(F.count("*").alias("n"))


@q("grf32_python_symbols", """SELECT concat('/src/m', p_partkey, '.py') AS filepath, concat('m', p_partkey, '.C') AS name, 'class' AS kind FROM part UNION ALL SELECT concat('/src/m', p_partkey, '.py'), concat('m', p_partkey, '.C.f'), 'method' FROM part
UNION ALL SELECT concat('/src/m', p_partkey, '.py'), concat('m', p_partkey), 'module' FROM part UNION ALL SELECT concat('/src/m', p_partkey, '.py'), concat('m', p_partkey, '.g'), 'function' FROM part""")
def _(t: Tables):
    code = F.concat(F.lit("import os\nclass C(Base):\n    def f(self):\n        return g("), F.col("p_size").cast("string"), F.lit(")\ndef g(x):\n    return os.path.join(x)\n"))
    return extraction.symbols(t.part.select(F.concat(F.lit("/src/m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("filepath"), code.alias("text"))).select("filepath", "name", "kind")


@q("grf35_names", "SELECT p_partkey, 'c' AS last, concat('doc_', p_partkey) AS module FROM part")
def _(t: Tables):
    key = F.col("p_partkey").cast("string")
    return t.part.select("p_partkey", paths.last_ident(F.concat(F.lit("a.b"), key, F.lit("::c"))).alias("last"), paths.module_of(F.concat(F.lit("/x/doc_"), key, F.lit(".py"))).alias("module"))


@q("joi02_postings", f"WITH {FILES} SELECT chunk_id, filepath FROM files WHERE list_contains(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), 'licensed')")
def _(t: Tables):
    postings = t.files.select("chunk_id", tx.tokens(F.col("text")).alias("t")).where(F.array_contains("t", "licensed")).select("chunk_id")
    return postings.join(t.files.select("chunk_id", "filepath"), "chunk_id")


@q("joi04_semi", "SELECT count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def _(t: Tables):
    return t.documents.join(t.labels.where("quality = 0").select("doc_id"), "doc_id", "left_semi").agg(F.count("*").alias("n"))


@q("joi07_sibling_key", f"WITH {FILES} SELECT f.filepath FROM files f JOIN (SELECT concat(filepath, '.extracted.md') AS s FROM files WHERE lang = 'es') x ON concat(f.filepath, '.extracted.md') = x.s")
def _(t: Tables):
    made = t.files.where("lang = 'es'").select(F.concat("filepath", F.lit(paths.EXTRACTED)).alias("s"))
    return t.files.select("filepath", F.concat("filepath", F.lit(paths.EXTRACTED)).alias("s")).join(made, "s").select("filepath")


@q("joi12_verdicts", "SELECT o_orderkey AS uid, c_mktsegment AS verdict FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment <> 'MACHINERY'")
def _(t: Tables):
    verdicts = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("verdict"))
    return t.orders.join(verdicts, "o_custkey").where("verdict <> 'MACHINERY'").select(F.col("o_orderkey").alias("uid"), "verdict")


@q("agg02_conditional", f"WITH {EDGES} SELECT from_path, sum(CASE WHEN edge_kind = 'A' THEN 1 ELSE 0 END) AS a, count(*) AS n FROM edges GROUP BY from_path HAVING count(*) > 3")
def _(t: Tables):
    return t.edges.groupBy("from_path").agg(F.count_if(F.col("edge_kind") == "A").alias("a"), F.count("*").alias("n")).where("n > 3")


@q("agg09_by_status", "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def _(t: Tables):
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@q("src01_scan")
def _(t: Tables):
    return source.scan(t.spark, t.sf_dir, content=False).select("ino", "filepath", "size")


@q("src14_utf8_gate", "SELECT doc_id, doc_id % 2 = 0 AS valid FROM documents WHERE text <> ''")
def _(t: Tables):
    raw = F.when(F.col("doc_id") % 2 == 0, F.col("text").cast("binary")).otherwise(F.concat(F.col("text").cast("binary"), F.lit(b"\xff")))
    return t.documents.where("text <> ''").select("doc_id", F.is_valid_utf8(raw.cast("string")).alias("valid"))


@q("src15_raw_sibling", "SELECT doc_id, md5(concat(lang, chr(10), text)) AS index_md5, md5(text) AS raw_md5 FROM documents WHERE text IS NOT NULL")
def _(t: Tables):
    own = t.documents.where("text IS NOT NULL")
    return own.select("doc_id", F.md5(tx.weave(F.col("lang"), F.col("text"))).alias("index_md5"), F.md5("text").alias("raw_md5"))


@q("llm01_entities")
def _(t: Tables):
    return extraction.rule_entities(t.documents, "doc_id").groupBy("kind").agg(F.count("*").alias("n"))


@q("llm02_relations")
def _(t: Tables):
    return extraction.rule_relations(t.documents, "doc_id").groupBy("relation").agg(F.count("*").alias("n"))


@q("llm04_compressible", "SELECT doc_id, doc_id % 4 NOT IN (1, 3) AND strlen(text) >= 4096 AS ok FROM documents WHERE text IS NOT NULL")
def _(t: Tables):
    own = t.files.join(t.documents.where("text IS NOT NULL").select("doc_id"), "doc_id", "left_semi")
    return own.select("doc_id", extraction.compressible(True, paths.is_spreadsheet(F.col("filepath")), paths.is_verbatim(F.col("filepath")), F.col("text")).alias("ok"))


@q("dml06_tree_ops", """WITH o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events WHERE event_type IN ('view', 'click'))
SELECT CAST(user_id AS VARCHAR) AS tree, event_id AS seq, CASE WHEN i > 1 THEN 'EEXIST' END AS error FROM o""")
def _(t: Tables):
    own = t.events.where("event_type IN ('view', 'click')")
    op = F.when(F.col("event_type") == "view", "mkdir").otherwise("create")
    ops = own.select(F.col("user_id").cast("string").alias("tree"), F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("/"), "event_type").alias("path"), F.lit(None).cast("string").alias("target"))
    return extraction.applied(ops).select("tree", "seq", "error")


@q("dml09_migrate", "SELECT r_regionkey, r_name, CAST(NULL AS BIGINT) AS size FROM region")
def _(t: Tables):
    from pyspark.sql import types as T

    return extraction.migrated(t.region, T.StructType([T.StructField("r_name", T.StringType()), T.StructField("size", T.LongType())]))


@q("dml11_marked_block", "SELECT item_id, md5(concat(text, chr(10), '<!-- corpus:begin -->', chr(10), 'new', chr(10), '<!-- corpus:end -->', chr(10))) AS text_md5 FROM benchmark")
def _(t: Tables):
    old = extraction.marked_block(F.col("text"), "old")
    return t.benchmark.select("item_id", F.md5(extraction.marked_block(old, "new")).alias("text_md5"))


@q("dml07_blocks_round_trip", "SELECT doc_id AS ino, md5(regexp_replace(coalesce(text, ''), '[^ -~\n]', '?', 'g')) AS data_md5 FROM documents")
def _(t: Tables):
    own = t.documents.select(F.col("doc_id").alias("ino"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~\n]", "?").cast("binary").alias("data"))
    out = maintenance.read_bytes(maintenance.blocks_of(own), own.select("ino", F.octet_length("data").alias("size")))
    return out.select("ino", F.md5("data").alias("data_md5"))


@q("snk03_report_lines")
def _(t: Tables):
    relations = t.nation.select(F.col("n_name").alias("source"), F.col("n_regionkey").cast("string").alias("target"), F.lit("part_of").alias("relation"), F.lit("AMBIGUOUS").alias("confidence"), F.lit(1.0).alias("confidence_score"))
    return graph.report(t.edges, relations, t.entities)
