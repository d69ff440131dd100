"""Queries of chunking, retrieval lanes, fusion and delivery."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import paths, vectors
from corpusloom.functions import text as tx
from corpusloom.operators import delivery, lanes, rank
from corpusloom.plans.book import EDGES, FILES, Book, Tables

BOOK = q = Book()

QUERY = "licensed under version stupid moron"
PATHS = "src3 en src0 md doc src3"
NOW = 1_735_689_600_000
TERMS = "('licensed'), ('under'), ('version'), ('stupid'), ('moron')"
TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
BM25 = f"""tokenised AS (SELECT doc_id, chunk_id, filepath, {TOKENS} AS t FROM files),
stats AS (SELECT count(*) AS n, avg(len(t)) AS a FROM tokenised),
terms(term) AS (VALUES {TERMS}),
tf AS (SELECT chunk_id, filepath, term, len(t) AS dl, len(list_filter(t, lambda x: x = term)) AS tf FROM tokenised, terms),
df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term),
bm25 AS (SELECT chunk_id, filepath, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 9) AS score
  FROM tf JOIN df USING (term), stats WHERE tf > 0 GROUP BY chunk_id, filepath),
fts AS (SELECT filepath, chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS rank FROM bm25 QUALIFY rank < 80)"""
PATH_TERMS = "[" + ", ".join(f"'{t}'" for t in ("src3", "src0", "doc", "src3")) + "]"
PATH_HITS = rf"len(list_filter({PATH_TERMS}, lambda t: list_contains(string_split(regexp_replace(lower(filepath), '[^\p{{L}}\p{{N}}]', ' ', 'g'), ' '), t)))"
PATH = f"""hits AS (SELECT filepath, min(chunk_id) AS chunk_id, max({PATH_HITS}) AS hits FROM files GROUP BY filepath HAVING max({PATH_HITS}) >= 2),
path_lane AS (SELECT filepath, chunk_id, hits, row_number() OVER (ORDER BY hits DESC, filepath) - 1 AS rank FROM hits QUALIFY rank < 80)"""
ERROR = "(starts_with(lower(regexp_replace(text, '^\\s+', '')), '<html') AND strlen(text) < 2048 AND (contains(lower(text), '403 forbidden') OR contains(lower(text), '404 not found') OR contains(lower(text), '502 bad gateway') OR contains(lower(text), 'openresty')))"


def nine(name: str):
    return F.round(name, 9).alias(name)


@q("chk01_windows", rf"""WITH {FILES}, p AS (SELECT doc_id, regexp_extract_all(text, '\S+\s*') AS w FROM files),
n AS (SELECT doc_id, w, len(w) AS n, CASE WHEN len(w) <= 200 THEN 1 ELSE CAST(ceil((len(w) - 200) / 170.0) AS INT) + 1 END AS k FROM p WHERE len(w) > 0),
c AS (SELECT doc_id, w, unnest(range(k)) AS ord FROM n)
SELECT doc_id, ord, md5(regexp_replace(array_to_string(w[ord * 170 + 1 : ord * 170 + 200], ''), '\s+$', '')) AS chunk_md5 FROM c""")
def _(t: Tables):
    return tx.windows(t.files.select("doc_id", "text")).select("doc_id", F.col("ord").cast("long").alias("ord"), F.md5("chunk").alias("chunk_md5"))


@q("chk02_head", "SELECT doc_id, strlen(t) AS bytes, md5(t) AS head_md5 FROM (SELECT doc_id, CASE WHEN strlen(text) <= 1048576 THEN text ELSE left(text, 1048576) END AS t FROM documents)")
def _(t: Tables):
    head = tx.head(F.col("text"))
    return t.documents.select("doc_id", F.octet_length(head).cast("long").alias("bytes"), F.md5(head).alias("head_md5"))


@q("chk04_joined_chunks", "SELECT conv_id AS filepath, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, text)) AS text_md5 FROM conversations GROUP BY conv_id")
def _(t: Tables):
    chunks = t.conversations.select(F.col("conv_id").alias("filepath"), F.col("turn").alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
    return tx.joined_chunks(chunks).select("filepath", F.md5("text").alias("text_md5"))


@q("chk05_graph_blob", """WITH b AS (SELECT concat('/', user_id) AS filepath, string_agg(concat(chr(10), event_type, ' ', props), '' ORDER BY event_id) AS s FROM events GROUP BY user_id)
SELECT filepath, md5(left(s, 6000)) AS blob_md5 FROM b""")
def _(t: Tables):
    chunks = t.events.select(F.concat(F.lit("/"), F.col("user_id").cast("string")).alias("filepath"), F.col("event_id").alias("chunk_id"), F.concat_ws(" ", "event_type", "props").alias("text"))
    return tx.graph_blob(chunks).select("filepath", F.md5("blob").alias("blob_md5"))


@q("chk03_stitch")
def _(t: Tables):
    chunks = tx.windows(t.files.select("filepath", "text")).select("filepath", "ord", F.col("chunk").alias("text"))
    return tx.stitched(chunks).select("filepath", F.md5("text").alias("text_md5"))


@q("chk06_paragraphs")
def _(t: Tables):
    return tx.packed_paragraphs(t.documents.select("doc_id", "text"), most=1500).select("doc_id", "ord", F.md5("passage").alias("passage_md5"))


@q("chk08_content_key", "SELECT doc_id, sha256(concat(source, chr(0), lang, chr(0), coalesce(text, ''))) AS key FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", tx.content_key(F.col("source"), F.col("lang"), F.coalesce("text", F.lit(""))).alias("key"))


@q("chk07_weave", "SELECT doc_id, md5(CASE WHEN trim(coalesce(lang, '')) = '' THEN coalesce(text, '') ELSE concat(lang, chr(10), coalesce(text, '')) END) AS woven_md5 FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.md5(tx.weave(F.col("lang"), F.coalesce("text", F.lit("")))).alias("woven_md5"))


@q("chk10_line_range", "SELECT conv_id, turn, CAST(1 AS BIGINT) AS first, 1 + len(t) - len(replace(t, chr(10), '')) AS last FROM (SELECT conv_id, turn, rtrim(coalesce(text, ''), chr(10)) AS t, text FROM conversations) WHERE text <> ''")
def _(t: Tables):
    span = tx.line_range(F.concat("text", F.lit("\nend")), F.col("text"))
    return t.conversations.where("text <> ''").select("conv_id", "turn", span.alias("r")).select("conv_id", "turn", "r.first", "r.last")


@q("fil01_scope", f"WITH {FILES} SELECT filepath FROM files WHERE starts_with(filepath, '/src0/en/')")
def _(t: Tables):
    return t.files.where(paths.in_scope(F.col("filepath"), "/src0/en/")).select("filepath")


@q("fil03_code_path", f"WITH {FILES} SELECT filepath, lower(regexp_extract(filepath, '[.]([^./]*)$', 1)) IN ('rs', 'py', 'go', 'c', 'sql') AS is_code FROM files")
def _(t: Tables):
    return t.files.select("filepath", paths.is_code(F.col("filepath")).alias("is_code"))


@q("fil06_error_pages", f"SELECT page_id, {ERROR.replace('text', 'html')} AS is_error FROM pages")
def _(t: Tables):
    return t.pages.select("page_id", paths.is_error_page(F.col("html")).alias("is_error"))


@q("fil09_normalise", "SELECT page_id, regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/+$', '') AS path FROM pages")
def _(t: Tables):
    raw = F.concat(F.lit("//x/../"), F.regexp_extract("url", "://([^?#]*)", 1), F.lit("/./y/.."))
    return t.pages.select("page_id", F.ltrim(paths.normalised(raw), F.lit("/")).alias("path"))


@q("fil10_top_dirs", f"WITH {FILES} SELECT regexp_extract(filepath, '^(/[^/]+)/', 1) AS dir, count(*) AS n FROM files GROUP BY 1")
def _(t: Tables):
    return t.files.groupBy(paths.top_dir(F.col("filepath")).alias("dir")).agg(F.count("*").alias("n"))


@q("fil11_file_type", f"WITH {FILES} SELECT CASE WHEN filepath LIKE '%.py' THEN 'code' ELSE 'document' END AS file_type, count(*) AS n FROM files GROUP BY 1")
def _(t: Tables):
    return t.files.groupBy(paths.file_type(F.col("filepath")).alias("file_type")).agg(F.count("*").alias("n"))


@q("fil13_good_entity", "SELECT p_partkey, length(trim(p_name)) BETWEEN 2 AND 30 AND regexp_matches(p_name, '[A-Za-z]') AS good FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", paths.good_entity(F.col("p_name")).alias("good"))


@q("src10_refusals", "SELECT conv_id, turn, NOT regexp_matches(lower(left(trim(text), 64)), 'sorry|i can''t|i cannot|i can not|i''m unable|i am unable|unable to transcribe|contains no text|there is no text') AND trim(text) <> '' AS kept FROM conversations WHERE text IS NOT NULL")
def _(t: Tables):
    return t.conversations.where("text IS NOT NULL").select("conv_id", "turn", tx.refused(F.col("text")).isNotNull().alias("kept"))


@q("ret04_bm25_top80", f"WITH {FILES}, {BM25} SELECT filepath, score, rank FROM fts")
def _(t: Tables):
    return lanes.bm25(t.files, QUERY).select("filepath", nine("score"), F.col("rank").cast("long").alias("rank"))


@q("ret05_all_terms", f"WITH {FILES}, {BM25}, every AS (SELECT chunk_id FROM tf WHERE term IN ('licensed', 'under') GROUP BY chunk_id HAVING min(tf) > 0) SELECT filepath FROM files JOIN every USING (chunk_id) ")
def _(t: Tables):
    return lanes.bm25(t.files, "licensed under", match="all", top=None).select("filepath")


@q("ret06_path_tokens", f"WITH {FILES}, {PATH} SELECT filepath, hits, rank FROM path_lane")
def _(t: Tables):
    return lanes.path_lane(t.files, PATHS).select("filepath", F.col("hits").cast("long").alias("hits"), F.col("rank").cast("long").alias("rank"))


@q("ret07_path_pins", f"WITH {FILES}, {PATH} SELECT filepath FROM hits WHERE hits = (SELECT max(hits) FROM hits) ORDER BY filepath LIMIT 2")
def _(t: Tables):
    return lanes.path_pins(lanes.path_lane(t.files, PATHS, top=None))


@q("ret08_integrity", "SELECT url AS filepath FROM pages WHERE url LIKE '%.html' GROUP BY url")
def _(t: Tables):
    return lanes.integrity_lane(t.pages.select(F.col("url").alias("filepath"), F.col("page_id").alias("chunk_id"), F.when(F.endswith("url", F.lit(".html")), "  <html><body>404 Not Found</body>").otherwise(F.col("html")).alias("text")), "example").select("filepath")


@q("ret10_representatives", f"WITH {FILES}, {BM25}, d AS (SELECT *, min(chunk_id) OVER (PARTITION BY lang) AS f FROM files) SELECT d.lang AS filepath, coalesce(max_by(b.chunk_id, b.score * 1e9 - b.chunk_id * 1e-6) , min(f)) AS chunk_id FROM d LEFT JOIN bm25 b ON b.chunk_id = d.chunk_id GROUP BY d.lang")
def _(t: Tables):
    return lanes.best_chunk(t.files.select(F.col("lang").alias("filepath"), "chunk_id", "text"), QUERY)


def _query_vector(t: Tables) -> list[float]:
    return t.embeddings.where("vec_id = 0").first()["embedding"]


DISTANCE = "sqrt(list_sum(list_transform(list_zip(embedding, q), lambda x: pow(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE), 2))))"
COSINE = "list_sum(list_transform(list_zip(a, b), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) / sqrt(list_sum(list_transform(a, lambda x: pow(CAST(x AS DOUBLE), 2))) * list_sum(list_transform(b, lambda x: pow(CAST(x AS DOUBLE), 2))))"
VECTOR0 = "v AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"


@q("ret01_knn_l2", f"WITH {VECTOR0} SELECT vec_id, round({DISTANCE}, 9) AS distance FROM embeddings, v ORDER BY {DISTANCE}, vec_id LIMIT 80")
def _(t: Tables):
    return lanes.nearest(t.embeddings, _query_vector(t), key="vec_id").select("vec_id", nine("distance"))


@q("ret01_knn_scoped", f"WITH {VECTOR0} SELECT vec_id, round({DISTANCE}, 9) AS distance FROM embeddings, v WHERE label = 3 ORDER BY {DISTANCE}, vec_id LIMIT 80")
def _(t: Tables):
    return lanes.nearest(t.embeddings, _query_vector(t), key="vec_id", where=F.col("label") == 3).select("vec_id", nine("distance"))


@q("ret02_knn_cosine", f"WITH {VECTOR0}, s AS (SELECT vec_id, embedding AS a, q AS b FROM embeddings, v) SELECT vec_id, round(1 - {COSINE}, 9) AS distance FROM s ORDER BY 1 - {COSINE}, vec_id LIMIT 80")
def _(t: Tables):
    return lanes.nearest(t.embeddings, _query_vector(t), key="vec_id", metric="cosine").select("vec_id", nine("distance"))


@q("ret03_knn_code", f"WITH {VECTOR0} SELECT vec_id, CAST(row_number() OVER (ORDER BY {DISTANCE}, vec_id) - 1 AS INT) AS rank FROM embeddings, v WHERE label % 2 = 1 QUALIFY rank < 80")
def _(t: Tables):
    code = t.embeddings.withColumn("lane", F.when(F.col("label") % 2 == 1, "code").otherwise("text"))
    return lanes.nearest(code, _query_vector(t), key="vec_id", where=F.col("lane") == "code").select("vec_id", "rank")


@q("ret09_candidate_lane", f"WITH {FILES}, c AS (SELECT filepath, row_number() OVER (ORDER BY length(text) DESC, filepath) - 1 AS rank FROM files) SELECT filepath, rank, doc_id AS chunk_id FROM c JOIN files USING (filepath)")
def _(t: Tables):
    longest = lanes.ranked(t.files.withColumn("n", F.length("text")), F.desc("n"), F.col("filepath"), top=1 << 30)
    return lanes.candidate_lane(longest.select("filepath", "rank"), t.files).select("filepath", F.col("rank").cast("long").alias("rank"), "chunk_id")


@q("ret11_sparse", "SELECT l_orderkey AS key, round(sum(l_quantity * s_acctbal), 4) AS score FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey")
def _(t: Tables):
    weights = t.lineitem.select(F.col("l_orderkey").alias("key"), F.col("l_suppkey").alias("term"), F.col("l_quantity").alias("weight"))
    return lanes.sparse_scores(weights, t.supplier.select(F.col("s_suppkey").alias("term"), F.col("s_acctbal").alias("weight"))).select("key", F.round("score", 4).alias("score"))


@q("ret12_two_indices", """WITH r AS (SELECT 'a' AS lane, user_id AS filepath, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM events
UNION ALL SELECT 'b', user_id, row_number() OVER (ORDER BY ts, event_id) FROM events), b AS (SELECT lane, filepath, min(rank) AS rank FROM r GROUP BY ALL)
SELECT filepath, round(sum(1.0 / (60 + rank)), 9) AS score FROM b GROUP BY filepath ORDER BY round(sum(1.0 / (60 + rank)), 12) DESC, filepath LIMIT 10""")
def _(t: Tables):
    own = t.events.withColumnRenamed("user_id", "filepath")
    a = lanes.ranked(own, F.desc("value"), F.col("event_id"), top=1 << 30, lane="a")
    b = lanes.ranked(own, F.col("ts"), F.col("event_id"), top=1 << 30, lane="b")
    rows = a.unionByName(b).select("lane", "filepath", (F.col("rank") + 1).alias("rank"))
    return lanes.merged_ranks(rows).select("filepath", nine("score"))


RRF = """lanes AS (SELECT 'fts' AS lane, filepath, rank FROM fts UNION ALL SELECT 'path', filepath, rank FROM path_lane),
rrf AS (SELECT filepath, round(sum(1.0 / (60 + r)), 12) AS score FROM (SELECT filepath, lane, min(rank) AS r FROM lanes GROUP BY ALL) GROUP BY filepath)"""


def _lanes(t: Tables):
    columns = ["lane", "filepath", "chunk_id", "text", "rank"]
    return lanes.bm25(t.files, QUERY).withColumn("lane", F.lit("fts")).select(columns).unionByName(lanes.path_lane(t.files, PATHS).withColumn("lane", F.lit("path")).select(columns))


@q("rnk01_rrf_files", f"WITH {FILES}, {BM25}, {PATH}, {RRF} SELECT filepath, round(score, 9) AS score, row_number() OVER (ORDER BY score DESC, filepath) - 1 AS rank FROM rrf QUALIFY rank < 10")
def _(t: Tables):
    """Minimum slice: keyword and path lanes, fused, the first ten."""
    hits = rank.fused(_lanes(t))
    return lanes.ranked(hits, *rank.by_score(), top=10).select("filepath", nine("score"), F.col("rank").cast("long").alias("rank"))


@q("rnk02_priors", f"WITH {FILES}, {BM25}, {PATH}, {RRF} SELECT filepath, round(score + least(greatest(length(text) / 10000.0, 0), 0.15), 9) AS score FROM rrf JOIN files USING (filepath)")
def _(t: Tables):
    own = t.files.select("filepath", (F.length("text") / 10000.0).alias("prior"))
    return rank.with_priors(rank.fused(_lanes(t)), own).select("filepath", nine("score"))


@q("rnk03_best_texts", f"WITH {FILES}, {BM25}, {PATH}, l AS (SELECT lang, text, min(rank) AS rank FROM (SELECT filepath, rank FROM fts UNION ALL SELECT filepath, rank FROM path_lane) JOIN files USING (filepath) GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY rank, text) AS i FROM l) SELECT lang AS filepath, md5(string_agg(text, chr(10) ORDER BY i)) AS text_md5 FROM n WHERE i <= 3 GROUP BY lang")
def _(t: Tables):
    own = _lanes(t).drop("text").join(t.files.select("filepath", "lang", "text"), "filepath").select(F.col("lang").alias("filepath"), "text", "rank")
    return rank.best_texts(own, 3).select("filepath", F.md5("text").alias("text_md5"))


@q("rnk05_rerank")
def _(t: Tables):
    hits = rank.fused(_lanes(t)).join(t.files.select("filepath", "text"), "filepath")
    return rank.reranked(hits, lambda c: vectors.overlap_score(QUERY, c)).select("filepath", nine("score"))


@q("rnk07_revalidate", "SELECT l_orderkey AS chunk_id, CAST(l_partkey AS VARCHAR) AS filepath FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size = l_orderkey)")
def _(t: Tables):
    hits = t.lineitem.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").cast("string").alias("filepath"))
    return rank.revalidated(hits, t.part.select(F.col("p_size").cast("long").alias("chunk_id"), F.col("p_partkey").cast("string").alias("filepath")))


@q("rnk08_comention", f"""WITH {EDGES}, hits AS (SELECT concat('/orders/', o_orderkey, '.md') AS filepath, o_totalprice - 250000 AS score FROM orders),
own AS (SELECT DISTINCT from_path, to_path FROM edges WHERE from_path IN (SELECT filepath FROM hits)), shared AS (SELECT to_path FROM own GROUP BY to_path HAVING count(*) > 1),
boosted AS (SELECT DISTINCT from_path FROM own WHERE to_path IN (SELECT to_path FROM shared))
SELECT filepath, round(CASE WHEN filepath NOT IN (SELECT from_path FROM boosted) THEN score WHEN score >= 0 THEN score * 1.05 ELSE score / 1.05 END, 4) AS score FROM hits""")
def _(t: Tables):
    hits = t.orders.select(F.concat(F.lit("/orders/"), "o_orderkey", F.lit(".md")).alias("filepath"), (F.col("o_totalprice") - 250000).alias("score"))
    return rank.comention_boost(hits, t.edges).select("filepath", F.round("score", 4).alias("score"))


@q("rnk09_salience", f"""WITH s AS (SELECT user_id, max(epoch_ms(ts)) AS last_accessed, count(*) AS accesses FROM events GROUP BY user_id)
SELECT user_id AS filepath, round(1 + 0.2 * (pow(0.5, greatest(({NOW} - last_accessed) / 86400000.0, 0) / 14) - 0.5) + 0.05 * ln(1 + accesses), 9) AS salience FROM s""")
def _(t: Tables):
    stats = rank.access_stats(t.events.select(F.col("user_id").alias("filepath"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at")))
    return stats.select("filepath", F.round(rank.salience(F.col("last_accessed"), F.col("accesses"), NOW), 9).alias("salience"))


@q("rnk11_pins_reserve_limit", f"""WITH {FILES}, {PATH}, pins AS (SELECT filepath, 1 AS p FROM hits WHERE hits = (SELECT max(hits) FROM hits) ORDER BY filepath LIMIT 2)
SELECT filepath, CAST(row_number() OVER (ORDER BY p DESC NULLS LAST, length(text) DESC, filepath) - 1 AS BIGINT) AS rank FROM files LEFT JOIN pins USING (filepath) QUALIFY rank < 10""")
def _(t: Tables):
    hits = t.files.select("filepath", F.length("text").cast("double").alias("score"), "text")
    out = rank.final_order(hits, lanes.path_pins(lanes.path_lane(t.files, PATHS, top=None)))
    return out.select("filepath", F.col("rank").cast("long").alias("rank"))


LABELLED = "hits AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS score FROM embeddings)"


@q("dlv01_adaptive_k", f"""WITH {LABELLED}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC) AS i FROM hits),
e AS (SELECT label, count(*) AS n, max(score) AS s1, max(CASE WHEN i = 2 THEN score END) AS s2, greatest(max(score) - min(score), 2.220446049250313e-16) AS spread FROM o GROUP BY label),
r AS (SELECT o.label, count(*) AS run FROM o JOIN e USING (label) WHERE (s1 - score) / spread <= 0.5 GROUP BY o.label)
SELECT label, CAST(CASE WHEN n = 1 OR (s1 - s2) / spread >= 0.3 THEN 1 ELSE least(run, 10) END AS INT) AS k, CASE WHEN n = 1 OR (s1 - s2) / spread >= 0.3 THEN 'answer' ELSE 'cluster' END AS verdict FROM e JOIN r USING (label)""")
def _(t: Tables):
    return delivery.adaptive_k(t.embeddings.select("label", "vec_id", F.col("embedding")[0].cast("double").alias("score")), "label")


@q("dlv03_confidence", f"""WITH {LABELLED}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC) AS i FROM hits),
e AS (SELECT label, count(*) AS n, max(score) AS s1, max(CASE WHEN i = 2 THEN score END) AS s2, min(score) AS sn FROM o GROUP BY label)
SELECT label, CASE WHEN n < 2 OR (CASE WHEN sn < s2 THEN (s1 - s2) / (s1 - sn) >= 0.3 ELSE (s1 - s2) / abs(s1) >= 0.15 END) THEN CASE WHEN label % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END ELSE 'MIXED' END AS confidence FROM e""")
def _(t: Tables):
    hits = t.embeddings.select("label", F.col("embedding")[0].cast("double").alias("s"))
    own = lanes.Window.partitionBy("label").orderBy(F.desc("s"))
    ends = hits.withColumn("i", F.row_number().over(own)).groupBy("label").agg(F.count("*").alias("n"), F.max("s").alias("s1"), F.max(F.when(F.col("i") == 2, F.col("s"))).alias("s2"), F.min("s").alias("sn"))
    return ends.select("label", delivery.confidence(F.col("n"), F.col("s1"), F.col("s2"), F.col("sn"), F.col("label") % 2 == 0).alias("confidence"))


@q("dlv04_render_budget")
def _(t: Tables):
    hits = t.conversations.select("conv_id", F.col("turn").alias("rank"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    return delivery.budgeted(hits, "conv_id", budget=500, per_hit=300, short=50)


@q("dlv06_complete", "SELECT doc_id, strlen(text) <= 8192 AS inlined FROM documents WHERE text IS NOT NULL")
def _(t: Tables):
    return t.documents.where("text IS NOT NULL").select("doc_id", delivery.inlines_whole(F.col("text")).alias("inlined"))


@q("dlv07_session_dedup", """WITH RECURSIVE s AS (SELECT DISTINCT user_id AS session, event_id AS turn, event_type AS path FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY session, path ORDER BY turn) AS i FROM s),
f AS (SELECT session, path, i, turn, turn AS at, CAST(NULL AS BIGINT) AS first_turn FROM o WHERE i = 1
UNION ALL SELECT o.session, o.path, o.i, o.turn, CASE WHEN f.at > o.turn - 400 THEN f.at ELSE o.turn END, CASE WHEN f.at > o.turn - 400 THEN f.at END FROM f JOIN o ON o.session = f.session AND o.path = f.path AND o.i = f.i + 1)
SELECT session, path, turn, first_turn FROM f""")
def _(t: Tables):
    return delivery.session_dedup(t.events.select(F.col("user_id").alias("session"), F.col("event_id").alias("turn"), F.col("event_type").alias("path")), 400)


@q("dlv08_sufficient", "SELECT user_id, count(*) > 0 AND count(CASE WHEN event_type = 'view' THEN 1 END) >= 2 AND count(CASE WHEN event_type = 'view' THEN 1 END) >= 0.2 * count(*) * 3 AS sufficient FROM events GROUP BY user_id")
def _(t: Tables):
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("v")).select("user_id", delivery.sufficient(F.col("n"), F.col("v")).alias("sufficient"))


@q("dlv09_workspace_map")
def _(t: Tables):
    return delivery.workspace_map(t.files.select("filepath", F.length("text").alias("size")))


@q("emb02_hash")
def _(t: Tables):
    return t.benchmark.select("item_id", vectors.HashEmbedder(64).embed(F.col("text")).alias("embedding"))


@q("emb03_bytesum")
def _(t: Tables):
    return t.benchmark.select("item_id", vectors.ByteSumEmbedder().embed(F.col("text")).alias("embedding"))


@q("emb08_cosine", f"WITH s AS (SELECT e.vec_id, e.embedding AS a, f.embedding AS b FROM embeddings e JOIN embeddings f ON f.vec_id = e.vec_id + 1) SELECT vec_id, round({COSINE}, 9) AS cosine FROM s")
def _(t: Tables):
    after = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return t.embeddings.join(after, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("b")), 9).alias("cosine"))
