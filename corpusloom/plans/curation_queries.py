"""Queries of corpus curation, evaluation analytics and window-style operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions import vectors
from corpusloom.operators import curation
from corpusloom.plans.book import FILES, Book, Tables

BOOK = q = Book()


def six(name: str):
    return F.round(name, 6).alias(name)


@q("cur01_exact_dedup", "SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text")
def _(t: Tables):
    return curation.exact_dedup(t.documents.where("text IS NOT NULL")).select("doc_id")


@q("cur02_prefix_dedup", "SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY left(text, 120)")
def _(t: Tables):
    return curation.prefix_dedup(t.documents.where("text IS NOT NULL")).select("doc_id")


@q("cur03_split", "WITH s AS (SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS s FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id) AS i FROM s) SELECT doc_id, CASE WHEN s = 'test' AND i > 30 OR s = 'validation' AND i > 20 THEN 'train' ELSE s END AS split FROM r")
def _(t: Tables):
    return curation.quota_split(t.documents.select("doc_id"), "doc_id", {"test": 30, "validation": 20}).select("doc_id", "split")


@q("cur04_grouped_split")
def _(t: Tables):
    return curation.grouped_split(t.documents.select("doc_id", "lang", "source"), "lang", "source", 0.2)


@q("cur05_length_band", "SELECT doc_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents WHERE n_chars BETWEEN 300 AND 1500) WHERE r <= 40")
def _(t: Tables):
    return curation.per_group(curation.length_band(t.documents, "n_chars"), "lang", "doc_id", 40).select("doc_id")


DIGITS = "length(regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g'))"


@q("cur06_density", f"""WITH d AS (SELECT doc_id, lang, {DIGITS} AS digits FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY digits, doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d), x AS (SELECT *, CAST(floor(n * 0.25) AS BIGINT) AS lo FROM o)
SELECT doc_id, digits, 'A' AS set, 1 AS tier FROM x WHERE i >= lo AND i < lo + 50 UNION ALL SELECT doc_id, digits, 'A', 2 FROM x WHERE i >= lo AND i < lo + 50 UNION ALL SELECT doc_id, digits, 'B', CASE WHEN (i - lo - 50) % 2 = 1 THEN 1 ELSE 2 END FROM x WHERE i >= lo + 50 AND i < lo + 150 UNION ALL SELECT doc_id, digits, 'C', 2 FROM x WHERE i >= n - 20""")
def _(t: Tables):
    own = t.documents.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    return curation.density_bands(own, "lang", "doc_id").select("doc_id", "digits", "set", "tier")


@q("cur07_uid", "SELECT doc_id, left(md5(concat(source, '|', lang, '|', left(coalesce(text, ''), 200))), 16) AS uid FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", curation.uid(F.col("source"), F.col("lang"), F.substring(F.coalesce("text", F.lit("")), 1, 200)).alias("uid"))


HISTORY = "h AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE l_returnflag WHEN 'A' THEN 'ERROR' WHEN 'N' THEN 'LOSSY' ELSE 'LOSSLESS' END AS v FROM lineitem)"


def _history(t: Tables):
    v = F.when(F.col("l_returnflag") == "A", "ERROR").when(F.col("l_returnflag") == "N", "LOSSY").otherwise("LOSSLESS")
    step = F.struct(F.col("l_linenumber").alias("n"), v.alias("verdict"), F.concat(F.lit("an attempt that is long enough to be of use: "), F.col("l_linenumber").cast("string")).alias("compressed"), F.when(v == "LOSSY", F.array(F.lit("fact"))).otherwise(F.array().cast("array<string>")).alias("dropped"))
    own = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(step)).alias("history"))
    return own.select(F.col("k").alias("original"), F.lit(1).alias("tier"), F.when(F.col("k") % 2 == 0, "LOSSLESS").otherwise("IDENTITY").alias("verdict"), F.concat(F.lit("c"), F.col("k").cast("string")).alias("compressed"), "history")


@q("cur08_kept_verdicts", f"WITH {HISTORY} SELECT k AS original FROM h GROUP BY k HAVING k % 2 = 0 OR count(CASE WHEN v = 'ERROR' THEN 1 END) = 0")
def _(t: Tables):
    return curation.kept_verdicts(_history(t)).select("original")


@q("cur09_preferences", f"WITH {HISTORY}, f AS (SELECT k, min(n) AS n FROM h WHERE v = 'LOSSY' AND k % 2 = 0 GROUP BY k) SELECT k AS original, concat('an attempt that is long enough to be of use: ', n) AS rejected FROM f")
def _(t: Tables):
    return curation.preference_pairs(_history(t)).select("original", "rejected")


@q("cur10_chat_rows", "SELECT conv_id, turn, md5(concat('be brief', coalesce(text, ''), role)) AS row_md5 FROM conversations")
def _(t: Tables):
    row = curation.chat_row(F.lit("be brief"), F.coalesce("text", F.lit("")), F.col("role"))
    return t.conversations.select("conv_id", "turn", F.md5(F.array_join(F.transform(row, lambda x: x["content"]), "")).alias("row_md5"))


@q("cur11_gate", "SELECT round(avg(CASE WHEN l_discount >= 0.05 AND l_tax < 0.05 THEN 1.0 ELSE 0 END), 6) AS pass_rate, min(l_discount) AS least, round(quantile_cont(l_discount, 0.1), 6) AS p10, round(median(l_discount), 6) AS median FROM lineitem")
def _(t: Tables):
    out = curation.gate(t.lineitem.select(F.col("l_discount").alias("cos"), (F.col("l_tax") < 0.05).alias("passed")), least=0.05)
    return out.select(six("pass_rate"), "least", six("p10"), six("median"))


@q("cur12_negatives", f"WITH {HISTORY} SELECT k AS original, concat('an attempt that is long enough to be of use: ', n) AS negative FROM h WHERE v = 'LOSSY'")
def _(t: Tables):
    return curation.rejected_attempts(_history(t)).select("original", "negative")


@q("cur13_profile", "SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS mean, median(length(text)) AS median, round(quantile_cont(length(text), 0.1), 6) AS p10, round(quantile_cont(length(text), 0.9), 6) AS p90, round(sum(length(text) - length(regexp_replace(text, '\\s', '', 'g'))) / sum(length(text)), 6) AS space_share FROM documents GROUP BY lang")
def _(t: Tables):
    return curation.text_profile(t.documents, "lang").select("lang", "n", six("mean"), "median", six("p10"), six("p90"), six("space_share"))


@q("cur14_log_chunks", "WITH o AS (SELECT user_id, event_id, event_type, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 30) AS BIGINT) AS chunk FROM events) SELECT user_id, chunk, md5(string_agg(event_type, chr(10) ORDER BY event_id)) AS text_md5 FROM o GROUP BY ALL HAVING count(*) = 30")
def _(t: Tables):
    return curation.log_chunks(t.events.withColumnRenamed("event_type", "line"), "user_id", "event_id", 30).select("user_id", "chunk", F.md5("text").alias("text_md5"))


@q("cur15_run_labels", "SELECT o_orderkey, 'codex' AS agent, CAST(o_custkey AS VARCHAR) AS case_id, replace(o_orderpriority, '-', '_') AS arm, CAST(o_orderkey % 5 AS INT) AS rep FROM orders")
def _(t: Tables):
    label = F.concat(F.lit("pm_codex_"), "o_custkey", F.lit("_"), F.replace("o_orderpriority", F.lit("-"), F.lit("_")), F.lit("_r"), (F.col("o_orderkey") % 5).cast("string"))
    return t.orders.select("o_orderkey", curation.run_label(label).alias("x")).select("o_orderkey", "x.agent", F.col("x.case").alias("case_id"), "x.arm", "x.rep")


@q("cur15_tool_class", "SELECT event_id, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'search' WHEN 'purchase' THEN 'write' WHEN 'signup' THEN 'engine' ELSE 'other' END AS class FROM events")
def _(t: Tables):
    e = F.col("event_type")
    cmd = F.when(e == "view", "sed -n 1,9p a").when(e == "click", "rg word .").when(e == "purchase", "cat > f <<E").when(e == "signup", "corpus grep x").otherwise("true")
    return t.events.select("event_id", curation.tool_class(cmd).alias("class"))


@q("cur16_failures", "SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN l_discount >= 0.05 THEN NULL WHEN l_quantity < 10 THEN 'A_empty_deliverable' WHEN l_returnflag = 'A' THEN 'B_timeout_overexplore' ELSE 'C_wrong_or_hollow_content' END AS bucket FROM lineitem) GROUP BY bucket")
def _(t: Tables):
    bucket = curation.failure_bucket(F.col("l_discount") * 10, F.when(F.col("l_quantity") < 10, 0).otherwise(1), F.when(F.col("l_returnflag") == "A", "timeout").otherwise("ok"))
    return t.lineitem.select(bucket.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@q("cur17_ceiling", "SELECT round(avg(l_quantity), 6) AS mean, avg(l_quantity) <= 30 AS ok FROM lineitem")
def _(t: Tables):
    return curation.within_ceiling(t.lineitem, "l_quantity", 30).select(six("mean"), "ok")


@q("cur18_balanced", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS r FROM labels) WHERE r <= 25")
def _(t: Tables):
    return curation.per_group(t.labels, "quality", "doc_id", 25).select("doc_id")


@q("cur19_facts", r"""WITH p AS (SELECT item_id, text || ' 12 and 3,400 or 56% https://a.b/c `x y`' AS o, CASE item_id % 3 WHEN 0 THEN text || ' 12 3,400 56% https://a.b/c x y' WHEN 1 THEN '12' ELSE '12 3,400 56%' END AS c FROM benchmark),
f AS (SELECT *, list_distinct(regexp_extract_all(o, '\d[\d,]*\.?\d*%?')) AS nums FROM p)
SELECT item_id, round(len(list_filter(nums, lambda x: contains(c, x))) / len(nums), 3) AS number_share, len(list_filter(nums, lambda x: contains(c, x))) / len(nums) >= 0.9 AND contains(c, 'https://a.b/c') AND contains(c, 'x y') AS kept_facts FROM f""")
def _(t: Tables):
    o = F.concat("text", F.lit(" 12 and 3,400 or 56% https://a.b/c `x y`"))
    c = F.when(F.col("item_id") % 3 == 0, F.concat("text", F.lit(" 12 3,400 56% https://a.b/c x y"))).when(F.col("item_id") % 3 == 1, "12").otherwise("12 3,400 56%")
    return curation.fact_gate(t.benchmark.select("item_id", o.alias("o"), c.alias("c")), "o", "c").select("item_id", "number_share", "kept_facts")


@q("cur20_subsequence", "SELECT item_id, CAST(CASE item_id % 2 WHEN 0 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS share FROM benchmark")
def _(t: Tables):
    c = F.when(F.col("item_id") % 2 == 0, "alpha beta").otherwise("alpha zzz")
    return t.benchmark.select("item_id", tx.subsequence_share(F.lit("alpha and Beta"), c).alias("share"))


@q("cur21_duplicate_chunks", "WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING n > 1) SELECT count(*) AS groups, coalesce(sum(n - 1), 0) AS extra FROM g")
def _(t: Tables):
    return curation.duplicate_chunks(t.lineitem.select(F.col("l_orderkey").alias("filepath"), F.col("l_linenumber").alias("ord")))


@q("cur23_trace", "SELECT conv_id, count(*) AS events, count(CASE WHEN role = 'user' THEN 1 END) AS users, count(CASE WHEN role = 'assistant' THEN 1 END) AS assistants, left(min_by(text, CASE WHEN role = 'user' THEN turn END), 2000) AS first_user, left(max_by(text, CASE WHEN role = 'assistant' THEN turn END), 2000) AS last_assistant FROM conversations GROUP BY conv_id")
def _(t: Tables):
    return curation.trace_summary(t.conversations).drop("calls")


RUNS = "runs AS (SELECT o_orderpriority AS arm, o_custkey AS case_id, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS correct, o_totalprice AS tokens FROM orders)"


def _runs(t: Tables):
    return t.orders.select(F.col("o_orderpriority").alias("arm"), F.col("o_custkey").alias("case_id"), F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("correct"), F.col("o_totalprice").alias("tokens"))


@q("agg09_accuracy", f"WITH {RUNS} SELECT arm, count(*) AS judged, count(CASE WHEN correct THEN 1 END) AS right, round(count(CASE WHEN correct THEN 1 END) / count(*), 4) AS accuracy, round(sum(tokens) / count(CASE WHEN correct THEN 1 END), 3) AS tokens_per_correct FROM runs WHERE correct IS NOT NULL GROUP BY arm")
def _(t: Tables):
    return curation.accuracy(_runs(t), "arm").withColumn("tokens_per_correct", F.round("tokens_per_correct", 3))


@q("cur26_macro", "WITH c AS (SELECT l_returnflag AS arm, l_suppkey AS k, sum(CASE WHEN l_tax < 0.04 THEN 1 ELSE 0 END) AS p, count(*) AS t, avg(l_extendedprice) AS tok FROM lineitem GROUP BY ALL) SELECT arm, round(avg(100.0 * p / t), 6) AS macro, round(100.0 * sum(p) / sum(t), 6) AS pooled, round(avg(100.0 * p / t) / (avg(tok) / 100000), 6) AS points_per_100k FROM c GROUP BY arm")
def _(t: Tables):
    own = t.lineitem.select(F.col("l_returnflag").alias("arm"), F.col("l_suppkey").alias("k"), (F.col("l_tax") < 0.04).cast("int").alias("p"), F.lit(1).alias("t"), F.col("l_extendedprice").alias("tok"))
    return curation.macro_average(own, "arm", "k", "p", "t", "tok").select("arm", six("macro"), six("pooled"), six("points_per_100k"))


@q("cur27_paired", "SELECT round(avg(CASE WHEN l_linestatus = 'F' THEN l_discount END) - avg(CASE WHEN l_linestatus <> 'F' THEN l_discount END), 6) AS delta, round(100 * (1 - avg(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END) / avg(CASE WHEN l_linestatus <> 'F' THEN l_extendedprice END)), 6) AS saved_pct FROM lineitem")
def _(t: Tables):
    return curation.paired(t.lineitem.withColumn("on", F.col("l_linestatus") == "F"), "on", "l_discount", "l_extendedprice").select(six("delta"), six("saved_pct"))


@q("agg01_basics", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS parts, round(sum(l_quantity), 3) AS s, min(l_tax) AS lo, max(l_tax) AS hi, round(avg(l_discount), 6) AS a FROM lineitem GROUP BY l_returnflag HAVING count(*) > 10")
def _(t: Tables):
    out = t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"), F.round(F.sum("l_quantity"), 3).alias("s"), F.min("l_tax").alias("lo"), F.max("l_tax").alias("hi"), F.round(F.avg("l_discount"), 6).alias("a"))
    return out.where("n > 10")


@q("agg04_top_groups", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 15")
def _(t: Tables):
    return t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(15)


@q("agg10_medians", "SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median, count(*) AS n FROM lineitem GROUP BY ALL")
def _(t: Tables):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.round(F.median("l_extendedprice"), 4).alias("median"), F.count("*").alias("n"))


@q("agg11_corr", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def _(t: Tables):
    return curation.correlation(t.lineitem, "l_quantity", "l_extendedprice").select(six("r"))


@q("agg12_scores", "SELECT p_partkey, CAST(CASE p_size % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 ELSE NULL END AS DOUBLE) AS score FROM part")
def _(t: Tables):
    text = F.when(F.col("p_size") % 3 == 0, "2/4").when(F.col("p_size") % 3 == 1, "0.25").otherwise("7")
    return t.part.select("p_partkey", curation.score_of(text).alias("score"))


@q("agg13_index_percentile", "WITH o AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT l_returnflag, v AS value FROM o WHERE i = least(n - 1, CAST(floor(n * 0.9) AS BIGINT))")
def _(t: Tables):
    return curation.index_percentile(t.lineitem, "l_returnflag", "l_extendedprice", 0.9)


@q("agg14_percentiles", "SELECT round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(avg(CASE WHEN l_extendedprice > 50000 THEN 1.0 ELSE 0 END), 6) AS over_cap, round(sum(least(l_extendedprice, 50000)), 2) AS capped FROM lineitem")
def _(t: Tables):
    x = F.col("l_extendedprice")
    return t.lineitem.agg(F.round(F.percentile(x, 0.5), 4).alias("p50"), F.round(F.percentile(x, 0.95), 4).alias("p95"), F.round(F.avg((x > 50000).cast("double")), 6).alias("over_cap"), F.round(F.sum(F.least(x, F.lit(50000.0))), 2).alias("capped"))


@q("agg15_histogram", "SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def _(t: Tables):
    return t.documents.join(t.labels, "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"))


@q("agg16_quality", "SELECT l_returnflag AS model, round(avg(1 - l_tax) * (1 - avg(l_discount)), 6) AS score FROM lineitem GROUP BY 1")
def _(t: Tables):
    return curation.quality_score(t.lineitem.withColumn("cos", 1 - F.col("l_tax")).withColumnRenamed("l_returnflag", "model"), "model", "cos", "l_discount").select("model", six("score"))


@q("agg17_costs", "SELECT l_suppkey, count(*) AS generations, sum(l_linenumber) AS cached, sum(l_partkey - l_linenumber) AS uncached, sum(l_orderkey) AS output, round(sum(l_tax), 6) AS cost FROM lineitem GROUP BY 1")
def _(t: Tables):
    own = t.lineitem.select("l_suppkey", F.col("l_linenumber").alias("cached"), F.col("l_partkey").alias("prompt"), F.col("l_orderkey").alias("completion"), F.col("l_tax").alias("cost"))
    return curation.token_costs(own, "l_suppkey")


@q("agg18_rate", "SELECT user_id, count(*) AS n, round(count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6, 0), 6) AS per_minute FROM events GROUP BY user_id")
def _(t: Tables):
    return curation.rate_per_minute(t.events, "user_id", "ts").select("user_id", "n", six("per_minute"))


@q("win04_gap_clusters", """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 7200e6 THEN 1 ELSE 0 END AS new FROM events), c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS c FROM g)
SELECT user_id, event_id, CAST(m + 1 AS BIGINT) AS clusters FROM (SELECT *, max(c) OVER (PARTITION BY user_id) AS m FROM c) WHERE c = m""")
def _(t: Tables):
    return curation.gap_clusters(t.events, "user_id", "ts", 7200).select("user_id", "event_id", "clusters")


@q("win05_reprefill", "WITH o AS (SELECT conv_id, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations) SELECT conv_id, CAST(sum(n * (k - i)) AS BIGINT) AS weight FROM o GROUP BY conv_id")
def _(t: Tables):
    return curation.reprefill(t.conversations, "conv_id", "turn", F.length(F.coalesce("text", F.lit(""))))


@q("win08_last_rows", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")
def _(t: Tables):
    return curation.last_rows(t.events, "user_id", "event_id", 3).select("event_id")


@q("win09_alternate", "SELECT c_custkey, CAST((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) % 3 AS INT) AS slot FROM customer")
def _(t: Tables):
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    return t.customer.select("c_custkey", F.pmod(number, F.lit(3)).alias("slot"))


@q("srt_multi_key", f"WITH {FILES} SELECT doc_id FROM files ORDER BY length(text) DESC, lang, filepath LIMIT 50")
def _(t: Tables):
    return t.files.orderBy(F.length("text").desc(), "lang", "filepath").select("doc_id").limit(50)


@q("set01_difference", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 47")
def _(t: Tables):
    return t.part.select(F.col("p_partkey").alias("k")).exceptAll(t.lineitem.where("l_quantity > 47").select("l_partkey").distinct())


@q("iso_millis", "SELECT o_orderkey, epoch_ms(o_orderdate) + 250 AS ms FROM orders")
def _(t: Tables):
    return t.orders.select("o_orderkey", tx.iso_millis(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".25+05:00"))).alias("ms"))


@q("rrk01_overlap", "SELECT item_id, round((CASE WHEN list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'the') THEN 1 ELSE 0 END + CASE WHEN list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'of') THEN 1 ELSE 0 END) / 2, 6) AS score FROM benchmark")
def _(t: Tables):
    return t.benchmark.select("item_id", F.round(vectors.overlap_score("the of", F.col("text")), 6).alias("score"))


@q("json_verdicts", "SELECT event_id, event_type IN ('click', 'view') AS correct FROM events")
def _(t: Tables):
    body = F.when(F.col("event_type") == "click", '```json\n{"correct": true}\n```').when(F.col("event_type") == "view", 'so: {"correct": true, "reason": "x"}').otherwise('{"correct": false}')
    return t.events.select("event_id", curation.verdict_of(body).alias("correct"))
