"""Corpus curation and evaluation analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators.maintenance import first_wins


def exact_dedup(df: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """CUR-01: the first of each text, whatever its domain or split. Two aggregations, no ordering of groups, so that a
    text with very many copies is summed before it moves."""
    own = df.withColumn("_h", F.md5(F.col(text)))
    first = own.groupBy("_h").agg(F.min(order).alias(order))
    return own.join(first, ["_h", order], "left_semi").dropDuplicates(["_h"]).drop("_h")


def prefix_dedup(df: DataFrame, text: str = "text", order: str = "doc_id", length: int = 120, *, more: tuple[str, ...] = ()) -> DataFrame:
    """CUR-02: the first of each beginning (the key is the feature; texts stay whole)."""
    own = df.withColumn("_k", F.substring(text, 1, length))
    keys = ["_k", *more]
    first = own.groupBy(*keys).agg(F.min(order).alias(order))
    return own.join(first, [*keys, order], "left_semi").drop("_k")


def split_of(number: Column, of: int = 12) -> Column:
    """CUR-03: test, validation or train by the document's number."""
    return F.when(F.pmod(number, F.lit(of)) == 0, "test").when(F.pmod(number, F.lit(of)) == 1, "validation").otherwise("train")


def quota_split(df: DataFrame, number: str, quotas: dict[str, int]) -> DataFrame:
    """CUR-03: a split beyond its quota falls back to train."""
    own = df.withColumn("split", split_of(F.col(number)))
    rank = F.row_number().over(Window.partitionBy("split").orderBy(number))
    quota = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))])
    return own.withColumn("split", F.when(rank <= F.coalesce(quota[F.col("split")], rank), F.col("split")).otherwise("train"))


def grouped_split(df: DataFrame, domain: str, group: str, share: float, seed: int = 42) -> DataFrame:
    """CUR-04: a share of each domain's groups (at least one if there are over two) is held out, whole groups at a time,
    chosen by a hash of the group."""
    groups = df.select(domain, group).distinct()
    w = Window.partitionBy(domain)
    n = F.count("*").over(w)
    rank = F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), F.col(group)), F.col(group)))
    held = groups.withColumn("split", F.when((n > 2) & (rank <= F.greatest(F.lit(1), F.round(n * share))), "validation").otherwise("train"))
    return df.join(held, [domain, group])


def length_band(df: DataFrame, n: str, low: int = 300, high: int = 1500) -> DataFrame:
    """CUR-05."""
    return df.where(F.col(n).between(low, high))


def per_group(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """CUR-05, CUR-18, WIN-03: the first n of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def density_bands(df: DataFrame, domain: str, order: str, text: str = "text", n_a: int = 50, n_b: int = 100, n_dense: int = 20) -> DataFrame:
    """CUR-06: by digits: after the lowest quarter n_a rows for both tiers, n_b for tiers in turn, and the densest tail."""
    w = Window.partitionBy(domain)
    own = df.withColumn("digits", digits(F.col(text)))
    own = own.withColumn("i", F.row_number().over(w.orderBy("digits", order)) - 1).withColumn("n", F.count("*").over(w))
    low = F.floor(F.col("n") * 0.25)
    a = F.when((F.col("i") >= low) & (F.col("i") < low + n_a), F.array(F.struct(F.lit("A").alias("set"), F.lit(1).alias("tier")), F.struct(F.lit("A").alias("set"), F.lit(2).alias("tier"))))
    b = F.when((F.col("i") >= low + n_a) & (F.col("i") < low + n_a + n_b), F.array(F.struct(F.lit("B").alias("set"), F.when((F.col("i") - low - n_a) % 2 == 1, 1).otherwise(2).alias("tier"))))
    c = F.when(F.col("i") >= F.col("n") - n_dense, F.array(F.struct(F.lit("C").alias("set"), F.lit(2).alias("tier"))))
    none = F.array().cast("array<struct<set:string,tier:int>>")
    return own.select(*df.columns, "digits", F.inline(F.concat(F.coalesce(a, none), F.coalesce(b, none), F.coalesce(c, none))))


def uid(*parts: Column) -> Column:
    """CUR-07."""
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 16)


def kept_verdicts(rows: DataFrame) -> DataFrame:
    """CUR-08: lossless rows, and identity rows without an error in their history (verdict, ...)."""
    clean = ~F.exists("history", lambda h: F.coalesce(h["verdict"] == "ERROR", F.lit(False)))
    return rows.where((F.col("verdict") == "LOSSLESS") | ((F.col("verdict") == "IDENTITY") & clean))


def preference_pairs(rows: DataFrame) -> DataFrame:
    """CUR-09: an accepted row with the first rejected attempt that dropped facts; one for each passage."""
    bad = F.filter("history", lambda h: (h["verdict"] != "LOSSLESS") & (F.size(h["dropped"]) > 0))
    pairs = rows.where("verdict = 'LOSSLESS'").withColumn("_b", bad).where(F.size("_b") > 0)
    pairs = pairs.select("original", "tier", F.col("compressed").alias("chosen"), F.col("_b")[0]["compressed"].alias("rejected"))
    return first_wins(pairs, F.col("original"), order="tier")


def chat_row(system: Column, user: Column, assistant: Column) -> Column:
    """CUR-10."""
    return F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", system), ("user", user), ("assistant", assistant))))


def gate(rows: DataFrame, score: str = "cos", least: float = 0.83, other: str = "passed") -> DataFrame:
    """CUR-11: the pass rate of both gates, and the scores' least, tenth percentile and median."""
    return rows.agg(F.avg(((F.col(score) >= least) & F.col(other)).cast("double")).alias("pass_rate"), F.min(score).alias("least"), F.percentile(score, 0.1).alias("p10"), F.median(score).alias("median"))


def rejected_attempts(rows: DataFrame, most: int = 4000) -> DataFrame:
    """CUR-12: attempts that dropped facts, of a usable length."""
    return rows.select("original", F.explode("history").alias("h")).where((F.size("h.dropped") > 0) & (F.length("h.compressed") > 40) & (F.length("h.compressed") <= most)).select("original", F.col("h.compressed").alias("negative"), "h.dropped")


def text_profile(df: DataFrame, by: str, text: str = "text") -> DataFrame:
    """CUR-13: by domain: rows, mean, median, tenth and ninetieth percentile of lengths, share that looks like code, and
    of white space."""
    n, code = F.length(text), F.col(text).rlike(r"```|def \w+\(|function \w+\(|#include|console\.log\(|public static")
    space = F.length(text) - F.length(F.regexp_replace(text, r"\s", ""))
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg(n).alias("mean"), F.median(n).alias("median"), F.percentile(n, 0.1).alias("p10"), F.percentile(n, 0.9).alias("p90"), F.avg(code.cast("double")).alias("code_share"), (F.sum(space) / F.sum(n)).alias("space_share"))


def log_chunks(lines: DataFrame, by: str, order: str, size: int = 70) -> DataFrame:
    """CUR-14: groups of exactly so many consecutive lines; an incomplete tail is dropped."""
    own = lines.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / size))
    out = own.groupBy(by, "chunk").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n").alias("text"))
    return out.where(F.col("n") == size).drop("n")


def run_label(label: Column) -> Column:
    """CUR-15: agent, case, arm and repetition of a run's label."""
    pattern = r"^pm_([^_]+)_(\d+)_(.+)_r(\d+)$"
    parts = [F.regexp_extract(label, pattern, i) for i in range(1, 5)]
    return F.when(label.rlike(pattern), F.struct(parts[0].alias("agent"), parts[1].alias("case"), parts[2].alias("arm"), parts[3].cast("int").alias("rep")))


def tool_class(command: Column, engine: str = "corpus grep") -> Column:
    """CUR-15: what a shell command is used for."""
    c = F.lower(command)
    has = lambda s: F.contains(c, F.lit(s))
    heredoc = has("cat >") | has("cat <<") | has("<<")
    return (
        F.when(has(engine), "engine")
        .when(c.rlike(r"\b(cat|sed|head|tail|less|nl|awk)\b") & ~heredoc, "read")
        .when(has("grep") | has("rg ") | has("find ") | has("ls "), "search")
        .when(has("cat >") | has("<<") | has("tee ") | (has("python") & has(">")), "write")
        .otherwise("other")
    )


def failure_bucket(accuracy: Column, deliverables: Column, status: Column) -> Column:
    """CUR-16: null for what didn't fail."""
    bad = F.when(deliverables == 0, "A_empty_deliverable").when(status == "timeout", "B_timeout_overexplore").when(accuracy < 0.5, "C_wrong_or_hollow_content").otherwise("D_other")
    return F.when(accuracy.isNull() | (accuracy < 0.5), bad)


def within_ceiling(rows: DataFrame, value: str, ceiling: float) -> DataFrame:
    """CUR-17."""
    return rows.agg(F.avg(value).alias("mean")).withColumn("ok", F.col("mean") <= ceiling)


def duplicate_chunks(chunks: DataFrame) -> DataFrame:
    """CUR-21: groups of (filepath, ord) with more than one row, and their extra rows."""
    return chunks.groupBy("filepath", "ord").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"))


def trace_summary(events: DataFrame, session: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", most: int = 2000, calls: int = 50) -> DataFrame:
    """CUR-23: by session: events by type, first user message, last assistant message (cut, as a summary's), first calls."""
    o = F.col(order)
    user, said = F.when(F.col(role) == "user", o), F.when(F.col(role) == "assistant", o)
    return events.groupBy(session).agg(F.count("*").alias("events"), F.count_if(F.col(role) == "user").alias("users"), F.count_if(F.col(role) == "assistant").alias("assistants"), F.substring(F.min_by(text, user), 1, most).alias("first_user"), F.substring(F.max_by(text, said), 1, most).alias("last_assistant"), F.slice(F.sort_array(F.collect_list(F.when(F.col(role) == "tool", F.struct(order, text)))), 1, calls).alias("calls"))


def changed_workspaces(diff: DataFrame) -> DataFrame:
    """CUR-24: workspaces with any path that isn't unchanged."""
    return diff.groupBy("workspace").agg(F.count_if(F.col("change") != "unchanged").alias("changes")).where("changes > 0")


def accuracy(runs: DataFrame, *by: str) -> DataFrame:
    """AGG-09, CUR-25: accuracy of the judged runs, and their tokens for each correct one (null without any)."""
    judged = runs.where("correct IS NOT NULL")
    right = F.count_if("correct")
    return judged.groupBy(*by).agg(F.count("*").alias("judged"), right.alias("right"), F.round(right / F.count("*"), 4).alias("accuracy"), F.when(right > 0, F.sum("tokens") / right).alias("tokens_per_correct"))


def macro_average(cases: DataFrame, arm: str, case: str, passed: str, total: str, tokens: str) -> DataFrame:
    """CUR-26, AGG-12: the mean of the cases' percentages, the pooled one, and points for 100K tokens."""
    one = cases.groupBy(arm, case).agg(F.sum(passed).alias("p"), F.sum(total).alias("t"), F.avg(tokens).alias("tokens"))
    pct = 100.0 * F.col("p") / F.col("t")
    return one.groupBy(arm).agg(F.avg(pct).alias("macro"), (100.0 * F.sum("p") / F.sum("t")).alias("pooled"), (F.avg(pct) / (F.avg("tokens") / 100_000)).alias("points_per_100k"))


def paired(rows: DataFrame, treatment: str, value: str, tokens: str) -> DataFrame:
    """CUR-27: the difference of means and the tokens saved, in percent."""
    on, off = F.col(treatment), ~F.col(treatment)
    return rows.agg((F.avg(F.when(on, F.col(value))) - F.avg(F.when(off, F.col(value)))).alias("delta"), (100 * (1 - F.avg(F.when(on, F.col(tokens))) / F.avg(F.when(off, F.col(tokens))))).alias("saved_pct"))


def score_of(text: Column) -> Column:
    """AGG-12: "a/b" or a number: up to 1 a share, beyond it a count."""
    frac = text.rlike(r"^\s*\d+(\.\d+)?\s*/\s*\d+(\.\d+)?\s*$")
    a, b = F.trim(F.split(text, "/")[0]).try_cast("double"), F.trim(F.get(F.split(text, "/"), 1)).try_cast("double")
    return F.when(frac & (b != 0), a / b).otherwise(F.when(text.try_cast("double") <= 1, text.try_cast("double")))


def correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    """AGG-11: NaN with fewer than three pairs."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return rows.where(both).agg(F.when(F.count("*") >= 3, F.corr(x, y)).otherwise(float("nan")).alias("r"))


def index_percentile(rows: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """AGG-13: the element min(n - 1, int(p n)) of the sorted values. Values are counted first, so a group's rows aren't
    ordered in one task, only its distinct values."""
    count = rows.groupBy(by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(by)
    own = count.withColumn("upto", F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    return own.where(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * p))).groupBy(by).agg(F.min(value).alias("value"))


def gap_clusters(rows: DataFrame, by: str, at: str, gap_s: int = 300) -> DataFrame:
    """WIN-04: rows of the last run of rows without a longer pause, and how many such runs there are."""
    w = Window.partitionBy(by).orderBy(at)
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    own = rows.withColumn("_s", seconds).withColumn("_new", (F.col("_s") - F.lag("_s").over(w) > gap_s).cast("int"))
    own = own.withColumn("cluster", F.sum(F.coalesce("_new", F.lit(0))).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    own = own.withColumn("clusters", F.max("cluster").over(Window.partitionBy(by)) + 1)
    return own.where(F.col("cluster") == F.col("clusters") - 1).drop("_s", "_new", "cluster")


def reprefill(steps: DataFrame, by: str, order: str, size: Column) -> DataFrame:
    """WIN-05: what is read again: sum of size times the steps that follow."""
    w = Window.partitionBy(by)
    after = F.count("*").over(w) - F.row_number().over(w.orderBy(order))
    return steps.withColumn("_x", size * after).groupBy(by).agg(F.sum("_x").alias("weight"))


def last_rows(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """WIN-08."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")


def token_costs(rows: DataFrame, *by: str) -> DataFrame:
    """AGG-17: input that wasn't cached, output and cost."""
    return rows.groupBy(*by).agg(F.count("*").alias("generations"), F.sum("cached").alias("cached"), F.sum(F.col("prompt") - F.col("cached")).alias("uncached"), F.sum("completion").alias("output"), F.round(F.sum("cost"), 6).alias("cost"))


def rate_per_minute(rows: DataFrame, by: str, at: str) -> DataFrame:
    """AGG-18: null when all rows have one time."""
    minutes = (F.unix_micros(F.max(at).cast("timestamp")) - F.unix_micros(F.min(at).cast("timestamp"))) / 60e6
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.when(minutes > 0, F.count("*") / minutes).alias("per_minute"))


def fact_gate(rows: DataFrame, original: str, compressed: str) -> DataFrame:
    """CUR-19, CUR-20."""
    ok, share = tx.preserves_facts(F.col(original), F.col(compressed))
    return rows.withColumn("kept_facts", ok).withColumn("number_share", share).withColumn("subsequence", tx.subsequence_share(F.col(original), F.col(compressed)))


def verdict_of(reply: Column) -> Column:
    """JSON verdict (2.13): a fence stripped, the first object parsed, else the field looked for."""
    bare = F.regexp_replace(F.trim(reply), r"^```(json)?\s*|\s*```$", "")
    body = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.from_json(body, "correct boolean")["correct"], F.regexp_extract(reply, r'"correct"\s*:\s*(true|false)', 1).try_cast("boolean"))


def quality_score(rows: DataFrame, model: str, cos: str, ratio: str) -> DataFrame:
    """AGG-16: mean cosine times what was saved, and the best model."""
    return rows.groupBy(model).agg((F.avg(cos) * (1 - F.avg(ratio))).alias("score")).orderBy(F.desc("score"), model)
