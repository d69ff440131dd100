"""Budgeted delivery of ranked hits, for one list or for each list of many (partition columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import DEFAULT

EPSILON = 2.220446049250313e-16


def adaptive_k(hits: DataFrame, *by: str, score: str = "score") -> DataFrame:
    """DLV-01: how many hits of each list to show, and why. A list's scores are aggregated to its first, second and
    last; a second pass counts the leading run, so no list is gathered."""
    w = Window.partitionBy(*by).orderBy(F.desc(score))
    own = hits.withColumn("_i", F.row_number().over(w))
    ends = own.groupBy(*by).agg(F.max("_i").alias("n"), F.max(score).alias("s1"), F.max(F.when(F.col("_i") == 2, F.col(score))).alias("s2"), F.min(score).alias("sn"))
    spread = F.greatest(F.col("s1") - F.col("sn"), F.lit(EPSILON))
    run = own.join(ends, list(by)) if by else own.crossJoin(F.broadcast(ends))  # one row
    run = run.where((F.col("s1") - F.col(score)) / spread <= DEFAULT.adaptive_cluster).groupBy(*by).agg(F.count("*").alias("run"))
    told = ends.join(run, list(by)) if by else ends.crossJoin(F.broadcast(run))
    answer = (F.col("n") == 1) | ((F.col("s1") - F.col("s2")) / spread >= DEFAULT.adaptive_dominance)
    return told.select(*by, F.when(answer, 1).otherwise(F.least("run", F.lit(DEFAULT.adaptive_most))).cast("int").alias("k"), F.when(answer, "answer").otherwise("cluster").alias("verdict"))


def render_count(n: int, adaptive: int, explicit: int | None = None, everything: bool = False, use_adaptive: bool = True) -> int:
    """DLV-02: an explicit limit, else all, else the adaptive number, else the pool."""
    return min(n, explicit if explicit is not None else n if everything or not use_adaptive else adaptive)


def confidence(n: Column, s1: Column, s2: Column, sn: Column, complete: Column) -> Column:
    """DLV-03: HIGH, MEDIUM or MIXED from the margin of the first hit."""
    spread = sn < s2
    margin = F.when(n < 2, 1.0).when(spread, (s1 - s2) / (s1 - sn)).otherwise(F.when(s1 == 0, 0.0).otherwise((s1 - s2) / F.abs(s1)))
    least = F.when((n < 2) | spread, 0.30).otherwise(0.15)
    return F.when(margin >= least, F.when(complete, "HIGH").otherwise("MEDIUM")).otherwise("MIXED")


def budgeted(hits: DataFrame, *by: str, size: str = "bytes", budget: int = DEFAULT.render_budget, per_hit: int = DEFAULT.hit_budget, short: int = 200) -> DataFrame:
    """DLV-04, WIN-06: hits (rank from 0, bytes) with shown bytes and mode. After the budget is reached a hit is a path
    and a snippet, whose bytes count too; a fold over each list's hits in order, of which there are at most a pool."""
    rows = F.sort_array(F.collect_list(F.struct(F.col("rank"), F.col(size).cast("long").alias("size"), F.struct(*[c for c in hits.columns if c not in (*by, "rank", size)]).alias("rest"))))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<struct<shown:bigint,mode:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        demoted = (a["total"] >= budget) & (x["rank"] > 0)
        shown = F.when(demoted, F.least(x["size"], F.lit(short).cast("long"))).otherwise(F.least(x["size"], F.lit(per_hit).cast("long")))
        told = F.struct(shown.alias("shown"), F.when(demoted, "snippet").when(x["size"] > per_hit, "cut").otherwise("inline").alias("mode"))
        return F.struct((a["total"] + shown).alias("total"), F.concat(a["out"], F.array(told)).alias("out"))

    folded = hits.groupBy(*by).agg(rows.alias("rows")).withColumn("told", F.aggregate("rows", start, step)["out"])
    flat = folded.select(*by, F.explode(F.arrays_zip("rows", "told")).alias("x"))
    return flat.select(*by, F.col("x.rows.rank").alias("rank"), F.col("x.rows.size").alias(size), F.col("x.rows.rest.*") if len(hits.columns) > len(by) + 2 else F.col("x.told.shown").alias("shown"), *([F.col("x.told.shown").alias("shown")] if len(hits.columns) > len(by) + 2 else []), F.col("x.told.mode").alias("mode"))


def render_mode(paths_only: Column, chunk_only: Column) -> Column:
    """DLV-05."""
    return F.when(paths_only, "paths").when(chunk_only, "two-tier").otherwise("inline")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_complete(chunk: Column, file: Column) -> Column:
    """DLV-06: the chunk has the whole file, white space aside."""
    return F.contains(squeezed(chunk), squeezed(file))


def inlines_whole(file: Column, most: int = 8 << 10) -> Column:
    return F.octet_length(file) <= most


def sufficient(rendered: Column, seen: Column) -> Column:
    """DLV-08: most of what is shown has been seen before."""
    return (rendered > 0) & (seen >= 2) & (seen >= 0.6 * rendered)


def workspace_map(files: DataFrame, size: str = "size", dirs: int = 40, budget_tokens: int = 2000) -> DataFrame:
    """DLV-09: for each folder (two components) its files, three extensions, two largest files; folders by files; cut at
    so many tokens of four characters."""
    folder = F.array_join(F.slice(F.split(F.ltrim(F.regexp_replace("filepath", "/[^/]*$", ""), F.lit("/")), "/"), 1, 2), "/")
    own = files.select(folder.alias("folder"), "filepath", F.col(size).alias("size"), F.lower(F.substring_index("filepath", ".", -1)).alias("ext"))
    exts = own.groupBy("folder", "ext").agg(F.count("*").alias("n"))
    top = exts.withColumn("i", F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("n"), "ext"))).where("i <= 3")
    top = top.groupBy("folder").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "ext"))), lambda x: x["ext"]), ",").alias("exts"))
    marks = own.withColumn("i", F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("size"), "filepath"))).where("i <= 2")
    marks = marks.groupBy("folder").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", F.substring_index("filepath", "/", -1).alias("name")))), lambda x: x["name"]), ",").alias("landmarks"))
    count = own.groupBy("folder").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "folder").limit(dirs)
    lines = count.join(top, "folder").join(marks, "folder").withColumn("line", F.format_string("%s: %d files (%s) e.g. %s", "folder", "files", "exts", "landmarks"))
    used = F.sum(F.length("line") + 1).over(Window.orderBy(F.desc("files"), "folder"))
    return lines.withColumn("used", used).where(F.col("used") / 4 <= budget_tokens).drop("used")


def session_dedup(seen: DataFrame, window: int) -> DataFrame:
    """DLV-07: of (session, turn, path) rows, the turn at which each was first recorded and still is remembered, or null
    for a first sight. A record is forgotten `window` turns after it was made; later sights don't refresh it. A path's
    turns in a session are folded in order."""
    turns = F.sort_array(F.collect_set("turn"))
    start = F.struct(F.lit(None).cast("long").alias("at"), F.array().cast("array<struct<turn:bigint,first_turn:bigint>>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        t = t.cast("long")
        known = a["at"].isNotNull() & (a["at"] > t - window)
        return F.struct(F.when(known, a["at"]).otherwise(t).alias("at"), F.concat(a["out"], F.array(F.struct(t.alias("turn"), F.when(known, a["at"]).alias("first_turn")))).alias("out"))

    folded = seen.groupBy("session", "path").agg(F.aggregate(turns, start, step)["out"].alias("x"))
    return folded.select("session", "path", F.inline("x"))
