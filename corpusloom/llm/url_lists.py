"""URL filters by a temporal list join, in DataFrame expressions only.

A list's history is dated events: at a time a pattern is put on a list (`add`) or taken off (`remove`). Consecutive
events of a list's pattern become validity intervals [from, until). Events are ordered in two levels, within a day and
from day to day, so a pattern with very many events doesn't order them in one task.

A capture (url, fetch time) is matched as of its fetch time: it offers the keys that could list it (its host and the
host's parent domains; its host with the leading parts of the path, of each depth that a list has) and joins the intervals on key and period of
`period_days`, which both sides have, then on from <= fetched < until. Intervals are entered in each period they touch
between the first and the last capture. Equal captures are joined once and pre-aggregated, then handed back by an
equi-join. The verdict is that of the longest active pattern; at a tie `block` beats `allow`.

Kinds of pattern: `domain` (the host itself or below it), `host` (exactly), `prefix` (host/path up to a `/`).
Edge cases: hosts are lower-cased, without user, port and trailing dot; query and fragment are ignored; a null or
malformed url, or a null time, matches nothing; events with a null field are ignored; an add while on the list goes
on as an interval that touches the one before, a remove while off it changes nothing; events at one instant: `remove` counts before `add`; empty lists match nothing;
extra columns of captures pass through, and those named as results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import fresh

RESULTS = ("blocked", "n_active", "pattern", "lists")


def host_of(url: Column) -> Column:
    """Lower-cased host; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """The path without the leading and trailing /, query and fragment."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(path, r"^/+|/+$", "")


def intervals(events: DataFrame) -> DataFrame:
    """(list, kind, pattern, verdict, from, until): when each pattern of each list was active; until is null if it
    still is. events: list, kind, pattern, verdict, action, at."""
    key = ["list", "kind", "pattern", "verdict"]
    good = events.select(*key, F.lower("action").alias("action"), "at").dropna().distinct()
    # of an instant's events the last in order counts: remove, then add
    state = good.groupBy(*key, "at").agg(F.max(F.when(F.col("action") == "add", 1).otherwise(0)).alias("on"))
    state = state.withColumn("day", F.to_date("at"))
    days = state.groupBy(*key, "day").agg(F.min("at").alias("first_at"))
    by_day = Window.partitionBy(*key).orderBy("day")
    days = days.select(*key, "day", F.lead("first_at").over(by_day).alias("next_at"))
    inside = Window.partitionBy(*key, "day").orderBy("at")
    runs = state.withColumn("next_in", F.lead("at").over(inside))
    runs = runs.join(days, [*key, "day"])
    return runs.where("on = 1").select(*key, F.col("at").alias("from"), F.coalesce("next_in", "next_at").alias("until"))


def keys_of(host: Column, path: Column, depths: list[int]) -> Column:
    """Keys that could list a url: domain:..., host:..., prefix:host/... of so many path parts. depths: those that the
    lists have, so a url with very many parts offers no more keys than there are depths."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    at = F.array(*(F.lit(d) for d in depths)).cast("array<int>")
    prefixes = F.transform(F.filter(at, lambda i: i <= F.size(parts)), lambda i: F.concat(F.lit("prefix:"), host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.concat(domains, F.array(F.concat(F.lit("host:"), host)), prefixes)


def judge(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched_at", period_days: int = 30) -> DataFrame:
    """captures with blocked, n_active (active entries that match), pattern (the longest, that decides) and lists
    (sorted names of the active entries' lists)."""
    captures = captures.drop(*RESULTS)
    period = lambda t: F.floor(F.unix_seconds(t.cast("timestamp")) / (86400 * period_days))
    one = captures.select(F.col(url).alias("c_url"), F.col(fetched).alias("c_at")).where("c_url IS NOT NULL AND c_at IS NOT NULL").distinct()
    one = one.withColumn("c_host", host_of(F.col("c_url"))).where("c_host IS NOT NULL")
    prefixes = events.where(F.col("kind") == "prefix").select((F.size(F.split("pattern", "/")) - 1).alias("n")).where("n > 0").distinct()
    depths = sorted(r.n for r in prefixes.collect())  # as many as different depths of listed paths
    offered = one.select("c_url", "c_at", period(F.col("c_at")).alias("p"), F.explode(F.array_distinct(keys_of(F.col("c_host"), path_of(F.col("c_url")), depths))).alias("k"))
    p0, p1 = captures.agg(period(F.min(fetched)), period(F.max(fetched))).first() or (None, None)  # two numbers
    low, high = F.lit(p0).cast("long"), F.lit(p1).cast("long")
    active = intervals(events).withColumn("a", F.greatest(period(F.col("from")), low)).withColumn("z", F.least(F.coalesce(period(F.col("until")), high), high)).where(low.isNotNull() & (F.col("a") <= F.col("z")))
    active = active.select("list", "verdict", "from", "until", F.col("pattern").alias("hit"), F.concat_ws(":", "kind", "pattern").alias("k"), F.explode(F.sequence("a", "z")).alias("p"))
    hits = offered.join(active, ["k", "p"]).where((F.col("from") <= F.col("c_at")) & (F.col("until").isNull() | (F.col("c_at") < F.col("until"))))
    block = (F.col("verdict") == "block").cast("int")
    found = hits.groupBy("c_url", "c_at").agg(F.count("*").alias("n_active"), F.max(F.struct(F.length("hit").alias("n"), block.alias("block"), F.col("hit"))).alias("top"), F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"))
    u, at, told = (fresh(c, captures) for c in ("c_url", "c_at", "told"))
    found = found.select(F.col("c_url").alias(u), F.col("c_at").alias(at), F.struct("n_active", "top", "lists").alias(told))
    joined = captures.join(found, (F.col(url) == F.col(u)) & (F.col(fetched) == F.col(at)), "left")
    result = lambda name: F.col(f"{told}.{name}")
    return joined.select(*(captures[c] for c in captures.columns), F.coalesce(result("top.block") == 1, F.lit(False)).alias("blocked"), F.coalesce(result("n_active"), F.lit(0)).cast("long").alias("n_active"), result("top.hit").alias("pattern"), F.coalesce(result("lists"), F.lit("")).alias("lists"))
