"""Copy-on-write changes of index tables, merges, coverage and snapshot comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import paths


def indexed(table: DataFrame, new: DataFrame, key: str = "filepath") -> DataFrame:
    """DML-01: the rows of the new files replace theirs."""
    return table.join(new.select(key).distinct(), key, "left_anti").select(table.columns).unionByName(new)


def removed(table: DataFrame, gone: DataFrame, key: str = "filepath") -> DataFrame:
    """DML-02: for chunks by filepath, for edges by from_path."""
    return table.join(gone.select(F.col("filepath").alias(key)).distinct(), key, "left_anti").select(table.columns)


def renamed(chunks: DataFrame, moves: DataFrame) -> DataFrame:
    """DML-03: moves (old, new). Rows of the destination go; moved rows get the new path, unless their lane (code or text)
    no longer fits the new extension, in which case they go."""
    kept = chunks.join(moves.select(F.col("new").alias("filepath")), "filepath", "left_anti")
    joined = kept.join(moves.withColumnRenamed("old", "filepath"), "filepath", "left")
    fits = paths.is_code(F.col("filepath")) == paths.is_code(F.col("new"))
    rest = [c for c in chunks.columns if c != "filepath"]
    return joined.where(F.col("new").isNull() | fits).select(F.coalesce("new", "filepath").alias("filepath"), *rest).select(chunks.columns)


def siblings(files: DataFrame, gone: DataFrame) -> DataFrame:
    """DML-08, JOI-07: derived files that go with removed ones."""
    names = gone.select(F.explode(F.array(*(F.concat("filepath", F.lit(s)) for s in paths.SIBLINGS))).alias("filepath"))
    return files.join(names, "filepath", "left_semi")


def merged_indexes(parts: list[DataFrame]) -> DataFrame:
    """SNK-04: partial indexes (filepath, ord, ...) as one with new chunk ids. Ids are numbered inside range partitions and
    shifted by what the partitions before hold, so no task sees all rows."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    from corpusloom.plans.lineage import cut

    own = cut(every.drop("chunk_id").repartitionByRange("filepath", "ord").withColumn("_p", F.spark_partition_id()))
    count = own.groupBy("_p").agg(F.count("*").alias("n"))
    base = count.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("base"))
    number = F.row_number().over(Window.partitionBy("_p").orderBy("filepath", "ord"))
    return own.join(F.broadcast(base), "_p").withColumn("chunk_id", F.col("base") + number).drop("_p", "base")


def surface_cleaned(files: DataFrame) -> DataFrame:
    """SNK-05: without generated overlays and root hints."""
    hints = ["/KNOWLEDGE_GRAPH.md", "/GRAPH_REPORT.md", "/graph.json", "/AGENTS.md", "/CLAUDE.md"]
    return files.where(~(F.startswith("filepath", F.lit("/kg/")) | F.col("filepath").isin(hints)))


def shard(files: DataFrame, n: int, k: int) -> DataFrame:
    """SRC-03: file number i of the sorted paths belongs to shard i mod n."""
    return files.where(F.pmod(F.col("ino") - 1, F.lit(n)) == k)


def unindexed(files: DataFrame, *done: DataFrame) -> DataFrame:
    """SRC-04: files that none of the indexes has."""
    for d in done:
        files = files.join(d.select("filepath").distinct(), "filepath", "left_anti")
    return files


def coverage(files: DataFrame, chunks: DataFrame, allowed: int = 0, least: float = 0.0) -> DataFrame:
    """AGG-06: files with content, those that a chunk of theirs or of their extracted sibling reaches, and the verdict.
    files: filepath, size. A file counts once; nothing is reachable beyond the content."""
    has = chunks.select("filepath").distinct()
    via = has.where(F.endswith("filepath", F.lit(paths.EXTRACTED))).select(F.regexp_replace("filepath", r"\.extracted\.md$", "").alias("filepath"))
    reach = has.unionByName(via).distinct().withColumn("r", F.lit(1))
    count = files.where("size > 0").where(~F.endswith("filepath", F.lit(paths.EXTRACTED))).join(reach, "filepath", "left").agg(F.count("*").alias("content"), F.count("r").alias("reachable"))
    return verdict(count, allowed, least)


def verdict(counts: DataFrame, allowed: int = 0, least: float = 0.0) -> DataFrame:
    reachable = F.least("reachable", "content")
    ratio = F.when(F.col("content") == 0, 1.0).otherwise(reachable / F.col("content"))
    return counts.select("content", reachable.alias("reachable"), (F.col("content") - reachable).alias("unreachable"), ratio.alias("coverage"), ((F.col("content") - reachable <= allowed) & (ratio >= least)).alias("complete"))


def coverage_buckets(files: DataFrame, chunks: DataFrame, failed: DataFrame, embedded: DataFrame) -> DataFrame:
    """AGG-07: files by how they are reached: direct, sibling, failed, unembedded, other."""
    def mark(df: DataFrame, name: str) -> DataFrame:
        return df.select("filepath").distinct().withColumn(name, F.lit(True))

    sib = chunks.where(F.endswith("filepath", F.lit(paths.EXTRACTED))).select(F.regexp_replace("filepath", r"\.extracted\.md$", "").alias("filepath"))
    own = files.select("filepath").join(mark(embedded, "e"), "filepath", "left").join(mark(sib, "s"), "filepath", "left").join(mark(failed, "f"), "filepath", "left").join(mark(chunks, "c"), "filepath", "left")
    bucket = F.when(F.col("e"), "direct").when(F.col("s"), "sibling").when(F.col("f"), "failed").when(F.col("c"), "unembedded").otherwise("other")
    return own.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("files"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "path") -> DataFrame:
    """JOI-11, SET-01: (path, change) of two snapshots (path, size, mtime)."""
    a = before.select(key, F.struct("size", "mtime").alias("a"))
    b = after.select(key, F.struct("size", "mtime").alias("b"))
    change = F.when(F.col("a").isNull(), "created").when(F.col("b").isNull(), "deleted").when(F.col("a") == F.col("b"), "unchanged").otherwise("modified")
    return a.join(b, key, "full").select(key, change.alias("change"))


def vector_check(chunks: DataFrame, vectors: DataFrame, identity: str, stamped: str | None, dims: int) -> DataFrame:
    """EMB-05, EMB-06: whether an index can be searched, in one row: the same model and width, something in it, a vector
    for each chunk."""
    counts = chunks.agg(F.count("*").alias("chunks")).crossJoin(vectors.agg(F.count("*").alias("vectors"), F.count_if(F.size("embedding") != dims).alias("odd")))  # one row each
    good = F.lit(stamped == identity) & (F.col("chunks") > 0) & (F.col("chunks") == F.col("vectors")) & (F.col("odd") == 0)
    return counts.select("chunks", "vectors", "odd", good.alias("searchable"))


def lane_rebuild(vectors: DataFrame, new: DataFrame, widths: dict[str, int]) -> DataFrame:
    """DML-10: lanes whose width changed are taken from `new`, the others stay."""
    width = vectors.groupBy("lane").agg(F.max(F.size("embedding")).alias("w"))
    wanted = F.create_map(*[x for k, v in widths.items() for x in (F.lit(k), F.lit(v))])
    stale = F.broadcast(width.where(F.coalesce(wanted[F.col("lane")], F.col("w")) != F.col("w")).select("lane"))  # a row for each lane
    return vectors.join(stale, "lane", "left_anti").unionByName(new.join(stale, "lane", "left_semi").select(vectors.columns))


def blocks_of(files: DataFrame, size: int = 4096) -> DataFrame:
    """DML-07, SNK-01: the bytes (data) of files in blocks; blocks of zeros only aren't kept."""
    n = F.ceil(F.octet_length("data") / size).cast("int")
    rows = files.where(n > 0).select("ino", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("data", i * size + 1, F.lit(size)))).alias("chunk_index", "data"))
    return rows.where(~F.hex("data").rlike("^0*$"))


def read_bytes(blocks: DataFrame, sizes: DataFrame, offset: int = 0, length: int | None = None, size: int = 4096) -> DataFrame:
    """DML-07: the bytes [offset, offset + length) of each file, without a length all from the offset on; missing blocks
    are zeros."""
    first = offset // size
    if length is None:
        last, kept = F.greatest(F.floor((F.col("size") - 1) / size).cast("int"), F.lit(first)), blocks.where(F.col("chunk_index") >= first)
    else:
        end = (offset + length - 1) // size
        last, kept = F.lit(end), blocks.where(F.col("chunk_index").between(first, end))
    wanted = sizes.select("ino", "size", F.explode(F.sequence(F.lit(first), last)).alias("chunk_index"))
    held = wanted.join(kept, ["ino", "chunk_index"], "left")
    text = F.rpad(F.coalesce(F.hex("data"), F.lit("")), 2 * size, "0")
    joined = held.groupBy("ino", "size").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", text.alias("h")))), lambda x: x["h"]), "").alias("h"))
    rest = F.col("size") - offset
    n = F.greatest(rest if length is None else F.least(rest, F.lit(length)), F.lit(0)).cast("int")
    return joined.select("ino", F.unhex(F.substring("h", F.lit(2 * (offset - first * size) + 1), n * 2)).alias("data"))


def tree(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-01: (path, parent, name, is_dir) of every folder and file of a tree, and stats by AGG-05."""
    parts = F.split(F.ltrim("filepath", F.lit("/")), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("path"), (i < F.size(parts)).alias("is_dir")))
    nodes = files.select(F.explode(prefixes).alias("x")).select("x.path", "x.is_dir").groupBy("path").agg(F.bool_or("is_dir").alias("is_dir"))
    nodes = nodes.select("path", paths.parent(F.col("path")).alias("parent"), paths.base_name(F.col("path")).alias("name"), "is_dir")
    return nodes, nodes.groupBy("is_dir").agg(F.count("*").alias("n"))


def fs_stats(inodes: DataFrame) -> DataFrame:
    """AGG-05."""
    return inodes.agg(F.count("*").alias("inodes"), F.coalesce(F.sum(F.when(~paths.is_directory(F.col("mode")), F.col("size"))), F.lit(0)).alias("bytes"))


def extracted_siblings(texts: DataFrame, files: DataFrame) -> DataFrame:
    """SNK-02: an extracted sibling for each text whose name no user's file has."""
    own = texts.withColumn("filepath", F.concat("filepath", F.lit(paths.EXTRACTED)))
    return own.join(files.select("filepath"), "filepath", "left_anti")


def visible(nodes: DataFrame, always: tuple[str, ...] = ("KNOWLEDGE_GRAPH.md", "GRAPH_REPORT.md", "graph.json", "AGENTS.md", "CLAUDE.md")) -> DataFrame:
    """FIL-14: what a search-first listing shows: folders, the names that always show, and outputs."""
    return nodes.where(F.col("is_dir") | F.col("name").isin(*always) | F.col("path").rlike(r"(^|/)model_output(/|$)"))


def full_paths(dentries: DataFrame, root: int = 1) -> DataFrame:
    """JOI-14: (ino, path) by walking down from the root, a level a round, until no child is left, however deep. Each
    level is written, so the plan doesn't grow with the depth. An entry below itself, which would go on for ever, is an
    error; entries that the root doesn't reach have no path."""
    from corpusloom.plans.lineage import cut

    level = cut(dentries.where((F.col("parent_ino") == root) & (F.col("ino") != root)).select("ino", F.concat(F.lit("/"), "name").alias("path"), F.array("parent_ino", "ino").alias("seen")))
    out, rounds = level.select("ino", "path"), 0
    while not level.isEmpty():
        below = level.withColumnRenamed("ino", "parent_ino").join(dentries, "parent_ino")
        level = cut(below.select("ino", F.concat("path", F.lit("/"), "name").alias("path"), F.array_append("seen", F.col("ino")).alias("seen"), F.array_contains("seen", F.col("ino")).alias("again")))
        if not level.where("again").isEmpty():
            raise ValueError("the entries have a cycle")
        level, rounds = level.drop("again"), rounds + 1
        out = out.unionByName(level.select("ino", "path"))
        if rounds % 50 == 0:
            out = cut(out)
    return out


def completeness(**tables: DataFrame) -> DataFrame:
    """CUR-22: (layer, rows) of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("layer"), F.count("*").alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out


def mean_vectors(vectors: DataFrame, key: str) -> DataFrame:
    """EMB-07: (key, pos, avg): means of the components. Vectors of another width than the widest lane's are left out of
    the sums yet counted."""
    width = vectors.agg(F.max(F.size("embedding")).alias("w"))
    own = vectors.crossJoin(F.broadcast(width))  # one row
    count = own.groupBy(key).agg(F.count("*").alias("n"))
    sums = own.where(F.size("embedding") == F.col("w")).select(key, F.posexplode("embedding").alias("pos", "x")).groupBy(key, "pos").agg(F.sum(F.col("x").cast("double")).alias("s"))
    return sums.join(count, key).select(key, "pos", (F.col("s") / F.col("n")).alias("avg"))


def first_wins(df: DataFrame, *key: Column | str, order: str) -> DataFrame:
    """SET-03: one row for each key, the first by order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_r = 1").drop("_r")
