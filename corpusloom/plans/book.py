"""Registration of queries, and the logical tables that they take from the driver's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same tables as SQL, to begin an oracle's WITH.
FILES = """files AS (SELECT doc_id, doc_id AS chunk_id, lang, concat('/', source, '/', lang, '/doc_', doc_id, CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.py' WHEN 2 THEN '.txt' ELSE '.csv' END) AS filepath, coalesce(text, '') AS text FROM documents)"""
EDGES = """edges AS (SELECT concat('/orders/', l_orderkey, '.md') AS from_path, concat('/parts/', l_partkey) AS to_path, l_returnflag AS edge_kind FROM lineitem)"""
ENTITIES = """entities AS (SELECT concat('/parts/', p_partkey) AS path, p_name AS name, p_brand AS kind FROM part)"""
COMMUNITIES = """communities AS (SELECT concat('/orders/', o_orderkey, '.md') AS file_path, CAST(c_nationkey AS BIGINT) AS community_id FROM orders JOIN customer ON c_custkey = o_custkey)"""


class Book:
    """Queries by name, with their oracles."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(Tables(spark, sf_dir))

            run.__name__, run.__doc__ = name, f.__doc__
            self.queries[name] = run
            if sql:
                self.oracles[name] = sql
            return f

        return add


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def files(self) -> DataFrame:
        ext = F.when(F.col("doc_id") % 4 == 0, ".md").when(F.col("doc_id") % 4 == 1, ".py").when(F.col("doc_id") % 4 == 2, ".txt").otherwise(".csv")
        path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), ext)
        return self.documents.select("doc_id", F.col("doc_id").alias("chunk_id"), "lang", path.alias("filepath"), F.coalesce("text", F.lit("")).alias("text"))

    @property
    def edges(self) -> DataFrame:
        return self.lineitem.select(F.concat(F.lit("/orders/"), "l_orderkey", F.lit(".md")).alias("from_path"), F.concat(F.lit("/parts/"), "l_partkey").alias("to_path"), F.col("l_returnflag").alias("edge_kind"))

    @property
    def entities(self) -> DataFrame:
        return self.part.select(F.concat(F.lit("/parts/"), "p_partkey").alias("path"), F.col("p_name").alias("name"), F.col("p_brand").alias("kind"))

    @property
    def communities(self) -> DataFrame:
        return self.orders.join(self.customer, F.col("c_custkey") == F.col("o_custkey")).select(F.concat(F.lit("/orders/"), "o_orderkey", F.lit(".md")).alias("file_path"), F.col("c_nationkey").cast("long").alias("community_id"))
