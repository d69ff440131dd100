"""Queries over whole tables against plain versions of their own."""

import os
import random
from collections import defaultdict

import duckdb
import pytest
from oracle import compare
from pyspark.sql import functions as F

from corpusloom.operators import graph, maintenance
from corpusloom.plans import lineage, registry
from corpusloom.plans.book import Tables
from corpusloom.plans.graph_queries import _matched


def test_prior_runs_thirty_rounds(spark, small):
    """Against plain PageRank over the same edges and seeds."""
    t = Tables(spark, small)
    near, seeds = defaultdict(list), {"e" + r.path for r in _matched(t).collect()}
    for r in t.edges.collect():
        a, b = "f" + r.from_path, "e" + r.to_path
        near[a].append(b)
        near[b].append(a)
    seeds &= near.keys()
    mass = dict.fromkeys(seeds, 1 / len(seeds))
    for _ in range(30):
        after = defaultdict(float, dict.fromkeys(seeds, 0.5 / len(seeds)))
        for a, m in mass.items():
            for b in near[a]:
                after[b] += 0.5 * m / len(near[a])
        mass = after
    files = {a[1:]: m for a, m in mass.items() if a[0] == "f"}
    most = max(files.values())
    rows = registry.QUERIES["grf11_ppr_prior"](spark, small).collect()
    assert len(rows) == t.orders.count()
    for r in rows:
        assert r.prior == pytest.approx(0.12 * files.get(r.filepath, 0) / most, abs=2e-9) and r.connected == (files.get(r.filepath, 0) > 0)
    assert sum(r.connected for r in rows) > 0


def test_references_of_all_brands_are_resolved(spark, small):
    """Against pairs of rows of part."""
    part = Tables(spark, small).part.collect()
    by_name = defaultdict(list)
    for r in part:
        by_name[r.p_name].append(r)
    want = set()
    for r in part:
        relation, kind = ("calls", 0) if r.p_size % 3 == 0 else ("inherits", 1)
        want |= {(f"/sym/{r.p_partkey}", f"/sym/{s.p_partkey}", relation) for s in by_name[r.p_name] if s.p_partkey != r.p_partkey and s.p_size % 2 == kind}
    got = [(r.source, r.target, r.relation) for r in registry.QUERIES["grf34_resolve"](spark, small).collect()]
    assert sorted(got) == sorted(want)


def test_files_are_read_back_whole(spark):
    sizes = [0, 1, 4095, 4096, 4097, 9001, 150_000]
    files = [(i, bytearray((7 * j + i) % 251 for j in range(n))) for i, n in enumerate(sizes)] + [(90, bytearray(10_000) + b"x"), (91, bytearray(20_000))]
    own = spark.createDataFrame(files, "ino long, data binary")
    told = own.select("ino", F.octet_length("data").alias("size"))
    blocks = maintenance.blocks_of(own)
    assert {r.ino: bytes(r.data) for r in maintenance.read_bytes(blocks, told).collect()} == {i: bytes(d) for i, d in files}
    assert {r.ino: bytes(r.data) for r in maintenance.read_bytes(blocks, told, 5000).collect()} == {i: bytes(d[5000:]) for i, d in files}


def test_paths_of_any_depth(spark):
    deep = [(1, 1, "root")] + [(i, i - 1, f"d{i}") for i in range(2, 103)] + [(900, 901, "lost"), (901, 900, "lost")]
    rows = {r.ino: r.path for r in maintenance.full_paths(spark.createDataFrame(deep, "ino long, parent_ino long, name string")).collect()}
    assert rows == {i: "".join(f"/d{j}" for j in range(2, i + 1)) for i in range(2, 103)}
    with pytest.raises(ValueError, match="cycle"):
        maintenance.full_paths(spark.createDataFrame([(2, 1, "a"), (3, 2, "b"), (2, 3, "c")], "ino long, parent_ino long, name string"))


def agrees(spark, folder, name, **tables):
    """The query over these tables (duckdb's SELECTs) against its SQL: what differs, or empty."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"CREATE TABLE {table} AS {sql}")
        con.execute(f"COPY {table} TO '{folder}/{table}.parquet' (FORMAT parquet)")
    return compare(registry.QUERIES[name](spark, str(folder)), con, registry.ORACLES[name])


def test_users_beyond_a_thousand_are_not_retargeted(spark, tmp_path):
    """Users at both sides of 1000, among them pairs of which one's new path is the other's own, negative ones and none."""
    events = "SELECT row_number() OVER () AS event_id, user_id, event_type FROM (SELECT unnest([-995, 3, 5, 5, 999, 1000, 1005, 1999, 2005, NULL]) AS user_id) CROSS JOIN (SELECT unnest(['click', 'view']) AS event_type)"
    assert agrees(spark, tmp_path, "dml05_retarget", events=events) == ""


def test_half_balances_are_rounded_as_in_sql(spark, tmp_path):
    customer = "SELECT CAST(i AS BIGINT) AS c_custkey, i % 3 AS c_nationkey, (i - 100) / 2.0::DOUBLE AS c_acctbal FROM range(200) t(i)"
    assert agrees(spark, tmp_path, "grf33_nesting", customer=customer) == ""


def test_modularity_of_the_projection_makes_no_pairs(spark, small):
    """Against the modularity of the pairs, with files of no, one and two communities, entities of too many files, and
    nulls; and lineitem is read once, not joined with itself."""
    rng = random.Random(4)
    edges = [(f"f{rng.randint(0, 40)}", f"e{rng.randint(0, 30)}") for _ in range(200)] + [(f"f{i}", "hub") for i in range(70)] + [(None, "e1"), ("f1", None), (None, "x"), ("f2", "x"), ("f3", "e1"), ("f3", "e1")]
    part = [(f"f{i}", i % 5) for i in range(35)] + [("f3", 4), ("f3", 4), ("f7", 0), ("f8", None), (None, 1), ("g", 2)]
    e, p = spark.createDataFrame(edges, "from_path string, to_path string"), spark.createDataFrame(part, "node string, community long")
    pairs = graph.projection(e)
    for place in (p, p.where("community < 3"), p.where("node <> 'f3' AND node <> 'f7'")):
        want = graph.modularity(pairs, place).first().modularity
        assert graph.projection_modularity(e, place).first().modularity == pytest.approx(want, abs=1e-12)
    assert graph.projection_modularity(e.where("to_path = 'x'"), p).first().modularity is None
    plan = registry.QUERIES["grf21_modularity"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_partkey") and plan.count("Relation [l_orderkey") == 1


def test_resolved_pairs_are_not_moved(spark):
    """Against pairs of rows: symbols of several names and kinds, rows that come twice, nulls. The distinct over pairs is
    for symbols of several names alone."""
    rng = random.Random(6)
    kinds = ["function", "method", "class", "enum", "module", None]
    symbols = [(f"s{rng.randint(0, 30)}", f"m.{rng.choice('abcdef')}", rng.choice(kinds)) for _ in range(90)] + [(None, "m.a", "class")]
    references = [(f"s{rng.randint(0, 30)}", f"q::{rng.choice('abcdef')}", rng.choice(["calls", "inherits", "uses", "imports"])) for _ in range(90)]
    fits = {"calls": ("function", "method"), "inherits": ("class", "enum"), "uses": ("class", "enum")}
    want = {(a, b, k) for a, n, k in references for b, m, kind in symbols if b and a != b and n[-1] == m[-1] and kind in fits.get(k, ())}
    found = graph.resolved(spark.createDataFrame(references, "source string, name string, kind string"), spark.createDataFrame(symbols, "path string, name string, kind string"))
    assert sorted((r.source, r.target, r.relation) for r in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.splitlines()[0].startswith("Union")


def test_walk_goes_by_half_steps_and_leaves_no_step(spark):
    """Against all mass moved in each round, with edges that come twice; and tables of steps are removed, so that the
    folder doesn't grow with the rounds."""
    rng = random.Random(9)
    edges = [(f"/f{rng.randint(0, 20)}", f"/e{rng.randint(0, 15)}") for _ in range(60)] + [("/alone", "/x"), ("/f1", None)]
    near = defaultdict(list)
    for a, b in edges:
        near["f" + a].append(b and "e" + b)
        if b:
            near["e" + b].append("f" + a)
    df, seeds = spark.createDataFrame(edges, "from_path string, to_path string"), spark.createDataFrame([("/e1",), ("/e2",), ("/e2",), ("/none",)], "path string")
    for rounds, restart in ((1, 0.5), (2, 0.5), (3, 0.2), (8, 0.5), (9, 0.5)):
        own = {"e/e1", "e/e2"}
        mass = dict.fromkeys(own, 1 / 2)
        for _ in range(rounds):
            after = defaultdict(float, dict.fromkeys(own, restart / 2))
            for a, m in mass.items():
                for b in near[a]:
                    after[b] += (1 - restart) * m / len(near[a])
            mass = {a: m for a, m in after.items() if a}
        want = {a[1:]: m for a, m in mass.items() if a[0] == "f"}
        before = set(os.listdir(lineage.folder(df).removeprefix("file:")))
        got = {r.filepath: r.mass for r in graph.pagerank(df, seeds, restart, rounds).collect()}
        assert got == pytest.approx({a: m / max(want.values()) for a, m in want.items()}, rel=1e-9)
        assert len(set(os.listdir(lineage.folder(df).removeprefix("file:"))) - before) <= 5
    assert graph.pagerank(df, seeds, rounds=0).count() == 0 and graph.pagerank(df, seeds.where("path = '/none'")).count() == 0


def _walked(edges, own, rounds, restart=0.5):
    """Files' mass over the largest, by plain rounds."""
    near = defaultdict(list)
    for a, b in edges:
        if a:
            near["f" + a].append(b and "e" + b)
        if b:
            near["e" + b].append(a and "f" + a)
    mass = dict.fromkeys(own, 1 / len(own))
    for _ in range(rounds):
        after = defaultdict(float, dict.fromkeys(own, restart / len(own)))
        for a, m in mass.items():
            for b in near[a]:
                after[b] += (1 - restart) * m / len(near[a])
        mass = {a: m for a, m in after.items() if a}
    files = {a[1:]: m for a, m in mass.items() if a[0] == "f"}
    return {a: m / max(files.values()) for a, m in files.items()}


def test_walk_by_blocks_of_any_size(spark):
    """Files over many blocks, blocks without an entity, a hub on either side, edges that come twice and without an end."""
    rng = random.Random(13)
    edges = [(f"/f{rng.randint(0, 40)}", f"/e{rng.randint(0, 25)}") for _ in range(120)]
    edges += [("/hub", f"/e{i}") for i in range(0, 40, 2)] + [(f"/f{i}", "/hub") for i in range(0, 60, 3)] + [("/a", None), ("/zz", None), (None, "/e1"), (None, "/hub"), (None, None), ("/f1", None), ("/far", "/away")]
    df, seeds = spark.createDataFrame(edges, "from_path string, to_path string"), spark.createDataFrame([("/e1",), ("/hub",), ("/e1",), (None,), ("/none",)], "path string")
    for block, rounds, restart in ((1, 5, 0.5), (20, 6, 0.3), (20, 2, 0.5), (70, 30, 0.5)):
        got = {r.filepath: r.mass for r in graph.pagerank(df, seeds, restart, rounds, block=block).collect()}
        assert got == pytest.approx(_walked(edges, ["e/e1", "e/hub"], rounds, restart), rel=1e-9)


def test_walk_moves_the_edges_once(spark):
    """The rows of all shuffles of a walk are the edges and a few for each block, however many the rounds."""

    def moved() -> dict:
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (stages.apply(i) for i in range(stages.size()))}

    rng = random.Random(14)
    edges = list({(f"/f{i}", f"/e{rng.randint(0, 49)}") for i in range(1000) for _ in range(5)})
    df, seeds = spark.createDataFrame(edges, "from_path string, to_path string"), spark.createDataFrame([("/e1",)], "path string")
    before = moved()
    got = {r.filepath: r.mass for r in graph.pagerank(df, seeds, rounds=9).collect()}
    assert sum(n for k, n in moved().items() if k not in before) < 2 * len(edges)
    assert got == pytest.approx(_walked(edges, ["e/e1"], 9), rel=1e-9)


def test_resolved_pairs_take_little_space(spark, tmp_path):
    """Four and a half million pairs of two names, whole and written in less than a quarter of a byte each."""
    n, m = 1501, 1503
    symbols = spark.range(2 * m).selectExpr("concat('/sym/', id) AS path", "concat('a.', id % 2) AS name", "'class' AS kind")
    references = spark.range(2 * n).selectExpr("concat('/ref/', id) AS source", "concat('b.', id % 2) AS name", "'inherits' AS kind")
    found = graph.resolved(references, symbols).select("source", "target", "relation", "confidence")
    found.write.parquet(f"{tmp_path}/pairs")
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 2 * n * m / 4
    right = "CAST(split_part(source, '/', 3) AS INT) % 2 = CAST(split_part(target, '/', 3) AS INT) % 2"
    assert duckdb.sql(f"SELECT count(DISTINCT (source, target)), count(*), bool_and({right}) FROM '{tmp_path}/pairs/*.parquet'").fetchall() == [(2 * n * m, 2 * n * m, True)]
