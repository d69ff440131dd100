"""Hand-computed cases: text, ranking, graph, delivery, sync, sources."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import paths, vectors
from corpusloom.functions import text as tx
from corpusloom.operators import community, curation, delivery, graph, maintenance, rank, sync
from corpusloom.sources import files as source
from corpusloom.sources import paged
from corpusloom.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_windows(spark):
    rows = [(0, "   "), (1, "short text here"), (2, " ".join(f"w{i}" for i in range(1, 26))), (3, None), (4, "")]
    out = tx.windows(spark.createDataFrame(rows, "id int, text string"), size=10, overlap=3).orderBy("id", "ord").collect()
    assert [r.chunk for r in out if r.id == 1] == ["short text here"]
    own = [r.chunk.split() for r in out if r.id == 2]
    assert [(c[0], c[-1]) for c in own] == [("w1", "w10"), ("w8", "w17"), ("w15", "w24"), ("w22", "w25")]
    assert {r.id for r in out} == {1, 2}


def test_head_keeps_characters(spark):
    for n in range(1, 14):
        got = one(spark, tx.head(F.lit("a中é😀bc"), n))
        assert got.encode() == "a中é😀bc".encode()[: len(got.encode())] and len(got.encode()) <= n
        assert "a中é😀bc".startswith(got) and len("a中é😀bc".encode()[:n].decode("utf-8", "ignore")) == len(got)


def test_stitch():
    assert tx.stitch(["the quick brown fox jumps", "brown fox jumps over the lazy dog"]) == "the quick brown fox jumps over the lazy dog"
    assert tx.stitch(["alpha", "beta"]) == "alphabeta"
    assert tx.stitch(["中文", "文字"], cap=7) == "中文"


def test_line_range(spark):
    text = F.lit("a b\nc d\ne f")
    assert tuple(one(spark, tx.line_range(text, F.lit("c d\ne")))) == (2, 3)
    assert tuple(one(spark, tx.line_range(text, F.lit("b  c\td")))) == (1, 2)
    assert one(spark, tx.line_range(text, F.lit("z"))) is None


def test_slug(spark):
    assert [one(spark, tx.slug(F.lit(x))) for x in ("Auth Service", "Acme, Inc.", "東京")] == ["auth-service", "acme-inc", "e-2f3c04f1ff1b2daf"]


def test_hash_embedder():
    for word, at, sign in (("alpha", 171, -1), ("beta", 167, -1), ("gamma", 362, 1)):
        v = vectors.hash_vector(word, 384)
        assert v[at] == sign and abs(v).sum() == 1


def test_paths(spark):
    def run(f, *values):
        return [one(spark, f(F.lit(v))) for v in values]

    assert run(paths.normalised, "//a/./b/../c/", "/..", "a/b") == ["/a/c", None, "/a/b"]
    assert run(paths.is_code, "/a/b.RS", "/a.py/b", "/x.md") == [True, False, False]
    assert run(paths.is_spreadsheet, "/a.xlsx.extracted.md", "/a.md") == [True, False]
    assert run(paths.is_noise, "/._x", "/.Trashes/a", "/a/.DS_Store", "/a") == [True, True, True, False]
    assert run(paths.top_dir, "/a/b/c", "/c") == ["/a", "/"]
    assert run(paths.good_entity, "Plan", "2024-09-26", "1,000", "x", None) == [True, False, False, False, False]
    assert run(paths.error_label, " <HTML>404 Not Found", "<html>openresty", "404 not found") == ["404 Not Found", "HTTP error", None]
    assert one(spark, paths.in_scope(F.lit("/a%b/c"), "/a%b/")) and not one(spark, paths.in_scope(F.lit("/axb/c"), "/a%b/"))
    assert paths.scope_of("/mnt/x/docs", "/mnt/x") == "/docs/" and paths.scope_of("/mnt/x", "/mnt/x") is None and paths.scope_of("a.md") == "/a.md"
    assert paths.flag("Yes") and not paths.flag("maybe") and paths.flag("maybe", True) and not paths.flag("off", True)


def lanes_of(spark, rows):
    return spark.createDataFrame(rows, "filepath string, lane string, rank int, text string")


def test_fusion(spark):
    rows = [("/f", "text", 0, "a"), ("/f", "fts", 1, "a"), ("/g", "text", 7, "b"), ("/g", "text", 2, "c"), ("/g", "fts", 3, "b")]
    got = {r.filepath: r.score for r in rank.fused(lanes_of(spark, rows)).collect()}
    assert got["/f"] == pytest.approx(1 / 60 + 1 / 61) and got["/g"] == pytest.approx(1 / 62 + 1 / 63)


def test_priors(spark):
    scores = spark.createDataFrame([("/a", 1 / 60), ("/b", 1 / 61)], "filepath string, score double")
    priors = spark.createDataFrame([("/b", 99.0), ("/missing", 0.15)], "filepath string, prior double")
    got = {r.filepath: r.score for r in rank.with_priors(scores, priors).collect()}
    assert got == {"/a": pytest.approx(1 / 60), "/b": pytest.approx(1 / 61 + 0.15)}


def test_best_texts(spark):
    rows = [("/f", "t", r, x) for r, x in ((5, "c_fifth"), (0, "a_best"), (5, "a_best"), (2, "b_second"), (9, "d_worst"))]
    assert rank.best_texts(lanes_of(spark, rows), 3).first()["text"] == "a_best\nb_second\nc_fifth"


def test_salience(spark):
    day, now = 86_400_000, 100 * 86_400_000
    for last, n, want in ((now, 0, 1.1), (now - 60 * day, 0, 0.910254192), (now, 25, 1.262904827), (now - 14 * day, 0, 1.0), (None, 0, 1.0)):
        assert one(spark, rank.salience(F.lit(last).cast("long"), F.lit(n), now)) == pytest.approx(want, abs=1e-8)


def test_reserved_place_and_pins(spark):
    rows = [(f"/{i:02}", 1 - i / 100, "x") for i in range(12)] + [("/err", 0.1, "<html>404 not found"), ("/model_output/a", 9.0, "x")]
    hits = spark.createDataFrame(rows, "filepath string, score double, text string")
    pins = spark.createDataFrame([("/05",)], "filepath string")
    got = [r.filepath for r in rank.final_order(hits, pins, 5).orderBy("rank").collect()]
    assert got == ["/05", "/00", "/01", "/02", "/err"]


def graph_fixture(spark):
    edges = [("a", "revenue"), ("a", "conversion_rate"), ("a", "q1"), ("b", "revenue"), ("c", "widget"), ("d", "q1"), ("d", "widget")]
    e = spark.createDataFrame([(f"/sales/{x}.md", y, "mentions") for x, y in edges], "from_path string, to_path string, edge_kind string")
    n = spark.createDataFrame([("revenue", "Revenue"), ("conversion_rate", "Conversion Rate"), ("q1", "Q1 Plan"), ("widget", "Widget")], "path string, name string")
    c = spark.createDataFrame([(f"/sales/{x}.md", 1) for x in "abd"] + [(f"/noise/{i}.md", 1) for i in range(40)] + [("/sales/c.md", 2)], "file_path string, community_id long")
    return e, n, c


def test_graph_priors_and_candidates(spark):
    e, n, c = graph_fixture(spark)
    matched = graph.matched_entities(n, "revenue conversion rate")
    assert {r.path for r in matched.collect()} == {"revenue", "conversion_rate"}
    files = spark.createDataFrame([(f"/sales/{x}.md",) for x in "abd"], "filepath string")
    got = {r.filepath[7]: r.prior for r in graph.priors(e, c, matched, files).collect()}
    assert got == {"a": pytest.approx(0.15), "b": pytest.approx(0.082083333), "d": pytest.approx(0.041041667)}
    rows = graph.candidates(e, c, matched, limit=16).orderBy("rank").collect()
    assert len(rows) == 11 and rows[0].filepath == "/sales/a.md" and rows[0].score == pytest.approx(0.08)
    assert [r.reason for r in rows] == [0, *[2] * 8, 0, 1]
    assert graph.candidates(e, c, graph.matched_entities(n, "revenue"), "/sales/c").count() == 0


@pytest.mark.parametrize(("rounds", "want"), [(2, {"a": 1, "b": 1}), (3, {"a": 1, "b": 0.842105263, "d": 0.052631579}), (30, {"a": 1, "b": 0.871993128, "c": 0.003436426, "d": 0.048109965})])
def test_pagerank(spark, rounds, want):
    e, n, _ = graph_fixture(spark)
    got = {r.filepath[7]: r.mass for r in graph.pagerank(e, graph.matched_entities(n, "revenue"), rounds=rounds).collect()}
    assert {k: v for k, v in got.items() if v > 1e-12} == {k: pytest.approx(v, abs=1e-8) for k, v in want.items()}
    assert graph.pagerank(e, n.where("path = 'nobody'"), rounds=1).count() == 0


def test_penalty(spark):
    assert [one(spark, graph.penalty(F.lit(n))) for n in (24, 43, 96, 200)] == [0, pytest.approx(0.007916667), 0.03, 0.03]


def test_knn_edges(spark):
    files = spark.createDataFrame(list(enumerate([[1.0, 0.0], [0.98, 0.05], [0.0, 1.0], [0.05, 0.98]])), "filepath int, embedding array<double>")
    assert {tuple(r) for r in graph.knn_edges(files, 1).collect()} == {(0, 1), (2, 3)}


def test_communities(spark):
    clique = [(a, b, 1) for s in (0, 12) for a in range(s, s + 12) for b in range(a + 1, s + 12)]
    pairs = spark.createDataFrame([*clique, (0, 12, 1)], "a long, b long, w long")
    got = {r.node: r.community for r in community.detect(pairs).collect()}
    assert {got[i] for i in range(12)} == {0} and {got[i] for i in range(12, 24)} == {12}
    g = community.Graph(24, clique + [(0, 12, 1)])
    assert community.dense([7, 7, 7, 2]) == [0, 0, 0, 1]
    assert community.connected(g, community.leiden(g)) == community.leiden(g)
    alone = community.detect(pairs, spark.createDataFrame([(99,)], "node long"))
    assert alone.where("node = 99").first()["community"] == 99


def test_hubs(spark):
    rows = [(f"f{i}", "e1") for i in range(100)] + [(f"f{i}", f"e{k}") for k in range(2, 21) for i in range(2)]
    hub = graph.hubs(spark.createDataFrame(rows, "from_path string, to_path string"))
    assert [r.to_path for r in hub.collect()] == ["e1"]


def adaptive(spark, scores):
    rows = delivery.adaptive_k(spark.createDataFrame([(float(s),) for s in scores], "score double")).collect()
    return tuple(rows[0]) if rows else None


def test_adaptive_k(spark):
    assert adaptive(spark, [0.9, 0.4, 0.35, 0.3]) == (1, "answer")
    assert adaptive(spark, [0.5 - 0.001 * i for i in range(12)]) == (6, "cluster")
    assert delivery.render_count(20, 3, explicit=5) == 5 and delivery.render_count(20, 3, everything=True) == 20 and delivery.render_count(20, 3) == 3


@pytest.mark.parametrize(("s", "complete", "want"), [((0.8, 0.5, 0.3), True, "HIGH"), ((0.8, 0.5, 0.3), False, "MEDIUM"), ((0.8, 0.78, 0.3), True, "MIXED"), ((0.034, 0.032, 0.0305), True, "HIGH"), ((0.034, 0.0338, 0.03), True, "MIXED")])
def test_confidence(spark, s, complete, want):
    assert one(spark, delivery.confidence(F.lit(3), *map(F.lit, s), F.lit(complete))) == want


def test_sufficient(spark):
    assert [one(spark, delivery.sufficient(F.lit(a), F.lit(b))) for a, b in ((4, 3), (5, 1), (0, 0))] == [True, False, False]


@pytest.mark.parametrize(("window", "want"), [(2, [None, 1, None]), (5, [None, 1, 1])])
def test_session_memory(spark, window, want):
    seen = spark.createDataFrame([(1, t, "a") for t in (1, 2, 3)], "session long, turn long, path string")
    assert [r.first_turn for r in delivery.session_dedup(seen, window).orderBy("turn").collect()] == want


def test_render_budget(spark):
    hits = spark.createDataFrame([(0, 900, "p"), (1, 300, "q"), (2, 300, "r")], "rank int, bytes int, filepath string")
    got = [(r.shown, r["mode"]) for r in delivery.budgeted(hits, budget=700, per_hit=500, short=50).orderBy("rank").collect()]
    assert got == [(500, "cut"), (300, "inline"), (50, "snippet")]


def test_coverage_verdicts(spark):
    def run(content, reachable, allowed=0, least=0.0):
        r = maintenance.verdict(spark.createDataFrame([(content, reachable)], "content long, reachable long"), allowed, least).first()
        return r.complete, r.coverage, r.reachable

    assert run(627, 616)[0] is False and run(627, 616, 11)[0] is True and run(627, 616, 100, 0.99)[0] is False
    assert run(0, 0) == (True, 1.0, 0) and run(10, 999)[2] == 10


def test_queue(spark):
    q = spark.createDataFrame([("a", 500, None, False)], "filepath string, updated_at long, inflight_started_at long, poisoned boolean")
    assert [sync.claimable(q, t).count() for t in (0, 499, 500)] == [0, 0, 1]
    event = lambda kind, seq, op="x", remote=None: {"kind": kind, "seq": seq, "op": op, "remote_id": remote}
    s = jobs.queue_step(None, event("write", 1, "create", "r1"))
    s = jobs.queue_step(s, event("claim", 2))
    s = jobs.queue_step(s, event("write", 3, "update"))
    assert s[:4] == ("create", "r1", True, "update")
    assert jobs.queue_step(s, event("ok", 4))[:4] == ("update", "r1", False, None)
    assert jobs.queue_step(jobs.queue_step(jobs.queue_step(None, event("write", 1)), event("claim", 2)), event("ok", 3)) is None
    assert jobs.queue_step(s, event("fail", 4))[4] == 1
    assert [one(spark, sync.backoff_ms(F.lit(n))) for n in (1, 2, 7, 99)] == [500, 1000, 60000, 60000]


def test_streams(spark, tmp_path):
    rows = [("p", 1, "write", "create", None), ("p", 2, "claim", None, None), ("p", 3, "write", "update", None), ("q", 4, "write", "create", "r")]
    spark.createDataFrame(rows, "filepath string, seq long, kind string, op string, remote_id string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("filepath string, seq long, kind string, op string, remote_id string").parquet(f"{tmp_path}/in")
    query = jobs.coalescing_queue(stream).writeStream.format("memory").queryName("queue_out").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    got = {r.filepath: (r.op, r.pending_op, r.inflight) for r in spark.sql("SELECT * FROM queue_out").collect()}
    assert got == {"p": ("create", "update", True), "q": ("create", None, False)}
    spark.createDataFrame([(1, t, "a") for t in (1, 2, 3)], "session long, turn long, path string").write.parquet(f"{tmp_path}/s")
    hits = spark.readStream.schema("session long, turn long, path string").parquet(f"{tmp_path}/s")
    query = jobs.session_memory(hits, 2).writeStream.format("memory").queryName("session_out").option("checkpointLocation", f"{tmp_path}/d").start()
    query.processAllAvailable()
    query.stop()
    assert [r.first_turn for r in spark.sql("SELECT * FROM session_out ORDER BY turn").collect()] == [None, 1, None]
    pulled = []
    changes = spark.readStream.schema("filepath string, seq long, kind string, op string, remote_id string").parquet(f"{tmp_path}/in").withColumnRenamed("filepath", "updated_at")
    query = jobs.pull(changes, lambda df, n: pulled.append(df.count()), f"{tmp_path}/e", last_seen="p")
    query.awaitTermination(60)
    assert sum(pulled) == 1


def xlsx(rows) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="S1"/><sheet name="Empty"/></sheets></workbook>')
        body = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' for v in r) + "</row>" for r in rows)
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", "<worksheet><sheetData/></worksheet>")
    return out.getvalue()


def docx() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:t>Hello</w:t><w:t> you</w:t></w:p><w:p><w:t>Bye</w:t></w:p></w:document>')
    return out.getvalue()


def test_sources(spark, tmp_path):
    tree = {"a/x.xlsx": b"  <!DOCTYPE html><p>403</p>", "a/s.xlsx": xlsx([["k", "v"], ["1", ""]]), "d.docx": docx(), "n.md": "naïve".encode(), "t.csv": b"a,b\n1,2", "bad.docx": b"PK\x03\x04 word/document.xml", "p.pdf": b"%PDF-1", "raw.bin": b"\xff\xfe\x00", ".git/x": b"x", "node_modules/y.js": b"y"}
    for name, data in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = source.scan(spark, str(tmp_path))
    got = {r.filepath: r.ino for r in files.collect()}
    assert sorted(got, key=got.get) == sorted(f"/{n}" for n in tree if not n.startswith((".git", "node_modules")))
    rows = {r.filepath: r for r in source.extract(files).collect()}
    assert rows["/a/x.xlsx"].route == "html" and rows["/a/x.xlsx"].text == "403"
    assert rows["/a/s.xlsx"].text == "k\tv\n1" and rows["/d.docx"].text == "Hello you\nBye"
    assert rows["/t.csv"].route == "table" and rows["/n.md"].text == "naïve"
    assert {r.filepath for r in source.ledger(source.extract(files)).collect()} == {"/bad.docx", "/p.pdf", "/raw.bin"}
    assert [tuple(r) for r in source.sheet_rows(files).collect()] == [("/a/s.xlsx", "S1", "k\tv\n1")]
    assert {r.filepath for r in source.import_list(spark, str(tmp_path)).collect()} == {f"/{n}" for n in tree if not n.startswith((".git/", "node_modules"))}


def test_paged_source(spark, tmp_path):
    import json

    docs = [{"id": str(i), "updated_at": f"2024-01-{30 - i:02}"} for i in range(25)]
    assert [d["id"] for d in paged.pages(lambda n, k: docs[n * k : n * k + k], "2024-01-27", 2)] == ["0", "1", "2"]
    (tmp_path / "d.jsonl").write_text("".join(json.dumps(d) + "\n" for d in docs))
    spark.dataSource.register(paged.JsonlPages)
    read = spark.read.format("corpusloom_pages").option("path", str(tmp_path / "d.jsonl")).option("page", 10)
    assert read.load().count() == 25 and read.option("last_seen", "2024-01-27").load().count() == 3


def test_curation(spark):
    ok, share = tx.preserves_facts(F.lit("10 of 20, see https://x.y and `z`"), F.lit("10 20, https://x.y z"))
    assert one(spark, F.struct(ok, share)) == (True, 1.0)
    assert one(spark, tx.subsequence_share(F.lit("a b c"), F.lit("a c b"))) == pytest.approx(0.667)
    assert one(spark, tx.refused(F.lit(" I'm sorry, no"))) is None and one(spark, tx.refused(F.lit(" text "))) == "text"
    assert one(spark, tx.vision_reply(F.lit("[VISUAL] a cat"))) == ("a cat", True) and one(spark, tx.vision_reply(F.lit("sorry"))) is None
    assert one(spark, tx.iso_millis(F.lit("2024-01-02T03:04:05.6789+09:00"))) == 1704164645678
    assert one(spark, curation.verdict_of(F.lit("```json\n{\"correct\": true}\n```"))) is True
    d = spark.createDataFrame([(2, "x"), (1, "x"), (1, "x"), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in curation.exact_dedup(d.where("text is not null")).collect()) == [(1, "x")]


def test_dedup_is_repeatable(spark):
    parts = [spark.createDataFrame([(f"/{i}", 0, i) for i in range(k, 20, 2)], "filepath string, ord int, chunk_id long") for k in (0, 1)]
    out = maintenance.merged_indexes(parts).collect()
    assert sorted(r.chunk_id for r in out) == [*range(1, 21)]
    assert [r.filepath for r in sorted(out, key=lambda r: r.chunk_id)] == sorted(f"/{i}" for i in range(20))


def test_search_end_to_end(spark, small):
    from corpusloom.plans.book import Tables
    from corpusloom.plans.search import Index, search

    t = Tables(spark, small)
    c = t.files.select("chunk_id", "filepath", "text")
    hits = search(Index(c), "licensed under version doc src0", limit=5).orderBy("rank").collect()
    assert [r["rank"] for r in hits] == [*range(5)]
    prefix = hits[0].filepath.rsplit("/", 1)[0] + "/"
    scoped = search(Index(c), "licensed under version doc src0", prefix=prefix).collect()
    assert scoped and all(r.filepath.startswith(prefix) for r in scoped)
    assert search(Index(c), "licensed under", profile="server").count() > 0
