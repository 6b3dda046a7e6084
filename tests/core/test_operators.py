import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import bm25, chunking, drift, fusion, graph, grounding, parsing, store, vectors
from tessera.session import spread
from tessera.sources import files as src
from tessera.streaming import progress


def test_bm25_golden(spark):
    docs = spark.createDataFrame([("1", "handleRoute\nfunc handleRoute(r)"), ("2", "parseConfig\nfunc parseConfig(p)"), ("3", "Server\ntype Server struct")], "id string, text string")
    index = bm25.build_index(docs)
    q = spark.createDataFrame([(1, "handle route"), (2, "parse config"), (3, "")], "query_id long, text string")
    top = bm25.top_k(bm25.scores(index, q), 5).collect()
    assert {(r.query_id, r.id) for r in top if r.rank == 1} == {(1, "1"), (2, "2")} and all(r.score > 0 for r in top)


def test_nearest_ties_and_blocks(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(k, [rng.choice([0.0, 1.0, 2.0]) for _ in range(4)]) for k in range(300)] + [(900, None), (901, [1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    q = df.where("id % 20 = 0 and id < 900").withColumnRenamed("id", "query_id")
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 4)

    def cos(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / n, 6) if n else 0.0

    got = {(r.query_id, r["rank"]): r.id for r in vectors.nearest(df, q, 5).collect()}
    for i, v in rows[:300:20]:
        best = sorted(((-cos(v, w), j) for j, w in rows[:300]))[:5]
        assert [got[i, n + 1] for n in range(5)] == [j for _, j in best]


def test_rrf(spark):
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id long, id string, rank long")
    b = spark.createDataFrame([(1, "b", 1), (1, "d", 2), (1, "a", 3)], "query_id long, id string, rank long")
    got = [(r.id, r.score) for r in fusion.fuse([a, b], 4).orderBy("rank").collect()]
    assert got == [("b", 0.032522), ("a", 0.032266), ("d", 0.016129), ("c", 0.015873)]


def test_evaluate(spark):
    ranked = spark.createDataFrame([(1, "x", "f", 1), (1, "y", "g", 2), (2, "y", "g", 2), (3, "z", "h", 6)], "query_id long, file string, symbol string, rank long")
    want = spark.createDataFrame([(1, "y", None), (2, "y", "other"), (3, "z", "h")], "query_id long, file string, symbol string")
    r = fusion.evaluate(ranked, want).first()
    assert (r.cases, r.mrr, r.recall) == (3, round(0.5 / 3, 6), round(1 / 3, 6))


def _windows(text, c):
    """The rule, line by line."""
    lines = text.split("\n")
    count = [len(re.findall(r"[A-Za-z_]\w*|\d+|[^\s\w]", x)) for x in lines]
    safe, depth = [True], 0
    for x in lines:
        for ch in x:
            depth = depth + 1 if ch in "([{" else max(0, depth - 1) if ch in ")]}" else depth
        safe.append(depth == 0)
    out, start = [], 0
    while start < len(lines):
        end, total = start, 0
        while end < len(lines) and (end == start or total + count[end] <= c.max_tokens):
            total += count[end]
            end += 1
        if end < len(lines):
            end = next((k for k in range(end, start, -1) if safe[k]), end)
        out.append((start, end, sum(count[start:end])))
        if end == len(lines):
            return out
        back, held = end, 0
        while back > 0 and held < c.overlap:
            back -= 1
            held += count[back]
        back = next(k for k in range(back, -1, -1) if safe[k])
        start = back if back > start else end
    return out


@pytest.mark.parametrize("seed", range(4))
def test_windows_against_the_rule(seed):
    rng = random.Random(seed)
    c = chunking.ChunkConfig(40, 10, 4)
    for _ in range(60):
        lines = ["".join(rng.choice(["a ", "bb ", "1 ", "( ", ") ", "{ ", "} ", "+ "]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 60))]
        text = "\n".join(lines)
        assert chunking.windows(text, c) == _windows(text, c)


def test_windows_end(spark):
    c = chunking.ChunkConfig(128, 24, 8)
    one_line = "x = [" + ", ".join(f"item{k}" for k in range(400)) + "]"
    assert chunking.windows(one_line, c)[-1][1] == 1
    open_text = "d = {\n" + "\n".join(f'    "key{k}": {k},' for k in range(200))
    got = chunking.windows(open_text, c)
    assert got[0][0] == 0 and got[-1][1] == 201
    df = spark.createDataFrame([(1, "a.py", "f", open_text, 5), (2, "a.py", "g", "x = 1", 1), (3, "a.py", "h", None, 1)], "parsed_id long, file_path string, symbol_name string, body string, start_line int")
    rows = chunking.split_symbols(df, c).orderBy("part").collect()
    assert [r.part for r in rows] == list(range(len(rows))) and {r.part_total for r in rows} == {len(rows)} and rows[0].start_line == 5 and len({r.chunk_id for r in rows}) == len(rows)
    with pytest.raises(ValueError):
        chunking.ChunkConfig(64, 64)


PY = '"""Doc."""\n\n\ndef top(a, b):\n    """Adds."""\n    return a + b\n\n\nclass Greeter:\n    """Says."""\n\n    def greet(self) -> str:  # note\n        return top("x", "y")\n'
GO = "package a\n\n// Server serves.\ntype Server struct {\n\tname string\n}\n\nfunc handle(s string) error {\n\treturn nil\n}\n\n// Start begins.\nfunc (s *Server) Start() error {\n\treturn handle(s.name)\n}\n"


def test_parsing():
    got = [(r[0], r[1], r[5], r[6]) for r in parsing.parse_text("a.py", PY, "python")]
    assert got == [("top", "function", 4, 6), ("Greeter", "class", 9, 13), ("greet", "method", 12, 13)]
    top, _, greet = parsing.parse_text("a.py", PY, "python")
    assert top[2] == "def top(a, b)" and top[3] == "Adds." and greet[2] == "def greet(self) -> str"
    got = [(r[0], r[1], r[3], r[5], r[6]) for r in parsing.parse_text("a.go", GO, "go")]
    assert got == [("Server", "type", "// Server serves.", 4, 6), ("handle", "function", "", 8, 10), ("Start", "method", "// Start begins.", 13, 15)]
    assert parsing.parse_text("a.txt", "line one\nline two\n", None) == [("a.txt", "file", "", "", "line one\nline two\n", 1, 3)]
    assert parsing.parse_text("a.py", "def (", "python")[0][1] == "file"


def _chunks(spark):
    rows = [
        ("h", "r", "s.py", "helper", "function", 1, 2, "def helper():\n    return 1"), ("d", "r", "s.py", "driver", "function", 4, 5, "def driver():\n    return helper()"),
        ("S", "r", "s.py", "Service", "class", 7, 9, "class Service:\n    def run(self):\n        return driver()"), ("u", "r", "s.py", "run", "method", 8, 9, "def run(self):\n        return driver()"),
        ("o", "other", "t.py", "helper", "function", 1, 2, "def helper(): pass"), ("G", "r", "g.go", "Server", "type", 1, 2, "type Server struct {}"), ("m", "r", "g2.go", "Start", "method", 1, 2, "func (s *Server) Start() {}"),
    ]
    return spark.createDataFrame(rows, "chunk_id string, repo_id string, file_path string, symbol_name string, kind string, start_line int, end_line int, body string")


def test_graph(spark):
    c = _chunks(spark)
    edges = {(r.src, r.dst): r.type for r in graph.build(c).collect()}
    assert edges == {("d", "h"): "calls", ("u", "d"): "calls", ("S", "d"): "calls", ("u", "S"): "implements", ("S", "u"): "calls", ("m", "G"): "implements"}
    names = spark.createDataFrame([("d", "r", "helper")], "src string, repo_id string, name string")
    assert {(r.src, r.dst): r.type for r in graph.build(c, names).collect()}[("d", "h")] == "imports"


def test_walks(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "seed string")
    got = {r.id: r.depth for r in graph.neighbours(edges, seeds, 2).collect()}
    assert got == {"b": 1, "x": 1, "c": 2}
    assert graph.neighbours(edges, seeds, 0).count() == 0
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, id string, rank long")
    grown = [(r.id, r.seed) for r in graph.expand(edges, ranked, 1, 4).orderBy("rank").collect()]
    assert grown == [("a", True), ("b", True), ("x", False), ("c", False)]


def test_citations(spark):
    answers = spark.createDataFrame([(1, "ok [r.py:1-5]"), (2, "far [r.py:999]"), (3, "turned [r.py:5-2]"), (4, "gone [x.py:1]"), (5, "nothing"), (6, "out [../r.py:1]")], "answer_id long, text string")
    files = spark.createDataFrame([("r.py", "\n".join(f"line {k}" for k in range(1, 11)))], "file string, content string")
    checks = grounding.validate(answers, files)
    assert {r.answer_id: r.ok for r in grounding.answer_ok(checks, answers).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


def test_grounding(spark):
    answers = spark.createDataFrame([(1, "the cat sat. a dog"), (2, ""), (3, "words here")], "answer_id long, text string")
    premises = spark.createDataFrame([(1, "the cat sat down"), (1, "a bird")], "answer_id long, premise string")
    got = {r.answer_id: (r.score, r.verdict) for r in grounding.ground(answers, premises).collect()}
    assert got == {1: (0.75, "high"), 2: (0.0, "none"), 3: (0.0, "none")}


def test_drift(spark):
    claims = spark.createDataFrame([(1, "handle route returns path"), (2, "zzz yyy"), (3, "other words")], "claim_id long, claim string")
    near = spark.createDataFrame([(1, "a", 1, "def handle route returns path"), (1, "b", 2, "handle route returns path"), (2, "a", 1, "")], "claim_id long, chunk_id string, rank long, text string")
    got = {r.claim_id: (r.status, r.score, r.chunk_id) for r in drift.check(claims, near).collect()}
    assert got == {1: ("supported", 1.0, "a"), 2: ("contradicted", 0.5, "a"), 3: ("not_found", 0.0, None)}
    report = json.loads(drift.report_json(drift.check(claims, near)).first().report)
    assert report == {"counts": {"contradicted": 1, "not_found": 1, "supported": 1}, "has_contradictions": True}
    raw = spark.createDataFrame([("a.md", 'x [{"claim": " one ", "line": 99}, {"line": 2}, {"claim": "two", "line": "x"}] y', 5), ("b.md", "no json", 3)], "doc_file string, raw string, n_lines int")
    assert [(r.claim, r.doc_line) for r in drift.parse_claims(raw).orderBy("pos").collect()] == [("one", 5), ("two", 1)]


IGNORED = ["vendor/a.go", "a/vendor/b.go", "node_modules/x/y.js", "dist/app.js", "a/b/x.min.js", "x.pb.go", "a/x_pb2.py", "x.generated.ts", ".git/config", "a/__pycache__/b.py", "site-packages/z.py", "./build/x.c"]
KEPT = ["src/main.go", "vendored/a.go", "a/distribution.py", "minx.js"]


def test_ignore(spark):
    df = spark.createDataFrame([(p,) for p in IGNORED + KEPT + ["keep.min.js", "docs/a/b.py", "logs/x.py"]], "path string")
    got = {r.path for r in df.where(src.is_ignored(F.col("path"), ["!keep.min.js", "docs/**/b.py", "/logs/", "# note", ""])).collect()}
    assert got == {*IGNORED, "docs/a/b.py", "logs/x.py"}


def test_store(spark):
    old = spark.createDataFrame([("r", "a", "1", "t0"), ("r", "b", "2", "t0")], "repo_id string, path string, h string, created string")
    new = spark.createDataFrame([("r", "b", "3", "t9"), ("r", "c", "4", "t9")], "repo_id string, path string, h string, created string")
    got = {(r.path, r.h, r.created) for r in store.upsert(old, new, ["repo_id", "path"], keep=("created",)).collect()}
    assert got == {("a", "1", "t0"), ("b", "3", "t0"), ("c", "4", "t9")}
    change = {(r.path, r.change) for r in src.changed(old.select("repo_id", "path", F.col("h").alias("content_hash")), new.select("repo_id", "path", F.col("h").alias("content_hash"))).collect()}
    assert change == {("a", "removed"), ("b", "modified"), ("c", "added")}


def test_streaming_state_over_many_batches(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:{k % 60:02d}:00", k % 3, f"type{k % 5}", 0.0, "{}") for k in range(90)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for n in range(3):
        events.where(f"event_id % 3 = {n}").coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
    events.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    want = {tuple(r) for r in progress.current_state(events).select("user_id", "event_type", "ts", "events").collect()}
    assert {tuple(r) for r in progress.stream_state(spark, str(tmp_path / "events.parquet"), events.schema).collect()} == want


def test_frames(spark):
    raw = spark.createDataFrame([(1, "event: token\ndata: a b\n\nevent: done\ndata: {}\n\n")], "stream_id long, raw string")
    assert [(r.event, r.data) for r in progress.parse_frames(raw).orderBy("seq").collect()] == [("token", "a b"), ("done", "{}")]


@pytest.mark.parametrize("most", [2_000, 5])
def test_nearest_with_queries_of_other_lengths(spark, monkeypatch, most):
    """A query of another length takes nothing from the rest, and has the neighbours of its own length."""
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", most)
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=3 if k % 4 else 2).tolist()) for k in range(60)]
    asked = [(k, rng.normal(size=n).tolist()) for k, n in enumerate([3] * 12 + [2] * 3 + [7])]
    got = {(r.query_id, r["rank"]): r.id for r in vectors.nearest(spark.createDataFrame(rows, "id long, vector array<double>"), spark.createDataFrame(asked, "query_id long, vector array<double>"), 4).collect()}
    want = {}
    for q, v in asked:
        near = sorted((-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 6), k) for k, w in rows if len(w) == len(v))
        want |= {(q, n): k for n, (_, k) in enumerate(near[:4], 1)}
    assert got == want and len({q for q, _ in got}) == 15


def test_segments_softmax_and_names(spark):
    rows = spark.createDataFrame([(1, "See [a.py:1-2] and [b.py:7]. End", "/src/demo.git/"), (2, "[a.py:1]", "git@host:team/tool.git"), (3, "none", "x"), (4, "", ""), (5, None, None)], "id long, text string, place string")
    got = {r.id: r.s and [tuple(x) for x in r.s] for r in rows.select("id", T.segments(F.col("text")).alias("s")).collect()}
    assert got == {1: [("prose", "See "), ("citation", "a.py:1-2"), ("prose", " and "), ("citation", "b.py:7-7"), ("prose", ". End")], 2: [("citation", "a.py:1-1")], 3: [("prose", "none")], 4: [], 5: None}
    assert {r.id: r.n for r in rows.select("id", T.base_name(F.col("place")).alias("n")).collect()} == {1: "demo", 2: "tool", 3: "x", 4: "", 5: None}
    z = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1000.0, 1000.0],), ([],), (None,)], "z array<double>").select(T.softmax(F.col("z")).alias("p")).collect()
    assert [round(x, 6) for x in z[0].p] == [0.090031, 0.244728, 0.665241] and z[1].p == [0.5, 0.5] and z[2].p is None and z[3].p is None


def test_model_seams(spark):
    logits = grounding.from_logits(lambda p, h: F.when(F.contains(p, h), F.array(F.lit(0.0), F.lit(50.0), F.lit(0.0))).otherwise(F.array(F.lit(50.0), F.lit(0.0), F.lit(0.0))))
    a = spark.createDataFrame([(1, "yes."), (2, "no.")], "answer_id long, text string")
    p = spark.createDataFrame([(1, "c", "oh yes. it is"), (2, "d", "it isn't")], "answer_id long, chunk_id string, premise string")
    assert {r.answer_id: r.score for r in grounding.ground(a, p, logits).collect()} == {1: 1.0, 2: 0.0}
    rows = spark.createDataFrame([(1, "a", 1, "q", "long text"), (1, "b", 2, "q", "x")], "query_id long, id string, rank long, query string, text string")
    assert [r.id for r in fusion.rerank(rows, 2, lambda query, text: -F.length(text)).orderBy("rank").collect()] == ["b", "a"]
    parsed = spark.createDataFrame([(1, "a.py", "f", "one\ntwo\nthree", 1)], "parsed_id long, file_path string, symbol_name string, body string, start_line int")
    assert chunking.split_symbols(parsed, chunking.ChunkConfig(10, 2, 1), len).count() > 1
    cited = spark.createDataFrame([(1, "c")], "answer_id long, chunk_id string")
    context = spark.createDataFrame([(1, "c", "x"), (1, "d", "y"), (2, "e", "z")], "answer_id long, chunk_id string, premise string")
    assert {tuple(r) for r in grounding.premises_of(cited, context).collect()} == {(1, "c", "x"), (2, "e", "z")}


def test_cache(spark, tmp_path):
    cache = store.Cache(spark, str(tmp_path / "cache"))
    wanted = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "key string, n int")
    assert cache.get(wanted).count() == 0 and (cache.hits, cache.misses) == (0, 2)
    calls = []

    def make(rows):
        calls.append(sorted({r.key for r in rows.collect()}))
        return rows.select("key", F.concat("key", F.lit("!")).alias("value"))

    for _ in range(2):
        assert {tuple(r) for r in cache.get_or_set(wanted.distinct(), make).collect()} == {("a", "a!"), ("b", "b!")}
    assert calls == [["a", "b"], []]
    cache.set(spark.createDataFrame([("a", "new")], "key string, value string"))
    assert {tuple(r) for r in cache.entries().collect()} == {("a", "new"), ("b", "b!")}
    assert cache.invalidate(spark.createDataFrame([("a",), ("zz",)], "key string")) == 1
    assert {r.key: r.present for r in cache.has(wanted).collect()} == {"a": False, "b": True}
    cache.clear()
    assert cache.entries().count() == 0 and (cache.hits, cache.misses) == (0, 0)
    assert store.valid_requests(spark.createDataFrame([("p", None), (None, "u"), (None, None)], "path string, url string")).count() == 2


def test_call_links(spark):
    got = {(r.src, r.name): r.definitions for r in graph.call_links(_chunks(spark)).collect()}
    assert got == {("d", "helper"): 1, ("S", "driver"): 1, ("S", "run"): 1, ("u", "driver"): 1}


def test_spread_runs_nothing(spark):
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    small = spark.range(10).toDF("id")
    spread(small.groupBy("id").count())
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before and spread(small).count() == 10
