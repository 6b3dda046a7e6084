"""Places of wanted texts against the full ranking, and known_item_eval against SQL on tables where all texts share words."""

import random

import pytest

from tessera.operators import bm25
from tessera.plans import queries

WORDS = ["the", "of", "load", "shard", "depot", "harbor", "crane", "island", "voucher", "berth"]


def _shuffled(spark):
    """Records that all stages of the session have written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


@pytest.mark.parametrize(("first", "block", "asked"), [(500_000, 4_000_000, 50_000), (40, 60, 50_000), (0, 30, 7)])
def test_places_are_those_of_the_full_ranking(spark, monkeypatch, first, block, asked):
    monkeypatch.setattr(bm25, "FIRST_WORDS", first)
    monkeypatch.setattr(bm25, "BLOCK_WORDS", block)
    monkeypatch.setattr(bm25, "BLOCK_QUERIES", asked)
    rng = random.Random(3)
    # few words and exact copies: many ties; "the" in most texts has the raised weight of a negative idf
    rows = [(f"d{k:03}", " ".join(["the"] * (k % 3) + rng.choices(WORDS, k=rng.randint(1, 9)))) for k in range(120)]
    rows += [(f"e{k:03}", rows[k % 10][1]) for k in range(30)] + [("n1", None), ("n2", "")]
    texts = spark.createDataFrame(rows, "id string, text string").repartition(3)
    wants = [(q, " ".join(rng.choices(WORDS, k=rng.randint(1, 5)))) for q in range(60)] + [(90, "unheard"), (91, ""), (92, "the the the")]
    asks = spark.createDataFrame(wants, "query_id long, text string")
    pairs = [(q, *rng.choice(rows)) for q, _ in wants for _ in range(rng.randint(0, 3))]
    pairs += [(q, *rows[k]) for q in range(0, 60, 2) for k in rng.sample(range(len(rows)), 12)]
    wanted = spark.createDataFrame(pairs, "query_id long, id string, text string").distinct()
    index = bm25.build_index(texts)
    k = 5
    full = bm25.top_k(bm25.scores(index, asks), k).join(wanted.select("query_id", "id"), ["query_id", "id"])
    want = {r.query_id: r["min(rank)"] for r in full.groupBy("query_id").agg({"rank": "min"}).collect()}
    got = {r.query_id: r["rank"] for r in bm25.places(index, texts, asks, wanted, k).collect()}
    assert got == want and len(set(got.values())) > 2


def test_places_with_negative_weights(spark):
    # all terms are in most texts, so the mean idf and with it every weight is negative or none
    texts = spark.createDataFrame([("a", "x y"), ("b", "x y"), ("c", "x y z")], "id string, text string")
    asks = spark.createDataFrame([(1, "x z"), (2, "x"), (3, "z")], "query_id long, text string")
    index = bm25.build_index(texts)
    wanted = asks.select("query_id").crossJoin(texts)
    full = {r.query_id: r["min(rank)"] for r in bm25.top_k(bm25.scores(index, asks), 5).groupBy("query_id").agg({"rank": "min"}).collect()}
    assert {r.query_id: r["rank"] for r in bm25.places(index, texts, asks, wanted, 5).collect()} == full


def test_known_items_shuffle_no_pairs(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(5)
    bodies = [" ".join(rng.choices(WORDS, k=8)) for _ in range(3000)]
    chunks = [(f"c{k:05}", "r", f"f{k % 50}.py", None if k % 97 == 0 else f"s{k}", None, x, "function", k, k + 1) for k, x in enumerate(bodies)]
    spark.createDataFrame(chunks, "chunk_id string, repo_id string, file_path string, symbol_name string, signature string, body string, symbol_type string, start_line long, end_line long").write.parquet(f"{tmp_path}/index_chunks.parquet")
    parsed = [(20 * k, bodies[k] if k % 2 else rng.choice(bodies), f"f{k % 50}.py", None if k % 97 == 0 else f"s{k}") for k in range(600)]
    parsed += [(20 * k, None if k % 2 else "the of load", "f1.py", "s1") for k in range(600, 620)]
    spark.createDataFrame(parsed, "parsed_id long, docstring string, file_path string, symbol_name string").write.parquet(f"{tmp_path}/parsed_chunks.parquet")
    before = _shuffled(spark)
    got = queries.queries()["known_item_eval"](spark, str(tmp_path)).collect()
    # 610 queries and 3,000 texts make over a million pairs that share a word
    assert _shuffled(spark) - before < 100_000
    duck = duckdb.connect()
    for name in ("index_chunks", "parsed_chunks"):
        duck.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert [tuple(r) for r in got] == duck.execute(queries.oracle_sql()["known_item_eval"]).fetchall()
