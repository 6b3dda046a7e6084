from pyspark.sql import functions as F

from tessera.functions import text as T


def one(spark, make, *values):
    rows = [(v,) for v in values]
    return [r[0] for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t string").orderBy("k").select(make(F.col("t"))).collect()]


def test_code_tokens(spark):
    got = one(spark, T.code_tokens, "handleRoute", "parse_config_file", "HTTPServer", "parseURL2", "", None)
    assert got == [["handle", "route"], ["parse", "config", "file"], ["http", "server"], ["parse", "url", "2"], [], None]


def test_token_count(spark):
    assert one(spark, T.token_count, "x = 1", "naïve_x(1)", "", None) == [3, 4, 0, 0]


def test_sentences_and_citations(spark):
    assert one(spark, T.sentences, "One thing. Two things! Three?", "see [router.py:1-5].") == [["One thing.", "Two things!", "Three?"], ["see [router.", "py:1-5]."]]
    got = one(spark, T.citations, "a [router.py:1-5]. b [pkg/auth.py:2] and [router.py:1-5]", "none")
    assert [tuple(x) for x in got[0]] == [("router.py", 1, 5), ("pkg/auth.py", 2, 2)] and got[1] == []


def test_chunk_id_is_uuid5(spark):
    import hashlib
    import uuid

    space = uuid.UUID(T.CHUNK_NAMESPACE)
    rows = [("a.py", "f", k, f"body é {k}") for k in range(50)]
    df = spark.createDataFrame(rows, "p string, s string, n int, b string")
    got = {r.n: r.i for r in df.select("n", T.chunk_id(F.col("p"), F.col("s"), F.col("n"), F.col("b")).alias("i")).collect()}
    for p, s, n, b in rows:
        assert got[n] == str(uuid.uuid5(space, f"{p}|{s}|{n}|{hashlib.sha256(b.encode()).hexdigest()}"))


def test_sha_vector(spark):
    import hashlib

    got = one(spark, T.sha_vector, "abc")[0]
    assert got == [x / 255 for x in hashlib.sha256(b"abc").digest()[:16]]


def test_small_functions(spark):
    assert one(spark, lambda c: T.occurrences(c, F.array(F.lit("aa"), F.lit("b"), F.lit("zz"))), "aaaa b") == [3.0]
    assert one(spark, T.language_of, "a/B.PY", "x.tsx", ".py", "Makefile", "a.b/c") == ["python", "typescript", None, None, None]
    assert one(spark, lambda c: T.verdict(c.cast("double")), "0.75", "0.5", "0.25", "0.1") == ["high", "medium", "low", "none"]
    assert one(spark, T.error_type, "KEY not set", "Rate limit hit", "boom") == ["llm_unconfigured", "rate_limited", "llm_error"]
    now = F.lit("2024-01-03 00:00:00").cast("timestamp")
    assert one(spark, lambda c: T.relative_time(c.cast("timestamp"), now), "2024-01-02 23:59:30", "2024-01-02 23:50:00", "2024-01-02 20:00:00", "2024-01-01 00:00:00", None) == ["just now", "10m", "4h", "2d", "—"]
