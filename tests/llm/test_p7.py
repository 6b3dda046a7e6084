import math
import os

import pytest

pytest.importorskip("tessera.llm")
from tessera.llm import p7_mixture as p7  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.exists(p7.TOKENIZER), reason="no tokenizer file")
DOCS = "doc_id long, text string, source string, tokens int, block int"
TARGETS = "source string, target_share double, max_repeats int"


def test_weights():
    s = [p7.Source("a", 0.5, 2, 1000, 10), p7.Source("b", 0.3, 4, 100, 5), p7.Source("c", 0.2, 1, 0, 0)]
    w, total, a = p7.weights(s)
    assert a == 0 and w == pytest.approx({"a": 0.625, "b": 0.375}) and total == pytest.approx(400 / 0.375)
    w, total, a = p7.weights(s, total=2000)
    assert 0 < a < 1 and w["b"] * total <= 400 * (1 + 1e-9) and w["b"] * total > 399
    w, _, _ = p7.weights(s, entropy=0.5)
    assert -sum(x * math.log(x) for x in w.values()) == pytest.approx(0.5, abs=1e-6)
    assert p7.weights([p7.Source("c", 0.2, 1)]) == ({}, 0.0, 0.0)
    w, total, a = p7.weights(s, total=10**9)  # more than all repeats hold
    assert w["a"] * total <= 2000 * (1 + 1e-9) and w["b"] * total <= 400 * (1 + 1e-9)


def _docs():
    rows = [(k, f"words of document {k} " * (1 + k % 7), " Readme" if k % 2 else "read-me", 1, 2) for k in range(600)]
    rows += [(1000 + k, "a short issue text", "ISSUE", 1, 2) for k in range(20)]
    return rows + [rows[0], (2000, None, "issue", 1, 2), (2001, "text", None, 1, 2), (None, "text", "issue", 1, 2), (2002, "", "issue", 1, 2), (2003, "other", "else", 1, 2), (2004, "word " * 20_000, "read_me", 1, 2)]


def test_shares_and_repeats(spark):
    docs = spark.createDataFrame(_docs(), DOCS)
    targets = spark.createDataFrame([("readme", 0.8, 2), ("Issue", 0.15, 3), ("nowhere", 0.05, 2), (None, 0.5, 1)], TARGETS)
    for block in (50_000, 40):
        rows = p7.mixture(docs, targets, p7.MixtureConfig(block=block)).collect()
        assert len({r.doc_id for r in rows}) == len(rows) and not {2000, 2001, 2003} & {r.doc_id for r in rows}
        assert all(r.uses <= (3 if r.source == "issue" else 2) for r in rows)
        by = {s: sum(r.tokens * r.uses for r in rows if r.source == s) for s in ("readme", "issue")}
        biggest = max(r.tokens for r in rows)
        assert abs(by["readme"] - (by["readme"] + by["issue"]) * 0.8 / 0.95) <= biggest
        assert by["issue"] == 3 * sum(r.tokens for r in p7.count_tokens(docs, p7.MixtureConfig()).where("source = 'issue'").collect())
    report = {r.source: r for r in p7.shares(docs, targets).collect()}
    assert report["nowhere"].actual_share == 0 and sum(r.actual_share for r in report.values()) == pytest.approx(1, abs=1e-5)


def test_filled_mixture_bisects(spark):
    """A mixture as large as the corpus: the exponent isn't 0, no budget is more than the repeats hold, and records without a
    token do no harm."""
    docs = spark.createDataFrame([*_docs(), *((3000 + k, "", "issue", 1, 2) for k in range(50))], DOCS)
    targets = spark.createDataFrame([("readme", 0.1, 1), ("issue", 0.9, 3)], TARGETS)
    config = p7.MixtureConfig(of_corpus=1.0, block=16)
    sizes = p7.count_tokens(docs, config)
    sources, total, exponent = p7.plan(sizes, targets, config)
    held = {r.source: r.tokens for r in sizes.groupBy("source").agg({"tokens": "sum"}).toDF("source", "tokens").collect()}
    assert 0 < exponent <= 1 and total == held["readme"] + held["issue"] and all(s.budget <= s.most * s.tokens for s in sources)
    rows = p7.mixture(docs, targets, config).collect()
    assert all(r.uses <= (3 if r.source == "issue" else 1) for r in rows)
    used = {s: sum(r.tokens * r.uses for r in rows if r.source == s) for s in held}
    assert all(abs(used[s.key] - s.budget) <= max(r.tokens for r in rows if r.source == s.key) for s in sources)


def test_same_for_any_partitioning(spark):
    docs, targets = spark.createDataFrame(_docs(), DOCS), spark.createDataFrame([("readme", 0.5, 1), ("issue", 0.5, 2)], TARGETS)
    a = {tuple(r) for r in p7.mixture(docs.repartition(1), targets).collect()}
    assert a == {tuple(r) for r in p7.mixture(docs.repartition(7), targets).collect()}


def test_empty(spark):
    docs, targets = spark.createDataFrame(_docs(), DOCS), spark.createDataFrame([("readme", 0.5, 1)], TARGETS)
    assert p7.mixture(spark.createDataFrame([], DOCS), targets).count() == 0
    assert p7.mixture(docs, spark.createDataFrame([], TARGETS)).count() == 0
