import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tessera.llm")
from tessera.llm import p6_leaks as p6  # noqa: E402

DOCS = "doc_id long, text string, item_id long, answer string, block int"
ITEMS = "item_id long, reference_answer string, doc_id long"


def _words(t):
    return [w.lower() for w in re.findall(r"[^\W_]+", t or "")]


def _brute(docs, items):
    out = set()
    for i, answer in {(r[0], r[1]) for r in items if r[0] is not None and r[1]}:
        a = _words(answer)
        long = {tuple(a[k : k + 13]) for k in range(len(a) - 12)}
        short = {tuple(a[k : k + 5]) for k in range(len(a) - 4)}
        for d, text in {(r[0], r[1]) for r in docs if r[0] is not None and r[1]}:
            w = _words(text)
            held = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} & short
            if any(tuple(w[k : k + 13]) in long for k in range(len(w) - 12)) or short and 2 * len(held) >= len(short):
                out.add((d, i))
    return out


def _tables(seed):
    rng = random.Random(seed)
    vocabulary = [f"word{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 9, 14, 30, 60]))), 0) for k in range(25)]
    docs = []
    for d in range(120):
        a = _words(rng.choice(items)[1])
        mode = d % 6
        if mode == 0:
            a = a[2 : 2 + rng.choice([12, 13, 14])]
        elif mode == 1:
            a = [w if k % rng.choice([6, 9, 12]) else "edit" for k, w in enumerate(a)]
        elif mode == 2:
            parts = [a[k : k + 7] for k in range(0, len(a), 7)]
            rng.shuffle(parts)
            a = [w for p in parts for w in [*p, "gap"]]
        elif mode == 3:
            a = [rng.choice(vocabulary) for _ in range(40)]
        docs.append((d, "Intro, " + "; ".join(a).title() + "_end.", 1, "x", 2))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    docs, items = _tables(seed)
    got = {(r.doc_id, r.item_id) for r in p6.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == _brute(docs, items)


def test_blocks_give_the_same(spark):
    docs, items = _tables(4)
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    one = {tuple(r) for r in p6.find_leaks(d, i).collect()}
    many = {tuple(r) for r in p6.find_leaks(d, i, block_words=60).collect()}
    assert one == many and one


def test_blocks_are_measured(spark):
    items = spark.createDataFrame([(k, 50) for k in range(64)] + [(99, 900)], "item_id long, size int")
    parts = [items.where(b).agg(F.sum("size"), F.count("*")).first() for b in p6._blocks(items, 200, 8)]
    assert all(words <= 200 or n == 1 for words, n in parts) and sum(n for _, n in parts) == 65 and len(parts) < 40


def test_near_and_edges(spark):
    answer = "a quick look at the lower shelf shows that every third box is still empty today"
    docs = [(1, "so " + answer.replace("third", "fourth").replace("shelf", "rack"), 0, "", 0), (2, None, 0, "", 0), (3, "", 0, "", 0), (None, answer, 0, "", 0), (4, answer.replace("a quick", "ａ qu​ick").upper(), 0, "", 0), (4, answer, 0, "", 0), (5, "x " * 200_000 + answer, 0, "", 0)]
    items = [(7, answer, 0), (7, answer, 0), (8, None, 0), (9, "", 0), (None, answer, 0), (10, "too short text", 0)]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert sorted((r.doc_id, r.item_id) for r in p6.find_leaks(d, i).collect()) == [(4, 7), (5, 7)]
    near = {(r.doc_id, r.item_id): r.edits for r in p6.find_leaks(d, i, near=True).collect()}
    assert near == {(1, 7): 2, (4, 7): 0, (5, 7): 0}
    assert p6.find_leaks(d, spark.createDataFrame([], ITEMS)).count() == 0
    assert p6.find_leaks(spark.createDataFrame([], DOCS), i).count() == 0


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize(("size", "edits"), [(5, 1), (7, 1), (8, 1), (9, 2), (12, 2), (13, 1), (13, 2), (13, 3)])
def test_recall_of_near_windows(size, edits):
    """Of a thousand isolated windows with so many edits, at least the stated part is found by the walks alone."""
    config, rng = p6.LeakConfig(), np.random.default_rng(size)
    words = [[f"w{k}" for k in rng.integers(0, 1 << 40, size)] for _ in range(1_000)]
    ids = {}
    plain = np.array([[ids.setdefault(w, len(ids) + 1) for w in row] for row in words], np.uint64)
    most = config.edits_of(size)
    other = [[f"w{k}x" for k in row] for row in p6.edited(plain, edits, rng).tolist()]
    mine = [[f"w{k}x" for k in row] for row in plain.tolist()]
    held = p6.Items(config, list(range(len(mine))), mine)
    want = {(k, k) for k in range(len(mine)) if _edits(mine[k], other[k]) <= most}
    got = {(t, i): e for t, i, _, _, _, e in held.leaks(other, True)}
    # three standard errors of the measure below the stated recall at most
    assert len(want) > 300 and len(want & set(got)) >= (config.recall - 3 * (config.recall * (1 - config.recall) / len(want)) ** 0.5) * len(want)
    assert all(e in (_edits(mine[i], other[t]), config.max_edits + 1) for (t, i), e in got.items())
