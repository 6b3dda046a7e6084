import random

import numpy as np
import pytest

pytest.importorskip("tessera.llm")
from tessera.llm import p3_near as p3  # noqa: E402

SCHEMA = "chunk_id string, file_path string, body string, token_count int, set_no int, band string"


def _runs(text):
    t = p3.TOKEN.findall(text or "")
    return {tuple(t[k : k + 3]) for k in range(len(t) - 2)}


def _brute(rows):
    seen = {(r[0], r[1], r[2]) for r in rows if None not in r[:3] and r[3] is not None and r[3] >= 40}
    rows = sorted(seen)
    out = set()
    for n, a in enumerate(rows):
        for b in rows[n + 1 :]:
            x, y = _runs(a[2]), _runs(b[2])
            if a[0] != b[0] and a[1] != b[1] and x and y and len(x & y) >= 0.7 * len(x | y):
                out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def _corpus(seed=1, families=12):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for f in range(families):
        base = [rng.choice(words) for _ in range(90)]
        for v in range(rng.randint(1, 6)):
            t = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                t[rng.randrange(len(t))] = rng.choice(words)
            if rng.random() < 0.3:
                t = t[40:] + t[:40]
            rows.append((f"c{f}_{v}", f"p{f}_{v % 5}.py", " ".join(t), 90, 1, "x"))
    return rows


def test_pairs_against_brute_force(spark):
    rows = _corpus()
    rows += [rows[0], ("same_file", rows[0][1], rows[0][2], 90, 1, "x"), ("short", "q.py", rows[0][2], 39, 1, "x"), ("blanks", "q.py", "  " + rows[0][2].replace(" ", "\n"), 90, 1, "x")]
    rows += [(None, "q.py", rows[0][2], 90, 1, "x"), ("n1", None, rows[0][2], 90, 1, "x"), ("n2", "q.py", None, 90, 1, "x"), ("n3", "q.py", rows[0][2], None, 1, "x"), ("n4", "q.py", "", 90, 1, "x"), ("n5", "r.py", "a b", 90, 1, "x")]
    got = {tuple(r) for r in p3.near_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == _brute(rows)


def test_groups_are_the_pairs_components(spark):
    rows = _corpus(2)
    df = spark.createDataFrame(rows, SCHEMA)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in p3.near_pairs(df).collect():
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.chunk_id: r.group_id for r in p3.near_groups(df).collect()}
    assert all(got[c] == find(c) for c in root)


def test_hot_group_of_copies(spark):
    text = " ".join(f"w{k % 37}" for k in range(80))
    rows = [(f"c{k:04d}", "one.py", text, 80, 1, "x") for k in range(3000)] + [("other", "two.py", text + " tail", 81, 1, "x")]
    out = p3.near_pairs(spark.createDataFrame(rows, SCHEMA))
    assert out.count() == 3000  # each copy with the one chunk of another file


def test_sketch_estimates():
    rng = np.random.default_rng(3)
    config = p3.SketchConfig()
    for j in (0.3, 0.7, 0.9):
        sets, sizes = [], []
        for _ in range(40):
            both = rng.integers(1, 1 << 62, int(300 * j), np.uint64)
            for _ in range(2):
                own = rng.integers(1, 1 << 62, int(300 * (1 - j) / 2), np.uint64)
                sets.append(np.concatenate((both, own)))
                sizes.append(len(sets[-1]))
        starts = np.concatenate(([0], np.cumsum(sizes)))
        r = p3.sketches(np.concatenate(sets), starts, config)
        got = p3.estimate(r[::2], r[1::2], np.array(sizes[::2]), np.array(sizes[1::2]), config)
        assert abs(got.mean() - j) < 0.03
    # a sketch of a union is the larger register of both
    a, b = sets[0], sets[1]
    whole = p3.sketches(np.concatenate((a, b)), np.array([0, len(a) + len(b)]), config)[0]
    parts = p3.sketches(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), config)
    assert (whole == parts.max(axis=0)).all()


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert p3.near_pairs(empty).count() == 0
    assert p3.near_groups(empty).count() == 0


def test_connected_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in p3.connected(links).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
