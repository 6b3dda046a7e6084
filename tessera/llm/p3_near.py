"""Problem 3: chunks whose bodies were copied and then edited.

Each body is the set S of its runs of three tokens. Its sketch has ``registers`` SetSketch registers: the minimum over S of a
hash that is exponentially distributed, on the exponentially spaced scale floor(1 - log_b(minimum)), truncated to one byte.
Bands of register values are the keys of an equi-join; the candidates' similarity is estimated by maximum likelihood from
how many registers are larger, smaller or equal, and what is not surely below the threshold is verified on the token runs.

Chunks with equal S are one class from the start, and all of the search is between classes: a group of exact copies, however
large, costs one row in every join but the last one, which lists its members.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow
from tessera.session import spread, table, written

TOKEN = re.compile(r"[A-Za-z_]\w*|\d+|[^\s\w]")
_U = np.uint64


@dataclass(frozen=True)
class SketchConfig:
    """``bands`` bands of ``rows`` registers each; ``base``, ``rate`` and ``limit``: the registers' scale. ``slack``: how far
    below the threshold an estimate may be, in standard errors, before a candidate is dropped unverified (4: 3 in 100,000)."""

    similarity: float = 0.7
    bands: int = 40
    rows: int = 5
    base: float = 1.08
    rate: float = 20.0
    limit: int = 250
    slack: float = 4.0
    min_tokens: int = 40
    seed: int = 7

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def token_runs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct runs of three tokens of each text, sorted within it, and where each text begins."""
    known: dict[str, int] = {}
    tokens, sizes = [], []
    for text in texts:
        words = TOKEN.findall(text) if text else []
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        tokens.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        sizes.append(max(0, len(words) - 2))
    flat = np.concatenate(tokens) if tokens else np.empty(0, np.uint64)
    lengths = np.array([len(t) for t in tokens], np.int64)
    text = np.repeat(np.arange(len(texts)), lengths)
    if len(flat) < 3:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = text[2:] == text[:-2]
    runs = _mix(_mix(_mix(flat[:-2]) + flat[1:-1]) + flat[2:])[inside]
    text = text[2:][inside]
    order = np.lexsort((runs, text))
    runs, text = runs[order], text[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (text[1:] != text[:-1])
    runs, text = runs[new], text[new]
    return runs, np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(texts)))))


def sketches(runs: np.ndarray, starts: np.ndarray, config: SketchConfig) -> np.ndarray:
    """Registers (uint8) of each set, one row a set; all 0 for an empty one. The minimum of a union is the minimum of minima,
    so sketches of parts merge by the larger register."""
    n = len(starts) - 1
    out = np.zeros((n, config.registers), np.uint8)
    full = np.flatnonzero(np.diff(starts))
    if not len(full):
        return out
    rng = np.random.default_rng(config.seed)
    factors = rng.integers(0, 1 << 63, config.registers, np.uint64) * _U(2) + _U(1)
    begins = starts[:-1][full]
    folded = runs ^ (runs >> _U(32))
    least = np.empty((config.registers, len(full)), np.uint64)
    held = np.empty_like(runs)
    for r, factor in enumerate(factors):
        np.multiply(folded, factor, out=held)
        np.minimum.reduceat(held, begins, out=least[r])
    # the exponential scale is monotone, so it is taken of the minima only
    uniform = (least.astype(np.float64) + 0.5) / 2.0**64
    scaled = np.floor(1 - np.log(-np.log1p(-np.minimum(uniform, 1 - 1e-16)) / config.rate) / np.log(config.base))
    out[full] = np.clip(scaled, 0, config.limit + 1).astype(np.uint8).T
    return out


def band_keys(registers: np.ndarray, config: SketchConfig) -> np.ndarray:
    """The registers of each band packed into one integer with the band's number; two keys are equal if and only if they are."""
    grouped = registers.reshape(len(registers), config.bands, config.rows).astype(np.int64)
    keys = np.broadcast_to(np.arange(config.bands, dtype=np.int64), grouped.shape[:2])
    for r in range(config.rows):
        keys = (keys << 8 if config.rows <= 6 else keys * 257) + grouped[:, :, r]
    return keys


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, config: SketchConfig, steps: int = 128) -> np.ndarray:
    """Jaccard similarity of sets by joint maximum likelihood: of the numbers of registers in which a is larger, b is larger
    and both are equal, given the sets' sizes."""
    over, under = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - over - under
    u = size_a / np.maximum(size_a + size_b, 1)
    v = 1 - u
    most = np.minimum(u / np.maximum(v, 1e-9), v / np.maximum(u, 1e-9))
    best, at = np.full(len(u), -np.inf), np.zeros(len(u))

    def larger(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (config.base - 1) / config.base) / np.log(config.base), 1e-12, 1)

    for k in range(steps + 1):
        j = most * k / steps
        p, q = larger(u - v * j), larger(v - u * j)
        fit = over * np.log(p) + under * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))
        better = fit > best
        best[better], at[better] = fit[better], j[better]
    return at


def jaccard(texts_a: list[str], texts_b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """|S_a and S_b| and |S_a or S_b| of each pair of texts."""
    n = len(texts_a)
    runs, starts = token_runs([*texts_a, *texts_b])
    size = np.diff(starts)
    pair = np.concatenate((np.repeat(np.arange(n), size[:n]), np.repeat(np.arange(n), size[n:])))
    order = np.lexsort((runs, pair))
    runs, pair = runs[order], pair[order]
    both = (runs[1:] == runs[:-1]) & (pair[1:] == pair[:-1])
    shared = np.bincount(pair[1:][both], minlength=n)[:n]
    return shared, size[:n] + size[n:] - shared


def sketch_chunks(chunks: DataFrame, config: SketchConfig) -> DataFrame:
    """Rows (chunk_id, file_path, body_hash, set_id, runs, registers) of the chunks that take part, distinct by chunk_id and set_id.

    ``set_id`` is a 128-bit digest of S, so equal sets have equal ids whatever the body's blanks.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs, starts = token_runs(batch.column(2).to_pylist())
        found = sketches(runs, starts, config)
        size = np.diff(starts)
        keep = size > 0
        sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(runs ^ _U(s)), dtype=np.uint64))) for s in (0x51ED27, 0xA3C59A)]
        parts = [x[starts[1:]] - x[starts[:-1]] for x in sums]
        ids = np.stack(parts, axis=1).astype(">u8").tobytes()
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), batch.column(3),
                pa.array([ids[16 * k : 16 * k + 16].hex() for k in range(batch.num_rows)]),
                pa.array(size.astype(np.int32)), pa.array([r.tobytes() for r in found], pa.binary()),
            ],
            ["chunk_id", "file_path", "body_hash", "set_id", "runs", "registers"],
        ).filter(pa.array(keep))

    rows = chunks.where((F.col("token_count") >= config.min_tokens) & F.col("chunk_id").isNotNull() & F.col("file_path").isNotNull() & F.col("body").isNotNull())
    rows = spread(rows.select(*(F.col(c).cast("string").alias(c) for c in ("chunk_id", "file_path", "body")), F.xxhash64("body").alias("body_hash")))
    return map_arrow(rows, work, "chunk_id string, file_path string, body_hash long, set_id string, runs int, registers binary", "body")


@dataclass(frozen=True)
class NearResult:
    """``members``: (chunk_id, file_path, set_no); ``links``: (a, b, shared, together) between different classes, a < b."""

    members: DataFrame
    links: DataFrame


def near_classes(chunks: DataFrame, config: SketchConfig = SketchConfig()) -> NearResult:
    """The classes of chunks with equal S, and the verified links between them."""
    made = written(sketch_chunks(chunks, config), "p3-sketches")
    classes = made.groupBy("set_id").agg(F.min(F.struct("chunk_id", "body_hash")).alias("text"), F.first("runs").alias("runs"), F.first("registers").alias("registers"))
    classes = written(classes.withColumn("set_no", F.monotonically_increasing_id()), "p3-classes")

    def bands(batch: pa.RecordBatch) -> pa.RecordBatch:
        registers = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, config.registers)
        keys = band_keys(registers, config)
        numbers = np.repeat(batch.column(0).to_numpy(), config.bands)
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(numbers)], ["band", "set_no"])

    banded = map_arrow(classes.select("set_no", "registers"), bands, "band long, set_no long", "registers")
    other = banded.select(F.col("band"), F.col("set_no").alias("b"))
    pairs = banded.select("band", F.col("set_no").alias("a")).join(other, "band").where("a < b").select("a", "b").distinct()

    side = classes.select("set_no", "runs", "registers")
    near_sized = pairs.join(side.toDF("a", "runs_a", "registers_a"), "a").join(side.toDF("b", "runs_b", "registers_b"), "b")
    near_sized = near_sized.where(F.least("runs_a", "runs_b") >= config.similarity * F.greatest("runs_a", "runs_b"))

    def likely(batch: pa.RecordBatch) -> pa.RecordBatch:
        get = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
        a, b = (np.frombuffer(b"".join(get[k].to_pylist()), np.uint8).reshape(-1, config.registers) for k in ("registers_a", "registers_b"))
        about = estimate(a, b, get["runs_a"].to_numpy(), get["runs_b"].to_numpy(), config)
        error = np.sqrt(config.similarity * (1 - config.similarity) / config.registers)
        keep = pa.array(about >= config.similarity - config.slack * error)
        return pa.RecordBatch.from_arrays([get["a"], get["b"]], ["a", "b"]).filter(keep)

    candidates = written(map_arrow(near_sized, likely, "a long, b long", "registers_a"), "p3-candidates")

    # the text of a class is found by id and hash, as rows of one chunk_id might differ in their bodies
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("set_no")).distinct().join(classes.select("set_no", "text.*"), "set_no")
    bodies = chunks.where(F.col("token_count") >= config.min_tokens).select(F.col("chunk_id").cast("string").alias("chunk_id"), F.xxhash64("body").alias("body_hash"), "body")
    texts = wanted.join(bodies, ["chunk_id", "body_hash"]).groupBy("set_no").agg(F.first("body").alias("body"))
    both = candidates.join(texts.toDF("a", "body_a"), "a").join(texts.toDF("b", "body_b"), "b")

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        shared, together = jaccard(batch.column(2).to_pylist(), batch.column(3).to_pylist())
        keep = pa.array(shared >= config.similarity * together - 1e-9)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.astype(np.int32)), pa.array(together.astype(np.int32))], ["a", "b", "shared", "together"]).filter(keep)

    links = map_arrow(both.select("a", "b", "body_a", "body_b"), verify, "a long, b long, shared int, together int", "body_a")
    members = made.select("chunk_id", "file_path", "set_id").distinct().join(classes.select("set_id", "set_no"), "set_id").select("chunk_id", "file_path", "set_no")
    return NearResult(members, links)


def near_pairs(chunks: DataFrame, config: SketchConfig = SketchConfig()) -> DataFrame:
    """Rows (chunk_id_a, chunk_id_b), a < b, of chunks in different files whose bodies share ``similarity`` of their runs.

    Chunks with null chunk_id, file_path, body or token_count, with fewer than ``min_tokens`` tokens, or without a run of
    three tokens take no part. Repeated rows count once. Chunks of one class are in the result if their files differ, as the
    pairs' definition asks; ``near_groups`` gives one row for each chunk instead. Columns beyond those named don't matter.
    """
    found = near_classes(chunks, config)
    m = found.members
    linked = found.links.select("a", "b").join(m.toDF("chunk_a", "path_a", "a"), "a").join(m.toDF("chunk_b", "path_b", "b"), "b")
    copied = m.groupBy("set_no").count().where("count > 1").select("set_no")
    inside = m.join(copied, "set_no", "left_semi").select(*m.columns)
    equal = inside.toDF("chunk_a", "path_a", "a").join(inside.toDF("chunk_b", "path_b", "a"), "a").where("chunk_a < chunk_b")
    cols = ("chunk_a", "path_a", "chunk_b", "path_b")
    both = linked.select(*cols).unionByName(equal.select(*cols)).where("path_a <> path_b")
    return both.select(F.least("chunk_a", "chunk_b").alias("chunk_id_a"), F.greatest("chunk_a", "chunk_b").alias("chunk_id_b")).where("chunk_id_a < chunk_id_b").distinct()


def connected(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Rows (node, root): the smallest node that each node of ``links`` (a, b) is connected with.

    Rounds of taking the smallest label among neighbours, then the label's label, until none changes; each round is written
    to the shared folder. Nothing but a count comes to the driver.
    """
    edges = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "p3-edges")
    labels = written(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "p3-labels")
    for _ in range(most_rounds):
        near = edges.join(labels.toDF("b", "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "near").alias("low"))
        hop = labels.toDF("low", "further")
        new = written(step.join(hop, "low", "left").select("node", F.coalesce(F.least("low", "further"), "low").alias("new"), "root"), "p3-labels")
        changed = new.where("new <> root").limit(1).count()
        labels = new.select("node", F.col("new").alias("root"))
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {most_rounds} rounds")


def near_groups(chunks: DataFrame, config: SketchConfig = SketchConfig()) -> DataFrame:
    """One row (chunk_id, group_id, links) for each chunk that has a copy or a link: the smallest chunk_id of its group, and
    to how many other classes its class is linked."""
    found = near_classes(chunks, config)
    links = written(found.links, "p3-links")
    roots = connected(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("set_no")).groupBy("set_no").agg(F.count("*").alias("links"))
    members = found.members
    copied = members.groupBy("set_no").agg(F.count("*").alias("copies"))
    named = members.join(copied, "set_no").join(roots.toDF("set_no", "root"), "set_no", "left").join(degree, "set_no", "left")
    named = named.where("root is not null or copies > 1").withColumn("root", F.coalesce("root", "set_no"))
    group = named.groupBy("root").agg(F.min("chunk_id").alias("group_id"))
    return named.join(group, "root").select("chunk_id", "group_id", F.coalesce("links", F.lit(0)).alias("links")).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(table(spark, sf_dir, "index_chunks"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "index_chunks"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p3_found": p3_found, "p3_groups": p3_groups}
SQL: dict[str, str] = {
    "p3_found": r"""with c as (select distinct chunk_id, file_path, body from index_chunks where token_count >= 40 and chunk_id is not null and file_path is not null and body is not null),
w as (select chunk_id, file_path, body, regexp_extract_all(body, '[A-Za-z_][\p{L}\p{N}_]*|\p{Nd}+|[^\s\p{Z}\p{L}\p{N}_]') t from c),
s as materialized (select distinct chunk_id, file_path, body, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || chr(1) || t[i + 1] || chr(1) || t[i + 2])) run from w where len(t) >= 3),
k as materialized (select chunk_id, file_path, run, hash(body) h, count(*) over (partition by chunk_id, file_path, body) n from s)
select distinct least(a.chunk_id, b.chunk_id) chunk_id_a, greatest(a.chunk_id, b.chunk_id) chunk_id_b from k a join k b on a.run = b.run and a.chunk_id < b.chunk_id
where a.file_path <> b.file_path group by a.chunk_id, b.chunk_id, a.file_path, b.file_path, a.h, b.h having count(*) >= 0.7 * (any_value(a.n) + any_value(b.n) - count(*))""",
}
