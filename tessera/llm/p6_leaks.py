"""Problem 6: passages of evaluation items in training texts.

Every item answer is cut into windows of 13 words (what is sure to be a leak) and of 5 words (the runs of which half make a
leak), at every word; items of less than 13 words are a window of their own length, too. Each window is embedded by CGK random
walks, which turn edit distance into Hamming distance, and samples of each walk's positions are its hash keys. Windows of the
documents are embedded by the same walks and looked up among the items' keys; equal windows always meet, as they walk alike
whichever bits are sampled. How many walks and samples there are is chosen by simulation, so that a stated part (``recall``) of
windows with the most edits allowed meets. What meets is verified on the words themselves: whether windows of a full leak are
equal, the longest common run, the share of the item's runs of five, and the edit distance of the closest windows.

The items are a stated query set: they are cut into blocks whose measured size is bounded, each block is broadcast and goes
over all documents in one map stage, and no document is shuffled.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow
from tessera.llm.p8_consistent import consistent
from tessera.session import spread, table, written

WORD = re.compile(r"[^\W_]+")
#: Words of all items in a block. Each of the at most MOST_WALKS keys of a word takes 16 bytes, so this bounds them at 160 MB.
BLOCK_WORDS, MOST_WALKS = 500_000, 20
OUT = "doc_id long, item_id long, common_run int, shared_runs int, item_runs int, edits int"


@dataclass(frozen=True)
class LeakConfig:
    """``run``: words that are a leak by themselves; ``short``: words in the runs of which ``share`` are one;
    ``max_edits``: of a near leak's windows of ``run`` words, in proportion fewer of shorter items' windows; ``recall``: the
    part of windows with so many random edits that meets, found by itself, without the help of windows beside it; ``samples``:
    positions of a walk that are sampled for the keys of equal windows (those of near ones are planned)."""

    run: int = 13
    short: int = 5
    share: float = 0.5
    recall: float = 0.9
    max_edits: int = 3
    samples: int = 8
    seed: int = 42

    def edits_of(self, size: int) -> int:
        return self.max_edits * size // self.run


def word_lists(texts: pa.Array) -> list[list[str]]:
    """The words of each text: runs of letters and digits of its consistent form, in lower case; none for null."""
    return [WORD.findall(x.lower()) if x else [] for x in consistent(texts).to_pylist()]


def word_ids(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in one array, and where each text begins in it (one more at the end)."""
    known: dict[str, int] = {}
    ids = np.empty(sum(map(len, words)), np.uint64)
    starts = np.zeros(len(words) + 1, np.int64)
    at = 0
    for k, ws in enumerate(words):
        for w in ws:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            ids[at] = h
            at += 1
        starts[k + 1] = at
    return ids, starts


def _windows(starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First positions of all windows that lie in one text, and their texts."""
    lengths = np.diff(starts)
    n = np.maximum(lengths - size + 1, 0)
    ends = np.cumsum(n)
    if not len(n) or not ends[-1]:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = np.repeat(np.arange(len(n)), n)
    return np.arange(ends[-1]) - np.repeat(ends - n, n) + starts[text], text


def _distinct(*columns: np.ndarray) -> np.ndarray:
    """Places of one row of each kind among rows given as columns."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    return order[new]


class Walk:
    """The CGK walk for windows of ``size`` words: at each of 3 * size steps it emits the word it stands on, and a random bit
    of step and word says whether it goes on to the next word. ``keys`` hashes what it emits at sampled steps."""

    def __init__(self, size: int, repeats: int, samples: int, seed: int) -> None:
        rng = np.random.default_rng([seed, size])
        self.size, self.steps = size, 3 * size
        # a walk for each repetition, so that one that drifts apart at an edit leaves the others' chances as they are
        self.factor = rng.integers(0, 1 << 63, (repeats, self.steps), np.uint64) * np.uint64(2) + np.uint64(1)
        self.mixer = rng.integers(0, 1 << 63, self.steps, np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(0, 1 << 63, repeats, np.uint64)
        # the samples of a repetition are one from each of as many equal parts of the walk, so that they cover the window
        edges = np.linspace(0, self.steps, samples + 1).astype(int)
        self.sampled = np.zeros((repeats, self.steps), bool)
        for r in range(repeats):
            for low, high in zip(edges, edges[1:]):
                self.sampled[r, rng.integers(low, high)] = True

    def first(self, repeats: int) -> Walk:
        """The first ``repeats`` of the repetitions."""
        self.factor, self.salt, self.sampled = self.factor[:repeats], self.salt[:repeats], self.sampled[:repeats]
        return self

    def keys(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Keys of the windows that begin at ``first``, one column for each repetition."""
        out = np.repeat(self.salt[:, None], len(first), axis=1)
        padded = np.append(ids, np.uint64(0))
        for r, key in enumerate(out):
            at = np.zeros(len(first), np.int64)
            for step in range(np.flatnonzero(self.sampled[r])[-1] + 1):
                inside = at < self.size
                symbol = np.where(inside, padded[np.where(inside, first + at, 0)], np.uint64(0))
                mixed = symbol * self.factor[r, step]
                if self.sampled[r, step]:
                    key ^= (mixed ^ (mixed >> np.uint64(31))) * self.mixer[step]
                    key *= np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                at += (mixed >> np.uint64(63)).astype(np.int64)
        return out


def edited(windows: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """``windows`` (one in a row) after ``edits`` random word edits each: substitutions, insertions and deletions alike. New
    words and what fills up the end are unlike all others."""
    out = np.empty_like(windows)
    fresh = iter(rng.integers(1, 1 << 63, (2 * edits + 1) * len(windows) + 1, np.uint64))
    for k, window in enumerate(windows):
        row = list(window)
        for kind, at in zip(rng.integers(0, 3, edits), rng.random(edits)):
            at = int(at * len(row))
            row[at : at + int(kind != 1)] = [next(fresh)] * int(kind != 2)
        out[k] = [*row, *(next(fresh) for _ in range(len(windows[k]) - len(row)))][: windows.shape[1]]
    return out


@functools.lru_cache(maxsize=256)
def planned(size: int, edits: int, recall: float, seed: int) -> Walk:
    """The walks for windows of ``size`` words by which ``recall`` of simulated windows with ``edits`` edits meet: of those with
    at most MOST_WALKS repetitions the one with the most samples, as they keep chance hits away."""
    rng = np.random.default_rng([seed, size, edits])
    plain = rng.integers(1, 1 << 63, (1_000, size), np.uint64)
    other = edited(plain, edits, rng)
    first = np.arange(len(plain)) * size
    for samples in range(8 if edits else 1, 0, -1):
        walk = Walk(size, MOST_WALKS if edits else 1, samples if edits else 3 * size, seed)
        met = np.logical_or.accumulate(walk.keys(plain.ravel(), first) == walk.keys(other.ravel(), first), axis=0).mean(axis=1)
        enough = np.flatnonzero(met >= recall)
        if len(enough):
            return walk.first(int(enough[0]) + 1)
    raise ValueError(f"no {MOST_WALKS} walks over {size} words find {recall} of windows with {edits} edits")


def edit_distances(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Word edits between the windows of ``a`` at ``x`` and of ``b`` at ``y``, for all pairs of windows at once."""
    row = np.repeat(np.arange(size + 1, dtype=np.int8)[:, None], len(x), axis=1)
    for i in range(size):
        last, row[0] = row[0].copy(), i + 1
        mine = a[x + i]
        for j in range(1, size + 1):
            new = np.minimum(np.minimum(row[j], row[j - 1]) + 1, last + (mine != b[y + j - 1]))
            last, row[j] = row[j].copy(), new
    return row[size]


@dataclass
class Items:
    """One block of items with its keys."""

    config: LeakConfig
    ids: list[int]
    words: list[list[str]]
    walks: list[Walk] = field(default_factory=list)
    keys: list[np.ndarray] = field(default_factory=list)
    owner: list[np.ndarray] = field(default_factory=list)
    where: list[np.ndarray] = field(default_factory=list)
    needed: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    hashed: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    def __post_init__(self) -> None:
        c = self.config
        self.hashed, self.starts = hashed, starts = word_ids(self.words)
        # one walk for equal windows of both sizes, then as many as near ones need: of ``run`` words, or as long as a shorter item
        sizes = sorted({min(len(w), c.run) for w in self.words if len(w) >= c.short})
        plans = [(Walk(size, 1, min(c.samples, size), c.seed), False) for size in (c.run, c.short)]
        for walk, near in [*plans, *((planned(size, c.edits_of(size), c.recall, c.seed), True) for size in sizes)]:
            first, text = _windows(starts, walk.size)
            if near and walk.size < c.run:
                own = np.diff(starts)[text] == walk.size
                first, text = first[own], text[own]
            keys = walk.keys(hashed, first)
            flat = keys.ravel()
            who, where = np.tile(text, len(keys)).astype(np.int32), np.tile(first - starts[text], len(keys)).astype(np.int32)
            order = np.argsort(flat, kind="stable")
            self.walks.append(walk)
            self.keys.append(flat[order])
            self.owner.append(who[order])
            self.where.append(where[order])
        self.needed = np.array([math.ceil(c.share * len(self.runs(w))) if len(w) >= c.short else 1 << 40 for w in self.words], np.int64)

    def runs(self, words: list[str]) -> set[tuple[str, ...]]:
        n = self.config.short
        return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}

    def met(self, which: int, hashed: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Text, item, position in the text, position in the item of the windows of one size that share a key."""
        first, text = _windows(starts, self.walks[which].size)
        keys = self.keys[which]
        if not len(first) or not len(keys):
            return tuple(np.empty(0, np.int64) for _ in range(4))
        mine = self.walks[which].keys(hashed, first)
        flat = mine.ravel()
        low = np.searchsorted(keys, flat)
        there = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == flat)
        low = low[there]
        n = np.searchsorted(keys, flat[there], "right") - low
        window = there % len(first)
        ends = np.cumsum(n)
        entry = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(low, n)
        window = np.repeat(window, n)
        item, at, of = self.owner[which][entry].astype(np.int64), first[window], self.where[which][entry].astype(np.int64)
        if which < 2:  # windows that met by their samples are equal in all their words, or no match
            there = self.starts[item] + of
            same = np.ones(len(at), bool)
            for k in range(self.walks[which].size):
                same &= hashed[at + k] == self.hashed[there + k]
            window, item, at, of = window[same], item[same], at[same], of[same]
        return text[window], item, at - starts[text[window]], of

    def leaks(self, words: list[list[str]], near: bool) -> Iterator[tuple[int, int, int, int, int, int]]:
        """Text number, item id and the verified figures of every leak; ``near``: also of windows with few edits."""
        c = self.config
        hashed, starts = word_ids(words)
        n_items = len(self.ids)
        text, item, _, _ = self.met(0, hashed, starts)
        found = np.unique(text * n_items + item)
        text5, item5, _, of5 = self.met(1, hashed, starts)
        if len(text5):
            # a text can only hold half of an item's runs if as many of its windows met; equal runs of an item count once in
            # ``needed``, so windows met may be more but never fewer
            pair = (text5 * n_items + item5)[_distinct(text5 * n_items + item5, of5)]
            both, count = np.unique(pair, return_counts=True)
            found = np.union1d(found, both[count >= self.needed[both % n_items]])
        full = {p: f for p in found.tolist() if (f := self._figures(words, *divmod(p, n_items)))[3]}
        edits_of = self._edits(words) if near else {}
        for p in sorted({*full, *edits_of}):
            t, i = divmod(p, n_items)
            longest, shared, runs, _ = full.get(p) or self._figures(words, t, i)
            whole = longest >= min(c.run, len(self.words[i]))
            yield t, self.ids[i], longest, shared, runs, 0 if whole else edits_of.get(p, c.max_edits + 1)

    def _figures(self, words: list[list[str]], t: int, i: int) -> tuple[int, int, int, bool]:
        """Longest common run, shared runs and all runs of a text and an item, and whether that is a leak."""
        want = self.runs(self.words[i])
        shared = len(want & self.runs(words[t]))
        longest = _common_run(words[t], self.words[i])
        return longest, shared, len(want), bool(longest >= self.config.run or want and shared >= self.config.share * len(want))

    def _edits(self, words: list[list[str]]) -> dict[int, int]:
        """By text and item (text number times number of items plus item), the edits of their closest near windows."""
        hashed, starts = word_ids(words)
        least: dict[int, int] = {}
        for which in range(2, len(self.walks)):
            size = self.walks[which].size
            text, item, at, of = self.met(which, hashed, starts)
            # one entry for windows that met by several keys, then exact verification of their edits
            spot = _distinct(text * len(self.ids) + item, at, of)
            text, item, at, of = text[spot], item[spot], at[spot], of[spot]
            edits = edit_distances(hashed, self.hashed, starts[text] + at, self.starts[item] + of, size)
            close = edits <= self.config.edits_of(size)
            for p, n in zip((text[close] * len(self.ids) + item[close]).tolist(), edits[close].tolist()):
                least[p] = min(n, least.get(p, n))
        return least


def _common_run(a: list[str], b: list[str]) -> int:
    """Length of the longest run of words that stands in both."""
    best, row = 0, [0] * (len(b) + 1)
    places: dict[str, list[int]] = {}
    for j, y in enumerate(b, 1):
        places.setdefault(y, []).append(j)
    for x in a:
        new = {j: row[j - 1] + 1 for j in places.get(x, ())}
        row = [0] * (len(b) + 1)
        for j, n in new.items():
            row[j] = n
            best = max(best, n)
    return best


def _blocks(sized: DataFrame, most: int, buckets: int = 4096) -> list[Column]:
    """Conditions that part items (item_id, size) into blocks of at most ``most`` words, but for an item that has more by itself.

    Items fall into buckets by hash, whose sums (at most ``buckets`` rows) come to the driver to be packed in their order; if
    one holds too much, there are more buckets.
    """
    bucket = F.pmod(F.xxhash64("item_id"), F.lit(buckets))
    sums = sized.groupBy(bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n")).orderBy("bucket").collect()
    if any(r.words > most and r.n > 1 for r in sums):
        return _blocks(sized, most, 16 * buckets)
    out, held, low = [], 0, 0
    for r in sums:
        if held and held + r.words > most:
            out.append((bucket >= low) & (bucket < r.bucket))
            low, held = r.bucket, 0
        held += r.words
    return [*out, bucket >= low]


def find_leaks(docs: DataFrame, items: DataFrame, config: LeakConfig = LeakConfig(), near: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (doc_id, item_id, common_run, shared_runs, item_runs, edits): one for each document and item that leaked into it.

    A document contains an item if it has ``run`` consecutive words of its reference_answer, or at least ``share`` of the
    distinct runs of ``short`` consecutive words of it. With ``near``, windows of ``run`` words with at most ``max_edits``
    word edits count too, and those as long as a shorter answer with as many in proportion (1 of 5 to 8 words, 2 of 9 to 12);
    of windows with the most edits, the configuration's ``recall`` is found. ``edits`` are those of the closest window, 0 if a
    whole one is equal, and more than ``max_edits`` if none is near or near ones weren't looked for. Null ids take no part; null or empty texts and answers contain nothing; an answer of fewer than
    ``short`` words can't leak. Repeated documents or items give one row. Texts are read whole. An item block holds at
    most ``block_words`` words, measured before it is broadcast (or one item that is longer); with more items there are more
    blocks, each over all documents.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("reference_answer").cast("string").alias("answer")).where("item_id is not null and answer is not null").distinct()
    sized = written(wanted.withColumn("size", 1 + F.regexp_count("answer", F.lit(r"[\p{L}\p{N}]+"))), "p6-items")
    blocks = _blocks(sized, block_words)
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).where("doc_id is not null and text is not null")
    out = None
    for block in blocks:
        mine = sized.where(block).select("item_id", "answer").toArrow()
        held = spark.sparkContext.broadcast(Items(config, mine.column(0).to_pylist(), word_lists(mine.column(1).combine_chunks())))

        def work(batch: pa.RecordBatch, held: Broadcast[Items] = held) -> pa.RecordBatch:
            ids = batch.column(0).to_pylist()
            got = [(ids[t], *rest) for t, *rest in held.value.leaks(word_lists(batch.column(1)), near)]
            columns = list(zip(*got)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k < 2 else pa.int32()) for k, x in enumerate(columns)], ["doc_id", "item_id", "common_run", "shared_runs", "item_runs", "edits"])

        part = map_arrow(rows, work, OUT, "text")
        out = part if out is None else out.unionByName(part)
    best = F.max(F.struct("common_run", "shared_runs", "item_runs", "edits")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_cases")).select("doc_id", "item_id")


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By item, how many documents hold it, fully or nearly."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_cases"), near=True)
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.count_if(F.col("edits") == 0).alias("verbatim"), F.max("common_run").alias("longest_run"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p6_found": p6_found, "p6_items": p6_items}
SQL: dict[str, str] = {}
