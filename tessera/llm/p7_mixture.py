"""Problem 7: mixing sources to target weights.

Documents are counted in tokens of a public tokenizer, and their tokens summed by source. The weights lie on a temperature
path: w(a) is proportional to target^(1-a) * share^a, from the targets themselves (a = 0) to the natural shares (a = 1, every
record once). The exponent is bisected to the smallest a at which no source needs more repeats than it may have (or, if an
entropy is asked for, at which the weights have it). Without a given total, the total is the largest one at which the targets
themselves can be met.

The weights are realised as budgeted block permutations: each source is used whole as often as its budget holds it, and the
rest of the budget is filled with blocks of its records in random order. Blocks have a bounded number of records, so a source
that holds a third of all rows is many blocks; only the one block in which a budget ends is looked into.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow
from tessera.session import spread, table, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer's text is split before merging (part of the public vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class MixtureConfig:
    """``total``: tokens of the mixture (None: as many as the targets allow); ``of_corpus``: the total as a part of all tokens
    of the targets' sources instead; ``entropy``: wanted entropy of the weights in
    nats (None: as near to the targets as the repeats allow); ``block``: records in a block; ``most_targets``: rows of the
    target table at most, as they and their sources' sums are worked out on the driver."""

    total: int | None = None
    of_corpus: float | None = None
    entropy: float | None = None
    block: int = 50_000
    most_targets: int = 100_000
    tokenizer: str = TOKENIZER
    pattern: str = PATTERN
    seed: int = 17


@dataclass(frozen=True)
class Source:
    """What is known of a source, and its budget."""

    key: str
    target: float
    most: int
    tokens: int = 0
    records: int = 0
    budget: float = 0.0


def source_key(source: Column) -> Column:
    """Sources that differ only in case, blanks or ``-``/``_`` are the same."""
    return F.regexp_replace(F.lower(source), r"(?U)[\s_-]+", "")


def count_tokens(docs: DataFrame, config: MixtureConfig) -> DataFrame:
    """Rows (doc_id, source, tokens), one for each document with an id, a source and a text; the largest count of a doc_id's rows."""
    path, pattern = config.tokenizer, config.pattern

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        global _ENCODING
        try:
            encoding = _ENCODING
        except NameError:
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            encoding = _ENCODING = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        sizes = [len(encoding.encode_ordinary(t)) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["doc_id", "source", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source").cast("string")).alias("source"), F.col("text").cast("string").alias("text"))
    rows = spread(rows).where("doc_id is not null and source is not null and source <> '' and text is not null")
    counted = map_arrow(rows, work, "doc_id long, source string, tokens long", "text")
    return counted.groupBy("doc_id").agg(F.max_by("source", F.struct("tokens", "source")).alias("source"), F.max("tokens").alias("tokens"))


def weights(sources: list[Source], total: int | None = None, entropy: float | None = None) -> tuple[dict[str, float], float, float]:
    """Weight by source, the total in tokens, and the exponent of the temperature path.

    Sources without tokens have weight 0; the targets of the others are scaled to 1.
    """
    held = [s for s in sources if s.tokens > 0 and s.target > 0 and s.most > 0]
    if not held:
        return {}, 0.0, 0.0
    everything, wanted = sum(s.tokens for s in held), sum(s.target for s in held)

    def at(a: float) -> dict[str, float]:
        logs = {s.key: (1 - a) * math.log(s.target / wanted) + a * math.log(s.tokens / everything) for s in held}
        top = max(logs.values())
        raw = {k: math.exp(v - top) for k, v in logs.items()}
        whole = sum(raw.values())
        return {k: v / whole for k, v in raw.items()}

    def fits(a: float, size: float) -> bool:
        w = at(a)
        return all(w[s.key] * size <= s.most * s.tokens * (1 + 1e-12) for s in held)

    def spread_of(a: float) -> float:
        return -sum(x * math.log(x) for x in at(a).values() if x > 0)

    exponent = 0.0
    if entropy is not None:
        low, high = 0.0, 1.0
        rising = spread_of(1) >= spread_of(0)
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if (spread_of(middle) < entropy) == rising else (low, middle)
        exponent = (low + high) / 2
    size = float(total) if total is not None else min(s.most * s.tokens / at(exponent)[s.key] for s in held)
    if not fits(exponent, size):
        if not fits(1.0, size):  # more than the repeats of all sources together can hold in their natural shares
            size = min(size, min(s.most * everything for s in held))
        low, high = exponent, 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if fits(middle, size) else (middle, high)
        exponent = high
    return at(exponent), size, exponent


def plan(sizes: DataFrame, targets: DataFrame, config: MixtureConfig) -> tuple[list[Source], float, float]:
    """The sources with their budgets, the total and the exponent. At most ``most_targets`` sums come to the driver."""
    wanted = targets.select(source_key(F.col("source").cast("string")).alias("source"), F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("target"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)).alias("most"))
    wanted = wanted.where("source is not null and source <> ''").groupBy("source").agg(F.sum("target").alias("target"), F.min("most").alias("most"))
    sums = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("records"))
    rows = wanted.join(sums, "source", "left").orderBy("source").limit(config.most_targets + 1).collect()
    if len(rows) > config.most_targets:
        raise ValueError(f"more than {config.most_targets} targets")
    sources = [Source(r.source, max(r.target, 0.0), max(r.most, 0), r.tokens or 0, r.records or 0) for r in rows]
    asked = config.total if config.of_corpus is None else int(config.of_corpus * sum(s.tokens for s in sources))
    weight, total, exponent = weights(sources, asked, config.entropy)
    # a budget is never more than the repeats hold, whatever the rounding of the weights
    budgets = [min(weight.get(s.key, 0.0) * total, float(s.most * s.tokens)) for s in sources]
    return [Source(s.key, s.target, s.most, s.tokens, s.records, b) for s, b in zip(sources, budgets)], total, exponent


def mixture(docs: DataFrame, targets: DataFrame, config: MixtureConfig = MixtureConfig()) -> DataFrame:
    """Rows (doc_id, source, tokens, uses, block_order, place) of the records that the mixture holds, ``uses`` times each.

    Read in order of (block_order, place), once for each use, the sources come in random order of their blocks. A record is
    used at most its source's max_repeats times; each source's tokens are within half a record of its budget. Documents with a
    null id, source or text take no part, nor do sources without a target; repeated rows count once; a null target_share is 0
    and a null max_repeats is 1; targets of one source add up. Documents without a token are records of size 0. An empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    sizes = written(count_tokens(docs, config), "p7-sizes")
    sources, _, _ = plan(sizes, targets, config)
    rows = [(s.key, s.budget, s.tokens, max(1, math.ceil(s.records / config.block))) for s in sources if s.budget > 0]
    planned = spark.createDataFrame(rows, "source string, budget double, source_tokens long, blocks int")
    planned = planned.withColumn("whole", F.floor(F.col("budget") / F.greatest("source_tokens", F.lit(1))).cast("int")).withColumn("rest", F.col("budget") - F.col("whole") * F.col("source_tokens"))
    placed = sizes.join(F.broadcast(planned), "source").withColumn("place", F.xxhash64(F.lit(config.seed), "doc_id")).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(config.seed + 1)), F.col("blocks")).cast("int"))
    blocks = placed.groupBy("source", "block", "rest", "whole").agg(F.sum("tokens").alias("block_tokens")).withColumn("block_order", F.xxhash64("source", "block", F.lit(config.seed + 2)))
    before = Window.partitionBy("source").orderBy("block_order", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", F.coalesce(F.sum("block_tokens").over(before), F.lit(0)))
    blocks = blocks.select("source", "block", "block_order", "start", (F.col("start") + F.col("block_tokens") <= F.col("rest")).alias("full"), (F.col("start") >= F.col("rest")).alias("out"))
    joined = placed.join(blocks, ["source", "block"])
    settled = joined.where("full or out").withColumn("uses", F.col("whole") + F.when(F.col("full"), 1).otherwise(0))
    # the one block of each source in which the rest of its budget ends; the window holds a block's records at most
    inside = Window.partitionBy("source", "block").orderBy("place", "doc_id")
    ending = joined.where("not full and not out").withColumn("upto", F.col("start") + F.sum("tokens").over(inside))
    # the record over which the budget ends is used if that comes nearer to the budget
    ending = ending.withColumn("uses", F.col("whole") + F.when(2 * F.col("upto") - F.col("tokens") < 2 * F.col("rest"), 1).otherwise(0)).drop("upto")
    out = settled.unionByName(ending).where("uses > 0")
    return out.select("doc_id", "source", "tokens", "uses", "block_order", "place")


def shares(docs: DataFrame, targets: DataFrame, config: MixtureConfig = MixtureConfig()) -> DataFrame:
    """Rows (source, target_share, actual_share, tokens, records, most_uses): what the mixture has of each target."""
    mixed = written(mixture(docs, targets, config), "p7-mixture")
    by = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("records"), F.max("uses").alias("most_uses"))
    total = by.agg(F.sum("tokens").alias("all_tokens"))
    wanted = targets.select(source_key(F.col("source").cast("string")).alias("source"), "target_share").where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    share = F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share")
    return wanted.join(by, "source", "left").crossJoin(F.broadcast(total)).select("source", "target_share", share, zero("tokens"), zero("records"), zero("most_uses"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of a mixture as large as its sources together: repeats run out, so the exponent is bisected."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), MixtureConfig(of_corpus=1.0))


def p7_whole_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of that mixture."""
    return shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), MixtureConfig(of_corpus=1.0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p7_mixture": p7_mixture, "p7_filled": p7_filled, "p7_shares": p7_shares, "p7_whole_corpus": p7_whole_corpus}
SQL: dict[str, str] = {}
