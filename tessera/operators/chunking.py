"""Greedy windows over lines: from parsed symbols to chunks of a bounded number of tokens.

Windows depend on each other within a text, so a text is split in one call, on token counts and bracket depths that numpy
makes for all its lines at once; texts are independent and spread over all tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import chunk_id
from tessera.session import spread

_TOKEN = re.compile(r"[A-Za-z_]\w*|\d+|[^\s\w]")
_BRACKET = re.compile(r"[([{}\])]")


@dataclass(frozen=True)
class ChunkConfig:
    max_tokens: int = 512
    overlap: int = 64
    min_tokens: int = 8

    def __post_init__(self) -> None:
        if not 0 < self.overlap < self.max_tokens:
            raise ValueError("overlap must be positive and less than max_tokens")


def count_tokens(text: str) -> int:
    """The default measure of a text: words, numbers and single signs."""
    return len(_TOKEN.findall(text))


def windows(text: str, config: ChunkConfig, measure: Callable[[str], int] = count_tokens) -> list[tuple[int, int, int]]:
    """(first line, end line, tokens) of the windows of ``text``; lines count from 0 and the end isn't part of the window.

    A window takes lines while its tokens fit, at least one, and ends at the last place where no bracket is open, if there is
    one in it. The next one begins ``overlap`` tokens before its end, at such a place, or at its end if that is no progress.
    """
    lines = text.split("\n")
    n = len(lines)
    count = np.array([measure(x) for x in lines])
    before = np.concatenate(([0], np.cumsum(count)))
    open_at, depth = np.zeros(n + 1, bool), 0
    open_at[0] = True
    for k, line in enumerate(lines):
        for ch in _BRACKET.findall(line):
            depth = depth + 1 if ch in "([{" else max(0, depth - 1)
        open_at[k + 1] = depth == 0
    safe = np.flatnonzero(open_at)

    def last_safe(high: int, low: int) -> int:
        k = np.searchsorted(safe, high, "right") - 1
        return int(safe[k]) if k >= 0 and safe[k] >= low else -1

    out, start = [], 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(before, before[start] + config.max_tokens, "right")) - 1)
        if end < n:
            cut = last_safe(end, start + 1)
            end = cut if cut > 0 else end
        end = min(end, n)
        out.append((start, end, int(before[end] - before[start])))
        if end >= n:
            return out
        back = int(np.searchsorted(before, before[end] - config.overlap, "right")) - 1
        back = last_safe(max(0, min(back, end - 1)), 0)
        start = back if back > start else end
    return out


def split_symbols(parsed: DataFrame, config: ChunkConfig = ChunkConfig(), measure: Callable[[str], int] = count_tokens) -> DataFrame:
    """Chunks of (parsed_id, file_path, symbol_name, body, start_line): with body, start_line, end_line, token_count, part,
    part_total and chunk_id.

    A body within ``max_tokens`` is one chunk, or none below ``min_tokens``; a longer one is split, and windows below
    ``min_tokens`` are dropped before parts are numbered. A null body is empty. Whole texts are read. ``measure`` counts the
    tokens of a text, such as those of a model's own tokenizer.
    """

    def work(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            rows: list[tuple] = []
            for i, body, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                body = body or ""
                total = measure(body)
                if total <= config.max_tokens:
                    kept = [(0, body.count("\n") + 1, total)] if total >= config.min_tokens else []
                else:
                    kept = [w for w in windows(body, config, measure) if w[2] >= config.min_tokens]
                lines = body.split("\n") if len(kept) > 1 or total > config.max_tokens else [body]
                for part, (a, b, tokens) in enumerate(kept):
                    text = "\n".join(lines[a:b]) if total > config.max_tokens else body
                    rows.append((i, text, (first or 1) + a, (first or 1) + b - 1, tokens, part, len(kept)))
            types = [pa.int64(), pa.string(), *[pa.int32()] * 5]
            names = ["parsed_id", "body", "start_line", "end_line", "token_count", "part", "part_total"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [()] * 7, types)], names)

    bodies = spread(parsed.select(F.col("parsed_id").cast("long").alias("parsed_id"), F.col("body").cast("string").alias("body"), F.col("start_line").cast("int").alias("start_line")))
    made = bodies.mapInArrow(work, "parsed_id long, body string, start_line int, end_line int, token_count int, part int, part_total int")
    named = made.join(parsed.select(F.col("parsed_id").cast("long").alias("parsed_id"), "file_path", "symbol_name"), "parsed_id")
    return named.withColumn("chunk_id", chunk_id(F.col("file_path"), F.col("symbol_name"), F.col("part"), F.col("body")))
