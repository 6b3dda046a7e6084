"""What the problems share: language names, batches and repeated rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import SUFFIX_LANGUAGE

# Other spellings of the languages.
LANGUAGE_SPELLING = {
    "py": "python", "python3": "python", "js": "javascript", "node": "javascript", "ts": "typescript",
    "golang": "go", "rs": "rust", "c++": "cpp", "cxx": "cpp", "cc": "cpp",
}


def language_column(language: Column, path: Column) -> Column:
    """The canonical language: from its spelling if that is known, else from the path's suffix, else null."""
    names = sorted(set(SUFFIX_LANGUAGE.values()))
    spelled = F.lower(F.trim(language))
    known = F.create_map(*[F.lit(x) for k in names for x in (k, k)], *[F.lit(x) for kv in LANGUAGE_SPELLING.items() for x in kv])
    suffix = F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv])
    return F.coalesce(F.try_element_at(known, spelled), F.try_element_at(suffix, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))))


def by_blocks(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most_bytes`` of ``column``, so that numpy work on a slice stays in cache and memory.

    A single longer text is a slice of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, int(batch.num_rows * most_bytes / max(1, batch.column(batch.schema.get_field_index(column)).nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str) -> DataFrame:
    """``work`` over slices of ``df``, sized by ``column``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_blocks(batches, column):
            out = work(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)
