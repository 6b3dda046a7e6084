"""Exact nearest neighbours of a stated query set.

The queries are matrices of bounded size, one for each vector length; each batch of rows is multiplied with that of its length,
and only the best k of each batch and query go on to the final ranking. If there are more queries than a block holds, they are
written to the shared folder and searched block by block, so that no more than one is on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.bm25 import top_k
from tessera.session import written

#: Rows of a block of queries, and of a product of queries and rows, at most.
BLOCK_QUERIES, BLOCK_ROWS = 2_000, 4_096


def nearest(rows: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, id, score, rank) of the ``k`` nearest of (id, vector) for each of (query_id, vector).

    ``metric``: ``cosine`` or ``l2`` (then the score is the negative distance). Scores are rounded to 6 digits; the smaller id
    is first among equals. Null vectors and those of another length take no part; a zero vector has the cosine 0.
    """
    numbered = queries.where("vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    some = numbered.limit(BLOCK_QUERIES + 1).toArrow()
    if some.num_rows <= BLOCK_QUERIES:
        lengths = pa.compute.list_value_length(some.column(1))
        parts = [_block(rows, some.filter(pa.compute.equal(lengths, n)), k, metric) for n in sorted(set(lengths.to_pylist()))]
        parts = parts or [_block(rows, some, k, metric)]
    else:
        parts = []
        asked = written(numbered.select("*", F.size("vector").alias("dim"), F.xxhash64(F.monotonically_increasing_id()).alias("turn")), "queries")
        for dim, n in sorted(map(tuple, asked.groupBy("dim").count().collect())):
            blocks = -(-n // BLOCK_QUERIES)  # by hash, so a block may be somewhat larger than the mean
            for block in range(blocks):
                mine = asked.where((F.col("dim") == dim) & (F.pmod("turn", F.lit(blocks)) == block)).select("query_id", "vector").toArrow()
                if mine.num_rows:
                    parts.append(written(_block(rows, mine, k, metric), "nearest"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return top_k(out, k, positive=False)


def _block(rows: DataFrame, block: pa.Table, k: int, metric: str) -> DataFrame:
    """Scores of the nearest rows in each batch for queries whose vectors have one length."""
    ids = block.column(0).to_numpy()
    vectors = block.column(1).to_pylist()
    matrix = np.array(vectors, float).reshape(len(ids), len(vectors[0]) if vectors else 1)
    dim = matrix.shape[1]
    normed = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    id_type = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                keep = pa.compute.equal(pa.compute.list_value_length(batch.column(1)), dim)
                batch = batch.filter(pa.compute.fill_null(keep, False))
                if not batch.num_rows or not len(ids):
                    continue
                held = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, dim)
                if metric == "l2":
                    score = -np.sqrt(np.maximum((matrix**2).sum(1)[:, None] + (held**2).sum(1) - 2 * matrix @ held.T, 0))
                else:
                    score = normed @ (held / np.maximum(np.linalg.norm(held, axis=1, keepdims=True), 1e-300)).T
                score = np.round(score, 6)
                # all that tie with the k-th stay, as the id decides among them
                limit = np.partition(score, -min(k, score.shape[1]), axis=1)[:, -min(k, score.shape[1])]
                q, r = np.nonzero(score >= limit[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), batch.column(0).take(pa.array(r)), pa.array(score[q, r])], ["query_id", "id", "score"])

    return rows.select("id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(work, f"query_id long, id {id_type}, score double")


def fetch_in_order(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of ``rows`` by an ordered id list (pos, ``key``), in its order; ids that don't exist are left out."""
    return ids.join(rows, key).orderBy("pos")
