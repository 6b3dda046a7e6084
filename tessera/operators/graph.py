"""The symbol graph: edges by containment, calls and receivers, their precedence, and walks over them.

Chunks are (chunk_id, repo_id, file_path, symbol_name, kind, start_line, end_line, body); names are resolved within a
repository. Of several edges between two nodes the strongest type stays: imports, calls, containment, receiver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CALLABLE = ("function", "method", "constructor")
CONTAINER = ("class", "struct", "interface", "impl", "trait", "type", "enum")
CALL = r"([A-Za-z_][A-Za-z0-9_]*)!?\("
#: The receiver's type in the head of a method.
RECEIVER = r"^func \([A-Za-z_][A-Za-z0-9_]* \*?([A-Za-z_][A-Za-z0-9_]*)\)"
PRIORITY = {"imports": 0, "calls": 1, "contains": 2, "receiver": 3}


def containment(chunks: DataFrame) -> DataFrame:
    """(src, dst, type): from each chunk to the smallest longer container of its file that encloses its lines, the smallest
    chunk_id among equals. The file is an equi-key, so this is a hash join with a range condition."""
    c = chunks.where(F.col("kind").isin(*CONTAINER)).select("file_path", F.col("chunk_id").alias("dst"), F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"))
    inside = (F.col("c_start") <= F.col("start_line")) & (F.col("c_end") >= F.col("end_line")) & (F.col("c_end") - F.col("c_start") > F.col("end_line") - F.col("start_line"))
    held = chunks.join(c, "file_path").where(inside & (F.col("chunk_id") != F.col("dst")))
    best = F.min_by("dst", F.struct(F.col("c_end") - F.col("c_start"), "dst")).alias("dst")
    return held.groupBy(F.col("chunk_id").alias("src")).agg(best).select("src", "dst", F.lit("implements").alias("type"), F.lit("contains").alias("via"))


def call_sites(chunks: DataFrame) -> DataFrame:
    """(src, repo_id, name) of the different names that a chunk calls."""
    names = F.array_distinct(F.regexp_extract_all("body", F.lit(CALL), 1))
    return chunks.select(F.col("chunk_id").alias("src"), "repo_id", F.explode(names).alias("name"))


def call_links(chunks: DataFrame) -> DataFrame:
    """(src, repo_id, name, definitions): the calls of each chunk by name, with the number of callable chunks of its repository
    that they may mean, but itself. One row a call: definitions are counted before they are joined."""
    callable_ = chunks.where(F.col("kind").isin(*CALLABLE)).select("repo_id", F.col("symbol_name").alias("name"), F.col("chunk_id").alias("src"))
    known = callable_.groupBy("repo_id", "name").agg(F.count("*").alias("n"))
    found = call_sites(chunks).join(known, ["repo_id", "name"]).join(callable_.withColumn("own", F.lit(1)), ["repo_id", "name", "src"], "left")
    return found.select("src", "repo_id", "name", (F.col("n") - F.coalesce("own", F.lit(0))).alias("definitions")).where("definitions > 0")


def calls(chunks: DataFrame) -> DataFrame:
    """(src, dst, type): from each chunk to the callable chunks of its repository whose name it calls, but itself.

    The rows are calls times definitions, as every one is an edge; adaptive execution splits a name that is called from
    everywhere. ``call_links`` is the form whose size doesn't grow with the definitions of a name.
    """
    callable_ = chunks.where(F.col("kind").isin(*CALLABLE)).select("repo_id", F.col("symbol_name").alias("name"), F.col("chunk_id").alias("dst"))
    found = call_sites(chunks).join(callable_, ["repo_id", "name"]).where("src <> dst")
    return found.select("src", "dst", F.lit("calls").alias("type"), F.lit("calls").alias("via")).distinct()


def receivers(chunks: DataFrame) -> DataFrame:
    """(src, dst, type): from a method to the container that its receiver names; the largest chunk_id of the name wins."""
    to = chunks.where(F.col("kind").isin(*CONTAINER)).groupBy("repo_id", F.col("symbol_name").alias("name")).agg(F.max("chunk_id").alias("dst"))
    heads = chunks.where("kind = 'method'").select("repo_id", F.col("chunk_id").alias("src"), F.regexp_extract("body", RECEIVER, 1).alias("name"))
    return heads.join(to, ["repo_id", "name"]).where("src <> dst").select("src", "dst", F.lit("implements").alias("type"), F.lit("receiver").alias("via"))


def imports(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst, type): from chunks to the callable chunks of their repository that they import by name (src, repo_id, name)."""
    callable_ = chunks.where(F.col("kind").isin(*CALLABLE)).select("repo_id", F.col("symbol_name").alias("name"), F.col("chunk_id").alias("dst"))
    found = names.join(callable_, ["repo_id", "name"]).where("src <> dst")
    return found.select("src", "dst", F.lit("imports").alias("type"), F.lit("imports").alias("via")).distinct()


def strongest(edges: DataFrame) -> DataFrame:
    """One edge (src, dst, type) for each pair: of the strongest kind."""
    rank = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    best = F.min_by("type", F.struct(rank[F.col("via")], "type")).alias("type")
    return edges.groupBy("src", "dst").agg(best)


def build(chunks: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """All edges of the graph; ``names`` is (src, repo_id, name) of imported names, if they are known."""
    edges = containment(chunks).unionByName(calls(chunks)).unionByName(receivers(chunks))
    return strongest(edges.unionByName(imports(chunks, names)) if names is not None else edges)


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, id, depth) of the nodes within ``hops`` steps of each (seed) in either direction, but the seed itself."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    seen = seeds.select("seed", F.col("seed").alias("id"), F.lit(0).cast("long").alias("depth")).distinct()
    front = seen
    for depth in range(1, hops + 1):
        step = front.select("seed", F.col("id").alias("src")).join(both, "src").select("seed", F.col("dst").alias("id")).distinct()
        front = step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("depth", F.lit(depth).cast("long"))
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def expand(edges: DataFrame, ranked: DataFrame, hops: int = 1, most: int = 12) -> DataFrame:
    """(query_id, id, rank, seed) of ranked chunks (query_id, id, rank), cut to ``most``, followed by neighbours in the order
    of their seeds, depth and id as long as there is room."""
    near = neighbours(edges, ranked.select(F.col("id").alias("seed")), hops)
    reached = ranked.select("query_id", F.col("id").alias("seed"), F.col("rank").alias("seed_rank")).join(near, "seed")
    kept = ranked.where(F.col("rank") <= most)
    fresh = reached.join(ranked.select("query_id", "id"), ["query_id", "id"], "left_anti")
    fresh = fresh.groupBy("query_id", "id").agg(F.min(F.struct("seed_rank", "depth")).alias("place"))
    rows = kept.select("query_id", "id", F.lit(0).alias("part"), F.struct(F.col("rank").alias("seed_rank"), F.lit(0).cast("long").alias("depth")).alias("place"))
    rows = rows.unionByName(fresh.select("query_id", "id", F.lit(1).alias("part"), "place"))
    order = Window.partitionBy("query_id").orderBy("part", "place", "id")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most).select("query_id", "id", "rank", (F.col("part") == 0).alias("seed"))
