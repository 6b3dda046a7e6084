"""Keyed tables: upserts, cascading deletes, statistics and the cache of computed values."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import written


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``new`` and the rows of ``old`` whose keys it doesn't have; columns in ``keep`` stay as they were in ``old``."""
    if keep:
        before = old.select(*keys, *(F.col(c).alias(f"_{c}") for c in keep))
        joined = new.join(before, keys, "left")
        new = joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in keep else c for c in new.columns))
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti").select(*new.columns))


def delete_cascade(repos: DataFrame, files: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the repositories (id) in ``gone``."""
    ids = gone.select("id").distinct()
    return repos.join(ids, "id", "left_anti"), files.join(ids.withColumnRenamed("id", "repo_id"), "repo_id", "left_anti")


def file_stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(repo_id, path, content_hash, num_chunks) of each file, also of those without chunks (repo_id, file_path, chunk_id)."""
    by = chunks.groupBy("repo_id", F.col("file_path").alias("path")).agg(F.count_distinct("chunk_id").alias("num_chunks"))
    return files.join(by, ["repo_id", "path"], "left").select("repo_id", "path", F.sha2("content", 256).alias("content_hash"), F.coalesce("num_chunks", F.lit(0)).alias("num_chunks"))


def repo_stats(files: DataFrame) -> DataFrame:
    """(repo_id, num_files, num_chunks, languages) of (repo_id, path, language, num_chunks)."""
    return files.groupBy("repo_id").agg(F.count("*").alias("num_files"), F.sum("num_chunks").alias("num_chunks"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))


def cache_key(model: str, text: str):  # noqa: ANN201
    """Content-addressed key of a computed value."""
    return F.sha2(F.concat(F.lit(model), F.lit("\n"), F.col(text)), 256)


def probe(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``wanted`` (key, ...) whose key is in ``cache`` (key), and those whose isn't."""
    keys = cache.select("key").distinct()
    return wanted.join(keys, "key", "left_semi"), wanted.join(keys, "key", "left_anti")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")


class Cache:
    """Computed values by key, in a folder of append-only parquet files: the last entry of a key counts, and one without a value
    is none. ``hits`` and ``misses`` count the keys that ``get`` was asked for."""

    SCHEMA = "key string, value string, at long"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.hits = self.misses = self._entries = 0

    def _all(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).option("ignoreCorruptFiles", "true").parquet(self.folder)
        except AnalysisException:  # nothing was stored yet
            return self.spark.createDataFrame([], self.SCHEMA)

    def _add(self, rows: DataFrame) -> None:
        self._entries += 1
        stamped = rows.withColumn("at", F.lit(time.time_ns() + self._entries))
        stamped.select(*(x.split()[0] for x in self.SCHEMA.split(", "))).write.mode("append").parquet(self.folder)

    def entries(self) -> DataFrame:
        """(key, value) of all that is stored."""
        return latest(self._all(), ["key"], ["at"]).where("value is not null").select("key", "value")

    def has(self, wanted: DataFrame) -> DataFrame:
        """(key, present), without counting."""
        return wanted.select("key").distinct().join(self.entries(), "key", "left").select("key", F.col("value").isNotNull().alias("present"))

    def get(self, wanted: DataFrame) -> DataFrame:
        """(key, value) of the keys of ``wanted`` that are stored."""
        asked = wanted.select("key").distinct()
        found = written(asked.join(self.entries(), "key"), "cached")
        n = found.count()
        self.hits, self.misses = self.hits + n, self.misses + asked.count() - n
        return found

    def set(self, rows: DataFrame) -> None:
        """Stores (key, value)."""
        self._add(rows.select("key", "value").where("value is not null").dropDuplicates(["key"]))

    def get_or_set(self, wanted: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(key, value) of all keys of ``wanted``: what isn't stored is made of its rows by ``make`` (to key, value), and stored."""
        found = self.get(wanted)
        made = written(make(wanted.join(found, "key", "left_anti")).select("key", "value"), "made")
        self.set(made)
        return found.unionByName(made)

    def invalidate(self, keys: DataFrame) -> int:
        """Removes keys; how many were there."""
        gone = written(self.entries().join(keys.select("key").distinct(), "key", "left_semi").select("key"), "gone")
        self._add(gone.withColumn("value", F.lit(None).cast("string")))
        return gone.count()

    def clear(self) -> None:
        self._add(self.entries().select("key", F.lit(None).cast("string").alias("value")))
        self.reset_stats()

    def reset_stats(self) -> None:
        self.hits = self.misses = 0


def valid_requests(rows: DataFrame) -> DataFrame:
    """Requests (path, url, ...) to add a repository that name either."""
    return rows.where("path is not null or url is not null")
