"""The three modes over a tree of files: index it, ask it, and check its documentation against it.

An index is a folder of parquet tables: files, lines, chunks, vectors, postings, lengths, terms, edges and findings, each with a
partition for each repository, and repos with their history. ``lines`` has the number of lines of every file of the tree, as
all of them can be cited. ``chunks`` is written first, and the others are independent jobs over it. Indexing a repository
again replaces its partitions and leaves those of others alone; vectors are only made of chunks that are new.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions import text as T
from tessera.operators import bm25, chunking, drift, fusion, graph, grounding, parsing, prompts, store, vectors
from tessera.session import path_exists, plain_unions, remove_path, written
from tessera.sources import files as src

TABLES = ("lines", "chunks", "vectors", "postings", "lengths", "terms", "edges", "files", "findings")


@dataclass(frozen=True)
class Engine:
    """``data_dir`` holds the index. Models are columns, such as their pandas UDFs: ``encode`` makes a vector of a text, ``rank``
    a score of a query and a text, ``entails`` the entailment of a hypothesis by a premise; ``measure`` counts the tokens of a text."""

    spark: SparkSession
    data_dir: str
    settings: Settings = Settings()
    encode: Callable[[Column], Column] = T.sha_vector
    rank: Callable[[Column, Column], Column] = fusion.word_hits
    entails: grounding.Entails = grounding.overlap
    measure: Callable[[str], int] = chunking.count_tokens
    progress: Callable[[str, str], None] = lambda stage, message: None

    def __post_init__(self) -> None:
        plain_unions(self.spark)
        self.spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")  # repo_id is a string

    def table(self, name: str, repo_id: str | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.data_dir}/{name}")
        return rows if repo_id is None else rows.where(F.col("repo_id") == repo_id)

    def _partition(self, name: str, repo_id: str) -> str:
        return f"{self.data_dir}/{name}/repo_id={quote(repo_id, safe='')}"

    def _write(self, name: str, df: DataFrame, repo_id: str) -> DataFrame:
        """Replaces the repository's partition of a table, also by nothing."""
        df.drop("repo_id").write.mode("overwrite").parquet(self._partition(name, repo_id))
        return self.table(name, repo_id)

    def _status(self, repo_id: str, name: str, source: str, status: str, error: str | None = None) -> None:
        """One more row of the repository's history; its last row is its state."""
        row = self.spark.createDataFrame([(repo_id, name, source, status, error)], "id string, name string, source string, status string, error string")
        row.withColumn("updated_at", F.current_timestamp()).write.mode("append").parquet(f"{self.data_dir}/repos")

    def repos(self) -> DataFrame:
        return store.latest(self.table("repos"), ["id"], ["updated_at"]).where("status <> 'deleted'")

    def delete(self, repo_id: str) -> bool:
        """Removes a repository and all its partitions; whether it was there."""
        there = self.repos().where(F.col("id") == repo_id).limit(1).count() > 0
        for name in TABLES:
            remove_path(self.spark, self._partition(name, repo_id))
        if there:
            self._status(repo_id, "", "", "deleted")
        return there

    def index(self, root: str, repo_id: str) -> DataFrame:
        """Indexes the files below ``root``; one row of the repository's statistics."""
        name = root.rstrip("/").rsplit("/", 1)[-1].removesuffix(".git")
        self._status(repo_id, name, root, "indexing")
        try:
            raw = self._scan(root)
            return self.index_files(raw.where(F.col("length") <= src.MAX_FILE_BYTES).select("path", "content"), repo_id, name, root, raw.select("path", "content"))
        except Exception as e:
            self._status(repo_id, name, root, "error", str(e)[:500])
            raise

    def _scan(self, root: str) -> DataFrame:
        return src.scan(self.spark, root).withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))

    def index_files(self, texts: DataFrame, repo_id: str, name: str = "", root: str = "", citable: DataFrame | None = None) -> DataFrame:
        """Indexes files (path, content); ``citable``: all that can be cited (path, content), if those are more."""
        s = self.settings
        self._write("lines", grounding.line_counts((texts if citable is None else citable).withColumnRenamed("path", "file")), repo_id)
        kept = src.eligible(texts, s.languages, s.ignore).select("path", "content")
        self.progress("parse", "parsing files")
        parsed = parsing.parse_files(kept)
        numbered = parsed.withColumn("parsed_id", F.xxhash64("path", "pos")).withColumnRenamed("path", "file_path")
        made = chunking.split_symbols(numbered, chunking.ChunkConfig(s.max_tokens, s.overlap, s.min_tokens), self.measure)
        about = numbered.select("parsed_id", F.col("symbol_type").alias("kind"), "signature", "docstring", "language")
        self.progress("chunk", "writing chunks")
        chunks = self._write("chunks", made.join(about, "parsed_id").drop("parsed_id").dropDuplicates(["chunk_id"]), repo_id)
        self.progress("embed", "encoding chunks")
        self._upsert_vectors(chunks, repo_id)
        self.progress("words", "building the inverted index")
        made_index = bm25.build_index(chunks.select(F.col("chunk_id").alias("id"), F.concat_ws("\n", "symbol_name", "signature", "body").alias("text")))
        for part in ("postings", "lengths"):
            self._write(part, getattr(made_index, part), repo_id)
        self._write("terms", bm25.weigh(self.table("postings", repo_id), self.table("lengths", repo_id))[1], repo_id)
        self.progress("graph", "building the symbol graph")
        names = chunks.select(F.col("chunk_id").alias("src"), "repo_id", F.explode(parsing.imported_names()).alias("name"))
        self._write("edges", graph.build(chunks, names), repo_id)
        by_file = store.file_stats(kept.withColumn("repo_id", F.lit(repo_id)), chunks)
        files = self._write("files", by_file.withColumn("language", T.language_of(F.col("path"))), repo_id)
        self._status(repo_id, name, root, "ready")
        self.progress("done", "ready")
        return store.repo_stats(files)

    def _upsert_vectors(self, chunks: DataFrame, repo_id: str) -> None:
        """The vectors of a repository's chunks: those it has stay, new ones are encoded, and those of no chunk go."""
        text = F.array_join(F.filter(F.array("symbol_name", "signature", "docstring", "body"), lambda x: x != ""), "\n")
        wanted = chunks.select(F.col("chunk_id").alias("id"), text.alias("text"))
        made = lambda rows: rows.select("id", self.encode(F.col("text")).alias("vector"))
        if path_exists(self.spark, self._partition("vectors", repo_id)):
            old = self.table("vectors", repo_id).select("id", "vector")
            rows = written(store.upsert(old, made(wanted.join(old, "id", "left_anti")), ["id"]).join(wanted, "id", "left_semi"), "vectors")
        else:
            rows = made(wanted)
        self._write("vectors", rows, repo_id)

    def retrieve(self, queries: DataFrame, k: int | None = None, hints: DataFrame | None = None, repo_id: str | None = None) -> DataFrame:
        """(query_id, id, score, rank) of queries (query_id, text) that aren't blank: both legs, fused. The dense leg reads the
        query followed by its hint (query_id, hint), if there is one; the word leg reads the query alone. ``repo_id``: only this
        repository, weighed by its own words; else all of them together."""
        s, queries = self.settings, prompts.asked(queries)
        postings, lengths = self.table("postings", repo_id), self.table("lengths", repo_id)
        terms = bm25.weigh(postings, lengths)[1] if repo_id is None else self.table("terms", repo_id)
        words = bm25.Bm25Index(postings, lengths, terms, lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")))
        asked = queries.join(hints, "query_id", "left").select("query_id", F.concat_ws("\n", "text", "hint").alias("text")) if hints is not None else queries
        dense = vectors.nearest(self.table("vectors", repo_id), asked.select("query_id", self.encode(F.col("text")).alias("vector")), s.top_k_dense)
        ranked = bm25.top_k(bm25.scores(words, queries), s.top_k_words)
        return fusion.fuse([dense, ranked], k or s.top_k_dense)

    def context(self, queries: DataFrame, hints: DataFrame | None = None, repo_id: str | None = None) -> DataFrame:
        """(query_id, rank, chunk_id, ...) of the chunks that answer each query: retrieved, re-ranked and expanded."""
        s, c = self.settings, self.table("chunks", repo_id)
        text = fusion.preview(F.col("file_path"), F.col("symbol_name"), F.col("signature"), F.col("body"))
        rows = self.retrieve(queries, hints=hints, repo_id=repo_id).join(c.select(F.col("chunk_id").alias("id"), text.alias("text")), "id").join(queries.withColumnRenamed("text", "query"), "query_id")
        best = fusion.rerank(rows, s.top_k_rerank, self.rank).select("query_id", "id", "rank")
        grown = graph.expand(self.table("edges", repo_id), best, s.hops, s.most_chunks)
        return grown.join(c, F.col("id") == F.col("chunk_id")).drop("id")

    def answer(self, queries: DataFrame, model: Callable[[DataFrame], DataFrame], attempts: int | None = None, repo_id: str | None = None) -> DataFrame:
        """(answer_id, text, ok, score, verdict): ``model`` turns prompts (answer_id, system, prompt) into answers (answer_id, text).

        Answers that cite nothing or what doesn't exist are asked for again, with the same prompt, up to the settings'
        retries; those that say the marker of nothing found stay. All queries go through each step together. Blank queries
        have no answer. An answer is supported by the chunks it cites, or by all it was shown if it cites none of them.
        """
        queries = prompts.asked(queries)
        used = written(self.context(queries, repo_id=repo_id), "context")
        shown = used.select("chunk_id", "file_path", "start_line", "end_line", "symbol_name", "kind", "body").distinct()
        parts = used.select("query_id", "rank", "chunk_id").join(prompts.chunk_text(shown).withColumnRenamed("id", "chunk_id"), "chunk_id")
        waiting = queries.join(prompts.joined_parts(parts, "query_id"), "query_id", "left")
        waiting = waiting.select(F.col("query_id").alias("answer_id"), F.lit(prompts.GROUNDED).alias("system"), prompts.question_message(F.col("context"), F.col("text")).alias("prompt"))
        waiting = written(waiting, "prompts")
        disk = self.table("lines", repo_id).groupBy("file").agg(F.max("last").alias("last"))
        done = None
        for _ in range((self.settings.max_retries if attempts is None else attempts) + 1):
            said = written(model(waiting).select("answer_id", "text"), "answers")
            spans = grounding.cited(said).join(disk, "file", "left")
            good = spans.groupBy("answer_id").agg(F.every(F.coalesce((F.col("start") >= 1) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("last")), F.lit(False))).alias("ok"))
            checked = written(said.join(good, "answer_id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)) | F.startswith(T.strip(F.col("text")), F.lit(T.NOT_FOUND_MARKER))), "checked")
            part = checked.where("ok")
            done = part if done is None else done.unionByName(part)
            waiting = waiting.join(part.select("answer_id"), "answer_id", "left_anti")
            if not waiting.limit(1).count():
                break
        out = done.unionByName(checked.where("not ok"))
        context = used.select(F.col("query_id").alias("answer_id"), "chunk_id", F.col("body").alias("premise"))
        premises = grounding.premises_of(grounding.cited_chunks(grounding.cited(out), shown), context)
        return out.join(grounding.ground(out.select("answer_id", "text"), premises, self.entails), "answer_id")

    def claims(self, files: DataFrame, model: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(claim_id, claim, doc_file, doc_line) that ``model`` reads in the documentation among files (path, content): prompts
        (answer_id, system, prompt) become answers (answer_id, text) with a JSON array of claims."""
        asked = drift.claim_prompts(src.documents(files, self.settings.ignore)).withColumn("answer_id", F.xxhash64("doc_file"))
        asked = written(asked.withColumn("system", F.lit(prompts.CLAIMS)), "documents")
        raw = model(asked.select("answer_id", "system", "prompt")).select("answer_id", F.col("text").alias("raw"))
        found = drift.parse_claims(asked.join(raw, "answer_id").select("doc_file", "raw", "n_lines"))
        return found.select(F.xxhash64("doc_file", "pos").alias("claim_id"), "claim", "doc_file", "doc_line")

    def drift(self, claims: DataFrame, k: int = 8, repo_id: str | None = None) -> DataFrame:
        """Findings of claims (claim_id, claim, ...), all retrieved and checked together; blank claims are none."""
        claims = prompts.asked(claims, "claim")
        near = self.retrieve(claims.select(F.col("claim_id").alias("query_id"), F.col("claim").alias("text")), k, repo_id=repo_id)
        c = self.table("chunks", repo_id)
        retrieved = near.join(c.select(F.col("chunk_id").alias("id"), F.col("body").alias("text")), "id").select(F.col("query_id").alias("claim_id"), F.col("id").alias("chunk_id"), "rank", "text")
        places = c.select("chunk_id", F.col("file_path").alias("code_file"), F.col("start_line").alias("code_start"), F.col("end_line").alias("code_end"), F.col("symbol_name").alias("code_symbol"))
        return drift.check(claims.select("claim_id", "claim"), retrieved, self.entails).join(claims, "claim_id").join(places, "chunk_id", "left")

    def check_documents(self, root: str, repo_id: str, model: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Findings of the documentation below ``root``, kept as the repository's latest report."""
        self.progress("extract", "reading documentation")
        claims = written(self.claims(self._scan(root), model), "claims")
        n = claims.count()
        self.progress("check", f"checking {n} claims")
        found = self._write("findings", written(self.drift(claims, repo_id=repo_id), "findings").withColumn("checked_at", F.current_timestamp()), repo_id)
        self.progress("done", f"{n} of {n} claims checked")
        return found

    def latest_report(self, repo_id: str, status: str | None = None) -> DataFrame | None:
        """The findings of the last check of a repository, or None if there was none."""
        if not path_exists(self.spark, self._partition("findings", repo_id)):
            return None
        return drift.with_status(self.table("findings", repo_id), status)
