"""Citations and grounding: does an answer cite lines that exist, and do they support it?"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import citations, jaccard, sentences, softmax, verdict, word_set

NLI_WORD = r"[A-Za-z_]+"


def overlap(premise: Column, hypothesis: Column) -> Column:
    """The deterministic stand-in of an entailment model: the part of the hypothesis' words that the premise has."""
    words = lambda t: F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(NLI_WORD), 0), F.lower))
    h = words(hypothesis)
    return F.when(F.size(h) == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(words(premise), h)) / F.size(h), 4))


#: A model of entailment: premise and hypothesis to a column; of contradiction, entailment and neutral only the second is used here.
Entails = Callable[[Column, Column], Column]


def from_logits(model: Callable[[Column, Column], Column]) -> Entails:
    """A model that gives three logits (contradiction, entailment, neutral) as one that gives the part of entailment."""
    return lambda premise, hypothesis: softmax(model(premise, hypothesis))[1]


def cited(answers: DataFrame) -> DataFrame:
    """(answer_id, pos, file, start, end) of the different citations of (answer_id, text), in order from 0."""
    return answers.select("answer_id", F.posexplode(citations("text"))).select("answer_id", F.col("pos").cast("long").alias("pos"), "col.file", "col.start", "col.end")


def _lines(content: str) -> Column:
    return F.split(F.regexp_replace(content, r"\n$", ""), "\n")


def line_counts(files: DataFrame) -> DataFrame:
    """(file, last): the number of lines of each of (file, content), without null contents; counted as by ``validate``."""
    return files.where("content is not null").groupBy("file").agg(F.max(F.size(_lines("content"))).alias("last"))


def validate(answers: DataFrame, files: DataFrame) -> DataFrame:
    """(answer_id, pos, file, start, end, exists, similarity, reason) of every citation, against (file, content).

    A citation exists if its file does and 1 <= start <= end <= number of lines. Similarity is the Jaccard similarity of the
    answer's words and the cited lines'; it only informs. The contents that are cited are joined, not all.
    """
    spans = cited(answers)
    wanted = spans.select("file").distinct()
    known = files.join(wanted, "file", "left_semi").select("file", _lines("content").alias("lines"))
    checked = spans.join(known, "file", "left").join(answers.select("answer_id", "text"), "answer_id")
    in_range = (F.col("start") >= 1) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.size("lines"))
    reason = F.when(F.col("lines").isNull(), "file not found").when(~in_range, "line range out of bounds").otherwise("")
    length = F.when(in_range, F.col("end") - F.col("start") + 1).otherwise(0).cast("int")
    snippet = F.array_join(F.slice("lines", F.greatest(F.col("start"), F.lit(1)).cast("int"), length), "\n")
    exists = reason == ""
    similarity = F.when(exists, F.round(jaccard(word_set(F.col("text")), word_set(snippet)), 6)).otherwise(0.0)
    return checked.select("answer_id", "pos", "file", "start", "end", exists.alias("exists"), similarity.alias("similarity"), reason.alias("reason"))


def answer_ok(checks: DataFrame, answers: DataFrame) -> DataFrame:
    """(answer_id, ok, citations): an answer is in order if it cites anything and all that it cites exists."""
    by = checks.groupBy("answer_id").agg(F.count("*").alias("citations"), F.every("exists").alias("all_exist"))
    joined = answers.select("answer_id").join(by, "answer_id", "left")
    return joined.select("answer_id", F.coalesce("all_exist", F.lit(False)).alias("ok"), F.coalesce("citations", F.lit(0)).alias("citations"))


def cited_chunks(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """(answer_id, chunk_id): chunks (chunk_id, file_path, start_line, end_line) that hold a citation's first line."""
    c = chunks.select("chunk_id", F.col("file_path").alias("file"), "start_line", "end_line")
    held = spans.join(c, "file").where((F.col("start") >= F.col("start_line")) & (F.col("start") <= F.col("end_line")))
    return held.select("answer_id", "chunk_id").distinct()


def premises_of(cited_rows: DataFrame, context: DataFrame) -> DataFrame:
    """What supports an answer: of its context (answer_id, chunk_id, premise) the cited chunks (answer_id, chunk_id), or all
    of it if none of that is cited."""
    held = context.join(cited_rows, ["answer_id", "chunk_id"], "left_semi")
    return held.unionByName(context.join(held.select("answer_id").distinct(), "answer_id", "left_anti"))


def ground(answers: DataFrame, premises: DataFrame, entails: Entails = overlap) -> DataFrame:
    """(answer_id, score, verdict): the mean over an answer's sentences of the best entailment by a premise (answer_id,
    premise); 0 without sentences or premises. Sentences meet the premises of their own answer only."""
    parts = answers.select("answer_id", F.posexplode(sentences("text"))).withColumnRenamed("col", "sentence")
    best = parts.join(premises, "answer_id", "left").groupBy("answer_id", "pos").agg(F.max(F.coalesce(entails(F.col("premise"), F.col("sentence")), F.lit(0.0))).alias("best"))
    score = best.groupBy("answer_id").agg(F.round(F.avg("best"), 4).alias("score"))
    out = answers.select("answer_id").join(score, "answer_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return out.withColumn("verdict", verdict(F.col("score")))
