"""Prompts of grounded answers and of claim extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import CITATION, NOT_FOUND_MARKER, language_of, strip

GROUNDED = (
    "You explain a code base from excerpts of it. Say only what the excerpts show, and end each sentence with the place that shows it, "
    f"as [path:start-end]. If they don't show an answer, reply with {NOT_FOUND_MARKER} and nothing else."
)
CLAIMS = (
    "Read the numbered lines of a document and list what it states about the behaviour of the code, one fact an entry. "
    'Reply with a JSON array of {"claim": text, "line": number} and nothing else; [] if it states none.'
)


def chunk_text(chunks: DataFrame) -> DataFrame:
    """(id, part): each chunk as it stands in a prompt, its citable place first."""
    head = F.format_string("[%s:%d-%d]  %s (%s, %s)", "file_path", "start_line", "end_line", F.coalesce("symbol_name", F.lit("<module>")), F.coalesce("kind", F.lit("")), language_of(F.col("file_path")))
    return chunks.select(F.col("chunk_id").alias("id"), F.concat(head, F.lit("\n"), "body").alias("part"))


def joined_parts(rows: DataFrame, key: str) -> DataFrame:
    """(key, context) of (key, rank, part): the parts in order, with a blank line between them."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"])  # at most the chunks of one answer
    return rows.groupBy(key).agg(F.array_join(parts, "\n\n").alias("context"))


def question_message(context: Column, question: Column) -> Column:
    """What the model is asked: excerpts, then the question."""
    shown = F.coalesce(F.nullif(context, F.lit("")), F.lit("(nothing was found in the code)"))
    return F.concat(F.lit("Excerpts:\n\n"), shown, F.lit("\n\n---\nQuestion: "), question, F.lit("\nCite [path:start-end] after each sentence."))


def claims_message(name: Column, numbered: Column) -> Column:
    return F.concat(F.lit("Document "), name, F.lit(":\n\n"), numbered)


def asked(queries: DataFrame, text: str = "text") -> DataFrame:
    """The queries that ask anything: blank ones are refused."""
    return queries.where(F.col(text).isNotNull() & (strip(F.col(text)) != ""))


def first_excerpt(prompt: Column) -> Column:
    """The stand-in of a model: points to the first excerpt of its prompt, or says that there is none."""
    place = F.regexp_extract(prompt, CITATION, 0)
    name = F.regexp_extract(prompt, r"\]  (\S+) \(", 1)
    return F.when(place == "", NOT_FOUND_MARKER).otherwise(F.concat(F.lit("See "), name, F.lit(" "), place, F.lit(".")))
