"""Documentation drift: claims against the code that is retrieved for them."""

from __future__ import annotations

import io
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import strip
from tessera.operators.grounding import Entails, overlap
from tessera.operators.prompts import claims_message

# The order and the headings of the report.
STATUSES = ("contradicted", "not_found", "supported")
SUPPORT, CONTRADICT = 0.5, 0.5
CLAIMS = "array<struct<claim string, line int>>"


def number_lines(text):  # noqa: ANN001, ANN201
    """Each line with its number from 1."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x)), "\n")


def claim_prompts(docs: DataFrame) -> DataFrame:
    """(doc_file, prompt, n_lines) of documents (doc_file, text) that hold anything."""
    filled = docs.where(F.col("text").isNotNull() & (strip(F.col("text")) != ""))
    body = F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), "\n$", "")
    return filled.select("doc_file", claims_message(F.col("doc_file"), number_lines(body)).alias("prompt"), F.size(F.split(body, "\n")).alias("n_lines"))


def parse_claims(raw: DataFrame) -> DataFrame:
    """(doc_file, pos, claim, doc_line) of model output (doc_file, raw, n_lines): the JSON array in it, without entries that
    lack a claim; lines that aren't numbers are 1, and all are kept within the document."""
    parsed = F.from_json(F.regexp_extract("raw", r"(?s)\[.*\]", 0), CLAIMS, {"mode": "PERMISSIVE"})
    rows = raw.select("doc_file", "n_lines", F.posexplode(parsed))
    line = F.greatest(F.lit(1), F.least(F.coalesce("col.line", F.lit(1)), F.greatest(F.col("n_lines").cast("int"), F.lit(1))))
    return rows.select("doc_file", F.col("pos").cast("long").alias("pos"), strip(F.col("col.claim")).alias("claim"), line.cast("long").alias("doc_line")).where("claim <> ''")


def check(claims: DataFrame, retrieved: DataFrame, entails: Entails = overlap) -> DataFrame:
    """(claim_id, status, score, chunk_id) of claims (claim_id, claim) by retrieved chunks (claim_id, chunk_id, rank, text).

    The best entailment of at least 0.5 supports a claim, else the best contradiction of at least 0.5 contradicts it, else it
    isn't found; the lower rank is first among equals. Without chunks the score is 0.
    """
    scored = retrieved.join(claims, "claim_id").withColumn("entail", entails(F.col("text"), F.col("claim")))
    scored = scored.withColumn("contra", F.round((1 - F.col("entail")) / 2, 4))
    best = scored.groupBy("claim_id").agg(
        F.max_by(F.struct("entail", "chunk_id"), F.struct("entail", -F.col("rank"))).alias("e"),
        F.max_by(F.struct("contra", "chunk_id"), F.struct("contra", -F.col("rank"))).alias("c"),
    )
    joined = claims.select("claim_id").join(best, "claim_id", "left")
    supported, contradicted = F.col("e.entail") >= SUPPORT, F.col("c.contra") >= CONTRADICT
    status = F.when(supported, "supported").when(contradicted, "contradicted").otherwise("not_found")
    score = F.when(supported, F.col("e.entail")).when(contradicted, F.col("c.contra")).otherwise(F.coalesce("e.entail", F.lit(0.0)))
    return joined.select("claim_id", status.alias("status"), F.round(score, 4).alias("score"), F.when(~supported & contradicted, F.col("c.chunk_id")).otherwise(F.col("e.chunk_id")).alias("chunk_id"))


def counts(findings: DataFrame) -> DataFrame:
    """(status, n) in the order of the report, with 0 for what doesn't occur."""
    spark = findings.sparkSession
    order = spark.createDataFrame(list(enumerate(STATUSES)), "ord long, status string")
    return order.join(findings.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("ord", "status", F.coalesce("n", F.lit(0)).alias("n"))


def report_json(findings: DataFrame) -> DataFrame:
    """One row (report): counts and whether anything is contradicted, as JSON."""
    made = findings.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    return made.select(F.to_json(F.struct(F.struct(*STATUSES).alias("counts"), (F.col("contradicted") > 0).alias("has_contradictions"))).alias("report"))


def with_status(findings: DataFrame, status: str | None = None) -> DataFrame:
    """The findings of one status, or all."""
    return findings if status is None else findings.where(F.col("status") == status)


def markdown_lines(findings: DataFrame) -> DataFrame:
    """(ord, doc_file, doc_line, claim, text): each finding as a piece of the report, to be read in the order of these columns."""
    order = F.create_map(*[F.lit(x) for k, s in enumerate(STATUSES) for x in (s, k)])
    code = F.when(F.col("code_file").isNull(), "no relevant code retrieved").otherwise(F.format_string("`%s:%d-%d` — score %.2f", "code_file", "code_start", "code_end", "score"))
    text = F.concat(F.lit("### "), "claim", F.format_string("\n\n- **Doc:** `%s:%d`\n- **Code:** ", "doc_file", "doc_line"), code, F.lit("\n"))
    return findings.select(order[F.col("status")].alias("ord"), "doc_file", "doc_line", "claim", text.alias("text"))


def markdown(findings: DataFrame, repo_name: str = "", out: TextIO | None = None) -> str | None:
    """The report of all findings (claim, doc_file, doc_line, status, score, code_file, code_start, code_end), written to ``out``
    partition by partition, or returned. Groups follow the fixed order; empty ones are left out."""
    to = io.StringIO() if out is None else out
    n = {r.status: r.n for r in counts(findings).collect()}
    to.write("# Documentation Drift Report" + (f" — {repo_name}" if repo_name else "") + "\n\n")
    to.write(f"- ❌ Contradicted: **{n['contradicted']}**\n- ⚠️ Not found: **{n['not_found']}**\n- ✅ Supported: **{n['supported']}**\n")
    last = None
    for r in markdown_lines(findings).orderBy("ord", "doc_file", "doc_line", "claim").toLocalIterator():
        if r.ord != last:
            last = r.ord
            to.write(f"\n## {STATUSES[last].replace('_', ' ').capitalize()} ({n[STATUSES[last]]})\n")
        to.write("\n" + r.text)
    return to.getvalue() if out is None else None
