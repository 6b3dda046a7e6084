"""Scanning source trees: what is read, what is ignored, what has changed."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import language_of

#: Larger files are taken for data.
MAX_FILE_BYTES = 1_000_000
# Languages that are read by default, suffixes of documentation, and paths that are always ignored.
DEFAULT_LANGUAGES = ("python", "go", "javascript", "typescript", "rust", "c", "cpp", "java")
DOC_SUFFIXES = (".md", ".markdown", ".rst", ".txt")
DEFAULT_IGNORE = (
    ".git/", ".idea/", ".vscode/", "node_modules/", "vendor/", "third_party/", ".venv/", "venv/", "env/", "ENV/", "site-packages/",
    "dist/", "build/", "target/", "out/", "*.egg-info/", "__pycache__/", ".mypy_cache/", ".ruff_cache/", ".pytest_cache/",
    "*.generated.*", "*.gen.go", "*.pb.go", "*.pb.cc", "*.pb.h", "*_pb2.py", "*_pb2_grpc.py", "*.min.js", "*.min.css", "*.map",
)


def glob_regex(pattern: str) -> str:
    """The regular expression of a path pattern of the ignore-file language, for paths without a leading slash.

    A pattern with a slash before its end is tied to the root; ``*`` and ``?`` stay within a path part and ``**`` doesn't; a
    pattern that ends in a slash matches directories, that is everything below them.
    """
    below_only = pattern.endswith("/")
    body = pattern.rstrip("/")
    rooted = "/" in body
    body = body.lstrip("/")
    out, at = [], 0
    while at < len(body):
        if body.startswith("**/", at):
            out.append("(?:.*/)?")
            at += 3
        elif body.startswith("/**", at) and at + 3 == len(body):
            out.append("/.*")
            at += 3
        elif body.startswith("**", at):
            out.append(".*")
            at += 2
        elif body[at] == "*":
            out.append("[^/]*")
            at += 1
        elif body[at] == "?":
            out.append("[^/]")
            at += 1
        elif body[at] == "[" and "]" in body[at + 2 :]:
            end = body.index("]", at + 2)
            out.append("[" + body[at + 1 : end].replace("!", "^", 1 if body[at + 1] == "!" else 0).replace("\\", "\\\\") + "]")
            at = end + 1
        else:
            out.append(re.escape(body[at]))
            at += 1
    return ("^" if rooted else "^(?:.*/)?") + "".join(out) + ("/.*$" if below_only else "(?:/.*)?$")


def parse_rules(lines: list[str] | tuple[str, ...]) -> list[tuple[str, bool]]:
    """(regular expression, negated) of each rule; comments and blank lines are none."""
    rules = []
    for raw in lines:
        line = raw.strip()
        if line and not line.startswith("#"):
            negated = line.startswith("!")
            rules.append((glob_regex(line[negated:]), negated))
    return rules


def is_ignored(path: Column, extra: list[str] | tuple[str, ...] = ()) -> Column:
    """Whether the last rule that matches ``path`` ignores it: the defaults, then ``extra``."""
    clean = F.regexp_replace(path, r"^(?:\./|/)+", "")
    out = F.lit(False)
    for pattern, negated in parse_rules([*DEFAULT_IGNORE, *extra]):
        out = F.when(clean.rlike(pattern), F.lit(not negated)).otherwise(out)
    return out


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, content bytes, length) of all files below ``root``; a filter on length or path is applied before reading."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.escape(root.rstrip("/").split("://")[-1])
    return found.select(F.regexp_replace("path", f"^.*?{base}/", "").alias("path"), "content", "length")


def eligible(files: DataFrame, languages: tuple[str, ...] = DEFAULT_LANGUAGES, ignore: tuple[str, ...] = ()) -> DataFrame:
    """``files`` (path, content string) that are to be parsed, with their language: not ignored, of a wanted language, not
    too large and not binary."""
    kept = files.withColumn("detected", language_of(F.col("path"))).where(~is_ignored(F.col("path"), ignore))
    kept = kept.where(F.col("detected").isin(*languages)) if languages else kept.where("detected is not null")
    return kept.where((F.octet_length("content") <= MAX_FILE_BYTES) & ~F.contains("content", F.lit("\0")))


def documents(files: DataFrame, ignore: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(doc_file, text) of documentation among files (path, content): by suffix in any case, and not ignored; of any size."""
    suffix = F.lower(F.regexp_extract("path", r"[^/](\.[^./]+)$", 1))
    return files.where(suffix.isin(*DOC_SUFFIXES) & ~is_ignored(F.col("path"), ignore)).select(F.col("path").alias("doc_file"), F.col("content").alias("text"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo_id, path, change) between two snapshots (repo_id, path, content_hash): ``added``, ``removed`` or ``modified``."""
    a = old.select("repo_id", "path", F.col("content_hash").alias("old_hash"), F.lit(1).alias("was"))
    b = new.select("repo_id", "path", F.col("content_hash").alias("new_hash"), F.lit(1).alias("is"))
    both = a.join(b, ["repo_id", "path"], "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "modified")
    return both.select("repo_id", "path", change.alias("change")).where("change is not null")
