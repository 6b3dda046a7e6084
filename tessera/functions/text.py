"""Scalar functions over text, as Column expressions that stay in the JVM.

Patterns avoid what Java, Python and RE2 read differently: letters and digits are Unicode classes, and blanks include \\p{Z}.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token, sentence, citation, word and stream patterns.
TOKEN = r"[A-Za-z_][\p{L}\p{N}_]*|\p{Nd}+|[^\s\p{Z}\p{L}\p{N}_]"
CODE_PIECE = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
SENTENCE = r"[^.!?\n]+[.!?]?"
CITATION = r"\[([^\[\]\s:]+):(\d+)(?:-(\d+))?\]"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
STREAM_TOKEN = r"\S+\s*"
BLANK_ENDS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
NOT_FOUND_MARKER = "NOT_FOUND_IN_CODEBASE"

# File suffix -> language.
SUFFIX_LANGUAGE = {
    "py": "python", "pyi": "python", "go": "go", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "rs": "rust", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp",
    "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "java": "java",
}
#: Fixed value: namespace of the name-based ids of chunks.
CHUNK_NAMESPACE = "5f3c9a1e2b6d4e8a9c477a1d0b2f6e30"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def strip(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(text, BLANK_ENDS, "")


def code_tokens(text: Column) -> Column:
    """Identifiers split at underscores and case changes, in lower case; only ASCII letters and digits count."""
    return F.transform(_all(text, CODE_PIECE), F.lower)


def tokens(text: Column) -> Column:
    """Words, numbers and single signs."""
    return _all(text, TOKEN)


def token_count(text: Column) -> Column:
    return F.size(tokens(F.coalesce(text, F.lit(""))))


def sentences(text: Column) -> Column:
    """Sentences without blanks at their ends, without empty ones; every full stop ends one, also inside of names."""
    return F.filter(F.transform(_all(text, SENTENCE), strip), lambda x: x != "")


def citations(text: Column) -> Column:
    """Array of (file, start, end) in order, one for each different span; without an end the start is the end."""
    ends = _all(text, CITATION, 3)
    spans = F.transform(
        F.arrays_zip(_all(text, CITATION, 1).alias("file"), _all(text, CITATION, 2).alias("start"), ends.alias("end")),
        lambda x: F.struct(x["file"].alias("file"), x["start"].cast("bigint").alias("start"), F.coalesce(F.nullif(x["end"], F.lit("")), x["start"]).cast("bigint").alias("end")),
    )
    return F.array_distinct(spans)


def word_set(text: Column) -> Column:
    """The different identifiers of a text, in lower case."""
    return F.array_distinct(F.transform(_all(text, IDENTIFIER), F.lower))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def language_of(path: Column) -> Column:
    """Language by the path's last suffix, in any case; null if it isn't known."""
    names = F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv])
    return F.try_element_at(names, F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)))


def base_name(place: Column) -> Column:
    """The last part of a repository's path or address, without blanks, slashes and ``.git`` at its end."""
    return F.regexp_extract(F.regexp_replace(F.regexp_replace(strip(place), r"[/\\\\]+$", ""), r"\.git$", ""), r"([^/\\\\:]*)$", 1)


def segments(text: Column) -> Column:
    """Array of (kind, text) of an answer in order: prose as it stands, and for each citation its ``file:start-end``."""
    spans = F.transform(_all(text, CITATION, 0), lambda c: F.struct(F.lit("citation").alias("kind"), _span_of(c).alias("text")))
    prose = F.transform(F.split(text, CITATION), lambda x: F.struct(F.lit("prose").alias("kind"), x.alias("text")))
    both = F.flatten(F.transform(F.arrays_zip(prose.alias("p"), spans.alias("c")), lambda x: F.array(x["p"], x["c"])))
    return F.filter(both, lambda s: s.isNotNull() & (s["text"] != ""))


def _span_of(citation: Column) -> Column:
    part = lambda n: F.regexp_extract(citation, CITATION, n)
    return F.concat(part(1), F.lit(":"), part(2), F.lit("-"), F.coalesce(F.nullif(part(3), F.lit("")), part(2)))


def softmax(logits: Column) -> Column:
    """An array of scores as parts of 1, safe for large ones; null for null or empty."""
    raised = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(logits) > 0, F.transform(raised, lambda x: x / total))


def chunk_id(file_path: Column, symbol: Column, part: Column, body: Column) -> Column:
    """Name-based (version 5) id of a chunk's place and content."""
    key = F.concat_ws("|", file_path, symbol, part.cast("string"), F.sha2(body, 256))
    h = F.sha1(F.concat(F.unhex(F.lit(CHUNK_NAMESPACE)), F.encode(key, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("bigint").bitwiseAND(63)).bitwiseOR(128)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


def occurrences(text: Column, words: Column) -> Column:
    """How often the words stand in the text, overlapping ones once."""
    one = lambda w: F.try_divide(F.length(text) - F.length(F.replace(text, w, F.lit(""))), F.length(w))
    return F.aggregate(words, F.lit(0.0), lambda total, w: total + F.coalesce(one(w), F.lit(0.0)))


def verdict(score: Column) -> Column:
    """Fixed limits of a grounding score."""
    return F.when(score >= 0.75, "high").when(score >= 0.5, "medium").when(score >= 0.25, "low").otherwise("none")


def name_hue(value: Column) -> Column:
    """A hue (0 to 359) by a 32-bit rolling hash of the characters."""
    codes = F.transform(F.split(value, ""), F.ascii)
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))) % 360


def relative_time(then: Column, now: Column) -> Column:
    """Age in the largest of minutes, hours and days that fits."""
    seconds = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(then))
    whole = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(unit))
    return F.when(then.isNull(), "—").when(seconds < 60, "just now").when(seconds < 3600, whole(60, "m")).when(seconds < 86400, whole(3600, "h")).otherwise(whole(86400, "d"))


def error_type(text: Column) -> Column:
    """Kind of a model backend's failure by its text."""
    low = F.lower(text)
    return F.when(low.contains("not set"), "llm_unconfigured").when(low.contains("rate limit") | low.contains("rate_limit") | low.contains("429"), "rate_limited").otherwise("llm_error")


def sha_vector(text: Column, dim: int = 16) -> Column:
    """The deterministic stand-in of an encoder: the first bytes of the text's SHA-256, each as a part of 1."""
    digest = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255)
