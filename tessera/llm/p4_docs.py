"""Problem 4: functions paired with their documentation.

A map stage finds for every chunk what it is (from symbol_type or, without one, from its code), its documentation (the
docstring or what opens its body), which of that describes it once markers, tags, placeholders, directives, licences, code
and restated names are gone, and for classes which classes they extend. Functions that have nothing of their own, or only a
pointer to their parent, are then joined level by level with the method of the same name in the classes above theirs, until
a description is found or no class is left; what stays without one is dropped. A function's own documentation is level 0 of
the same search.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import language_column, map_arrow
from tessera.session import spread, table, written

# Kinds of symbols, and words of languages that begin their declarations.
FUNCTIONS = {"function", "method", "constructor"}
CLASSES = {"class", "struct", "interface", "trait", "impl", "type", "enum"}
_CLASS_CODE = re.compile(r"^\s*(?:(?:export|default|pub(?:\([^)]*\))?|public|private|protected|abstract|final|static|sealed|data|unsafe|@\w+(?:\([^)]*\))?|typedef)\s+)*(?:class|struct|interface|trait|impl|enum|type|namespace|record|union|mod)\b(?!\s*\()")
_FUNCTION_CODE = re.compile(r"^\s*(?:(?:export|default|pub(?:\([^)]*\))?|public|private|protected|abstract|final|static|async|unsafe|const|inline|virtual|explicit|@\w+(?:\([^)]*\))?)\s+)*(?:def|func|fn|function)\b|^[^=;{}]*?[\w$~>*&\]]\s*\([^{};]*\)[^;{}=]*(?:\{|:|$)", re.S)

_LINE_MARK = re.compile(r"^\s*(?://+!?|#+!?|--+(?=\s))\s?")
_BLOCK_MARK = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!\*))\s?|\s*\*+/\s*$")
_QUOTE_MARK = re.compile(r"^\s*(?:\"\"\"|''')|(?:\"\"\"|''')\s*$")
_INNER_MARK = re.compile(r"^\s*(?://|#|/\*)")
_RESTATED = re.compile(r"^\W*(?:(?:the|a|this is(?: the| a)?|function|method|constructor)\s+)(?:\w+\s+){0,4}(?:function|method|constructor|routine|procedure)\W*$|^\W*this is(?:\s+\w+){1,3}\W*$", re.I)
_TAG = re.compile(r"^\s*(?:[@\\:](?:param|arg|argument|tparam|type|rtype|raises?|throws|exception|see|since|author|version|private|internal|deprecated|override|ignore|hidden|todo|module|class|name|memberof|template|inheritdoc)\b.*|\{@\w+[^}]*\}\s*$)", re.I)
_RETURN = re.compile(r"^\s*(?:[@\\:]returns?:?|returns?\s*:)\s*", re.I)
_SECTION = re.compile(r"^\s*(?:args|arguments|parameters|params|returns?|yields?|raises|throws|attributes|keyword args|see also|notes?|examples?|todo)\s*:?\s*$", re.I)
_ITEM = re.compile(r"^\s*[-*]?\s*`?\*{0,2}[A-Za-z_$][\w$.]*`?(?:\s*\([^)]*\))?\s*(?::(?![:=])|--?\s|–\s)(?P<rest>.*)$")
_NAME_ONLY = re.compile(r"^\s*[A-Za-z_$][\w$.]*(?:\(\s*\))?\s*\.?\s*$")
_DIRECTIVE = re.compile(r"^\s*(?:noqa|nolint|nosec|pylint|flake8|mypy|pyright|ruff|type:\s*ignore|eslint|tslint|jshint|jslint|prettier|istanbul|c8|@ts-|pragma|clang-format|NOSONAR|checkstyle|fmt:|isort|yapf|rustfmt|lint|go:\w+|coding[:=]|region|endregion)(?!\w)", re.I)
_PLACEHOLDER = re.compile(r"^\W*(?:to-?do|fixme|xxx|hack|tbd|n/?a|none|null|wip|no (?:description|documentation|docs?)|undocumented|missing doc\w*|doc(?:string|umentation)?|description|internal|helper|placeholder|stub|auto-?generated (?:method|function|constructor)? ?stub|(?:write|add|insert) (?:docs?|documentation|description)\b.*|lorem ipsum\b.*)\W*(?:(?<=:)\s.*|(?<=todo)\W.*|(?<=fixme)\W.*)?$", re.I)
_MARKED_TODO = re.compile(r"^\W*(?:to-?do|fixme|xxx|hack|tbd)\b", re.I)
_LICENCE = re.compile(r"spdx-license|copyright|\(c\)\s*\d{4}|©|all rights reserved|licen[sc]ed? under|under the terms|governed by the licen[sc]e|may not use this file|in compliance with|without warrant|redistribution and use|licence file|license file|public terms", re.I)
_POINTER = re.compile(r"^\W*(?:\{?@?inherit\s?-?doc\}?|see\b|refer to\b|documented (?:in|at|by|elsewhere)\b|docs? (?:in|at)\b|(?:full |more )?documentation (?:is )?(?:in|at|elsewhere|can be found)\b|inherited (?:from|documentation)\b|same as\b|as (?:in|for) (?:the )?(?:base|parent|super)\b|overrides?\b|implements\b|for (?:details|more|documentation)\b.*\bsee\b|defined (?:in|by) (?:the )?(?:base|parent|interface)\b|siehe\b|voir\b|véase\b|ver\b|см\.)", re.I)
_INHERIT = re.compile(r"inherit\s?-?doc|base class|parent class|super\s?class|overrid|see (?:the )?(?:base|parent|super|interface)|implements", re.I)
_CODE = re.compile(
    r"""^\s*(?:
        (?:let|const|var|auto|int|long|double|float|bool|char|string|String|final|static|mut)\s+[\w\s*&<>:]*=.*
      | (?:let|const|var|auto|mut)\s+\w+.*[;=].*
      | [A-Za-z_$][\w$.\[\]>-]*\s*(?::=|[+*/-]?=(?!=))\s*\S.*
      | (?:return|throw|raise|break|continue|yield|await|import|include|from|use|package)\b[^.!?]*[;(){}]\s*$
      | return\s+[\w.]+\s*[-+*/(\[].*
      | (?:if|for|while|switch|elif|else|try|catch|except|with|def|func|fn|function|class)\b.*[:{]\s*$
      | [A-Za-z_$][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*!?)*!?\s*\((?:[^()]|\([^()]*\))*\)(?:\[[^\]]*\])?\s*[;{]?\s*$
      | [})\];]+\s*$
      | .*[;{}]\s*$
    )""",
    re.X,
)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_INLINE_TAG = re.compile(r"\{@(?:link|code|literal|linkplain)\s+([^}]*)\}")
_HTML = re.compile(r"</?[A-Za-z][^<>]*>")
_SPLIT = re.compile(r"(?<=[^\W\d_])[_\W]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[_\W]+")
# Words that say nothing beyond a name.
FILLERS = set("a an the this that these it its is are was be of to for in on by with and or method function constructor class func fn procedure routine call calls called implementation implements implement does do performs perform here".split())
OUT = "parsed_id long, repo_id string, file_path string, symbol_name string, kind string, language string, start_line int, end_line int, description string, pointer boolean, parents array<string>"


_BEFORE_HEAD = re.compile(r"\s+|/\*.*?\*/|(?://|#(?!include|define|if|\[|!\[))[^\n]*|@(?!interface)[\w.]+(?:[ \t]*(?P<args>\())?", re.S)
_HEAD_END = re.compile(r"[;{}]")


def _head(body: str) -> str:
    """The code of ``body`` from behind its leading comments and annotations to its first brace or semicolon, where a head
    ends at the latest."""
    at = 0
    while m := _BEFORE_HEAD.match(body, at):
        at = m.end()
        depth = 1 if m["args"] else 0
        while depth and at < len(body):
            depth += {"(": 1, ")": -1}.get(body[at], 0)
            at += 1
    end = _HEAD_END.search(body, at)
    return body[at : end.end() if end else len(body)]


def kind_of(symbol_type: str | None, signature: str | None, body: str | None) -> str | None:
    """``function`` (also for methods and constructors), ``class`` (for what can hold methods), or None."""
    said = (symbol_type or "").strip().lower()
    if said:
        return "function" if said in FUNCTIONS else "class" if said in CLASSES else None
    code = (signature or "").strip() or _head(body or "")
    if _CLASS_CODE.match(code):
        return "class"
    return "function" if _FUNCTION_CODE.match(code) else None


_LINE_ENDS = re.compile(r"[ \t]*(?:#[^\n]*)?\n")


def opening(body: str) -> str:
    """The comment before a body's code or, after its header, the comment or string literal that opens it."""
    text = body.replace("\r\n", "\n")
    lead = _comment_at(text, 0)
    if lead:
        return lead
    depth = 0
    for m in re.finditer(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'|[()\[\]{}:\n]", text):
        ch = m.group()
        if ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif depth <= 0 and (ch == "{" or ch == ":" and _LINE_ENDS.match(text, m.end())):
            if ch == "{" and re.search(r"(?:->|:)\s*$", text[: m.start()]):  # a type's brace
                continue
            rest = text[m.end() :]
            after = re.match(r"[ \t]*(?:#[^\n]*)?\n" if ch == ":" else r"[ \t]*\n?", rest)
            return _comment_at(text, m.end() + (after.end() if after else 0))
    return ""


def _comment_at(text: str, at: int) -> str:
    """The comment lines, block comment or string literal that stand at ``at``, after blanks."""
    at += len(text[at:]) - len(text[at:].lstrip())
    rest = text[at:]
    if rest.startswith("/*"):
        return rest[: rest.find("*/") + 2] if "*/" in rest else rest
    m = re.match(r"[rRuUbBfF]{0,2}(\"\"\"|''')", rest)
    if m:
        end = rest.find(m.group(1), m.end())
        return rest[m.start(1) : end + 3] if end >= 0 else rest
    m = re.match(r"(?:(?://|#(?!include|define|if|\[|!\[))[^\n]*(?:\n[ \t]*|$))+", rest)
    if m:
        return m.group()
    m = re.match(r"[rRuU]?(\"(?:[^\"\\\n]|\\.)+\"|'(?:[^'\\\n]|\\.)+')\s*(?:\n|$)", rest)
    return m.group(1)[1:-1] if m else ""


def words_of(name: str) -> set[str]:
    return {w.lower() for w in _SPLIT.split(name or "") if w}


def describes(line: str, name_words: set[str]) -> bool:
    """Whether a phrase has four words or more, and at least two beyond the symbol's name."""
    words = [w.lower() for w in _WORD.findall(re.sub(r"`[^`]*`", " x ", line))]
    cjk = len(_CJK.findall(line))
    if cjk:
        return cjk >= 8 or len(words) + cjk // 2 >= 4
    beyond = [w for w in words if w not in name_words and w not in FILLERS and not (w.endswith("s") and w[:-1] in name_words)]
    return len(words) >= 4 and len(beyond) >= 2


def description(doc: str, name: str, signature: str | None = None) -> tuple[str, bool]:
    """What of ``doc`` describes the symbol (empty: nothing), and whether it points to a parent's documentation."""
    name_words = words_of(name)
    kept: list[str] = []
    section = pointer = False
    lines = doc.replace("\r\n", "\n").split("\n")
    filled = [x for x in lines if x.strip()]
    # what every line of the documentation carries is its own mark; any other mark is part of what it says
    block = doc.lstrip().startswith("/*")
    mark = _BLOCK_MARK if block else _LINE_MARK if filled and all(_LINE_MARK.match(x) for x in filled) else _QUOTE_MARK
    inner: list[int] = []
    has_code = False
    for raw in lines:
        line = mark.sub("", raw)
        remark = bool(_INNER_MARK.match(line))
        line = _LINE_MARK.sub("", line) if remark else line
        line = _HTML.sub(" ", _INLINE_TAG.sub(r"\1", line)).strip()
        if _INHERIT.search(line):
            pointer = True
        if not line or not re.search(r"\w", line):
            if not line:
                section = False
            continue
        if _SECTION.match(line):
            section = not line.lower().startswith(("note", "example"))
            continue
        if _TAG.match(line) or _DIRECTIVE.match(line) or _MARKED_TODO.match(line) or _PLACEHOLDER.match(line) or _LICENCE.search(line) or _POINTER.match(line):
            continue
        line = _RETURN.sub("", line)
        item = _ITEM.match(line)
        if item and (section or re.match(r"\s*[-*]?\s*`?[a-z]\w*(?:_\w+|[A-Z]\w*)+", line) or signature and re.search(rf"\b{re.escape(line.split(':')[0].strip(' `*-'))}\b", signature)):
            continue
        if section and (raw.startswith((" ", "\t")) and item or _NAME_ONLY.match(line)):
            continue
        if _NAME_ONLY.match(line):
            continue
        if _CODE.match(line):
            has_code = True
            continue
        if remark:
            inner.append(len(kept))
        kept.append(line)
    if has_code:  # commented-out code with its own comments
        kept = [x for k, x in enumerate(kept) if k not in inner]
    # sentences may run over lines, so phrases are looked for in the joined text
    text = " ".join(kept)
    phrases = re.split(r"(?<=[.!?。！？])\s*|\s*[;\n]\s*", text)
    good = [p for p in phrases if p and not _RESTATED.match(p) and not _PLACEHOLDER.match(p) and not _MARKED_TODO.match(p) and not _POINTER.match(p) and not _LICENCE.search(p)]
    if any(describes(p, name_words) for p in good):
        return " ".join(good), pointer
    return "", pointer


_PARENTS = [
    re.compile(r"\bclass\s+\w+\s*\(([^()]*)\)\s*:"),
    re.compile(r"\b(?:class|interface|struct|record)\s+\w+(?:<[^{}]*?>)?[^{};]*?\bextends\s+([^{}]*?)(?:\bimplements\b|\bpermits\b|\{|$)"),
    re.compile(r"\b(?:class|struct|record|enum)\b[^{};]*?\bimplements\s+([^{};]*?)(?:\{|$)"),
    re.compile(r"\b(?:class|struct)\s+\w+(?:\s+final)?\s*:\s*([^{};]*)(?:\{|$)"),
    re.compile(r"\bimpl(?:<[^{}]*?>)?\s+([\w:<>, ]+?)\s+for\s+\w+"),
]
_PARENT_NAME = re.compile(r"[A-Za-z_]\w*(?:(?:\.|::)\w+)*")


def parents_of(signature: str | None, body: str | None) -> list[str]:
    """Names of the classes that a class's header extends or implements."""
    head = (signature or "") + "\n" + re.split(r"[{\n]", (body or "").lstrip() + "\n")[0]
    out: list[str] = []
    for pattern in _PARENTS:
        for m in pattern.finditer(head):
            cleaned = re.sub(r"<[^<>]*>|\b(?:public|private|protected|virtual|metaclass\s*=\s*\w+)\b", " ", m.group(1))
            out += [re.split(r"\.|::", n)[-1] for n in _PARENT_NAME.findall(cleaned)]
    return list(dict.fromkeys(n for n in out if n != "object"))


def document_chunks(chunks: DataFrame) -> DataFrame:
    """Rows of OUT, one for each row of ``chunks`` that is a function or may hold methods."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        out: list[tuple] = []
        for i, repo, path, name, symbol_type, signature, doc, body, language, start, end in zip(*columns):
            kind = kind_of(symbol_type, signature, body)
            if kind == "class":
                out.append((i, repo, path, name, kind, language, start, end, "", False, parents_of(signature, body)))
            elif kind == "function":
                text, pointer = description(doc if doc and doc.strip() else opening(body or ""), name or "", signature)
                out.append((i, repo, path, name, kind, language, start, end, text, pointer, None))
        types = [pa.int64(), *[pa.string()] * 5, pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.list_(pa.string())]
        names = [x.split()[0] for x in OUT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [()] * 11, types)], names)

    rows = chunks.select(
        F.col("parsed_id").cast("long").alias("parsed_id"), *(F.col(c).cast("string").alias(c) for c in ("repo_id", "file_path", "symbol_name", "symbol_type", "signature", "docstring", "body")),
        language_column(F.col("language").cast("string"), F.col("file_path").cast("string")).alias("language"), F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"),
    )
    return map_arrow(spread(rows).where("parsed_id is not null"), work, OUT, "body")


def class_parents(classes: DataFrame) -> DataFrame:
    """Rows (class_id, parent_id) of classes (class_id, repo_id, language, file_path, class_name, parents).

    A parent's name means the class of that name in the same file, else in the same folder, else in the repository, of the same
    language; of several the one with the smallest id. Each look-up has one row a key, so none multiplies rows.
    """
    folder = F.regexp_replace("file_path", "[^/]*$", "")
    known = classes.select("class_id", "repo_id", F.coalesce("language", F.lit("")).alias("language"), "file_path", folder.alias("folder"), F.col("class_name").alias("parent"), "parents")
    named = known.select("class_id", "repo_id", "language", "file_path", "folder", F.explode("parents").alias("parent"))
    for n, place in enumerate((["file_path"], ["folder"], [])):
        keys = ["repo_id", "language", *place, "parent"]
        # the two smallest ids, as a class isn't its own parent
        there = known.groupBy(*keys).agg(F.min("class_id").alias("low"), F.max("class_id").alias("high"))
        named = named.join(there, keys, "left").withColumn(f"found{n}", F.when(F.col("low") != F.col("class_id"), F.col("low")).when(F.col("high") != F.col("class_id"), F.col("high"))).drop("low", "high")
    return named.select("class_id", F.coalesce("found0", "found1", "found2").alias("parent_id")).where("parent_id is not null").distinct()


def pairs(chunks: DataFrame) -> DataFrame:
    """Rows (parsed_id, description, levels): code–description pairs with inherited descriptions, ``levels`` classes above.

    A function's own description is level 0. A method belongs to the smallest class chunk of its file that encloses its lines.
    One without a description takes that of the method of its name in a class that its own extends, the nearest level first,
    the class with the smallest id within a level; classes are resolved by ``class_parents``. No class is visited twice for a method,
    so circular hierarchies end, and there is no limit to the levels. What has no description at the end is dropped.

    Null parsed_ids give nothing. Repeated rows count once (with the smallest description, if they differ). A null or blank
    docstring is replaced by what opens the body; a null body opens with nothing; a null name can't be restated nor inherits;
    without a repository or path there is no class. Texts are read whole.
    """
    rows = written(document_chunks(chunks), "p4-chunks")
    place = F.min(F.struct("repo_id", "file_path", "symbol_name", "language", "start_line", "end_line")).alias("at")
    own = F.min(F.when(F.col("description") != "", F.col("description"))).alias("description")
    functions = rows.where("kind = 'function'").groupBy("parsed_id").agg(own, place).select("parsed_id", "description", "at.*")
    classes = rows.where("kind = 'class'").groupBy(F.col("parsed_id").alias("class_id")).agg(place, F.flatten(F.collect_set("parents")).alias("parents"))
    classes = classes.select("class_id", "at.repo_id", "at.language", "at.file_path", F.col("at.symbol_name").alias("class_name"), F.col("at.start_line").alias("class_start"), F.col("at.end_line").alias("class_end"), F.array_distinct("parents").alias("parents"))
    classes = written(classes, "p4-classes")
    above = written(class_parents(classes), "p4-above")

    held = functions.join(classes.select("class_id", "repo_id", "file_path", "class_name", "class_start", "class_end"), ["repo_id", "file_path"])
    held = held.where("class_start <= start_line and class_end >= end_line and (class_name <> symbol_name or class_end - class_start > end_line - start_line)")
    smallest = F.min_by("class_id", F.struct(F.col("class_end") - F.col("class_start"), "class_id")).alias("class_id")
    placed = written(held.groupBy("parsed_id", "symbol_name", "description").agg(smallest), "p4-methods")
    donors = placed.where("description is not null").groupBy(F.col("class_id").alias("at"), "symbol_name").agg(F.min_by("description", "parsed_id").alias("inherited"))
    waiting = placed.where("description is null").select("parsed_id", "symbol_name", F.col("class_id").alias("at"))
    seen, parts, level = waiting.select("parsed_id", "at"), [], 0
    while True:
        level += 1
        step = waiting.join(above.withColumnRenamed("class_id", "at"), "at").select("parsed_id", "symbol_name", F.col("parent_id").alias("at")).distinct()
        climbed = written(step.join(seen, ["parsed_id", "at"], "left_anti"), "p4-level")
        found = climbed.join(donors, ["at", "symbol_name"]).groupBy("parsed_id").agg(F.min_by("inherited", "at").alias("inherited"), F.lit(level).alias("above"))
        if not climbed.limit(1).count():
            parts.append(found)
            break
        parts.append(written(found, "p4-found"))
        waiting, seen = climbed.join(parts[-1], "parsed_id", "left_anti"), seen.unionByName(climbed.select("parsed_id", "at"))
    inherited = functools.reduce(DataFrame.unionByName, parts)
    both = functions.join(inherited, "parsed_id", "left").select("parsed_id", F.coalesce("description", "inherited").alias("description"), F.when(F.col("description").isNotNull(), 0).otherwise(F.col("above")).alias("levels"))
    return both.where("description is not null")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions that are described where they stand: what is only inherited is a pointer elsewhere."""
    return pairs(table(spark, sf_dir, "parsed_chunks")).where("levels = 0").select("parsed_id")


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(table(spark, sf_dir, "parsed_chunks"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p4_found": p4_found, "p4_pairs": p4_pairs}
SQL: dict[str, str] = {}
