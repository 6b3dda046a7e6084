"""Structural parsing: from files to one row for each definition.

Python is parsed by the interpreter's own parser. The other languages are read by their brackets: literals and comments are
blanked, heads of definitions are found by one pattern for each language, and a definition ends with the bracket that closes
its body. Spans of these are exact for code that the formatters of the languages write.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import language_of
from tessera.session import spread

CLASS_LIKE = {"class", "struct", "interface"}
PARSED = "path string, symbol_name string, symbol_type string, signature string, docstring string, body string, start_line int, end_line int, language string, pos int"

_BLANK = {
    "default": re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\.[^'\n]{0,8})'", re.S),
    "javascript": re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`|'(?:[^'\\\n]|\\.)*'", re.S),
}
_BLANK["typescript"] = _BLANK["javascript"]
_NOT_NAMES = r"(?!(?:if|for|while|switch|catch|return|else|do|new|function|sizeof|throw|await|typeof|super|this)\b)"
# The heads of definitions by language; a group's name is the kind of the symbol it names.
_HEADS = {
    "go": r"^func\s+(?P<function>\w+)\s*[\[(]|^func\s*\([^)]*\)\s*(?P<method>\w+)\s*\(|^type\s+(?P<type>\w+)\s",
    "rust": r"(?:^|(?<=\n))[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|const|extern(?:\s+\x01)?)\s+)*(?:fn\s+(?P<function>\w+)|struct\s+(?P<struct>\w+)|enum\s+(?P<enum>\w+)|trait\s+(?P<trait>\w+))|(?:^|(?<=\n))[ \t]*(?:unsafe\s+)?impl\b(?:\s*<[^{]*?>)?\s+(?:[^{;]*?\bfor\s+)?(?P<impl>\w+)",
    "javascript": rf"(?:^|(?<=\n))[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<function>[\w$]+)\s*\(|(?:^|(?<=\n))[ \t]*(?:export\s+)?(?:default\s+)?class\s+(?P<class>[\w$]+)|(?:^|(?<=\n))[ \t]+(?:(?:static|async|get|set)\s+)*\*?{_NOT_NAMES}(?P<method>[\w$#]+)\s*\([^(){{}};]*\)\s*\{{",
    "typescript": rf"(?:^|(?<=\n))[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<function>[\w$]+)\s*[<(]|(?:^|(?<=\n))[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<class>[\w$]+)|(?:^|(?<=\n))[ \t]*(?:export\s+)?interface\s+(?P<interface>[\w$]+)|(?:^|(?<=\n))[ \t]*(?:export\s+)?type\s+(?P<type>[\w$]+)[^=\n]*=|(?:^|(?<=\n))[ \t]+(?:(?:public|private|protected|static|async|get|set|readonly|abstract|override)\s+)*{_NOT_NAMES}(?P<method>[\w$#]+)\s*\([^(){{}};]*\)\s*(?::[^{{;()=]*)?\{{",
    "java": rf"(?:^|(?<=\n))[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|sealed|strictfp)\s+)*(?:class\s+(?P<class>\w+)|interface\s+(?P<interface>\w+)|enum\s+(?P<enum>\w+))|(?:^|(?<=\n))[ \t]+(?:(?:public|private|protected)\s+)?{_NOT_NAMES}(?P<constructor>[A-Z]\w*)\s*\([^(){{}};]*\)\s*(?:throws[^{{;]*)?\{{|(?:^|(?<=\n))[ \t]+(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^{{;()]*>\s*)?{_NOT_NAMES}[A-Za-z_][\w<>\[\], .?]*\s+{_NOT_NAMES}(?P<method>\w+)\s*\([^(){{}};]*\)\s*(?:throws[^{{;]*)?[{{;]",
    "c": rf"(?:^|(?<=\n))(?:static\s+|inline\s+|extern\s+|const\s+)*{_NOT_NAMES}[\w]+(?:[ \t]+[\w]+)*[ \t*]+\**{_NOT_NAMES}(?P<function>\w+)\s*\([^(){{}};]*\)\s*\{{|(?:^|(?<=\n))[ \t]*(?:typedef\s+)?struct\s+(?P<struct>\w+)\s*\{{",
    "cpp": rf"(?:^|(?<=\n))[ \t]*(?:template\s*<[^{{;]*>\s*)?(?:(?:static|inline|virtual|explicit|constexpr|const|friend)\s+)*(?:{_NOT_NAMES}[\w:<>,]+(?:[ \t]+[\w:<>,]+)*[ \t*&]+)?[*&]*{_NOT_NAMES}(?P<function>~?[\w:]+)\s*\([^(){{}};]*\)\s*(?:const|noexcept|override|final|\s)*(?::[^{{;]*)?\{{|(?:^|(?<=\n))[ \t]*(?:template\s*<[^{{;]*>\s*)?class\s+(?P<class>\w+)[^;{{]*\{{|(?:^|(?<=\n))[ \t]*struct\s+(?P<struct>\w+)[^;{{]*\{{",
}
HEADS = {k: re.compile(v, re.M) for k, v in _HEADS.items()}
_COMMENT_ABOVE = re.compile(r"(?:[ \t]*(?://[^\n]*|#(?!\[)[^\n]*)\n|[ \t]*/\*(?:[^*]|\*(?!/))*\*/[ \t]*\n)+\Z")
_SPACES = re.compile(r"\s+")


def signature_of(head: str) -> str:
    """A definition's text before its body, on one line and without the bracket that opens the body."""
    return _SPACES.sub(" ", head.strip().rstrip("{(:").strip())


def _python(text: str) -> list[tuple]:
    lines = text.split("\n")
    out: list[tuple] = []

    def visit(node: ast.AST, container: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            kind = "class" if isinstance(child, ast.ClassDef) else "function" if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)) else None
            if kind:
                a, b = child.lineno, child.end_lineno
                body = "\n".join([lines[a - 1].encode()[child.col_offset :].decode(), *lines[a:b]])
                first = child.body[0]
                head = "\n".join(lines[a - 1 : first.lineno - 1]) if first.lineno > a else lines[a - 1].encode()[: first.col_offset].decode()
                head = re.sub(r"\s+#[^\n]*$", "", head, flags=re.M)
                out.append((child.name, "method" if kind == "function" and container in CLASS_LIKE else kind, signature_of(head), ast.get_docstring(child, clean=True) or "", body, a, b))
                visit(child, kind if kind == "class" else container)
            else:
                visit(child, container)

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        visit(ast.parse(text), None)
    return out


def _braces(text: str, language: str) -> list[tuple]:
    blank = _BLANK.get(language, _BLANK["default"]).sub(lambda m: re.sub(r"[^\n]", "\x01", m.group()), text)
    closes: dict[int, int] = {}
    stack: list[int] = []
    for m in re.finditer(r"[{}]", blank):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            closes[stack.pop()] = m.start()
    found: list[tuple[int, int, str, str, int]] = []
    for m in HEADS[language].finditer(blank):
        kind, name = next((k, v) for k, v in m.groupdict().items() if v)
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        stop = re.compile(r"[;{]" if language != "go" else r"[{\n]").search(blank, m.end() - 1)
        opens = stop.start() if stop else -1
        if opens >= 0 and blank[opens] == "{" and opens in closes:
            end = closes[opens] + 1
        elif opens >= 0 and blank[opens] in ";\n" and kind in ("type", "method", "struct"):
            end = opens + (blank[opens] == ";")
        else:
            continue
        found.append((start, end, kind, name.split("::")[-1], opens if blank[opens] == "{" else end))
    out = []
    for k, (start, end, kind, name, body_at) in enumerate(found):
        container = next((x[2] for x in reversed(found[:k]) if x[0] < start and x[1] >= end and x[2] not in ("function", "method", "constructor")), None)
        if kind == "function" and container in CLASS_LIKE:
            kind = "method"
        above = _COMMENT_ABOVE.search(text[: text.rfind("\n", 0, start) + 1])
        out.append((name, kind, signature_of(text[start:body_at]), above.group().rstrip("\n") if above else "", text[start:end], text.count("\n", 0, start) + 1, text.count("\n", 0, end) + 1))
    return out


def parse_text(path: str, text: str, language: str | None) -> list[tuple]:
    """(symbol_name, symbol_type, signature, docstring, body, start_line, end_line) of all definitions in ``text``, outer ones
    first; the whole file as one symbol if there is none or the text can't be parsed."""
    try:
        found = _python(text) if language == "python" else _braces(text, language) if language in HEADS else []
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        found = []
    return found or [(path, "file", "", "", text, 1, text.count("\n") + 1)]


def parse_files(files: DataFrame) -> DataFrame:
    """Rows of PARSED for files (path, content), ``pos`` in the order of the definitions. Null paths or contents give none;
    the language is that of the path's suffix. Files are independent of each other and are read whole."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, text, language in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows += [(path, *r, language, n) for n, r in enumerate(parse_text(path, text, language))]
            types = [*[pa.string()] * 6, pa.int32(), pa.int32(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [()] * 10, types)], [x.split()[0] for x in PARSED.split(", ")])

    kept = files.where("path is not null and content is not null").select("path", "content", language_of(F.col("path")).alias("language"))
    return spread(kept).mapInArrow(work, PARSED)


IMPORT = r"(?m)^[ \t]*(?:from[ \t]+[\w.]+[ \t]+import[ \t]+([^\n#(]+)|import[ \t]+(?:type[ \t]+)?\{([^}]*)\}|use[ \t]+[\w:]*\{?([^;{}]*)\}?;|import[ \t]+(?:static[ \t]+)?[\w.]*\.(\w+);|import[ \t]+([\w., ]+)$)"


def imported_names(text: str = "body"):  # noqa: ANN201
    """The different identifiers that the import lines of a text name."""
    parts = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(IMPORT), n) for n in range(1, 6)]))
    return F.array_distinct(F.regexp_extract_all(F.array_join(parts, " "), F.lit(r"[A-Za-z_]\w*"), 0))
