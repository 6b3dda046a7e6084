"""Problem 1: files that nobody wrote by hand in their repository.

``classify_files`` gives, for every row, why a file is not hand-written source: ``notice`` (the file says that a tool
emitted it), ``upstream`` (the file says that it is a copy of a project), ``vendored`` and ``generated_path`` (the path holds
such files by convention), ``minified``, ``data`` and ``mechanical`` (the shape of the content). One Aho-Corasick automaton over all cue
words reads each text once; only comments that hold a cue are looked at closer, by a small grammar of what a file says of itself
(this file, was made, by a tool, at a version). It is one map stage without a shuffle of contents: repeated rows are dropped among the results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow
from tessera.session import spread, table

# Words (lower case) one of which any statement about a file's origin holds.
GENERATED_CUES = [
    "generated", "autogen", "auto-gen", "produced", "created", "emitted", "written", "machine", "made by", "built by", "compiled", "derived", "translated", "transpiled",
    "rendered", "do not", "don't", "must not", "never edit", "hands off", "overwritten", "will be lost", "erzeugt", "generiert", "erstellt", "généré", "produit", "créé",
    "generad", "creado", "gerad", "criado", "generato", "prodotto", "creato", "wygenerowan", "utworzon", "сгенерирован", "создан", "自動生成", "自动生成", "生成", "생성", "object code from",
]
UPSTREAM_CUES = [
    "upstream", "bundled copy", "vendored", "copied from", "copied verbatim", "taken from", "third-party", "third party",
    "authors", "contributors", "licence", "license", "mirror of", "fork of", "/*!", " v",
]

#: Comment marks before and after the words of a whole-line comment.
COMMENT_LINE = re.compile(r"^\s*(?://[/!]*|#+!?|/\*+!?|\*+(?!/)|--|;+|%+|<!--|\"\"\"|''')\s*(?:!\s*)?(.*?)\s*(?:\*/|-->|\"\"\"|''')?\s*$")
VERSION = r"v?\d+(?:\.\d+)+[\w.+-]*"
# The words of a notice's grammar: what a file is called, what a tool does to it, and how or by what.
_THIS = r"(?:(?:this|diese[rs]?|ce(?:tte)?|est[ea]|quest[oa]|ten|ta|этот|данный)\s+|この|本|此|该|이\s*)"
_FILE = (
    r"(?:(?:source|code|header|class|python|java|c|meta\s+object|lexical|model|client)\s+)?(?:files?|sources?|code|modules?|headers?|scripts?|class(?:es)?|contents?|documents?|parsers?|lexers?|scanners?|bindings?|stubs?|form"
    r"|datei|quelltext|fichier|archivo|fichero|ficheiro|arquivo|código|sorgente|plik|kod|файл|код)\b|ファイル|コード|文件|代码|檔案|파일|코드"
)
_DONE = (
    r"(?:(?:generated|produced|emitted|derived|translated|transpiled|rendered|autogenerated|auto-generated|erzeugt|generiert|erstellt|généré|produit|créé|generad[oa]|cread[oa]|gerad[oa]|criad[oa]"
    r"|generat[oa]|prodott[oa]|creat[oa]|wygenerowan[yoae]|utworzon[yoae]|сгенерирован[ао]?|создан[ао]?)(?!\w)|自動生成|自动生成|生成|생성)"
)
_AUTO = r"(?:auto(?:matically|matisch|matiquement|máticamente|maticamente|maticamente|matycznie|mated)?(?!\w)|автоматически|自動|自动|자동)"
_BY = r"(?:(?:by|from|with|using|via|von|aus|mit|durch|par|à\s+partir|avec|por|desde|con|da|dal|przez|z|из|с\s+помощью)(?!\w)|から|により|によって|由|从|에\s*의해)"
_HANDS_OFF = r"(?:do\s+not|don't|must\s+not|never|please\s+do\s+not)\s+(?:be\s+)?(?:edit(?:ed)?|modify|modified|touch(?:ed)?|change[d]?|alter(?:ed)?)\b|hands\s+off"
_OVERWRITTEN = r"(?:changes|edits|modifications)\b.{0,60}\b(?:lost|overwritten|discarded|undone)\b"
_IS = r"(?:\s*(?:was|is|are|were|has\s+been|have\s+been|wurde|ist|wird|a\s+été|est|ha\s+sido|fue|es|foi|é|è\s+stat[oa]|è|został|jest|был|はツール|は|이|가|是))?"
_TOOL = r"(?:the\s+)?['\"]?[\w@/][^\s,;]*(?:\s+(?!(?:is|are|was|and|so|when|if|which|that|below|above|here)\b)[\w(@/:.+#-][^\s,;]*){0,4}?"
#: What can follow a tool's name: its version or a date, the end of the sentence, or what not to do.
_VERSION = rf"[\s,(]+(?:version\s+)?(?:{VERSION}|(?<=version\s)\d+)"
_SIGNED = rf"(?:{_VERSION}|\s+(?:on|at|from|in|by|using|with)\s+\S|\s*\(|\s*[.;,!—–-]*\s*(?:$|(?:source\s*:|https?:|{_HANDS_OFF})))"
NOTICE = re.compile(
    rf"""^(?:note\s*:\s*|warning\s*:\s*|\W+)?(?:
      @generated\b
    | <auto-?generated\s*/?>
    | (?:{_THIS}(?:{_FILE}){_IS}|(?:{_FILE}))\s*(?:{_AUTO}[\s-]*)?{_DONE}(?!\s*(?:code|files?|stubs?|client|types?)\b).*?(?:{_AUTO}|{_BY})
    | {_THIS}(?:{_FILE}){_IS}\s*(?:.{{0,40}}?[\s,])?{_AUTO}[\s-]*(?:\w+\s+){{0,3}}?(?:{_DONE}|created|written|built|compiled|made)
    | {_THIS}(?:{_FILE}){_IS}\s*(?:created|written|built|compiled|made)\s+{_AUTO}
    | {_THIS}(?:{_FILE}){_IS}\s*{_DONE}\s*(?:[.;,!—–-]|$)
    | {_THIS}(?:{_FILE}).{{0,60}}?(?:{_BY}).{{0,40}}?(?:生成|생성|自動|{_DONE})
    | (?:auto(?:matically|matic)?|machine)[\s-]*(?:generated|made|written|produced|created)\s+(?:{_BY}\s|(?:file|code|source)\b)(?!.*\b(?:stubs?|method)\b)
    | (?:generated|emitted)\s+(?:automatically\s+)?(?:by|using|with|via):?\s+{_TOOL}{_SIGNED}
    | (?:produced|created|built|compiled|rendered|translated)\s+(?:automatically\s+)?(?:by|using|with|via):?\s+{_TOOL}{_VERSION}
    | (?:generated|produced|created|derived|translated|compiled|rendered)\s+(?:automatically\s+)?from\s+\S+\.\w+
    | (?:an?\s+)?(?:\w+\s+){{0,3}}?(?:{_FILE}),?\s+(?:made|generated|produced|created|from\s+reading)\s+(?:by\s+|from\s+)?{_TOOL}{_SIGNED}
    | (?:\w+\s+)?generated\s+(?:code|file|source|content)s?\b\W*(?:{_HANDS_OFF})
    | (?:{_HANDS_OFF})(?:\s+(?:this\s+file|by\s+hand|manually|it))*\s*[.!:;-]*\s*$
    | (?:{_HANDS_OFF})\b.*\b(?:this\s+file\s+(?:is|was)|generated\s+(?:by|from|automatically))\b
    | (?:any|all|manual|your|local)\s+(?:manual\s+)?{_OVERWRITTEN}
    )""",
    re.I | re.X,
)
UPSTREAM = re.compile(
    rf"""^(?:
      (?:imported|vendored|copied|taken|mirrored|synced|extracted)\s+(?:verbatim\s+)?from\s+(?:upstream\s+)?\S+.*(?:\b{VERSION}|https?://|\btag\b|\bcommit\b|\brev(?:ision)?\b)
    | (?:bundled|vendored|verbatim|local|unmodified|embedded)\s+copy\s+of\s+\S+
    | (?:fork|mirror|snapshot)\s+of\s+(?:upstream\s+)?\S+\s.*(?:{VERSION}|https?://)
    | (?:[@\w][\w./@-]*)\s+{VERSION}\s*\|?\s*\(c\)\s.*\b(?:contributors|authors)\b
    )""",
    re.I | re.X,
)
#: "<library> <version>" as all of a line: a statement of origin together with a licence or authors in the next lines, or after "!".
NAME_VERSION = re.compile(rf"^([A-Za-z@][\w./@-]*)\s+{VERSION}$")
BANNER = re.compile(rf"^\s*/\*!\s*[@\w][\w./@-]*\s+{VERSION}")
OF_AUTHORS = re.compile(r"\b(?:authors|contributors)\b|\breleased\s+under\b|\blicen[cs]ed?\b|\(c\)", re.I)

# Directories and file names that by convention hold foreign or emitted files.
VENDOR_DIRS = {"third_party", "third-party", "thirdparty", "3rdparty", "node_modules", "bower_components", "jspm_packages", "site-packages", "dist-packages", "_vendor", "vendored", "godeps", "extern", "external", "externals", "deps", "carthage", "pods"}
#: These words also name ordinary parts of a product, so they count only at the root or under a folder of served files.
ROOT_VENDOR_DIRS = {"vendor"}
SERVED_DIRS = {"public", "assets", "static", "web", "js", "javascripts", "wwwroot", "src", "lib"}
EMITTED_DIRS = {"__generated__", "generated", "autogen", "__autogen__", "gen-src", "generated-sources", ".next", ".nuxt"}
EMITTED_PAIRS = {("build", "gen"), ("build", "generated"), ("target", "generated-sources"), ("target", "generated")}
EMITTED_NAME = re.compile(r"(?:_pb2(?:_grpc)?\.pyi?|[._]pb(?:\.gw|-c|\.validate)?\.(?:go|cc|h|c|js|ts|hpp|cxx|cpp|rs|mjs|cjs|py)|(?:Grpc|OuterClass)\.java|[._](?:gen|generated|g|autogen)\.\w+|_string\.go|\.(?:tab|yy|lex)\.(?:c|h|cc|cpp|hpp)|^moc_\w+\.\w+|\.designer\.\w+)$")
MINIFIED_NAME = re.compile(r"[.-]min\.(?:js|mjs|cjs|css|jsx|ts)$|\.(?:bundle|chunk)\.(?:js|mjs|cjs)$|\b(?:bundle|chunk|main|vendor|runtime|app)\w*\.[0-9a-f]{8,20}\.(?:js|mjs|cjs)$")
LOCK_NAME = re.compile(r"^(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|pipfile\.lock|cargo\.lock|go\.sum|composer\.lock|gemfile\.lock)$", re.I)

#: A line of nothing but literals, as in a table or a blob stored as code.
DATA_LINE = re.compile(
    r"""^[ \t]*(?:
        (?:[-+]?(?:0[xX][0-9a-fA-F]+|\d+\.?\d*(?:[eE][-+]?\d+)?)[uUlLfF]*|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
        (?:[ \t]*[,+|][ \t]*(?:[-+]?(?:0[xX][0-9a-fA-F]+|\d+\.?\d*(?:[eE][-+]?\d+)?)[uUlLfF]*|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'))*
        [ \t]*[,;+\\]*[)\]}]*;?
      | [A-Za-z0-9+/]{44,}={0,2}(?:\\n)?["'`]*[,;)]*
    )[ \t]*$""",
    re.X | re.M,
)
#: Characters of literals at the least that make a file data; fewer are a short table.
DATA_LEAST = 72
_WORD_SPACE = re.compile(r"[ \t\n]")

OUT = "file_id long, reasons array<string>"


def path_reasons(path: str | None) -> list[str]:
    """What the path alone says."""
    if not path:
        return []
    *dirs, name = path.split("/")
    low = [d.lower() for d in dirs]
    out = []
    for n, d in enumerate(low):
        if d in VENDOR_DIRS or (d in ROOT_VENDOR_DIRS and (n == 0 or all(x in SERVED_DIRS for x in low[:n]))):
            out.append("vendored")
            break
    if LOCK_NAME.match(name) or EMITTED_NAME.search(name) or EMITTED_DIRS.intersection(low) or any(p in EMITTED_PAIRS for p in zip(low, low[1:])):
        out.append("generated_path")
    if MINIFIED_NAME.search(name):
        out.append("minified")
    return out


#: A line that gives a number to a name that ends in the same number.
_NUMBERED = re.compile(r"^[^\n=]*?(\d+)\b[^=\n\d]*=[ \t]*(\d+)\b", re.M)
_NAME, _DIGITS = re.compile(r"[A-Za-z_]\w*"), re.compile(r"\d+")
_LITERALS = re.compile(r'"(?:[^"\\]|\\.)*"|[A-Za-z0-9+/=]{80,}|(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d+)\s*,')
#: Members of a numbered series, and the part of the lines that are alike, of what only a tool writes out.
SERIES, ALIKE, REPEATS = 16, 0.6, 8


def mechanical(text: str) -> bool:
    """Whether a long series of names numbered without a gap is written out, and most lines are alike but for their names."""
    want = longest = 1
    for m in _NUMBERED.finditer(text):
        n = int(m[1])
        if m[1] == m[2]:
            want = n + 1 if n == want else 2 if n == 1 else want
            longest = max(longest, want)
    if longest <= SERIES:
        return False
    shapes = [_NAME.sub("w", _DIGITS.sub("0", x)) for x in map(str.strip, text.split("\n")) if len(x) > 3]
    return sum(n for n in Counter(shapes).values() if n >= REPEATS) >= ALIKE * len(shapes)


def shape_reasons(text: str) -> list[str]:
    """What the shape of the content says: ``minified`` (long dense lines of code), ``data`` (nearly all of it literals) or
    ``mechanical`` (a numbered series written out)."""
    n = len(text)
    out: list[str] = []
    data = sum(m.end() - m.start() for m in DATA_LINE.finditer(text))
    if data >= 0.6 * n and data >= DATA_LEAST:
        return ["data"]
    lines = text.split("\n")
    widest = max(map(len, lines))
    if widest >= 200:
        long = [x for x in lines if len(x) >= 200]
        held = sum(map(len, long))
        if held >= 0.6 * n:
            body = "".join(long)
            # words with blanks between them are a message, not data
            strings = sum(len(m) for m in _LITERALS.findall(body) if m.count(" ") <= 0.05 * len(m))
            if strings >= 0.75 * held:
                out.append("data")
            elif len(_WORD_SPACE.findall(body)) <= 0.14 * held and sum(map(body.count, ";,(){}")) >= 0.06 * held:
                out.append("minified")
    elif mechanical(text):
        out.append("mechanical")
    return out


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in GENERATED_CUES:
        found.add_word(word, (0, word))
    for word in UPSTREAM_CUES:
        found.add_word(word, (1, word))
    found.make_automaton()
    return found


_HEADER = re.compile(r"(?:\s+|//[^\n]*|#(?!\s*(?:include|define|if|pragma)\b)[^\n]*|--[^\n]*|;[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|<!--.*?-->|\"\"\".*?\"\"\"|'{3}.*?'{3})*", re.S)
_CLOSED = re.compile(r"\s*/\*(?:[^*]|\*(?!/))*\*/(?=\s*\S)")


def notice_reasons(text: str, cues: ahocorasick.Automaton) -> list[str]:
    """What the file says of itself, in comment lines that hold a cue; strings and remarks about other files don't count."""
    low = text.lower()
    if len(low) != len(text):  # a few capitals grow in lower case; positions must stay
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out: set[str] = set()
    seen: set[int] = set()
    header = -1  # where the comments at the beginning of the file end
    for end, _ in cues.iter(low):
        start = text.rfind("\n", 0, end) + 1
        if start in seen:
            continue
        seen.add(start)
        stop = text.find("\n", end)
        line = text[start : stop if stop >= 0 else len(text)].rstrip("\r")
        # an indented comment speaks of the code around it, but for those at the file's beginning and the " * " of a block
        if line[:1] in (" ", "\t") and not line.lstrip().startswith("*"):
            header = _HEADER.match(text).end() if header < 0 else header
            if start >= header:
                continue
        closed = _CLOSED.match(line)  # a comment that ends before its line does, as in a bundle
        m = COMMENT_LINE.match(closed.group() if closed else line)
        if not m:
            continue
        said = m.group(1).lstrip("!* ").strip()
        if NOTICE.match(said):
            out.add("notice")
        elif UPSTREAM.match(said) or BANNER.match(line):
            out.add("upstream")
        elif OF_AUTHORS.search(said):
            # "<library> <version>" directly above a line of its authors or licence
            above = text[:start].rstrip("\r\n").rsplit("\n", 2)[-2:]
            for x in above:
                c = COMMENT_LINE.match(x.rstrip("\r"))
                name = c and NAME_VERSION.match(c.group(1).lstrip("!* ").strip())
                if name and name.group(1).lower() not in ("version", "python", "node", "licence", "license", "release"):
                    out.add("upstream")
    return sorted(out)


def classify_files(files: DataFrame) -> DataFrame:
    """Rows (file_id, reasons) for the files that are not hand-written, one for each file_id.

    Reads file_id, path and content; other columns don't matter. Null or empty content is no case and gives no row, nor does
    a null file_id. A null path says nothing. Repeated rows count once: a file is reported with the reasons of all its rows.
    An empty table gives an empty result. Texts of any length are read whole.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        global _CUES
        try:
            cues = _CUES
        except NameError:
            cues = _CUES = _automaton()
        ids, found = [], []
        for i, path, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            why = path_reasons(path) + notice_reasons(text, cues) + shape_reasons(text)
            if why:
                ids.append(i)
                found.append(sorted(set(why)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.string()))], ["file_id", "reasons"])

    rows = files.select(F.col("file_id").cast("long").alias("file_id"), F.col("path").cast("string").alias("path"), F.col("content").cast("string").alias("content"))
    rows = spread(rows).where(F.col("file_id").isNotNull() & F.col("content").rlike(r"\S"))
    found = map_arrow(rows, work, OUT, "content")
    return found.groupBy("file_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"))


def hand_written(files: DataFrame) -> DataFrame:
    """The rows of ``files`` that remain to be parsed: with a file_id and content, and not reported by ``classify_files``."""
    return files.where(F.col("file_id").isNotNull() & F.col("content").rlike(r"\S")).join(classify_files(files).select("file_id"), "file_id", "left_anti")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_files(table(spark, sf_dir, "walked_files")).select("file_id")


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by reason, the report of the operator."""
    return classify_files(table(spark, sf_dir, "walked_files")).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("files"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_reasons": p1_reasons}
SQL: dict[str, str] = {}
