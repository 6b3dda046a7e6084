"""Problem 5: files that are not syntactically valid in their language.

A lexer for each language splits a text into code, literals and comments; a pushdown stack holds its open brackets. Found
are unterminated literals and comments, unbalanced delimiters, premature ends, and merge-conflict markers, patch headers and
template placeholders outside of literals. What is left of the code after literals and comments are blanked is searched for
neighbours that no grammar of the language allows: words of prose in a row, statements without what they must begin with or
end in, and declarations of another language. Python's lexer keeps a second stack, of its blocks; see ``p5_python``.

It is one map stage; repeated rows and the rates per repository and language are settled among its small results.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import language_column, map_arrow
from tessera.llm.p5_python import python_fault
from tessera.session import spread, table

CLOSER = {"(": ")", "[": "]", "{": "}"}
OUT = "file_id long, repo_id string, path string, language string, reason string"

_LINE = r"//[^\n]*"
_C_LINE = r"//(?:[^\n\\]|\\.)*"
_BLOCK = r"/\*.*?\*/"
_DQ = r'"(?:[^"\\\n]|\\.)*"'
_SQ = r"'(?:[^'\\\n]|\\.)*'"
_OPEN = r"/\*|[\"'`]"
#: To the end of its logical line; comments in it are part of it.
_DIRECTIVE = r"(?P<d>(?:^|(?<=\n))[ \t]*#(?:[^\n\\/]|\\.|/\*(?:[^*]|\*(?!/))*\*/|/(?![*/]))*)"
_BRACKET = r"[(){}\[\]]"


def _lexer(*parts: str) -> re.Pattern[str]:
    """One pattern of named groups: c comment, s literal, d directive, x what begins a literal or comment that doesn't end,
    b bracket, t start of a template, r what may be a regular expression."""
    return re.compile("|".join(parts), re.S)


LEXERS = {
    "go": _lexer(rf"(?P<c>{_LINE}|{_BLOCK})", rf"(?P<s>{_DQ}|`[^`]*`|'(?:[^'\\\n]|\\.[^'\n]*)')", rf"(?P<x>{_OPEN})", rf"(?P<b>{_BRACKET})"),
    "java": _lexer(rf"(?P<c>{_LINE}|{_BLOCK})", rf'(?P<s>"""(?:[^\\]|\\.)*?"""|{_DQ}|\'(?:[^\'\\\n]|\\[^\n][0-9a-fA-F]*)\')', rf"(?P<x>{_OPEN})", rf"(?P<b>{_BRACKET})"),
    "rust": _lexer(rf"(?P<c>{_LINE})", r'(?P<s>\b(?:b|c)?r(?P<h>#*)".*?"(?P=h)|"(?:[^"\\]|\\.)*"|\'(?:[^\'\\\n]|\\[^\n][^\'\n]*)\')', r"(?P<l>'[A-Za-z_]\w*)", rf"(?P<x>{_OPEN})", rf"(?P<b>{_BRACKET})"),
    "c": _lexer(rf"(?P<c>{_C_LINE}|{_BLOCK})", _DIRECTIVE, rf"(?P<n>\b\d[\w.]*(?:'\w+)*)", rf"(?P<s>{_DQ}|'(?:[^'\\\n]|\\.[^'\n]*)+')", rf"(?P<x>{_OPEN})", rf"(?P<b>{_BRACKET})"),
    "cpp": _lexer(rf"(?P<c>{_C_LINE}|{_BLOCK})", _DIRECTIVE, r"(?P<n>\b\d[\w.]*(?:'\w+)*)", r'(?P<s>R"(?P<h>[^()\\\s]{0,16})\(.*?\)(?P=h)"|' + _DQ + r"|'(?:[^'\\\n]|\\.[^'\n]*)+')", rf"(?P<x>{_OPEN})", rf"(?P<b>{_BRACKET})"),
    "javascript": _lexer(rf"(?P<c>{_LINE}|{_BLOCK}|(?:^|(?<=\n))#![^\n]*)", rf"(?P<s>{_DQ}|{_SQ})", r"(?P<t>`)", r"(?P<r>/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*)", rf"(?P<x>/\*|[\"'])", rf"(?P<b>{_BRACKET})"),
}
LEXERS["typescript"] = LEXERS["javascript"]
_TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)
_NESTED = re.compile(r"/\*|\*/")
#: A slash after one of these begins a regular expression, not a division.
_BEFORE_REGEX = re.compile(r"(?:^|[=(,:\[!&|?{};+\-*%~^<>]|\b(?:return|typeof|case|in|of|do|else|void|delete|throw|new|await|yield|instanceof))\s*$")

# Lines that tools leave in files, and placeholders of template languages.
_CONFLICT = re.compile(r"^(?:<{7}|>{7}|\|{7})(?: .*)?$|^={7}$", re.M)
_PATCH = re.compile(r"^diff --git a/|^index [0-9a-f]{6,}\.\.[0-9a-f]{6,}|^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@|^(?:---|\+\+\+) [ab]/", re.M)
_PLACEHOLDER = re.compile(r"\{%-?\s|^[ \t]*\{\{-? ?[\w.]+ ?-?\}\}|<%[=-]?\s|\s-?%>", re.M)

_WORD = r"[A-Za-z_$][\w$]*"
# Keywords and words that stand before or after a name in the language's grammar.
KEYWORDS = {
    "javascript": "abstract as async await break case catch class const continue debugger default delete do else enum export extends finally for from function get if import in instanceof let new of return set static super switch this throw try typeof var void while with yield using assert",
    "typescript": "abstract accessor any as asserts async await boolean break case catch class const continue debugger declare default delete do else enum export extends finally for from function get global if implements import in infer instanceof interface is keyof let module namespace never new null number object of out override package private protected public readonly require return satisfies set static string super switch symbol this throw try type typeof undefined unique unknown using var void while with yield assert",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new non package permits private protected public record return sealed short static strictfp super switch synchronized this throw throws transient try var void volatile when while yield module requires exports opens uses provides to with open",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "rust": "as async await break const continue crate default dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self static struct super trait type union unsafe use where while yield auto raw macro_rules safe gen",
    "c": "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while bool _Bool _Atomic _Noreturn _Static_assert _Thread_local typeof asm defined",
    "cpp": "alignas alignof and asm auto bool break case catch char class co_await co_return co_yield concept const consteval constexpr constinit const_cast continue decltype default delete do double dynamic_cast else enum explicit export extern false final float for friend goto if import inline int long module mutable namespace new noexcept not operator or override private protected public register reinterpret_cast requires return short signed sizeof static static_assert struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual void volatile wchar_t while",
}
#: Words that begin what stands at the top of a file: all others there are of another language.
_TOP_WORDS = {
    "java": "package import public protected private abstract final static strictfp sealed non class interface enum record module open",
    "rust": "use pub fn struct enum impl trait mod const static type extern unsafe async macro_rules union crate auto default safe gen",
    "go": "package import func const var type",
}
#: Words that begin declarations of other languages and can't begin one in C or C++.
_FOREIGN_TOP = {
    "c": "import export function from def class namespace package use pub fn impl func let var public private protected template using trait mod async elif lambda",
    "cpp": "export function from def package use pub fn impl func let var public private protected trait mod async elif lambda import",
}


def _words(text: str) -> str:
    return "|".join(text.split())


_CODE_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|[^\W\d]\w*|\d[\w.]*|[^\w\s]|\n")
# The signs of words by which rules tell them from other keywords ("k"); the type names are Java's.
_SIGN_OF = {w: s for s, words in {"r": "return throw break continue goto", "c": "if while switch", "e": "else", "O": "operator"}.items() for w in words.split()}
_JAVA_TYPES = set("int long short byte char float double boolean".split())


class _Signs(dict):
    """The sign of each token of blanked code: n name, u name in other letters, M macro, 0 number, s literal, k keyword, t type,
    those of _SIGN_OF, or the character itself. A text's signs are its shape, in which neighbours stand side by side."""

    def __init__(self, language: str) -> None:
        self.language, self.keywords = language, set(KEYWORDS[language].split())

    def __missing__(self, token: str) -> str:
        first = token[0]
        if token in self.keywords:
            sign = "t" if self.language == "java" and token in _JAVA_TYPES else _SIGN_OF.get(token, "k")
        elif first.isdigit():
            sign = "0"
        elif first.isalpha() or first in "_$":
            macro = self.language in ("c", "cpp") and re.fullmatch("[A-Z][A-Z0-9_]*", token)  # which may stand for anything
            sign = "M" if macro else "n" if first.isascii() else "u"
        else:
            sign = {"\x01": "s", "\x02": "'"}.get(first, first)
        if len(self) > 1 << 18:
            self.clear()
        self[token] = sign
        return sign


def _shape_rules(language: str) -> list[tuple[str, re.Pattern[str]]]:
    """Neighbours that the language's grammar doesn't allow, to be searched for in the shape of blanked code."""
    row = {"javascript": 2, "typescript": 2, "java": 3, "go": 3, "rust": 2, "c": 4, "cpp": 4}[language]
    out = [
        ("words in a row", rf"n{{{row}}}(?<![.@#'].{{{row}}})" + (r"(?![!(])" if language in ("c", "cpp") else "(?!!)")),
        ("operands in a row", r"[n0]0(?<!\...)" + ("" if language == "cpp" else r"|0n(?<!\...)")),
        # before what closes or ends, at the start of what opens, and one after another
        ("operand missing", r"[-=+%^/](?=\n*[;)\]}])(?<![=!<>.\[(*+/%&|^-]=)(?<!\+\+)(?<!--)(?<!//)" + (r"(?<![O(].)" if language == "cpp" else "")),
        ("operand missing", r"[(\[=]\n*(?:[%^]|/(?![a-zM0u(*&\[]))\n*[a-zM0u(]"),
    ]
    if language in ("javascript", "typescript", "java"):
        out += [("operand missing", r"[-+/%^][*%^]|[(\[=][*%/^][a-z0u]")]
    if language in ("javascript", "typescript", "java", "c", "cpp"):
        out += [("operand missing", r"c\n*\(\n*\)(?<!\.c..)")]
    if language in ("java", "c", "cpp"):
        out += [("statement without its end", r"r(?<!\..)[^;{}:]*\}"), ("operand missing", r",\n*;")]
    if language == "java":
        out += [
            ("operand missing", r",\n*[,)]|\(,"),
            ("statement without its end", r"=(?<![=!<>]=)(?!=)[^;{}(),]*\}"),
            ("branch without its statement", r"[a-z0u)\]]\n*e"),
            ("type without a name", r"n\((?<!\.n\()(?:[^()]*,)?\n*t[,)]"),
        ]
    if language == "go":
        out += [("operand missing", r",\n*,|\(,"), ("branch without its statement", r"\n+e|[^}\n]e")]
    return [(why, re.compile(rule)) for why, rule in out]


_SIGNS: dict[str, _Signs] = {}
_SHAPE_RULES: dict[str, list[tuple[str, re.Pattern[str]]]] = {}


def _rules(language: str) -> list[tuple[str, re.Pattern[str]]]:
    """Neighbours that the language's grammar doesn't allow, to be searched for in blanked code."""
    kw = _words(KEYWORDS[language])
    # capitals are macros there, which may stand for anything
    name = rf"(?!(?:{kw})\b){_WORD}" if language not in ("c", "cpp") else rf"(?!(?:{kw}|[A-Z][A-Z0-9_]*)\b){_WORD}"
    out = []
    if language in ("javascript", "typescript", "java", "c", "cpp"):
        out.append(("statement without its bracket", r"(?<![\w$.#@])(?:if|while|switch|for)\b(?![ \t\n]*(?:\(|constexpr|consteval|!|await\b" + (r"|(?:_?[A-Z][A-Z0-9_]*|\w*likely)[ \t]*\(" if language in ("c", "cpp") else "") + r"))(?![ \t]*[:=,)\]};?.<])"))
    if language in ("javascript", "typescript"):
        out += [
            ("other language", r"(?:^|(?<=\n))(?:static|#\w+|public|private|protected|package|pub|use|def|func|fn|impl)[ \t]+\w+"),
            ("other language", r"(?:^|(?<=\n))#\s*\w+"),
            ("other language", rf"\bclass[ \t]+{_WORD}[ \t]*(?:\([^()]*\))?[ \t]*:"),
            ("other language", r"\w::\w"),
            ("other language", rf"(?:^|(?<=\n))import[ \t]+{_WORD}(?:\.{_WORD})*[ \t]*(?:;|\n|$)"),
            ("declaration without a name", r"(?<![\w$.])(?:const|let|var)[ \t]*[=;)]"),
        ]
    if language == "javascript":
        out += [
            ("types in untyped language", rf"\bfunction\b[^(){{}}]*\([^()]*{_WORD}\??[ \t]*:[ \t]*{_WORD}"),
            ("types in untyped language", rf"\bfunction\b[^(){{}}]*\([^()]*\)[ \t]*:[ \t]*{_WORD}"),
            ("types in untyped language", rf"(?:^|(?<=\n))[ \t]+(?:(?:private|public|protected|readonly|static|async)[ \t]+)*(?!(?:if|for|while|switch|catch|return)\b){_WORD}[ \t]*\((?:[ \t]*{_WORD}\??[ \t]*:[ \t]*{_WORD}(?:\[\])*[ \t]*,?)+\)[ \t]*(?::[^{{;\n]*)?\{{"),
            ("types in untyped language", rf"(?<![\w$.])(?:const|let|var)[ \t]+{_WORD}[ \t]*:[ \t]*{_WORD}"),
            ("types in untyped language", rf"(?:^|(?<=\n))(?:export[ \t]+)?(?:interface|type|enum|namespace|declare)[ \t]+{_WORD}[ \t]*[{{=<]"),
            ("types in untyped language", rf"(?:^|(?<=\n))[ \t]+(?:private|public|protected|readonly)[ \t]+{_WORD}"),
        ]
    if language == "go":
        out += [
            ("other language", r"(?<![\w.])(?:while|public|private|class|def|let|try|catch)[ \t]+\w"),
            ("statement without its block", r"(?:^|(?<=\n))[ \t]*(?:if|for|func)\b[^\n{};]*\n[ \t]*(?!\{)(?:[A-Za-z_]\w*[ \t]*(?::?=|\()|return\b|\})"),
        ]
    if language == "rust":
        out += [
            ("other language", rf"(?<![\w.])const[ \t]+(?!fn\b|unsafe\b|async\b|extern\b){_WORD}[ \t]*[=;\[]"),
            ("other language", rf"(?<![\w.'])static[ \t]+(?!mut\b|ref\b|move\b){_WORD}[ \t]+(?!:)"),
            ("other language", rf"(?<![\w.])fn[ \t]+{_WORD}[^(){{}};]*\((?:[^():]*[A-Za-z_]\w*[ \t]+[A-Za-z_]\w*)[^():]*\)"),
        ]
    if language in ("c", "cpp"):
        out += [
            ("other language", rf"(?:^|(?<=\n))(?:{_words(_FOREIGN_TOP[language])})[ \t]+[\w{{*.\"\x01]"),
            ("other language", r"===|!==|(?<!<)=>|:="),
        ]
    if language == "c":
        out.append(("other language", r"::|(?<![\w.])(?:namespace|class|template)(?:[ \t]+\w|[ \t]*<)"))
    if language == "java":
        out += [
            ("other language", rf"(?:^|(?<=\n))import[ \t]+(?!static\b)(?:{_WORD}[ \t]*\.[ \t]*)*(?:{_WORD}|\*)[ \t]*(?!;|[ \t]|[\w.*$])"),
            ("other language", r"(?:^|(?<=\n))#|===|!==|:="),
            ("other language", rf"\bclass[ \t]+{_WORD}[ \t]*(?:\([^()]*\))?[ \t]*:"),
            ("other language", rf"(?<=[{{;}}])\s*(?:function|constructor|let|fn|func|def)\b[ \t]*[\w(]"),
            ("other language", rf"(?:^|(?<=\n))(?:[ \t]{{2}}|\t){_WORD}[ \t]*=(?!=)"),
        ]
    if language in ("java", "c", "cpp", "rust"):
        # a call or an assigned value ends its line and a new statement begins on the next; a macro's call may end without a sign
        macro = "" if language in ("java", "rust") else r"(?!_?[A-Z][A-Z0-9_]*\b|__)"
        out.append(("statement without its end", rf"(?:^|(?<=\n))[ \t]+(?:(?:return|{_WORD}(?:[ \t]+[*&]?{_WORD})*[ \t]*=)[ \t]*)?{macro}(?!(?:if|for|while|switch|catch|else|synchronized|try|match|loop|unsafe|fn|pub|impl)\b){_WORD}(?:[.]{_WORD}|->{_WORD}|::{_WORD})*\([^(){{}}\n]*\)(?:\[[^\]\n]*\])?[ \t]*\n[ \t]*(?!(?:throws|const|noexcept|override|final|where)\b)(?:{_WORD}(?:[ \t]+{_WORD})*[ \t]*(?:=(?!=)|\(|\.|;|\[)|(?:return|if|for|while)\b)" + (r"(?!(?:[^{};]*)\{)" if language == "cpp" else "")))
        if language != "rust":
            out.append(("statement without its end", rf"(?:^|(?<=\n))[ \t]+return\b[^;{{}}()\n]*(?:\([^(){{}};\n]*\))?[^;{{}}()\n,+*/&|=<>?:.-]\n[ \t]*\}}"))
    return [(why, re.compile(rule)) for why, rule in out]


_RULES: dict[str, list[tuple[str, re.Pattern[str]]]] = {}
_DANGLING = re.compile(r"(?:[=+*/%&|^<,.?:~(\[{-]|\b(?:return|import|from|package|const|let|var|func|fn|class|new|if|else|for|while|static|public|private|pub|use|struct|function|extends|implements|export))\s*$")
_DANGLING_OK = re.compile(r"(?:\+\+|--|[*:>?])\s*$")


class Lexed:
    """A text after the lexer: ``code`` with literals and comments blanked, and the first fault, if any."""

    __slots__ = ("code", "fault", "top")

    def __init__(self, text: str, language: str) -> None:
        self.fault: str | None = None
        self.top: list[str] = []  # pieces of code outside of all brackets
        out: list[str] = []
        stack: list[str] = []
        branches: list[list[str]] = []
        lexer = LEXERS[language]
        at = 0
        match = lexer.search
        while True:
            m = match(text, at)
            if not m:
                break
            kind, start, end = m.lastgroup, m.start(), m.end()
            if kind == "h":
                kind = "s"
            out.append(text[at:start])
            if not stack:
                self.top.append(text[at:start])
            at = end
            if kind == "b":
                ch = text[start]
                out.append(ch)
                if ch in CLOSER:
                    if not stack:
                        self.top.append(ch)
                    stack.append(ch)
                elif not stack:
                    self.fault = "unbalanced delimiter"
                    break
                elif stack[-1] == "`":
                    # the end of a template's inner code: back into the template
                    stack.pop()
                    at = self._template(text, at, stack, out)
                    if at < 0:
                        return self._done(out, "unterminated literal")
                elif CLOSER[stack[-1]] != ch:
                    self.fault = "unbalanced delimiter"
                    break
                else:
                    stack.pop()
                    if not stack:
                        self.top.append(ch)
            elif kind in ("s", "n"):
                out.append("\x01" if kind == "s" else "0")
                if kind == "s" and not stack:
                    self.top.append("\x01")
                if kind == "s" and "\n" in m.group():
                    out.append(" ")
            elif kind == "c":
                out.append("\n" if "\n" in m.group() else " ")
            elif kind == "l":
                out.append("\x02")
            elif kind == "d":
                word = re.match(r"\s*#\s*(\w*)", m.group()).group(1)
                if word in ("if", "ifdef", "ifndef"):
                    branches.append(stack.copy())
                elif word in ("else", "elif", "elifdef", "elifndef") and branches:
                    stack = branches[-1].copy()
                elif word == "endif" and branches:
                    branches.pop()
            elif kind == "t":
                at = self._template(text, at, stack, out)
                if at < 0:
                    return self._done(out, "unterminated literal")
            elif kind == "r":
                before = "".join(out[-6:])[-40:] if out else ""
                if _BEFORE_REGEX.search(before) or not before.strip():
                    out.append("\x01")
                else:  # a division: only the slash is read
                    out.append("/")
                    at = start + 1
            elif kind == "x":
                if text[start] == "/" and language == "rust":
                    at = self._nested(text, start)
                    if at > 0:
                        out.append(" ")
                        continue
                return self._done(out, "unterminated comment" if text[start] == "/" else "unterminated literal")
        if self.fault is None:
            out.append(text[at:])
            if not stack:
                self.top.append(text[at:])
            else:
                self.fault = "premature end"
        self.code = "".join(out)

    def _done(self, out: list[str], fault: str) -> None:
        self.fault, self.code = fault, "".join(out)

    @staticmethod
    def _template(text: str, at: int, stack: list[str], out: list[str]) -> int:
        """Reads a template literal from ``at``; where code goes on, or -1 if it doesn't end."""
        while True:
            m = _TEMPLATE.search(text, at)
            if not m:
                return -1
            at = m.end()
            if m.group() == "`":
                out.append("\x01")
                return at
            if m.group() == "${":
                stack.append("`")
                out.append("\x01+(")
                return at

    @staticmethod
    def _nested(text: str, at: int) -> int:
        depth = 0
        for m in _NESTED.finditer(text, at):
            depth += 1 if m.group() == "/*" else -1
            if not depth:
                return m.end()
        return -1


def fault(text: str, language: str) -> str | None:
    """Why ``text`` isn't valid in ``language``, or None. Languages without a lexer have no faults."""
    if language not in LEXERS and language != "python" or not text.strip():
        return None
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = text.removeprefix("\ufeff")
    if language == "python":
        found = python_fault(text)
        return found and ("conflict marker" if _CONFLICT.search(text) else "patch" if _PATCH.search(text) else found)
    lexed = Lexed(text, language)
    found = lexed.fault
    code = lexed.code
    marked = _CONFLICT.search(text) or _PATCH.search(text)
    if marked and (_CONFLICT.search(code) or found):
        found = "conflict marker"
    elif marked and _PATCH.search(code):
        found = "patch"
    if found:
        return found
    if _PLACEHOLDER.search(code):
        return "template placeholder"
    body = code.rstrip()
    if _DANGLING.search(body) and not (_DANGLING_OK.search(body) and not body.endswith(("::", "="))):
        return "premature end"
    top = "".join(lexed.top)
    begins = _top_fault(top, language)
    if begins:
        return begins
    if language not in _RULES:
        _RULES[language], _SHAPE_RULES[language], _SIGNS[language] = _rules(language), _shape_rules(language), _Signs(language)
    shape = "".join(map(_SIGNS[language].__getitem__, _CODE_TOKEN.findall(code)))
    for why, rule in _SHAPE_RULES[language]:
        if rule.search(shape):
            return why
    for why, rule in _RULES[language]:
        if rule.search(code):
            return why
    return None


_STATEMENT = {
    "java": re.compile(r"(?:^|[;}])\s*([^\s;}@]\w*)"),
    "go": re.compile(r"(?:^|\n)[ \t]*([A-Za-z_]\w*|[^\s;)}\]{(\[])"),
    "rust": re.compile(r"(?:^|[;}])\s*([^\s;}#!]\w*)"),
}
_TYPE_WORD = re.compile(r"\b(?:class|interface|enum|record|module)\b|@interface")


def _top_fault(top: str, language: str) -> str | None:
    """Whether something stands at the top of the file that the language doesn't allow there."""
    if language == "go":
        m = re.match(r"\s*package[ \t]+[A-Za-z_]\w*[ \t]*(?:;|\n|$)", top)
        if not m:
            return "other language"
    if language in _STATEMENT:
        allowed = set(_TOP_WORDS[language].split())
        clean = re.sub(r"@\w+(?:\.\w+)*(?:\s*\(\))?", " ", top) if language == "java" else re.sub(r"#!?\s*\[\]", " ", top) if language == "rust" else top
        for m in _STATEMENT[language].finditer(clean):
            word = m.group(1)
            if word not in allowed and not (language == "rust" and re.match(r"\w+\s*(?:::\s*\w+\s*)*!", clean[m.start(1) :])):
                return "other language"
        if language == "java":
            for piece in re.findall(r"(?:^|[;}])([^;{}]*)\{", clean):
                if not _TYPE_WORD.search(piece):
                    return "other language"
    return None


def check_files(files: DataFrame) -> DataFrame:
    """Rows (file_id, repo_id, path, language, reason) for every row of ``files`` that has content; reason is null if it is valid.

    The language is the row's, in any known spelling, else that of the path's suffix; a file in no known language is valid.
    Null or blank content gives no row. A null file_id gives no row. Repeated rows are kept here and counted once by what
    follows. Texts are read whole. An empty table gives an empty result.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, languages = batch.column(4).to_pylist(), batch.column(3).to_pylist()
        reasons = [fault(t, k) if k else None for t, k in zip(texts, languages)]
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(reasons, pa.string())], ["file_id", "repo_id", "path", "language", "reason"])

    rows = files.select(
        F.col("file_id").cast("long").alias("file_id"), F.col("repo_id").cast("string").alias("repo_id"), F.col("path").cast("string").alias("path"),
        language_column(F.col("language"), F.col("path")).alias("language"), F.col("content").cast("string").alias("content"),
    )
    rows = spread(rows).where(F.col("file_id").isNotNull() & F.col("content").rlike(r"\S"))
    return map_arrow(rows, work, OUT, "content")


def invalid_files(files: DataFrame) -> DataFrame:
    """Rows (file_id, reason), one for each file with an invalid row."""
    return check_files(files).where("reason is not null").groupBy("file_id").agg(F.min("reason").alias("reason"))


def invalid_rates(files: DataFrame, meta: DataFrame) -> DataFrame:
    """Per repository and language: files, invalid files, their rate, and how many of the invalid ones gave chunks nevertheless.

    ``meta`` has repo_id, path and num_chunks; its repeated rows count once and its largest num_chunks counts.
    """
    one = check_files(files).groupBy("file_id", "repo_id", "path", "language").agg(F.max(F.col("reason").isNotNull().cast("int")).alias("invalid"))
    chunks = meta.groupBy("repo_id", "path").agg(F.max("num_chunks").alias("num_chunks"))
    joined = one.join(chunks, ["repo_id", "path"], "left")
    return joined.groupBy("repo_id", "language").agg(
        F.count("*").alias("files"), F.sum("invalid").alias("invalid"), F.round(F.avg("invalid"), 6).alias("rate"), F.count_if((F.col("invalid") == 1) & (F.col("num_chunks") > 0)).alias("invalid_with_chunks")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_files(table(spark, sf_dir, "walked_files")).select("file_id")


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_rates(table(spark, sf_dir, "walked_files"), table(spark, sf_dir, "files"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p5_found": p5_found, "p5_rates": p5_rates}
SQL: dict[str, str] = {}
