"""Python's part of problem 5: a lexer, a stack of open brackets, a stack of open blocks, and the order of a statement's tokens.

Each logical line becomes a word with one sign for each of its tokens (``n`` name, ``0`` number, ``s`` literal, a sign for each
keyword and operator). Most lines of real code have one of few such shapes, so what the grammar says of a shape is remembered.
"""

from __future__ import annotations

import functools
import re

# The signs of keywords and operators; an operator that isn't listed stands between operands ("o").
KEYWORDS = {
    "if": "I", "elif": "L", "else": "E", "for": "F", "while": "W", "def": "D", "class": "C", "try": "t", "except": "x", "finally": "f", "with": "w",
    "async": "a", "await": "A", "lambda": "l", "return": "r", "yield": "y", "raise": "R", "import": "m", "from": "M", "as": "S", "global": "g",
    "nonlocal": "g", "del": "d", "pass": "p", "break": "p", "continue": "p", "assert": "B", "in": "i", "is": "k", "not": "N", "and": "o", "or": "o",
    "None": "T", "True": "T", "False": "T",
}
OPERATORS = {
    "+": "-", "-": "-", "~": "~", "*": "*", "**": "P", "@": "@", "/": "/", "->": ">", ":=": "q", "=": "=", "...": "e", ".": ".", ",": ",", ":": ":", ";": ";",
    **{c: c for c in "()[]{}"}, **{c + "=": "Q" for c in ("+", "-", "*", "/", "//", "%", "@", "&", "|", "^", ">>", "<<", "**")},
}
_QUOTED = r"(?P<s>(?:[bB][rR]?|[rR][bB]?|[uU])?(?:\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\.|'(?!''))*'''|\"(?!\"\")(?:[^\"\\\n]|\\.)*\"|'(?!'')(?:[^'\\\n]|\\.)*'))"
TOKEN = re.compile(
    r"(?P<b>[ \t\f]+|\\\r?\n)|(?P<c>#[^\n]*)|" + _QUOTED + r"|(?P<t>(?:[rR]?[fFtT]|[fFtT][rR])(?:\"\"\"|'''|\"|'))|(?P<x>(?:[bB]?[rR]?|[uU])[\"'])"
    r"|(?P<n>[^\W\d]\w*)|(?P<d>0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*(?:\.(?!\.))?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)"
    r"|(?P<o>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|>>|<<|[-+*/%@&|^]=|[=!<>]=|[-+*/%@&|^~<>=.,:;()\[\]{}])|(?P<l>\n)|(?P<u>.)",
    re.S,
)
_AFTER_NUMBER = re.compile(r"(?:and|else|for|if|in|is|not|or)\b")
_IN_TEMPLATE = re.compile(r"\\.|\{\{|\}\}|\{|\"\"\"|'''|[\"'\n]", re.S)
_IN_FIELD = re.compile(r"(?P<s>[rRuUbB]{0,2}(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'))|(?P<t>[rR]?[fFtT][rR]?(?:\"\"\"|'''|[\"']))|(?P<b>[()\[\]{}])|(?P<q>[\"'])", re.S)
CLOSER = {"(": ")", "[": "]", "{": "}"}
#: What must stand before these heads of blocks, at the same indentation.
_FOLLOWS = {"L": "IL", "E": "ILFWx", "x": "tx", "f": "txe"}


def template_end(text: str, at: int, quote: str) -> int:
    """The place after a template literal whose text begins at ``at``, or -1: its fields may hold literals of any quotes."""
    while m := _IN_TEMPLATE.search(text, at):
        got, at = m.group(), m.end()
        if got == quote or got.startswith(quote) and len(quote) == 1:
            return m.start() + len(quote)
        if got == "\n" and len(quote) == 1:
            return -1
        if got == "{":
            depth, field = 1, at
            while depth:
                f = _IN_FIELD.search(text, field)
                if not f or f["q"]:
                    return -1
                if f["t"]:
                    field = template_end(text, f.end(), f["t"].lstrip("rRfFtT"))
                    if field < 0:
                        return -1
                    continue
                # the quote that would end the template may also begin a literal of the field, since Python 3.12
                if f["b"]:
                    depth += 1 if f["b"] in "([{" else -1
                field = f.end()
            at = field
    return -1


class _Bad(Exception):
    pass


def _need(s: str, i: int, sign: str) -> int:
    if s[i] != sign:
        raise _Bad
    return i + 1


def _primary(s: str, i: int) -> int:
    c = s[i]
    if c == "s":
        while s[i] == "s":
            i += 1
    elif c in "n0Te":
        i += 1
    elif c in "([{":
        i = _bracket(s, i)
    else:
        raise _Bad
    while True:
        c = s[i]
        if c == ".":
            i = _need(s, i + 1, "n")
        elif c in "([":
            i = _bracket(s, i)
        else:
            return i


def _expr(s: str, i: int, ternary: bool = True) -> int:
    while True:
        while s[i] in "-~NA":
            i += 1
        if s[i] == "l":
            return _expr(s, _need(s, _params(s, i + 1, ":"), ":"), ternary)
        i = _primary(s, i)
        c = s[i]
        if c in "o-*P@/ik":
            i += 1
        elif c == "N":
            i = _need(s, i + 1, "i")
        elif c == "q":
            i += 1
        elif c == "I" and ternary:
            i = _need(s, _expr(s, i + 1, False), "E")
        else:
            return i


def _many(s: str, i: int) -> int:
    """Expressions with commas, also starred ones."""
    while True:
        i = _expr(s, i + (s[i] == "*"))
        if s[i] != ",":
            return i
        i += 1
        if s[i] in "=\n:;)]}>":
            return i


def _targets(s: str, i: int) -> int:
    while True:
        i = _primary(s, i + (s[i] == "*"))
        if s[i] != ",":
            return i
        i += 1
        if s[i] in "i=\n:;":
            return i


def _bracket(s: str, i: int) -> int:
    opened = s[i]
    close = CLOSER[opened]
    i += 1
    while s[i] != close:
        c = s[i]
        if c == "y":
            i = _yield(s, i)
        elif c == "*" or c == "P" and opened != "[":
            i = _expr(s, i + 1)
        else:
            if c != ":" or opened != "[":
                i = _expr(s, i)
            if s[i] == "=" and opened == "(":
                i = _expr(s, i + 1)
            elif s[i] == "S" and opened == "(":
                i = _primary(s, i + 1)
            if s[i] == ":" and opened == "{":
                i = _expr(s, i + 1)
            for _ in range(2):
                if s[i] == ":" and opened == "[":
                    i += 1
                    if s[i] not in ":,]":
                        i = _expr(s, i)
        while s[i] == "F" or s[i] == "a" and s[i + 1] == "F":
            i = _need(s, _targets(s, i + 1 + (s[i] == "a")), "i")
            i = _expr(s, i) if s[i] == "l" else _expr(s, i, False)
            while s[i] == "I":
                i = _expr(s, i + 1, False)
        if s[i] == ",":
            i += 1
        elif s[i] != close:
            raise _Bad
    return i + 1


def _params(s: str, i: int, end: str) -> int:
    while s[i] != end:
        if s[i] in "*P":
            i += 1 + (s[i + 1] == "n")
        elif s[i] == "/":
            i += 1
        else:
            i = _need(s, i, "n")
        if s[i] == ":" and end != ":":
            i = _expr(s, i + 1 + (s[i + 1] == "*"))
        if s[i] == "=":
            i = _expr(s, i + 1)
        if s[i] == ",":
            i += 1
        elif s[i] != end:
            raise _Bad
    return i


def _yield(s: str, i: int) -> int:
    if s[i + 1] == "M":
        return _expr(s, i + 2)
    return i + 1 if s[i + 1] in ")\n;=" else _many(s, i + 1)


def _names(s: str, i: int, dotted: bool) -> int:
    while True:
        i = _need(s, i, "n")
        while dotted and s[i] == ".":
            i = _need(s, i + 1, "n")
        if s[i] == "S":
            i = _need(s, i + 1, "n")
        if s[i] != "," or s[i + 1] == ")":
            return i
        i += 1


_CONST = re.compile(r"[0T]|s+")
#: What can't be assigned to: a plain value, or anything that ends in a call or has an operator outside of brackets.
_OPERATES = re.compile(r"[o\-~/@kiNIEAlq]|[^,(*]P|[^,(*=]\*")


def _assignable(target: str, single: bool) -> bool:
    flat, depth, calls = [], 0, False
    for n, c in enumerate(target):
        if c in "([{":
            if depth == 0:
                flat.append(c)
                calls = c == "(" and n > 0 and target[n - 1] in "n)]s"
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth == 0 and calls and (n + 1 == len(target) or target[n + 1] == ","):
                return False
        elif depth == 0:
            flat.append(c)
    text = "".join(flat)
    parts = [p.lstrip("*") for p in text.split(",") if p]
    if single and len(parts) > 1 or any(_CONST.fullmatch(p) or p.startswith("{") and len(p) == 1 for p in parts):
        return False
    return not _OPERATES.search(text)


def _simple(s: str, i: int) -> int:
    c = s[i]
    after = s[i + 1]
    bare = after in "\n;"
    if c == "p":
        return i + 1
    if c == "r":
        return i + 1 if bare else _many(s, i + 1)
    if c == "R":
        i = i + 1 if bare else _expr(s, i + 1)
        return _expr(s, i + 1) if s[i] == "M" and not bare else i
    if c == "g":
        return _names(s, i + 1, False)
    if c == "d":
        return _many(s, i + 1)
    if c == "B":
        i = _expr(s, i + 1)
        return _expr(s, i + 1) if s[i] == "," else i
    if c == "m":
        return _names(s, i + 1, True)
    if c == "M":
        i += 1
        level = i
        while s[i] in ".e":
            i += 1
        if s[i] == "n":
            while s[i] == "n" and s[i + 1] == ".":
                i += 2
            i = _need(s, i, "n")
        elif i == level:
            raise _Bad
        i = _need(s, i, "m")
        if s[i] == "*":
            return i + 1
        if s[i] == "(":
            i = _names(s, i + 1, False)
            return _need(s, i + (s[i] == ","), ")")
        return _names(s, i, False)
    if c == "y":
        i = _yield(s, i)
        if s[i] != "=":
            return i
        raise _Bad
    start = i
    i = _many(s, i)
    if s[i] == "Q":
        if not _assignable(s[start:i], True):
            raise _Bad
        return _yield(s, i + 1) if s[i + 1] == "y" else _many(s, i + 1)
    if s[i] == ":":
        if not _assignable(s[start:i], True):
            raise _Bad
        i = _expr(s, i + 1)
        if s[i] == "=":
            i = _yield(s, i + 1) if s[i + 1] == "y" else _many(s, i + 1)
        return i
    while s[i] == "=":
        if not _assignable(s[start:i], False):
            raise _Bad
        start = i + 1
        i = _yield(s, start) if s[start] == "y" else _many(s, start)
    return i


def _head(s: str) -> int:
    """The place of the colon after the head of a compound statement."""
    i = 1 if s[0] == "a" and s[1] in "DFw" else 0
    c = s[i]
    if c in "ILW":
        return _expr(s, i + 1)
    if c in "Etf":
        return i + 1
    if c == "x":
        i += 1 + (s[i + 1] == "*")
        if s[i] == ":":
            return i
        i = _many(s, i)
        return _need(s, i + 1, "n") if s[i] == "S" else i
    if c == "F":
        return _many(s, _need(s, _targets(s, i + 1), "i"))
    if c == "D":
        i = _need(s, i + 1, "n")
        if s[i] == "[":
            i = _params(s, i + 1, "]") + 1
        i = _need(s, _params(s, _need(s, i, "("), ")"), ")")
        return _expr(s, i + 1) if s[i] == ">" else i
    if c == "C":
        i = _need(s, i + 1, "n")
        if s[i] == "[":
            i = _params(s, i + 1, "]") + 1
        return _bracket(s, i) if s[i] == "(" else i
    if c == "w":
        while True:
            i = _expr(s, i + 1)
            if s[i] == "S":
                i = _primary(s, i + 1)
            if s[i] != ",":
                return i
    raise _Bad


@functools.lru_cache(maxsize=1 << 16)
def statement(shape: str, soft: str) -> tuple[str, bool]:
    """What kind of statement a shape is ("": no statement of the grammar), and whether a block must follow.

    ``soft``: the first word if that is one that is a keyword only in some places.
    """
    n = len(shape)
    s = shape + "\n\n\n"  # what is beyond its end is a line end
    try:
        if s[0] == "@":
            return ("@", False) if _expr(s, 1) == n else ("", False)
        compound = s[0] in "ILWEtfxFDCw" or s[0] == "a" and s[1] in "DFw"
        if compound:
            i = _need(s, _head(s), ":")
            kind = s[0] if s[0] != "a" else s[1]
            if i == n:
                return kind, True
        else:
            i, kind = 0, "s"
        while i < n:
            i = _simple(s, i)
            if i < n:
                i = _need(s, i, ";")
        return kind, False
    except _Bad:
        pass
    except RecursionError:
        return "s", shape.endswith(":")
    if soft in ("match", "case") and ":" in shape and len(shape) > 2:
        return "s", shape.endswith(":")
    if soft == "type" and s[1] == "n" and "=" in shape:
        return "s", False
    return "", False


def python_fault(text: str) -> str | None:
    """Why ``text`` (line ends as \\n) isn't valid Python, or None."""
    if "\0" in text:
        return "null bytes"
    brackets: list[str] = []
    levels = [0]
    before: list[str] = [""]  # by level: the kind of its last statement
    tries: list[bool] = [False]  # by level: a try that still needs its except or finally
    shape: list[str] = []
    soft, indent, opened, decorated = "", 0, False, False
    at, size, begins = 0, len(text), True
    match = TOKEN.match

    def close_levels(to: int) -> bool:
        while levels[-1] > to:
            if tries.pop():
                return False
            levels.pop()
            before.pop()
        return levels[-1] == to

    def end_line() -> str | None:
        nonlocal opened, decorated, soft
        word = "".join(shape)
        shape.clear()
        kind, opens = statement(word, soft)
        soft = ""
        if opened:
            if indent <= levels[-1]:
                return "block without statements"
            levels.append(indent)
            before.append("")
            tries.append(False)
        elif indent > levels[-1]:
            return "indented without a block"
        elif indent < levels[-1] and not close_levels(indent):
            return "indentation of no open block"
        if not kind:
            return "tokens in no order of the grammar"
        if kind in _FOLLOWS:
            if not before[-1] or before[-1] not in _FOLLOWS[kind]:
                return "branch without its statement"
            if kind in "xf":
                tries[-1] = False
            elif kind == "E" and before[-1] == "x":
                kind = "e"  # of a try
        elif tries[-1]:
            return "try without its handler"
        if decorated and kind not in "@DC":
            return "decorator without a definition"
        decorated = kind == "@"
        if kind == "t":
            tries[-1] = True
        before[-1] = kind
        opened = opens
        return None

    while at < size:
        if begins:
            # the indentation of a line, by columns
            column = 0
            while at < size and text[at] in " \t\f":
                column = column + 1 if text[at] == " " else (column // 8 + 1) * 8 if text[at] == "\t" else 0
                at += 1
            begins = False
            if at >= size:
                break
            if text[at] == "\n":
                at += 1
                begins = True
                continue
            if text[at] != "#":
                indent = column
        m = match(text, at)
        kind, got, at = m.lastgroup, m.group(), m.end()
        if kind == "b" or kind == "c":
            continue
        if kind == "n":
            sign = KEYWORDS.get(got, "n")
            if not shape and sign == "n" and got in ("match", "case", "type"):
                soft = got
            if text[at : at + 1] in ("'", '"'):
                return "word before a literal"
            shape.append(sign)
        elif kind == "o":
            sign = OPERATORS.get(got, "o")
            if got in "([{":
                brackets.append(got)
            elif got in ")]}":
                if not brackets or CLOSER[brackets.pop()] != got:
                    return "unbalanced delimiter"
            shape.append(sign)
        elif kind == "l":
            if brackets:
                continue
            if shape:
                why = end_line()
                if why:
                    return why
            begins = True
        elif kind == "s":
            shape.append("s")
        elif kind == "d":
            if text[at : at + 1].isalnum() and not _AFTER_NUMBER.match(text, at) or text[at : at + 1] == "_":
                return "name in a number"
            if len(got) > 1 and got[0] == "0" and got.isdigit() and got.strip("0"):
                return "leading zeros"
            shape.append("0")
        elif kind == "t":
            quote = got.lstrip("rRfFtTbB")
            at = template_end(text, at, quote)
            if at < 0:
                return "unterminated literal"
            shape.append("s")
        elif kind == "x":
            return "unterminated literal"
        elif got.isidentifier():
            shape.append("n")
        else:
            return "character of no token"
    if brackets:
        return "premature end"
    if shape:
        why = end_line()
        if why:
            return why
    if opened or decorated:
        return "premature end"
    return None if close_levels(0) and not tries[0] else "try without its handler"
