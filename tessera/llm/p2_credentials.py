"""Problem 2: credentials in source texts.

1. Candidates: literals that stand where a credential could: after a name, in a URL, header, command, SQL statement, call,
   comment, JSON text or encoded literal, also in pieces, and blocks of keys. One automaton over cue words finds the lines.
2. Weak labels: patterns that can hardly be anything else label some candidates as credentials, and placeholders, lookups,
   digests, ids and literals under unrelated names as none. The rest stay unlabelled.
3. Character Markov models of both classes are counted over all labelled candidates (a bounded table of character pairs).
4. Logistic regression on the models' likelihood ratio, the surrounding names, the value's shape and the path is fitted on a
   bounded sample of labelled candidates, and calibrated on another part of it.
5. What scores high is reported by line, or masked in place, character by character, so that the rest keeps its positions.

Texts are never shuffled: candidates are cut out in a map stage, and masking is another one that carries the fitted model.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow
from tessera.session import spread, table, written

# Words near which credentials stand, and forms that tokens of known issuers have.
CUES = ["pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "basic ", "://", "identified", "begin ", "sign_in", "signin", "login", "log_in", "connect", "open_session", "opensession", "base64", "b64", "akia", "ghp_", "gho_", "github_pat_", "glpat-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "xoxa-", "eyj", "aiza", "npm_", "sig=", "_cert", "_pem", "_hash", "sha256", "trace_id", "traceid", "data:", "integrity", "client_id", "_pin", "pw"]
ISSUED = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w-]{18,}|[sr]k_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{16,}|AIza[\w-]{30,}|npm_[A-Za-z0-9]{30,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{10,})")
PREFIXED = re.compile(r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|[sr]k_live_|xox[abprs]-|AIza|npm_|eyJ)")
# The next three are matched against names in snake case, see ``snake``.
STRONG_NAME = re.compile(r"password|passwd|passphrase|passcode|(?:^|_)(?:pwd|pw|pin|sig|signature)(?:_|$)|(?:^|_)pass$|secret|token|credential|(?:api|access|private|secret|signing|encryption|upload|master|deploy|license|auth|service|account|storage|webhook|session|client)_?key|^x_(?:auth|api)")
WEAK_NAME = re.compile(r"(?:^|_)(?:keys?|auth|bearer|basic|cert|pem|dsn|broker|url|uri|conn|config|settings|curl)(?:_|$)|authorization|connection")
OTHER_NAME = re.compile(r"(?:^|_)(?:public_key|field|header|params?|names?|ids?|trace|commit|sha\d*|hash|digest|integrity|checksum|icon|image|data|path|file|env|label|title|prefix|suffix|type|count|length|expire\w*|ttl|banner|message|pattern|regex|column|attr|limit|url)$|(?:^|_)public(?:_|$)")
PLACEHOLDER = re.compile(
    r"""^[*x.#•_-]+$|^<.*>$|^\$?\{.*\}$|^\$\(.*\)$|^%\w+%$|^%\(\w+\)[sd]$|^%[sdv]$|^\[.*\]$|^\{\{.*\}\}$|^__\w+__$
    |change[\s_-]*me|replace[\s_-]*(?:me|this|with)|placeholder|redacted|dummy|example|sample(?![a-z])|your[\s_-]|not[\s_-]*a[\s_-]*real|fake|insert[\s_-]|todo|fixme|test[\s_-]only|for[\s_-]*tests?\b|xxxx|\*\*\*|^(?:none|null|nil|undefined|empty|unset|n/?a|tbd|true|false|secret|password|passwd|token|key|api_?key|pass|default)$|^\W*masked\W*$|hidden-value|\.\.\.|REDACT""",
    re.I | re.X,
)
LOOKUP = re.compile(r"(?:getenv|read_?env|environ(?:\.get)?|process\.env|env::var|System\.getenv|os\.Getenv|get_?secret|from_?vault|lookup|get_?config|config\.get|settings\.get|require|load_?secret|fetch_?secret)\s*[\[(.]?\s*$", re.I)
DIGEST = re.compile(r"^(?:sha\d+[:-])?(?:[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})$|^sha(?:1|256|384|512)[:-]|^md5[:-]", re.I)
UUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)
PLACE = re.compile(r"^[a-z]+://|^data:|^/[\w./-]+$|^(?:[\w-]+\.)+[a-z]{2,}(?::\d+)?(?:/\S*)?$|^[A-Za-z]+(?:[/_.:-][A-Za-z]+)*$", re.I)

_SNAKE = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[^A-Za-z0-9]+")


def snake(name: str) -> str:
    """``name`` in lower case with underscores between its words."""
    return _SNAKE.sub("_", name).strip("_").lower()


# Lines can be whole bundles, so the patterns below start once in a run of name characters and don't go back into it or into
# blanks (possessive repeats): the matches are the same, in a time that grows with the line's length only.
_NAME = r"[A-Za-z_$][\w$.-]*"
_LITERAL = r'''"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`\n]*`'''
#: name [: type] = ... literal; what stands between may be a lookup with a default
ASSIGN = re.compile(rf"""(?:(?P<q>["'])(?P<quoted>{_NAME}+)(?P=q)|(?<![\w$.-])(?:[^\WA-Za-z_]|[.-])*+(?P<plain>{_NAME}+))\s*+(?:\[\d*\]\s*+)?(?::\s*+(?:const\s+)?[&*]?\s*+(?:'?\w+\s+)?[A-Za-z_][\w<>&\s]*+)?(?::=|=>|(?<![=!<>])=(?!=)|:|,(?=\s*["'`]))\s*+""")
LITERAL = re.compile(_LITERAL)
ESCAPED_PAIR = re.compile(r"""\\["'](?P<name>[\w.-]+)\\["']\s*:\s*\\["'](?P<value>(?:[^"'\\\n]|\\[^"'\n])+)\\["']""")
BARE_PAIR = re.compile(r"(?<![\w.-])(?:[^\WA-Za-z]|[.-])*+(?P<name>[A-Za-z][\w.-]*+)\s*+(?:=|:\s)\s*+(?P<value>[^\s\"'`,;<>(){}]{6,})")
#: "old auth token was ...", "login: user / ..." in the words of a comment
PROSE_PAIR = re.compile(r"(?<![A-Za-z_])(?P<name>[A-Za-z_]*(?:password|passwd|passphrase|secret|token|credentials?|(?:api|access|signing|private|encryption|upload|deploy)[ _-]key|pwd|\bpw|\bpass))\s*(?:(?:is|was|are|now|to|->|-|:|=)\s*)?\s(?P<value>[^\s\"'`,;<>(){}]{6,})", re.I)
LOGIN_PAIR = re.compile(r"(?P<name>login|credentials?|account|user)(?:\s*+[:=])?\s++\S+\s*/\s*(?P<value>[^\s\"'`,;<>(){}]{6,})", re.I)
URL_USER = re.compile(r"[a-z][0-9+.-]*+://[^\s:/@\"'`<>]*:(?P<value>[^\s@/\"'`]+)@[\w.-]+", re.I)
URL_PARAM = re.compile(r"[?&](?P<name>sig|signature|key|token|secret|password|passwd|pwd|auth|[a-z_]*(?:api_?key|access_?token|auth_?token|access_?key|_token|_secret|_key))=(?P<value>[^\s&\"'`#<>]+)", re.I)
HEADER = re.compile(r"(?P<name>authorization|x-[a-z-]*(?:token|key|auth|secret)[a-z-]*+|api-key|private-token)(?:\"|')?\s*[:,]\s*(?:\"|'|`)?(?:(?P<scheme>bearer|basic|token)\s+)?(?P<value>[^\s\"'`,;)]+)", re.I)
SQL_LITERAL = re.compile(r"(?:identified\s+by|password)\s+(?:=\s*)?'(?P<value>[^'\n]+)'", re.I)
CALL = re.compile(r"(?<!\w)(?P<name>\w*(?:log_?in|sign_?in|connect|open_?session|authenticate|auth)\w*+)\s*+\((?P<args>[^()\n]*)\)", re.I)
OPTION = re.compile(r"(?:^|\s)--?(?P<name>password|passwd|pass|token|secret|api-key|apikey|auth-token|access-token|user)(?:=|\s+)[\"']?(?P<value>[^\s\"'`]+)", re.I)
ENCODED = re.compile(rf"(?:base64|b64|atob)\w*+\s*+(?:\(\s*+)?(?P<value>{_LITERAL})", re.I)
INNER_PAIR = re.compile(r"(?<!\w)\d*+(?P<name>[A-Za-z_]\w*+)\s*+[=:]\s*(?P<value>[^;&\s\"',]+)")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]+-----")
_END = re.compile(r"-----END [A-Z0-9 ]+-----")
_RUN = re.compile(r"[A-Za-z0-9+/=]{16,}")
#: What of a private key is masked: all but signs, escapes and the plus signs between its pieces.
_KEY_PART = re.compile(r"""\\[nrt]|(?<![^\s"'`])\+(?![^\s"'`])|(?P<part>[A-Za-z0-9+/=]+)""")
#: A key without its end, as in a chunk: headers, then long runs with what joins them, then a shorter last line.
_OPEN_KEY = re.compile(r"""(?:\s|\\[nr]|["'`])*+(?:[A-Za-z-]+:[ ][^\n\\]*(?:\s|\\[nr])++)*+(?:[\s"'`,()#*;|>\\.]|\+(?=\s)|//(?=\s)|(?<=\\)[nrt]|[A-Za-z0-9+/=]{16,})*+(?:(?<=[\n"'`])[A-Za-z0-9+/=]{1,15}(?=[ \t\r]*(?:\n|["'`]|\Z)))?""")
_ISSUED_CUES = ("AKIA", "ASIA", "gh", "glpat-", "_live_", "xox", "AIza", "npm_", "eyJ")
COMMENT = re.compile(r"^\s*(?://|#(?!include|define|if|endif|else|pragma)|\*|/\*|<!--|--\s)")
BARE_FILE = re.compile(r"\.(?:env|properties|ini|cfg|conf|ya?ml|toml|sh|bash)$", re.I)
_CONTINUES = re.compile(r"(?:[=(+\\]|:=)\s*$")
_BELOW = re.compile(rf"(?:[ \t]*+(?:\([ \t]*+)?\r?\n)*+[ \t]*+(?={_LITERAL})")
_SUM, _ROW = (re.compile(rf"[ \t]*(?:\)?[ \t]*\+|\\|{comma})?[ \t]*(?:\r?\n[ \t]*)?(?:\+[ \t]*)?") for comma in ("\\+", ","))
_COLON = re.compile(r".[ \t]*+:")
_ENV = re.compile(r"\b(?:env|environ)\b")
_PLAIN = re.compile(r"\s*+(?:\{\s*+)?")
_WRAPPED = re.compile(r"\s*+(?:[\w:.<>&]+!?\s*+\(\s*|\(\s*|\[\s*|\w+\s+|String::from\(|[bfruLR]{1,2})")
_NEXT_ASSIGN = re.compile(r",\s*[\w$.]+\s*[=:]")

KINDS = ("assign", "pair", "bare", "url", "param", "header", "sql", "call", "option", "encoded", "block", "issued")
FEATURES = ("bias", "likelihood", "length", "digits", "capitals", "symbols", "entropy", "words", "strong", "weak", "other", "lookup", "prefixed", "place", "blank", "named", "test_path", "plural_case", *KINDS)
_N_CHARS = 96
CANDIDATE = "row_kind string, row_key string, line_no long, kind string, name string, value string, context string, path string, weak int"


@dataclass
class Found:
    """One candidate of a text: ``spans`` are the character ranges that hold the literal's pieces."""

    line_no: int
    kind: str
    name: str
    value: str
    context: str
    spans: list[tuple[int, int]] = field(default_factory=list)


def _cues() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in CUES:
        found.add_word(word, word)
    found.make_automaton()
    return found


_CUES: ahocorasick.Automaton | None = None


def _lines(text: str) -> Iterator[tuple[int, int, int]]:
    """Number, start and end of the lines that hold a cue."""
    global _CUES
    if _CUES is None:
        _CUES = _cues()
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    number, counted, stop = 1, 0, -1
    for end, _ in _CUES.iter(low):
        if end <= stop:
            continue
        start = text.rfind("\n", 0, end) + 1
        stop = text.find("\n", end)
        stop = len(text) if stop < 0 else stop
        number += text.count("\n", counted, start)
        counted = start
        yield number, start, stop


def candidates(text: str, path: str | None = None) -> list[Found]:
    """All literals of ``text`` that stand where a credential could."""
    out: list[Found] = []
    taken: set[tuple[int, int]] = set()
    keys: list[tuple[int, int]] = []  # from BEGIN to END of armoured blocks, which are read as such only
    covered = bytearray(len(text))  # 1 where a candidate stands

    def put(c: Found) -> None:
        if not any(a < e and s < b for a, b in keys for s, e in c.spans):
            out.append(c)
            for s, e in c.spans:
                covered[s:e] = b"\1" * (e - s)

    def add(kind: str, name: str, value: str, start: int, end: int, number: int, context: str = "") -> None:
        if value and (start, end) not in taken:
            taken.add((start, end))
            put(Found(number, kind, name, value, context, [(start, end)]))

    bare_file = bool(path and BARE_FILE.search(path))
    pem_until = -1
    for number, start, stop in _lines(text):
        line = text[start:stop]
        for m in PEM.finditer(line):
            stop_at = PEM_END.search(text, start + m.end())
            again = PEM.search(text, start + m.end())
            if stop_at and not (again and again.start() < stop_at.start()):
                until = stop_at.start()
            else:
                until = _OPEN_KEY.match(text, start + m.end()).end()
            runs = [r.group() for r in _RUN.finditer(text, start + m.end(), until)]
            if sum(map(len, runs)) >= 40:
                parts = [r.span() for r in _KEY_PART.finditer(text, start + m.end(), until) if r["part"]]
                put(Found(number, "block", "private_key", runs[0], "", parts))
                pem_until = max(pem_until, until)
        for m in _BEGIN.finditer(line):
            end = _END.search(text, start + m.end())
            at = start + m.start()
            while at > start and text[at - 1] in "\"'`":
                at -= 1
            keys.append((at, end.end() if end and end.start() <= max(stop, pem_until) else max(start + m.end(), pem_until)))
        if start < pem_until and stop <= pem_until and "BEGIN" not in line:
            continue
        low = line.lower()
        comment = bool(COMMENT.match(line))
        quoted = '"' in line or "'" in line or "`" in line
        if not quoted and not comment and not bare_file and "://" not in line and not _CONTINUES.search(line):
            continue
        if "://" in line:
            for m in URL_USER.finditer(line):
                add("url", "password", m.group("value"), start + m.start("value"), start + m.end("value"), number)
            for m in URL_PARAM.finditer(line) if "?" in line else ():
                add("param", m.group("name"), m.group("value"), start + m.start("value"), start + m.end("value"), number)
        for m in HEADER.finditer(line) if "authorization" in low or "x-" in low or "api-key" in low or "private-token" in low else ():
            value = m.group("value")
            if (m.group("scheme") or "").lower() == "basic":
                inner = _decoded(value)
                if inner and ":" in inner:
                    add("header", "password", inner.split(":", 1)[1] or "none", start + m.start("value"), start + m.end("value"), number)
                continue
            add("header", m.group("name") if not m.group("scheme") else "token", value, start + m.start("value"), start + m.end("value"), number)
        for m in SQL_LITERAL.finditer(line) if "'" in line and ("identified" in low or "password" in low) else ():
            add("sql", "password", m.group("value"), start + m.start("value"), start + m.end("value"), number)
        for m in OPTION.finditer(line) if " -" in line else ():
            value, at = m.group("value"), start + m.start("value")
            if m.group("name").lower() == "user":
                if ":" not in value:
                    continue
                at += value.index(":") + 1
                value = value.split(":", 1)[1]
            add("option", m.group("name"), value, at, at + len(value), number)
        for m in ENCODED.finditer(line) if "64" in line or "atob" in low else ():
            inner = _decoded(m.group("value")[1:-1])
            for p in INNER_PAIR.finditer(inner or ""):
                if STRONG_NAME.search(snake(p.group("name"))):
                    add("encoded", p.group("name"), p.group("value"), start + m.start("value") + 1, start + m.end("value") - 1, number)
        for m in ESCAPED_PAIR.finditer(line) if "\\" in line else ():
            add("pair", m.group("name"), m.group("value"), start + m.start("value"), start + m.end("value"), number)
        for m in CALL.finditer(line) if quoted and "(" in line and "," in line else ():
            args = list(LITERAL.finditer(m.group("args")))
            if len(args) >= 2:
                at = start + m.start("args") + args[-1].start() + 1
                add("call", m.group("name"), args[-1].group()[1:-1], at, at + len(args[-1].group()) - 2, number)
        if quoted or _CONTINUES.search(line):
            _assigned(text, line, number, start, stop, put, taken)
        for m in ISSUED.finditer(line) if any(x in line for x in _ISSUED_CUES) else ():
            at, end = start + m.start(), start + m.end()
            if covered.find(0, at, end) >= 0:
                add("issued", _name_before(text, start, at), m.group(), at, end, number)
        if comment or bare_file:
            for m in BARE_PAIR.finditer(line):
                if STRONG_NAME.search(snake(m.group("name"))) and not covered[start + m.start("value")]:
                    value = m.group("value").rstrip(".")
                    add("bare", m.group("name"), value, start + m.start("value"), start + m.start("value") + len(value), number)
        for pattern in (PROSE_PAIR, LOGIN_PAIR) if comment else ():
            for m in pattern.finditer(line):
                value = m.group("value").rstrip(".:")
                at = start + m.start("value")
                if re.search(r"\d", value) and not covered[at]:
                    add("bare", m.group("name") if pattern is PROSE_PAIR else "login_password", value, at, at + len(value), number)
    return out


def _name_before(text: str, low: int, at: int) -> str:
    """The name to which what begins at ``at`` is given on a line that begins at ``low``."""

    def back(chars: str, most: int | None = None) -> int:
        k = at
        while k > low and (most is None or at - k < most) and (text[k - 1] in chars if chars else text[k - 1].isspace()):
            k -= 1
        return k

    at = back("\"'`", 1)
    at = back("")
    op = back("=", 1)
    at, equals = op, op < at
    op = back(":", 1)
    if op == at and not equals:
        return ""
    at = op
    at = back("")
    end = at = back("\"'", 1)
    while at > low and (text[at - 1].isalnum() or text[at - 1] in "_-"):
        at -= 1
    m = re.search(r"[A-Za-z_][\w-]*$", text[at:end])
    return m.group() if m else ""


def _decoded(value: str) -> str | None:
    try:
        return base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("ascii")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return None


def _assigned(text: str, line: str, number: int, start: int, stop: int, put: Callable[[Found], None], taken: set[tuple[int, int]]) -> None:
    """Literals that are given to a name, with further pieces on the same or the next lines."""
    at, ahead = 0, -1  # ``first``: the next literal from ``ahead`` on, which all names before it share
    first, env, ends = None, -1, len(line.rstrip())
    while True:
        m = ASSIGN.search(line, at)
        if not m:
            return
        name, at = m.group("quoted") or m.group("plain"), m.end()
        words = snake(name)
        cued = bool(STRONG_NAME.search(words) or WEAK_NAME.search(words) or OTHER_NAME.search(words))
        if ahead < 0 or first and first.start() < at:
            ahead, first = at, LITERAL.search(line, at)
            env = max((e.start() for e in _ENV.finditer(line, at, first.start())), default=-1) if first else -1
        if not first and cued and (at >= ends or line[ends - 1] in "=(+\\"):
            # the value begins on a later line
            head = _BELOW.match(text, stop + 1)
            if head:
                spans, values = _pieces(text, head.end())
                if spans and _ends_value(text, spans[-1][1]) and spans[0] not in taken:
                    taken.update(spans)
                    put(Found(number + 1 + text.count("\n", stop + 1, spans[0][0]), "assign", name, "".join(values), "", spans))
            return
        if not first:
            continue
        quote = first.start()
        lookup = _looked_up(line, at, quote)
        if lookup or env >= at:
            before = line[at:quote]
            if ";" in before or before.count("(") <= before.count(")") and _NEXT_ASSIGN.search(before):
                continue  # the literal is given to a later name
            # the first literal of a lookup names what is looked up; a default may follow
            at = first.end()
            after = LITERAL.search(line, at)
            if after and re.match(r"\s*[\])]*\s*(?:,|\|\||\?\?|or\b|\.unwrap_or\w*\()", line[at : after.start()] or ","):
                span = (start + after.start() + 1, start + after.end() - 1)
                if span not in taken and cued:
                    taken.add(span)
                    put(Found(number, "assign", name, after.group()[1:-1], "default", [span]))
                    at = after.end()
            elif re.search(r"\|\||\?\?|\bor\b", before):
                span = (start + first.start() + 1, start + first.end() - 1)
                if span not in taken and cued:
                    taken.add(span)
                    put(Found(number, "assign", name, first.group()[1:-1], "default", [span]))
            elif cued:
                put(Found(number, "assign", name, first.group()[1:-1], "lookup", [(start + first.start() + 1, start + first.end() - 1)]))
            continue
        if not _PLAIN.fullmatch(line, at, quote) and not _WRAPPED.fullmatch(line, at, quote):
            continue
        before = line[at:quote]
        value = first.group()[1:-1]
        at = first.end()
        if not cued and (len(value) < 12 or " " in value or not re.search(r"\d", value)):
            continue
        pieces, values = _pieces(text, start + quote)
        spans = pieces or [(start + quote + 1, start + first.end() - 1)]
        if spans[0] not in taken:
            called = bool(re.search(r"[\w!]\s*\(\s*$", before)) and not re.search(r"(?:String|str|string|bytes|from|new|Some|Optional\.of|concat!?)\s*\(\s*$", before)
            taken.update(spans)
            put(Found(number, "pair" if m.group("q") else "assign", name, "".join(values) or value, "call" if called else "", spans))
        if at >= len(line):
            return


def _looked_up(line: str, low: int, end: int) -> bool:
    """Whether a call or index that looks something up stands between ``low`` and ``end``, at its end."""
    while end > low and line[end - 1] in "([ ":
        end -= 1
    while end > low and line[end - 1].isspace():
        end -= 1
    if end > low and line[end - 1] in "[(.":
        end -= 1
    while end > low and line[end - 1].isspace():
        end -= 1
    return bool(LOOKUP.search(line[max(low, end - 24) : end]))  # longer than any of its words


def _pieces(text: str, at: int) -> tuple[list[tuple[int, int]], list[str]]:
    """Literals from ``at`` on that are joined by plus signs or stand directly in a row, also over line ends."""
    spans, values = [], []
    glue = _ROW if _after_concat(text, at) else _SUM
    while True:
        m = LITERAL.match(text, at)
        if not m:
            return spans, values
        spans.append((m.start() + 1, m.end() - 1))
        values.append(m.group()[1:-1])
        g = glue.match(text, m.end())
        if not g.group() and not LITERAL.match(text, g.end()):
            return spans, values
        at = g.end()


def _after_concat(text: str, at: int) -> bool:
    """Whether the bracket of a concat call opens just before ``at``."""
    while at and text[at - 1].isspace():
        at -= 1
    if not at or text[at - 1] != "(":
        return False
    at -= 1
    while at and text[at - 1].isspace():
        at -= 1
    return text.endswith(("concat", "concat!"), 0, at)


def _ends_value(text: str, at: int) -> bool:
    """Whether a value can end at ``at``, just before a quote: no further argument or pair follows."""
    return not _COLON.match(text, at)


def weak_label(c: Found) -> int:
    """1: a pattern that can hardly be anything but a credential; 0: one that can hardly be one; -1: unknown."""
    v, name = c.value, snake(c.name)
    strong = bool(STRONG_NAME.search(OTHER_NAME.sub("_", name))) or c.kind in ("url", "sql", "call", "param")
    if c.kind == "block":
        return 1
    if c.context == "lookup" or not v or PLACEHOLDER.search(v) or len(set(v)) < 4:
        return 0
    if ISSUED.search(v):
        return 1
    if v.startswith("data:") or DIGEST.search(v) and (not strong or ":" in v) or UUID.match(v) and not strong:
        return 0
    if OTHER_NAME.search(name) and (not strong or re.search(r"(?:field|header|params?|names?|prefix|path|url|env|label|public_key|id)$", name)):
        return 0
    if " " in v or len(v) < 6 or c.context == "call":
        return 0
    if strong:
        return 1 if re.search(r"\d", v) else -1
    return -1 if WEAK_NAME.search(name) else 0


def _codes(value: str) -> np.ndarray:
    raw = np.frombuffer(value.encode("latin-1", "replace"), np.uint8).astype(np.int64)
    return np.where((raw >= 32) & (raw < 127), raw - 31, 0)


def features(c: Found | tuple, path: str | None, ratio: float) -> list[float]:
    """The candidate as a row of FEATURES: what the value is like, the name and the code around it, and the path. The patterns by
    which values are labelled (placeholders, digests, ids, whole tokens of issuers) aren't among them. ``ratio``: log-likelihood ratio a character of the two Markov models."""
    v, name = c.value, snake(c.name)
    n = max(1, len(v))
    counts = np.bincount(_codes(v), minlength=_N_CHARS) if v else np.zeros(_N_CHARS)
    p = counts[counts > 0] / n
    words = sum(map(len, re.findall(r"[A-Za-z]{4,}", v))) / n
    bare = OTHER_NAME.sub("_", name)
    row = [
        1.0, ratio, math.log(n), sum(map(str.isdigit, v)) / n, sum(map(str.isupper, v)) / n, len(re.findall(r"[^\w\s]", v)) / n,
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0, words, float(bool(STRONG_NAME.search(bare)) or c.kind in ("url", "sql", "call", "param", "block")), float(bool(WEAK_NAME.search(name))),
        float(bool(OTHER_NAME.search(name))), float(c.context in ("lookup", "call")), float(bool(PREFIXED.match(v))),
         float(bool(PLACE.match(v))), float(" " in v),
        float(bool(STRONG_NAME.search(snake(v))) and not re.search(r"\d", v)), float(bool(re.search(r"(?:^|/)(?:tests?|spec|fixtures?|examples?|mocks?)/|_test\.|\.test\.|\.spec\.", path or ""))),
        float(bool(re.search(r"[a-z]", v) and re.search(r"[A-Z]", v) and re.search(r"\d", v))),
    ]
    return row + [float(c.kind == k) for k in KINDS]


@dataclass(frozen=True)
class CredentialModel:
    """Markov log-probabilities of both classes (pairs of character codes), the regression's weights and the calibration."""

    pairs: np.ndarray
    weights: np.ndarray
    scale: tuple[float, float]

    def ratio(self, value: str) -> float:
        if not value:
            return 0.0
        codes = np.concatenate(([0], _codes(value)))
        return float((self.pairs[1][codes[:-1], codes[1:]] - self.pairs[0][codes[:-1], codes[1:]]).mean())

    def score(self, c: Found, path: str | None) -> float:
        """The calibrated probability that the candidate is a credential."""
        z = float(np.dot(self.weights, features(c, path, self.ratio(c.value))))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.scale[0] * z + self.scale[1]))))


@dataclass(frozen=True)
class CredentialConfig:
    """``sample``: labelled candidates of each class at most on which the regression is fitted (all are counted for the Markov
    models); ``threshold``: the least calibrated score of a credential; ``ridge``: the regression's penalty."""

    sample: int = 10_000
    threshold: float = 0.5
    ridge: float = 1e-5


def texts_of(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (row_kind, row_key, path, text) of both tables, without null keys and null or empty texts."""
    a = files.select(F.lit("file").alias("row_kind"), F.col("file_id").cast("string").alias("row_key"), F.col("path").cast("string").alias("path"), F.col("content").cast("string").alias("text"))
    b = chunks.select(F.lit("chunk").alias("row_kind"), F.col("chunk_id").cast("string").alias("row_key"), F.col("file_path").cast("string").alias("path"), F.col("body").cast("string").alias("text"))
    return spread(a.unionByName(b)).where("row_key is not null and text is not null and text <> ''")


def find_candidates(texts: DataFrame) -> DataFrame:
    """Rows of CANDIDATE for all candidates of ``texts`` (row_kind, row_key, path, text)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for kind, key, path, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            rows += [(kind, key, c.line_no, c.kind, c.name, c.value, c.context, path, weak_label(c)) for c in candidates(text, path)]
        columns = list(zip(*rows)) or [()] * 9
        types = [pa.string(), pa.string(), pa.int64(), *[pa.string()] * 5, pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], [x.split()[0] for x in CANDIDATE.split(", ")])

    return map_arrow(texts, work, CANDIDATE, "text")


def fit(found: DataFrame, config: CredentialConfig = CredentialConfig()) -> CredentialModel:
    """The model from weakly labelled candidates. The Markov counts are over all of them; the sample is the labelled values
    with the smallest hashes, so it is the same for any partitioning."""
    labelled = found.where("weak >= 0").select("kind", "name", "value", "context", "path", "weak").distinct()

    def pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = np.zeros((2, _N_CHARS * _N_CHARS), np.int64)
        for value, weak in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            codes = np.concatenate(([0], _codes(value)))
            total[weak] += np.bincount(codes[:-1] * _N_CHARS + codes[1:], minlength=_N_CHARS * _N_CHARS)
        weak, pair = np.nonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(weak.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(total[weak, pair])], ["weak", "pair", "n"])

    counts = map_arrow(labelled.select("value", "weak"), pairs, "weak int, pair int, n long", "value").groupBy("weak", "pair").agg(F.sum("n").alias("n"))
    table_of = np.full((2, _N_CHARS, _N_CHARS), 0.5)  # at most 2 * 96 * 96 rows come to the driver
    for r in counts.collect():
        table_of[r.weak, r.pair // _N_CHARS, r.pair % _N_CHARS] += r.n
    logs = np.log(table_of / table_of.sum(axis=2, keepdims=True))
    model = CredentialModel(logs, np.zeros(len(FEATURES)), (1.0, 0.0))

    # of each class about twice the sample comes to the driver: the rows whose hash is below a limit that its size sets
    sizes = {r["weak"]: r["count"] for r in labelled.groupBy("weak").count().collect()}
    hashed = labelled.withColumn("turn", F.xxhash64("kind", "name", "value", "path"))
    limits = {weak: int(-(2**63) + 2**64 * min(1.0, 2 * config.sample / n)) - 1 for weak, n in sizes.items()}
    below = F.lit(False)
    for weak, limit in limits.items():
        below = below | ((F.col("weak") == weak) & (F.col("turn") <= limit))
    rows = sorted(hashed.where(below).collect(), key=lambda r: (r.turn, r.value, r.name, r.path or "", r.kind, r.context))
    x, y, turn = [], [], []
    for weak in (0, 1):
        for k, r in enumerate([r for r in rows if r.weak == weak][: config.sample]):
            c = Found(0, r.kind, r.name, r.value, r.context)
            x.append(features(c, r.path, model.ratio(r.value)))
            y.append(weak)
            turn.append(k % 4 == 3)
    if len(set(y)) < 2:  # nothing to tell apart: only what has a known issuer's form scores high
        weights = np.zeros(len(FEATURES))
        weights[[FEATURES.index(f) for f in ("bias", "prefixed", "issued", "block")]] = -4, 8, 8, 8
        return CredentialModel(logs, weights, (1.0, 0.0))
    xs, ys, held = np.array(x), np.array(y, float), np.array(turn)
    weights = _regress(xs[~held], ys[~held], config.ridge)
    z = np.stack([xs[held] @ weights, np.ones(held.sum())], axis=1)
    a, b = _regress(z, ys[held], 1e-3, start=np.array([1.0, 0.0])) if len(set(ys[held])) == 2 else (1.0, 0.0)
    return CredentialModel(logs, weights, (float(max(a, 0.1)), float(b)))


def _regress(x: np.ndarray, y: np.ndarray, ridge: float, start: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression by Newton steps with a ridge penalty."""
    w = np.zeros(x.shape[1]) if start is None else start.astype(float)
    origin = w.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        slope = x.T @ (p - y) / len(y) + ridge * (w - origin)
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def find_credentials(files: DataFrame, chunks: DataFrame, config: CredentialConfig = CredentialConfig()) -> DataFrame:
    """Rows (row_kind, row_key, line_no, kind, score), one for each line on which a credential starts.

    ``files`` has file_id, path and content, ``chunks`` chunk_id, file_path and body. Rows with a null key and null or empty
    texts give nothing; repeated rows count once. Lines end at \\n and count from 1. Texts are read whole, long lines too.
    """
    found = written(find_candidates(texts_of(files, chunks)), "p2-candidates")
    model = fit(found, config)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        get = {k: batch.column(i).to_pylist() for i, k in enumerate(batch.schema.names)}
        rows = zip(get["kind"], get["name"], get["value"], get["context"], get["path"])
        scores = [model.score(Found(0, k, n, v, c), p) for k, n, v, c, p in rows]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(scores, pa.float64())], ["row_kind", "row_key", "line_no", "kind", "score"])

    scored = map_arrow(found, work, "row_kind string, row_key string, line_no long, kind string, score double", "value")
    best = F.max_by("kind", F.struct("score", "kind")).alias("kind")
    return scored.where(F.col("score") >= config.threshold).groupBy("row_kind", "row_key", "line_no").agg(best, F.max("score").alias("score"))


def masked(text: str, path: str | None, model: CredentialModel, threshold: float) -> str:
    """``text`` with each character of its credentials replaced by ``*``; all else keeps its place."""
    spans = sorted(s for c in candidates(text, path) if c.context != "lookup" and model.score(c, path) >= threshold for s in c.spans)
    out, at = [], 0
    for start, end in spans:
        if end > at:
            start = max(start, at)
            out += [text[at:start], re.sub(r"[^\r\n]", "*", text[start:end])]
            at = end
    return "".join([*out, text[at:]])


def redact(texts: DataFrame, model: CredentialModel, threshold: float = 0.5) -> DataFrame:
    """``texts`` (row_kind, row_key, path, text) with the credentials in text masked, and as ``masked`` how many characters
    that were; one map stage, no shuffle. A null text stays null."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(3).to_pylist()
        clean = [masked(t, p, model, threshold) if t else t for p, t in zip(batch.column(2).to_pylist(), texts)]
        count = [c.count("*") - t.count("*") if t else 0 for t, c in zip(texts, clean)]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(clean, pa.string()), pa.array(count, pa.int32())], ["row_kind", "row_key", "path", "text", "masked"])

    return map_arrow(texts.select("row_kind", "row_key", "path", "text"), work, "row_kind string, row_key string, path string, text string, masked int", "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_credentials(table(spark, sf_dir, "walked_files"), table(spark, sf_dir, "index_chunks"))
    return found.select("row_kind", "row_key", "line_no")


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and number of masked characters of every text that held a credential."""
    texts = texts_of(table(spark, sf_dir, "walked_files"), table(spark, sf_dir, "index_chunks"))
    model = fit(written(find_candidates(texts), "p2-candidates"))
    return redact(texts, model).where("masked > 0").select("row_kind", "row_key", F.md5(F.col("text").cast("binary")).alias("digest"), "masked").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p2_redacted": p2_redacted}
SQL: dict[str, str] = {}
