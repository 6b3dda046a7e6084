"""Problem 8: one consistent form of texts that look the same.

``consistent`` turns an Arrow string column into one with the same look and one spelling: full-width letters and digits
become ordinary ones, invisible characters go, special spaces become one space each, accents are composed, and letters of
another script that look like those around them become these. All steps work on the code points of a whole batch as numpy
arrays: lookup-table gathers for one-to-one changes, offsets by ``repeat`` for expansions, and for the composition of marks
one pass over all positions for each mark that a letter carries. There is no call for a single text.

A word (a run of letters and marks) of look-alike letters only is written in Latin letters; one that also holds other
letters of exactly one script but Latin is written in that script; any other in Latin. What decides is the same for all texts that look the same, so these become equal, and no letter is changed into
one that looks different.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow
from tessera.session import spread, table

# Letters that look the same, from the public data on confusable characters: Latin (the first is what is written;
# Roman numerals and letters of phonetics are Latin), Cyrillic, Greek, Armenian, Cherokee.
LOOK_ALIKES = """
a ɑ|а|||    c ⅽ|с|ϲ||   d ⅾ|ԁ|||    e|е|||      g ɡ|||ց|    h|һ||հ|     i ⅰ|і|||    j|ј|ϳ|յ|    l ⅼ|ӏ|||    m ⅿ||||     n|||ո|
o|о|ο|օ|    p|р|ρ||     q|ԛ||զ|     s|ѕ|||      u|||ս|      v ⅴ|ѵ|ν||   w|ԝ|||      x ⅹ|х|||    y|у ү|||
A|А|Α||Ꭺ    B|В|Β||Ᏼ    C Ⅽ|С|Ϲ||Ꮯ  D Ⅾ||||Ꭰ    E|Е|Ε||Ꭼ    G|Ԍ|||Ꮐ     H|Н|Η||Ꮋ    I Ⅰ|І Ӏ|Ι||  J|Ј|Ϳ||Ꭻ    K|К|Κ||Ꮶ    L Ⅼ|||Լ|Ꮮ
M Ⅿ|М|Μ||Ꮇ  N||Ν||      O|О|Ο|Օ|    P|Р|Ρ||Ꮲ    Q|Ԛ|||      R||||Ꭱ     S|Ѕ||Տ|Ꮪ    T|Т|Τ||Ꭲ    U|||Ս|      V Ⅴ|Ѵ|||Ꮩ   W|Ԝ|||Ꮃ
X Ⅹ|Х|Χ||   Y|Ү|Υ||     Z||Ζ||Ꮓ
"""
# Characters without a look of their own (ranges, inclusive), and spaces of one space's look.
INVISIBLE = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFEFF, 0xFEFF)]
SPACES = [(0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
ZWJ = 0x200D
#: A joiner between two of these makes one sign of them, so it is seen.
PICTURES = [(0x1F000, 0x1FAFF), (0x2600, 0x27BF), (0x2190, 0x21FF), (0x2B00, 0x2BFF), (0xFE0F, 0xFE0F)]

SCRIPTS = LATIN, CYRILLIC, GREEK, ARMENIAN, CHEROKEE = 1, 2, 4, 8, 16
# Where the scripts' letters stand.
BLOCKS = [(0x41, 0x250, LATIN), (0x250, 0x2B0, LATIN), (0x370, 0x400, GREEK), (0x400, 0x530, CYRILLIC), (0x530, 0x590, ARMENIAN), (0x13A0, 0x1400, CHEROKEE), (0x1E00, 0x1F00, LATIN), (0x1F00, 0x2000, GREEK), (0x2160, 0x2188, LATIN)]
_N = 0x110000
_GONE = np.uint32(0xFFFFFFFF)


class _Tables:
    """Lookup tables over all code points, made once for each worker from Python's Unicode data."""

    def __init__(self) -> None:
        points = np.arange(_N, dtype=np.uint32)
        self.fold = points.copy()  # one-to-one changes; _GONE: none
        for low, high in INVISIBLE:
            self.fold[low : high + 1] = _GONE
        for low, high in SPACES:
            self.fold[low : high + 1] = 0x20
        for low, high in ((0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)):
            self.fold[low : high + 1] -= np.uint32(0xFEE0)
        self.picture = np.zeros(_N, bool)
        for low, high in PICTURES:
            self.picture[low : high + 1] = True
        self.ccc = np.zeros(_N, np.uint8)
        self.parts = np.zeros(_N, np.uint8)  # length of the canonical decomposition if there is one
        self.starts = np.zeros(_N, np.int32)
        pool: list[int] = []
        pairs: dict[tuple[int, int], int] = {}
        letter = np.zeros(_N, bool)
        self.script = np.zeros(_N, np.uint8)
        for cp in range(0xC0, 0x30000):
            if 0xAC00 <= cp < 0xD7A4 or 0xD800 <= cp < 0xE000 or 0x3400 <= cp < 0xA000 or 0x20000 <= cp < 0x2F800:
                continue
            ch = chr(cp)
            self.ccc[cp] = unicodedata.combining(ch)
            full = unicodedata.normalize("NFD", ch)
            if full != ch:
                self.parts[cp], self.starts[cp] = len(full), len(pool)
                pool.extend(map(ord, full))
                if unicodedata.normalize("NFC", full) == ch:
                    first = unicodedata.decomposition(ch).split()
                    if len(first) == 2:
                        pairs[int(first[0], 16), int(first[1], 16)] = cp
        self.pool = np.array(pool, np.uint32)
        for low, high, script in BLOCKS:
            for cp in range(low, high):
                if chr(cp).isalpha() or unicodedata.category(chr(cp)) == "Nl":
                    letter[cp], self.script[cp] = True, script
        self.word = letter | (self.ccc > 0)
        keys = np.array([(a << 21) | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_values = keys[order], np.array(list(pairs.values()), np.uint32)[order]
        self.alike = np.zeros(_N, bool)
        self.to = {s: points.copy() for s in SCRIPTS}
        for row in re.split(r"\s{2,}|\n", LOOK_ALIKES.strip()):
            there = {s: cell.split() for s, cell in zip(SCRIPTS, row.split("|"))}
            for cp in (ord(c) for cell in there.values() for c in cell):
                self.alike[cp] = True
                for s, cell in there.items():
                    if cell:
                        self.to[s][cp] = ord(cell[0])
        self.own = np.where(self.alike, 0, self.script).astype(np.uint8)  # scripts of letters without a twin


_TABLES: _Tables | None = None


def _tables() -> _Tables:
    global _TABLES
    if _TABLES is None:
        _TABLES = _Tables()
    return _TABLES


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the column in one array, and where each text begins in it (one more at the end)."""
    texts = texts.cast(pa.large_string())
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return points, before[offsets - offsets[0]]


def _strings(points: np.ndarray, starts: np.ndarray, valid: np.ndarray) -> pa.Array:
    """The reverse of ``_points``."""
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    ends = np.concatenate(([0], np.cumsum(size)))
    data = points.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8")
    bits = np.packbits(valid, bitorder="little").tobytes()
    return pa.Array.from_buffers(pa.large_string(), len(valid), [pa.py_buffer(bits), pa.py_buffer(ends[starts].astype(np.int64).tobytes()), pa.py_buffer(data)])


def _keep(points: np.ndarray, starts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return points[keep], np.concatenate(([0], np.cumsum(keep)))[starts]


def _compose(points: np.ndarray, starts: np.ndarray, t: _Tables) -> tuple[np.ndarray, np.ndarray]:
    """Orders the marks of each letter, then joins letter and mark where one character stands for both."""
    ccc = t.ccc[points]
    is_mark = ccc > 0
    is_mark[starts[:-1][starts[:-1] < len(points)]] = False  # a text's first character has nothing before it to join
    if not is_mark.any():
        return points, starts
    run = np.cumsum(~is_mark)
    late = np.flatnonzero(is_mark[1:] & is_mark[:-1] & (ccc[1:] < ccc[:-1])) + 1
    if len(late):
        order = np.lexsort((np.where(is_mark, ccc, 0), run))  # stable: equal classes keep their order
        points = points[order]
        ccc = t.ccc[points]
    points = points.copy()
    base = np.maximum.accumulate(np.where(is_mark, 0, np.arange(len(points))))
    rank = np.arange(len(points)) - base
    gone = np.zeros(len(points), bool)
    blocked = np.zeros(len(points), np.uint8)  # by base: the class of the last mark that stayed
    for n in range(1, int(rank.max()) + 1):
        at = np.flatnonzero(rank == n)
        key = (points[base[at]].astype(np.int64) << 21) | points[at]
        hit = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
        joins = (t.pair_keys[hit] == key) & (blocked[base[at]] < ccc[at])
        points[base[at[joins]]] = t.pair_values[hit[joins]]
        gone[at[joins]] = True
        blocked[base[at[~joins]]] = ccc[at[~joins]]
    return _keep(points, starts, ~gone)


def _compose_hangul(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins the letters of Hangul syllables by arithmetic: a lead and a vowel, then what they make and a tail."""
    if not ((points >= 0x1100) & (points <= 0x11C2)).any():
        return points, starts
    for first, last, low, high, step in ((0x1100, 0x1112, 0x1161, 0x1175, 28), (0xAC00, 0xD7A3, 0x11A8, 0x11C2, 1)):
        left, right = points[:-1], points[1:]
        joins = (left >= first) & (left <= last) & (right >= low) & (right <= high)
        if step == 1:
            joins &= (left - 0xAC00) % 28 == 0  # no tail yet
        joins &= ~np.isin(np.arange(1, len(points)), starts)
        at = np.flatnonzero(joins)
        points = points.copy()
        made = (points[at] - 0x1100) * 588 + (points[at + 1] - low) * 28 + 0xAC00 if step == 28 else points[at] + points[at + 1] - 0x11A7
        points[at] = made
        keep = np.ones(len(points), bool)
        keep[at + 1] = False
        points, starts = _keep(points, starts, keep)
    return points, starts


def consistent(texts: pa.Array) -> pa.Array:
    """The consistent form of each text; null stays null, an empty text stays empty."""
    t = _tables()
    valid = np.array(pc.is_valid(texts))
    points, starts = _points(texts)
    if len(points) == 0 or points.max() < 0x80:
        return texts.cast(pa.large_string())
    # one-to-one changes; a joiner stays where it makes one sign of two pictures
    new = t.fold[points]
    joiner = np.flatnonzero(points == ZWJ)
    if len(joiner):
        inside = joiner[(joiner > 0) & (joiner + 1 < len(points))]
        inside = inside[~np.isin(inside, starts) & ~np.isin(inside + 1, starts)]
        seen = inside[t.picture[points[inside - 1]] & t.picture[points[inside + 1]]]
        new[seen] = ZWJ
    points, starts = _keep(new, starts, new != _GONE)
    # decompose: every character is repeated as often as it has parts, then the parts are gathered
    parts = t.parts[points]
    if parts.any():
        times = np.maximum(parts, 1).astype(np.int64)
        ends = np.cumsum(times)
        which = np.arange(ends[-1]) - np.repeat(ends - times, times)
        spread_points = np.repeat(points, times)
        split = np.repeat(parts > 0, times)
        spread_points[split] = t.pool[t.starts[spread_points[split]] + which[split]]
        points, starts = spread_points, np.concatenate(([0], ends))[starts]
    # look-alikes, by word
    alike = t.alike[points]
    foreign = alike & (points != t.to[LATIN][points])
    if foreign.any():
        word = t.word[points]
        first = word.copy()
        first[1:] &= ~word[:-1]
        begins = starts[:-1][starts[:-1] < len(points)]
        first[begins] = word[begins]
        number = np.cumsum(first)  # of the word; what stands between words is looked at nowhere
        own = t.own[points]
        scripts = np.zeros(number[-1] + 1, np.uint8) if len(number) else np.zeros(1, np.uint8)
        for s in SCRIPTS:
            scripts[number[word & (own == s)]] |= s
        of = np.where(np.isin(scripts, SCRIPTS), scripts, LATIN)[number]  # letters of several scripts: Latin
        points = points.copy()
        for s in SCRIPTS:
            here = alike & word & (of == s)
            points[here] = t.to[s][points[here]]
    points, starts = _compose(points, starts, t)
    points, starts = _compose_hangul(points, starts)
    return _strings(points, starts, valid)


def with_consistent(df: DataFrame, column: str, out: str = "consistent_text") -> DataFrame:
    """``df`` with the consistent form of ``column`` as ``out``; an older column of that name is replaced.

    Null stays null and empty stays empty; a text of invisible characters becomes empty. One map stage, no shuffle.
    """
    kept = df.drop(out) if out in df.columns else df
    schema = kept.select("*", F.col(column).cast("string").alias(out)).schema

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        form = consistent(batch.column(batch.schema.get_field_index(column))).cast(pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, form], [*batch.schema.names, out])

    return map_arrow(spread(kept), work, schema, column)


def look_alike_pairs(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Pairs (``key``_a < ``key``_b) of rows whose texts differ as stored and are equal in their consistent form.

    Texts are compared by 128-bit digests of their stored and their consistent form, made in the map stage, so that no text
    is shuffled. Only forms with at least two stored spellings are kept, so a large group of exact copies of one text
    costs a row each and joins with nothing. Rows with a null key or text take no part; repeated rows count once; an empty
    text has the form of a text of invisible characters only. The number of rows is what the pairs' definition asks for;
    ``look_alike_groups`` gives one row for each document instead.
    """
    forms = look_alike_groups(docs, key, column)
    a, b = f"{key}_a", f"{key}_b"
    left = forms.select("form", F.col("spelling").alias("spelling_a"), F.col(key).alias(a))
    right = forms.select("form", F.col("spelling").alias("spelling_b"), F.col(key).alias(b))
    return left.join(right, "form").where((F.col("spelling_a") != F.col("spelling_b")) & (F.col(a) < F.col(b))).select(a, b).distinct()


def look_alike_groups(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Rows (``key``, form, spelling) of the texts whose consistent form has more than one stored spelling."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        form = consistent(batch.column(1)).cast(pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), form], ["key", "text", "form"])

    rows = spread(docs.select(F.col(key).cast("long").alias("key"), F.col(column).cast("string").alias("text"))).where("key is not null and text is not null")
    forms = map_arrow(rows, work, "key long, text string, form string", "text").select(
        F.col("key").alias(key), F.md5(F.col("form").cast("binary")).alias("form"), F.md5(F.col("text").cast("binary")).alias("spelling")
    ).distinct()
    several = forms.groupBy("form").agg(F.min("spelling").alias("low"), F.max("spelling").alias("high")).where("low <> high").select("form")
    return forms.join(several, "form", "left_semi")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_pairs(table(spark, sf_dir, "documents"))


def p8_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest and length of every document's consistent form."""
    docs = with_consistent(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return docs.select("doc_id", F.md5(F.col("consistent_text").cast("binary")).alias("form"), F.length("consistent_text").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p8_found": p8_found, "p8_forms": p8_forms}


# The SQL has its own values, so that it shares none with the operator: a text with the same equalities as the consistent form,
# with all look-alikes as Latin letters and accents composed.
_FROM = "асеорхуіјѕһԁԛԝѵӏүАВСЕНІЈКМОРЅТХҮӀԌԚԜѴονρϲϳΑΒΕΗΙΚΜΝΟΡΤΧΥΖϹօոսհզցյՕՍՏԼɡɑёїѐЁЇЀό"
_TO = "aceopxyijshdqwvlyABCEHIJKMOPSTXYIGQWVovpcjABEHIKMNOPTXYZConuhqgjOUSLgaëïèËÏÈó"
_WIDE = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
_NARROW = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def form_sql(column: str) -> str:
    kept = f"regexp_replace({column}, '([\U0001f000-\U0001faff\u2190-\u21ff\u2600-\u27bf\u2b00-\u2bff\ufe0f])\u200d([\U0001f000-\U0001faff\u2190-\u21ff\u2600-\u27bf\u2b00-\u2bff\ufe0f])', '\\1\ue000\\2', 'g')"
    bare = f"regexp_replace({kept}, '[\\x{{AD}}\\x{{34F}}\\x{{61C}}\\x{{180B}}-\\x{{180E}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{2064}}\\x{{2066}}-\\x{{206F}}\\x{{FEFF}}]', '', 'g')"
    spaced = f"regexp_replace({bare}, '[\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', ' ', 'g')"
    return f"nfc_normalize(translate({spaced}, '{_FROM}{_WIDE}', '{_TO}{_NARROW}'))"


SQL: dict[str, str] = {
    "p8_found": f"""with d as materialized (select distinct doc_id, text, {form_sql("text")} form from documents where doc_id is not null and text is not null)
select distinct a.doc_id doc_id_a, b.doc_id doc_id_b from d a join d b on a.form = b.form and a.doc_id < b.doc_id and a.text <> b.text"""
}
assert sys.byteorder == "little"
