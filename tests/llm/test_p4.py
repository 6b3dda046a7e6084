import pytest

pytest.importorskip("tessera.llm")
from tessera.llm import p4_docs as p4  # noqa: E402

SCHEMA = "parsed_id long, repo_id string, file_path string, symbol_name string, symbol_type string, signature string, docstring string, body string, start_line int, end_line int, language string, description string, levels int"

GOOD = [
    "Returns the number of rows that were read so far.",
    "// Skips any pallet whose verdict is folded.",
    "/**\n * Older clients still prune the ladder, so the flag stays.\n *\n * @param x the row\n */",
    "True if a row may be read twice.\n\n:param x: the row",
    "Новый узел считает свой общий шаблон.",
    "古い要求は応答を調べる。",
    "Reads the next row from the open file.\n\n    # with a remark\n    and a second line of words",
]
BAD = [
    "TODO", "FIXME: document", "todo: write docs", "----------", "noqa: D103", "// eslint-disable-next-line", "{@inheritDoc}", "See base class.", "See the base class for what this does.",
    "Function read_next_row.", "This is read next row.", "The read next row function.", "read_next_row()", "/** @private */", ":param a: the first of them\n:param b: the second\n:return:",
    "Args:\n    first_row:\n    last_row: the row shallow", "Parameters\n----------\nfirst_row", "SPDX-License-Identifier: LicenseRef-A\n(c) 2023 A Works", "Copyright 2024 The Collective. All rights reserved.\nUse of this source is governed by the licence in the LICENSE file.",
    "// let a = read(b, 12);\n// a.close();\n// // before the lock closes\n// return a;", "Auto-generated method stub", "No description.", "first_row: a row shallow",
]


def test_descriptions():
    for doc in GOOD:
        assert p4.description(doc, "read_next_row", "def read_next_row(x)")[0], doc
    for doc in BAD:
        assert not p4.description(doc, "read_next_row", "def read_next_row(first_row, last_row)")[0], doc


def test_opening_of_bodies():
    assert "doc" in p4.opening('def f(a: int) -> int:\n    """a doc"""\n    return a\n')
    assert "doc" in p4.opening("func f(a int) int {\n\t// a doc\n\t// of two lines\n\treturn a\n}")
    assert "doc" in p4.opening("int f(int a)\n{\n    /* a doc */\n    return a;\n}")
    assert "doc" in p4.opening("// a doc\nfn f() {}\n")
    assert not p4.opening("func f(a int) int {\n\tb := a\n\t// not at the start\n\treturn b\n}")
    assert not p4.opening("")


def _row(i, name, kind, doc, body, start=1, end=2, signature=None, path="a.java"):
    return (i, "r", path, name, kind, signature, doc, body, start, end, "java", "clash", 9)


def test_found_and_edges(spark):
    rows = [
        _row(1, "f", " Function ", GOOD[0], "x"), _row(1, "f", " Function ", GOOD[0], "x"), _row(2, "f", "class", GOOD[0], "x"), _row(3, "f", None, GOOD[0], "def f():\n    pass", signature="def f()"),
        _row(4, "C", None, GOOD[0], "class C:\n    pass", signature="class C"), _row(5, "f", "METHOD", " \n", "void f() {\n  // Reads the next of all rows here.\n}"), _row(6, None, "method", GOOD[1], None), _row(None, "f", "method", GOOD[0], "x"),
        _row(7, "f", "method", None, None), _row(8, "f", "constructor", "", ""), _row(9, "f", "file", GOOD[0], "x"), _row(10, "f", "method", GOOD[0] + " more" * 100_000, "x"),
    ]
    got = {r.parsed_id for r in p4.pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1, 3, 5, 6, 10}
    assert p4.pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_inheritance(spark):
    rows = [
        _row(1, "Base", "class", None, "class Base {", 1, 20), _row(2, "read", "method", GOOD[0], "void read() {}", 2, 4),
        _row(3, "Middle", "class", None, "class Middle extends Base {", 1, 20, path="b.java"),
        _row(4, "Leaf", "class", None, "class Leaf extends Middle implements Other {", 1, 20, path="c.java"), _row(5, "read", "method", "{@inheritDoc}", "void read() {}", 2, 4, path="c.java"),
        _row(6, "write", "method", "", "void write() {}", 6, 8, path="c.java"), _row(7, "A", "class", None, "class A extends B {", 1, 9, path="d.java"), _row(8, "B", "class", None, "class B extends A {", 1, 9, path="e.java"),
        _row(9, "go", "method", None, "void go() {}", 2, 3, path="d.java"),
    ]
    got = {r.parsed_id: (r.description, r.levels) for r in p4.pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {2: (GOOD[0], 0), 5: (GOOD[0], 2)}
    assert p4.parents_of("class A(B, mod.C)", "class A(B, mod.C):\n") == ["B", "C"]
    assert p4.parents_of(None, "impl Shape for Circle {") == ["Shape"]


def test_planted_hierarchies(spark):
    """20 levels, the nearest overriding one first, a circle, and classes of one name in other files and languages."""
    rows = []
    for k in range(20):
        rows += [_row(100 + k, f"L{k}", "class", None, f"class L{k}" + (f" extends L{k - 1}" if k else "") + " {", 1, 30, path=f"p/l{k}.java"), _row(200 + k, "read", "method", GOOD[0] if k in (0, 7) else "", "void read() {}", 2, 4, path=f"p/l{k}.java")]
    rows += [_row(300, "write", "method", GOOD[1], "void write() {}", 6, 8, path="p/l0.java"), _row(301, "write", "method", "", "void write() {}", 6, 8, path="p/l19.java")]
    # two classes named Box: the one in the same file counts, then the one in the same folder; a Python class of the name never
    rows += [_row(400, "Box", "class", None, "class Box {", 1, 9, path="a/x.java"), _row(401, "open", "method", "Opens the lid of this box slowly.", "void open() {}", 2, 3, path="a/x.java")]
    rows += [_row(410, "Box", "class", None, "class Box {", 1, 9, path="b/x.java"), _row(411, "open", "method", "Unwraps the content of another parcel.", "void open() {}", 2, 3, path="b/x.java")]
    rows += [_row(420, "Crate", "class", None, "class Crate extends Box {", 11, 19, path="b/x.java"), _row(421, "open", "method", "", "void open() {}", 12, 13, path="b/x.java")]
    rows += [_row(430, "Tin", "class", None, "class Tin extends Box {", 1, 9, path="a/y.java"), _row(431, "open", "method", "", "void open() {}", 2, 3, path="a/y.java")]
    other = lambda r: r[:10] + ("python",) + r[11:]
    rows += [other(_row(440, "Lid", "class", None, "class Lid(Box):", 1, 9, path="a/z.py")), other(_row(441, "open", "method", "", "def open(self):", 2, 3, path="a/z.py"))]
    got = {r.parsed_id: (r.description, r.levels) for r in p4.pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {200 + k: (GOOD[0], k if k < 7 else k - 7) for k in range(20)}
    want |= {300: (GOOD[1].removeprefix("// "), 0), 301: (GOOD[1].removeprefix("// "), 19)}
    want |= {401: ("Opens the lid of this box slowly.", 0), 411: ("Unwraps the content of another parcel.", 0), 421: ("Unwraps the content of another parcel.", 1), 431: ("Opens the lid of this box slowly.", 1)}
    assert got == want


def test_kind_by_a_long_head():
    """What stands before a head and how long it is doesn't matter."""
    params = ", ".join(f"int number{k}" for k in range(80))
    for lead in ("", "/* " + "says a lot; " * 60 + "*/\n", "// one more line {}\n" * 40, '@Route(path = "/x", more = f(1))\n' * 20):
        assert p4.kind_of(None, None, f"{lead}int sum({params}) {{\n  return 0;\n}}") == "function"
        assert p4.kind_of(None, None, f"{lead}public class Sum {{\n}}") == "class"
        assert p4.kind_of(None, None, f"{lead}x = {{1; 2}}") is None
