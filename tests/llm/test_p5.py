import ast
import glob
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("tessera.llm")
from tessera.llm import p5_syntax as p5  # noqa: E402

SCHEMA = "file_id long, repo_id string, path string, language string, content string, reason string"

VALID = {
    "python": 'x = """<<<<<<< HEAD\n((("""\nif x:\n    y = {"a": [1, (2)]}\n',
    "go": 'package a\n\nimport (\n\t"b/c"\n)\n\nfunc f(a int, b []string) error {\n\tif a > 5 {\n\t\treturn nil\n\t}\n\ts := `raw " ( `\n\tr := \'"\'\n\t_ = s + string(r)\n\treturn nil\n}\n',
    "java": 'package a.b;\n\nimport java.util.List;\n\n@Deprecated\npublic final class A<T> extends B implements C {\n    private static final String S = "((( \\" [";\n    char c = \'{\';\n    public A(int x) {\n        this.x = x > 1 ? 2 : 3;\n    }\n    int f(List<String> a) throws E {\n        for (var q : a) {\n            log.info("x");\n        }\n        return 1;\n    }\n}\n',
    "rust": "use a::b::C;\n\n#[derive(Debug)]\npub struct A<'a> {\n    x: &'a str,\n}\n\nimpl<'a> A<'a> {\n    pub fn f(&self, c: char) -> Option<u64> {\n        /* a /* nested */ comment */\n        let r = r#\"a \" ( \"#;\n        let q = if c == '\\'' { 1 } else { 2 };\n        info!(\"{}\", q);\n        Some(q)\n    }\n}\n",
    "c": "#include <a.h>\n#ifdef A\nint f(int a) {\n#else\nint f(long a) {\n#endif\n    char c = '\"';\n    // don't\n    struct b *p = (struct b *)a;\n    return a + c;\n}\n",
    "cpp": "#include <string>\n\nnamespace a {\n\ntemplate <typename T>\nclass B : public C {\n public:\n    explicit B(int x) : x_(x) {}\n    const std::string s = R\"x(a \" ( )x\";\n private:\n    int n = 1'000;\n};\n\n}  // namespace a\n",
    "javascript": 'import { a } from "./b";\nconst b = require("c");\nconst r = /[/"\'(]+/g.test(b);\nconst t = `x ${a ? `y ${b}` : "z"} ((`;\nclass C extends D {\n  static #p = 1;\n  async f(x, y) {\n    for (const q of x) {\n      y = q / 2 / 3;\n    }\n    return { x: y ? 1 : 2 };\n  }\n}\nexport default C;\n',
    "typescript": "export interface A {\n  readonly x: number;\n}\nexport abstract class B<T extends A> {\n  private x: string[] = [];\n  f(a: number, b?: string): Promise<void> {\n    const c = a as unknown as T;\n    return c;\n  }\n}\ntype C = A | { y: keyof A };\n",
}
BROKEN = {
    "go": ['package a\n\nfunc f() {\n', "class A {\n}\n", 'package a\n\nvar s = "x\n', "package a\n\nfunc f() {\n<<<<<<< HEAD\n\ta()\n=======\n\tb()\n>>>>>>> x\n}\n", "# A title\n\nSome words of prose here.\n"],
    "java": ["package a;\nclass A {\n  int f() {\n    return (1;\n  }\n}\n", "def f(x):\n    return x\n", '#include <a>\nint f() { return 1; }\n', 'class A { String s = "x; }\n', "function f(a) {\n  let b = a;\n}\n", "/* open\nclass A {}\n"],
    "rust": ["fn f() {\n", "import a from b\n", "package a;\n\npublic class A {}\n", 'fn f() { let s = "open; }\n', "const A = 5;\n"],
    "c": ["int f() {\n", "package a\n\nfunc f() {}\n", "int f(void) { char *s = \"x; }\n", "class A:\n    pass\n", "namespace a { int b; }\n", "The lower shelf shows that every third box is empty.\n"],
    "cpp": ["class A {\n", "int f() { return 1; }}\n", "use a::b;\nfn f() {}\n", "diff --git a/x b/x\nindex 936b1c8..e0ce4bb 100644\n--- a/x\n+++ b/x\n"],
    "javascript": ["function f( {\n", "const a = `open ${1}\n", "public class A {\n}\n", "def f(x):\n    return x\n", "function f(a: string): number {\n  return 1;\n}\n", "const a = 1;\n<%= render :b %>\n", "{{ cookie.slug }} = {{ 1 2\n", "let x = \n", "Some words of prose here.\n"],
    "typescript": ["class A {\n", "use a::b;\n", 'const a = "x\n', "package a\n\nfunc f() {}\n"],
    "python": ["def f(:\n", "if x\n    y\n", "x = '''open\n", "package a\n", "def f():\n", "x = (1,\n"],
}


def test_cases():
    for language, text in VALID.items():
        assert p5.fault(text, language) is None, (language, p5.fault(text, language))
        assert p5.fault(text.replace("\n", "\r\n"), language) is None, language
    for language, texts in BROKEN.items():
        for text in texts:
            assert p5.fault(text, language), (language, text)


def test_prefixes_of_valid_texts_inside_brackets_are_broken():
    for language in ("go", "java", "rust", "cpp", "typescript"):
        text = VALID[language]
        cut = text.rindex("}")
        assert p5.fault(text[:cut], language), language


def _valid(text):
    try:
        ast.parse(text)
        return True
    except (SyntaxError, ValueError):
        return False


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abif()[]{}:=\"'#\n \\0+,", max_size=40))
def test_valid_python_is_never_reported(text):
    """The interpreter's parser is the reference of the test; the operator doesn't use it."""
    if _valid(text):
        assert p5.fault(text, "python") is None


def test_python_against_the_parser():
    """Real modules and edits of them: no false alarm, and nearly all that the parser refuses."""
    rng = random.Random(7)
    files = sorted(glob.glob(os.path.dirname(os.__file__) + "/*.py"))[:120]
    refused = found = 0
    for path in files:
        text = open(path, encoding="utf-8").read()
        assert p5.fault(text, "python") is None, path
        for _ in range(3):
            at = rng.randrange(len(text))
            edited = text[:at] + text[at + rng.choice((1, 1, 3, len(text))) :]
            if _valid(edited):
                assert p5.fault(edited, "python") is None, (path, at)
            else:
                refused += 1
                found += p5.fault(edited, "python") is not None
    assert refused > 100 and found >= 0.97 * refused


def test_operands_and_macros():
    for language, text in {"java": "class A { int x = ; }", "go": "package a\n\nfunc f() {\n\tx := }\n", "javascript": "let a = 1 +* 2;\n"}.items():
        assert p5.fault(text, language), language
    for text in ("class A { int f() { return 1 } }", "abstract class A { abstract void f(int); }", "class A { void f() { if () { g(); } } }"):
        assert p5.fault(text, "java"), text
    for text in ("extern MYLIB_API my_type MYLIB_CALL name(void);\n", "#define A(x) /* why */ \\\n  do { x; \\\n  } while (0)\nint a;\n", "EXPORT( int )\nf( int a );\n"):
        assert p5.fault(text, "c") is None, p5.fault(text, "c")
    assert p5.fault("auto operator<=>(const A& a) const = default;\n", "cpp") is None


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(sorted([*p5.LEXERS, "python"])), st.text(alphabet="ab(){}[]\"'`/*\\\n $#<>=;:r", max_size=60))
def test_never_breaks(language, text):
    p5.fault(text, language)


def test_table(spark):
    good = VALID["go"]
    rows = [(1, "r", "a.go", "golang", good, "x"), (2, "r", "a.go", None, "package a\n(", "x"), (2, "r", "a.go", None, "package a\n(", "x"), (3, "r", "a.py", "PYTHON", "x = (", "x"), (4, "r", "a.txt", None, "x = (", "x"), (5, "r", "a.go", None, None, "x"), (6, "r", "a.go", None, "", "x"), (None, "r", "a.go", None, "(", "x"), (7, None, None, "go", "(", "x"), (8, "r", "a.java", "java", "class A {" + "int a() { return 1; }\n" * 30_000 + "}", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.file_id for r in p5.invalid_files(df).collect()} == {2, 3, 7}
    meta = spark.createDataFrame([("r", "a.go", 3), ("r", "a.go", 3)], "repo_id string, path string, num_chunks int")
    got = {(r.repo_id, r.language): (r.files, r.invalid, r.invalid_with_chunks) for r in p5.invalid_rates(df, meta).collect()}
    assert got[("r", "go")] == (2, 1, 1) and got[("r", "python")] == (1, 1, 0) and got[(None, "go")] == (1, 1, 0)
    assert p5.invalid_files(spark.createDataFrame([], SCHEMA)).count() == 0
