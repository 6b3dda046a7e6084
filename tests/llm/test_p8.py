import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("tessera.llm")
from tessera.llm import p8_consistent as p8  # noqa: E402

SCHEMA = "doc_id long, text string, form string, spelling string, key long"


def form(*texts):
    return p8.consistent(pa.array(list(texts), pa.string())).to_pylist()


SAME = [
    ("abc 12", "ａｂｃ １２"),
    ("café naïve", "café naïve"),
    ("state", "sta​te"),
    ("state", "st­ate﻿"),
    ("a b", "a b"),
    ("a b", "a b"),
    ("packet", "pаcket"),
    ("one of", "пne of".replace("п", "о")),
    ("Новый фрагмент", "Нoвый фрaгмент"),
    ("новый", "новый"),
    ("ガ", "ガ"),
    ("Ångström", "Ångström"),
]
DIFFERENT = [("state", "State"), ("naive", "naïve"), ("a b", "a  b"), ("a\nb", "a b"), ("a.", "a"), ("новый", "новыи"), ("👩‍💻", "👩💻"), ("l", "1"), ("k", "к"), ("foo!", "foo！")]


def test_cases():
    for a, b in SAME:
        assert len(set(form(a, b))) == 1, (a, b)
    for a, b in DIFFERENT:
        assert len(set(form(a, b))) == 2, (a, b)
    assert len(p8._FROM) == len(p8._TO) and len(p8._WIDE) == len(p8._NARROW) == 62
    assert form("раз", "привет", "cop") == ["раз", "привет", "cop"]


def test_nulls_slices_and_empty():
    whole = pa.array(["x", None, "", "é", "​", "é"], pa.string())
    assert p8.consistent(whole).to_pylist() == ["x", None, "", "é", "", "é"]
    assert p8.consistent(whole.slice(3)).to_pylist() == ["é", "", "é"]
    assert p8.consistent(pa.array([], pa.string())).to_pylist() == []
    long = "é" * 300_000 + "é" * 10
    assert p8.consistent(pa.array([long])).to_pylist() == ["é" * 300_010]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=30), max_size=8))
def test_stable_and_composed(texts):
    once = form(*texts)
    assert form(*once) == once
    assert [form(t)[0] for t in texts] == once  # a text's form doesn't depend on the batch
    plain = [t for t in texts if all(ord(c) < 0x500 for c in t)]
    assert all(unicodedata.normalize("NFC", x) == x for x in form(*plain))


def test_pairs(spark):
    rows = [(1, "café", "f", "s", 0), (2, "café", "f", "s", 0), (3, "café", "f", "s", 0), (4, "cafe", "f", "s", 0), (5, None, "f", "s", 0), (6, "", "f", "s", 0), (7, "​", "f", "s", 0), (None, "café", "f", "s", 0), (2, "café", "f", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, p8.look_alike_pairs(df).collect())) == [(1, 2), (2, 3), (6, 7)]
    assert p8.look_alike_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    out = p8.with_consistent(df.withColumnRenamed("form", "consistent_text"), "text")
    assert out.columns.count("consistent_text") == 1 and out.count() == len(rows)
