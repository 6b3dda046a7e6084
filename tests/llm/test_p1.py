import pytest

pytest.importorskip("tessera.llm")
from tessera.llm import p1_generated as p1  # noqa: E402

SCHEMA = "file_id long, path string, content string, language string, reasons string"
CODE = "def stitch(a, b):\n    # joins both\n    return a + b\n\n\nclass Ledger:\n    limit = 3\n"
MINIFIED = "(function(e){" + "var a=e.b(1),c=!d;if(a)return c[0];for(var i=0;i<9;i++)f(a,i);g.h=function(x){return x+1};" * 12 + "})();"
TABLE = "TABLE = [\n" + "    12, 55, -9, 1044, 77, 3,\n" * 40 + "]\n"

CASES = [
    ("a/x.py", "# Code generated by maker v1.2.3. DO NOT EDIT.\n" + CODE, {"notice"}),
    ("a/x.py", CODE + "\n# This file was produced automatically by maker; manual changes will be lost.\n", {"notice"}),
    ("a/x.py", "# @generated\n" + CODE, {"notice"}),
    ("a/x.ts", "// Diese Datei wurde von maker erzeugt. Nicht von Hand ändern.\nlet a = 1;\n", {"notice"}),
    ("a/x.go", "// Imported from upstream quux at tag v3.3.19; local patches: none\npackage a\n", {"upstream"}),
    ("a/x.py", "# quux 3.15.26\n# Copyright (c) the quux authors\n" + CODE, {"upstream"}),
    ("a/x.js", "/*! quux v7.0.2 */\nlet a = 1;\n", {"upstream"}),
    ("third_party/quux/x.py", CODE, {"vendored"}),
    ("vendor/quux/x.go", "package a\n", {"vendored"}),
    ("a/x_pb2.py", CODE, {"generated_path"}),
    ("a/XGrpc.java", "class A {}\n", {"generated_path"}),
    ("a/x.js", MINIFIED, {"minified"}),
    ("a/x.py", TABLE, {"data"}),
    ("a/x.py", CODE, set()),
    ("services/vendor/x.py", "# Vendor onboarding rules for our marketplace.\n" + CODE, set()),
    ("third_party_payments/x.py", CODE, set()),
    ("a/generated_at.py", CODE, set()),
    ("a/x.py", "# Hand-written wrapper around generated code.\n" + CODE, set()),
    ("a/x.py", "# Do not edit the generated client by hand; change this template instead.\n" + CODE, set()),
    ("a/x.py", 'BANNER = "// Code generated by maker. DO NOT EDIT."\n' + CODE, set()),
    ("a/x.py", 'def f():\n    """Auto-generated method stub"""\n', set()),
    ("a/x.py", "# Copyright 2024 The Collective. All rights reserved.\n# Use of this source is governed by the licence in the LICENSE file.\n" + CODE, set()),
    ("a/x.py", 'LONG = "' + "many words in one line of text " * 30 + '"\n' + CODE * 12, set()),
    ("a/x.py", "T = [\n    1, 2, 3,\n    4, 5, 6,\n]\n" + CODE * 3, set()),
]


#: Notices as public tools write them; the operator holds words, not these sentences.
NOTICES = """Code generated by protoc-gen-go. DO NOT EDIT.
This file was automatically generated by SWIG (http://www.swig.org).
A Bison parser, made by GNU Bison 3.8.2.
Produced by bison 3.8.2
A lexical scanner generated by flex
Autogenerated by Thrift Compiler (0.13.0)
Generated from Expr.g4 by ANTLR 4.9.3
Generated by Django 4.2 on 2024-01-01 10:00
Generated by Cython 0.29.21
NOTE: This class is auto generated by OpenAPI Generator (https://openapi-generator.tech).
This file is generated by jOOQ.
Meta object code from reading C++ file 'window.h'
Form generated from reading UI file 'window.ui'
Generated using SwiftGen, https://github.com/SwiftGen/SwiftGen
automatically generated by rust-bindgen 0.55.1
This file was generated by the Eclipse Implementation of JAXB, v2.3.7
This class was generated by the JAX-WS RI.
Generated by GNU Autoconf 2.69.
CMAKE generated file: DO NOT EDIT!
This file is autogenerated by pip-compile with Python 3.11
C code produced by gperf version 3.1
This file was generated by json-schema-to-typescript. DO NOT MODIFY IT BY HAND
Code generated by MockGen. DO NOT EDIT.
Generated code -- do not touch
Created by: The Qt Meta Object Compiler version 67
This file has been emitted by a tool; any changes will be overwritten.
Any changes to this file will be lost.
Please do not edit this file manually.
Questo file è stato generato automaticamente da maker.
Este ficheiro foi gerado automaticamente por maker.
Este arquivo é gerado por maker.
Ten plik został wygenerowany automatycznie przez maker.
Ce fichier a été généré automatiquement par maker.
Este archivo fue generado por maker. No editar.
Этот файл создан автоматически программой maker.
此文件由 maker 自动生成，请勿修改
このファイルは maker により自動生成されました
이 파일은 maker에 의해 자동 생성되었습니다""".split("\n")
REMARKS = """The parser is generated by the build from the grammar and checked in twice a year by hand.
Values are generated by the caller and written to disk here.
Generated files live in another folder and are never committed.
Never edit vendored copies; patch them through this shim.
Keep in sync with the auto-generated stubs (see make regen).
This file writes the notice that generated code carries.
Do not edit the order of these calls.
This code is compiled with optimisations when the flag is set.
Created by Jo Smith on 2024-01-01
Built by the platform team.
Do not change this without asking the owners.
This module creates generated stubs for the client.
Files are created from templates by the scaffold command in the next step""".split("\n")


def test_notices_of_public_tools():
    cues = p1._automaton()
    missed = [x for x in NOTICES if p1.notice_reasons(f"# {x}\n" + CODE, cues) != ["notice"]]
    assert len(missed) <= 0.03 * len(NOTICES), missed
    wrong = [x for x in REMARKS if p1.notice_reasons(f"# {x}\n" + CODE, cues)]
    assert not wrong, wrong


def test_long_and_indented_lines_and_series():
    cues = p1._automaton()
    assert p1.notice_reasons("/* Code generated by maker v1.2. DO NOT EDIT. */" + "var a=1;" * 1_500 + "\n", cues) == ["notice"]
    assert p1.notice_reasons("// Code generated by maker v1.2. DO NOT EDIT." + " " + "so it is " * 2_000 + "\n", cues) == ["notice"]
    assert p1.notice_reasons("  // Code generated by maker v1.2. DO NOT EDIT.\n" + CODE, cues) == ["notice"]
    assert p1.notice_reasons("def f():\n    # Code generated by maker v1.2. DO NOT EDIT.\n    return 1\n", cues) == []
    assert p1.shape_reasons("T=[" + "1,22,3," * 12 + "]\n") == [] and p1.shape_reasons("0x12, 0x13, 0x14, 0x15, 0x16, 0x17,\n" * 3) == ["data"]
    fields = "".join(f"ABC_{k} = {k}\n" for k in range(1, 40)) + "".join(f"def get_{k}(b):\n    x = decode(b, {k})\n    return x\n\n" for k in range(1, 40))
    assert p1.shape_reasons(fields) == ["mechanical"]
    assert p1.shape_reasons("".join(f"ABC_{k} = {k}\n" for k in range(1, 9)) + CODE * 4) == []


def test_cases(spark):
    rows = [(k, p, t, "x", "clash") for k, (p, t, _) in enumerate(CASES)]
    got = {r.file_id: set(r.reasons) for r in p1.classify_files(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, (path, text, want) in enumerate(CASES):
        assert got.get(k, set()) == want, (path, text[:60])


def test_edges(spark):
    noticed = "# @generated\nx = 1\n"
    rows = [(1, None, noticed, None, None), (2, "a.py", None, None, None), (3, "a.py", "", None, None), (4, "vendor/a.py", " \n", None, None), (None, "vendor/a.py", "x", None, None), (5, "vendor/a.py", "x", None, None), (5, "vendor/a.py", "x", None, None), (6, "a.py", "x = 1\n" * 400_000 + noticed, None, None)]
    out = p1.classify_files(spark.createDataFrame(rows, SCHEMA))
    assert {r.file_id: r.reasons for r in out.collect()} == {1: ["notice"], 5: ["vendored"], 6: ["notice"]}
    assert p1.hand_written(spark.createDataFrame(rows, SCHEMA)).count() == 0
    assert p1.classify_files(spark.createDataFrame([], SCHEMA)).count() == 0
