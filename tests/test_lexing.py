"""Token-based imports and spans: against ``ast`` on the standard library, and golden JS/TS cases."""

import ast
import glob
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from srcatlas.functions import lexing as L
from srcatlas.operators import chunk, definitions, imports


def by_ast(text):
    """(spans, imports in discovery order) of a Python file, from Python's own parser."""
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)

    def at(line, col):                           # ast counts columns in bytes
        return starts[line - 1] + len(lines[line - 1].encode()[:col].decode())

    spans, found = set(), []
    for x in ast.walk(ast.parse(text)):
        if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(x, ast.ClassDef) else "function"
            spans.add((at(x.lineno, x.col_offset), at(x.end_lineno, x.end_col_offset), kind, x.name))
        elif isinstance(x, ast.Import):
            found.append((-at(x.lineno, x.col_offset), [a.name for a in x.names]))
        elif isinstance(x, ast.ImportFrom) and x.module and (x.module, x.level) != ("__future__", 0):
            found.append((-at(x.lineno, x.col_offset), [x.module]))
    return spans, [n for _, names in sorted(found, key=lambda f: f[0]) for n in names]


def test_python_equals_ast_on_the_standard_library():
    files = sorted(glob.glob(os.path.join(os.path.dirname(ast.__file__), "*.py")))
    assert len(files) > 50
    for f in files:
        with open(f, encoding="utf-8", errors="replace") as h:
            text = h.read()
        spans, found = by_ast(text)
        assert set(L.python_spans(text)) == spans, f
        assert L.python_imports(text) == found, f


@pytest.mark.parametrize("code, want", [
    ("import a; import b", ["b", "a"]), ("if x: import late", ["late"]), ("try: import z\nexcept E: from . import y", ["z"]),
    ("import c, \\\n  d as e", ["c", "d"]), ("from .m import (a,\n b)\nfrom .. import q\nfrom ...p.q import r", ["p.q", "m"]),
    ("'''\nimport notreal\n'''\n# import no\nx = 'import no'\nfrom __future__ import x\nimport __future__", ["__future__"]),
    ("def f():\n  yield from x\n  raise A from b\n  from z import *", ["z"]), ("# it's \"\"\" fine\nimport ünï.cödé", ["ünï.cödé"]),
    ("x = (1,\nimport after_an_open_bracket", ["after_an_open_bracket"]), ("class A: import inner", ["inner"]),
    ("s = f'{x}'; from a import b\r\nimport c", ["c", "a"]), ("important = 1\nimport_ = 2", []), (None, []), ("", [])])
def test_python_import_forms(code, want):
    assert L.imports_of(code, "python") == want


@pytest.mark.parametrize("code, want", [
    ("import{b}from'./b'", ["./b"]), ("import*as c from \"c\"", ["c"]), ("import a from 'a';import b from 'b'", ["b", "a"]),
    ("import type {T} from './t'", ["./t"]), ("import './s.css'", ["./s.css"]), ("export * from './c'", []),
    ("const d=import('./d')", []), ("import x = require('./y')", []), ("import x, {\n a as b,\n} from '../m'", ["../m"]),
    ("const a=require('a'),b=require('./b',1,'c')", ["./b", "c", "a"]), ("import x from 'x' with { type: 'json' }", ["x"]),
    ("// import x from 'no'\n/* import y from 'no' */ s = \"import z from 'no'\"; t=`require('no') ${require('yes')}`", ["yes"]),
    ("foo.require('no'); require.resolve('no'); require(`no`); new require('no'); require(x + 'no')", []),
    ("const re = /require('no')/; if (a / b / require('yes')) x", ["yes"]), ("import.meta.url; import x", []),
    ("import {'odd name' as y} from 'z'", ["z"]), ("it's unclosed\nimport a from 'a'", ["a"])])
def test_script_import_forms(code, want):
    assert L.imports_of(code, "typescript") == want == L.imports_of(code, "javascript")


def spans(code, language="typescript", **options):
    return [(s.kind, s.name, code[s.start:s.end]) for s in sorted(L.spans_of(code, language, **options))]


@pytest.mark.parametrize("code, want", [
    ("export async function f(\n a,\n {b}) {\n  return /[/}]\\}/.test(a)\n}\nx", [("function", "f", "async function f(\n a,\n {b}) {\n  return /[/}]\\}/.test(a)\n}")]),
    ("const g = /\\{/; function h() { return 1 }", [("function", "h", "function h() { return 1 }")]),
    ("function* gen() {} const e = function named() {}; export default function () {}", []),
    ("function over(a: string): void;\nfunction over(a: any): a is {x: 1} { return true }", [("function", "over", "function over(a: any): a is {x: 1} { return true }")]),
    ("@Dec({a: 1})\nclass A<T extends {a: 1}> extends B<T> { }", [("class", "A", "@Dec({a: 1})\nclass A<T extends {a: 1}> extends B<T> { }")]),
    ("const C = class Named { m() { } }", [("function", "m", "m() { }")]),
    ("abstract class A { abstract m(): void; n(): {a: 1} { return x } }", [("function", "n", "n(): {a: 1} { return x }")]),
    ("class A { static async *g<T>(x: T): X<T> { } get y() { } ['c' + 1]() { } #p() { } 'q'() { } a = () => b\n z?(): void { } }",
     [("class", "A", None), ("function", "g", "static async *g<T>(x: T): X<T> { }"), ("function", "y", "get y() { }"),
      ("function", "anonymous", "['c' + 1]() { }"), ("function", "anonymous", "#p() { }"), ("function", "anonymous", "'q'() { }"),
      ("function", "b", "() => b"), ("function", "z", "z?(): void { }")]),
    ("const o = { m(x) { return x }, get p() { return 1 }, q: function(x) { }, r: (x) => { }, s: foo(x) }",
     [("function", "m", "m(x) { return x }"), ("function", "p", "get p() { return 1 }"), ("function", "anonymous", "(x) => { }")]),
    ("const {a, b} = ({x}, [y]) => x + y, c = 1", [("function", "anonymous", "({x}, [y]) => x + y")]),
    ("const f: (a: number) => string = (a) => String(a)", [("function", "anonymous", "(a) => String(a)")]),
    ("const f = (a: number): string => a ? b : c, g = async x => await x", [("function", "anonymous", "(a: number): string => a ? b : c"), ("function", "x", "async x => await x")]),
    ("const t = c ? (a) => x : (b) => y", [("function", "x", "(a) => x"), ("function", "y", "(b) => y")]),
    ("const p = (s) => s.items\n  .map(e => e.id)\nconst q = 1", [("function", "anonymous", "(s) => s.items\n  .map(e => e.id)"), ("function", "e", "e => e.id")]),
    ("const g = <T extends object>(a: T) => a", [("function", "a", "<T extends object>(a: T) => a")]),
    ("x = y as (a: string) => void; function z(cb: (n: number) => void, d?: () => X) { }", [("function", "z", "function z(cb: (n: number) => void, d?: () => X) { }")]),
    ("type U =\n  | { f: (x: number) => void }\n  | string\nconst a = 1", [("type", "U", "type U =\n  | { f: (x: number) => void }\n  | string")]),
    ("export type G<T> = { [K in keyof T]: Record<\n string,\n T[K]\n> };", [("type", "G", "type G<T> = { [K in keyof T]: Record<\n string,\n T[K]\n> };")]),
    ("interface I<T> extends J<(a: string) => void> { m(a: number): string; n: () => void }", [("type", "I", None)]),
    ("const s = `a ${[1].map(v => `{${v}`)} function no() {}`", [("function", "v", "v => `{${v}`")]),
    ("if (type == 1) { type = 2 } class\n", [])])
def test_script_spans(code, want):
    assert [(k, n) for k, n, _ in spans(code)] == [(k, n) for k, n, _ in want]
    assert all(text is None or text == got for (_, _, text), (_, _, got) in zip(want, spans(code)))


def test_abstract_classes_are_an_option():
    code = "export abstract class A { n() { } }"
    assert [n for _, n, _ in spans(code)] == ["n"]
    assert [n for _, n, _ in spans(code, abstract_classes=True)] == ["A", "n"]
    assert spans("interface I { a: 1 }\ntype T = 1", "javascript") == []


def test_broken_code_never_fails():
    rng = random.Random(0)
    bits = ["(", ")", "{", "}", "[", "]", "=>", "`", "${", "'", '"', "/", "class A", "function f", "type X =", "<", ">", ":", "?",
            "import", "from", "def g(", "\n", "    ", "x", ",", ";", '"""', "@d", "async ", "interface I"]
    for _ in range(4000):
        code = "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))
        for language in ("python", "javascript", "typescript"):
            for s in L.spans_of(code, language):
                assert 0 <= s.start < s.end <= len(code)
            L.imports_of(code, language)
    started = time.time()
    for bit in ["(", "{", "x:(", "a:{", "<", "x=>", "`${", "?:", "(a)=>", "type a<"]:
        L.spans_of(bit * (50_000 // len(bit)), "typescript")
    assert time.time() - started < 60


FILES = "repo_name string, rel_path string, language string, content string"


def test_chunks_of_spans(spark):
    code = "import x\n" + "def f(a):\n" + "".join(f"    a = a + {i}\n" for i in range(400)) + "    return a\n" + "class K:\n    pass\n"
    files = spark.createDataFrame([("r", "a.py", "python", code), ("r", "b.py", "python", ""), ("r", "c.py", "python", None),
                                   ("r", "d.ts", "typescript", "a\x0cb\nfunction long_enough_to_stay(first, second) { return 1 }")], FILES)
    one = {r.name: r for r in definitions.definition_chunks(files).collect()}
    assert set(one) == {"f", "long_enough_to_stay"} and one["f"].text == code[9:3009] + "\n... [truncated]"
    assert (one["f"].start_line, one["f"].end_line) == (2, 403) and one["long_enough_to_stay"].start_line == 2
    split = [r for r in chunk.chunk_files(files, split_long=True).orderBy("chunk_id").collect() if r.name == "f"]
    whole = code[9:code.index("class K")].rstrip("\n")
    assert "".join(r.text for r in split) == whole and max(len(r.text) for r in split) <= 3000
    assert [r.start_line for r in split[1:]] == [r.end_line + 1 for r in split[:-1]] and split[-1].end_line == 403


def test_splitter_replaces_the_spans(spark):
    files = spark.createDataFrame([("r", "a.py", "python", "x" * 60 + "\n" + "y" * 60)], FILES)
    got = definitions.definition_chunks(files, splitter=lambda text, language: [(0, 60, language, "one"), (61, 121, "k", "two")])
    assert [(r.name, r.chunk_type, r.start_line) for r in got.collect()] == [("two", "k", 2), ("one", "python", 1)]


def test_import_order_has_no_limit(spark):
    names = ", ".join(f"m{i}" for i in range(3000))
    files = spark.createDataFrame([("r", "a.py", "python", f"import {names}\nimport last")], FILES)
    got = imports.extract_imports(files).orderBy("import_ord")
    assert [r.import_path for r in got.collect()] == ["last"] + [f"m{i}" for i in range(3000)]
    assert got.select(F.countDistinct("import_ord")).first()[0] == 3001
