import time

import numpy as np
import pytest

from evidentia.operators import syntax as S

FILE = "path string, content string"

PYTHON = '''import os
from pkg.mod import name  # import comment
"""def quoted():
import quoted
"""


class A:
    """def in_doc(): }"""

    def one(self, x=(1,
2)):
        return "def no(): #"  # def neither():

    async def two(self):
        pass

    # def three(): pass


def empty(): ...
x = 'it''s' "a" # "
def last():
    s = """
def still():
    """
    return s
'''
GO = """package main

import (
\t"fmt"
\tx "a/b" // "c/d"
)

// func no() {
func main() {
\tfmt.Println("}", '}', `}
func quoted() {`)
\tif true {
\t}
}
type T struct {
\ta int
}
func (t *T) M(
\ta int,
) int {
\treturn 1 }
type Short int
"""
SCRIPT = """import a from './a.js';
/* import b from './b.js';
function no() { */
export async function one(x) { return `}${x}
function quoted() {`; }
class B
{
  m() { if (x) { return '{'; } }
}
const f = (x) => {
  return 1;
};
const g = x => x;
const s = "const t = require('z')"; const u = require('u');
"""


def facts(spark, path, content):
    rows = S.tree_facts(spark.createDataFrame([(path, content)], FILE)).collect()
    return sorted((r.kind, r.line_start, r.line_end, r.name) for r in rows)


def test_python(spark):
    assert facts(spark, "m.py", PYTHON) == [
        ("definition", 8, 16, "A"), ("definition", 11, 13, "one"), ("definition", 15, 16, "two"), ("definition", 21, 21, "empty"), ("definition", 23, 27, "last"),
        ("import", 1, 1, "os"), ("import", 2, 2, "pkg.mod"),
    ]


def test_go(spark):
    assert facts(spark, "m.go", GO) == [
        ("definition", 9, 14, "main"), ("definition", 15, 17, "T"), ("definition", 18, 21, "M"), ("definition", 22, 22, "Short"), ("import", 4, 4, "fmt"), ("import", 5, 5, "a/b"),
    ]


def test_script(spark):
    assert facts(spark, "m.js", SCRIPT) == [
        ("definition", 4, 5, "one"), ("definition", 6, 9, "B"), ("definition", 10, 12, "f"), ("definition", 13, 13, "g"), ("import", 1, 1, "./a.js"), ("import", 14, 14, "u"),
    ]


def test_lua_elixir_and_shell(spark):
    lua = "local function f(x)\n  if x then -- end\n    g(function() return 'end' end)\n  end\nend\nfunction m.g() return 1 end\n"
    assert facts(spark, "m.lua", lua) == [("definition", 1, 5, "f"), ("definition", 6, 6, "m.g")]
    elixir = "defmodule A.B do\n  def f(x), do: x\n  def g(x) do\n    if x do\n      1 # end\n    end\n  end\nend\n"
    assert facts(spark, "m.ex", elixir) == [("definition", 1, 8, "A.B"), ("definition", 2, 2, "f"), ("definition", 3, 7, "g")]
    assert facts(spark, "m.sh", "f() {\n  echo '}' # }\n}\nfunction g\n{\n}\n") == [("definition", 1, 3, "f"), ("definition", 4, 6, "g")]


@pytest.mark.parametrize(("path", "content", "code"), [
    ("a.py", "x = '''a\nb''' # c\n'd", "x = \"   \n        \n\" "),
    ("a.js", "a /* b\nc */ d // e\n`f\n'g`", "a     \n     d     \n\" \n   "),
    ("a.rs", "fn f<'a>(c: char) { '{' }", "fn f<'a>(c: char) { \"   }"),
    ("a.sh", "echo $# # {\n# x", "echo $#    \n   "),
    ("a.lua", "a --[[ {\n]] b -- c", "a       \n   b     "),
    ("a.go", "`\\`{", "\"  {"),
    ("a.c", '"unfinished {\n}', '"            \n}'),
    ("a.py", '"""never closed {\n}', '"                \n '),
    ("a.js", "", ""),
])
def test_strings_and_comments_are_no_code(spark, path, content, code):
    rows = S.code_lines(spark.createDataFrame([(path, content)], FILE)).orderBy("line_no").collect()
    assert "\n".join(r.code for r in rows) == code and "\n".join(r.line for r in rows) == content


def test_nesting_and_unbalanced_braces(spark):
    text = "}\nfunc a() {\n(\n[{\n}])\n"
    rows = S.nesting(S.code_lines(spark.createDataFrame([("a.go", text), ("b.txt", "{"), ("c.go", None)], FILE))).orderBy("path", "line_no").collect()
    assert [(r.path, r.depth_before, r.depth) for r in rows] == [("a.go", 0, -1), ("a.go", -1, 0), ("a.go", 0, 1), ("a.go", 1, 3), ("a.go", 3, 0), ("a.go", 0, 0), ("c.go", 0, 0)]
    assert facts(spark, "a.go", text) == [("definition", 2, 6, "a")]


def test_other_rows(spark):
    assert S.tree_facts(spark.createDataFrame([], FILE)).collect() == []
    assert S.tree_facts(spark.createDataFrame([(None, "def f(): pass"), ("x.unknown", "def f(): pass"), ("x.py", None)], FILE)).collect() == []


def test_next_at_most_equals_a_plain_search():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 200):
        x = rng.integers(0, 6, n)
        assert S.next_at_most(x).tolist() == [next((j for j in range(i + 1, n) if x[j] <= x[i]), n) for i in range(n)]


def test_long_files_and_lexemes_take_linear_time(spark):
    text = "".join(f"function f{i}(a) {{\n  return '{'x' * 20}';\n}}\n" for i in range(30_000)) + "/*" + "{" * 300_000 + "*/ `" + "\\`" * 100_000 + "`"
    flat = "".join(f"def f{i}():\n  pass\n" for i in range(45_000)) + '"""' + "\\x" * 200_000
    df = spark.createDataFrame([("a.js", text), ("a.py", flat)], FILE)
    S.definitions(df.limit(1)).count()
    began = time.time()
    assert S.definitions(df).filter("line_end > line_start").count() == 75_000
    assert time.time() - began < 40
