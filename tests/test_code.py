"""Elements, calls, imports and edges of a small repository."""

import random

import pytest

from pyspark.sql import functions as F

from loomwork.operators import path_index
from loomwork.sources import python_code

FILES = {
    "pkg/util.py": 'def helper(x):\n    """Doc."""\n    return len(x)\n',
    "pkg/base.py": "class Base:\n    def run(self):\n        return self.run()\n",
    "pkg/sub.py": "from pkg.util import helper\nfrom .base import Base\n\nclass Child(Base):\n    def go(self):\n        return helper([1])\n",
    "main.py": "import pkg.sub\nfrom pkg.sub import Child\n\ndef helper():\n    pass\n\ndef main():\n    Child().go()\n",
    "bad.py": "def broken(:\n",
    ".hidden/x.py": "def no(): pass\n",
}


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for name, code in FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(code)
    return str(root), python_code.read_code(spark, str(root)).cache()


def test_rows(rows):
    root, df = rows
    got = {(r["path"].removeprefix(root + "/"), r["kind"], r["name"]) for r in df.collect()}
    assert {g for g in got if g[1] != "file"} == {
        ("pkg/util.py", "function", "helper"), ("pkg/base.py", "class", "Base"), ("pkg/base.py", "method", "run"), ("pkg/base.py", "call", "run"), ("pkg/sub.py", "class", "Child"),
        ("pkg/sub.py", "method", "go"), ("pkg/sub.py", "base", "Base"), ("pkg/sub.py", "call", "helper"), ("pkg/sub.py", "import", "pkg.util"), ("pkg/sub.py", "import", "base"),
        ("main.py", "import", "pkg.sub"), ("main.py", "function", "helper"), ("main.py", "function", "main"), ("main.py", "call", "Child"), ("main.py", "call", "go"),
    }
    assert len([g for g in got if g[1] == "file"]) == 5
    assert {r["detail"] for r in df.where("name = 'helper' and kind = 'function'").collect()} == {"Doc.", None}


def test_edges(rows):
    root, df = rows
    names = {r["id"]: (r["path"].removeprefix(root + "/"), r["name"]) for r in df.where("kind not in ('call', 'import', 'base')").collect()}
    got = {(names[r["src_id"]], names[r["dst_id"]], r["kind"]) for r in python_code.build_edges(df, root).collect()}
    sub, go = ("pkg/sub.py", "sub.py"), ("pkg/sub.py", "go")
    assert (go, ("pkg/util.py", "helper"), "Calls") in got  # the imported one, not main's
    assert {g for g in got if g[2] == "Inherits"} == {(("pkg/sub.py", "Child"), ("pkg/base.py", "Base"), "Inherits")}
    assert (sub, ("pkg/base.py", "base.py"), "Imports") in got and (sub, ("pkg/util.py", "util.py"), "Imports") in got and (("main.py", "main.py"), sub, "Imports") in got
    assert (("pkg/base.py", "run"), ("pkg/base.py", "run"), "Calls") not in got
    assert len([g for g in got if g[2] == "Defines"]) == 7


def test_path_index(spark):
    """Every pair, against a comparison of all with all."""
    rng = random.Random(4)
    paths = ["/".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 5))) + ".py" for _ in range(300)]
    needles = [p[rng.randrange(len(p)) :][: rng.randrange(1, 12)] for p in paths[:150]] + ["zzz", "abcabcabcabc", ".py", "/"]
    p = spark.createDataFrame([(x,) for x in [*paths, paths[0], None, ""]], "path string")
    n = spark.createDataFrame([(x,) for x in [*needles, needles[0], None, ""]], "needle string")
    want = {(x, y) for x in needles if x for y in paths if x in y}
    got = [tuple(r) for r in path_index.pairs(p, n).collect()]
    assert set(got) == want and len(got) == len(want)
    assert {tuple(r) for r in path_index.first_containing(p, n).collect()} == {(x, min(y for y in paths if x in y)) for x, _ in want}
    assert path_index.pairs(p.limit(0), n).count() == 0


def test_guessed_edges(spark):
    """Imports by name, last segment and path; calls by a path that contains an imported name."""
    files = {
        "app/main.py": "import only_function\nimport lib.Widget\nimport deep.store\nimport nowhere\nfrom ..far import thing\n\ndef go():\n    load()\n    thing()\n",
        "src/deep/store_impl.py": "def load():\n    pass\n",
        "src/aaa/other.py": "def load():\n    pass\n\ndef only_function():\n    pass\n\nclass Widget:\n    pass\n",
        "zz/far/x.py": "def thing():\n    pass\n",
        "app/plain.py": "import nowhere\n\ndef stay():\n    load()\n",
        "app/named.py": "from deep.store import load\n\ndef use():\n    load()\n",
    }
    rows = python_code.extract(spark.createDataFrame(list(files.items()), "path string, code string")).cache()
    names = {r["id"]: (r["path"], r["name"]) for r in rows.where("kind not in ('call', 'import', 'base')").collect()}
    got = {(names[r["src_id"]], names[r["dst_id"]], r["kind"]) for r in python_code.build_edges(rows, "").collect()}
    main, other = ("app/main.py", "main.py"), "src/aaa/other.py"
    imports = {g[1] for g in got if g[0] == main and g[2] == "Imports"}
    assert imports == {(other, "only_function"), (other, "Widget"), ("src/deep/store_impl.py", "store_impl.py"), ("zz/far/x.py", "x.py"), ("zz/far/x.py", "thing")}
    assert {g[1] for g in got if g[0] == ("app/main.py", "go") and g[2] == "Calls"} == {(other, "load"), ("zz/far/x.py", "thing")}
    assert {g[1] for g in got if g[0] == ("app/plain.py", "stay") and g[2] == "Calls"} == {(other, "load")}
    assert {g[1] for g in got if g[0] == ("app/named.py", "use") and g[2] == "Calls"} == {(other, "load")}
    near = python_code.extract(spark.createDataFrame([("app/m.py", "import store_impl\n\ndef go():\n    load()\n"), *[f for f in files.items() if f[0].startswith("src")]], "path string, code string")).cache()
    ids = {r["id"]: r["path"] for r in near.where("kind in ('function', 'file')").collect()}
    assert [ids[r["dst_id"]] for r in python_code.build_edges(near, "").where("kind = 'Calls'").collect()] == ["src/deep/store_impl.py"]


def found(path, code, kind, *fields):
    names = ("path", "kind", "id", "name", "owner", "start_line", "end_line", "detail", "names", "level")
    rows = [dict(zip(names, r, strict=True)) for r in python_code.parse(path, code)]
    by = {r["id"]: r["name"] for r in rows if r["kind"] not in ("call", "import", "base")}
    return [tuple(by[r["id"]] if f == "in" else r[f] for f in fields) if len(fields) > 1 else r[fields[0]] for r in rows if r["kind"] in (kind if isinstance(kind, tuple) else (kind,))]


DEFS = python_code.DEFINITIONS
SCRIPT = """import React, { useState as us, type Foo } from "react";
import * as path from 'path';
import "side";
const q = require("./q");
/** Widget doc
 * more */
export class Widget<T> extends React.Component<Props> implements Named, Other {
  x = compute(1)
  constructor(a: string) { super(a); init(`n ${fmt(a, `${deep()}`)} } call(`); }
  static async run(n: number): Promise<{ a: string }> { if (n) { this.go().then(x => log(x)); } return new Foo(bar()); }
  abstract foo(): void;
}
interface Shape extends Base { area(): number; }
enum Color { Red = pick("x") }
// says hi
async function hi(x) { /* call() */ const r = /foo(bar)[/(]/.test("baz("); return a / b(2) / c; }
const k = function inner() { z(); };
const o = { m() { y?.z(); }, n: () => w() };
"""
RUST = """use std::collections::{HashMap, hash_map::Entry as E, self};
use crate::graph::Node;
pub use foo::*;
mod util;
mod inline { fn hidden() { a() } }
/// A point.
/// Two lines.
#[derive(Debug, Clone)]
pub struct Point<T> { x: T, f: fn(i32) -> i32 }
pub enum Kind { A(i32), B { c: u8 } }
impl<T: Fmt> fmt::Display for Point<T> where T: Copy {
    pub(crate) fn fmt<'a>(&'a self, f: &mut Formatter) -> Result<(), Error> {
        let c = '{'; let d = b'"'; let s = r#"raw " } call()"#; /* a /* nested */ call() */
        write!(f, "{}", self.x.abs())?;
        match q { Some(v) => Vec::new(v), None => helper(1)?.go() }
    }
}
trait T { fn sig(&self); fn dflt(&self) { self.sig(); } }
async fn main() { Point::<i32>::make(1); if let Ok(z) = get() { z(); } }
"""
GO = """package main
import "fmt"
import (
    "os"
    alias "net/http"
)
// Run runs.
func Run(x int) (interface{}, error) {
    fmt.Println(`raw { call()`, '{')
    go func() { work() }()
    b := []byte(s)
    return helper(x).Next(), nil
}
type I interface { Do(x int) }
func (s *Svc) Start() { s.f(1); defer s.stop() }
"""
JAVA = """package com.x;
import java.util.*;
import static java.lang.Math.max;
/** Doc. */
@Service("a{")
public class M extends Base<String> implements Runnable, Comparable<M> {
  private int x = compute(1);
  public M(int a) { super(a); this.x = a; }
  @Override
  public void run() throws IOException { System.out.println("}" + foo()); new Thing(bar()).go(); }
  abstract int size();
  enum E { A(1), B(2); E(int x) { init(x); } }
}
"""
C = """#include <stdio.h>
#include "local.h"
#define CALL(x) foo(x) { \\\\
   bar()
struct point { int x; };
static int add(int a, int b) { return mul(a, sub(b)); }
int proto(int);
int *ptr(void)
{
    struct point p; char c = '"'; p.f->g(1); sizeof(int); if (x) { puts("}"); }
}
"""
CPP = """namespace ns {
class Derived : public Base, private ns::Other<int> {
 public:
  Derived(int a) : x(a), y(a) { init(); }
  int get() const { return std::sort(v.begin(), v.end()); }
  void decl(int);
};
template <typename T> T Derived::run(T t) { auto s = R"x(call() })x"; return t; }
}
"""


def test_script():
    assert found("a.ts", SCRIPT, DEFS, "kind", "name", "start_line", "end_line") == [("class", "Widget", 7, 12), ("method", "constructor", 9, 9), ("method", "run", 10, 10), ("interface", "Shape", 13, 13), ("enum", "Color", 14, 14), ("function", "hi", 16, 16), ("function", "m", 18, 18)]
    assert found("a.ts", SCRIPT, "import", "name", "names") == [("react", ["React", "useState", "Foo"]), ("path", ["*"]), ("side", []), ("./q", [])]
    assert found("a.ts", SCRIPT, "base", "name") == ["Component", "Named", "Other", "Base"]
    assert found("a.ts", SCRIPT, DEFS, "detail")[::5] == ["Widget doc\nmore", "says hi"]
    assert found("a.ts", SCRIPT, "call", "name", "detail", "in") == [
        ("require", None, "a.ts"), ("compute", None, "Widget"), ("init", None, "constructor"), ("fmt", None, "constructor"), ("deep", None, "constructor"), ("go", "this", "run"), ("then", "this.go()", "run"), ("log", None, "run"), ("bar", None, "run"),
        ("test", "/foo(bar)[/(]/", "hi"), ("b", None, "hi"), ("z", None, "a.ts"), ("z", "y", "m"), ("w", None, "a.ts"),
    ]


def test_rust():
    assert found("a.rs", RUST, DEFS, "kind", "name", "start_line", "end_line") == [("function", "hidden", 5, 5), ("struct", "Point", 9, 9), ("enum", "Kind", 10, 10), ("class", "Point<T>", 11, 17), ("method", "fmt", 12, 16), ("function", "dflt", 18, 18), ("function", "main", 19, 19)]
    assert found("a.rs", RUST, "import", "name", "names") == [("std::collections", ["collections", "HashMap", "hash_map::Entry"]), ("crate::graph::Node", ["graph", "Node"]), ("foo", ["*"]), ("util", ["util"])]
    assert found("a.rs", RUST, "base", "name", "in") == [("Display", "Point<T>")] and found("a.rs", RUST, "struct", "detail") == ["A point.\nTwo lines."]
    assert found("a.rs", RUST, "call", "name", "detail", "in") == [("a", None, "hidden"), ("abs", "self.x", "fmt"), ("new", "Vec", "fmt"), ("helper", None, "fmt"), ("go", "helper(1)?", "fmt"), ("sig", "self", "dflt"), ("make", "Point::<i32>", "main"), ("get", None, "main"), ("z", None, "main")]


def test_go():
    assert found("a.go", GO, DEFS, "kind", "name", "start_line", "end_line", "detail") == [("function", "Run", 8, 13, "Run runs."), ("function", "Start", 15, 15, None)]
    assert found("a.go", GO, "import", "name", "names", "start_line") == [("fmt", ["fmt"], 2), ("os", ["os"], 4), ("net/http", ["http"], 5)]
    assert found("a.go", GO, "call", "name", "detail") == [("Println", "fmt"), ("work", None), ("helper", None), ("Next", "helper(x)"), ("f", "s"), ("stop", "s")]


def test_java():
    assert found("a.java", JAVA, DEFS, "kind", "name", "start_line", "end_line") == [("class", "M", 5, 13), ("method", "M", 8, 8), ("method", "run", 9, 10), ("method", "size", 11, 11), ("enum", "E", 12, 12), ("method", "E", 12, 12)]
    assert found("a.java", JAVA, "import", "name", "names") == [("com.x", []), ("java.util.*", ["*"]), ("java.lang.Math.max", ["max"])]
    assert found("a.java", JAVA, "base", "name") == ["Base", "Runnable", "Comparable"] and found("a.java", JAVA, "class", "detail") == ["Doc."]
    assert found("a.java", JAVA, "call", "name", "detail", "in") == [("compute", None, "M"), ("println", "System.out", "run"), ("foo", None, "run"), ("bar", None, "run"), ("go", "new Thing(bar())", "run"), ("init", None, "E")]


def test_c():
    assert found("a.c", C, DEFS, "kind", "name", "start_line", "end_line") == [("struct", "point", 5, 5), ("function", "add", 6, 6), ("function", "ptr", 8, 11)]
    assert found("a.c", C, "import", "name") == ["stdio.h", "local.h"] and found("a.c", C, "call", "name", "detail") == [("mul", None), ("sub", None), ("g", "p.f"), ("puts", None)]
    assert found("a.cpp", CPP, DEFS, "kind", "name", "start_line", "end_line") == [("class", "Derived", 2, 7), ("method", "Derived", 4, 4), ("method", "get", 5, 5), ("function", "run", 8, 8)]
    assert found("a.cpp", CPP, "base", "name") == ["Base", "Other"] and found("a.cpp", CPP, "call", "name", "detail") == [("init", None), ("sort", "std"), ("begin", "v"), ("end", "v")]


@pytest.mark.parametrize("path", ["a.ts", "a.rs", "a.go", "a.java", "a.c", "a.cpp", "a.py", "a.txt", "noext"])
@pytest.mark.parametrize("code", ["", "\n\n", "}}}{{{", "((([[[", '"unfinished', "'", "`${`${", "/* open", "use ", "import ", "import", "class", "fn", "impl", "func (", "#include", "x" * 100_000, "é(ü) {ß}", "}}`}", "a.b.c.d().e(", "namespace {", "new", "r#\"", "impl<T", "enum class"])
def test_broken_sources(path, code):
    rows = python_code.parse(path, code)
    assert rows[0][1] == "file" and rows[0][6] == code.count("\n") + 1
    assert all(1 <= r[5] <= r[6] <= code.count("\n") + 1 for r in rows)


def test_cut_sources():
    """Every beginning of the sources is read without an error."""
    for path, code in (("a.ts", SCRIPT), ("a.rs", RUST), ("a.go", GO), ("a.java", JAVA), ("a.c", C), ("a.cpp", CPP)):
        for n in range(len(code)):
            python_code.parse(path, code[:n])


def module(rng, names):
    """A module of a few functions and classes that import and call names at random."""
    lines = []
    for _ in range(rng.randrange(3)):
        lines.append(rng.choice(["import {a}.{b}", "import {b}", "from {a} import {b}", "from .{a} import {b}", "from {a}.{b} import *", "import zz.{b}"]).format(a=rng.choice(names), b=rng.choice(names)))
    for _ in range(rng.randrange(1, 4)):
        name = rng.choice(names)
        lines += [f"class {name}({rng.choice(names)}):", f"    def {rng.choice(names)}(self):", f"        {rng.choice(names)}()"] if rng.random() < 0.4 else [f"def {name}():", f"    {rng.choice(names)}()"]
    return "\n".join(lines) + "\n"


@pytest.mark.parametrize("seed", [1, 2])
def test_refresh_equals_a_rebuild(spark, seed):
    rng = random.Random(seed)
    names, code = [f"n{k}" for k in range(40)], {}
    frame = lambda d: spark.createDataFrame(list(d.items()), "path string, code string").coalesce(1)
    code = {f"{rng.choice('abc')}/{rng.choice(names)}{rng.choice(['', 'x'])}.py": module(rng, names) for _ in range(25)}
    rows = python_code.extract(frame(code)).checkpoint()
    edges = python_code.build_edges(rows, "").checkpoint()
    fewer = 0
    for _ in range(2):
        new = {rng.choice(sorted(code)): module(rng, names), f"{rng.choice('abc')}/{rng.choice(names)}y.py": module(rng, names)}
        gone = [p for p in rng.sample(sorted(code), 2) if p not in new]
        code = {p: c for p, c in {**code, **new}.items() if p not in gone}
        changed = spark.createDataFrame([(p,) for p in [*new, *gone]], "path string")
        rows, edges, affected = python_code.refresh(rows, edges, python_code.extract(frame(new)), changed, "")
        whole = python_code.extract(frame(code)).cache()
        plain = lambda e: sorted(tuple(r) for r in e.select("src_id", "dst_id", "kind").collect())
        assert plain(edges) == plain(python_code.build_edges(whole, ""))
        assert sorted(map(repr, rows.select("path", "kind", "name", "start_line").collect())) == sorted(map(repr, whole.select("path", "kind", "name", "start_line").collect()))
        fewer += len(code) - affected.where(F.col("path").isin(list(code))).count()
    assert fewer > 0
