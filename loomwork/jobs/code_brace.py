"""Code queries in two more languages: a TypeScript module for every even part, a Rust module for every odd one.

Module k imports from module k - 2 of its language; brackets, quotes and calls stand in strings, templates, patterns and comments too. The texts are
made by column expressions, one for each row; lexer and edges are those for any files.
"""

import re

from pyspark.sql import functions as F

from loomwork.jobs.code import PER_TASK, UNUSED
from loomwork.operators.lineage import cut, shuffled
from loomwork.sources import python_code
from loomwork.sources.tables import dealt, table

SCRIPT = """import React, { helper«p» as other } from "src/ts«fp»/w«p»";
import * as path from ''path'';

/** «name» */
export class Widget«k» extends Widget«p» implements Shape {
  title = `price ${ helper«p»(«size») } }`;
  async price(n: number): Promise<number> {
    // helper«k»(9) in a comment
    const s = "call({";
    return this.scale(helper«p»(n / 2)) / other(3);
  }
  scale(n: number): number { return n * «size»; }
}

export function helper«k»(n: number): number {
  const r = /call\\(/.test("x");
  return common(n);
}
«common»"""
RUST = """use crate::rs«fp»::w«p»::{Part«p», helper«p» as other};
mod util;

/// «name»
#[derive(Debug, Clone)]
pub struct Part«k»<''a> { name: &''a str, f: fn(i32) -> i32 }

impl<''a> Shape for Part«k»<''a> {
    fn price(&self, n: i32) -> i32 {
        let c = ''{''; let s = r#"call({ "#; /* a /* nested( */ call() */
        self.scale(helper«p»(n))
    }
    fn scale(&self, n: i32) -> i32 { n * «size» }
}

pub(crate) fn helper«k»(n: i32) -> i32 {
    println!("{}", n);
    common(n)
}
«common»"""
#: What stands between the marks, in words that both dialects know.
_TEXT = "cast({} as varchar(20))"
KEYS = {"k": _TEXT.format("k"), "p": _TEXT.format("p"), "fp": _TEXT.format("p % 10"), "name": "p_name", "size": _TEXT.format("p_size")}
COMMON = {"ts": "export function common(n: number) { return n; }", "rs": "fn common(n: i32) -> i32 { Part«k»::new(n); n }"}
PATH = f"concat('src/', lang, {_TEXT.format('k % 10')}, '/w', {_TEXT.format('k')}, '.', lang)"


def _text(template, lang, escape=""):
    """A template as an expression. Spark reads backslashes in literals as escapes, DuckDB doesn't."""
    parts = []
    for piece in re.split("(«[a-z]+»|\n)", template):
        if piece == "\n":
            parts.append("chr(10)")
        elif piece == "«common»":
            parts.append(f"case when k % 4 = {0 if lang == 'ts' else 1} then {_text(COMMON[lang], lang)} else '' end")
        elif piece[:1] == "«":
            parts.append(KEYS[piece[1:-1]])
        elif piece:
            parts.append("'" + (piece.replace("\\", "\\\\").replace("''", "\\'") if escape else piece) + "'")
    return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]


def _files(spark, sf):
    x = dealt(table(spark, sf, "part"), PER_TASK).selectExpr("p_partkey as k", "p_name", "p_size", "greatest(p_partkey - 2, p_partkey % 2) as p", "case when p_partkey % 2 = 0 then 'ts' else 'rs' end as lang")
    return x.selectExpr(f"{PATH} as path", f"case when lang = 'ts' then {_text(SCRIPT, 'ts', 'spark')} else {_text(RUST, 'rs', 'spark')} end as code")


def _rows(spark, sf):
    return python_code.extract(_files(spark, sf))


def e01_brace_elements(spark, sf):
    """Files, classes, structs, methods and functions with their lines."""
    return _rows(spark, sf).where(F.col("kind").isin("file", *python_code.DEFINITIONS)).select("path", "kind", "name", "start_line", "end_line")


def e03_brace_docs(spark, sf):
    """Comments in front of definitions."""
    return _rows(spark, sf).where(F.col("kind").isin(*python_code.DEFINITIONS) & F.col("detail").isNotNull()).select("path", "kind", "name", F.col("detail").alias("doc"))


def e06_brace_calls(spark, sf):
    return _rows(spark, sf).where("kind = 'call'").select("path", "name", F.col("detail").alias("receiver"), "start_line")


def e08_brace_imports(spark, sf):
    return _rows(spark, sf).where("kind = 'import'").select("path", F.col("name").alias("module"), F.array_join("names", ",").alias("names"), "start_line")


def e09_brace_bases(spark, sf):
    return _rows(spark, sf).where("kind = 'base'").select("path", "name")


def j02_brace_edges(spark, sf):
    """All edges: Defines, Imports, Calls and Inherits, both languages together."""
    rows = cut(_rows(spark, sf).drop(*UNUSED))
    names = shuffled(rows).where(F.col("kind").isin("file", *python_code.DEFINITIONS)).select("id", F.concat_ws(":", "path", "kind", "name").alias("label"))
    e = python_code.build_edges(rows, "src")
    return e.join(names.toDF("src_id", "src"), "src_id").join(names.toDF("dst_id", "dst"), "dst_id").select("kind", "src", "dst")


QUERIES = {n: f for n, f in list(globals().items()) if n[:1] in "ej" and n[1:3].isdigit()}

X = f"""WITH x AS (SELECT *, {PATH} AS path, k % 4 = CASE WHEN lang = 'ts' THEN 0 ELSE 1 END AS own FROM (SELECT p_partkey AS k, p_name, p_size, greatest(p_partkey - 2, p_partkey % 2) AS p, CASE WHEN p_partkey % 2 = 0 THEN 'ts' ELSE 'rs' END AS lang FROM part))"""
#: lang, kind, name, first and last line, condition
ELEMENTS = (
    ("ts", "class", "'Widget' || k", 5, 13, "true"), ("ts", "method", "'price'", 7, 11, "true"), ("ts", "method", "'scale'", 12, 12, "true"), ("ts", "function", "'helper' || k", 15, 18, "true"), ("ts", "function", "'common'", 19, 19, "own"),
    ("rs", "struct", "'Part' || k", 6, 6, "true"), ("rs", "class", "'Part' || k || '<''a>'", 8, 14, "true"), ("rs", "method", "'price'", 9, 12, "true"), ("rs", "method", "'scale'", 13, 13, "true"), ("rs", "function", "'helper' || k", 16, 19, "true"), ("rs", "function", "'common'", 20, 20, "own"),
)
N = f"""{X}, n AS ({" UNION ALL ".join(f"SELECT k, path, lang, '{kind}' AS kind, {name} AS name, {lo} AS start_line, {hi} AS end_line FROM x WHERE lang = '{lang}' AND {when}" for lang, kind, name, lo, hi, when in ELEMENTS)}
  UNION ALL SELECT k, path, lang, 'file', 'w' || k || '.' || lang, 1, CASE lang WHEN 'ts' THEN 19 ELSE 20 END FROM x)"""
#: lang, called name, receiver, line
CALLED = (
    ("ts", "'helper' || p", "NULL", 6, "true"), ("ts", "'scale'", "'this'", 10, "true"), ("ts", "'helper' || p", "NULL", 10, "true"), ("ts", "'other'", "NULL", 10, "true"), ("ts", "'test'", "'/call\\(/'", 16, "true"), ("ts", "'common'", "NULL", 17, "true"),
    ("rs", "'scale'", "'self'", 11, "true"), ("rs", "'helper' || p", "NULL", 11, "true"), ("rs", "'common'", "NULL", 18, "true"), ("rs", "'new'", "'Part' || k", 20, "own"),
)
LABEL = "path || ':' || kind || ':' || name"
IMPORTED = "CASE lang WHEN 'ts' THEN ['src/ts' || (p % 10) || '/w' || p, 'React', 'helper' || p, 'path'] ELSE ['crate::rs' || (p % 10) || '::w' || p, 'rs' || (p % 10), 'w' || p, 'Part' || p, 'helper' || p, 'util'] END"
ORACLES = {
    "e01_brace_elements": f"{N} SELECT path, kind, name, start_line, end_line FROM n",
    "e03_brace_docs": f"{N} SELECT n.path, kind, name, p_name AS doc FROM n JOIN x USING (k) WHERE kind = 'struct' OR name LIKE 'Widget%'",
    "e06_brace_calls": f"{X} " + " UNION ALL ".join(f"SELECT path, {name} AS name, {receiver} AS receiver, {line} AS start_line FROM x WHERE lang = '{lang}' AND {when}" for lang, name, receiver, line, when in CALLED),
    "e08_brace_imports": f"""{X} SELECT path, 'src/ts' || (p % 10) || '/w' || p AS module, 'React,helper' || p AS names, 1 AS start_line FROM x WHERE lang = 'ts' UNION ALL SELECT path, 'path', '*', 2 FROM x WHERE lang = 'ts'
      UNION ALL SELECT path, 'crate::rs' || (p % 10) || '::w' || p, 'rs' || (p % 10) || ',w' || p || ',Part' || p || ',helper' || p, 1 FROM x WHERE lang = 'rs' UNION ALL SELECT path, 'util', 'util', 2 FROM x WHERE lang = 'rs'""",
    "e09_brace_bases": f"{X} SELECT path, 'Widget' || p AS name FROM x WHERE lang = 'ts' UNION ALL SELECT path, 'Shape' FROM x",
    "j02_brace_edges": f"""{N}, c AS (SELECT k, path, {LABEL} AS label FROM n WHERE name = 'common'), f AS (SELECT k, path, {LABEL} AS label FROM n WHERE kind = 'file'),
      tier AS (SELECT k, path AS target, 1 AS rank FROM c UNION ALL SELECT m.k, c.path, 3 FROM (SELECT k, unnest({IMPORTED}) AS m FROM x) m JOIN c ON contains(c.path, m.m) UNION ALL SELECT k, (SELECT min(path) FROM c), 4 FROM x),
      best AS (SELECT k, arg_min(target, (rank, target)) AS target FROM tier GROUP BY 1),
      inside AS (SELECT x.k, min(f.path) AS target FROM x JOIN f ON contains(f.path, 'src/ts' || (p % 10) || '/w' || p) WHERE lang = 'ts' GROUP BY 1)
      SELECT 'Defines' AS kind, f.label AS src, n.{LABEL} AS dst FROM n JOIN f USING (k) WHERE kind <> 'file'
      UNION ALL SELECT 'Imports', f.label, t.label FROM inside JOIN f USING (k) JOIN f t ON t.path = inside.target
      UNION ALL SELECT 'Imports', f.label, d.{LABEL} FROM f JOIN x USING (k) JOIN n d ON d.k = x.p AND (d.name = 'helper' || x.p OR d.name = 'Part' || x.p)
      UNION ALL SELECT 'Calls', s.{LABEL}, d.{LABEL} FROM n s JOIN x USING (k) JOIN n d ON d.name = 'helper' || x.p WHERE s.name IN ('price', 'Widget' || k)
      UNION ALL SELECT 'Calls', s.{LABEL}, d.{LABEL} FROM n s JOIN n d ON d.k = s.k AND d.name = 'scale' WHERE s.name = 'price'
      UNION ALL SELECT 'Calls', s.{LABEL}, c.label FROM n s JOIN best USING (k) JOIN c ON c.path = best.target WHERE s.name = 'helper' || s.k
      UNION ALL SELECT 'Inherits', s.{LABEL}, d.{LABEL} FROM n s JOIN x USING (k) JOIN n d ON d.name = 'Widget' || x.p WHERE s.name = 'Widget' || s.k""".replace(f"s.{LABEL}", "s.path || ':' || s.kind || ':' || s.name").replace(f"d.{LABEL}", "d.path || ':' || d.kind || ':' || d.name").replace(f"n.{LABEL}", "n.path || ':' || n.kind || ':' || n.name"),
}
