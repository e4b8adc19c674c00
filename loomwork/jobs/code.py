"""Code queries (S04, S16, E01, E03, E06, E08, E09, J01, J02, J04, J05, J07, G01) over a module of Python for every part.

A part k stands for ``src/pkg<k % 25>/p<k>.py``: it imports a helper of part k // 2 and, relatively, the class of part k - 25 as its base.
The texts are made by column expressions, one for each row, so they grow with the table; parser and edges are those for any files.
"""

from pyspark.sql import functions as F

from loomwork.operators import blocks
from loomwork.operators.lineage import cut, shuffled
from loomwork.sources import python_code
from loomwork.sources.tables import dealt, table

#: Lines of a module; {..} are columns of ``KEYS``.
MODULE = (
    "{first}",
    "from pkg{fh}.p{h} import helper_{h}",
    "{relative}",
    "",
    "class Part{k}({base}object):",
    '    """{name}"""',
    "    # price by size",
    "    def price(self, n):",
    "        return self.scale(helper_{h}(len(n)))",
    "",
    "    def scale(self, n):",
    "        return n * {size}",
    "",
    "def helper_{k}(n):",
    '    """Helper of {kind}."""',
    "    return common(n)",
    "{common}",
)
#: The columns, in words that both dialects know.
KEYS = {
    "k": "cast(p_partkey as varchar(20))",
    "h": "cast(h as varchar(20))",
    "fh": "cast(h % 25 as varchar(20))",
    "first": "concat('import pkg', cast(h % 25 as varchar(20)), '.p', cast(h as varchar(20)), case when p_partkey % 3 = 0 then concat('.helper_', cast(h as varchar(20))) else '' end)",
    "relative": "case when p_partkey < 25 then 'import os' else concat('from .p', cast(p_partkey - 25 as varchar(20)), ' import Part', cast(p_partkey - 25 as varchar(20))) end",
    "base": "case when p_partkey < 25 then '' else concat('Part', cast(p_partkey - 25 as varchar(20)), ', ') end",
    "name": "p_name",
    "kind": "p_type",
    "size": "cast(p_size as varchar(20))",
    "common": "case when p_partkey % 2 = 0 then concat(chr(10), 'def common(n):', chr(10), '    return max(n, ', cast(p_size as varchar(20)), ')', chr(10)) else '' end",
}
#: Modules that a task makes and reads.
PER_TASK = 2048
PATH = "concat('src/pkg', cast(p_partkey % 25 as varchar(20)), '/p', cast(p_partkey as varchar(20)), '.py')"


def _code():
    """The module's text as an expression."""
    parts = []
    for line in MODULE:
        at = 0
        while (lo := line.find("{", at)) >= 0:
            hi = line.index("}", lo)
            parts += [f"'{line[at:lo]}'", KEYS[line[lo + 1 : hi]]]
            at = hi + 1
        parts += [f"'{line[at:]}'", "chr(10)"]
    return f"concat({', '.join(p for p in parts if p != chr(39) * 2)})"


def _files(spark, sf):
    x = dealt(table(spark, sf, "part"), PER_TASK).selectExpr("*", "cast(floor(p_partkey / 2) as bigint) as h")
    return x.selectExpr("p_partkey", f"{PATH} as path", f"{_code()} as code")


def _rows(spark, sf):
    return python_code.extract(_files(spark, sf))


#: What edges aren't made of.
UNUSED = ("owner", "end_line", "detail")


def _labels(rows):
    return rows.where(F.col("kind").isin("file", *python_code.DEFINITIONS)).select("id", F.concat_ws(":", "path", "name").alias("label"))


def _edges(spark, sf, kind):
    rows = _rows(spark, sf).where(F.col("kind").isin(*python_code.needed([kind])))
    rows = cut(rows.drop(*UNUSED))
    names = shuffled(_labels(rows))
    e = python_code.build_edges(rows, "src", kinds=[kind])
    return e.join(names.toDF("src_id", "src"), "src_id").join(names.toDF("dst_id", "dst"), "dst_id").select("src", "dst")


def element_texts(spark, sf):
    """doc_id (path, kind and name) and text (name, code and docstring) of every element."""
    rows = _rows(spark, sf).where(F.col("kind").isin("file", *python_code.DEFINITIONS)).join(shuffled(_files(spark, sf).select("path", "code")), "path")
    own = F.array_join(F.slice(F.split("code", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return rows.select(F.concat_ws(":", "path", "kind", "name").alias("doc_id"), F.concat_ws(" ", "name", own, F.coalesce("detail", F.lit(""))).alias("text"))


def e01_elements(spark, sf):
    """Files, classes, methods and functions with their lines."""
    return _rows(spark, sf).where("kind in ('file', 'class', 'method', 'function')").select("path", "kind", "name", "start_line", "end_line")


def e03_docstrings(spark, sf):
    return _rows(spark, sf).where("detail is not null and kind in ('class', 'method', 'function')").select("path", "name", F.col("detail").alias("docstring"))


def e06_calls(spark, sf):
    """Called names but builtins, with the receiver of methods."""
    return _rows(spark, sf).where("kind = 'call'").select("path", "name", F.col("detail").alias("receiver"), "start_line")


def e08_imports(spark, sf):
    return _rows(spark, sf).where("kind = 'import'").select("path", F.col("name").alias("module"), F.array_join("names", ",").alias("names"), "level")


def e09_bases(spark, sf):
    return _rows(spark, sf).where("kind = 'base'").select("path", "name")


def j01_code_defines(spark, sf):
    return _edges(spark, sf, "Defines")


def j02_code_calls(spark, sf):
    """Same file, then imported files, then the first path that contains an imported name, then the first by path."""
    return _edges(spark, sf, "Calls")


def j04_code_imports(spark, sf):
    """Files to files (relative, exact, parent of the module) and to imported symbols."""
    return _edges(spark, sf, "Imports")


def j07_code_inherits(spark, sf):
    return _edges(spark, sf, "Inherits")


def x01_code_changes(spark, sf):
    """All edges after three batches of changed files, kept up by resolving anew what they touch: equal to those of all files."""
    files, k = _files(spark, sf), F.col("p_partkey")
    code = lambda d: python_code.extract(d.select("path", "code")).drop(*UNUSED)
    early = files.where(k % 7 != 0).withColumn("code", F.when(k % 5 == 1, F.replace(F.replace("code", F.lit("def helper_"), F.lit("def other_")), F.lit("def common"), F.lit("def general"))).otherwise(F.col("code")))
    late = files.where((k % 7 == 0) | (k % 5 == 1))
    extra = files.where(k % 50 == 0).select(F.concat(F.lit("src/aa/extra"), k, F.lit(".py")).alias("path"), F.lit("def common(n):\n    return helper_7(n)\n").alias("code"))
    some = files.where(k % 11 == 0).select("path", "code")
    rows = cut(code(early))
    edges = shuffled(cut(python_code.build_edges(rows, "src")))
    for new, changed in ((late, late), (extra, extra.select("path").union(some.select("path"))), (some, extra.select("path").union(some.select("path")))):
        rows, edges, _ = python_code.refresh(rows, edges, code(new), changed, "src")
    names = shuffled(_labels(rows))
    return edges.join(names.toDF("src_id", "src"), "src_id").join(names.toDF("dst_id", "dst"), "dst_id").select("kind", "src", "dst")


def g01_code_callers(spark, sf):
    """Callers of every definition, most called first."""
    return _edges(spark, sf, "Calls").groupBy("dst").agg(F.count("*").alias("calls"), F.countDistinct("src").alias("callers"))


def s16_block(spark, sf):
    """The block around line 9 or 12 of every module, with levels, siblings, header and limit varied by part."""
    k = F.col("p_partkey")
    x = _files(spark, sf).select("p_partkey", "code", F.when(k % 2 == 0, 9).otherwise(12).alias("anchor"), (k % 3).alias("levels"), (k % 5 == 0).alias("siblings"), (k % 7 != 0).alias("header"), (k % 11 + 2).alias("most"))
    return blocks.indented_block(x, "p_partkey", "code", "anchor", "levels", "siblings", "header", "most")


QUERIES = {n: f for n, f in list(globals().items()) if n[:1] in "sejgx" and n[1:3].isdigit()}
X = f"WITH x AS (SELECT *, h % 25 AS fh, {PATH} AS path FROM (SELECT *, p_partkey AS k, p_partkey // 2 AS h FROM part)), f AS (SELECT *, {_code()} AS code FROM x)"
DEFS = f"""{X}, n AS (SELECT k, path, 'class' AS kind, 'Part' || k AS name, 5 AS start_line, 12 AS end_line FROM x UNION ALL SELECT k, path, 'method', 'price', 8, 9 FROM x UNION ALL SELECT k, path, 'method', 'scale', 11, 12 FROM x
  UNION ALL SELECT k, path, 'function', 'helper_' || k, 14, 16 FROM x UNION ALL SELECT k, path, 'function', 'common', 18, 19 FROM x WHERE k % 2 = 0)"""
TEXTS_SQL = f"""{DEFS} SELECT n.path || ':' || n.kind || ':' || n.name AS doc_id, n.name || ' ' || array_to_string(list_slice(string_split(f.code, chr(10)), n.start_line, n.end_line), chr(10)) || ' ' ||
  CASE WHEN n.kind = 'class' THEN f.p_name WHEN n.name = 'helper_' || n.k THEN 'Helper of ' || f.p_type || '.' ELSE '' END AS text FROM n JOIN f USING (k) UNION ALL SELECT path || ':file:p' || k || '.py', 'p' || k || '.py ' || code FROM f"""
FILE = "path || ':p' || k || '.py'"
CALLS = f"""{DEFS}, seen AS (SELECT k, h AS other FROM x UNION SELECT k, k - 25 FROM x WHERE k >= 25), c AS (SELECT k, path FROM n WHERE name = 'common'),
  cand AS (SELECT x.k, c.path, CASE WHEN x.k = c.k THEN 1 ELSE 2 END AS rank FROM x JOIN c ON c.k = x.k OR c.k IN (SELECT other FROM seen WHERE seen.k = x.k)
    UNION ALL SELECT m.k, c.path, 3 FROM (SELECT k, unnest(list_concat(['pkg' || fh || '.p' || h, 'helper_' || h], CASE WHEN k < 25 THEN ['os'] ELSE ['p' || (k - 25), 'Part' || (k - 25)] END)) AS m FROM x) m JOIN c ON contains(c.path, m.m)
    UNION ALL SELECT k, (SELECT min(path) FROM c), 4 FROM x),
  best AS (SELECT k, arg_min(path, (rank, path)) AS target FROM cand GROUP BY 1),
  e AS (SELECT path || ':price' AS src, path || ':scale' AS dst FROM x UNION ALL SELECT a.path || ':price', b.path || ':helper_' || b.k FROM x a JOIN x b ON b.k = a.h
  UNION ALL SELECT path || ':helper_' || k, target || ':common' FROM x JOIN best USING (k))"""
ORACLES = {
    "e01_elements": f"{DEFS} SELECT path, kind, name, start_line, end_line FROM n UNION ALL SELECT path, 'file', 'p' || k || '.py', 1, length(code) - length(replace(code, chr(10), '')) + 1 FROM f",
    "e03_docstrings": f"{X} SELECT path, 'Part' || k AS name, p_name AS docstring FROM x UNION ALL SELECT path, 'helper_' || k, 'Helper of ' || p_type || '.' FROM x",
    "e06_calls": f"{X} SELECT path, 'scale' AS name, 'self' AS receiver, 9 AS start_line FROM x UNION ALL SELECT path, 'helper_' || h, NULL, 9 FROM x UNION ALL SELECT path, 'common', NULL, 16 FROM x",
    "e08_imports": f"{X} SELECT path, 'pkg' || fh || '.p' || h || CASE WHEN k % 3 = 0 THEN '.helper_' || h ELSE '' END AS module, '' AS names, 0 AS level FROM x UNION ALL SELECT path, 'pkg' || fh || '.p' || h, 'helper_' || h, 0 FROM x UNION ALL SELECT path, CASE WHEN k < 25 THEN 'os' ELSE 'p' || (k - 25) END, CASE WHEN k < 25 THEN '' ELSE 'Part' || (k - 25) END, CASE WHEN k < 25 THEN 0 ELSE 1 END FROM x",
    "e09_bases": f"{X} SELECT path, 'object' AS name FROM x UNION ALL SELECT path, 'Part' || (k - 25) FROM x WHERE k >= 25",
    "j01_code_defines": f"{DEFS} SELECT {FILE} AS src, path || ':' || name AS dst FROM n",
    "j02_code_calls": f"{CALLS} SELECT src, dst FROM e",
    "j04_code_imports": f"""{X} SELECT {FILE.replace("path", "a.path").replace("k ||", "a.k ||")} AS src, unnest([b.path || ':p' || b.k || '.py', b.path || ':helper_' || b.k]) AS dst FROM x a JOIN x b ON b.k = a.h
      UNION SELECT a.path || ':p' || a.k || '.py', unnest([b.path || ':p' || b.k || '.py', b.path || ':Part' || b.k]) FROM x a JOIN x b ON b.k = a.k - 25""",
    "j07_code_inherits": f"{X} SELECT a.path || ':Part' || a.k AS src, b.path || ':Part' || b.k AS dst FROM x a JOIN x b ON b.k = a.k - 25",
    "g01_code_callers": f"{CALLS} SELECT dst, count(*) AS calls, count(DISTINCT src) AS callers FROM e GROUP BY 1",
}
ORACLES["x01_code_changes"] = " UNION ALL ".join(f"SELECT '{kind}' AS kind, * FROM ({ORACLES[name]})" for kind, name in (("Defines", "j01_code_defines"), ("Calls", "j02_code_calls"), ("Imports", "j04_code_imports"), ("Inherits", "j07_code_inherits")))
