"""Sources as rows: elements, calls, imports and bases; and the edges between them.

Python is read with the standard parser, languages with braces by ``brace_code``; other files give a file row and nothing else.
"""

import ast
import functools

import pandas as pd
from pyspark.sql import functions as F

from loomwork.operators import graph, path_index
from loomwork.operators.lineage import cut, shuffled
from loomwork.sources import brace_code
from loomwork.sources.elements import element_id

#: Builtins whose plain calls aren't of interest.
BUILTINS = {
    "abs", "all", "any", "bin", "bool", "breakpoint", "bytearray", "bytes", "callable", "chr", "classmethod", "compile", "complex", "delattr", "dict",
    "dir", "divmod", "enumerate", "eval", "exec", "filter", "float", "format", "frozenset", "getattr", "globals", "hasattr", "hash", "help", "hex",
    "id", "input", "int", "isinstance", "issubclass", "iter", "len", "list", "locals", "map", "max", "memoryview", "min", "next", "object",
    "oct", "open", "ord", "pow", "print", "property", "range", "repr", "reversed", "round", "set", "setattr", "slice", "sorted", "staticmethod",
    "str", "sum", "super", "tuple", "type", "vars", "zip",
}
#: Kinds that are defined in a file, and those of them that others inherit from.
TYPES = ("class", "struct", "enum", "interface")
DEFINITIONS = ("function", "method", *TYPES)
EDGES = ("Defines", "Imports", "Calls", "Inherits")
SCHEMA = "path string, kind string, id string, name string, owner string, start_line int, end_line int, detail string, names array<string>, level int"


def parse(path, code):
    """Rows of one file: kinds file, function, method, class, struct, enum, interface, call, import and base. Code that doesn't parse gives the file row only."""
    found = brace_code.parse(path, code)
    if found is not None:
        return found
    rows = [(path, "file", element_id("file", path), path.rsplit("/", 1)[-1], None, 1, code.count("\n") + 1, None, None, None)]
    if not path.endswith((".py", ".pyi")):
        return rows
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return rows

    def visit(node, owner, in_class):
        for child in ast.iter_child_nodes(node):
            inner, cls = owner, in_class
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                cls = isinstance(child, ast.ClassDef)
                kind = "class" if cls else "method" if in_class else "function"
                inner = element_id(kind, path, child.name, str(child.lineno))
                rows.append((path, kind, inner, child.name, owner, child.lineno, child.end_lineno, ast.get_docstring(child, clean=False), None, None))
                if cls:
                    rows.extend((path, "base", inner, ast.unparse(b).rsplit(".", 1)[-1], None, child.lineno, child.lineno, None, None, None) for b in child.bases)
            elif isinstance(child, ast.Call):
                f = child.func
                if isinstance(f, ast.Attribute):
                    rows.append((path, "call", inner, f.attr, None, child.lineno, child.end_lineno, ast.unparse(f.value), None, None))
                elif isinstance(f, ast.Name) and f.id not in BUILTINS:
                    rows.append((path, "call", inner, f.id, None, child.lineno, child.end_lineno, None, None, None))
            elif isinstance(child, ast.Import):
                rows.extend((path, "import", inner, a.name, None, child.lineno, child.end_lineno, None, [], 0) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                rows.append((path, "import", inner, child.module or "", None, child.lineno, child.end_lineno, None, [a.name for a in child.names], child.level))
            visit(child, inner, cls)

    visit(tree, rows[0][2], False)
    return rows


def read_code(spark, root, glob="*.{py,pyi," + ",".join(brace_code.LANGUAGES) + "}"):
    """Rows of all files under ``root`` that fit ``glob``; hidden folders are left out. Unreadable text is left out too."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).where(~F.col("path").rlike(r"/\.[^/]+/"))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return extract(files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), text.alias("code")))


def extract(files):
    """Rows of ``files(path, code)``."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [r for p, c in zip(pdf["path"], pdf["code"], strict=True) if p is not None and c is not None for r in parse(p, c)]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"start_line": "Int32", "end_line": "Int32", "level": "Int32"})

    return files.select("path", "code").mapInPandas(run, SCHEMA)


def module_path(path, root):
    """Dotted module of a path below ``root`` (a literal)."""
    plain = F.regexp_replace(F.regexp_replace(path, r"\.(py|ts|js|rs|go|java)$", ""), r"/__init__$", "")
    return F.replace(F.substring(plain, len(root.rstrip("/")) + 2, 1 << 20), F.lit("/"), F.lit("."))


def guess_imports(imports, rows):
    """``imports`` (with ``name``, the module as written) with ``found``: the first file or definition of that name, else of its last segment after '.', else the first file whose path contains it with '/' for '.' and '::'. Others, and empty names, are left out."""
    wanted = imports.where("name <> ''").withColumn("last", F.substring_index("name", ".", -1)).withColumn("normal", F.replace(F.replace("name", F.lit("."), F.lit("/")), F.lit("::"), F.lit("/")))
    named = graph.first_by(rows.where(F.col("kind").isin("file", *DEFINITIONS)), ["name"], "path", "start_line", "id").select("name", F.col("id").alias("exact"))
    wanted = wanted.join(named, "name", "left").join(named.toDF("last", "tail"), "last", "left")
    open_ = wanted.where("exact is null and tail is null").select(F.col("normal").alias("needle"))
    files = rows.where("kind = 'file'").select("path", F.col("id").alias("inside"))
    inside = path_index.first_containing(files, open_).join(files, "path").select(F.col("needle").alias("normal"), "inside")
    return wanted.join(inside, "normal", "left").withColumn("found", F.coalesce("exact", "tail", "inside")).where("found is not null")


def guess_calls(calls, rows, local):
    """``calls(path, name)`` with ``third``: of the definitions ``local(def_path, name, dst_id)`` the first by path that contains a module or name which the file imports. Files that import the called name itself aren't here: any definition fits, the first of all."""
    said = rows.where("kind = 'import'").select("path", F.explode(F.array_union(F.array("name"), F.coalesce("names", F.array().cast("array<string>")))).alias("needle")).where("needle not in ('', '*')").distinct()
    asked = cut(calls.join(said, "path"))
    asked = asked.join(asked.where("needle = name").select("path", "name").distinct(), ["path", "name"], "left_anti")
    local = shuffled(local.join(calls.select("name").distinct(), "name", "left_semi"))
    within = path_index.pairs(local.select(F.col("def_path").alias("path")), asked.select("needle")).select("needle", F.col("path").alias("def_path"))
    fits = within.join(local, "def_path").join(asked.select("needle", "name").distinct(), ["needle", "name"], "left_semi")
    best = fits.groupBy("needle", "name").agg(F.min(F.struct("def_path", "dst_id")).alias("best"))
    return asked.join(best, ["needle", "name"]).groupBy("path", "name").agg(F.min("best")["dst_id"].alias("third"))


def _wanted(imports, files):
    """``imports`` with one row for the module (symbol '') and for each imported name: the dotted module it may be a file of, and the module's parent for plain absolute ones."""
    imports = imports.join(files.select("path", "file_id", F.col("module").alias("here")), "path")
    package = F.when(F.col("path").endswith("/__init__.py"), F.col("level") - 1).otherwise(F.col("level"))
    parts = F.split("here", r"\.")
    up = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - package)), ".")
    target = F.when(F.col("level") > 0, F.concat_ws(".", F.nullif(up, F.lit("")), F.nullif("name", F.lit("")))).otherwise(F.col("name"))
    imports = imports.select("path", "file_id", "name", (F.col("level") == 0).alias("absolute"), F.explode(F.concat(F.array(F.lit("")), F.coalesce("names", F.array().cast("array<string>")))).alias("symbol"), target.alias("module"))
    above = F.when(F.col("absolute") & (F.col("symbol") == "") & F.contains("module", F.lit(".")), F.regexp_replace("module", r"\.[^.]*$", ""))
    module = F.when(F.col("symbol") == "", F.col("module")).otherwise(F.concat_ws(".", F.nullif("module", F.lit("")), "symbol"))
    return imports.withColumn("parent", above).withColumn("module", module)


def _files(rows, root):
    return rows.where("kind = 'file'").select("path", F.col("id").alias("file_id"), module_path(F.col("path"), root).alias("module"))


def needed(kinds):
    """The kinds of rows from which edges of ``kinds`` are found."""
    return sorted({"file", *DEFINITIONS, *(["import"] if {"Imports", "Calls"} & set(kinds) else []), *(["call"] if "Calls" in kinds else []), *(["base"] if "Inherits" in kinds else [])})


def build_edges(rows, root, only=None, kinds=EDGES):
    """Edges (src_id, dst_id, kind) of extracted rows, of ``kinds``: Defines, Imports, Calls, Inherits; with ``only(path)`` those that begin in these files.

    A called name goes to the definition of that name in the same file, else in a module that the file imports, else to the first
    one (by path and line) whose path contains a module or name that the file imports, else to the first of all; calls of itself are left out.
    An import goes to the file of its module (a relative one from its package; else to that of the module's parent), else to the first file or definition with the module's
    name, else with its last segment, else to the first file whose path contains the module with '/' for '.' and '::'; and to each imported name's first definition.
    A base goes to the first class, struct, enum or interface of its name.
    """
    rows, out = shuffled(rows), []
    mine = rows if only is None else shuffled(rows.join(only.select("path").distinct(), "path", "left_semi"))
    files = _files(rows, root)
    defs = rows.where(F.col("kind").isin(*DEFINITIONS)).select("name", "id", "kind", "path", "start_line")
    if "Defines" in kinds:
        out.append(mine.where(F.col("kind").isin(*DEFINITIONS)).select("id", "path").join(files, "path").select(F.col("file_id").alias("src_id"), F.col("id").alias("dst_id"), F.lit("Defines").alias("kind")))

    if only is not None:
        said = _wanted(mine.where("kind = 'import'"), files).select(F.col("symbol").alias("name")).union(mine.where("kind in ('call', 'base')").select("name")).distinct()
        defs = shuffled(cut(defs.join(said, "name", "left_semi")))
    first_def = graph.first_by(defs, ["name"], "path", "start_line", "id").select(F.col("name").alias("symbol"), F.col("id").alias("dst_id"))
    if {"Imports", "Calls"} & set(kinds):
        wanted = _wanted(mine.where("kind = 'import'"), files)
        known = files.select("module", F.col("file_id").alias("dst_id"))
        parent = known.select(F.col("module").alias("parent"), F.col("dst_id").alias("parent_id"))
        to_file = cut(wanted.join(known, "module", "left").join(parent, "parent", "left").withColumn("dst_id", F.coalesce("dst_id", "parent_id")))
        unknown = to_file.where("dst_id is null and symbol = ''")
        symbols = to_file.where("symbol not in ('', '*')").select("path", "file_id", "symbol")
        to_file = to_file.select(F.col("file_id").alias("src_id"), "dst_id", "path").where("dst_id is not null")
    if "Imports" in kinds:
        guessed = guess_imports(unknown, rows).select("file_id", F.col("found").alias("dst_id"))
        to_symbol = symbols.join(first_def, "symbol").select(F.col("file_id").alias("src_id"), "dst_id")
        out.append(to_file.select("src_id", "dst_id").union(guessed).union(to_symbol).distinct().select("src_id", "dst_id", F.lit("Imports").alias("kind")))

    if "Calls" in kinds:
        seen = to_file.join(files.select(F.col("file_id").alias("dst_id"), F.col("path").alias("def_path")), "dst_id").select("path", "def_path").distinct()
        calls = mine.where("kind = 'call'").select("path", "name", F.col("id").alias("src_id"))
        asked = calls.select("path", "name").distinct()
        # tier by tier, so that a name which many files define and call doesn't meet all of its definitions
        local = graph.first_by(defs, ["path", "name"], "start_line", "id").select(F.col("path").alias("def_path"), "name", F.col("id").alias("dst_id"))
        here = local.select(F.col("def_path").alias("path"), "name", F.col("dst_id").alias("here"))
        near = graph.first_by(asked.join(seen, "path").join(local, ["def_path", "name"]), ["path", "name"], "def_path", "dst_id").select("path", "name", F.col("dst_id").alias("near"))
        found = cut(asked.join(here, ["path", "name"], "left").join(near, ["path", "name"], "left").join(first_def.select(F.col("symbol").alias("name"), "dst_id"), "name", "left"))
        open_ = found.where("here is null and near is null and dst_id is not null").select("path", "name")
        third = guess_calls(open_, rows, local)
        found = found.join(third, ["path", "name"], "left").select("path", "name", F.coalesce("here", "near", "third", "dst_id").alias("dst_id"))
        out.append(calls.join(found, ["path", "name"]).where("src_id <> dst_id").select("src_id", "dst_id", F.lit("Calls").alias("kind")))

    if "Inherits" in kinds:
        classes = graph.first_by(defs.where(F.col("kind").isin(*TYPES)), ["name"], "path", "start_line", "id").select("name", F.col("id").alias("dst_id"))
        out.append(mine.where("kind = 'base'").select("name", F.col("id").alias("src_id")).distinct().join(classes, "name").select("src_id", "dst_id", F.lit("Inherits").alias("kind")))
    return functools.reduce(lambda a, b: a.union(b), out)


def refresh(rows, edges, new_rows, changed, root):
    """Rows and edges after the files ``changed(path)`` have become ``new_rows`` (gone, if they have none there), as a rebuild would give them: (rows, edges, affected).

    ``affected(path)`` are the files whose edges are resolved anew: the changed ones; those that call, inherit from or import a name of which the changed
    files gained or lost a definition; and those of whose imports one may mean, by module or by a contained path, a file that came or went. Edges
    that begin in other files stay as they are.
    """
    rows = shuffled(rows)
    changed = cut(changed.select("path").distinct())
    old, kept = shuffled(cut(rows.join(changed, "path", "left_semi"))), rows.join(changed, "path", "left_anti")
    new_rows = shuffled(cut(new_rows.select(*rows.columns)))
    now = shuffled(cut(kept.unionByName(new_rows)))
    ids = lambda r: r.where(F.col("kind").isin("file", *DEFINITIONS)).select("id", "kind", "name", "path")
    moved = shuffled(cut(ids(old).join(ids(new_rows).select("id"), "id", "left_anti").union(ids(new_rows).join(ids(old).select("id"), "id", "left_anti"))))
    names, came = moved.select("name").distinct(), moved.where("kind = 'file'")
    others = shuffled(now.join(changed, "path", "left_anti"))
    imports = others.where("kind = 'import'")
    meant = _wanted(imports, _files(now, root))
    modules = came.select(module_path(F.col("path"), root).alias("module")).distinct()
    normal = F.replace(F.replace("name", F.lit("."), F.lit("/")), F.lit("::"), F.lit("/"))
    needles = shuffled(cut(imports.select("path", F.explode(F.concat(F.array("name", normal), F.coalesce("names", F.array().cast("array<string>")))).alias("needle")).where("needle not in ('', '*')").distinct()))
    inside = path_index.pairs(came.select("path"), needles.select("needle")).select("needle").distinct()
    said = others.where("kind in ('call', 'base')").select("path", "name").union(meant.select("path", "symbol")).union(meant.select("path", "name")).union(meant.select("path", F.substring_index("name", ".", -1)))
    affected = changed.union(said.join(names, "name", "left_semi").select("path")).union(meant.join(modules, "module", "left_semi").select("path"))
    affected = affected.union(meant.join(modules.toDF("parent"), "parent", "left_semi").select("path")).union(needles.join(inside, "needle", "left_semi").select("path"))
    affected = cut(affected.distinct())
    gone = shuffled(rows.join(affected, "path", "left_semi").where(F.col("kind").isin("file", *DEFINITIONS)).select(F.col("id").alias("src_id")).distinct())
    return now, cut(edges.join(gone, "src_id", "left_anti").select(*edges.columns).unionByName(build_edges(now, root, affected).select(*edges.columns))), affected
