"""What shell command lines do: files read or listed, searches, other commands."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import policy

#: Options that take the next word, by tool.
_LS = ("-I", "-w", "--block-size", "--format", "--time-style", "--color", "--quoting-style")
_EZA = ("-I", "--ignore-glob", "--color", "--sort", "--time-style", "--time")
_RG = ("-g", "--glob", "--iglob", "-t", "--type", "--type-add", "--type-not", "-m", "--max-count", "-A", "-B", "-C", "--context", "--max-depth")
_GREP = ("-e", "--regexp", "-f", "--file", "-m", "--max-count", "-C", "--context", "-A", "--after-context", "-B", "--before-context")
_AG = ("-G", "-g", "--file-search-regex", "--ignore-dir", "--ignore-file", "--path-to-ignore")
_BAT = ("--theme", "--language", "--style", "--terminal-width", "--tabs", "--line-range", "--map-syntax")
TAKES_VALUE = {
    "ls": _LS, "eza": _EZA, "exa": _EZA, "tree": ("-L", "-P", "-I", "--charset", "--filelimit", "--sort"),
    "du": ("-d", "--max-depth", "-B", "--block-size", "--exclude", "--time-style"), "git ls-files": ("--exclude", "--exclude-from", "--pathspec-from-file"),
    "rg": _RG, "rga": _RG, "ripgrep-all": _RG, "grep": _GREP, "egrep": _GREP, "fgrep": _GREP, "git grep": _GREP, "ag": _AG, "ack": _AG, "pt": _AG,
    "fd": ("-t", "--type", "-e", "--extension", "-E", "--exclude", "--search-path"), "bat": _BAT, "batcat": _BAT,
    "less": ("-p", "-P", "-x", "-y", "-z", "-j", "--pattern", "--prompt", "--tabs", "--shift", "--jump-target"),
    "awk": ("-F", "-v", "-f", "--field-separator", "--assign", "--file"), "nl": ("-s", "-w", "-v", "-i", "-b"),
    "sed": ("-e", "-f", "--expression", "--file"), "xargs": ("-E", "-e", "-I", "-L", "-n", "-P", "-s"),
}
#: Tools by what they do, commands that only format, folders that don't name a path, calls that walk files.
LISTS, READS = ("ls", "eza", "exa", "tree", "du", "git ls-files"), ("cat", "bat", "batcat", "less", "more")
SEARCHES, GREPS = ("rg", "rga", "ripgrep-all", "ag", "ack", "pt"), ("grep", "egrep", "fgrep", "git grep")
FORMATS = ("wc", "tr", "cut", "sort", "uniq", "tee", "column", "yes", "printf")
UNNAMED = ("", "build", "dist", "node_modules", "src")
WALKS = ("os.walk", "os.listdir", "os.scandir", "glob.glob", "glob.iglob", "pathlib.Path", ".rglob(")
#: After ``--``, these tools' words that begin with a dash are no operands either.
_DASHED = ("rg", "rga", "ripgrep-all", "ag", "ack", "pt", "fd", "awk", "nl", "sed")
_RANGE = r"^[0-9]+(,[0-9]+)?p$"


def _has(values, x):
    return x.isin(*values)


def short_path(path):
    """The last part of a path that names something; the path itself where none does."""
    trimmed = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", "")
    return F.coalesce(F.element_at(F.filter(F.concat(F.array(F.lit(None).cast("string")), F.split(trimmed, "/")), lambda p: p.isNull() | ~_has(UNNAMED, p)), -1), trimmed)


def _quoted(words):
    """Words as one line, in single quotes where they hold more than letters, digits and ``_@%+=:,./-``."""
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike(r"^[\w@%+=:,./-]+$"), w).otherwise(F.concat(F.lit("'"), F.replace(w, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))), " ")


def _operands(tool, args):
    """Struct out, pattern: the words that are neither options nor their values; the first value of an option that gives a pattern."""
    flags = F.coalesce(F.create_map(*[c for t, v in TAKES_VALUE.items() for c in (F.lit(t), F.array(*map(F.lit, v)))])[tool], F.array().cast("array<string>"))
    none = F.lit(None).cast("string")
    state = lambda flag, rest, out, pattern: F.struct(flag.alias("flag"), rest.alias("rest"), out.alias("out"), pattern.alias("pattern"))

    def step(s, a):
        pattern = F.coalesce(s["pattern"], F.when(_has(("-e", "--regexp", "-f", "--file"), s["flag"]), a))
        option = a.startswith("-") & ~(s["rest"] & ~_has(_DASHED, tool))
        return (
            F.when(s["flag"].isNotNull(), state(none, s["rest"], s["out"], pattern))
            .when(~s["rest"] & (a == "--"), state(none, F.lit(True), s["out"], s["pattern"]))
            .when(~s["rest"] & F.array_contains(flags, a), state(a, s["rest"], s["out"], s["pattern"]))
            .when(option, state(none, s["rest"], s["out"], s["pattern"]))
            .otherwise(state(none, s["rest"], F.concat(s["out"], F.array(a)), s["pattern"]))
        )

    return F.aggregate(args, state(none, F.lit(False), F.array().cast("array<string>"), none), step)


def _counted_file(args, count):
    """The file of ``head`` and ``tail``: after a count of lines, or the only word."""
    apart = (F.get(args, F.lit(0)) == "-n") & F.get(args, F.lit(1)).rlike(f"^{count}$")
    valid = F.coalesce(apart, F.lit(False)) | F.coalesce((F.get(args, F.lit(0)) != "-n") & F.get(args, F.lit(0)).rlike(f"^-n{count}$"), F.lit(False))
    rest = F.when(apart, F.slice(args, 3, F.size(args))).otherwise(args)
    only = F.when((F.size(args) == 1) & ~args[0].startswith("-"), args[0])
    return F.coalesce(F.when(valid, F.get(F.filter(rest, lambda a: ~a.startswith("-")), F.lit(0))), only)


def _file_read(x):
    """The file that a command reads, else null. ``x``: columns tool, args, ops."""
    tool, args, out = x("tool"), x("args"), x("ops")["out"]
    first, second = F.get(out, F.lit(0)), F.get(out, F.lit(1))
    ranged = F.array_contains(args, "-n") & F.exists(args, lambda a: a.rlike(_RANGE))
    return (
        F.when(_has(READS, tool), F.when(F.size(out) == 1, first))
        .when(tool == "head", _counted_file(args, r"[0-9]*"))
        .when(tool == "tail", _counted_file(args, r"\+?[0-9]+"))
        .when(tool == "awk", F.when(F.array_contains(args, "-f") | F.array_contains(args, "--file"), first).otherwise(second))
        .when(tool == "nl", first)
        .when(tool == "sed", F.when(ranged, F.when(first.rlike(_RANGE), second).otherwise(first)))
    )


def _formats(x):
    """Whether a command only formats what it is given. ``x``: columns tool, args, ops, file."""
    tool, args = x("tool"), x("args")
    n, a, b = F.size(args), F.get(args, F.lit(0)), F.coalesce(F.get(args, F.lit(1)), F.lit(""))
    # what xargs runs, and whether that changes files
    run = F.get(x("ops")["out"], F.lit(0))
    after = F.slice(args, F.greatest(F.coalesce(F.array_position(args, run), F.lit(0)).cast("int"), F.lit(0)) + 1, F.size(args))
    in_place = F.exists(after, lambda w: w.startswith("-i") | w.startswith("-pi"))
    changes = F.when(_has(("perl", "ruby"), run), in_place).when(run == "sed", in_place | F.array_contains(after, "--in-place")).when(run == "rg", F.array_contains(after, "--replace")).otherwise(False)
    counted = lambda count: (n == 0) | ((n == 1) & a.startswith("-")) | ((n == 2) & _has(("-n", "-c"), a) & b.rlike(count))
    return F.coalesce(
        F.when(_has(FORMATS, tool), True).when(tool == "xargs", ~changes).when(_has(("awk", "sed"), tool), x("file").isNull()).when(tool == "head", counted("^[0-9]*$")).when(tool == "tail", counted(r"^\+?[0-9]*$")),
        F.lit(False),
    )


def _summary(x):
    """Struct kind, query, path of a command. ``x``: columns tool, args, ops, file."""
    tool, args, out, pattern = x("tool"), x("args"), x("ops")["out"], x("ops")["pattern"]
    first, second = F.get(out, F.lit(0)), F.get(out, F.lit(1))
    none = F.lit(None).cast("string")
    made = lambda kind, query, path: F.struct(F.lit(kind).alias("kind"), query.alias("query"), path.alias("path"))
    found = lambda query, path: F.when(query.isNotNull(), made("search", query, short_path(path))).otherwise(made("list", none, short_path(path)))
    pathish = _has((".", ".."), first) | F.contains(first, F.lit("/")) | F.contains(first, F.lit("\\"))
    alone = (F.size(out) == 1) & pathish
    named = F.filter(F.transform(args, lambda a, i: F.when(_has(("-name", "-iname", "-path", "-regex"), a), i)), lambda i: i.isNotNull())
    below = F.get(F.filter(args, lambda a: ~a.startswith("-") & ~_has(("!", "(", ")"), a)), F.lit(0))
    code = F.get(args, F.array_position(args, "-c").cast("int"))
    walks = F.when(F.array_contains(args, "-c"), F.exists(F.array(*map(F.lit, WALKS)), lambda w: F.contains(code, w)))
    return F.coalesce(
        F.when(_has(LISTS, tool) | (_has(("rg", "rga", "ripgrep-all"), tool) & F.array_contains(args, "--files")), made("list", none, short_path(first)))
        .when(_has(SEARCHES, tool), made("search", first, short_path(second)))
        .when(_has(GREPS, tool), made("search", F.coalesce(pattern, first), short_path(F.when(pattern.isNull(), second).otherwise(first))))
        .when(tool == "fd", found(F.when(~alone, first), F.when(alone, first).otherwise(second)))
        .when(tool == "find", found(F.get(args, F.get(named, F.lit(0)) + 1), below))
        .when(tool.rlike(r"^python([23]|[23]\..*)?$") & walks, made("list", none, none))
        .when(x("file").isNotNull(), made("read", none, x("file"))),
        made("unknown", none, none),
    )


def summaries(lines, key, line):
    """(key, n, kind, cmd, name, query, path): what each line of ``lines`` does, in order; ``key`` is a line's own.

    Kinds: read (``path`` is the file, below the folders that ``cd`` has gone to before, ``name`` its short name), list and search
    (``path`` shortened), unknown. Commands that only format, ``cd``, leading ``echo``, ``true`` and bare ``nl`` beside others give
    no row, nor does a command like the one before. Lines that aren't lists of words, and those that only format, are one unknown command.
    Null and blank lines give no row.
    """
    given = lines.where(F.trim(line) != "").select(F.col(key).alias("key"), F.col(line).alias("line"))
    words = policy.command_arrays(given, "key", "line")
    own = lambda *order: W.partitionBy("key").orderBy(*order)
    every = W.partitionBy("key")
    head = F.get("w", F.lit(0))
    git = (head == "git") & (F.size("w") > 1)
    x = words.withColumn("tool", F.when(git, F.concat(F.lit("git "), F.get("w", F.lit(1)))).otherwise(head)).withColumn("args", F.slice("w", F.when(git, 3).otherwise(2), F.size("w")))
    x = x.withColumn("ops", _operands(F.col("tool"), F.col("args"))).withColumn("file", _file_read(F.col)).withColumn("formats", _formats(F.col))
    x = x.withColumn("only_formats", F.min("formats").over(every))
    x = x.where("if(only_formats, n = 0, not formats)")  # on a window's result, so that the operands aren't worked out anew in a filter below it
    # folders gone to: from the last absolute one on
    dash = F.array_position("args", "--").cast("int")
    target = F.when(F.col("tool") == "cd", F.when(dash > 0, F.get("args", dash)).otherwise(F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter("args", lambda a: ~a.startswith("-"))), -1)))
    absolute = lambda p: p.rlike(r"^(/|[A-Za-z]:\\|\\\\)")
    before = own("n").rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("target", F.nullif(target, F.lit(""))).withColumn("base", F.max(F.when(absolute(F.col("target")), F.col("n"))).over(before))
    x = x.withColumn("gone", F.collect_list(F.when(F.col("target").isNotNull(), F.struct("n", "target"))).over(before)).where("tool <> 'cd'")
    folders = F.transform(F.filter("gone", lambda g: F.col("base").isNull() | (g["n"] >= F.col("base"))), lambda g: F.regexp_replace(g["target"], "/+$", ""))
    none = F.lit(None).cast("string")
    x = x.withColumn("s", F.when(~F.col("only_formats"), _summary(F.col)).otherwise(F.struct(F.lit("unknown").alias("kind"), none.alias("query"), none.alias("path"))))
    x = x.withColumn("cmd", F.when(F.col("only_formats"), F.col("line")).otherwise(_quoted(F.col("w")))).withColumn("several", F.count("*").over(every) > 1).where("not (several and cmd = 'true')")
    # what stays beside others: echo after something else, no bare nl
    bare = (F.col("s.kind") == "unknown") & (F.col("tool") == "nl")
    echo = F.col("tool") == "echo"
    x = x.withColumn("first", F.min(F.when(~bare & ~echo, F.col("n"))).over(every)).withColumn("last", F.max("n").over(every))
    x = x.where(F.when(F.col("first").isNull(), F.col("n") == F.col("last")).otherwise(~bare & (~echo | (F.col("n") > F.col("first")))))
    kind, path = F.col("s.kind"), F.col("s.path")
    full = F.when((kind == "read") & (F.size("gone") > 0) & ~absolute(path), F.array_join(F.concat(folders, F.array(path)), "/")).otherwise(path)
    x = x.select("key", "n", kind.alias("kind"), "cmd", F.when(kind == "read", short_path(path)).alias("name"), "s.query", full.alias("path"))
    now = F.struct("kind", "cmd", "name", "query", "path")
    x = x.withColumn("same", now.eqNullSafe(F.lag(now).over(own("n")))).where("not same").drop("same").withColumn("n", F.row_number().over(own("n")) - 1)
    other = given.where(~policy.is_word_list(F.col("line"))).select("key", F.lit(0).alias("n"), F.lit("unknown").alias("kind"), F.col("line").alias("cmd"), none.alias("name"), none.alias("query"), none.alias("path"))
    return x.union(other).withColumnRenamed("key", key)
