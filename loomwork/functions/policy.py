"""Rules over commands and hosts."""

import ipaddress
from functools import reduce

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

DECISIONS = ("allow", "prompt", "forbidden")


def match_rules(commands, rules):
    """Rules(program, rest array<array<string>>, severity) that ``commands(id, argv)`` begin with: id, severity, matched (length).

    An equi-join on the program, then a positional test of the alternatives.
    """
    x = commands.join(rules, F.col("argv")[0] == F.col("program"))
    fits = F.forall(F.zip_with("rest", F.slice("argv", 2, F.size("rest")), lambda alts, w: F.array_contains(alts, F.coalesce(w, F.lit("")))), lambda b: b)
    return x.where((F.size("argv") > F.size("rest")) & ((F.size("rest") == 0) | fits)).select("id", "severity", (F.size("rest") + 1).alias("matched"))


def decide(commands, rules, fallback):
    """The most severe decision of each command's rules, ``fallback`` where none fits."""
    worst = match_rules(commands, rules).groupBy("id").agg(F.max("severity").alias("severity"))
    return commands.select("id").join(worst, "id", "left").select("id", F.coalesce("severity", F.lit(fallback)).alias("severity"))


def suffixes(host):
    """A host and all its parents, as an array."""
    parts = F.split(host, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def match_hosts(hosts, patterns):
    """``hosts(host)`` by ``patterns(pattern, allow)``: exact, ``*.`` below, ``**.`` at or below, ``*`` any; deny wins, else an allow is needed.

    Equi-joins of a host's parents with the patterns' bases.
    """
    p = patterns.select("allow", F.regexp_replace("pattern", r"^\*{1,2}\.", "").alias("base"), F.when(F.col("pattern") == "*", "any").when(F.col("pattern").startswith("**."), "tree").when(F.col("pattern").startswith("*."), "below").otherwise("exact").alias("how"))
    h = hosts.select("host").distinct()
    up = h.select("host", F.explode(F.concat(suffixes(F.col("host")), F.array(F.lit("*")))).alias("base"))
    fits = up.join(p, "base").where(((F.col("how") == "exact") & (F.col("base") == F.col("host"))) | (F.col("how") == "tree") | (F.col("how") == "any") | ((F.col("how") == "below") & (F.col("base") != F.col("host"))))
    best = fits.groupBy("host").agg(F.min(F.col("allow").cast("int")).alias("allowed"))
    return h.join(best, "host", "left").select("host", (F.coalesce("allowed", F.lit(0)) == 1).alias("allowed"))


def longest_prefix(paths, roots):
    """The deepest root of each path that is the path or one of its parents: path, root."""
    parts = F.split("path", "/")
    up = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("root"))
    return up.join(roots.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))


#: A command line of words only: plain words, quoted words without substitutions, and the four operators.
_PIECE = r"""'[^']*'|"[^"$`\\]*"|[^\s'"<>$`(){}&|;\\#]++"""
_OPERATOR = r"&&|\|\||;|\|"


_WORD = f"(?:{_PIECE})++"


def is_word_list(line):
    """Whether a line holds only words, quoted words and operators between commands."""
    command = rf"{_WORD}(?:[ \t]+{_WORD})*"
    return line.rlike(rf"^[ \t]*{command}(?:[ \t]*(?:{_OPERATOR})[ \t]*{command})*[ \t]*$")


def command_arrays(lines, key, line):
    """(key, n, w, line): the n-th command of each line as an array of words. Other lines than ``is_word_list`` give no row; nor do null and empty lines."""
    parts = F.regexp_extract_all(line, F.lit(rf"((?:{_WORD}|{_OPERATOR}))"), 1)
    x = lines.where(is_word_list(F.col(line))).select(key, F.col(line).alias("_line"), F.posexplode(parts).alias("_at", "_w"))
    x = x.withColumn("_op", F.col("_w").rlike(rf"^(?:{_OPERATOR})$"))
    n = F.coalesce(F.sum(F.col("_op").cast("int")).over(W.partitionBy(key).orderBy("_at")), F.lit(0)).cast("int")
    words = x.withColumn("n", n).where("not _op").groupBy(key, "n").agg(F.sort_array(F.collect_list(F.struct("_at", "_w"))).alias("_l"), F.first("_line").alias("_line"))
    return words.select(key, "n", F.transform("_l", lambda p: F.regexp_replace(p["_w"], r"""'([^']*)'|"([^"]*)\"""", "$1$2")).alias("w"), F.col("_line").alias("line"))


def word_commands(lines, key, line):
    """(key, n, words): the n-th command of each line, its words joined by line ends; rows as in ``command_arrays``."""
    return command_arrays(lines, key, line).select(key, "n", F.array_join("w", "\n").alias("words"))


#: Networks that aren't public.
NETWORKS_4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
NETWORKS_6 = ("::1/128", "::/128", "fc00::/7", "fe80::/10", "ff00::/8")
_IPV4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)" + r"\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)" * 3 + "$"


def _non_public_4(host):
    """Whether a dotted address lies in one of NETWORKS_4; null for other texts."""
    parts = F.when(host.rlike(_IPV4), F.split(host, r"\."))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda n, x: n * 256 + x.try_cast("long"))
    networks = [ipaddress.ip_network(n) for n in NETWORKS_4]
    inside = lambda n: reduce(lambda a, b: a | b, [n.between(int(x.network_address), int(x.broadcast_address)) for x in networks])
    return F.exists(F.array(number), inside)


@F.pandas_udf(T.BooleanType())
def _non_public_6(host: pd.Series) -> pd.Series:
    four, six = ([ipaddress.ip_network(n) for n in names] for names in (NETWORKS_4, NETWORKS_6))

    def one(text):
        try:
            ip = ipaddress.IPv6Address(text)
        except ValueError:
            return False
        high, low = int(ip) >> 32, int(ip) & 0xFFFFFFFF
        held = ipaddress.IPv4Address(low)  # in ::/96 and ::ffff:0:0/96
        return any(ip in n for n in six) or (high in (0, 0xFFFF) and any(held in n for n in four))

    return host.map(lambda t: None if t is None else one(t))


def non_public(host):
    """Whether a normal host is this machine or an address that isn't public; a zone after '%' doesn't count. Other names: false; null: null."""
    host = F.substring_index(host, "%", 1)
    six = _non_public_6(F.when(F.contains(host, F.lit(":")), host))
    return F.when(host.isNotNull(), (host == "localhost") | F.coalesce(_non_public_4(host), six, F.lit(False)))
