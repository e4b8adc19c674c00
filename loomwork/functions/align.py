"""Fuzzy matching by alignment: the best way to find a needle's letters in order in a text, by dynamic programming with affine gaps.

A letter found scores MATCH, more at the beginning of a word or of a camel-case part (twice for the needle's first letter) and next to the letter
before; a gap between two letters costs OPEN and EXTEND for each further letter. What stands before the first and behind the last is free.
Needles in lower case match either case, others as they are written. A mask of letters keeps texts that lack one from ever reaching Python.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MATCH, BORDER, CAMEL, NEXT, OPEN, EXTEND = 16, 8, 7, 4, 3, 1
#: Texts of one length class are aligned together, so many entries at a time.
ENTRIES = 1 << 20
NONE = -(1 << 30)


def mask(column):
    """A bit for each letter of a text (codes modulo 64, case aside), null for null."""
    return F.expr(f"aggregate(split(lower({column}), ''), 0L, (a, c) -> a | shiftleft(1L, ascii(c) % 64))")


def _bonus(text):
    out, before = [], ""
    for c in text:
        camel = before.islower() and c.isupper() or c.isdigit() and before != "" and before.isalnum() and not before.isdigit()
        out.append(BORDER if c.isalnum() and not before.isalnum() else CAMEL if camel else 0)
        before = c
    return out


def scores(texts, needles):
    """The score of each pair, None where the needle isn't in the text or is empty."""
    out, todo = [None] * len(texts), {}
    for k, (t, n) in enumerate(zip(texts, needles, strict=True)):
        if t and n and len(n) <= len(t):
            todo.setdefault((len(n), max(8, 1 << (len(t) - 1).bit_length())), []).append(k)
    for (m, width), rows in todo.items():
        step = max(1, ENTRIES // width)
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            code, bonus = np.full((len(part), width), -1, np.int64), np.zeros((len(part), width), np.int64)
            for i, k in enumerate(part):
                t = texts[k]
                seen = t if needles[k] != needles[k].lower() else [c.lower()[:1] for c in t]
                code[i, : len(t)], bonus[i, : len(t)] = [ord(c) for c in seen], _bonus(t)
            wanted, at = np.array([[ord(c) for c in needles[k]] for k in part]), np.arange(width)
            best = None
            for j in range(m):
                hit = code == wanted[:, j : j + 1]
                if j == 0:
                    best = np.where(hit, MATCH + 2 * bonus, NONE)
                    continue
                close = np.full_like(best, NONE)
                close[:, 1:] = best[:, :-1] + np.maximum(bonus[:, 1:], NEXT)
                far = np.full_like(best, NONE)
                far[:, 2:] = np.maximum.accumulate(best + EXTEND * at, axis=1)[:, :-2] - OPEN - EXTEND * (at[2:] - 2) + bonus[:, 2:]
                best = np.where(hit, MATCH + np.maximum(close, far), NONE)
            for k, s in zip(part, best.max(1).tolist(), strict=True):
                out[k] = s if s > NONE // 2 else None
    return out


@F.pandas_udf(T.IntegerType())
def align(text: pd.Series, needle: pd.Series) -> pd.Series:
    return pd.Series(scores(text.tolist(), needle.tolist()), dtype="Int32")


def matches(texts, needles, text, block=256):
    """Pairs with a score: the columns of ``texts``, needle and score. ``needles(needle)`` is a stated set of queries: blocks of them meet all texts, pairs that lack a letter go before Python."""
    n = needles.where("needle <> ''").select("needle").distinct().withColumn("mask", mask("needle"))
    packed = n.groupBy(F.pmod(F.xxhash64("needle"), F.lit(max(1, -(-n.count() // block)))).alias("block")).agg(F.collect_list(F.struct("needle", "mask")).alias("needles"))
    near = texts.withColumn("_mask", mask(text)).crossJoin(packed.select("needles"))
    fits = F.filter("needles", lambda x: x["mask"].bitwiseAND(F.col("_mask")) == x["mask"])
    pairs = near.select(*texts.columns, F.explode(fits).alias("_n")).select(*texts.columns, F.col("_n.needle").alias("needle"))
    return pairs.withColumn("score", align(F.col(text), F.col("needle"))).where("score is not null")
