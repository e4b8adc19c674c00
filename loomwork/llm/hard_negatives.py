"""Operator 12: hard negatives by bounds along spanning trees of anchors.

Anchors are dealt to trees of near ones; in each a minimal spanning tree joins every anchor with a parent. A candidate's score
with the parent, plus and minus the edge's length times the candidate's norm, bounds its score with the child: only candidates whose
bounds overlap a window that is still open are scored again, all others pass their bounds on to the grandchildren. A first scan finds
the positives (window: no less than the last of the best so far), a second one the negatives of each positive's window.

Scores are integers. Each scan reads the candidates where they lie: blocks of anchors, of a fixed size, go to them. A scan runs in rounds over
slices of the rows, each seven times all before it, and the best of the earlier rounds narrow the windows of the next: a
window's candidates that leave a task are a few for each round, however many rows there are.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _shared as S

#: Anchors of a tree, trees that are sent to the candidates at once, candidates that are bounded at once, rows of the first slice.
TREE, TREES, CHUNK, FIRST = 1024, 16, 4096, 65_536
NONE = np.iinfo(np.int64).min


def spanning_tree(a):
    """(order, parent, edge) of a minimal spanning tree of the rows of ``a`` by Prim's rule: rows in order of joining, the place in that order of each one's parent (-1: root) and the distance to it."""
    n = len(a)
    root = int(((a - a.mean(0)) ** 2).sum(1).argmin())
    order, place = [root], np.full(n, -1)
    place[root] = 0
    near, best = np.full(n, root), ((a - a[root]) ** 2).sum(1)
    parent, edge = [-1], [0.0]
    for k in range(1, n):
        at = int(np.where(place < 0, best, np.inf).argmin())
        order.append(at)
        parent.append(int(place[near[at]]))
        edge.append(float(np.sqrt(best[at])))
        place[at] = k
        far = ((a - a[at]) ** 2).sum(1)
        closer = far < best
        near[closer], best[closer] = at, far[closer]
    return np.array(order), np.array(parent), np.array(edge)


def _tree(pdf):
    pdf = pdf.sort_values("place", kind="stable")
    order, parent, edge = spanning_tree(S.matrix(pdf["x"]))
    return pdf.iloc[order][["t", "anchor_id", "label", "x"]].assign(pos=np.arange(len(pdf)), parent=parent, edge=edge)


def _codes(batches):
    """Rows get a code by which near anchors come together: signs along fixed random directions, the leading ones first."""
    for pdf in batches:
        x = S.matrix(pdf["x"])
        side = x @ np.random.default_rng(11).standard_normal((x.shape[1], 20)) > 0
        yield pdf.assign(code=side @ (1 << np.arange(20)[::-1]))


class _Tree:
    """A tree's anchors by levels, and the windows [lo, hi] (slots) of each with what is known of the best in them."""

    def __init__(self, pdf, exact):
        pdf = pdf.sort_values("pos", kind="stable")
        self.x, self.id, self.label = S.matrix(pdf["x"], exact), pdf["anchor_id"].to_numpy(), pdf["label"].to_numpy()
        self.parent, self.edge = pdf["parent"].to_numpy(), pdf["edge"].to_numpy()
        self.key, self.longest = int(pdf["t"].iloc[0]), float(np.sqrt((self.x.astype(float) ** 2).sum(1)).max())
        self.lo, self.hi = S.matrix(pdf["lo"], "int64"), S.matrix(pdf["hi"], "int64")
        depth = np.zeros(len(pdf), int)
        for k in range(1, len(pdf)):
            depth[k] = depth[self.parent[k]] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]
        self.best = [np.zeros((0, 4), np.int64)]  # pos, slot, score, id

    def settle(self, k):
        """Keeps the k best of each slot; full slots take nothing below the last of them."""
        found = np.concatenate(self.best)
        if not len(found):
            return found
        found = found[np.lexsort((found[:, 3], -found[:, 2], found[:, 1], found[:, 0]))]
        new = np.r_[True, (found[1:, :2] != found[:-1, :2]).any(1)]
        start = np.maximum.accumulate(np.where(new, np.arange(len(found)), 0))
        rank = np.arange(len(found)) - start
        found = found[rank < k]
        last = found[rank[rank < k] == k - 1]
        self.lo[last[:, 0], last[:, 1]] = np.maximum(self.lo[last[:, 0], last[:, 1]], last[:, 2])
        self.best = [found]
        return found

    def take(self, x, norm, label, ids, same):
        """Candidates (a chunk) against all anchors of the tree, level by level; the number of scores made."""
        low, high, place, made = None, None, np.full(len(self.x), -1), 0
        for nodes in self.levels:
            floor, ceiling = self.lo[nodes].min(1), self.hi[nodes].max(1)
            if low is None:
                lo, hi = np.full((len(x), len(nodes)), -np.inf), np.full((len(x), len(nodes)), np.inf)
            else:
                up = place[self.parent[nodes]]
                wide = norm[:, None] * self.edge[nodes]
                wide += 1e-9 * wide + 1e-9 + 1e-12 * norm[:, None] * self.longest  # rounding of lengths, norms and scores
                lo, hi = low[:, up] - wide, high[:, up] + wide
            again = (hi >= floor) & (lo <= ceiling)
            again &= (label[:, None] == self.label[nodes]) == same
            if low is None:
                again[:] = True
            i, j = np.nonzero(again)
            made += len(i)
            if len(i) > again.size // 8:
                s = (x @ self.x[nodes].T)[i, j]
            else:
                s = np.concatenate([np.einsum("pd,pd->p", x[i[b : b + 65_536]], self.x[nodes[j[b : b + 65_536]]]) for b in range(0, len(i), 65_536)] or [np.zeros(0)])
            lo[i, j] = hi[i, j] = s
            s, at = s.astype(np.int64), nodes[j]
            fit = ((label[i] == self.label[at]) == same) & ((ids[i] != self.id[at]) if same else True)
            i, s, at = i[fit], s[fit], at[fit]
            for slot in range(self.lo.shape[1]):
                hit = np.flatnonzero((s >= self.lo[at, slot]) & (s <= self.hi[at, slot]))
                if len(hit):
                    self.best.append(np.c_[at[hit], np.full(len(hit), slot), s[hit], ids[i[hit]]])
            low, high = lo, hi
            place[:] = -1
            place[nodes] = np.arange(len(nodes))
        return made


def _scan(shared, same, k, exact):
    """A task's best k of every slot of every anchor of the block: t, pos, slot, score, id, and in a last row the scores that were made."""

    def scan(batches):
        trees = [_Tree(g, exact) for _, g in shared.value.groupby("t")]
        size, made = 256, 0
        for pdf in batches:
            x, label, ids = S.matrix(pdf["x"], exact), pdf["label"].to_numpy(), pdf["vec_id"].to_numpy()
            norm = np.sqrt((x.astype(float) ** 2).sum(1))
            lo = 0
            while lo < len(x):  # the first chunks are small: they raise the floors of the windows
                hi = min(len(x), lo + size)
                for t in trees:
                    made += t.take(x[lo:hi], norm[lo:hi], label[lo:hi], ids[lo:hi], same)
                    t.settle(k)
                lo, size = hi, min(CHUNK, 2 * size)
        for t in trees:
            found = t.settle(k)
            yield pd.DataFrame({"t": np.int64(t.key), "pos": found[:, 0], "slot": found[:, 1], "score": found[:, 2], "id": found[:, 3]})
        yield pd.DataFrame({"t": [-1], "pos": [-1], "slot": [-1], "score": [made], "id": [-1]})

    return scan


def _slices(n):
    """Rounds as shares [from, to) of 2^30 hashes: about FIRST rows, then seven times all before."""
    ends = [1 << 30]
    while n * ends[0] / (1 << 30) > 2 * FIRST:
        ends.insert(0, ends[0] // 8)
    return list(zip([0, *ends], ends, strict=False))


def _search(rows, trees, slots, n_blocks, n, same, k, exact):
    """The k best of every slot: t, pos, slot, rank, score, id. ``slots``: t, pos, slot, lo, hi (long, inclusive)."""
    spark, best, made = rows.sparkSession, None, 0
    top = W.partitionBy("t", "pos", "slot").orderBy(F.desc("score"), "id")
    hashed = F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 30))
    for start, end in _slices(n):
        part = rows.where((hashed >= start) & (hashed < end)) if (start, end) != (0, 1 << 30) else rows
        now = slots
        if best is not None:
            floor = best.groupBy("t", "pos", "slot").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
            now = slots.join(floor, ["t", "pos", "slot"], "left").withColumn("lo", F.greatest("lo", F.coalesce("floor", "lo"))).drop("floor")
        now = now.groupBy("t", "pos").agg(F.sort_array(F.collect_list(F.struct("slot", "lo", "hi"))).alias("w"))
        ready = trees.join(now, ["t", "pos"]).select("block", "t", "pos", "anchor_id", "label", "x", "parent", "edge", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi")).checkpoint()
        found = []
        for b in range(n_blocks):
            block = ready.where(F.col("block") == b).toPandas()  # at most TREE * TREES rows
            if len(block):
                shared = spark.sparkContext.broadcast(block)
                found.append(part.mapInPandas(_scan(shared, same, k, exact), "t long, pos long, slot long, score long, id long"))
        if not found:
            continue
        every = found[0]
        for f in found[1:]:
            every = every.union(f)
        every = every.checkpoint()
        made += every.where("t = -1").agg(F.sum("score")).first()[0] or 0
        every = every.where("t >= 0")
        if best is not None:
            every = every.union(best.drop("rank"))
        best = every.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).checkpoint()
    return best, made


def _trees(anchors, count):
    """The anchors with t, pos, parent, edge and block, and the number of blocks: TREE of them in the order of their codes make a tree, TREES trees a block."""
    spark = anchors.sparkSession
    dealt = anchors.repartitionByRange(min(2000, max(1, count // (4 * TREE))), "code", "anchor_id").sortWithinPartitions("code", "anchor_id", "label", "x")
    dealt = dealt.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33).cast("int")).checkpoint()
    ends, before = [], 0
    for r in dealt.groupBy("part").count().orderBy("part").collect():  # 2,000 rows at most, 211 or more on small tables
        ends.append((r["part"], before))
        before += r["count"]
    place = F.col("before") + F.col("row").bitwiseAND((1 << 33) - 1)
    placed = dealt.join(F.broadcast(spark.createDataFrame(ends, "part int, before long")), "part").withColumn("place", place).withColumn("t", F.floor(F.col("place") / TREE))
    trees = placed.groupBy("t").applyInPandas(_tree, "t long, anchor_id long, label long, x array<long>, pos long, parent long, edge double")
    return trees.withColumn("block", F.floor(F.col("t") / TREES)).checkpoint(), -(-count // (TREE * TREES))


def mine(table, every=50, positives=5, negatives=3, low=50, high=95, scale=256):
    """Hard negatives of ``table(vec_id, label, embedding)``: a row for each anchor, positive and rank.

    Anchors are rows whose vec_id is divisible by ``every``; an entry c counts as floor(scale * c), a score is the inner product. An anchor's positives are
    its best rows of the same label (``positives`` of them, the anchor's own id left out), and for each its best rows of other labels with low * positive score <= 100 * score <= high * positive
    score (``negatives`` of them). Ties go by the smaller id. A negative positive score has no such rows.

    Rows without id, label or vector, with null or non-finite entries, or of another length than the commonest take no part. Rows
    that repeat an id are rows of their own as candidates; an anchor's equal rows count once. Other columns aren't read. An empty
    table gives an empty result. Scores must be below 2^63; ``scored`` and ``pairs``, on every row, are the scores that both scans made and the pairs there are.
    """
    spark = table.sparkSession
    S.ensure_checkpoint_dir(spark)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, scored long, pairs long"
    rows = S.whole_vectors(table.where("vec_id is not null and label is not null").select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding"), scale)
    n, most, width = rows.agg(F.count("*"), F.max(F.expr("array_max(transform(x, v -> abs(v)))")), F.max(F.size("x"))).first()
    if not n:
        return spark.createDataFrame([], schema)
    bound = int(most) ** 2 * width
    if bound >= 1 << 63:
        raise ValueError("scores don't fit a long")
    exact = "float64" if bound < 1 << 53 else "int64"  # doubles hold such integers and their sums exactly
    anchors = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), "label", "x").distinct()
    anchors = anchors.mapInPandas(_codes, "anchor_id long, label long, x array<long>, code long").checkpoint()
    count = anchors.count()
    if not count:
        return spark.createDataFrame([], schema)
    trees, n_blocks = _trees(anchors, count)
    whole = trees.select("t", "pos", F.lit(0).alias("slot"), F.lit(NONE).alias("lo"), F.lit(-(NONE + 1)).alias("hi"))
    good, scored = _search(rows, trees, whole, n_blocks, n, True, positives, exact)
    windows = good.select("t", "pos", (F.col("rank") - 1).alias("slot"), "score", "id")
    # integers: ceil(low * s / 100), floor(high * s / 100)
    q = lambda e: F.expr(f"({e} - pmod({e}, 100)) div 100")
    windows = windows.withColumn("hi", q(f"(score * {high})")).withColumn("lo", -q(f"(-score * {low})")).checkpoint()
    bad, more = _search(rows, trees, windows.select("t", "pos", "slot", "lo", "hi"), n_blocks, n, False, negatives, exact)
    if bad is None:
        return spark.createDataFrame([], schema)
    named = windows.join(trees.select("t", "pos", "anchor_id"), ["t", "pos"]).select("t", "pos", "slot", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = named.join(bad.select("t", "pos", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["t", "pos", "slot"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", F.lit(scored + more).alias("scored"), F.lit(2 * count * n).alias("pairs"))


def op12_hard_negatives(spark, sf_dir):
    """Where vec_id is divisible by 7, the label is first moved on by one of ten."""
    t = S.table(spark, sf_dir, "embeddings")
    t = t.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(t).drop("scored", "pairs")


QUERIES = {"op12_hard_negatives": op12_hard_negatives}

ORACLES = {
    "op12_hard_negatives": """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
      s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
      p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
      n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
      SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
}
