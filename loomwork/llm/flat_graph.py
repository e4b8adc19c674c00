"""Operator 7: near-duplicate embeddings by a robust-pruned flat graph.

Vectors go to the shards of their nearest centres, several each, so shards overlap. Each shard builds a graph by robust
pruning; the adjacency lists of all shards are united. Greedy search from the shard's medoid over the united
lists, widened to the range of the link threshold, finds the links of the vectors at home in a shard; only
links that join something new are written. Links are cosines in double precision. Counting a vector's links is
exact within its component. Recall is audited against brute force for a bounded sample of vectors.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from . import _shared as S

SHARD_ROWS, MAX_CENTRES, SAMPLE = 1500, 4096, 20_000
NEAR, RANDOM, DEGREE, ALPHA, BEAM = 32, 16, 24, 1.2, 32
#: Components up to so many distinct vectors are counted in one task; larger ones in pairs of chunks of that size.
GROUP, BINS = 4096, 64


def _matrix(column):
    return np.array(column.tolist(), float).reshape(len(column), -1)


def unit_vectors(table):
    """vec_id, x (unit, double) of the usable vectors: no nulls, no non-finite values, not zero. Repeated rows count once."""
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(F.transform("x", lambda v: v * v), F.lit(0.0), lambda s, v: s + v))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    v = table.where("vec_id is not null and embedding is not null").select("vec_id", x.alias("x")).where(fine).withColumn("norm", norm)
    v = v.where((F.col("norm") > 0) & (F.col("norm") < float("inf"))).select("vec_id", F.transform("x", lambda c: c / F.col("norm")).alias("x"))
    v = v.dropDuplicates(["vec_id"])
    # vectors of the commonest length; of equally common ones the shorter
    usual = v.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    return v.join(F.broadcast(usual), F.size("x") == F.col("n"), "left_semi")


def centres(vectors, n, seed=7):
    """Unit centres: spherical k-means on a sample of at most SAMPLE vectors, those of least hash. Their number grows with the rows, up to MAX_CENTRES."""
    sample = _matrix(vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()["x"])
    k = int(min(MAX_CENTRES, len(sample), max(1, -(-n // SHARD_ROWS))))
    c = sample[np.random.default_rng(seed).choice(len(sample), k, replace=False)]
    for _ in range(4):
        near = np.concatenate([(sample[i : i + 2000] @ c.T).argmax(1) for i in range(0, len(sample), 2000)])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def _assign(shared, overlap):
    def assign(batches):
        c = shared.value
        m = min(overlap, len(c))
        for pdf in batches:
            near = np.argsort(-(_matrix(pdf["x"]) @ c.T), axis=1, kind="stable")[:, :m]
            yield pd.DataFrame({"vec_id": np.repeat(pdf["vec_id"].to_numpy(), m), "x": [x for x in pdf["x"] for _ in range(m)], "centre": near.ravel(), "home": np.tile(np.arange(m) == 0, len(pdf))})

    return assign


def _prune(x, rng):
    """Adjacency (rows, DEGREE), -1 where empty: robust pruning of the nearest and some random vectors of a shard."""
    n = len(x)
    out = np.full((n, DEGREE), -1, np.int64)
    for lo in range(0, n, 512):
        q = np.arange(lo, min(n, lo + 512))
        sims = x[q] @ x.T
        sims[np.arange(len(q)), q] = -2
        k = min(NEAR, n - 1)
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        cand = np.c_[near, rng.integers(0, n, (len(q), RANDOM))]
        far = 1 - np.take_along_axis(sims, cand, 1)
        order = np.argsort(far, axis=1, kind="stable")
        cand, far = np.take_along_axis(cand, order, 1), np.take_along_axis(far, order, 1)
        alive = (cand != q[:, None]) & (np.c_[np.full(len(q), -1), cand[:, :-1]] != cand)
        between = 1 - np.einsum("qid,qjd->qij", x[cand], x[cand])
        taken = np.zeros(len(q), np.int64)
        for j in range(cand.shape[1]):
            pick = np.flatnonzero(alive[:, j] & (taken < DEGREE))
            out[q[pick], taken[pick]] = cand[pick, j]
            taken[pick] += 1
            alive[pick] &= ~(ALPHA * between[pick, j] <= far[pick])
    return out


def _build(seed):
    def build(pdf):
        pdf = pdf.sort_values("vec_id", kind="stable")
        ids, x = pdf["vec_id"].to_numpy(), _matrix(pdf["x"])
        if len(x) < 2:
            return pd.DataFrame({"src": ids[:0], "dst": ids[:0]})
        adj = _prune(x, np.random.default_rng([seed, len(x)]))
        i, j = np.nonzero(adj >= 0)
        return pd.DataFrame({"src": ids[i], "dst": ids[adj[i, j]]})

    return build


class _Sets:
    def __init__(self, n):
        self.parent = list(range(n))

    def root(self, x):
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _greedy(x, adj, queries, start):
    """Beam search for all queries at once: (ids, cosines) of the beams."""
    n = len(queries)
    beam = np.full((n, BEAM), -1)
    beam[:, 0] = start
    sims = np.where(beam >= 0, (x[queries] @ x[start])[:, None], -2.0)
    done = np.zeros((n, BEAM), bool)
    live = np.arange(n)
    for _ in range(4 * BEAM):
        open_ = np.where(done[live] | (beam[live] < 0), -3.0, sims[live])
        pick = open_.argmax(1)
        go = open_[np.arange(len(live)), pick] > -3
        live, pick = live[go], pick[go]
        if not len(live):
            break
        done[live, pick] = True
        near = adj[beam[live, pick]]
        s = np.where(near >= 0, np.einsum("qd,qrd->qr", x[queries[live]], x[near]), -2.0)
        ids, val = np.c_[beam[live], near], np.c_[sims[live], s]
        mark = np.c_[done[live], np.zeros(near.shape, bool)]
        order = np.lexsort((~mark, ids, -val), axis=1)  # equal ids have equal cosines: the seen one first
        ids, val, mark = (np.take_along_axis(a, order, 1) for a in (ids, val, mark))
        again = np.c_[np.zeros(len(live), bool), ids[:, 1:] == ids[:, :-1]] | (ids < 0)
        val = np.where(again, -2.0, val)
        order = np.argsort(-val, axis=1, kind="stable")[:, :BEAM]
        ids, val, mark = (np.take_along_axis(a, order, 1) for a in (ids, val, mark))
        beam[live], sims[live], done[live] = np.where(val > -2, ids, -1), val, mark | (val <= -2)
    return beam, sims


def _search(threshold):
    def search(pdf):
        pdf = pdf.sort_values("vec_id", kind="stable").reset_index(drop=True)
        ids, x = pdf["vec_id"].to_numpy(), _matrix(pdf["x"])
        n, at = len(ids), {v: i for i, v in enumerate(ids.tolist())}
        lists = [[at[v] for v in a if v in at] if a is not None else [] for a in pdf["adj"]]
        adj = np.full((n, max(1, max(map(len, lists)))), -1)
        for i, a in enumerate(lists):
            adj[i, : len(a)] = a
        sets, found = _Sets(n), []

        def link(q, v):  # candidate pairs: joins those in range, returns the joined ones
            keep = v >= 0
            q, v = q[keep], v[keep]
            s = np.concatenate([np.einsum("pd,pd->p", x[q[i : i + 50_000]], x[v[i : i + 50_000]]) for i in range(0, max(1, len(q)), 50_000)])
            near = np.flatnonzero((s >= threshold) & (q != v))
            new = [k for k in near.tolist() if sets.join(int(q[k]), int(v[k]))]
            found.extend(zip(ids[q[new]].tolist(), ids[v[new]].tolist(), strict=True))
            return q[new], v[new]

        mean = x.mean(0)
        medoid = int((x @ mean).argmax())
        home = np.flatnonzero(pdf["home"].to_numpy())
        frontier = [link(np.repeat(np.arange(n), adj.shape[1]), adj.ravel())]
        for lo in range(0, len(home), 1000):
            q = home[lo : lo + 1000]
            beam, _ = _greedy(x, adj, q, medoid)
            frontier.append(link(np.repeat(q, BEAM), beam.ravel()))
        q, v = (np.concatenate(z) for z in zip(*frontier, strict=True))
        while len(q):  # the range grows over the neighbours of what was joined
            q, v = link(np.repeat(q, adj.shape[1]), adj[v].ravel())
        return pd.DataFrame(found, columns=["a", "b"])

    return search


def _count_small(threshold):
    def count(pdf):
        parts = []
        for _, g in pdf.groupby("component"):
            x, w = _matrix(g["x"]), g["copies"].to_numpy(float)
            n = np.concatenate([((x[i : i + 512] @ x.T) >= threshold) @ w for i in range(0, len(x), 512)])
            own = (np.einsum("pd,pd->p", x, x) >= threshold) * w
            parts.append(pd.DataFrame({"vec_id": g["vec_id"], "n_links": np.rint(n - own + w - 1).astype(np.int64)}))
        return pd.concat(parts)

    return count


def _count_pair(threshold):
    def count(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"vec_id": [], "n": []})
        x, y, w = _matrix(left["x"]), _matrix(right["x"]), right["copies"].to_numpy(float)
        n = np.concatenate([((x[i : i + 512] @ y.T) >= threshold) @ w for i in range(0, len(x), 512)])
        return pd.DataFrame({"vec_id": left["vec_id"], "n": np.rint(n).astype(np.int64)})

    return count


def _count_large(members, threshold):
    """Exact counts in large components. By angle from the component's pivot, pairs of bins surely in or out of range are counted as such; the rest are compared in chunks."""
    pivot = members.where("vec_id = component").select("component", F.col("x").alias("p"))
    dot = F.aggregate(F.zip_with("x", "p", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    angle, most = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))), float(np.arccos(threshold))
    m = members.join(pivot, "component").withColumn("angle", angle)
    m = m.withColumn("bin", F.floor(F.col("angle") / np.pi * BINS * 4).cast("int")).drop("p")
    sizes = m.groupBy("component", "bin").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.sum("copies").alias("n"), F.count("*").alias("rows"))
    m = m.join(sizes.select("component", "bin", F.ceil(F.col("rows") / GROUP).alias("chunks")), ["component", "bin"])
    m = m.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")))
    a = sizes.select("component", F.col("bin").alias("i"), F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i"), F.ceil(F.col("rows") / GROUP).alias("ci"))
    b = sizes.select("component", F.col("bin").alias("j"), F.col("lo").alias("lo_j"), F.col("hi").alias("hi_j"), "n", F.ceil(F.col("rows") / GROUP).alias("cj"))
    pairs = a.join(b, "component").where(F.greatest(F.col("lo_i") - F.col("hi_j"), F.col("lo_j") - F.col("hi_i")) <= most + 1e-9)
    sure = F.col("hi_i") + F.col("hi_j") < most - 1e-9
    certain = pairs.where(sure).groupBy("component", F.col("i").alias("bin")).agg(F.sum("n").alias("n"))
    certain = m.join(certain, ["component", "bin"]).select("vec_id", "n")
    unsure = pairs.where(~sure).select("component", "i", "j", F.explode(F.sequence(F.lit(0), F.col("ci").cast("int") - 1)).alias("p"), "cj")
    unsure = unsure.select("component", "i", "j", "p", F.explode(F.sequence(F.lit(0), F.col("cj").cast("int") - 1)).alias("q"))
    key = ["component", "i", "j", "p", "q"]
    left = m.withColumnsRenamed({"bin": "i", "chunk": "p"}).join(unsure, ["component", "i", "p"]).select(*key, "vec_id", "x", "copies")
    right = m.withColumnsRenamed({"bin": "j", "chunk": "q"}).join(unsure, ["component", "j", "q"])
    right = right.select(*[F.col(c).alias(c) for c in (*key, "vec_id", "x", "copies")])  # new columns, apart from those of the left side
    compared = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_count_pair(threshold), "vec_id long, n long")
    return certain.union(compared).groupBy("vec_id").agg((F.sum("n") - 1).alias("n_links"))


def audit(vectors, counted, threshold, sample=256):
    """Links found over links there are, for ``sample`` vectors of least hash against all rows; 1 where there are none."""
    some = counted.where("n_links is not null").orderBy(F.xxhash64(F.lit(1), "vec_id"), "vec_id").limit(sample).select("vec_id", "n_links")
    known = vectors.join(F.broadcast(some), "vec_id").toPandas()
    if not len(known):
        return 1.0
    shared = vectors.sparkSession.sparkContext.broadcast(_matrix(known["x"]))

    def hits(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [int((_matrix(pdf["x"]) @ shared.value.T >= threshold).sum()) if len(pdf) else 0]})

    there = (vectors.select("x").mapInPandas(hits, "n long").agg(F.sum("n")).first()[0] or 0) - len(known)
    return 1.0 if there <= 0 else float(known["n_links"].sum()) / there


def near_vectors(table, threshold=0.95, overlap=3, seed=7):
    """vec_id, n_links, component_id, kept and recall (the audit's, on every row) of every row of ``table(vec_id, embedding)``.

    Vectors that are null, zero or hold null or non-finite components link with nothing: n_links 0, component_id = vec_id,
    kept true. Null ids: n_links 0, component_id null, kept false. Equal vectors are searched as one and counted as
    many. Rows that repeat a vec_id are one vector and give equal rows. Vectors of another length than the commonest (of equally
    common ones the shorter) link with nothing either. Other
    columns, labels among them, aren't read. An empty table gives an empty result.
    """
    spark = table.sparkSession
    S.ensure_checkpoint_dir(spark)
    table = table.select("vec_id", "embedding")
    vectors = unit_vectors(table).checkpoint()
    distinct = vectors.groupBy("x").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")).checkpoint()
    n = distinct.count()
    if n == 0:
        none = table.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return none.withColumn("kept", F.col("vec_id").isNotNull()).withColumn("recall", F.lit(1.0))
    c = spark.sparkContext.broadcast(centres(distinct, n, seed))
    dealt = distinct.select("vec_id", "x").mapInPandas(_assign(c, overlap), "vec_id long, x array<double>, centre int, home boolean")
    sizes = {r[0]: r[1] for r in dealt.groupBy("centre").count().collect()}  # at most MAX_CENTRES rows
    # an outsized shard is halved by random directions until its parts are of ordinary size
    bits = [max(0, int(np.ceil(np.log2(max(1, sizes.get(i, 0)) / (4 * overlap * SHARD_ROWS))))) for i in range(len(c.value))]
    planes = np.random.default_rng(seed + 1).standard_normal((max(1, *bits), c.value.shape[1]))

    def halve(batches):
        for pdf in batches:
            b = np.array(bits)[pdf["centre"]]
            side = (_matrix(pdf["x"]) - c.value[pdf["centre"]]) @ planes.T > 0
            code = sum((side[:, k] & (k < b)).astype(np.int64) << k for k in range(len(planes)))
            yield pdf.assign(shard=pdf["centre"].to_numpy().astype(np.int64) << 32 | code)

    sharded = dealt.mapInPandas(halve, "vec_id long, x array<double>, centre int, home boolean, shard long").drop("centre").checkpoint()
    edges = sharded.groupBy("shard").applyInPandas(_build(seed), "src long, dst long")
    lists = edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("adj")).withColumnRenamed("src", "vec_id")
    ready = sharded.join(lists, "vec_id", "left")
    links = ready.groupBy("shard").applyInPandas(_search(threshold), "a long, b long")
    comp = S.components(links).withColumnRenamed("id", "vec_id")
    members = distinct.join(comp, "vec_id")
    large = members.groupBy("component").count().withColumnRenamed("count", "size")
    members = members.join(large, "component").checkpoint()
    buckets = max(1, n // GROUP)
    small = members.where(F.col("size") <= GROUP).withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets)))
    counted = small.groupBy("bucket").applyInPandas(_count_small(threshold), "vec_id long, n_links long")
    over = members.where(F.col("size") > GROUP)
    if not over.isEmpty():
        counted = counted.union(_count_large(over, threshold))
    per = distinct.join(comp, "vec_id", "left").join(counted, "vec_id", "left")
    per = per.select("x", F.coalesce("n_links", F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    every = vectors.join(per, "x").select("vec_id", "n_links", "component_id").checkpoint()
    # the smallest id of a component is that of its first distinct vector
    recall = audit(vectors, every, threshold)
    out = table.select("vec_id").join(every, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))).withColumn("recall", F.lit(recall))


def op7_flat_graph(spark, sf_dir):
    return near_vectors(S.table(spark, sf_dir, "embeddings"))


QUERIES = {"op7_flat_graph": op7_flat_graph}

ORACLES = {
    "op7_flat_graph": """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
      l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
      r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
      SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, c AS component_id, vec_id = c AS kept, 1.0::DOUBLE AS recall FROM embeddings JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) ON a = vec_id"""
}
