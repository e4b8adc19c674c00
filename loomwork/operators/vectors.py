"""Cosine nearest neighbours of a stated set of query vectors, in blocks."""

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Numbers in a block of queries, of vectors, and in a slice of scores held at once.
QUERIES, VECTORS, SCORES = 1 << 20, 1 << 19, 1 << 21
#: Parts of the vectors at most; each sends its best of every query.
PARTS = 32


def _packed(df, numbers):
    """Rows of up to ``numbers`` numbers as bytes: vec_ids, in order, and vectors of one length."""

    def pack(batches):
        held = {}

        def out(dim, ids, x):
            order = np.argsort(ids, kind="stable")
            return pd.DataFrame({"dim": [dim], "ids": [ids[order].tobytes()], "x": [x[order].tobytes()]})

        for pdf in batches:
            lengths = pdf["embedding"].map(len).to_numpy()
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                x = np.concatenate(pdf["embedding"].to_numpy()[at]).astype(float).reshape(len(at), dim)
                ids, x = (np.concatenate(p) for p in zip(held.pop(dim, (np.zeros(0, np.int64), np.zeros((0, dim)))), (pdf["vec_id"].to_numpy(np.int64)[at], x), strict=True))
                n = max(1, numbers // max(1, dim))
                for k in range(0, len(ids) - n + 1, n):
                    yield out(dim, ids[k : k + n], x[k : k + n])
                held[dim] = ids[len(ids) // n * n :], x[len(ids) // n * n :]
        for dim, (ids, x) in held.items():
            if len(ids):
                yield out(dim, ids, x)

    return df.where("vec_id is not null and size(embedding) > 0").select("vec_id", "embedding").mapInPandas(pack, "dim int, ids binary, x binary")


class Block:
    """Vectors of finite norm (of a positive one, for queries), as they are and of norm 1 in single precision."""

    def __init__(self, dim, ids, x, asks):
        ids, x = np.frombuffer(ids, np.int64), np.frombuffer(x).reshape(-1, dim)
        norms = np.linalg.norm(x, axis=1)
        some = np.isfinite(norms) & ((norms > 0) | (not asks))
        self.ids, self.x, self.norms = ids[some], x[some], norms[some]
        self.unit = np.divide(self.x, self.norms[:, None], out=np.zeros(self.x.shape), where=self.norms[:, None] > 0).astype(np.float32)


class Best:
    """The best ``k`` of a block of queries among all blocks of vectors met so far."""

    def __init__(self, block, k):
        self.q, self.k = block, k
        self.scores, self.ids = np.full((len(block.ids), k), -np.inf), np.zeros((len(block.ids), k), np.int64)

    def exact(self, rows, at, v):
        """Scores of queries ``rows`` with vectors ``at``, a few at a time."""
        out = np.zeros(len(rows))
        for lo in range(0, len(rows), 1 << 14):
            r, c = rows[lo : lo + (1 << 14)], at[lo : lo + (1 << 14)]
            norms = self.q.norms[r] * v.norms[c]
            out[lo : lo + (1 << 14)] = np.divide(np.einsum("ij,ij->i", self.q.x[r], v.x[c]), norms, out=np.zeros(len(r)), where=norms > 0)
        return np.round(out, 6)

    def meet(self, v):
        n, (_, dim) = max(1, SCORES // max(1, len(v.ids))), v.x.shape
        slack = (dim + 4) * 6e-8 + 1e-6  # of single precision, and of scores rounded to six places
        for lo in range(0, len(self.q.ids) if len(v.ids) else 0, n):
            s = self.q.unit[lo : lo + n] @ v.unit.T
            least = self.scores[lo : lo + n, -1] - slack
            rows, at = np.nonzero(s >= least[:, None]) if np.isfinite(least).all() else (None, None)
            if rows is None or len(rows) > s.size // 50:  # the first block, or many alike: a place by score, then by id
                norms = np.outer(self.q.norms[lo : lo + n], v.norms)
                s = np.divide(self.q.x[lo : lo + n] @ v.x.T, norms, out=np.zeros(norms.shape), where=norms > 0)
                place = np.rint(np.round(s, 6) * 1e6).astype(np.int64) * len(v.ids) - np.arange(len(v.ids))
                k = min(self.k, len(v.ids))
                at = np.argpartition(place, len(v.ids) - k, axis=1)[:, len(v.ids) - k :].ravel()
                rows = np.repeat(np.arange(len(s)), k)
                self.take(lo + rows, np.round(s[rows, at], 6), v.ids[at])
            elif len(rows):
                self.take(lo + rows, self.exact(lo + rows, at, v), v.ids[at])

    def take(self, rows, scores, ids):
        old = np.unique(rows)
        row = np.r_[np.repeat(old, self.k), rows]
        score, name = np.r_[self.scores[old].ravel(), scores], np.r_[self.ids[old].ravel(), ids]
        order = np.lexsort((name, -score, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        best = order[rank < self.k]
        self.scores[old], self.ids[old] = score[best].reshape(-1, self.k), name[best].reshape(-1, self.k)


def knn(vectors, queries, k=5, min_score=-1.0):
    """query_id, vec_id, score, rank of the best ``k`` of ``vectors(vec_id, embedding)``; ties by vec_id.

    A stored vector of norm 0 scores 0; a query of norm 0 has no result, vectors of a norm that isn't finite neither; vectors of other lengths than the query's
    don't count. Both sides are packed in blocks. Each part of the vectors meets each part of the queries block by block and keeps the best ``k``
    for each query, so what is shuffled is k rows a query and part. Scores in single precision choose those that are worked out in double.
    """
    dim = max(1, vectors.agg(F.max(F.size("embedding"))).first()[0] or 0)
    parts = lambda df, numbers, most: max(1, min(most, -(-df.count() * dim // numbers)))
    v, q = parts(vectors, VECTORS, PARTS), parts(queries, QUERIES, 1 << 15)
    asked = _packed(queries, QUERIES).select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x"))
    met = _packed(vectors, VECTORS).repartition(v).join(asked.repartition(q).hint("shuffle_replicate_nl"), F.col("dim") == F.col("q_dim"))

    def score(batches):
        best, last, block = {}, None, None
        for pdf in batches:
            for dim, ids, x, q_ids, q_x in pdf[["dim", "ids", "x", "q_ids", "q_x"]].itertuples(index=False):
                if (dim, ids, x) != last:
                    last, block = (dim, ids, x), Block(dim, ids, x, False)
                name = dim, q_ids, q_x
                if name not in best:
                    best[name] = Best(Block(dim, q_ids, q_x, True), k)
                best[name].meet(block)
        for b in best.values():
            rows, at = np.nonzero((b.scores >= min_score) & (b.scores > -np.inf))
            yield pd.DataFrame({"query_id": b.q.ids[rows], "vec_id": b.ids[rows, at], "score": b.scores[rows, at]})

    local = met.mapInPandas(score, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
