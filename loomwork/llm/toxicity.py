"""Operator 2: toxicity by cumulative-link ordinal regression over sparse word features.

P(grade <= j) = sigmoid(t_j - w.x): one weight vector serves all ordered thresholds t_1 < t_2 < ... . It is
fitted on a bounded sample of labelled documents and scores whole texts of all documents on the executors.
"""


import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from . import _shared as S

#: Signs dropped from words, so that "word," and "word###" are the feature "word".
SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


#: Lengths in bytes of the beginnings of words that are features beside the whole words; they hold inflected forms together.
BEGINNINGS = (3, 4, 5, 6)


def words(text):
    """Distinct lower-cased words of a text without signs."""
    return set((text or "").encode().lower().translate(None, SIGNS).split())


def features(word):
    """The word itself (marked) and its beginnings."""
    return [word + b"$", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


def _features(batches):
    for pdf in batches:
        yield pd.DataFrame({"grade": pdf["grade"], "features": [sorted({f for w in words(t) for f in features(w)}) for t in pdf["text"]]})


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class OrdinalModel:
    """Fitted weights by feature and ordered thresholds; pickles to the executors."""

    def __init__(self, weights, thresholds):
        self.weights, self.thresholds = weights, np.asarray(thresholds, float)

    def above(self, texts):
        """P(grade > j) for every text (rows) and threshold j (columns)."""
        cache, signal = {}, np.zeros(len(texts))
        for i, text in enumerate(texts):
            seen = set()
            for w in words(text):
                hit = cache.get(w)
                if hit is None:
                    hit = cache[w] = tuple(f for f in features(w) if f in self.weights)
                if hit:
                    seen.update(hit)
            signal[i] = sum(self.weights[f] for f in sorted(seen))
        return _sigmoid(signal[:, None] - self.thresholds)


def fit_rows(rows, grades, n_grades, l2=0.02, steps=300):
    """Penalised maximum likelihood by resilient propagation: steps per coordinate that grow while signs hold (deterministic).

    ``rows``: a list of features for each document. The thresholds are a first one and log gaps, which keeps
    their order. Without rows, there are no weights and the thresholds are high.
    """
    vocabulary = {f: i for i, f in enumerate(sorted({f for r in rows for f in r}))}
    y, cuts = np.asarray(grades, np.int64), n_grades - 1
    if not len(y):
        return OrdinalModel({}, np.arange(cuts) + 5.0)
    at = np.fromiter((vocabulary[f] for r in rows for f in r), np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n, v = len(y), len(vocabulary)
    share = np.array([(np.sum(y > j) + 0.5) / (n + 1) for j in range(cuts)])
    first = np.log((1 - share) / share)
    base, gap = first[0], np.log(np.maximum(np.diff(first), 0.1))
    w, step, last = np.zeros(v), np.full(v + cuts, 0.02), np.zeros(v + cuts)
    for _ in range(steps):
        t = base + np.r_[0, np.cumsum(np.exp(gap))]
        s = np.bincount(of, w[at], n) * 1.0
        edge = np.column_stack([np.ones(n), _sigmoid(s[:, None] - t[None, :]), np.zeros(n)])  # P(grade >= j), j = 0..n_grades
        hi, lo = edge[np.arange(n), y], edge[np.arange(n), y + 1]
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_w = np.bincount(at, (d_hi - d_lo)[of], v) - l2 * w
        g_t = np.array([d_lo[y == j].sum() - d_hi[y == j + 1].sum() for j in range(cuts)])
        g_gap = np.array([g_t[j + 1 :].sum() for j in range(cuts - 1)]) * np.exp(gap)
        g = np.r_[g_w, g_t.sum(), g_gap]
        turn = np.sign(g) * np.sign(last)
        step = np.clip(step * np.where(turn > 0, 1.2, np.where(turn < 0, 0.5, 1.0)), 1e-7, 0.5)
        last = np.where(turn < 0, 0.0, g)
        move = np.sign(last) * step
        w += move[:v]
        base += move[v]
        gap = np.clip(gap + move[v + 1 :], -5, 5)
    return OrdinalModel({f: float(w[i]) for f, i in vocabulary.items()}, base + np.r_[0, np.cumsum(np.exp(gap))])


def association(n, k, rows, positives):
    """Likelihood ratio statistic, as a column, of a feature in ``n`` of ``rows`` documents, ``k`` of them among the ``positives``."""
    part = lambda x, of, p: F.when(x > 0, 2 * x * F.log(x / (of * p))).otherwise(0.0)
    p = positives / rows
    return part(k, n, p) + part(n - k, n, 1 - p) + part(positives - k, rows - n, p) + part(rows - n - positives + k, rows - n, 1 - p)


def severity_grades(labels, rows, tiers=2):
    """Grades for 0/1 labels: 0 where not toxic, else 1 to ``tiers`` by how much evidence (features) a document shows.

    The cuts are quantiles of the evidence among toxic documents that show any; one that shows none has grade 1.
    """
    evidence = np.array([len(r) for r in rows])
    toxic = np.asarray(labels) > 0
    shown = evidence[toxic & (evidence > 0)]
    if not len(shown):
        return toxic.astype(np.int64)
    cuts = np.quantile(shown, np.arange(1, tiers) / tiers, method="higher")
    return np.where(toxic, 1 + np.searchsorted(cuts, evidence, side="left"), 0)


def fit(docs, labels, tiers=2, max_rows=8_000, min_association=24.0, max_features=20_000, **kw):
    """Model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; severity has grades 0 to ``tiers``.

    At most ``max_rows`` labelled documents are used, those of least hash of the id, with their whole texts. Rows alike in doc_id and
    text are one document, different texts of one doc_id are documents of their own; so what is fitted doesn't grow with repeated rows.
    Features are the words and their beginnings whose presence goes with toxic labels by a likelihood
    ratio of at least ``min_association`` (24: about one in a million by chance), counted on the executors;
    of these at most ``max_features``, the strongest. Rows with null id, text or label don't count; a document
    labelled more than once is toxic if one of its labels says so. With labels of one kind only, nothing is toxic.
    """
    spark = docs.sparkSession
    S.ensure_checkpoint_dir(spark)
    labelled = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    chosen = labelled.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.where("text is not null").select("doc_id", "text")
    known = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", F.md5(F.col("text").cast("binary")).alias("digest")).distinct()
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "digest").limit(max_rows)
    texts = texts.withColumn("digest", F.md5(F.col("text").cast("binary"))).join(F.broadcast(known), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    rows = texts.select("grade", "text").mapInPandas(_features, "grade int, features array<binary>").checkpoint()
    total, positives = rows.agg(F.count("*"), F.count_if(F.col("grade") > 0)).first()
    if not 0 < positives < total:
        return fit_rows([], [], tiers + 1)
    counted = rows.select(F.explode("features").alias("f"), (F.col("grade") > 0).cast("int").alias("k")).groupBy("f").agg(F.count("*").alias("n"), F.sum("k").alias("k"))
    counted = counted.where((F.col("n") > 1) & (F.col("k") * total > F.col("n") * positives)).withColumn("g", association(F.col("n"), F.col("k"), F.lit(total), F.lit(positives)))
    strong = {bytes(r["f"]) for r in counted.where(F.col("g") >= min_association).orderBy(F.desc("g"), "f").limit(max_features).select("f").toLocalIterator()}
    shared = spark.sparkContext.broadcast(strong)

    def only(batches):
        for pdf in batches:
            yield pd.DataFrame({"grade": pdf["grade"], "features": [[f for f in map(bytes, r) if f in shared.value] for r in pdf["features"]]})

    few = rows.mapInPandas(only, "grade int, features array<binary>").toPandas()
    data = sorted((int(g), sorted(map(bytes, r))) for g, r in zip(few["grade"], few["features"], strict=True))
    rows = [r for _, r in data]
    return fit_rows(rows, severity_grades([g for g, _ in data], rows, tiers), tiers + 1, **kw)


def score(docs, model, reject_at=0.5):
    """doc_id, severity (expected grade), p_toxic (P(grade > 0)), grade (most probable) and rejected (p_toxic >= ``reject_at``).

    One row per input row. Null and empty texts have no words and get the base rates. Extra columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for pdf in batches:
            above = shared.value.above(pdf["text"])
            edge = np.column_stack([np.ones(len(pdf)), above, np.zeros(len(pdf))])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "severity": above.sum(1), "p_toxic": above[:, 0], "grade": (edge[:, :-1] - edge[:, 1:]).argmax(1), "rejected": above[:, 0] >= reject_at})

    return docs.select("doc_id", "text").mapInPandas(scored, "doc_id long, severity double, p_toxic double, grade int, rejected boolean")


def reject_toxic(docs, labels, reject_at=0.5, **kw):
    """``docs`` without the rejected documents; all columns. Null texts have no words and stay."""
    model = fit(docs, labels, **kw)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.above(text)[:, 0] < reject_at)

    return docs.where(clean("text"))


def op2_toxicity(spark, sf_dir):
    docs, labels = S.table(spark, sf_dir, "documents"), S.table(spark, sf_dir, "labels")
    return score(docs, fit(docs, labels))


QUERIES = {"op2_toxicity": op2_toxicity}
