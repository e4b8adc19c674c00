"""Operator 13: whitening by an incremental eigendecomposition.

Each partition keeps the eigenpairs of its scatter about its own mean. A batch of rows enters as centred rank-one updates: the batch about its
mean, as the rows of its triangular factor (which have the same scatter, one for each dimension instead of one for each row), and the
step between the means. An update solves the secular equation 1 + sum z_i^2 / (d_i - t) = 0 between its poles; directions that the
update doesn't touch, and all but one of each group of equal eigenvalues, are deflated first. Spectra of partitions are combined
sixteen at a time by successive updates with their scaled eigenvectors. A distributed Rayleigh-Ritz step in the
combined basis refines the result to double precision, and is repeated while the residual asks for it.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from . import _shared as S

#: Directions that a spectrum keeps at most (all, up to that many dimensions), entries of a batch, spectra combined in one task.
RANK, BATCH, FAN = 256, 1 << 20, 16
#: A Rayleigh-Ritz step is the last once the residuals of the components are below this share of the largest eigenvalue.
RESIDUAL, MOST_STEPS = 1e-12, 100
EPS = np.finfo(float).eps


def _together(d, z, vectors, tol):
    """Equal eigenvalues: a reflection turns their directions so that the update touches the last of each group only."""
    cuts = np.flatnonzero(np.diff(d) > tol) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(d)], strict=True):
        if b - a > 1 and np.abs(z[a : b - 1]).max() > 0:
            length = np.linalg.norm(z[a:b])
            w = z[a:b].copy()
            sign = 1.0 if w[-1] >= 0 else -1.0
            w[-1] += sign * length
            w /= np.linalg.norm(w)
            vectors[:, a:b] -= 2 * np.outer(vectors[:, a:b] @ w, w)
            z[a:b] = 0
            z[b - 1] = -sign * length
    return z, vectors


def secular_roots(d, z):
    """The roots of 1 + sum z_i^2 / (d_i - t), d ascending without equals, z without zeros, as (origin, offset): t = d[origin] + offset.

    Each root lies between its pole and the next (the last one: at most z.z beyond). It is measured from the nearer pole,
    so that its distances to the poles keep all digits; steps fit a rational function with these two poles, and halve the bracket where they leave it.
    """
    n, z2 = len(d), z * z
    j = np.arange(n)
    gap = np.r_[np.diff(d), z2.sum()]
    middle = 1 + (z2[:, None] / (d[:, None] - (d + gap / 2)[None, :])).sum(0)
    origin = np.where((middle >= 0) | (j == n - 1), j, j + 1)
    delta = d[:, None] - d[origin][None, :]
    lo, hi = np.where(origin == j, 0.0, -gap / 2), np.where(origin == j, np.where(j == n - 1, gap, gap / 2), 0.0)
    mu = (lo + hi) / 2
    left = j[:, None] <= j[None, :]
    for _ in range(60):
        gaps = delta - mu
        part = z2[:, None] / gaps
        f = 1 + part.sum(0)
        done = np.abs(f) <= 4 * EPS * n * (1 + np.abs(part).sum(0))
        if done.all():
            break
        lo, hi = np.where(f < 0, mu, lo), np.where(f >= 0, mu, hi)
        slope = part / gaps
        s, r = np.where(left, slope, 0).sum(0), np.where(left, 0, slope).sum(0)
        a, b = gaps[j, j], gaps[np.minimum(j + 1, n - 1), j]
        b = np.where(j == n - 1, gap - mu, b)
        # f ~ c + s a^2 / (a - step) + r b^2 / (b - step), equal in value and slope at step 0
        c = f - s * a - r * b
        p, q = c * (a + b) + s * a * a + r * b * b, f * a * b
        root = np.sqrt(np.maximum(p * p - 4 * c * q, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            one, two = 2 * q / (p + np.where(p >= 0, root, -root)), (p + np.where(p >= 0, root, -root)) / (2 * c)
        fits = lambda x: np.isfinite(x) & (mu + x > lo) & (mu + x < hi)
        step = np.where(fits(one), mu + one, np.where(fits(two), mu + two, (lo + hi) / 2))
        mu = np.where(done | (one == 0), mu, step)
    return origin, mu


def update(values, vectors, v):
    """Eigenpairs (values ascending) of vectors diag(values) vectors' + v v'. A direction that the vectors lack is added."""
    z = vectors.T @ v
    if vectors.shape[1] < vectors.shape[0]:
        rest = v - vectors @ z
        rest -= vectors @ (vectors.T @ rest)
        length = np.linalg.norm(rest)
        if length > 1e-13 * max(np.linalg.norm(v), 1e-300):
            values, vectors, z = np.r_[0.0, values], np.c_[rest / length, vectors], np.r_[length, z]
    order = np.argsort(values, kind="stable")
    d, u, z = values[order], vectors[:, order], z[order].copy()
    tol = 8 * EPS * max(abs(d[-1]), float(z @ z), 1e-300) if len(d) else 0.0
    z, u = _together(d, z, u, tol)
    live = np.abs(z) * np.linalg.norm(z) > tol
    k = np.flatnonzero(live)
    if len(k):
        dk, zk = d[k], z[k]
        origin, mu = secular_roots(dk, zk)
        at = (dk[origin][None, :] - dk[:, None]) + mu[None, :]  # t_j - d_i
        apart = dk[None, :] - dk[:, None]
        np.fill_diagonal(apart, 1.0)
        exact = np.sqrt(np.abs(np.prod(at / apart, axis=1))) * np.sign(zk)  # the z of which these are the exact roots: its vectors are orthogonal
        w = exact[:, None] / at
        w /= np.linalg.norm(w, axis=0)
        d, u = d.copy(), u.copy()
        d[k], u[:, k] = dk[origin] + mu, u[:, k] @ w
    order = np.argsort(d, kind="stable")[-RANK:]
    return d[order], u[:, order]


class Spectrum:
    """n, mean and eigenpairs of the scatter of the rows so far."""

    def __init__(self, width):
        self.n, self.mean = 0, np.zeros(width)
        self.values, self.vectors = (np.zeros(width), np.eye(width)) if width <= RANK else (np.zeros(0), np.zeros((width, 0)))

    def _join(self, n, mean, terms):
        for v in terms:
            self.values, self.vectors = update(self.values, self.vectors, v)
        if self.n:
            self.values, self.vectors = update(self.values, self.vectors, np.sqrt(self.n * n / (self.n + n)) * (mean - self.mean))
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n

    def add(self, x):
        mean = x.mean(0)
        centred = x - mean
        self._join(len(x), mean, np.linalg.qr(centred, mode="r") if len(x) > x.shape[1] else centred)

    def combine(self, n, mean, values, vectors):
        self._join(n, mean, (np.sqrt(e) * vectors[:, i] for i, e in enumerate(values) if e > 0))


SPECTRUM = "node long, n long, total array<long>, mean array<double>, eigenvalues array<double>, eigenvectors array<double>"


def _spectrum_row(node, n, total, s):
    return pd.DataFrame({"node": [node], "n": [n], "total": [total], "mean": [s.mean], "eigenvalues": [s.values], "eigenvectors": [s.vectors.ravel()]})


def _spectra(width):
    def spectra(batches):
        s, total, rest, node = Spectrum(width), np.zeros(width, np.int64), [], 0
        for pdf in batches:
            x = S.matrix(pdf["x"], "int64")
            total = total + x.sum(0)
            node = int(pdf["node"].iloc[0]) if len(pdf) else node
            rest.append(x)
            if sum(map(len, rest)) >= max(2 * width, BATCH // width):
                s.add(np.concatenate(rest).astype(float))
                rest = []
        if sum(map(len, rest)):
            s.add(np.concatenate(rest).astype(float))
        if s.n:
            yield _spectrum_row(node, s.n, total, s)

    return spectra


def _combine(pdf):
    pdf = pdf.sort_values("node", kind="stable")
    s = total = None
    for r in pdf.itertuples():
        width = len(r.mean)
        s = s or Spectrum(width)
        total = np.asarray(r.total) if total is None else total + np.asarray(r.total)
        s.combine(r.n, np.asarray(r.mean), np.asarray(r.eigenvalues), np.asarray(r.eigenvectors).reshape(width, -1))
    return _spectrum_row(int(pdf["node"].iloc[0]) // FAN, s.n, total, s)


def _add_up(pdf):
    return pd.DataFrame({"node": [int(pdf["node"].iloc[0]) // FAN], "sums": [np.sum(pdf.sort_values("node", kind="stable")["sums"].tolist(), axis=0)]})


def _tree(parts, merge, schema, n):
    """One row of the partitions' rows (node 0 to n - 1), FAN at a time."""
    while n > 1:
        parts, n = parts.groupBy(F.floor(F.col("node") / FAN)).applyInPandas(merge, schema), -(-n // FAN)
    return parts.first()


def _sums(fit, n_parts, make):
    """The sums over all rows of what ``make`` gives for a batch's x (a flat array)."""

    def part(batches):
        sums, node = None, 0
        for pdf in batches:
            if len(pdf):
                node = int(pdf["node"].iloc[0])
                y = make(S.matrix(pdf["x"]))
                sums = y if sums is None else sums + y
        if sums is not None:
            yield pd.DataFrame({"node": [node], "sums": [sums]})

    schema = "node long, sums array<double>"
    return np.array(_tree(fit.mapInPandas(part, schema), _add_up, schema, n_parts)["sums"])


def refine(fit, n_parts, n, mean, basis, wanted):
    """Eigenvalues (falling), eigenvectors and trace of the covariance by Rayleigh-Ritz steps in ``basis``; all of them, or the wanted ones to RESIDUAL."""
    width = len(mean)
    for _ in range(MOST_STEPS):
        q, _ = np.linalg.qr(basis)

        def times(x, q=q):
            y = x - mean
            return np.r_[(y.T @ (y @ q)).ravel(), (y * y).sum()]

        sums = _sums(fit, n_parts, times) / n
        image, trace = sums[:-1].reshape(width, -1), float(sums[-1])
        h = q.T @ image
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, images = q @ turn, image @ turn
        residual = np.linalg.norm(images[:, :wanted] - vectors[:, :wanted] * values[:wanted], axis=0).max()
        if q.shape[1] == width or residual <= RESIDUAL * max(values[0], 0):
            return values, vectors, trace
        basis = np.c_[vectors[:, :wanted], images]
        basis = basis[:, :RANK] if basis.shape[1] > RANK else basis
    raise ArithmeticError(f"residual {residual} after {MOST_STEPS} steps")


def whiten(table, components=4, scale=256):
    """Principal components of ``table(vec_id, embedding)``, whitened: a row for each remaining row and component.

    An entry c counts as x = floor(scale * c). Mean and covariance (divisor n) are those of the distinct x. ``whitened`` is x less the mean, along the
    component, over the root of its eigenvalue; ``explained`` the eigenvalue's share of the trace; ``deviation`` the exact sum of
    (n * x - sums)^2, null where it doesn't fit a long; ``identity_error`` the largest entry of the whitened fit list's covariance less the identity.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped, and those of another length than the commonest. Rows with null or
    repeated ids stay and get values of their own. A component's largest entry is positive. There are as many components as dimensions at most. Without variance
    along a component whitened and explained are 0, and it doesn't count for identity_error. Other columns aren't read. An empty table gives an empty result.
    """
    spark = table.sparkSession
    S.ensure_checkpoint_dir(spark)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = S.whole_vectors(table.select(F.col("vec_id").cast("long"), "embedding"), scale)
    fit = S.stored(rows.select("x").distinct(), "whitening").withColumn("part", F.spark_partition_id())
    parts = [r["part"] for r in fit.groupBy("part").count().orderBy("part").collect()]
    if not parts:
        return spark.createDataFrame([], schema)
    nodes = F.element_at(F.create_map(*[F.lit(v) for pair in zip(parts, range(len(parts)), strict=True) for v in pair]), F.col("part")) if parts != list(range(len(parts))) else F.col("part")
    fit = fit.select(nodes.cast("long").alias("node"), "x")
    width = len(fit.first()["x"])
    top = _tree(fit.mapInPandas(_spectra(width), SPECTRUM), _combine, SPECTRUM, len(parts))
    n, total = top["n"], np.array(top["total"], dtype=object)
    mean = np.array([int(t) / n for t in total])
    basis = np.array(top["eigenvectors"]).reshape(width, -1)
    k = min(components, width)
    values, vectors, trace = refine(fit, len(parts), n, mean, basis[:, ::-1], k)
    e, v = values[:k].copy(), vectors[:, :k]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(k)])
    flat = e <= 1e-13 * max(trace, 0)
    e[flat] = 0
    to = np.where(flat, 0, v / np.sqrt(np.where(flat, 1, e)))
    gram = lambda x: (lambda w: np.r_[(w.T @ w).ravel(), w.sum(0)])((x - mean) @ to)
    sums = _sums(fit, len(parts), gram) / n
    shift = sums[k * k :]
    error = np.abs(sums[: k * k].reshape(k, k) - np.outer(shift, shift) - np.diag((~flat).astype(float)))
    identity_error = float(error.max())
    explained = e / trace if trace > 0 else e
    shared = spark.sparkContext.broadcast((n, total, to, explained))

    def project(batches):
        n, total, to, explained = shared.value
        for pdf in batches:
            x = S.matrix(pdf["x"], "int64")
            most = max([0, *(abs(int(f())) for f in ((x.max, x.min) if len(x) else ()))]) * n + max(abs(int(t)) for t in total)
            if width * most * most < 1 << 62:
                off = n * x - total.astype(np.int64)
                deviation, off = (off * off).sum(1).astype(object), off.astype(float)
            else:
                off = n * x.astype(object) - total
                deviation = np.array([s if s < 1 << 63 else None for s in (off * off).sum(1)] or np.zeros(0), object)
                off = off.astype(float)
            w = (off / n) @ to
            yield pd.DataFrame({
                "vec_id": np.repeat(pdf["vec_id"].to_numpy(), k), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(pdf)), "n": n,
                "deviation": pd.array(np.repeat(deviation, k), "Int64"), "whitened": w.ravel(), "explained": np.tile(explained, len(pdf)), "identity_error": identity_error,
            })

    return rows.select("vec_id", "x").mapInPandas(project, schema)


def op13_whitening(spark, sf_dir):
    return whiten(S.table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_whitening": op13_whitening}
