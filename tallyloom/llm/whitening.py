"""Embedding whitening by Chebyshev-filtered subspace iteration.

A vector c becomes the integers x = floor(64 * c) + 1000000; the distinct ones are the
fit list, written once. Every pass over it is a Spark job: partitions multiply centred
rows with a small block Q and return Xᵀ(XQ), summed by row of the matrix; the driver
holds matrices of one vector's length by a few dozen columns, however many vectors there
are. A few passes of a single column (Lanczos) bound the spectrum from below. Each step
then applies a Chebyshev polynomial of the covariance by its three-term recurrence, a
pass for each degree, which damps the spectrum between that bound and the block's
smallest Ritz value; QR and Rayleigh-Ritz follow. Steps go on until the residual of
every wanted pair is certified to be as small as rounding leaves it.

The whitened fit list's covariance is then measured by one more pass.

Sums of x are exact integers; covariances are of centred doubles, and the part of the
centre before the point is taken off in integers.

Defined results: vectors that are null, empty, or hold null or non-finite components
give no rows; nor do components without variance (where all vectors are alike, or there
are fewer than components); vectors of different lengths are fitted apart; repeated rows
are each whitened, and count once in the fit; entries of 64 * c beyond 2**60 are taken as that; a
deviation beyond a long is null; equal eigenvalues share a space, of which any basis
comes back, the same for all rows; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import materialize, partitions, sliced, table

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
GUARD, DEGREE, LANCZOS, STEPS = 16, 10, 8, 60  # further columns of the block; passes of a step; of the bound; steps at most
SMALL, TINY = 1e-11, 1e-14  # residuals as parts of the largest eigenvalue: those that certify, and those that need no further step
MOST = 2.0**60
FLAT = 1e-10  # an eigenvalue below that part of the largest one is none


class Fit(NamedTuple):
    """What whitens vectors of one length."""

    n: int
    sums: list[int]
    vectors: np.ndarray  # columns
    values: np.ndarray
    trace: float
    error: float


def integers(embedding: str | Column = "embedding") -> Column:
    return F.transform(embedding, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(MOST)), F.lit(-MOST))) + SHIFT)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, x of each row that takes part."""
    c = F.col("embedding")
    good = (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.coalesce(good, F.lit(False))).select("vec_id", integers().alias("x"))


def by_length(batches, name: str = "x", rows: int = 4096):
    """Each batch's rows of one length as (batch, length, matrix of longs)."""
    for b in sliced(batches, rows):
        x = b.column(b.schema.get_field_index(name))
        sizes = x.value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(sizes):
            part = b if (sizes == d).all() else b.filter(pa.array(sizes == d))
            flat = part.column(part.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)
            yield part, int(d), flat.reshape(-1, int(d))


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n as doubles."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole) - np.array([(s % n) / n for s in sums])


class Passes:
    """Jobs over the fit list that sum matrices; counts them."""

    def __init__(self, fit_list: DataFrame):
        self.rows, self.n_jobs = fit_list, 0

    def sum_of(self, make) -> dict[int, np.ndarray]:
        """length -> sum of make(length, x), which gives a matrix (or None, where there is nothing to do for a length)."""
        self.n_jobs += 1

        def local(batches):
            total: dict[int, np.ndarray] = {}
            for _, d, x in by_length(batches):
                if (m := make(d, x)) is not None:
                    total[d] = total[d] + m if d in total else m
            for d, m in total.items():
                yield rows_of([(d, i, r.tobytes()) for i, r in enumerate(m)])

        def added(batches):
            total: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                for d, i, raw in zip(*(b.column(k).to_pylist() for k in range(3))):
                    r = np.frombuffer(raw, kind)
                    total[d, i] = total[d, i] + r if (d, i) in total else r
            yield rows_of([(d, i, r.tobytes()) for (d, i), r in total.items()])

        def rows_of(items):
            return pa.record_batch([pa.array([v[k] for v in items], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["dim", "row", "raw"])

        kind = make.kind if hasattr(make, "kind") else np.float64
        schema = "dim int, row int, raw binary"
        parts = self.rows.mapInArrow(local, schema).repartition(partitions(self.rows.sparkSession), "dim", "row")
        found: dict[int, dict[int, np.ndarray]] = {}
        for r in parts.mapInArrow(added, schema).collect():  # as many rows as a vector has entries
            found.setdefault(r["dim"], {})[r["row"]] = np.frombuffer(r["raw"], kind)
        return {d: np.array([m[i] for i in range(len(m))]) for d, m in found.items()}

    def centres(self) -> dict[int, tuple[int, list[int]]]:
        """length -> number of rows and exact sums."""

        def halves(d, x):  # the upper and the lower 31 bits, each of which adds up within a long
            return np.vstack([np.full(d, len(x), np.int64), (x >> 31).sum(axis=0), (x & (2**31 - 1)).sum(axis=0)])

        halves.kind = np.int64
        return {d: (int(m[0][0]), [int(a) * 2**31 + int(b) for a, b in zip(m[1], m[2])]) for d, m in self.sum_of(halves).items()}

    def products(self, centre: dict, blocks: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Covariance times block, for each length of blocks."""

        def local(d, x):
            if d not in blocks:
                return None
            c = centred(x, *centre[d])
            return c.T @ (c @ blocks[d])

        return {d: m / centre[d][0] for d, m in self.sum_of(local).items()}


def start(d: int, columns: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(d).standard_normal((d, columns)))[0]


def lower_bounds(passes: Passes, centre: dict, dims: list[int], steps: int = LANCZOS) -> dict[int, float]:
    """Below each covariance's spectrum: the smallest Ritz value of a few Lanczos steps, less the residual's norm; 0 at least."""
    state = {d: (start(d, 1)[:, 0], np.zeros(d), 0.0, [], []) for d in dims}
    for _ in range(steps):
        got = passes.products(centre, {d: s[0][:, None] for d, s in state.items()})
        for d, (v, before, beta, alphas, betas) in state.items():
            w = got[d][:, 0] - beta * before
            alphas.append(float(w @ v))
            w -= alphas[-1] * v
            norm = float(np.linalg.norm(w))
            betas.append(norm)
            state[d] = (w / norm if norm else np.zeros(d), v, norm, alphas, betas)
    out = {}
    for d, (*_, alphas, betas) in state.items():
        t = np.diag(alphas) + np.diag(betas[:-1], 1) + np.diag(betas[:-1], -1)
        out[d] = max(0.0, float(np.linalg.eigvalsh(t)[0]) - betas[-1])
    return out


def eigenpairs(passes: Passes, centre: dict, components: int, guard: int = GUARD, degree: int = DEGREE, steps: int = STEPS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> eigenvectors (columns) and eigenvalues of the covariance, largest first."""
    width = {d: min(d, components + max(guard, components)) for d in centre}
    q = {d: start(d, width[d]) for d in centre}
    low = lower_bounds(passes, centre, [d for d in centre if width[d] < d]) if any(width[d] < d for d in centre) else {}
    done: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    best: dict[int, float] = {}
    for _ in range(steps):
        v = passes.products(centre, q)
        ritz = {}
        for d in list(q):
            values, turn = np.linalg.eigh((q[d].T @ v[d] + v[d].T @ q[d]) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            basis, image, k = q[d] @ turn, v[d] @ turn, min(components, d)
            residual = np.linalg.norm(image[:, :k] - basis[:, :k] * values[:k], axis=0).max() / max(values[0], 1e-300)
            stuck = residual <= SMALL and residual > best.get(d, np.inf) / 4  # rounding leaves no more
            if residual <= TINY or stuck or values[0] <= 0:
                done[d] = basis[:, :k], values[:k]
                del q[d]
                continue
            best[d], ritz[d] = residual, values
            q[d] = basis
        if not q:
            return done
        # the polynomial of each length that is left, scaled to 1 at the largest Ritz value
        half = {d: max((ritz[d][-1] - low.get(d, 0.0)) / 2, ritz[d][0] * 1e-6) for d in q}
        mid = {d: low.get(d, 0.0) + half[d] for d in q}
        sigma = {d: half[d] / (ritz[d][0] - mid[d]) for d in q}
        first, before, now = dict(sigma), dict(q), {}
        for k in range(degree):
            v = passes.products(centre, now or q)
            for d in q:
                y = now.get(d, q[d])
                if not k:
                    new = (v[d] - mid[d] * y) * (sigma[d] / half[d])
                else:
                    s = 1 / (2 / first[d] - sigma[d])
                    new = (v[d] - mid[d] * y) * (2 * s / half[d]) - before[d] * (sigma[d] * s)
                    sigma[d] = s
                before[d], now[d] = y, new
        q = {d: np.linalg.qr(now[d])[0] for d in q}
    raise ArithmeticError(f"no certified eigenvectors after {steps} steps")


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[dict[int, Fit], int]:
    """length -> Fit, and the number of passes."""
    passes = Passes(materialize(usable(vectors).select("x").distinct(), "fit"))
    centre = passes.centres()
    if not centre:
        return {}, passes.n_jobs
    traces = {d: float(m.sum()) / centre[d][0] for d, m in passes.sum_of(lambda d, x: np.square(centred(x, *centre[d])).sum(axis=0)[:, None]).items()}
    pairs = {}
    for d, (vectors_, values) in eigenpairs(passes, centre, components).items():
        real = values > max(FLAT * values[0], 0.0)
        pairs[d] = vectors_[:, real], values[real]

    def moments(d, x):
        w = centred(x, *centre[d]) @ (pairs[d][0] / np.sqrt(pairs[d][1]))
        return np.vstack([w.sum(axis=0), w.T @ w]) if w.shape[1] else None

    errors = {}
    for d, m in passes.sum_of(moments).items():
        n, mean = centre[d][0], m[0] / centre[d][0]
        errors[d] = float(np.abs(m[1:] / n - np.outer(mean, mean) - np.eye(m.shape[1])).max())
    return {d: Fit(*centre[d], *pairs[d], traces[d], errors.get(d, 0.0)) for d in centre}, passes.n_jobs


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - sums) ** 2, exact; None beyond a long."""
    most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums))
    if most * most * len(sums) < 2**63:
        return np.square(n * x - np.array(sums, np.int64)).sum(axis=1).tolist()
    whole = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    near = x - whole
    most = n * max(abs(int(near.max())), abs(int(near.min()))) + n
    if np.abs(whole).max() < 2**61 and most * most * len(sums) < 2**63:
        return np.square(n * near - np.array(rest, np.int64)).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each usable row and component."""
    found, _ = fit(vectors, components)
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for b, d, x in by_length(batches, rows=1024):
            f = found[d]
            k = len(f.values)
            w = centred(x, f.n, f.sums) @ (f.vectors / np.sqrt(f.values))
            r = len(x)
            yield pa.record_batch([
                b.column(0).take(pa.array(np.repeat(np.arange(r), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)), pa.array(np.full(r * k, f.n)),
                pa.array(deviations(x, f.n, f.sums), pa.int64()).take(pa.array(np.repeat(np.arange(r), k))), pa.array(w.ravel()),
                pa.array(np.tile(f.values / f.trace, r)), pa.array(np.full(r * k, f.error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable(vectors).mapInArrow(run, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": op12_whitening}
ORACLES: dict[str, str] = {}
