"""Embedding whitening by incremental eigendecomposition.

1. Every partition keeps the spectrum (eigenvalues, orthonormal basis) of the
   scatter of the rows read so far and changes it by centred rank-one updates
   only: with z the update in the present basis, the new eigenvalues are the
   roots of the secular equation 1 + sum z_j^2 / (d_j - x) = 0, found between
   their poles after deflation (components of no weight, equal eigenvalues),
   and the new basis comes from z recomputed from the roots (Loewner), which
   stays orthogonal. A block of rows enters as the rows of its centred
   triangular factor (the same scatter in at most as many rows as dimensions),
   then as one update for the shift of the mean; ``fold_rows=1`` updates by
   each row.
2. Spectra of partitions are combined, a few at a time, by successive rank-one
   updates: one for each eigenpair of the other and one for the two means.
3. Rayleigh-Ritz: one pass over the rows projects them, centred exactly, on the
   merged basis; the small matrix of these projections is diagonalised, which
   brings values and vectors to double precision.
4. A pass measures the covariance of the whitened rows, the last one returns them.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesops.llm.common import finite_by_length, tree_merge, vector_column

FOLD_ROWS = 2048
SCALE, OFFSET = 1024, 100000
# Entries from here on, once scaled, are no longer whole numbers a double can tell apart.
LIMIT = 2.0**42
_EPS = np.finfo(np.float64).eps
# Eigenvalues below this part of the largest are rounding errors of zero.
NO_SPREAD = 1e-12


def secular(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum z2 / (d - x)`` (d ascending and apart, z2 > 0), and d_j - root_i as a matrix (i, j)."""
    m = len(d)
    gap = np.append(np.diff(d), z2.sum())
    half = gap / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        at_mid = 1 + (z2 / (d[None, :] - d[:, None] - half[:, None])).sum(1)
    left = at_mid >= 0
    left[-1] = True
    origin = np.where(left, np.arange(m), np.minimum(np.arange(m) + 1, m - 1))
    base = d[None, :] - d[origin][:, None]
    lo, hi = np.where(left, 0.0, -half), np.where(left, half, 0.0)
    hi[-1] = gap[-1]
    mu = (lo + hi) / 2
    lower = np.tril(np.ones((m, m)))
    upper = 1 - lower
    own, after = np.arange(m), np.minimum(np.arange(m) + 1, m - 1)
    last = np.arange(m) == m - 1
    for _ in range(80):
        apart = base - mu[:, None]
        t = z2 / apart
        s = t / apart
        psi, phi = np.einsum("ij,ij->i", t, lower), np.einsum("ij,ij->i", t, upper)
        dpsi, dphi = np.einsum("ij,ij->i", s, lower), np.einsum("ij,ij->i", s, upper)
        f = 1 + psi + phi
        open_ = np.abs(f) > 1e-13 * m * (1 + np.abs(psi) + np.abs(phi))
        if not open_.any():
            break
        lo, hi = np.where(f < 0, mu, lo), np.where(f > 0, mu, hi)
        # Each side as a constant and one pole of equal value and slope.
        d1, d2 = apart[own, own], apart[own, after]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            c = f - d1 * dpsi - np.where(last, 0.0, d2 * dphi)
            a = c * (d1 + d2) + d1 * d1 * dpsi + d2 * d2 * dphi
            b = d1 * d2 * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(last, d1 + d1 * d1 * dpsi / c, np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root)))
            new = mu + step
        new = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
        if (new == mu)[open_].all():
            break
        mu = np.where(open_, new, mu)
    return d[origin] + mu, base - mu[:, None]


def rank_one(values: np.ndarray, basis: np.ndarray, v: np.ndarray, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of ``basis diag(values) basis' + weight v v'``; values ascending, not negative."""
    z = (v @ basis) * np.sqrt(weight)
    norm = float(z @ z)
    tol = 8 * _EPS * max(float(values[-1]), norm)
    live = np.abs(z) * np.sqrt(norm) > tol  # the others are deflated: their pair stays
    at = np.flatnonzero(live)
    if not len(at):
        return values, basis
    values, basis = values.copy(), basis.copy()
    near = np.diff(values[at]) * np.abs(z[at[1:]] * z[at[:-1]]) <= tol * (z[at[1:]] ** 2 + z[at[:-1]] ** 2)
    if near.any():
        # Equal eigenvalues: rotate the pair so that one of them has no part in the update.
        p = at[0]
        for i in at[1:]:
            t = np.hypot(z[p], z[i])
            c, s = z[i] / t, z[p] / t
            if (values[i] - values[p]) * abs(c * s) <= tol:
                basis[:, [p, i]] = basis[:, [p, i]] @ np.array([[c, s], [-s, c]])
                values[p], values[i] = values[p] * c * c + values[i] * s * s, values[p] * s * s + values[i] * c * c
                z[p], z[i], live[p] = 0.0, t, False
            p = i
        at = np.flatnonzero(live)
        at = at[np.argsort(values[at], kind="stable")]
    d, zl = values[at], z[at]
    roots, apart = secular(d, zl * zl)
    m = len(d)
    if m > 1:
        j, i = np.arange(m - 1)[:, None], np.arange(m)[None, :]
        ratio = -apart[:-1] / (d[j + (j >= i)] - d[i])
        zl = np.copysign(np.sqrt(np.maximum(ratio.prod(0) * -apart[-1], 0)), zl)
    turn = (zl / apart).T
    turn /= np.sqrt((turn * turn).sum(0))
    values[at], basis[:, at] = roots, basis[:, at] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


class Spectrum:
    """Count, mean and eigendecomposition of a scatter matrix."""

    def __init__(self, dims: int):
        self.n, self.mean = 0, np.zeros(dims)
        self.values, self.basis = np.zeros(dims), np.eye(dims)

    def shift(self, n: int, mean: np.ndarray) -> None:
        """Let the mean take in ``n`` rows of another mean."""
        gap = mean - self.mean
        if self.n:
            self.values, self.basis = rank_one(self.values, self.basis, gap, self.n * n / (self.n + n))
        self.mean = self.mean + gap * (n / (self.n + n))
        self.n += n

    def fold(self, rows: np.ndarray) -> None:
        mean = rows.mean(0)
        if len(rows) > 1:
            centred = rows - mean
            for r in np.linalg.qr(centred, mode="r") if len(rows) > rows.shape[1] else centred:
                self.values, self.basis = rank_one(self.values, self.basis, r)
        self.shift(len(rows), mean)

    def combine(self, other: Spectrum) -> None:
        for value, v in zip(other.values, other.basis.T, strict=True):
            if value > 0:
                self.values, self.basis = rank_one(self.values, self.basis, v, value)
        self.shift(other.n, other.mean)

    def pack(self) -> bytes:
        return b"".join(np.ascontiguousarray(x).tobytes() for x in (self.mean, self.values, self.basis))

    @classmethod
    def unpack(cls, dims: int, n: int, data: bytes) -> Spectrum:
        out, x = cls(dims), np.frombuffer(data)
        out.n, out.mean, out.values, out.basis = n, x[:dims], x[dims : 2 * dims], x[2 * dims :].reshape(dims, dims)
        return out


def whole_numbers(m: np.ndarray) -> np.ndarray:
    """``floor(1024 * c)``; the offset of 100000 moves only the sums."""
    return np.floor(m * SCALE).astype(np.int64)


PART = "place int, dims int, n long, sums array<decimal(38,0)>, data binary"
_SUMS = pa.list_(pa.decimal128(38, 0))


def _part(place: int, dims: int, n: int, sums: list[int], data: bytes) -> pa.RecordBatch:
    cols = [pa.array([place], pa.int32()), pa.array([dims], pa.int32()), pa.array([n], pa.int64()), pa.array([[Decimal(s) for s in sums]], _SUMS), pa.array([data], pa.binary())]
    return pa.record_batch(cols, names=["place", "dims", "n", "sums", "data"])


def _merged(key, table: pa.Table, data: bytes) -> pa.Table:
    """One part of the group ``key`` (dims, up), with the same columns as its parts."""
    sums = [int(sum(c)) for c in zip(*table["sums"].to_pylist(), strict=True)]
    one = pa.Table.from_batches([_part(0, key[0].as_py(), sum(table["n"].to_pylist()), sums, data)])
    return one.append_column("up", pa.array([key[1].as_py()], pa.int32()))


def _combine_spectra(key, table: pa.Table) -> pa.Table:
    dims, whole = key[0].as_py(), None
    for n, data in zip(table["n"].to_pylist(), table["data"].to_pylist(), strict=True):
        one = Spectrum.unpack(dims, n, data)
        if whole is None:
            whole = one
        else:
            whole.combine(one)
    return _merged(key, table, whole.pack())


def _add_matrices(key, table: pa.Table) -> pa.Table:
    return _merged(key, table, sum(np.frombuffer(x) for x in table["data"].to_pylist()).tobytes())


def fit_spectra(rows: DataFrame, fold_rows: int = FOLD_ROWS) -> dict[int, tuple[int, list[int], Spectrum]]:
    """For each vector length: count, exact sums of x, and the combined spectrum."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Spectrum, list[int]]] = {}
        for b in batches:
            for dims, _, m in finite_by_length(b.column("v"), LIMIT):
                spectrum, sums = held.get(dims) or (Spectrum(dims), [0] * dims)
                x = whole_numbers(m)
                for at in range(0, len(x), fold_rows):
                    spectrum.fold(x[at : at + fold_rows].astype(np.float64))
                # 31 low bits and the rest apart: neither sum leaves 64 bits.
                low, high = (x & 0x7FFFFFFF).sum(0), (x >> 31).sum(0)
                held[dims] = spectrum, [s + int(a) + (int(h) << 31) + OFFSET * len(x) for s, a, h in zip(sums, low, high, strict=True)]
        place = TaskContext.get().partitionId()
        for dims, (spectrum, sums) in held.items():
            yield _part(place, dims, spectrum.n, sums, spectrum.pack())

    parts = tree_merge(rows.select("v").mapInArrow(fit, PART), ["dims"], _combine_spectra, "whitening-spectra")
    return {r["dims"]: (r["n"], [int(s) for s in r["sums"]], Spectrum.unpack(r["dims"], r["n"], bytes(r["data"]))) for r in parts.collect()}


class Centre:
    """The exact mean as whole numbers and a rest below one."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n - OFFSET for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])
        self.left = [s % n for s in sums]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S)^2, exact."""
        y = x - self.whole
        bound = (int(np.abs(y).max(initial=0)) + 1) * self.n
        if bound * bound * max(x.shape[1], 1) < 2**63:
            return ((y * self.n - np.array(self.left, np.int64)) ** 2).sum(1).tolist()
        return [sum((self.n * v - w) ** 2 for v, w in zip(r, self.left, strict=True)) for r in y.tolist()]


def _scatter(rows: DataFrame, maps: dict[int, tuple[Centre, np.ndarray]], name: str) -> dict[int, np.ndarray]:
    """For each length the sums of p and of p p', p = centred row times its matrix: a (k + 1) x (k + 1) matrix."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for dims, _, m in finite_by_length(b.column("v"), LIMIT):
                centre, by = maps[dims]
                p = np.hstack([np.ones((len(m), 1)), centre.centred(whole_numbers(m)) @ by])
                held[dims] = held.get(dims, 0.0) + p.T @ p
        place = TaskContext.get().partitionId()
        for dims, s in held.items():
            yield _part(place, dims, 0, [], s.tobytes())

    parts = tree_merge(rows.select("v").mapInArrow(project, PART), ["dims"], _add_matrices, name)
    return {r["dims"]: np.frombuffer(bytes(r["data"])).reshape(maps[r["dims"]][1].shape[1] + 1, -1) for r in parts.collect()}


def whiten(vectors: DataFrame, components: int = 8, *, id_col: str = "vec_id", vector_col: str = "embedding", fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Each row on the leading principal components, scaled to variance one.

    A component c becomes the whole number x = floor(1024 * c) + 100000; the
    covariance of x has divisor n. Returns, for each row and component up to
    ``components``: ``vec_id, component`` (from 1, by falling eigenvalue), ``n,
    deviation`` (decimal: sum over dimensions of (n * x - S)^2, exact),
    ``whitened, explained`` (eigenvalue over trace) and ``identity_error``
    (largest absolute entry of the whitened rows' measured covariance less the
    identity; one value for all lengths).

    Defined cases: vectors that are null, empty or hold null or non-finite
    entries, or entries of 2^42 or more, are dropped. Rows with a null id take part
    and keep it; repeated rows count and come back each. Vectors of another
    length are a fit of their own, with their own n. A component without spread
    (its eigenvalue below 1e-12 of the largest) has a null ``whitened``, takes
    no part in the error and explains 0; the error of a fit without any spread
    is 0. Of vectors with fewer dimensions each has one component. The sign of
    an eigenvector makes its largest entry positive. Ties of eigenvalues leave
    any basis of their space. An empty table gives an empty result. Other
    columns are ignored. The table is read four times; store it first if its
    plan is dear or not deterministic.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector_column(vectors, vector_col).alias("v"))

    fits = fit_spectra(rows, fold_rows)
    centres = {dims: Centre(n, sums) for dims, (n, sums, _) in fits.items()}
    bases = {dims: np.linalg.qr(s.basis)[0] for dims, (_, _, s) in fits.items()}
    ritz = _scatter(rows, {d: (centres[d], bases[d]) for d in fits}, "whitening-ritz") if fits else {}
    maps, shares = {}, {}
    for dims, s in ritz.items():
        n = centres[dims].n
        small = s[1:, 1:] / n - np.outer(s[0, 1:], s[0, 1:]) / n**2
        e, u = np.linalg.eigh((small + small.T) / 2)
        e, u = e[::-1][:components], (bases[dims] @ u)[:, ::-1][:, :components]
        u = u * np.where(u[np.abs(u).argmax(0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
        spread = e > NO_SPREAD * max(e[0], 0.0)
        maps[dims] = (centres[dims], np.where(spread, u / np.sqrt(np.where(spread, e, 1.0)), 0.0), spread)
        shares[dims] = np.where(spread, e / np.trace(small) if spread.any() else 0.0, 0.0)
    error = 0.0
    for dims, s in _scatter(rows, {d: m[:2] for d, m in maps.items()}, "whitening-identity").items() if maps else ():
        n, spread = centres[dims].n, maps[dims][2]
        cov = (s[1:, 1:] / n - np.outer(s[0, 1:], s[0, 1:]) / n**2)[np.ix_(spread, spread)]
        error = max(error, float(np.abs(cov - np.eye(len(cov))).max(initial=0.0)))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dims, at, m in finite_by_length(b.column("v"), LIMIT):
                centre, by, spread = maps[dims]
                x, k = whole_numbers(m), by.shape[1]
                w = centre.centred(x) @ by
                ids = b.column("vec_id").take(pa.array(np.repeat(at, k)))
                far = pa.array([Decimal(d) for d in centre.deviation(x)], pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(x)), k)))
                repeat = lambda a, t: pa.array(np.tile(a, len(x)), t)
                yield pa.record_batch(
                    [ids, repeat(np.arange(1, k + 1), pa.int32()), pa.array(np.full(len(x) * k, centre.n), pa.int64()), far,
                     pa.array(w.ravel(), pa.float64(), mask=np.tile(~spread, len(x))), repeat(shares[dims], pa.float64()), pa.array(np.full(len(x) * k, error), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(apply, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
