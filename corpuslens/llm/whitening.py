"""Whitening of embeddings by incremental eigendecomposition: rank-one updates, merged spectra, Rayleigh-Ritz."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.session import cut_lineage

# Fixed values of the integer scale.
SCALE, SHIFT = 1024, 100_000

COMPONENTS = 8
FAN_IN = 16  # spectra that one task merges
REFINEMENTS = 3  # Rayleigh-Ritz passes over the data at most
DIAGONAL = 1e-13  # a basis is settled if no entry off the diagonal is larger against its two diagonal entries
LARGEST = float(1 << 50)  # entries beyond are taken as this large, so that whole numbers hold them
NO_ID = -(1 << 63)

_EPS = np.finfo(np.float64).eps


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + rho z z', and the matrix d_j - root_i.

    ``d`` rises strictly, ``rho`` is positive and no z is 0.  Root i of the
    secular equation 1 + rho sum z_j^2 / (d_j - x) = 0 lies between d_i and
    d_(i+1), the last below d_n + rho z'z.  A root is held as its distance
    from the nearer pole, so that differences keep their digits.  All roots
    step together: the terms of the poles up to a root and of those beyond are
    each replaced by a rational function of one pole, whose common root is the
    next value; a step out of the bracket becomes a bisection.
    """
    n = len(d)
    w = rho * z * z
    after = np.append(d[1:], d[-1] + w.sum())
    gap = after - d
    # The pole that a root is nearer to, by the sign at the middle.
    middle = d + 0.5 * gap
    with np.errstate(divide="ignore", invalid="ignore"):
        value = 1.0 + (w[None, :] / (d[None, :] - middle[:, None])).sum(1)
    left = (value >= 0) | (np.arange(n) == n - 1)
    pole = np.where(left, d, after)
    away = d[None, :] - pole[:, None]  # exact where a pole is the origin
    low = np.where(left, 0.0, -0.5 * gap)
    high = np.where(left, np.where(np.arange(n) == n - 1, gap, 0.5 * gap), 0.0)
    upper = (np.arange(n)[None, :] > np.arange(n)[:, None]).astype(np.float64)
    x = 0.5 * (low + high)
    near, far = np.diagonal(away).copy(), np.append(np.diagonal(away, 1), after[-1] - pole[-1])
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for _ in range(60):
            delta = away - x[:, None]
            term = w / delta
            slope = term / delta
            rise_far = np.einsum("ij,ij->i", slope, upper)
            psi_far = np.einsum("ij,ij->i", term, upper)
            total = term.sum(1)
            rise_near = slope.sum(1) - rise_far
            f = 1.0 + total
            done = np.abs(f) <= 8 * _EPS * (1.0 + 2 * psi_far - total)
            done |= (high - low) <= 4 * _EPS * np.maximum(np.abs(low), np.abs(high))
            if done.all():
                break
            low, high = np.where(f < 0, x, low), np.where(f >= 0, x, high)
            # q / (near - x) + s / (far - x) + c = 0 with the values and slopes of both sums at x.
            a, b = near - x, far - x
            q, s = rise_near * a * a, rise_far * b * b
            c = f - rise_near * a - rise_far * b
            # c (a - t) (b - t) + q (b - t) + s (a - t) = 0 for the step t.
            k1, k0 = c * (a + b) + q + s, c * a * b + q * b + s * a
            root = np.sqrt(np.maximum(k1 * k1 - 4 * c * k0, 0.0))
            big = k1 + np.copysign(root, k1)
            t1, t2 = 2 * k0 / big, big / (2 * c)
            inside1 = (x + t1 > low) & (x + t1 < high)
            inside2 = (x + t2 > low) & (x + t2 < high)
            step = np.where(inside1, t1, np.where(inside2, t2, 0.5 * (low + high) - x))
            x = np.where(done, x, x + step)
    return pole + x, away - x[:, None]


def rank_one_update(values: np.ndarray, basis: np.ndarray, x: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of basis diag(values) basis' + rho x x', values rising.

    Deflation first: directions that x doesn't reach stay as they are, and
    directions of equal values are turned, by one reflection, so that x
    reaches one of them alone.  The vectors of the rest come from the z that
    has exactly the computed roots, so they are orthogonal to rounding.
    """
    z = x @ basis
    size = float(z @ z)
    if rho * size == 0.0:
        return values, basis
    scale = max(abs(values[0]), abs(values[-1]), rho * size)
    equal = 8 * _EPS * scale
    starts = np.flatnonzero(np.append(True, np.diff(values) > equal))
    if len(starts) < len(values):
        values, basis = values.copy(), basis.copy()
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(values)).tolist(), strict=True):
            if b - a > 1:
                v, length = z[a:b].copy(), float(np.linalg.norm(z[a:b]))
                if length > 0.0:
                    v[-1] += np.copysign(length, v[-1])
                    part = basis[:, a:b]
                    basis[:, a:b] = part - np.outer(part @ v, v * (2.0 / (v @ v)))
                    z[a:b] = 0.0
                    z[b - 1] = -np.copysign(length, v[-1])
    live = rho * z * z > equal * _EPS
    live &= np.abs(z) > _EPS * np.sqrt(size)
    if not live.any():
        return values, basis
    d, u = values[live], z[live]
    roots, delta = secular_roots(d, u, rho)
    # The z of these roots: z_j^2 = prod_i (root_i - d_j) / prod_(i != j) (d_i - d_j).
    apart = d[None, :] - d[:, None]
    np.fill_diagonal(apart, 1.0)
    ratio = -delta / np.where(np.eye(len(d), dtype=bool), 1.0, -apart)
    exact = np.sqrt(np.abs(np.prod(ratio, axis=0))) * np.sign(u)
    vectors = exact[None, :] / delta
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    out_values, out_basis = values.copy(), basis.copy()
    out_values[live] = roots
    out_basis[:, live] = basis[:, live] @ vectors.T
    order = np.argsort(out_values, kind="stable")
    return out_values[order], out_basis[:, order]


@dataclass
class Spectrum:
    """n vectors' mean and the spectrum of their scatter, the sum of (x - mean)(x - mean)'."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    basis: np.ndarray

    @staticmethod
    def empty(size: int) -> Spectrum:
        return Spectrum(0, np.zeros(size), np.zeros(size), np.eye(size))

    def add(self, x: np.ndarray) -> None:
        """One more vector: a centred update of rank one."""
        apart = x - self.mean
        if self.n:
            self.values, self.basis = rank_one_update(self.values, self.basis, apart, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + apart / self.n

    def merge(self, other: Spectrum) -> None:
        """The other's scatter, a direction at a time, and the two means' distance."""
        if not self.n or not other.n:
            if other.n:
                self.n, self.mean, self.values, self.basis = other.n, other.mean, other.values, other.basis
            return
        for value, direction in zip(other.values.tolist(), other.basis.T, strict=True):
            if value > 0.0:
                self.values, self.basis = rank_one_update(self.values, self.basis, direction, value)
        n, apart = self.n + other.n, other.mean - self.mean
        self.values, self.basis = rank_one_update(self.values, self.basis, apart, self.n * other.n / n)
        self.mean = self.mean + apart * (other.n / n)
        self.n = n

    def to_bytes(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.values, self.basis.ravel()]).astype("<f8").tobytes()

    @staticmethod
    def from_bytes(raw: bytes, size: int) -> Spectrum:
        x = np.frombuffer(raw, "<f8")
        return Spectrum(int(x[0]), x[1 : size + 1], x[size + 1 : 2 * size + 1], x[2 * size + 1 :].reshape(size, size))


def _tree(states: DataFrame, merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """One state out of a row (state) per task: FAN_IN at a time, level by level, so no task and not the driver holds many."""
    numbered = "state binary, number bigint"

    def renumbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        for frame in frames:
            yield frame[["state"]].assign(number=number)

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"state": [merge(frame["state"].tolist())], "number": [int(frame["group"].iloc[0])]})

    now = cut_lineage(states.mapInPandas(renumbered, numbered), "spectra")
    while now.count() > 1:
        width = int(now.agg(F.max("number")).first()[0]) + 1
        # A task gives one state, so numbers are below the number of tasks and groups have FAN_IN states at most.
        grouped = now.withColumn("group", F.floor(F.col("number") / FAN_IN) if width > FAN_IN else F.lit(0).cast("bigint"))
        now = cut_lineage(grouped.groupBy("group").applyInPandas(merged, numbered), "spectra")
    row = now.first()
    return None if row is None else bytes(row["state"])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def scaled(rows: DataFrame) -> DataFrame:
    """(id, x): vectors without null or non-finite entries, as whole numbers floor(1024 c) + 100000."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    limited = F.transform("embedding", lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.lit(float(SCALE)) * c.cast("double"))))
    whole = F.transform(limited, lambda c: F.floor(c) + SHIFT)
    kept = rows.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(fine)
    return kept.select(F.coalesce(F.col("vec_id").cast("bigint"), F.lit(NO_ID)).alias("id"), whole.alias("x"))


def _sums(x: DataFrame) -> tuple[int, list[int]] | None:
    """(n, sums per dimension) of the vectors of the commonest length, the longer one in a tie."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for frame in frames:
            lengths = frame["x"].map(len).to_numpy()
            for size in np.unique(lengths).tolist():
                part = _matrix(frame["x"][lengths == size])
                n, sums = held.get(size, (0, 0))
                held[size] = [n + len(part), sums + part.sum(0).astype(object)]
        if held:
            yield pd.DataFrame({
                "size": list(held), "n": [n for n, _ in held.values()], "sums": [[str(s) for s in sums] for _, sums in held.values()],
            })

    parts = cut_lineage(x.mapInPandas(partial, "size int, n bigint, sums array<string>"), "sums")
    best = parts.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if best is None:
        return None
    mine = parts.filter(F.col("size") == best["size"]).select(F.posexplode("sums").alias("at", "s"))
    sums = mine.groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()
    return best["n"], [int(r["s"]) for r in sums]


def spectrum(x: DataFrame, size: int) -> Spectrum:
    """The spectrum of the scatter of all vectors, from one spectrum per task."""

    def updated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = Spectrum.empty(size)
        for frame in frames:
            for row in _matrix(frame["x"]).astype(np.float64):
                mine.add(row)
        if mine.n:
            yield pd.DataFrame({"state": [mine.to_bytes()]})

    def merge(states: list[bytes]) -> bytes:
        out = Spectrum.empty(size)
        for s in sorted(states):
            out.merge(Spectrum.from_bytes(s, size))
        return out.to_bytes()

    return Spectrum.from_bytes(_tree(x.mapInPandas(updated, "state binary"), merge), size)


def _added(states: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(s, "<f8") for s in sorted(states)], axis=0).astype("<f8").tobytes()


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n: the whole part first, so that nothing is lost to the size of x."""
    base = sums // n
    rest = sums - base * n
    return (x - base.astype(np.int64)).astype(np.float64) - (rest.astype(np.float64) / n)


def refined(x: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(falling values, basis) of the covariance: the data are projected on the basis until it diagonalises them."""
    size = len(sums)
    for _ in range(REFINEMENTS):
        basis = np.linalg.qr(basis)[0]

        def projected(frames: Iterator[pd.DataFrame], basis: np.ndarray = basis) -> Iterator[pd.DataFrame]:
            gram = np.zeros((size, size))
            for frame in frames:
                y = _centred(_matrix(frame["x"]), n, sums) @ basis
                gram += y.T @ y
            yield pd.DataFrame({"state": [gram.astype("<f8").tobytes()]})

        gram = np.frombuffer(_tree(x.mapInPandas(projected, "state binary"), _added), "<f8").reshape(size, size) / n
        diagonal = np.sqrt(np.maximum(np.diagonal(gram), 0.0))
        limit = DIAGONAL * np.outer(diagonal, diagonal)
        values, turn = np.linalg.eigh((gram + gram.T) / 2)
        basis = basis @ turn[:, ::-1]
        if (np.abs(gram - np.diag(np.diagonal(gram))) <= limit).all():
            break
    return values[::-1], basis


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row per vector and component.

    Vectors that are null or hold null or non-finite entries are dropped; an
    entry c becomes the whole number floor(1024 c) + 100000.  Each task takes
    its vectors one by one into the spectrum of their scatter (centred
    rank-one updates through the secular equation); the tasks' spectra are
    merged by rank-one updates along each other's directions; and the basis
    found is refined by projecting all vectors on it (Rayleigh-Ritz), so the
    components are eigenvectors of the covariance to double precision.

    ``n`` counts the vectors; ``deviation`` is the exact sum of (n x - S)^2
    over the dimensions, S the sums (the largest long where it is above that);
    ``whitened`` is x - S / n along the component over the root of its
    variance; ``explained`` is that variance over the total; and
    ``identity_error`` the largest distance of the covariance of ``whitened``
    from the identity.  Components without variance have ``whitened`` null,
    ``explained`` 0 (null without any variance) and no part in the error (null
    if there is no other).  With fewer dimensions there are fewer components.
    Empty vectors and vectors not of the commonest length (the longer one in a
    tie) are dropped.  A null vec_id stays null; repeated rows count and
    return each time; an empty table gives no rows; other columns aren't read.
    """
    kinds = "id bigint, component int, deviation bigint, whitened double, explained double"
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    x = cut_lineage(scaled(embeddings), "scaled")
    known = _sums(x)
    if known is None:
        return embeddings.sparkSession.createDataFrame(
            [], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        )
    n, sums = known[0], np.array(known[1], object)
    size = len(sums)
    x = x.filter(F.size("x") == size)
    values, basis = refined(x, n, sums, spectrum(x, size).basis)
    count = min(components, size)
    trace = float(values.sum())
    real = values[:count] > size * _EPS * max(float(values[0]), 0.0)
    root = np.where(real, np.sqrt(np.where(real, values[:count], 1.0)), np.nan)
    top = basis[:, :count] / root
    share = np.where(real, values[:count], 0.0) / trace if trace > 0 else np.full(count, np.nan)

    def projected(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        moments = np.zeros((count + 1, count))
        for frame in frames:
            y = _centred(_matrix(frame["x"]), n, sums) @ top
            moments += np.vstack([y.T @ y, y.sum(0)])
        yield pd.DataFrame({"state": [moments.astype("<f8").tobytes()]})

    moments = np.frombuffer(_tree(x.mapInPandas(projected, "state binary"), _added), "<f8").reshape(count + 1, count) / n
    apart = np.abs(moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(count))
    error = float(apart[np.ix_(real, real)].max()) if real.any() else None

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            part = _matrix(frame["x"])
            most = max((abs(n * int(v) - s) for lim in (part.min(0), part.max(0)) for v, s in zip(lim, sums, strict=True)), default=0)
            if most * most * size < 1 << 63:
                deviation = ((n * part - sums.astype(np.int64)) ** 2).sum(1)
            else:
                exact = ((n * part.astype(object) - sums) ** 2).sum(1)
                deviation = np.array([min(int(v), (1 << 63) - 1) for v in exact], np.int64)
            y = _centred(part, n, sums) @ top
            yield pd.DataFrame({
                "id": np.repeat(frame["id"].to_numpy(), count), "component": np.tile(np.arange(1, count + 1), len(part)),
                "deviation": np.repeat(deviation, count), "whitened": y.ravel(), "explained": np.tile(share, len(part)),
            })

    out = x.mapInPandas(rows, kinds)
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("whitened", "explained")]
    return out.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("vec_id"), "component", F.lit(n).cast("bigint").alias("n"), "deviation", *clean,
        F.lit(error).cast("double").alias("identity_error"),
    ).select(*names)
