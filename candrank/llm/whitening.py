"""Whitening by spectrum slicing.

Each vector becomes whole numbers x. The distinct x are the fit list: their number and sums are
exact, and their products are summed after the whole number next to the mean is taken off, so that
the sums are those of small whole numbers. Only the matrix of a vector's length squared comes
to the driver. There LDLT factors of the covariance less a shift give by their signs how many
eigenvalues lie above the shift; halving isolates each leading eigenvalue in an interval of
its own, Rayleigh quotient iteration converges to it, and two more counts certify its
number. The rows then meet the components where they are.

Defined results: of vectors of different lengths those of the most frequent length (of equally
frequent ones the longest) are fitted and projected; the others have their rows with a null
deviation and null whitened; 64*c beyond 2^62 counts as 2^62; a deviation beyond the range of long
is null; components without variance have no rows, so neither has a table whose vectors are
all equal; of equal eigenvalues any orthonormal vectors are taken; repeated rows and null ids keep
their rows; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candrank.llm.common import written

COMPONENTS = 16
FACTOR, OFFSET = 64, 1_000_000
_MOST = float(2**62)
#: Eigenvalues below this share of the trace are rounding errors.
NO_VARIANCE = 1e-13
_ROWS = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, "
    "identity_error double"
)


def whole(column: str) -> Column:
    """The long x of each entry."""

    def one(c: Column) -> Column:
        scaled = F.greatest(F.least(c.cast("double") * FACTOR, F.lit(_MOST)), F.lit(-_MOST))
        return F.floor(scaled) + F.lit(OFFSET)

    return F.transform(column, one)


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose vector has finite entries only."""

    def finite(c: Column) -> Column:
        return F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False))

    kept = table.filter(F.col("embedding").isNotNull() & F.forall("embedding", finite))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), whole("embedding").alias("x"))


# -- spectrum ---------------------------------------------------------------------------
def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are above ``shift``.

    The signs of the blocks of a pivoted LDLT factorisation of ``matrix - shift*I``: a block
    of two rows is only taken where its determinant is negative, so it has one of each sign.
    """
    a = matrix - shift * np.eye(len(matrix))
    positive = 0
    while len(a):
        size = np.abs(a)
        i = int(np.argmax(np.diagonal(size)))
        r, s = divmod(int(np.argmax(size)), len(a))
        if size[i, i] >= 0.64 * size[r, s]:
            if size[i, i] == 0:
                break
            rest = np.delete(np.arange(len(a)), i)
            column = a[rest, i]
            positive += bool(a[i, i] > 0)
            a = a[np.ix_(rest, rest)] - np.outer(column, column / a[i, i])
        else:
            rest = np.delete(np.arange(len(a)), [r, s])
            block, columns = a[np.ix_([r, s], [r, s])], a[np.ix_(rest, [r, s])]
            positive += 1
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(block, columns.T)
        a = (a + a.T) / 2
    return positive


def _apart(v: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    """The unit vector of ``v`` at right angles to those known."""
    for _ in range(2):
        for u in known:
            v = v - (u @ v) * u
    return v / np.linalg.norm(v)


def _solved(matrix: np.ndarray, shift: float, v: np.ndarray) -> np.ndarray:
    eye = np.eye(len(matrix))
    while True:
        try:
            found = np.linalg.solve(matrix - shift * eye, v)
            if np.isfinite(found).all():
                return found
        except np.linalg.LinAlgError:
            pass
        shift += 1e-15 * max(abs(shift), np.abs(matrix).max())


class Spectrum:
    """The leading eigenvalues of a covariance matrix with unit eigenvectors."""

    def __init__(self, matrix: np.ndarray):
        self._matrix = matrix
        self._scale = float(np.trace(matrix))
        # Shifts whose count is known: none is above the trace, all are above what is below zero.
        self._counts: dict[float, int] = {1.01 * self._scale: 0, -0.01 * self._scale: len(matrix)}
        self._rng = np.random.default_rng(3)
        self.values: list[float] = []
        self.vectors: list[np.ndarray] = []

    def count(self, shift: float) -> int:
        if shift not in self._counts:
            self._counts[shift] = above(self._matrix, shift)
        return self._counts[shift]

    def _interval(self, number: int) -> tuple[float, float]:
        """The narrowest known interval that holds the eigenvalue of this number."""
        low = max(s for s, c in self._counts.items() if c >= number)
        high = min(s for s, c in self._counts.items() if c < number)
        return low, high

    def _isolated(self, number: int, halvings: int = 0) -> tuple[float, float]:
        """An interval of this eigenvalue alone, or one too narrow to halve."""
        low, high = self._interval(number)
        while high - low > 4e-15 * self._scale and (halvings > 0 or self.count(low) - self.count(high) > 1):
            self.count((low + high) / 2)
            low, high = self._interval(number)
            halvings -= 1
        return low, high

    def _iterated(self, low: float, high: float) -> tuple[float, np.ndarray]:
        """Rayleigh quotient iteration from the middle of an interval."""
        v = _apart(self._rng.standard_normal(len(self._matrix)), self.vectors)
        shift, best = (low + high) / 2, (np.inf, 0.0, v)
        for step in range(60):
            v = _apart(_solved(self._matrix, shift, v), self.vectors)
            image = self._matrix @ v
            quotient = float(v @ image)
            left = float(np.linalg.norm(image - quotient * v))
            if left < best[0]:
                best = (left, quotient, v)
            elif step > 3 and left <= 1e-11 * self._scale:
                break
            # The middle leads until the quotient has come into the interval.
            shift = quotient if low <= quotient <= high else (low + high) / 2
        return best[1], best[2]

    def lead(self, number: int) -> bool:
        """Add the next eigenvalue; False where it is none but a rounding error."""
        slack = 1e-12 * self._scale
        for halvings in (0, 8, 16, 32, 64):
            low, high = self._isolated(number, halvings)
            if high <= NO_VARIANCE * self._scale:
                return False
            value, vector = self._iterated(low, high)
            # Two counts certify that exactly number - 1 are above it.
            if self.count(value + slack) < number <= self.count(value - slack):
                if value <= NO_VARIANCE * self._scale:
                    return False
                self.values.append(value)
                self.vectors.append(vector)
                return True
        raise ArithmeticError(f"eigenvalue {number} could not be certified")


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` leading eigenvalues, falling, and the unit vectors as columns."""
    found = Spectrum(matrix)
    if found._scale > 0:
        while len(found.values) < min(most, len(matrix)) and found.lead(len(found.values) + 1):
            pass
    order = np.argsort(-np.array(found.values), kind="stable")
    columns = np.array(found.vectors).reshape(len(order), len(matrix))[order].T
    return np.array(found.values)[order], columns


# -- over the rows ------------------------------------------------------------------------
def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number and exact sums per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * size
        for batch in batches:
            x = _matrix(batch.column(0), size)
            if not len(x):
                continue
            n += len(x)
            # Parts of 32 bits, so that no sum leaves 64.
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            total = [t + (int(h) << 32) + int(v) for t, h, v in zip(total, high, low, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(map(str, total))],
            names=["i", "n", "s"],
        )

    parts = fit.mapInArrow(run, "i int, n long, s string")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = {r.i: int(r.s) for r in rows}
    return (rows[0].n if rows else 0), [sums[i] for i in range(size)] if rows else []


def _products(fit: DataFrame, size: int, into: int, project) -> tuple[np.ndarray, np.ndarray]:
    """Sums of y and of y*y' over the fit list, y = project(x) of length ``into``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((into, into + 1))
        for batch in batches:
            y = project(_matrix(batch.column(0), size))
            both[:, :into] += y.T @ y
            both[:, into] += y.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(into), pa.int32()), pa.array(list(both), pa.list_(pa.float64()))], names=["i", "row"]
        )

    parts = fit.mapInArrow(run, "i int, row array<double>")
    # Added up before the shuffle, and by Spark, one column each.
    sums = [F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(into + 1)]
    rows = sorted(parts.groupBy("i").agg(*sums).collect(), key=lambda r: r.i)
    both = np.array([list(r)[1:] for r in rows], float).reshape(-1, into + 1)
    return both[:, :into], both[:, into]


def whiten(table: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: see the module's text."""
    rows = vectors(table)
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("k"))
    usual = lengths.orderBy(F.col("k").desc(), F.col("d").desc()).limit(1).collect()
    none = table.sparkSession.createDataFrame([], _ROWS)
    if not usual or not usual[0].d:
        return none
    size = usual[0].d
    fit = written(rows.filter(F.size("x") == size).select("x").distinct(), "fit-list")
    n, sums = _sums(fit, size)
    near = np.array([round(Fraction(s, n)) for s in sums], np.int64)
    products, rest = _products(fit, size, size, lambda x: (x - near).astype(np.float64))
    mean = rest / n
    covariance = products / n - np.outer(mean, mean)
    values, columns = leading((covariance + covariance.T) / 2, most)
    if not len(values):
        return none
    columns = columns / np.sqrt(values)
    exact = np.array([float(Fraction(s, n) - int(m)) for s, m in zip(sums, near, strict=True)])

    def project(x: np.ndarray) -> np.ndarray:
        # Both differences are exact or rounded once.
        return ((x - near).astype(np.float64) - exact) @ columns

    k = len(values)
    squares, whitened = _products(fit, size, k, project)
    off = np.abs(squares / n - np.outer(whitened / n, whitened / n) - np.eye(k)).max()
    explained = values / float(np.trace(covariance))
    far = max(abs(s) for s in sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0), batch.column(1)
            usable = np.array([len(v) == size for v in x], bool)
            fitted = _matrix(x.filter(pa.array(usable)), size)
            out = np.full((len(x), k), np.nan)
            out[usable] = project(fitted)
            apart: list[int | None] = [None] * len(x)
            if len(fitted):
                bound = n * int(np.abs(fitted).max()) + far
                if bound * bound * size < 2**63:
                    exactly = ((n * fitted - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
                else:
                    exactly = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in fitted.tolist()]
                for at, value in zip(np.flatnonzero(usable), exactly, strict=True):
                    apart[at] = value if value < 2**63 else None
            each = np.repeat(np.arange(len(x)), k)
            flat = out.reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), n, np.int64)),
                    pa.array(apart, pa.int64()).take(pa.array(each)),
                    pa.array(flat, mask=np.isnan(flat)),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(each), off)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, _ROWS)
