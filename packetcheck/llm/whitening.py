"""Whitening of embeddings: every entry as a whole number, components by pivoted Cholesky and Jacobi.

An entry c counts as the whole number floor(1024 c) + 100000. Three passes over the vectors,
each in Arrow batches: sums per dimension; the scatter of vectors centred by the whole
number next to their mean (whole products, exact up to 2^53), from which the rest of the mean is
taken out exactly; the projections. Tasks return sums, one row per pair of dimensions, which are added up by
Spark; the driver gets one scatter.

There the scatter is factored by Cholesky with diagonal pivoting, and Jacobi rotations are applied to the columns
of the triangular factor itself until they are orthogonal: their squared norms are the
eigenvalues, the columns at length 1 the components. The scatter isn't formed again,
so small eigenvalues keep their relative precision.

Defined cases: vectors that are null or hold a null or non-finite entry are dropped; equal rows all count;
a null vec_id is kept; vectors of different lengths are whitened apart, each length with a fit list
of its own; there are no more components than the vectors' rank, so equal vectors, a single one or empty ones
have no rows; entries beyond 2^52 / 1024 count as that; a deviation beyond a 64-bit number is null;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetcheck.session import stored

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
_BOUND = float(1 << 52)


@dataclass
class Fit:
    """Vectors of one length: how many, sums of their entries, and the components by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and the entries as doubles (``v``) of the vectors that count."""
    v = F.col("embedding").cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select("vec_id", v.alias("v")).where(F.coalesce(F.col("embedding").isNotNull() & fine, F.lit(False)))


def whole(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of a batch's vectors of one length, and their entries as whole numbers."""
    lists = batch.column("v")
    at = np.asarray(lists.offsets)
    values = np.asarray(lists.values)
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(values * SCALE), -_BOUND, _BOUND).astype(np.int64) + SHIFT
    sizes = np.diff(at)
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        yield rows, x[at[rows][:, None] + np.arange(size)]


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list[int]] = {}
    count: dict[int, int] = defaultdict(int)
    for batch in batches:
        for rows, x in whole(batch):
            size = x.shape[1]
            # high and low halves, so that no sum can overflow
            own = [(int(a) << 20) + int(b) for a, b in zip((x >> 20).sum(axis=0), (x & 0xFFFFF).sum(axis=0))]
            total[size] = [a + b for a, b in zip(total.get(size, [0] * size), own)]
            count[size] += len(rows)
    for size, own in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([count[size]] * size, pa.int64()),
             pa.array([Decimal(x) for x in own], pa.decimal128(38, 0))], ["dims", "place", "n", "total"])


def _scatter(batches: Iterable[pa.RecordBatch], centres: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, x in whole(batch):
            y = (x - centres[x.shape[1]]).astype(np.float64)
            total[x.shape[1]] = total.get(x.shape[1], 0.0) + y.T @ y
    for size, own in total.items():
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(i), size, dtype=np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(own[i, j])],
            ["dims", "i", "j", "product"])


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """Factor l, with its rows where a has them, of a = l l'; a column per rank of a."""
    a, d = a.copy(), len(a)
    least = d * np.finfo(float).eps * max(a.diagonal().max(initial=0.0), 0.0)
    columns, free = [], np.ones(d, dtype=bool)
    while free.any():
        p = int(np.flatnonzero(free)[a.diagonal()[free].argmax()])
        if a[p, p] <= least:
            break
        column = np.where(free, a[:, p], 0.0) / np.sqrt(a[p, p])
        a -= np.outer(column, column)
        free[p] = False
        columns.append(column)
    return np.stack(columns, axis=1) if columns else np.zeros((d, 0))


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Components (as columns) and eigenvalues of factor factor', by falling eigenvalue.

    In each round of a sweep the columns meet in pairs, as in a tournament; every two meet
    once a sweep.
    """
    u = factor.copy()
    r = u.shape[1]
    players = np.arange(r + r % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(players) - 1):
            half = len(players) // 2
            p, q = players[:half], players[half:][::-1]
            fine = (p < r) & (q < r)
            p, q = p[fine], q[fine]
            a, b = u[:, p], u[:, q]
            alpha, beta, gamma = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            wide = np.abs(gamma) > 1e-15 * np.sqrt(alpha * beta)
            if wide.any():
                turned = True
                p, q, a, b = p[wide], q[wide], a[:, wide], b[:, wide]
                with np.errstate(over="ignore"):
                    zeta = (beta - alpha)[wide] / (2 * gamma[wide])
                    t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.hypot(1, t)
                u[:, p], u[:, q] = c * a - c * t * b, c * t * a + c * b
            players = np.r_[players[:1], players[-1:], players[1:-1]]
        if not turned:
            break
    norm = np.sqrt((u * u).sum(axis=0))
    order = np.argsort(-norm, kind="stable")
    u, norm = u[:, order] / norm[order], norm[order]
    # a component's sign is free: its largest entry is positive
    if r:
        u *= np.where(u[np.abs(u).argmax(axis=0), np.arange(r)] < 0, -1.0, 1.0)
    return u, norm * norm


def fit(rows: DataFrame) -> dict[int, Fit]:
    """For each length of vectors its fit, from all of ``rows`` (see ``usable``)."""
    sums = rows.select("v").mapInArrow(_sums, "dims int, place int, n long, total decimal(38,0)")
    found = sums.groupBy("dims", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dims", "place").collect()
    count, total = {}, defaultdict(list)
    for r in found:
        count[r["dims"]] = r["n"]
        total[r["dims"]].append(int(r["total"]))
    centres = {d: np.array([round(Fraction(s, count[d])) for s in own], dtype=np.int64) for d, own in total.items()}
    scatter = rows.select("v").mapInArrow(lambda batches: _scatter(batches, centres), "dims int, i int, j int, product double")
    products = {d: np.zeros((d, d)) for d in centres}
    for r in scatter.groupBy("dims", "i", "j").agg(F.sum("product").alias("product")).collect():
        products[r["dims"]][r["i"], r["j"]] = products[r["dims"]][r["j"], r["i"]] = r["product"]
    fits = {}
    for d, a in products.items():
        n = count[d]
        rest = [s - n * int(m) for s, m in zip(total[d], centres[d])]
        a -= np.array([[float(Fraction(x * y, n)) for y in rest] for x in rest])
        components, eigenvalues = one_sided_jacobi(pivoted_cholesky(a / n))
        fits[d] = Fit(n, total[d], components, eigenvalues, float(np.trace(a / n)))
    return fits


def _deviations(x: np.ndarray, own: Fit) -> tuple[np.ndarray, list[int | None]]:
    """n x - S (rounded only once, as doubles) and the exact sums of its squares."""
    largest = max(int(np.abs(x).max()) * own.n + max(map(abs, own.sums)), 1)
    if largest * largest * x.shape[1] < 1 << 63:
        apart = x * own.n - np.array(own.sums, dtype=np.int64)
        return apart.astype(np.float64), (apart * apart).sum(axis=1).tolist()
    centre = np.array([round(Fraction(s, own.n)) for s in own.sums], dtype=np.int64)
    rest = np.array([s - own.n * int(m) for s, m in zip(own.sums, centre)], dtype=np.int64)
    y = x - centre
    largest = int(np.abs(y).max()) * own.n + own.n
    if largest * largest * x.shape[1] < 1 << 63:
        apart = y * own.n - rest
        return apart.astype(np.float64), (apart * apart).sum(axis=1).tolist()
    exact = y.astype(object) * own.n - rest.astype(object)
    squares = (exact * exact).sum(axis=1).tolist()
    return exact.astype(np.float64), [s if s < 1 << 63 else None for s in squares]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = usable(vectors)
    fits = fit(rows)
    most = {d: min(components, len(own.eigenvalues)) for d, own in fits.items()}

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in whole(batch):
                own = fits[x.shape[1]]
                k = most[x.shape[1]]
                apart, squares = _deviations(x, own)
                white = (apart / own.n) @ own.components[:, :k] / np.sqrt(own.eigenvalues[:k])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(at)), pa.array(np.full(len(at), x.shape[1], dtype=np.int32)), pa.array(squares, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * k), pa.array(white.reshape(-1), pa.float64()))],
                    ["vec_id", "dims", "deviation", "w"])

    white = stored(rows.mapInArrow(project, f"vec_id {kind}, dims int, deviation long, w array<double>"), "whitened")
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    moments = white.groupBy("dims").agg(*(F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs))
    errors = {r["dims"]: max((abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if j < most[r["dims"]]), default=0.0) for r in moments.collect()}
    each = [F.struct(F.lit(d), F.lit(own.n).cast("long"), F.array(*(F.lit(float(e / own.trace)) for e in own.eigenvalues[:most[d]])).cast("array<double>"), F.lit(errors[d]))
            for d, own in fits.items()]
    kinds = "array<struct<dims:int,n:bigint,explained:array<double>,error:double>>"
    known = F.filter((F.array(*each) if each else F.array()).cast(kinds), lambda x: x["dims"] == F.col("dims"))[0]
    split = white.select("vec_id", "deviation", known.alias("fit"), F.posexplode("w").alias("at", "whitened"))
    return split.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.col("fit.n").alias("n"), "deviation", "whitened",
        F.get("fit.explained", F.col("at")).alias("explained"), F.col("fit.error").alias("identity_error"))
