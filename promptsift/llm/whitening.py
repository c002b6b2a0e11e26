"""Whitening of embeddings from exact integer scatter.

Entries become integers, a shift is subtracted, and each task adds up sums and cross-products
as integers of any size: products of 20-bit limbs in blocks that a double holds exactly, and
from there 30-bit limbs, which Spark adds up as longs. The driver gets the totals, which grow
with the square of the dimension and not with the rows, forms n XᵀX - S Sᵀ in Python's
integers, and only then converts to floating point for the eigenvectors.

Edge cases: a row takes no part if its vector is null, empty or holds a null, infinite or NaN
entry, or if its length is not the most common one (the longest of those equally common).
Entries beyond the range of a long are held at its ends. Repeated rows count as often as they
occur; a null id is kept. A table without rows, or without a row that takes part, gives none. A component
without variance (its eigenvalue not above 1e-13 of all) has no direction: it is left out.
The deviation is a decimal of 38 digits, null beyond. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: An eigenvalue of at most this share of the trace is rounding.
NONE = 1e-13
#: Bits of a limb in products, which a double adds up exactly over 2^13 rows, and of a limb of a sum.
_LIMB, _ROWS, _SUM = 20, 1 << 13, 30
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def sound(vector: Column) -> Column:
    """Whether a vector holds numbers only."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))


def integers(entries: np.ndarray) -> np.ndarray:
    """floor(SCALE * entry) + OFFSET as longs."""
    with np.errstate(over="ignore"):
        x = np.floor(SCALE * entries) + OFFSET
    high, low = x >= 2.0**63, x < -(2.0**63)
    out = np.where(high | low, 0, x).astype(np.int64)
    out[high], out[low] = _MOST, _LEAST
    return out


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def scatter(y: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Column sums and cross-products of integers, exact. y: int64."""
    limbs, rest = [], y
    while True:
        if rest.size == 0 or (-(1 << _LIMB) < rest.min() and rest.max() < 1 << _LIMB):
            limbs.append(rest.astype(np.float64))
            break
        limbs.append((rest & (1 << _LIMB) - 1).astype(np.float64))
        rest = rest >> _LIMB
    d = y.shape[1]
    sums, products = np.zeros(d, object), np.zeros((d, d), object)
    for at in range(0, len(y), _ROWS):
        parts = [limb[at : at + _ROWS] for limb in limbs]
        for i, a in enumerate(parts):
            sums += a.sum(0).astype(np.int64).astype(object) << (_LIMB * i)
            for j, b in enumerate(parts):
                products += (a.T @ b).astype(np.int64).astype(object) << (_LIMB * (i + j))
    return sums.tolist(), products.tolist()


def _limbs(value: int) -> list[int]:
    """A number as limbs of _SUM bits, the last with the sign; sums of limbs are limbs of the sum."""
    out = []
    while not -(1 << _SUM) < value < 1 << _SUM:
        out.append(value & (1 << _SUM) - 1)
        value >>= _SUM
    return [*out, value]


def _totals(shift: list[int]):
    """Sums (j = -1), cross-products and the count (i = -1) of a task, by limb."""
    d = len(shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            x = integers(_matrix(batch["vector"]))
            if not len(x):
                continue
            # held entries may leave the range of a long when shifted
            y = x - np.array(shift) if abs(x.astype(np.float64)).max() < 2.0**62 else None
            if y is None:
                z = x.astype(object) - np.array(shift, object)
                s, p = z.sum(0), z.T.dot(z)
            else:
                s, p = (np.array(v, object) for v in scatter(y))
            n, sums, products = n + len(x), sums + s, products + p
        if n:
            cells = [(-1, -1, n), *((i, -1, int(v)) for i, v in enumerate(sums)), *((i, j, int(products[i, j])) for i in range(d) for j in range(i + 1))]
            rows = [(i, j, k, limb) for i, j, v in cells for k, limb in enumerate(_limbs(v))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "k", "value"])

    return run


@dataclass(frozen=True)
class Whitener:
    """What was fitted: vectors of length d over n rows, their sums, and the components by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float


def eligible(rows: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """Rows that take part, and the length of their vectors (0: there are none)."""
    good = rows.filter(sound(F.col(vector)))
    common = good.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common.d if common else 0
    return good.filter(F.size(vector) == d), d


def fitted(rows: DataFrame, d: int, vector: str = "embedding") -> Whitener | None:
    """The components of rows' covariance (divisor n); None without rows."""
    shift = [OFFSET] * d
    totals = rows.select(F.col(vector).alias("vector")).mapInArrow(_totals(shift), "i int, j int, k int, value long").groupBy("i", "j", "k").agg(F.sum("value").alias("value"))
    cells: dict[tuple[int, int], int] = {}
    for r in totals.collect():
        cells[r.i, r.j] = cells.get((r.i, r.j), 0) + (r.value << (_SUM * r.k))
    n = cells.get((-1, -1), 0)
    if not n:
        return None
    s = [cells[i, -1] for i in range(d)]
    scatter_of = [[n * cells[max(i, j), min(i, j)] - s[i] * s[j] for j in range(d)] for i in range(d)]
    covariance = np.array([[v / (n * n) for v in row] for row in scatter_of], np.float64)
    trace = sum(scatter_of[i][i] for i in range(d)) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    kept = [k for k in range(d - 1, -1, -1) if values[k] > NONE * trace][:COMPONENTS]
    components = vectors[:, kept].T
    for c in components:
        c *= 1 if c[np.argmax(np.abs(c))] > 0 else -1
    return Whitener(n, [v + n * OFFSET for v in s], components, values[kept], trace)


def projected(rows: DataFrame, white: Whitener, vector: str = "embedding") -> DataFrame:
    """rows with deviation (the sum over dimensions of (n x - S)², as a decimal) and whitened (an array by component)."""
    n, sums, scaled = white.n, white.sums, white.components / np.sqrt(white.values)[:, None]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            x = integers(_matrix(vectors))
            # n x - S fits where n (x - S / n) does
            away = max((abs(n * int(v) - s) for v, s in zip([*x.max(0), *x.min(0)], [*sums, *sums])), default=0) if len(x) else 0
            bound = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums)) if len(x) else 0
            if len(sums) * away**2 < 1 << 63 and bound < 1 << 63:
                moved = n * x - np.array(sums, np.int64)
                deviation = [int(v) for v in (moved * moved).sum(1)]
            else:
                moved = n * x.astype(object) - np.array(sums, object)
                deviation = [v if v < 10**38 else None for v in (moved * moved).sum(1)]
            centred = (moved / n).astype(np.float64)
            out = centred @ scaled.T
            yield pa.StructArray.from_arrays([pa.array(deviation, pa.decimal128(38, 0)), pa.array(list(out), pa.list_(pa.float64()))], names=["deviation", "whitened"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    found = arrow_udf(run, "struct<deviation:decimal(38,0),whitened:array<double>>")
    return rows.withColumn("_white", found(F.col(vector))).select(*rows.columns, "_white.deviation", "_white.whitened")


def identity_error(whitened: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance of whitened's k components (divisor n, centred) minus the identity."""
    means = whitened.agg(*(F.avg(F.col("whitened")[i]).alias(f"m{i}") for i in range(k))).first()
    centred = [F.col("whitened")[i] - F.lit(means[i]) for i in range(k)]
    cells = [(i, j) for i in range(k) for j in range(i + 1)]
    found = whitened.agg(*(F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in cells)).first()
    return max((abs(v - (i == j)) for (i, j), v in zip(cells, found)), default=0.0)


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each row that takes part and each component: key, component, n, deviation, whitened, explained, identity_error."""
    rows, d = eligible(rows.select(key, vector), vector)
    white = fitted(rows, d, vector) if d else None
    if white is None or not len(white.values):
        fields = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return rows.select(key).limit(0).join(rows.sparkSession.createDataFrame([], fields))
    found = projected(rows, white, vector).select(key, "deviation", "whitened")
    error = identity_error(found, len(white.values))
    explained = F.array(*(F.lit(float(v) / white.trace) for v in white.values))
    each = found.select(key, "deviation", F.posexplode("whitened").alias("k", "value"))
    return each.select(key, (F.col("k") + 1).alias("component"), F.lit(white.n).cast("long").alias("n"), "deviation", F.col("value").alias("whitened"), explained[F.col("k")].alias("explained"), F.lit(error).alias("identity_error"))
