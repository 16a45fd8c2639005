"""Vector distances, as Column expressions, SQL functions and numpy kernels.

The Column forms add up in double from left to right; the kernels work on
whole blocks and serve the search operators.  ``l2`` is squared, ``ip`` and
``cosine`` are one minus the product, so that smaller is nearer everywhere.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SPACES = ("l2", "ip", "cosine", "l2_u8")


@dataclass(frozen=True)
class Distance:
    """A distance of one's own in both forms: of two columns, and of a query and the rows of a matrix.

    The second lets a search run on blocks as with the built-in distances; a
    plain function of two columns works too, pair by pair.  ``below``, if there
    is one, makes of the rows of a matrix a function that gives for several
    queries numbers that no distance to these rows is below, rounding
    included: where those are far the kernel is not asked.
    """

    column: Callable[[Column, Column], Column]
    kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]
    below: Callable[[np.ndarray], Callable[[np.ndarray], np.ndarray]] | None = None

    def __call__(self, a: Column, b: Column) -> Column:
        return self.column(a, b)


def check_space(space: str | Distance) -> str | Distance:
    if isinstance(space, Distance):
        return space
    if space not in SPACES:
        raise ValueError(f"space name must be one of {', '.join(SPACES)}")
    return space


def _total(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def _double(x: Column) -> Column:
    return x.cast("double")


def finite(vector: Column | str) -> Column:
    """Whether no component is infinite or not a number; nulls are not asked about."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.coalesce(~F.exists(v, lambda x: F.isnan(_double(x)) | (F.abs(_double(x)) == float("inf"))), F.lit(True))


def same_length(a: Column, b: Column) -> Column:
    """True, or an error that says the dimensions differ."""
    return F.when(F.size(a) == F.size(b), True).otherwise(F.raise_error(F.lit("Wrong dimensionality of the vectors")))


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: _double(x) * _double(y)))


def _l2(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (_double(x) - _double(y)) * (_double(x) - _double(y))))


def _l1(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: F.abs(_double(x) - _double(y))))


#: Components that a kernel takes at a time, so that they stay in a core's cache.
CACHED = 32_768


def _l1_rows(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out, step = np.empty(len(rows)), max(1, CACHED // max(1, len(query)))
    for i in range(0, len(rows), step):
        d = rows[i : i + step] - query
        np.einsum("ij->i", np.abs(d, out=d), out=out[i : i + step])  # row by row, so that equal rows are equally far
    return out


def _l2_rows(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out, step = np.empty(len(rows)), max(1, CACHED // max(1, len(query)))
    for i in range(0, len(rows), step):
        d = rows[i : i + step] - query
        np.einsum("ij,ij->i", d, d, out=out[i : i + step])
    return out


#: Cells of a component's values for the bound of sums of absolute differences.
CELLS = 8


def _rounding(terms: int) -> float:
    """What a product of so many terms in single precision may be off by, as a share of the sizes of its sides."""
    return max(1e-5, 2e-7 * terms)


def _l1_below(rows: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Sums of absolute differences from below, by one matrix product.

    In place of ``|a - b|`` stands a function of ``b`` that is straight
    between knots and equal to it there, but less by twice as much at the knot
    nearest to ``a``; so it is nowhere above.  A row states of each cell
    between two knots what share it fills.  Values beyond the outer knots are
    taken to these, which brings none farther apart.
    """
    knots = np.quantile(rows, np.linspace(0, 1, CELLS + 1), axis=0)
    spread = 2 * (knots[-2] - knots[1])
    knots[0], knots[-1] = np.maximum(knots[0], knots[1] - spread), np.minimum(knots[-1], knots[-2] + spread)
    width = np.diff(knots, axis=0)
    width[width <= 0] = 1
    theirs = np.concatenate([np.clip((rows - low) / w, 0, 1).astype(np.float32) for low, w in zip(knots[:-1], width, strict=True)], axis=1).T
    unsure = _rounding(len(theirs))

    def below(queries: np.ndarray) -> np.ndarray:
        at = np.abs(np.clip(queries, knots[0], knots[-1])[:, None] - knots)
        at = np.where(at == at.min(axis=1, keepdims=True), -at, at)
        rise = np.diff(at, axis=1).reshape(len(queries), -1)
        out = rise.astype(np.float32) @ theirs
        out += (at[:, 0].sum(axis=1) - unsure * (np.abs(rise).sum(axis=1) + np.abs(at[:, 0]).sum(axis=1)) - 1e-9).astype(np.float32)[:, None]
        return out

    return below


def _l2_below(rows: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Squared distances from below, by one matrix product in single precision."""
    exact = 1 - _rounding(rows.shape[1])
    theirs, size = rows.astype(np.float32), (exact * (rows * rows).sum(axis=1) - 1e-9).astype(np.float32)

    def below(queries: np.ndarray) -> np.ndarray:
        out = (-2 * queries).astype(np.float32) @ theirs.T
        out += (exact * (queries * queries).sum(axis=1)).astype(np.float32)[:, None]
        out += size
        return out

    return below


#: Sum of absolute differences, as an example of a distance of one's own.
l1 = Distance(_l1, _l1_rows, _l1_below)

#: Squared distance pair by pair, of all pairs that are not certainly too far: what the space of that name is held against.
l2 = Distance(_l2, _l2_rows, _l2_below)


def l2_u8(a: Column, b: Column) -> Column:
    """Squared distance of vectors of whole numbers in 0..255, as an integer."""
    terms = F.zip_with(a, b, lambda x, y: (x.cast("int") - y.cast("int")) * (x.cast("int") - y.cast("int")))
    return F.aggregate(terms, F.lit(0), lambda s, x: s + x)


def ip(a: Column, b: Column) -> Column:
    return 1 - dot(a, b)


def cosine(a: Column, b: Column) -> Column:
    """One minus the cosine; 1 if either vector is zero."""
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms == 0, 1.0).otherwise(1 - dot(a, b) / norms)


def euclid(a: Column, b: Column) -> Column:
    """Root of the squared distance; an error if the dimensions differ."""
    return F.when(same_length(a, b), F.sqrt(l2(a, b)))


def normalize(v: Column) -> Column:
    """``v`` at unit length; a zero vector stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm == 0, 0.0).otherwise(_double(x) / norm))


def to_u8(v: Column) -> Column:
    """Components of -1..1 as whole numbers of 0..255."""
    return F.transform(v, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((_double(x) + 1) * 127.5))).cast("short"))


COLUMNS: dict[str, Callable[[Column, Column], Column]] = {"l2": l2, "ip": ip, "cosine": cosine, "l2_u8": l2_u8}


def register_sql(spark: SparkSession) -> None:
    """Make ``vec_l2sq``, ``vec_ip``, ``vec_cosine`` and ``vec_dot`` SQL functions of the session."""
    arrays = "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN"
    product = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    norm = "sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x))"
    bodies = {
        "vec_dot": product,
        "vec_ip": f"1 - {product}",
        "vec_l2sq": "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)",
        "vec_cosine": f"CASE WHEN {norm} = 0 THEN 1D ELSE 1 - {product} / {norm} END",
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{arrays} {body}")


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(norms == 0, 1, norms)


def block(space: str | Distance, queries: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Distances of all queries to all rows of ``base`` by one matrix product; good enough to shortlist."""
    if isinstance(space, Distance):
        return np.stack([space.kernel(q, base) for q in queries])
    out = queries @ base.T if space != "cosine" else unit(queries) @ unit(base).T
    if space in ("l2", "l2_u8"):
        out *= -2
        out += (queries * queries).sum(1)[:, None]
        out += (base * base).sum(1)
        return out
    return np.subtract(1, out, out=out)


def exact(space: str | Distance, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distances of one query to some rows, without the cancellation of :func:`block`."""
    if isinstance(space, Distance):
        return space.kernel(query, rows)
    if space in ("l2", "l2_u8"):
        return ((rows - query) ** 2).sum(axis=1)
    products = rows @ query
    if space == "ip":
        return 1 - products
    norms = np.sqrt((rows * rows).sum(axis=1) * (query @ query))
    return np.where(norms == 0, 1.0, 1 - products / np.where(norms == 0, 1, norms))


def pairs(space: str | Distance, queries: np.ndarray, base: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 65_536) -> np.ndarray:
    """What :func:`exact` says of the queries ``i`` and the rows ``j`` of ``base``, pair by pair; ``i`` ascends."""
    out = np.empty(len(i))
    if isinstance(space, Distance):
        cuts = np.flatnonzero(np.diff(i, prepend=-1, append=-1)) if len(i) else np.zeros(1, int)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            out[a:b] = space.kernel(queries[i[a]], base[j[a:b]])
        return out
    for a in range(0, len(i), step):
        q, x = queries[i[a : a + step]], base[j[a : a + step]]
        if space in ("l2", "l2_u8"):
            out[a : a + step] = ((x - q) ** 2).sum(axis=1)
            continue
        products = np.einsum("ij,ij->i", x, q)
        if space == "cosine":
            norms = np.sqrt((x * x).sum(axis=1) * (q * q).sum(axis=1))
            out[a : a + step] = np.where(norms == 0, 1.0, 1 - products / np.where(norms == 0, 1, norms))
        else:
            out[a : a + step] = 1 - products
    return out
