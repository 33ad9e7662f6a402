"""Curves held one per row as arrays: integrals, normalisation, moments, interpolation, regions, premium curves.

All are expressions on array columns and stay in the JVM; the work of one row grows with its grid, never with the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(f: Callable[..., Column], **values: Column) -> Column:
    """f of ``values``, each of which is evaluated once per row: bound to the variable of a one-element transform."""
    bound = F.array(F.struct(*[v.alias(n) for n, v in values.items()]))
    return F.transform(bound, lambda s: f(*[s[n] for n in values]))[0]


def linspace(a: float, b: float, n: int) -> Column:
    """Array of n equally spaced numbers from a to b; a literal."""
    return F.lit([a + (b - a) * i / (n - 1) for i in range(n)])


def _cells(x: Column) -> Column:
    return F.sequence(F.lit(0), F.size(x) - 2)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def areas(y: Column, x: Column) -> Column:
    """Trapezoid areas of the cells between neighbouring grid points."""
    return let(lambda y, x: F.transform(_cells(x), lambda i: (x[i + 1] - x[i]) * (y[i] + y[i + 1]) / 2), y=y, x=x)


def trapezoid(y: Column, x: Column) -> Column:
    """Integral of y over the grid x."""
    return _sum(areas(y, x))


def cumulative_at(y: Column, x: Column, edge: float) -> Column:
    """Integral of y up to ``edge``, which cuts its cell's area in proportion to the distance."""

    def parts(y: Column, x: Column) -> Column:
        share = lambda i: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(edge) - x[i]) / (x[i + 1] - x[i])))
        return F.transform(_cells(x), lambda i: (x[i + 1] - x[i]) * (y[i] + y[i + 1]) / 2 * share(i))

    return _sum(let(parts, y=y, x=x))


def normalised(y: Column, x: Column) -> Column:
    """y scaled to unit mass; as it is where the mass isn't above zero."""
    return let(lambda y, mass: F.when(mass > 0, F.transform(y, lambda v: v / mass)).otherwise(y), y=y, mass=trapezoid(y, x))


def moment(y: Column, x: Column, f: Callable[[Column], Column]) -> Column:
    """Integral of f(x) y."""
    return trapezoid(F.zip_with(y, x, lambda v, r: v * f(r)), x)


def mean_variance(y: Column, x: Column) -> tuple[Column, Column]:
    mean = moment(y, x, lambda r: r)
    return mean, let(lambda m, s, t: s - m * m * t, m=mean, s=moment(y, x, lambda r: r * r), t=trapezoid(y, x))


def interpolated(y: Column, x: Column, grid: Column, left: float = 0.0, right: float = 0.0) -> Column:
    """y on another grid, linear between the points of x (ascending), ``left`` and ``right`` outside."""

    def onto(y: Column, x: Column) -> Column:
        n = F.size(x)

        def at(g: Column) -> Column:
            j = F.greatest(F.least(F.size(F.filter(x, lambda v: v < g)) - 1, n - 2), F.lit(0))
            value = let(lambda j: y[j] * (1 - (g - x[j]) / (x[j + 1] - x[j])) + y[j + 1] * ((g - x[j]) / (x[j + 1] - x[j])), j=j)
            return F.when(g < x[0], F.lit(left)).when(g > x[n - 1], F.lit(right)).otherwise(value)

        return F.transform(grid, at)

    return let(onto, y=y, x=x)


def quantile_index(y: Column, x: Column, p: float) -> Column:
    """Index of the first grid point at which the cumulative reaches share p, within the inner points."""

    def walk(cells: Column) -> Column:
        def index(total: Column) -> Column:
            state = F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("k"))
            step = lambda s, a: F.struct((s["c"] + a).alias("c"), (s["k"] + F.when(s["c"] + a < F.lit(p) * total, 1).otherwise(0)).alias("k"))
            return F.greatest(F.lit(1), F.least(F.aggregate(cells, state, step)["k"] + 1, F.size(cells) - 1))

        return let(index, total=_sum(cells))

    return let(walk, cells=areas(y, x))


def log_ratio(a: Column, b: Column, floor: float = 1e-20) -> Column:
    """ln(a / b) point by point, both floored."""
    return F.zip_with(a, b, lambda u, v: F.log(F.greatest(u, F.lit(floor)) / F.greatest(v, F.lit(floor))))


def regions_by_edge(y: Column, x: Column, low: float = 0.90, high: float = 1.10) -> tuple[Column, Column, Column]:
    """Integrals below, between and above the edges; edges cut cells in proportion, so the three add up."""
    first, second = cumulative_at(y, x, low), cumulative_at(y, x, high)
    return first, second - first, trapezoid(y, x) - second


def regions_by_mask(y: Column, x: Column, low: float = 0.90, high: float = 1.10) -> tuple[Column, Column, Column]:
    """Integrals over the grid points of each region alone: cells across an edge belong to none. Null under two points."""

    def inside(keep: Callable[[Column], Column]) -> Column:
        def over(y: Column, x: Column) -> Column:
            cells = F.filter(_cells(x), lambda i: keep(x[i]) & keep(x[i + 1]))
            return F.transform(cells, lambda i: (x[i + 1] - x[i]) * (y[i] + y[i + 1]) / 2)

        return let(lambda a: F.when(F.size(a) > 0, _sum(a)), a=let(over, y=y, x=x))

    return inside(lambda r: r < low), inside(lambda r: (r >= low) & (r <= high)), inside(lambda r: r > high)


def premium_curve(q: Column, p: Column, x: Column) -> Column:
    """(R - 1)(p - q)."""
    return let(lambda q, p, x: F.transform(_all(x), lambda i: (p[i] - q[i]) * (x[i] - 1)), q=q, p=p, x=x)


def kernel_curve(q: Column, p: Column) -> Column:
    """q / p; null where p is below 1e-15."""
    return F.zip_with(q, p, lambda u, v: F.when(v >= 1e-15, u / v))


def _all(x: Column) -> Column:
    return F.sequence(F.lit(0), F.size(x) - 1)


def hump(m: Column, x: Column, low: float = 0.9, high: float = 1.1, trough_from: float = 0.7) -> Column:
    """Struct (height, peak, trough): the greatest m on [low, high] less the least on [trough_from, peak); ties to the left."""

    def best(m: Column, inside: Column, greater: bool) -> Column:
        better = (lambda i, b: m[i] > m[b]) if greater else (lambda i, b: m[i] < m[b])
        return F.aggregate(inside, F.lit(None).cast("int"), lambda b, i: F.when(b.isNull() | better(i, b), i).otherwise(b))

    def at(m: Column, x: Column) -> Column:
        first = F.filter(_all(x), lambda i: (x[i] >= low) & (x[i] <= high) & m[i].isNotNull())

        def below(peak: Column) -> Column:
            second = F.filter(_all(x), lambda i: (x[i] >= trough_from) & (x[i] < x[peak]) & m[i].isNotNull())
            return let(lambda trough: F.struct((m[peak] - m[trough]).alias("height"), x[peak].alias("peak"), x[trough].alias("trough")), trough=best(m, second, False))

        return let(below, peak=best(m, first, True))

    return let(at, m=m, x=x)


def tilted(q: Column, x: Column) -> Column:
    """R q, normalised: the density under the other numeraire."""
    return normalised(F.zip_with(q, x, lambda v, r: v * r), x)


def bounded_contracts(q: Column, x: Column, bound: float) -> dict[str, Column]:
    """Second to fourth log moments of q within |ln R| <= bound, renormalised there: V, W and X in density space."""
    cut = F.zip_with(q, x, lambda v, r: F.when(F.abs(F.log(r)) <= bound, v).otherwise(F.lit(0.0)))
    inside = normalised(cut, x)
    return {n: moment(inside, x, lambda r, k=k: F.pow(F.log(r), F.lit(float(k)))) for n, k in (("v", 2), ("w", 3), ("x", 4))}


def premium_weights(theta: float = 2.0) -> tuple[float, float, float]:
    """Weights of the second, third and fourth moment in the premium's lower bound."""
    return 1.0, -(theta + 1.0) / 3.0, (theta + 1.0) * (theta + 2.0) / 12.0
